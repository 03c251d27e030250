"""The library's operators: known answers, properties, synthetic truths and contracts."""

import math
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.functions import special, stats
from corpuscle.functions.text import NgramTokenizer, RegexTokenizer
from corpuscle.operators import collocation, keyness, lexical, matching, resampling, semantic, senses, series, temporal
from corpuscle.operators.corpus import Corpus
from corpuscle.plans.compare import compare
from corpuscle.sources import baselines, readers, speeches
from corpuscle.streaming import online


def corpus(spark, texts, **columns):
    rows = [(i, t, *[c[i] for c in columns.values()]) for i, t in enumerate(texts)]
    return Corpus(spark.createDataFrame(rows, ["doc_id", "text", *columns]), "text", "doc_id")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# statistics


@pytest.mark.parametrize("a,n_a,b,n_b,want", [(12000, 1e6, 10000, 1e6, 182.0694), (10, 1000, 0, 1000, 20 * math.log(2)), (1000, 1e6, 1, 1e6, 1371.8641), (5, 100, 10, 200, 0.0)])
def test_log_likelihood_known(spark, a, n_a, b, n_b, want):
    assert value(spark, stats.g2(a, b, n_a, n_b)) == pytest.approx(want, abs=1e-3)
    assert value(spark, stats.g2(b, a, n_b, n_a)) == pytest.approx(-want, abs=1e-3)


def test_dunning_and_effects(spark):
    assert value(spark, stats.g2(12000, 10000, 1e6, 1e6, "dunning")) == pytest.approx(184.10, abs=0.02)
    assert value(spark, stats.log_ratio(1000, 100, 1e6, 1e6)) == pytest.approx(math.log2(1000.5 / 100.5))
    assert value(spark, stats.percent_diff(5, 0, 10, 10)) == math.inf
    assert math.isnan(value(spark, stats.percent_diff(0, 0, 10, 10)))
    with pytest.raises(ValueError):
        stats.g2(1, 1, 2, 2, "other")
    with pytest.raises(ValueError):
        stats.log_ratio(1, 1, 2, 2, 0)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 10_000), st.integers(10_000, 1_000_000), st.integers(10_000, 1_000_000))
def test_g2_properties(a, b, n_a, n_b):
    one = lambda *x: float(resampling.g2_array(*[np.array([float(v)]) for v in x])[0])
    g = one(a, b, n_a, n_b)
    assert math.isfinite(g)
    assert abs(g) == pytest.approx(abs(one(b, a, n_b, n_a)), abs=1e-6)
    assert 0 <= special.chi2_sf(abs(g)) <= 1


def test_tails():
    assert special.chi2_sf(1.0) == pytest.approx(0.3173105, abs=1e-6)
    assert special.chi2_sf(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 500), st.integers(1, 500))
def test_wilson(x, n):
    x = min(x, n)
    low, high = stats.wilson_interval(x, n)
    assert 0 <= low <= x / n + 1e-12 and x / n - 1e-12 <= high <= 1
    a, b = stats.wilson_interval(n - x, n)
    assert low == pytest.approx(1 - b) and high == pytest.approx(1 - a)


# text and corpus


def test_tokens_match_python(spark):
    texts = ["Café x² Ⅷ İstanbul ΣΑΣ 東京_1 a‿b", "naïve, co-op; it's", "", None]
    c = corpus(spark, texts)
    got = {r["doc_id"]: r["tokens"] for r in c.tokens().collect()}
    tok = RegexTokenizer()
    for i in (1, 2):
        assert got[i] == tok(texts[i])
    assert got[0][0] == "café" and got[3] == []
    grams = {r["doc_id"]: r["tokens"] for r in c.with_tokenizer(NgramTokenizer(n=2, include_lower=True)).tokens().collect()}
    assert grams[1][-1] == "it_s" and grams[2] == []
    own = c.with_tokenizer(lambda t: t.split(",")).tokens().collect()
    assert own[1]["tokens"] == ["naïve", " co-op; it's"]


def test_slices_and_contracts(spark):
    c = corpus(spark, ["a b", "b c", "c"], outlet=["x", "y", None])
    assert len(c.slice(outlet="x")) == 1 and len(c.slice(outlet=["x", None])) == 2
    assert c.slice(outlet="x").label == "outlet=x"
    with pytest.raises(KeyError):
        c.slice(nothing=1)
    with pytest.raises(ValueError):
        Corpus(c.df, "missing")
    assert c.total_tokens() == 5
    cells, columns = c.doc_term_counts_sparse()
    assert {r["term"]: r["column"] for r in columns.collect()} == {"a": 0, "b": 1, "c": 2} and cells.count() == 5
    assert c.fingerprint() == Corpus(c.df.repartition(3), "text", "doc_id").fingerprint()


def test_keyness_end_to_end(spark):
    a = corpus(spark, ["the migrant came and the migrant left"] * 30)
    b = corpus(spark, ["the asylum seeker came and left"] * 30)
    result = compare(a, b).keyness(dispersion=True, permutation_n=99, ci="bootstrap", n_boot=99, simultaneous_ci=True, min_count=1)
    t = result.table.toPandas().set_index("term")
    assert t.loc["migrant", "g2"] > 0 > t.loc["asylum", "g2"]
    assert t.loc["migrant", "p_permutation"] == pytest.approx(0.01) and t.loc["migrant", "g2_ci_lower"] > 0
    assert {"p_adjusted", "dispersion_flag", "g2_ci_upper_simultaneous"} <= set(t.columns)
    assert result.explain("migrant", 2).count() == 2
    assert "migrant" in result.summary() and "migrant" in result.to_json()
    again = compare(a, Corpus(b.df.repartition(7), "text", "doc_id")).keyness(permutation_n=99, min_count=1).table.toPandas().set_index("term")
    assert (again["p_permutation"].sort_index() == t["p_permutation"].sort_index()).all()
    with pytest.raises(ValueError):
        compare(a, b.where("false")).keyness()


def test_multi_equals_pairwise(spark):
    a, b = corpus(spark, ["x x y z"] * 5), corpus(spark, ["x y y w"] * 5)
    two = {r["term"]: abs(r["g2"]) for r in keyness.keyness(a, b).collect()}
    many = {r["term"]: r["g2"] for r in keyness.keyness_multi([a, b]).collect()}
    assert two.keys() == many.keys() and all(two[k] == pytest.approx(many[k]) for k in two)


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.005, float("nan"), 0.04]
    df = spark.createDataFrame(list(enumerate(p)), "i long, p_value double")
    got = {r["i"]: r["p_adjusted"] for r in keyness.adjusted(df, "bh").collect()}
    real = sorted((v, i) for i, v in enumerate(p) if v == v)
    run = 1.0
    for r, (v, i) in reversed(list(enumerate(real, 1))):
        run = min(run, v * len(real) / r)
        assert got[i] == pytest.approx(run)
    assert math.isnan(got[4])


def test_keyed_permutation():
    for n in (1, 2, 7, 1000):
        assert sorted(resampling.keyed_permutation(np.arange(n), n, 5).tolist()) == list(range(n))


def test_resampling_without_tables(spark, monkeypatch):
    monkeypatch.setattr(resampling, "TABLE_CELLS", 0)
    index = np.arange(50)
    assert (resampling.label_weights(index, 50, 20, 9, 1).sum(axis=0) == 20).all()
    assert resampling.draw_weights(np.arange(5000), 5000, 3, 1, 0).mean() == pytest.approx(1, abs=0.05)


# collocation


def test_collocates_and_network(spark):
    texts = ["a b c d e"] * 5
    c = corpus(spark, texts)
    edges = collocation.cooccurrence_network(c, window=1)[1].collect()
    assert {(r["source"], r["target"]) for r in edges} == {("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")}
    rng = random.Random(1)
    words = [rng.choice("xyzw") for _ in range(60)]
    got = {r["collocate"]: r["count"] for r in collocation.collocate_counts(corpus(spark, [" ".join(words)]), "x", 3).collect()}
    want = Counter(words[j] for i, w in enumerate(words) if w == "x" for j in range(max(0, i - 3), min(60, i + 4)) if j != i)
    assert got == dict(want)
    lines = collocation.kwic(corpus(spark, ["one two three"]), "two", 1).collect()
    assert (lines[0]["left"], lines[0]["right"], lines[0]["position"]) == ("one", "three", 1)
    with pytest.raises(ValueError):
        collocation.collocation_shift(c, c, "absent")


# diversity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=60), st.integers(1, 20))
def test_mattr_kernel(tokens, window):
    n = len(tokens)
    want = len(set(tokens)) / n if n < window else np.mean([len(set(tokens[i : i + window])) / window for i in range(n - window + 1)])
    assert lexical.mattr(tokens, window) == pytest.approx(want)


def test_pooled_equals_kernels(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    tokens = " ".join(texts).split()
    t = {r["metric"]: r["value"] for r in lexical.lexical_diversity(corpus(spark, texts), window=20).collect()}
    assert t["ttr"] == pytest.approx(lexical.ttr(tokens)) and t["mattr"] == pytest.approx(lexical.mattr(tokens, 20))
    assert t["mtld"] == pytest.approx(lexical.mtld(tokens)) and t["hdd"] == pytest.approx(lexical.hdd(tokens))
    assert lexical.rarefaction_from_counts(list(Counter(tokens).values()), 42) == pytest.approx(lexical.hdd(tokens))
    assert lexical.hill_from_counts([1, 1, 1, 1], 1) == pytest.approx(4)


# matching


def test_matching(spark):
    rng = random.Random(3)
    side = lambda p: corpus(spark, ["t"] * 40, year=[rng.randint(2010, 2010 + p) for _ in range(40)], party=[rng.choice("ABC") for _ in range(40)])
    m = matching.match(side(10), side(14), ["year", "party"], seed=1)
    assert m.a.df.count() == m.b.df.count() > 0
    joint = m.imbalance.filter("covariate = '(joint)'").first()
    assert joint["l1_post"] <= joint["l1_pre"] and joint["l1_post"] == pytest.approx(0)
    with pytest.raises(ValueError):
        matching.match(side(1), side(1), [])


# series


def test_series_kernels():
    rng = np.random.default_rng(0)
    step = np.concatenate((rng.normal(0, 0.1, 30), rng.normal(5, 0.1, 30)))
    for model in ("rbf", "l2", "normal"):
        assert any(28 <= c <= 32 for c in series.detect_changepoints(step, model=model))
    assert series.detect_changepoints(step, "binseg") and any(25 <= c <= 35 for c in series.detect_changepoints(step, "window", width=20))
    r = series.bocpd(np.concatenate((rng.normal(0.01, 0.005, 50), rng.normal(0.04, 0.005, 50))))
    assert r.map_run_length[48] > 30 and min(r.map_run_length[50:60]) <= 8
    assert np.allclose(r.posterior.sum(axis=1), 1) and np.allclose(r.cp_probability, 0.01)
    state = series.kleinberg_bursts(np.array([2, 2, 2, 30, 30, 30, 30, 30, 2, 2, 2]), np.full(11, 1000))
    assert (state[3:8] >= 1).all() and state[0] == state[-1] == 0
    its = series.interrupted(np.concatenate((np.zeros(20), np.full(20, 5.0))) + rng.normal(0, 0.01, 40), 20).set_index("coefficient")
    assert its.loc["level_change", "coef"] == pytest.approx(5, abs=0.1)
    flat = np.concatenate((np.zeros(20), np.full(10, 0.04)))
    table, m = series.causal_impact(flat, 20)
    assert m["avg_effect"] == pytest.approx(0.04, abs=1e-3) and tuple(table.columns) == series.IMPACT_COLUMNS
    point, low, high = series.forecast(np.linspace(0.1, 0.3, 12), 3)
    assert (low <= point).all() and (point <= high).all() and point[0] > 0.29
    for bad in (lambda: series.interrupted(np.zeros(3), 1), lambda: series.kleinberg_bursts([1], [0]), lambda: series.bocpd([1.0], hazard=2), lambda: series.causal_impact(np.zeros(5), 2)):
        with pytest.raises(ValueError):
            bad()


def test_trajectory(spark):
    texts, dates = [], []
    for year in range(1990, 2012):
        texts += ["old word here", "plain text"] if year < 2001 else ["new word here", "new text"]
        dates += [f"{year}-03-01", f"{year}-09-01"]
    c = corpus(spark, texts, date=dates)
    t = temporal.track(c, ["new", "old"]).over_time()
    rows = {(r["period_label"], r["term"]): r["count"] for r in t.table.collect()}
    assert rows["1995", "new"] == 0 and rows["2005", "new"] == 2 and rows["1995", "old"] == 1
    assert t.interrupted_time_series("2001-01-01", "new").count() == 4
    assert t.forecast(horizon=2).count() == 4 and t.to_combined(horizon=2).count() == 48
    assert t.changepoints("new", model="l2", penalty=0.01).count() >= 1
    before = compare.before_after(c, "2001-01-01")
    assert (len(before.a), len(before.b)) == (22, 22)
    with pytest.raises(ValueError):
        temporal.track(c, [])
    moved = semantic.semantic_trajectory(c, "word", freq="Y").toPandas()
    assert moved["distance_from_baseline"].iloc[0] == pytest.approx(0) and moved["distance_from_baseline"].iloc[-1] > 0.1
    assert temporal.forecast_semantic_drift(semantic.semantic_trajectory(c, "word")).filter("ci_lower < 0").count() == 0


# senses


def sense_rows(spark, new=True):
    rng = np.random.default_rng(1)
    centers = np.eye(20)[:4] * 5
    out = []
    for year in range(2000, 2021):
        for s in range(3):
            out += [(year, f"sense{s} words", (centers[s] + rng.normal(0, 0.5, 20)).tolist()) for _ in range(15)]
        if new and year >= 2012:
            out += [(year, "brandnew meaning", (centers[3] + rng.normal(0, 0.5, 20)).tolist()) for _ in range(15)]
    rows = [(i, y, t, v) for i, (y, t, v) in enumerate(out)]
    return spark.createDataFrame(rows, "doc_id long, year int, text string, embedding array<double>")


def test_sense_and_density_drift(spark):
    df = sense_rows(spark)
    got = senses.sense_drift(df, "year", range(2000, 2010), text_col="text", restarts=2)
    assert set(got.table.loc[got.table["drift"], "period"]) >= set(range(2013, 2021)) and got.change_type == "emergence"
    assert "brandnew" in got.drift_terms
    assert got.composition().count() > 0 and got.decline_report().count() == 3
    named = got.name_senses(senses.EchoAnnotator())
    assert len(named) == 4 and named["label"].str.startswith("sense-").all()
    for mode in ("reference", "cumulative"):
        knn = senses.knn_density_drift(df, "year", range(2000, 2010), mode=mode)
        flagged = knn.table.loc[knn.table["drift"], "period"].tolist()
        assert not [p for p in flagged if p < 2012] and (mode == "cumulative" or 2013 in flagged)
    calm = senses.sense_drift(sense_rows(spark, False), "year", range(2000, 2010), restarts=2, n_permutations=2)
    assert calm.p_value is not None
    with pytest.raises(ValueError):
        senses.sense_drift(df, "year", [1900])


def test_induce_senses(spark):
    df = sense_rows(spark, False).withColumn("ref", F.substring("text", 1, 6))
    for method in ("kmeans", "agglomerative"):
        r = senses.induce_senses(df, k=3, method=method, text_col="text", restarts=2)
        a = r.agreement_with("ref")
        assert a["ari"] == pytest.approx(1) and a["v_measure"] == pytest.approx(1)
    assert r.leakage_audit("ref").count() == 0 and r.contingency("ref").count() == 3


def test_semantic_shift(spark):
    a, b = corpus(spark, ["the cat sat here"] * 2), corpus(spark, ["a cat ran there"] * 2)
    t = semantic.semantic_shift(a, b, ["cat", "absent"]).toPandas().set_index("target")
    assert t.loc["cat", "cosine_distance"] > 0.1 and math.isnan(t.loc["absent", "cosine_distance"])
    assert semantic.semantic_shift(a, a, "cat").first()["cosine_distance"] == pytest.approx(0, abs=1e-9)
    with pytest.warns(FutureWarning):
        assert semantic.semantic_shift(a, b, "cat", align="procrustes").first()["cosine_distance"] == pytest.approx(0, abs=1e-6)
    assert {r["status"] for r in semantic.neighborhood_drift(a, b, "cat", min_count=1).collect()} <= {"shared", "gained_in_a", "lost_in_a"}


# sources


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\n\n  \ntwo\r\nthree")
    lines = readers.read_txt(spark, str(tmp_path / "t.txt"), "line").df.orderBy("line").collect()
    assert [(r["line"], r["text"]) for r in lines] == [(1, "one"), (4, "two"), (5, "three")]
    assert len(readers.read_txt(spark, str(tmp_path / "t.txt"))) == 1
    (tmp_path / "t.csv").write_text('text,n\n"a ""quoted"" line\nbreak",1\n')
    assert readers.read_csv(spark, str(tmp_path / "t.csv")).df.first()["text"] == 'a "quoted" line\nbreak'
    assert value(spark, readers.clean_html(F.lit("<p>a &amp; b</p>  c"))) == "a & b c"
    c = readers.from_dataframe(spark, pd.DataFrame({"text": ["a a b", "a c"]}), "text")
    base = baselines.baseline_from_corpus(c, "mine")
    assert base.total_tokens == 5 and base.counts.count() == 1
    baselines.save_baseline(base, str(tmp_path / "lists"))
    assert baselines.list_baselines(str(tmp_path / "lists")) == ["mine"]
    assert baselines.load_baseline(spark, "mine", str(tmp_path / "lists")).total_tokens == 5
    with pytest.raises(KeyError):
        baselines.load_baseline(spark, "other", str(tmp_path / "lists"))
    got = readers.from_dataset(spark, "x/y", lambda name, config, split: pd.DataFrame({"text": ["a", "b"], "k": [1, 2], "z": [0, 0]}), columns=["k"], n_rows=1)
    assert got.df.columns == ["text", "k"] and len(got) == 1
    assert len(speeches.generate(spark)) == 193
    calls = []

    def fetch(query):
        calls.append(query)
        return {"Results": [{"ContributionText": f"<b>t{query['skip'] + i}</b>", "MemberId": i % 2} for i in range(query["take"])], "TotalResultCount": 5}

    s = speeches.fetch_speeches(spark, "q", "2020", "2021", fetch, page_size=2, cache_dir=str(tmp_path), parties=lambda m: f"p{m}")
    assert len(s) == 5 and len(calls) == 3 and s.df.filter("party is null").count() == 0
    speeches.fetch_speeches(spark, "q", "2020", "2021", fetch, page_size=2, cache_dir=str(tmp_path))
    assert len(calls) == 3


# streams


def test_streams(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    rng = np.random.default_rng(4)
    values = np.concatenate((rng.normal(0, 1, 40), rng.normal(9, 1, 40)))
    rows = [("k", float(v), i) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "key string, v double, o long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("key string, v double, o long").parquet(src)
    q = online.online_changepoints(stream, "key", "v", "o", 0.0, 1.0).writeStream.format("memory").queryName("cp").outputMode("append").option("checkpointLocation", ck).start()
    q.processAllAvailable()
    q.stop()
    got = [r["map_run_length"] for r in spark.table("cp").orderBy("seq").collect()]
    want = series.bocpd(values, mu_0=0.0, beta_0=1.0, max_run_length=500).map_run_length.tolist()
    assert got == want
    handle = online.novelty_sink(str(tmp_path / "store"), str(tmp_path / "out"), 2)
    for epoch in (0, 1):
        handle(spark.createDataFrame([(epoch * 10 + i, [1.0, float(i == 4 and epoch)]) for i in range(5)], "id long, embedding array<double>"), epoch)
    found = {r["id"]: r["novelty"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found[10] == pytest.approx(0, abs=1e-9) and found[14] > 0.2


def test_batch_and_stream_windows_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = online.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("w")) == key(online.windowed_counts(events, "ts", "event_type"))


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60
    assert os.path.exists(entry.__file__)


# what runs over ranges, blocks and cells


def test_running_over_ranges(spark):
    from corpuscle.plans.storage import ranged, running

    rng = random.Random(1)
    values = [(v, rng.randint(-5, 9)) for v in rng.sample(range(1000), 200)]
    df = ranged(spark.createDataFrame(values, "k long, x long").repartition(4), "k")
    order = sorted(values)
    up = {r["k"]: r["s"] for r in running(df, "k", "sum", "x", "s").collect()}
    down = {r["k"]: r["m"] for r in running(df, "k", "min", "x", "m", backwards=True).collect()}
    for i, (k, _) in enumerate(order):
        assert up[k] == sum(x for _, x in order[: i + 1]) and down[k] == min(x for _, x in order[i:])


def test_moving_ratio_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 1)
    rng = random.Random(2)
    tokens = {g: [rng.choice("abcdefgh") for _ in range(n)] for g, n in (("x", 150), ("y", 33), ("z", 3))}
    df = spark.createDataFrame([(g, i, t) for g, ts in tokens.items() for i, t in enumerate(ts)], "grp string, pos long, term string")
    got = {r["grp"]: r["mattr"] for r in lexical.pooled_mattr(df, 5).collect()}
    assert got == {g: pytest.approx(lexical.mattr(ts, 5)) for g, ts in tokens.items()}


def test_ward_by_weight():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 3))
    w = rng.integers(1, 4, 30)
    small, big = senses.ward(x, 4, w), senses.ward(np.repeat(x, w, axis=0), 4)
    assert senses.ward(x, 30).tolist() == list(range(30))
    at = np.cumsum(w) - w
    same = lambda v: (v[:, None] == v[None]).astype(int)
    assert (same(small) == same(big[at])).all()


def test_merging_sees_all_rows(spark, monkeypatch):
    """A sense held by a handful of rows is found beyond the sample's size too."""
    monkeypatch.setattr(senses, "SAMPLE", 40)
    monkeypatch.setattr(senses, "MICRO", 12)
    rng = np.random.default_rng(4)
    centers = np.eye(3) * 10
    labels = [0] * 150 + [1] * 150 + [2] * 5
    rows = [(i, (centers[g] + rng.normal(scale=0.1, size=3)).tolist(), g) for i, g in enumerate(labels)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>, label int")
    for part in (df, df.filter("doc_id % 10 = 0 or label = 2")):
        found = senses.induce_senses(part, k=3, method="agglomerative")
        assert found.agreement_with("label")["ari"] == pytest.approx(1.0)


def test_neighbours_through_an_index(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)) + np.repeat(np.eye(8)[:4] * 12, 100, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "id long, period int, x array<double>")
    exact = {r["id"]: r["novelty"] for r in senses.knn_novelty(df, df, 5, block=64).collect()}
    index = senses.knn_index(df, cells=8)
    got = {r["id"]: r["novelty"] for r in senses.knn_novelty(df, df, 5, block=64, index=index, probes=4).collect()}
    assert got.keys() == exact.keys() and sum(abs(got[i] - exact[i]) < 1e-9 for i in got) >= 0.9 * len(got)
    whole = {r["id"]: r["novelty"] for r in senses.knn_novelty(df, df, 5, index=index, probes=8).collect()}
    assert whole == {i: pytest.approx(v) for i, v in exact.items()}


def test_hashed_replicates():
    labels = resampling._label_table(50, 20, 99, 7)
    assert (labels.sum(axis=0) == 20).all() and len({c.tobytes() for c in labels.T}) == 99
    drawn = resampling._draw_table(50, 99, 7, 0)
    assert (drawn.sum(axis=0) == 50).all() and 0.3 < (drawn == 0).mean() < 0.45


def test_shared_folder_is_demanded_on_a_cluster():
    from corpuscle.plans import storage

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class No:
                            isDefined = staticmethod(lambda: False)

                        return No

                return S

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        sparkContext = Context

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)
