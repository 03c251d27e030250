"""What the queries hold, read and pass on, beside their results."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators.corpus import Corpus


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, texts, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
    return Corpus(spark.createDataFrame(rows, ["doc_id", "text", *more]), "text", "doc_id")


@pytest.mark.parametrize("form", list(text.NORMALIZERS))
def test_texts_are_normalised_without_python(spark, form):
    texts = ["café ﬁn ẛ̣", "Å Ω 가 가", "plain", "", "क़\U0001d15e \U0002f800", None]
    tokenizer = text.RegexTokenizer(normalize=form)
    df = corpus(spark, texts).with_tokenizer(tokenizer).token_lists("doc_id")
    assert "Python" not in plan_of(df)
    assert {r["doc_id"]: r["tokens"] for r in df.collect()} == {i: tokenizer(t or "") for i, t in enumerate(texts)}
    got = spark.createDataFrame([(t or "",) for t in texts], "t string").select("t", text.normal(F.col("t"), form).alias("n")).collect()
    assert all(r["n"] == unicodedata.normalize(form, r["t"]) for r in got)


def test_replicates_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    """The same draws, labels and intervals whatever the input's size is to the limits."""
    from corpuscle.operators import resampling as r

    rng = np.random.default_rng(1)
    words = np.array(list("abcdefghij"))
    docs = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)]
    c = corpus(spark, docs, side=[int(i % 3 == 0) for i in range(60)])
    a, b = c.slice(side=0), c.slice(side=1)
    rows = lambda df: {x["term"]: tuple(x)[1:] for x in df.collect()}
    runs = []
    for cells in (1_000_000, 40, 0):
        monkeypatch.setattr(r, "TABLE_CELLS", cells)
        found = (rows(r.permutation_pvalues(a, b, n_permutations=49, seed=3)), rows(r.bootstrap_g2_ci(a, b, n_boot=49, seed=3, simultaneous=True)))
        runs.append((r.draw_weights(np.arange(50), 50, 9, 7, 0), r.label_weights(np.arange(50), 50, 20, 9, 7), found))
        # n draws and n_a labels, from the hashed numbers that the SQL has too
        for k in range(9):
            drawn = (r._stream(7 * 1_000_003 + 2 * k + 500_009, 50) % np.uint64(50)).astype(int)
            assert (runs[-1][0][:, k] == np.bincount(drawn, minlength=50)).all()
            assert set(np.flatnonzero(runs[-1][1][:, k])) == set(np.argsort(r._stream(7 * 1_000_003 + k + 1, 50))[:20])
    for draws, labels, (p, ci) in runs[1:]:
        assert (draws == runs[0][0]).all() and (labels == runs[0][1]).all() and p == runs[0][2][0]
        assert ci.keys() == runs[0][2][1].keys() and all(v == pytest.approx(runs[0][2][1][t]) for t, v in ci.items())


def test_terms_settled_in_parts(spark, monkeypatch):
    from corpuscle.operators import resampling as r

    cells = spark.createDataFrame([(f"t{i % 30:02d}", 0, i, 1 + i % 4) for i in range(300)], "term string, side int, index long, n long")
    count = lambda number, side, index, n, terms: {"s": np.bincount(number, n, terms), "k": np.bincount(number, minlength=terms)}
    want = {(f"t{i:02d}", float(sum(1 + j % 4 for j in range(i, 300, 30))), 10) for i in range(30)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for held in (1_000_000, 8):
            monkeypatch.setattr(r, "TASK_CELLS", held)
            assert {tuple(x) for x in r._per_term(cells, count, "term string, s double, k long").collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_label_limit():
    from corpuscle.operators import resampling as r

    for n, n_a in ((1, 1), (2, 1), (9, 8), (3000, 7), (3000, 2993), (200_000, 90_000)):
        h = np.sort(r._stream(5 * 1_000_003 + 3, n))
        assert r.label_limit(n, n_a, 2, 5) == int(h[n_a - 1])


@pytest.mark.parametrize("limit", [20_000, 1])
def test_centroids_pass_on_sums_only(spark, monkeypatch, limit):
    """no text and no vector of one is shuffled."""
    from corpuscle.operators import semantic

    monkeypatch.setattr(semantic, "SUMS", limit)
    texts = spark.createDataFrame([(k, t) for k in "xyz" for t in ["ab", "abc", "ab", k * 3]], "k string, text string").repartition(2)
    got = semantic._centroids(texts, ["k"], semantic.LetterEmbedder())
    assert "posexplode" not in plan_of(got) and "text" not in plan_of(got).split("Exchange hashpartitioning(k")[0]
    for r in got.collect():
        assert r["n"] == 4 and r["centroid"] == pytest.approx(semantic.LetterEmbedder().encode(["ab", "abc", "ab", r["k"] * 3]).mean(axis=0))


@pytest.mark.parametrize("pairs", [8192, 3])
def test_rotation_pairs_texts_by_place(spark, monkeypatch, pairs):
    """the pairs are those of the k-th texts of both sides, repeats included, in blocks."""
    from corpuscle.operators import semantic

    monkeypatch.setattr(semantic, "PAIRS", pairs)
    rng = np.random.default_rng(2)
    a, b = (corpus(spark, [" ".join(rng.choice(list("vwxyz"), 3)) + " cat dog" for _ in range(n)]) for n in (25, 17))
    e = semantic.HashEmbedder(8)
    with pytest.warns(FutureWarning):
        got = semantic.semantic_shift(a, b, ["cat", "dog"], e, window=2, align="procrustes").collect()
    m, centers = 0, {}
    for target in ("cat", "dog"):
        x, y = (e.encode(sorted(r["text"] for r in semantic.window_texts(s, [target], 2).collect())) for s in (a, b))
        m = m + y[:17].T @ x[:17]
        centers[target] = x.mean(axis=0), y.mean(axis=0)
    u, _, v = np.linalg.svd(m)
    for r in got:
        p, q = centers[r["target"]]
        q = q @ u @ v
        assert r["cosine_similarity"] == pytest.approx(p @ q / np.linalg.norm(p) / np.linalg.norm(q))


def test_neighbours_in_blocks_that_grow(spark, monkeypatch):
    """a row is shuffled for as many blocks as there are, and pieces give the same neighbours."""
    from corpuscle.operators import senses

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "id long, period int, x array<double>")
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    period = np.arange(300) % 4
    late = np.where(period[None] < period[:, None], sims, -np.inf)
    monkeypatch.setattr(senses, "BLOCK", 10)
    for blocks, full, cells in ((3, 1000, 2_000_000), (3, 50, 512 * 11), (1, 1000, 1)):
        for name, v in (("BLOCKS", blocks), ("FULL_BLOCK", full), ("CELLS", cells)):
            monkeypatch.setattr(senses, name, v)
        for earlier, s in ((False, sims), (True, late)):
            got = {r["id"]: r["novelty"] for r in senses.knn_novelty(df, df, 7, earlier_only=earlier).collect()}
            assert len(got) == 300
            for i in range(300):
                best = np.sort(s[i])[-7:]
                assert got[i] == pytest.approx(1 - best.mean() if np.isfinite(best).all() else 0.0)


def test_distances_in_pieces(monkeypatch):
    """rows and centroids meet a few rows at a time, with the same numbers."""
    from corpuscle.operators import senses

    rng = np.random.default_rng(7)
    x, c = rng.normal(size=(100, 6)), rng.normal(size=(9, 6))
    want, seen, norm = np.linalg.norm(x[:, None] - c[None], axis=2), [], np.linalg.norm
    monkeypatch.setattr(senses, "CELLS", 200)
    monkeypatch.setattr(senses.np.linalg, "norm", lambda v, axis: seen.append(v.size) or norm(v, axis=axis))
    assert (senses.distances(x, c) == want).all() and max(seen) <= 200 and senses.distances(x[:0], c).shape == (0, 9)


def test_shuffled_periods_are_made_once(spark, monkeypatch):
    """ids are numbered once for all permutations, and a permutation is a table; k-means of few rows is one task."""
    from corpuscle.operators import senses

    rng = np.random.default_rng(8)
    rows = [(i, i % 6, rng.normal(size=4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, year int, embedding array<double>").repartition(4)
    calls, tasks, index = [], [], senses.dense_index
    monkeypatch.setattr(senses, "dense_index", lambda *a: calls.append(a) or index(*a))
    fit = senses.KMeans.fit
    monkeypatch.setattr(senses.KMeans, "fit", lambda self, v: tasks.append(v.rdd.getNumPartitions()) or fit(self, v))
    got = senses.sense_drift(df, "year", [0, 1], k=2, n_permutations=3, restarts=1)
    assert got.p_value is not None and len(calls) == 1 and set(tasks) == {1}
    mixed = senses.shuffled_periods(df.withColumn("period", F.col("year")), "doc_id", 5)
    assert "Join" not in plan_of(mixed)
    assert sorted(r["period"] for r in mixed.collect()) == sorted(i % 6 for i in range(120))


def test_mtld_in_blocks(spark, monkeypatch):
    """no task sees a whole group; factors that span blocks are those of one pass."""
    from corpuscle.operators import lexical

    rng = np.random.default_rng(9)
    tokens = {"x": [str(v) for v in rng.integers(0, 40, 900)], "y": [str(i) for i in range(70)], "z": list("aabbaab"), "w": ["a"]}
    df = spark.createDataFrame([(g, i, t) for g, ts in tokens.items() for i, t in enumerate(ts)], "grp string, pos long, term string").repartition(3)
    for block, rounds in ((50, 12), (1000, 12), (10, 1)):
        monkeypatch.setattr(lexical, "BLOCK", block)
        monkeypatch.setattr(lexical, "ROUNDS", rounds)
        got = {r["grp"]: r["mtld"] for r in lexical.pooled_mtld(df).collect()}
        assert got == {g: pytest.approx(lexical.mtld(ts), nan_ok=True) for g, ts in tokens.items()}


def test_intervals_by_weights(spark, monkeypatch):
    """replicates are not drawn row by row, and have the documents that xxhash64 draws."""
    import datetime

    from corpuscle.operators import lexical

    day = datetime.date(2001, 1, 1)
    want = spark.range(37).select(F.pmod(F.xxhash64(F.lit(day), F.lit(4), F.col("id").cast("int"), F.lit(-3)), F.lit(37)).alias("s"))
    want = np.bincount([r["s"] for r in want.collect()], minlength=37)
    assert (lexical.drawn_weights(day, 37, [4], -3)[:, 0] == want).all()
    rng = np.random.default_rng(10)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 5))) for _ in range(50)]
    c = corpus(spark, texts, date=[f"200{1 + i % 2}-05-01" for i in range(50)])
    monkeypatch.setattr(lexical, "_in_order", lambda *a: pytest.fail("drawn row by row"))
    got = lexical.lexical_diversity(c, freq="Y", metrics=("ttr", "hdd"), ci=True, n_boot=29, seed=5).collect()
    for r in got:
        own = [texts[i].split() for i in range(50) if 1 + i % 2 == r["period"].year - 2000]
        w = lexical.drawn_weights(r["period"], 25, range(29), 5)
        kernel = {"ttr": lexical.ttr, "hdd": lexical.hdd}[r["metric"]]
        x = [kernel([t for i, d in enumerate(own) for _ in range(w[i, b]) for t in d]) for b in range(29)]
        assert (r["ci_lower"], r["ci_upper"]) == (pytest.approx(np.quantile(x, 0.025)), pytest.approx(np.quantile(x, 0.975)))


@pytest.mark.parametrize("small", [200_000, 0])
def test_cells_of_kept_terms(spark, monkeypatch, small):
    """F16: rare terms go before the shuffle, ids may repeat, and columns are in the terms' order."""
    from collections import Counter

    from corpuscle.operators import corpus as module

    monkeypatch.setattr(module, "SMALL", small)
    rows = [(1, "b a Z é"), (1, "a a c"), (2, "b é"), (3, None), (None, "a b"), (4, "x y")]
    c = Corpus(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    want = Counter((i, t) for i, x in rows for t in (x or "").lower().split())
    every = Counter(t for (_, t), n in want.items() for _ in range(n))
    kept = sorted(t for t, n in every.items() if n >= 2)
    df = c.doc_term_counts(2)
    if small:
        assert plan_of(df).count("Exchange hashpartitioning") == 1
    assert {(r["doc_id"], r["term"]): r["n"] for r in df.collect()} == {k: n for k, n in want.items() if k[1] in kept}
    cells, columns = c.doc_term_counts_sparse(2)
    assert {r["column"]: r["term"] for r in columns.collect()} == dict(enumerate(kept))
    assert {(r["doc_id"], kept[r["column"]]): r["n"] for r in cells.collect()} == {k: n for k, n in want.items() if k[1] in kept}


def test_dispersion_cuts_texts_once(spark, monkeypatch):
    """the cells are a table for all that is counted of them."""
    from corpuscle.operators import keyness

    reads, lists = [], Corpus.token_lists
    monkeypatch.setattr(Corpus, "token_lists", lambda self, *keep: reads.append(keep) or lists(self, *keep))
    got = keyness.dispersion_dp(corpus(spark, ["a a b", "b c", "a"]))
    assert len(reads) == 1 and "regexp" not in plan_of(got) and "c" in {r["term"] for r in got.collect()}
    share = np.array([3, 2, 1]) / 6
    want = {t: 0.5 * np.abs(np.array(n) / sum(n) - share).sum() for t, n in {"a": (2, 0, 1), "b": (1, 1, 0), "c": (0, 1, 0)}.items()}
    assert {r["term"]: r["dp"] for r in got.collect()} == {t: pytest.approx(v) for t, v in want.items()}
