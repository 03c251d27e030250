"""Places where the operators once did less than the whole job."""

import datetime
import hashlib
import random
import re
import struct
import time

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuscle.llm import bpe, debruijn, decontam, imatch, licenses, secrets, shingles, simhash, suffixdedup, toxicity, urlfilter

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_reaches_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120, 300]))]
        rows.append((i, " ".join(words)))
        for c in range(rng.randrange(3)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = "edited"
            rows.append((100 + 3 * i + c, " ".join(copy)))
    rows += [(900, "notice stands here for all " * 8), (901, "notice stands here for all " * 9), (902, ""), (903, None)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if (w := (t or "").split()) else set() for i, t in rows}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if (x or y) and 5 * len(x & y) >= 4 * len(x | y) or not (x or y):
                p, q = sorted((find(a), find(b)))
                least[q] = p
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    assert kept == {i for i in ids if find(i) == i}


def test_decontamination_of_null_ids(spark):
    passage = " ".join(f"item{i}" for i in range(20))
    docs = spark.createDataFrame([(None, f"before {passage} after"), (1, passage), (2, "clean words")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = []
    for rows in (decontam.BROADCAST_ROWS, 0):
        found = decontam.contamination(docs, benchmark, broadcast_rows=rows).select("doc_id", "n_words", "n_hit", "contaminated")
        got.append(sorted(map(tuple, found.collect()), key=str))
    assert got[0] == got[1] == [(1, 20, 20, True), (2, 2, 0, False), (None, 22, 20, True)]


# every operator, and every stage, on odd tables


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, offending string, _text_key string, _node string, _s string, _e string, key string, h string, n string"
EXTRA = ("en", None, 5, "mine", "own", "k", "n", "s", "e", "key", "h", "n")


def odd(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA).coalesce(1)


def bench(spark):
    return spark.createDataFrame([(1, "a secret question of the test that no text should hold at all here")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda spark, df: toxicity.score(df, MODEL),
    "drop_toxic": lambda spark, df: toxicity.drop_toxic(df, MODEL),
    "decontamination": lambda spark, df: decontam.contamination(df, bench(spark)),
    "decontamination by shuffle": lambda spark, df: decontam.contamination(df, bench(spark), broadcast_rows=0),
    "remove": lambda spark, df: decontam.remove(df, bench(spark)),
    "licenses": lambda spark, df: licenses.scan(df, F.col("source")),
    "bpe": lambda spark, df: bpe.encode(df),
    "simhash": lambda spark, df: simhash.near_duplicates(df),
    "simhash keep_one": lambda spark, df: simhash.keep_one(df),
    "shingles keep_one": lambda spark, df: shingles.keep_one(df),
    "imatch": lambda spark, df: imatch.compare_with_edits(df, imatch.lexicon(df)),
    "suffixdedup": lambda spark, df: suffixdedup.deduplicate(df),
    "secrets": lambda spark, df: secrets.scan(df, FOREST),
    "redact": lambda spark, df: secrets.redact(df, FOREST),
    "debruijn": lambda spark, df: debruijn.deduplicate(df),
    "urlfilter": lambda spark, df: urlfilter.judge(df, "doc_id", "text"),
    "keep_allowed": lambda spark, df: urlfilter.keep_allowed(df, "text"),
}
MODEL = toxicity.ToxicityModel(-6.0, {"idiot": 12.0})
FOREST = secrets.train(secrets.labelled_findings(300))
KEPT = {"drop_toxic", "remove", "simhash keep_one", "shingles keep_one", "redact", "keep_allowed"}
ROWS = [(None, None), (None, "you idiot"), (3, ""), (3, "other text of one id"), (4, "same text"), (4, "same text"), (2**60 + 1, "plain words, and more"), (9, "a secret question of the test that no text should hold at all here")]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    run = OPERATORS[name]
    assert run(spark, odd(spark, [])).collect() == []
    df = odd(spark, ROWS)
    got = run(spark, df)
    rows = got.collect()
    ids = {r["doc_id"] for r in rows} if "doc_id" in got.columns else None
    if name in KEPT:
        assert got.columns == df.columns
        mine = {tuple(r) for r in df.collect()}
        if name != "redact":
            assert {tuple(r) for r in rows} <= mine
        assert 2**60 + 1 in ids
    elif name not in ("secrets",):
        assert ids == {i for i, _ in ROWS}


def test_kept_rows(spark):
    df = odd(spark, ROWS)
    texts = lambda got: sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert (0, "you idiot") not in texts(toxicity.drop_toxic(df, MODEL))
    assert len(texts(decontam.remove(df, bench(spark)))) == 7
    for kept in (simhash.keep_one(df), shingles.keep_one(df)):
        got = texts(kept)
        # null and empty texts are one class; equal rows are one; different texts of one id stay
        assert got.count((4, "same text")) == 1 and (3, "other text of one id") in got and (3, "") in got and (0, "") not in got
    many = odd(spark, [(5, "one two three four five six seven eight"), (5, "nine ten eleven twelve thirteen fourteen"), (7, "nine ten eleven twelve thirteen fourteen"), (3, "one two three four five six seven eight")])
    for kept in (simhash.keep_one(many), shingles.keep_one(many)):
        assert texts(kept) == [(3, "one two three four five six seven eight"), (5, "nine ten eleven twelve thirteen fourteen")]


def test_imatch_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 3)
    texts = [f"text number {i} of these" for i in range(14)]
    for kind, ids in (("string", [f"id{i:02}" for i in range(14)]), ("long", [2**60 + i for i in range(14)]), ("date", [datetime.date(2020, 1, 1 + i) for i in range(14)])):
        df = spark.createDataFrame([*zip(ids, texts), (None, "without")], f"doc_id {kind}, text string")
        got = {r["doc_id"]: r for r in imatch.compare_with_edits(df, imatch.lexicon(df)).collect()}
        order = [None, *ids]
        for i, t in enumerate([*texts, "without"]):
            me = [*ids, None][i]
            following = ([*texts][order.index(me) - 2] if order.index(me) > 1 else "without") if me is not None else texts[-1]
            k = len(t) // 3
            assert got[me]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()


def brute_fingerprint(text, codes, levels):
    """Sets of the text's lexicon terms, straight from the definition."""
    own = {int(c) for c in imatch.term_codes(text, imatch._Codes())}
    known = [i for i, c in enumerate(codes) if int(c) in own]
    mixed = lambda x: int(imatch.mixed(np.array([x % 2**64], np.uint64))[0])
    out = []
    for s in range(imatch.SETS):
        if not known:
            total = sum(map(mixed, own)) % 2**64 >> 52 if own else 0
            out.append(min(15, max(1, len(own))) << 12 | total)
            continue
        r, level = divmod(s - 1, imatch.LEVELS)
        inside = known if s == 0 else [i for i in known if levels[r][i] >= level + 1]
        total = sum(mixed(int(codes[i]) + s) for i in inside) % 2**64 >> 52
        out.append(min(len(inside), 15) << 12 | total if inside else 0)
    return out


def test_imatch_against_definition():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(30)] + ["", "unknown words only"]
    terms = imatch.term_codes(" ".join(words[:40]), imatch._Codes())
    lex = imatch.Lexicon.of(terms)
    got = imatch.fingerprint_table(texts, lex, imatch._Codes())
    want = [brute_fingerprint(t, lex.codes, lex.levels) for t in texts]
    assert got.astype(int).tolist() == want
    near = imatch.likeness(got[:-1], got[1:])
    for a, b, n in zip(want, want[1:], near):
        some = [(x, y) for x, y in zip(a, b) if x or y]
        fine = [(x, y) for x, y in some if x >> 12 <= 2 and y >> 12 <= 2]
        use = fine if len(fine) >= 3 else some
        assert n == (1.0 if a == b else pytest.approx(sum(x == y for x, y in use) / max(1, len(use))))


def test_simhash_bits_against_definition():
    rng = random.Random(9)
    texts = [None, "", " \x0b", "one", "A b  C\td", "É é B"] + [" ".join(rng.choices(["a", "B", "ç", "dd", "e f"], k=rng.randint(1, 60))) for _ in range(60)]
    got = simhash.fingerprints(pd.Series(texts, dtype=object)).view(np.uint64)
    for t, fp in zip(texts, got):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
        grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)] if words else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert int(fp) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_hot_bucket_is_parted(spark):
    """All fingerprints share the bits of some tables; further masks find the same links."""
    rng = random.Random(12)
    base = [rng.getrandbits(16) << 40 for _ in range(30)]
    fps = sorted({b ^ sum(1 << rng.randrange(40, 60) for _ in range(rng.randint(0, 3))) for b in base for _ in range(4)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")

    def classes(rows):
        own = {x: x for x in fps}

        def top(x):
            while own[x] != x:
                x = own[x]
            return x

        for r in rows:
            own[top(r["src"])] = top(r["dst"])
        return {frozenset(y for y in fps if top(y) == top(x)) for x in fps}

    want = [{"src": x, "dst": y} for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 4]
    assert classes(simhash.links(df, block=4, blocks=2).collect()) == classes(want)


def test_toxicity_gradient():
    rng = np.random.default_rng(3)
    rows, cols = np.repeat(np.arange(6), 2), rng.integers(0, 5, 12)
    bags = toxicity.Bags(rows, cols, np.array([0, 0, 1, 2, 2, 3]), np.array([1.0, 0, 2, 0, 3]), np.array([1.0, 0, 1, 0, 0]))
    w, b = rng.normal(size=5), -0.7
    loss, grad = bags.loss_and_gradient(w, b)
    # the loss, sentence by sentence
    total = 0.0
    for d in range(5):
        zs = [w[cols[rows == s]].sum() + b for s in np.flatnonzero(bags.owner == d)] + [b] * int(bags.plain[d])
        p = 1 - np.prod([1 - 1 / (1 + np.exp(-z)) for z in zs])
        total -= np.log(p) if bags.y[d] else np.log(1 - p)
    assert loss == pytest.approx(total / 5 + 1e-5 * (w @ w) / 2)
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-6
        up, down = (bags.loss_and_gradient(w + s * step[:5], b + s * step[5])[0] for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_toxicity_held_out_rows(spark):
    """On the given tables: nearly all toxic documents of the held-out fifth, and hardly a clean one."""
    from zlib import crc32

    d, labels = (pd.read_parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    both = d.merge(labels.dropna(subset=["toxic"]).groupby("doc_id").toxic.max().reset_index(), on="doc_id")
    out = both.doc_id.map(lambda i: crc32(str(i).encode()) % 5 == 0)
    model = toxicity.fit(both[~out].text.fillna("").tolist(), both[~out].toxic.astype(int).tolist())
    scorer = toxicity.Scorer(model)
    p = np.array([-np.expm1(-toxicity._softplus(np.array(scorer.sentence_scores(t))).sum()) for t in both[out].text])
    y = both[out].toxic.to_numpy() > 0
    assert ((p >= 0.5) & y).sum() >= 0.8 * y.sum() and ((p >= 0.5) & ~y).sum() <= 0.02 * (~y).sum()


def test_decontamination_of_a_long_text(spark):
    """Work grows with the text: 200,000 words of which one window is hit, and a second text of windows alone."""
    item = [f"item{i}" for i in range(30)]
    words = [f"w{i % 997}" for i in range(200_000)]
    words[150_000:150_020] = item[:20]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(item * 200))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for limit in (decontam.BROADCAST_ROWS, 0):
        got = {r["doc_id"]: r for r in decontam.contamination(df, items, broadcast_rows=limit).collect()}
        assert (got[1]["n_words"], got[1]["n_hit"], got[1]["contaminated"]) == (200_000, 20, False)
        assert (got[2]["n_words"], got[2]["n_hit"], got[2]["contaminated"]) == (6_000, 6_000, True)
    cut = {r["doc_id"]: r["text"] for r in decontam.remove(df, items).collect()}
    assert set(cut) == {1} and cut[1].split() == words[:150_000] + words[150_020:]


def test_pieces_without_a_shared_boundary():
    path, pattern = bpe.default_tokenizer()
    one = bpe._encoding(path, pattern).encode_ordinary
    rng = random.Random(2)
    parts = ["x" * 70, " ", " ", "  \n", "word", "123456789", "é", "'ll", "!?"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        got = bpe.pieces(text, pattern, 32, 8)
        assert "".join(got) == text and [i for p in got for i in one(p)] == one(text)
    long = "ab " * 400 + "x" * 500 + " cd" * 400
    assert max(map(len, bpe.pieces(long, pattern, 32, 8))) < 600


def test_long_texts_are_spread(spark):
    path, pattern = bpe.default_tokenizer()
    one = bpe._encoding(path, pattern).encode_ordinary
    texts = ["ab " * 60 + "x" * 300 + " cd e" * 90, "y" * 400, "  " * 90 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(df, chunk_chars=32, overlap_chars=8, long_chars=64).collect():
        assert list(r["ids"]) == one(texts[r["doc_id"]])


def test_rules_by_join_and_by_index(spark):
    rng = random.Random(1)
    hosts = ["casino.example.net", "free-bets.example.com", "www.bet-bonus.io", "a.com", "x.example.org", "plain.net", "ads-track.example.net", "roulettehub.co"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['en/1', 'fr/a', 'de/', '', 'es/x'])}{rng.choice(['', '?u=://casino.com', '#f'])}" for _ in range(80)] + [None, "casino.com", "http://"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (*urlfilter.HOST_RULES, *urlfilter.PATTERN_RULES[:40], *map(urlfilter.label_rule, ("bet-bonus", "ads-track", "roulettehub")), urlfilter.pattern_rule("[?]u=", "allow", ()), urlfilter.pattern_rule("/plain", "block", ()))
    rows = lambda got: sorted(map(str, got.collect()))
    found = urlfilter.judge(df, rules=rules, with_tried=True)
    assert rows(found) == rows(urlfilter.judge(df, rules=rules, broadcast_rules=0, with_tried=True))
    # by trying every rule
    for r in found.collect():
        url = urls[r["page_id"]]
        host, path = urlfilter.split_url(url)
        ok = [x for x in rules if url and "://" in url and urlfilter.fits(x, url.lower(), host, path)]
        best = max([x for x in ok if x.kind == "host"], key=lambda x: len(x.text), default=None)
        other = min([x for x in ok if x.kind != "host"], key=lambda x: (x.action != "block", x.text), default=None)
        assert r["rule"] == (best.text if best else None) and r["pattern"] == (other.text if other and not best else None)
        assert r["verdict"] == (best or other or urlfilter.HOST_RULES[0]).action


def test_wrapped_headers_and_licence_files(spark):
    gpl = "/*\n * This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU General\n * Public License as published by the Free Software Foundation,\n * either version 3 of the License, or (at your option) any later version.\n */\nint main() {}\n"
    data = [
        ("p/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\nEveryone is permitted to copy.\n"), ("p/src/a.c", gpl), ("p/src/b.c", "int b;\n"),
        ("p/sub/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files\n"), ("p/sub/x/c.c", "int c;"), ("q/d.c", "# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance with the License.\nx = 1\n"),
    ]
    filler = [(f"z/{i}.txt", f"plain words number {i} of the general program version 2 and 3") for i in range(60)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(data + filler)], "doc_id long, path string, text string")
    got = {r["path"]: (r["license"], r["inherited"], r["final"]) for r in licenses.scan(df, F.col("path")).collect()}
    assert got["p/COPYING"][0] == "GPL-2.0" and got["p/src/a.c"] == ("GPL-3.0", "GPL-2.0", "GPL-3.0") and got["p/src/b.c"] == (None, "GPL-2.0", "GPL-2.0")
    assert got["p/sub/LICENSE"][0] == "MIT" and got["p/sub/x/c.c"] == (None, "MIT", "MIT") and got["q/d.c"][2] == "Apache-2.0"
    assert all(got[p] == (None, None, None) for p, _ in filler)


def test_secrets_of_families_not_seen():
    """A fifth of the families at a time is kept from the forest and judged by it."""
    names = sorted([*secrets.SECRET_FAMILIES, *secrets.OTHER_FAMILIES])
    right = {0: [0, 0], 1: [0, 0]}
    for fold in range(5):
        out = tuple(names[fold::5])
        model = secrets.train(secrets.labelled_findings(1500, seed=fold, without=out))
        for before, value, after, path, label in secrets.labelled_findings(300, seed=50 + fold, only=out):
            kind = next((k for a, b, k in secrets.candidates(before + value + after) if a < len(before) + len(value) and b > len(before)), "opaque")
            p = model.predict(np.array([secrets.describe(before[-48:], value, after[:48], path, kind)]))[0]
            right[label][0] += (p >= 0.5) == bool(label)
            right[label][1] += 1
    assert right[1][0] / right[1][1] > 0.8 and right[0][0] / right[0][1] > 0.7


def test_secrets_in_documents(spark):
    """The documents assign hexadecimal tokens, and hold long numbers that are none."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = secrets.scan(df).collect()
    assert {(r["kind"], r["is_secret"]) for r in rows} == {("assigned", True), ("number", False)}
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in rows:
        value = text[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert hashlib.sha256(value.encode()).hexdigest() == r["sha256"] and value not in str(r)


# the pipeline, stage by stage against what it should keep


def test_pipeline_by_brute_force(spark):
    words = lambda seed, n: " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=n))
    item = " ".join(f"item{i}" for i in range(20))
    filler = [(100 + i, words(i, 80)) for i in range(12)]
    toxic = [(i, words(i, 30) + (". you idiot. " if i % 4 == 0 else ". ") + words(i + 1, 10)) for i in range(200, 320)]
    near = words(1, 80).split()
    near[40] = "edited"
    rows = [*filler, *toxic, (1, words(0, 80)), (2, None), (3, ""), (4, item), (5, words(77, 500) + " " + item), (6, " ".join(near)), (7, 'the token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" of ' + words(78, 30))]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in toxic], "doc_id long, quality int, toxic int")
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        now, kept = docs, {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, d)
            assert now.columns == docs.columns
            kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
        final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    every = {i for i, _ in rows}
    assert kept["toxicity"].keys() == every - {i for i, _ in toxic if i % 4 == 0}
    # 1 is a copy of 100, 6 nearly of 101, and no text of null
    assert kept["simhash_near_dedup"].keys() == kept["toxicity"].keys() - {100, 101, 3}
    assert kept["benchmark_decontamination"].keys() == kept["simhash_near_dedup"].keys() - {4}
    assert kept["benchmark_decontamination"][5] == words(77, 500) + " "
    assert kept["secret_scan"][7] == 'the token = "[SECRET]" of ' + words(78, 30)
    path, pattern = bpe.default_tokenizer()
    one = bpe._encoding(path, pattern).encode_ordinary
    assert final.keys() == kept["secret_scan"].keys()
    for i, r in final.items():
        text = kept["secret_scan"][i] or ""
        ids = one(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_links_of_sets(spark, monkeypatch):
    """Classes as by comparing all pairs; a hub that is cut to blocks gives the same."""
    rng = random.Random(21)
    texts = []
    for f in range(8):
        base = rng.choices([f"w{i}" for i in range(3000)], k=120)
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(120)] = "x"
            texts.append(" ".join(words))
    sets = [shingles.hashes(t) for t in texts]
    own = list(range(len(sets)))

    def top(x, own):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 36 * both >= 16 * (len(sets[i]) + len(sets[j])):
                own[top(i, own)] = top(j, own)

    def classes(pairs):
        mine = list(range(len(sets)))
        for a, b in pairs:
            mine[top(a, mine)] = top(b, mine)
        return {frozenset(j for j in range(len(sets)) if top(j, mine) == top(i, mine)) for i in range(len(sets))}

    want = {frozenset(j for j in range(len(sets)) if top(j, own) == top(i, own)) for i in range(len(sets))}
    assert 8 <= len(want) < len(sets)
    assert classes(shingles.group_links(sets, 16)) == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1_000_000, 500):
        monkeypatch.setattr(shingles, "HUB_SHINGLES", most)
        assert classes([(r["src"], r["dst"]) for r in shingles.links(df).collect()]) == want


def test_suffix_dedup_settles_anchors_cheaply():
    """contexts are compared at their anchors, as the transform does it and in a fraction of its time."""
    rng = random.Random(8)
    for length, gram, size, kinds in ((50, 16, 30, 40), (400, 64, 260, 300)):
        words = ["".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(60)]
        base = [" ".join(rng.choices(words, k=size)) for _ in range(12)]
        pieces = {}
        for _ in range(kinds):
            a, b = rng.sample(base, 2)
            raw = (a[rng.randint(0, len(a)) :] + " " + b[: rng.randint(0, len(b))] + " " + rng.choice(words)).encode()
            h, at, first, last = suffixdedup._anchors(raw, length, gram)
            pieces.update({(int(x), raw[f : t + length]): int(p - f) for x, p, f, t in zip(h, at, first, last)})
        held = sorted(pieces)
        contexts, number = [c for _, c in held], np.cumsum([0, *(x[0] != y[0] for x, y in zip(held[1:], held))])
        began = time.process_time()
        want = suffixdedup.repeated_starts(contexts, length)
        middle = time.process_time()
        got = suffixdedup.aligned_starts(contexts, [pieces[x] for x in held], number, length, gram)
        ended = time.process_time()
        assert [x.tolist() for x in got] == [x.tolist() for x in want] and 0 < sum(map(len, got)) < sum(len(c) - length + 1 for c in contexts)
    assert ended - middle < (middle - began) / 3


def test_chance_meetings_are_no_candidates(spark):
    """texts that meet in one shingle alone aren't paired; near copies of all sizes still are."""
    rng = random.Random(5)
    sets, kinds = [], []
    for size in [*range(1, 60), 80, 120, 300, 700]:
        own = set(rng.sample(range(1 << 40), size))
        near = set(own)
        for h in rng.sample(sorted(own), size // 10):  # about as many as a similarity of 0.8 allows
            near.remove(h)
            near.add(rng.randrange(1 << 40))
        grown = own | set(rng.sample(range(1 << 40), size // 4))
        sets += [own, near, grown]
    hot = list(range(-40, 0))  # the least of all, so first in every prefix
    chance = [{rng.choice(hot), *rng.sample(range(1 << 40), 200)} for _ in range(120)]
    sets = [np.array(sorted(x), np.int64) for x in sets + chance]
    none = np.empty(0, np.int64)
    rows = [(int(h), n, len(x), i) for n, x in enumerate(sets) for i, h in enumerate(shingles.prefix(x, none))]
    shared = spark.createDataFrame(rows, "h long, n long, size int, pos int")
    roots = spark.createDataFrame([], "node long, root long")
    got = {(r["a"], r["b"]) for r in shingles.candidates(shared, roots, shingles.TWENTIETHS).collect()}
    alike = lambda x, y: 5 * (both := len(np.intersect1d(x, y))) >= 4 * (len(x) + len(y) - both)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])}
    assert len(want) > 100 and want <= got
    first = len(sets) - len(chance)
    assert not [p for p in got if p[0] >= first]


def test_workers_hold_no_words_between_tasks(spark):
    """pipeline: what a task looked up is gone from its worker afterwards."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(50)]
    shingles.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    left = spark.range(64).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(shingles._codes)]}) for _ in batches), "n long")
    assert left.agg(F.max("n")).first()[0] == 0
