"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import pytest

from corpuscle.llm import bpe, debruijn, decontam, forest, imatch, licenses, secrets, simhash, suffixdedup, toxicity, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, k1 string, h string"


def make(spark, texts, ids=None):
    """Extra columns have the names that the operators use inside."""
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", None, None, "x", "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def odd_texts(seed=0, n=40):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "δέλτα", "é", "x1", "the", "of"]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    out = [None, "", " \n", "one", base[0], base[0], base[1] * 20]
    for _ in range(n):
        t = " ".join(rng.choices(words, k=rng.randint(1, 50)))
        if rng.random() < 0.6:
            t += " " + rng.choice(base)[rng.randint(0, 40) :] + " " + " ".join(rng.choices(words, k=5))
        out.append(t)
    return out


def rows(df, key, *cols):
    got = {}
    for r in df.collect():
        got.setdefault(r[key], []).append(tuple(r[c] for c in cols))
    return {k: sorted(v, key=repr) for k, v in got.items()}


# suffix arrays


def brute_bytes(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(g and not p for g, p in zip(gone, [0, *gone]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_bwt_groups_equal_strings():
    rng = random.Random(3)
    for trial in range(60):
        n = rng.choice([9, 12, 20])
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 80))) for _ in range(4)]
        contexts = [b"".join(p[rng.randint(0, len(p) - 1) :] for p in rng.choices(parts, k=3)) for _ in range(8)]
        seen = Counter(c[i : i + n] for c in contexts for i in range(len(c) - n + 1))
        for c, got in zip(contexts, suffixdedup.repeated_starts(contexts, n)):
            assert got.tolist() == [i for i in range(len(c) - n + 1) if seen[c[i : i + n]] > 1]


@pytest.mark.parametrize("most", [512, 1])
def test_suffix_dedup(spark, most):
    texts = odd_texts(1)
    ids = [None, *range(1, len(texts))]
    got = suffixdedup.deduplicate(make(spark, texts, ids), length=50, gram=16, most_contexts=most)
    want = {}
    for i, row in zip(ids, brute_bytes(texts, 50)):
        want.setdefault(i, []).append(row)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffixdedup.deduplicate(make(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [None, 3])
def test_debruijn(spark, bits, monkeypatch):
    """With neighbours of three bits most branches are missed, and the source has to settle them."""
    if bits:
        real = debruijn._edges

        def coarse(*args):
            run = real(*args)
            return lambda batches: (p.assign(before=p["before"] % 8, after=p["after"] % 8) for p in run(batches))

        monkeypatch.setattr(debruijn, "_edges", coarse)
    texts = odd_texts(2)
    n = 8
    lists = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    want = {}
    for i, w in enumerate(lists):
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] > 1:
                gone[p : p + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = [(len(w), sum(gone), hashlib.sha256(kept).hexdigest())]
    got = debruijn.deduplicate(make(spark, texts), size=n, gram=3)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert debruijn.deduplicate(make(spark, [])).count() == 0


# simhash


def test_covering_masks():
    rng = random.Random(5)
    masks = [m & (2**64 - 1) for m in simhash.masks(4)]
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_links(spark, block):
    rng = random.Random(6)
    centers = [rng.getrandbits(64) for _ in range(5)]
    fps = {0}
    for c in centers:
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                root[find(x)] = find(y)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    own = {signed(x): signed(x) for x in fps}

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    for r in simhash.links(df, block=block).collect():
        own[top(r["src"])] = top(r["dst"])
    for x in fps:
        for y in fps:
            assert (find(x) == find(y)) == (top(signed(x)) == top(signed(y)))


def test_simhash_copies(spark):
    df = make(spark, [None, "", "a b c d e f", "A b c d e f", "quite another text with words"])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [0, 2, 4]


# decontamination


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, limit):
    import re

    find = re.compile("[0-9a-z\x80-\U0010ffff]+").findall
    low = lambda t: find((t or "").translate({c: c + 32 for c in range(65, 91)}))
    texts = odd_texts(4)
    items = [None, "", "One", "beta GAMMA", texts[4][10:90], texts[4][:60]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.contamination(make(spark, texts), bench, n=5, broadcast_rows=limit)
    windows = {(i, tuple(w[p : p + 5])) for i, t in enumerate(items) for w in [low(t)] if w for p in range(max(1, len(w) - 4))}
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = low(t), set(), set()
        for item, win in windows:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
        want[d] = [(len(w), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))]
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == want
    assert decontam.contamination(make(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_cuts_words(spark):
    filler = " ".join(f"w{i}" for i in range(400))
    bench = spark.createDataFrame([(1, "a secret question of the test")], "item_id long, text string")
    df = make(spark, [f"{filler} A secret, question of the test! end.", filler, "a secret question of the test", None])
    got = {r["doc_id"]: r["text"] for r in decontam.remove(df, bench).collect()}
    assert got == {0: f"{filler} end.", 1: filler, 3: None}


# tokens


def test_bpe_round_trip_and_chunks(spark):
    path, pattern = bpe.default_tokenizer()
    enc = bpe._encoding(path, pattern)
    texts = [None, "", "Hello  world's 12 \n\n é", "x" * 500, " ".join(f"word{i}  ab" for i in range(300)), "  \n" * 200 + "end"]
    texts.append(texts[4])
    df = make(spark, texts)
    got = bpe.decode(bpe.encode(df, chunk_chars=64, overlap_chars=16))
    for r in got.collect():
        assert list(r["ids"]) == enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    for r in bpe.encode(df, digests_only=True, chunk_chars=64, overlap_chars=16).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


# fingerprints


def test_imatch_neighbours_and_likeness(spark):
    texts = [t for t in odd_texts(7) if t is not None] + [None]
    df = make(spark, texts)
    got = {r["doc_id"]: r for r in imatch.compare_with_edits(df, imatch.lexicon(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""
        k = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["near_edited"] <= 1
        assert (t == following) <= (got[i]["near_next"] == 1)
    same = [i for i, t in enumerate(texts) if t == texts[3]]
    assert len({got[i]["fingerprint"] for i in same}) == 1


def test_imatch_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 3)
    df = make(spark, [f"text {i}" for i in range(20)], [i // 2 for i in range(20)])
    got = imatch.compare_with_edits(df, imatch.lexicon(df))
    assert got.count() == 20


# toxicity, secrets, licenses, urls


def test_toxicity_learns_sentences(spark):
    rng = random.Random(8)
    clean = [f"w{i}" for i in range(50)]
    texts, labels = [], []
    for i in range(300):
        s = [" ".join(rng.choices(clean, k=8)) for _ in range(rng.randint(1, 8))]
        if i % 4 == 0:
            s[rng.randrange(len(s))] += " " + rng.choice(["idiot", "moron"])
        texts.append(". ".join(s))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, labels)
    df = make(spark, [None, "", "w1 w2. you idiot. w3 w4", "w1 w2. w5"])
    got = {r["doc_id"]: r for r in toxicity.score(df.drop("score"), model).collect()}
    assert got[2]["score"] > 0.5 and list(got[2]["offending"]) == [1]
    assert all(got[i]["score"] < 0.5 for i in (0, 1, 3))
    assert toxicity.locate(df, model).collect()[0]["words"] == "you idiot"
    assert toxicity.fit([], []).weights == {}


def test_secrets(spark):
    key = "AKIA" + "Q3R7TZ5W1XY9KLM2"
    df = make(spark, [None, "", f"my key {key} is here", "commit 3f786850e387550fdab836ed7e6dc881de23001b fixed", 'password = "changeme123"', 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"'])
    model = secrets.train()
    got = {r["doc_id"]: r["is_secret"] for r in secrets.scan(df, model).collect()}
    assert got == {2: True, 3: False, 4: False, 5: True}
    text = {r["doc_id"]: r["text"] for r in secrets.redact(df, model).collect()}
    assert text[2] == "my key [SECRET] is here" and text[0] is None and text[5] == 'token = "[SECRET]"'


def test_forest_held_out():
    rows_ = secrets.labelled_findings(600, seed=99)
    model = secrets.train()
    x = [secrets.describe(b[-48:], v, a[:48], p, next((k for s, e, k in secrets.candidates(b + v + a) if s < len(b) + len(v) and e > len(b)), "opaque")) for b, v, a, p, _ in rows_]
    right = (model.predict(np.array(x)) >= 0.5) == np.array([r[4] for r in rows_], bool)
    assert right.mean() > 0.9
    assert forest.train(np.zeros((4, 2)), np.array([0, 0, 1, 1]), trees=2).predict(np.zeros((1, 2))).shape == (1,)


def test_licenses(spark):
    from pyspark.sql import functions as F

    data = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c.txt", "plain words"), ("a/b/d/e.txt", "Header.\nLicensed under the Apache License, Version 2.0.\nbody"),
        ("x/y.txt", None), (None, ""), ("a/b/d/f.txt", "no license is given here, only words about one"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(data)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["inherited"], r["final"]) for r in licenses.scan(df, F.col("path")).collect()}
    assert got[0] == ("MIT", "MIT", "MIT") and got[1] == (None, "MIT", "MIT")
    assert got[2][0] == "Apache-2.0" and got[2][2] == "Apache-2.0"
    assert got[3] == (None, None, None) and got[4] == (None, None, None) and got[5][0] is None


def test_url_rules(spark):
    urls = [
        None, "no scheme", "http://Example.ORG/en/14", "http://sub.example.org/es/x", "http://example.org", "http://a.com/fr/x?q", "http://b.com/de/", "http://com/DE/",
        "http://casino.example.net/", "http://my-org/", "a:b://x.org/p#f", "http://free-bets.org/",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df).collect()}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("example.org", "/en/14", "example.org/en/1", "block")
    assert got[3][2:] == ("example.org/es/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == ("a.com", "/fr/x", "com/fr/", "allow") and got[6][2:] == ("com/de/", "block") and got[7][2:] == (None, "allow")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[10] == ("x.org", "/p", "org/", "allow") and got[11][2:] == ("org/", "allow")


# pipeline


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "/root/testdata/sf0.001")
        assert now.columns == docs.columns
    assert 0 < now.count() < docs.count()
