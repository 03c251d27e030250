"""Substring dedup on words by de Bruijn compaction.

1. Anchors (see anchors.py) are counted over all texts; a window of `size` words that starts twice has
   a repeated anchor, so only windows of repeated anchors become edges.
2. Each such window is an edge of the graph whose nodes are runs of size-1 words. One aggregation finds
   how often an edge occurs and whether all its occurrences go on alike on either side.
3. Repeated edges are joined back to their occurrences; where neighbours follow each other without a
   branch they are one path, so each text is left with a few spans, not with its windows.
4. Source coordinates verify the spans: the words themselves are digested, and a span counts as
   repeated if another with its path and digest exists. Edges of a span that stands alone (a hash
   stood for two things) are settled by the digests of the words at all their occurrences.

Edge cases: null texts have no words; texts of fewer words than `size` keep all; repeated rows are
copies of one another, also with the same id; null ids are allowed; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm import anchors
from corpuscle.llm.common import id_for_python, materialize

SIZE = 35
GRAM = 10


class _Codes(dict):
    """Word -> 64-bit code; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 1_000_000:
            self.clear()
        self[word] = code = xxh64_intdigest(word, 1)
        return code


def _coded(words: list[bytes], codes: _Codes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def _digest(data: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(data), np.int64).tolist())


_SCAN = "id {id}, tk long, k1 long, k2 long, n_words long, sha256 string, hs array<long>, ps array<int>"
_TEXT = "k1 long, k2 long, raw binary, ps array<int>"
#: Neighbours in 32 bits: where two of them seem alike and aren't, the words at the source tell.
_EDGES = "t long, pos int, edge long, before int, after int"


def _edges(size: int, gram: int, rows: int = 100_000):
    def table(parts: list[tuple]) -> pd.DataFrame:
        out = {"t": np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])}
        return pd.DataFrame(out | {c: np.concatenate([p[i] for p in parts]) for i, c in ((1, "pos"), (2, "edge"), (3, "before"), (4, "after"))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, parts, held = _Codes(), [], 0
        for pdf in batches:
            for t, raw, ps in zip(pdf["t"], pdf["raw"], pdf["ps"]):
                coded = _coded(raw.split(), codes)
                at, first, last = anchors.select(anchors.gram_hashes(coded, gram), size - gram + 1)
                own = np.isin(at, np.asarray(ps))
                if not own.any():
                    continue
                pos = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[own], last[own])])
                # zero beyond the ends: a text's end is a branch
                whole = np.concatenate(([0], anchors.gram_hashes(coded, size).view(np.int64), [0]))
                side = whole.astype(np.int32)  # the low half
                parts.append((t, pos.astype(np.int32), whole[pos + 1], side[pos], side[pos + 2]))
                held += len(pos)
                if held >= rows:
                    yield table(parts)
                    parts, held = [], 0
        if parts:
            yield table(parts)

    return run


def _digested(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, raw, spans in zip(pdf["t"], pdf["raw"], pdf["spans"]):
                words = raw.split()
                for s in spans:
                    out.append((t, s["first"], s["last"], s["path"], *_digest(b" ".join(words[s["first"] : s["last"] + size]))))
            yield pd.DataFrame(out, columns=["t", "first", "last", "path", "d1", "d2"])

    return run


def _each_window(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, raw, spans in zip(pdf["t"], pdf["raw"], pdf["spans"]):
                words = raw.split()
                for s in spans:
                    out += [(t, p, *_digest(b" ".join(words[p : p + size]))) for p in range(s["first"], s["last"] + 1)]
            yield pd.DataFrame(out, columns=["t", "first", "d1", "d2"])

    return run


def compacted(occurs: DataFrame) -> DataFrame:
    """Spans (t, first, last, path) of repeated edges: maximal runs without a branch.

    occurs: t (the text), pos, edge, before, after. path: the edge that the run begins with.
    """
    known = (
        occurs.groupBy("edge")
        .agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("before", "after") for n, f in (("a", F.min), ("z", F.max))])
        .filter("n > 1")
        .select("edge", (F.col("before_a") == F.col("before_z")).alias("one_in"), (F.col("after_a") == F.col("after_z")).alias("one_out"))
    )
    joined = occurs.select("t", "pos", "edge").join(known, "edge")
    order = Window.partitionBy("t").orderBy("pos")
    goes_on = (F.lag("pos").over(order) == F.col("pos") - 1) & F.lag("one_out").over(order) & F.col("one_in")
    cut = joined.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    cut = cut.withColumn("run", F.sum("new").over(order))
    return cut.groupBy("t", "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.max(F.when(F.col("new") == 1, F.col("edge"))).alias("path")
    ).drop("run")


def _verified(spans: DataFrame, occurs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The spans, or single windows of them, whose words occur at two source coordinates."""
    grouped = spans.groupBy("t").agg(F.collect_list(F.struct("first", "last", "path")).alias("spans"))
    read = materialize(
        texts.select("t", "raw").join(grouped, "t")
        .mapInPandas(_digested(size), "t long, first int, last int, path long, d1 long, d2 long")
    )
    alike = read.groupBy("path", "d1", "d2").agg(F.count("*").alias("n"))
    good = read.join(alike.filter("n > 1"), ["path", "d1", "d2"]).select("t", "first", "last")
    # A span alone with its words: a hash stood for two windows, or for two neighbours. Its edges are
    # settled one by one, at all their occurrences.
    alone = read.join(alike.filter("n = 1"), ["path", "d1", "d2"]).select("t", "first", "last")
    if alone.limit(1).count() == 0:
        return good
    inside = occurs.select("t", "pos", "edge").join(alone, "t").filter(F.col("pos").between(F.col("first"), F.col("last")))
    places = occurs.join(inside.select("edge").distinct(), "edge", "left_semi").select("t", F.struct(F.col("pos").alias("first"), F.col("pos").alias("last")).alias("s"))
    odd = places.groupBy("t").agg(F.collect_list("s").alias("spans"))
    each = texts.select("t", "raw").join(odd, "t").mapInPandas(_each_window(size), "t long, first int, d1 long, d2 long")
    often = each.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1").select("d1", "d2")
    single = each.join(often, ["d1", "d2"], "left_semi").select("t", "first", F.col("first").alias("last"))
    return good.unionByName(single)


def deduplicate(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, with_text: bool = False
) -> DataFrame:
    """Per row of df: id, n_words, n_removed, n_spans, kept_sha256 [, kept: the words left, space-joined]."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(id_for_python(df, id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        for pdf in batches:
            out = []
            for i, tk, text in zip(pdf["id"], pdf["tk"], pdf["text"]):
                words = text.encode().split()
                joined = b" ".join(words)
                hashes = anchors.gram_hashes(_coded(words, codes), gram)
                at, _, _ = anchors.select(hashes, size - gram + 1)
                out.append((i, tk, *_digest(joined), len(words), hashlib.sha256(joined).hexdigest(), hashes[at].view(np.int64), at.astype(np.int32)))
            yield pd.DataFrame(out, columns=["id", "tk", "k1", "k2", "n_words", "sha256", "hs", "ps"])

    rows = materialize(docs.mapInPandas(scan, _SCAN.format(id=docs.schema["id"].dataType.simpleString())))
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(F.struct("id", "tk")).alias("one"))
    every = rows.select("k1", F.explode(F.arrays_zip("hs", "ps")).alias("a")).select("k1", F.col("a.hs").alias("h"), F.col("a.ps").alias("p"))
    twice = (
        every.groupBy("h")
        .agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("p").alias("c"), F.max("p").alias("d"))
        .filter("a <> b or c <> d").select("h")
    )
    places = every.join(twice, "h", "left_semi").groupBy("k1").agg(F.collect_set("p").alias("ps"))
    chosen = copies.join(places, "k1").select("k1", "k2", "one.id", "one.tk", "ps")

    def join_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, k1, k2, ps in zip(pdf["text"], pdf["k1"], pdf["k2"], pdf["ps"]):
                joined = b" ".join(text.encode().split())
                if _digest(joined) == (k1, k2):  # else another text under the same id
                    out.append((k1, k2, joined, ps))
            yield pd.DataFrame(out, columns=["k1", "k2", "raw", "ps"])

    # one row a text: identical rows would meet themselves
    texts = docs.join(chosen, docs["id"].eqNullSafe(chosen["id"]) & (docs["tk"] == chosen["tk"])).select("text", "k1", "k2", "ps").mapInPandas(join_words, _TEXT)
    # the number is in the table, so it stays what it is
    texts = materialize(texts.dropDuplicates(["k1", "k2"]).withColumn("t", F.monotonically_increasing_id()))
    occurs = materialize(texts.select("t", "raw", "ps").mapInPandas(_edges(size, gram), _EDGES))
    spans = _verified(compacted(occurs), occurs, texts, size).groupBy("t").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k1, k2, raw, found in zip(pdf["k1"], pdf["k2"], pdf["raw"], pdf["spans"]):
                words = raw.split()
                first = np.array([s["first"] for s in found], np.int64)
                end = np.array([s["last"] for s in found], np.int64) + size
                first, end = anchors.merge_spans(first, end)
                kept = [w for x, y in zip([0, *end.tolist()], [*first.tolist(), len(words)]) for w in words[x:y]]
                joined = b" ".join(kept)
                out.append((k1, k2, len(words) - len(kept), len(first), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else ""))
            yield pd.DataFrame(out, columns=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    cuts = texts.select("t", "k1", "k2", "raw").join(spans, "t").select("k1", "k2", "raw", "spans").mapInPandas(
        remove, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )
    copied = copies.filter("copies > 1").select("k1", "k2", F.lit(True).alias("copied"))
    both = rows.select("id", "k1", "k2", "n_words", "sha256").join(copied, ["k1", "k2"], "left").join(cuts, ["k1", "k2"], "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= size)
    empty = hashlib.sha256(b"").hexdigest()
    return both.select(
        F.col("id").cast(kind).alias(id_col),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *([F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
