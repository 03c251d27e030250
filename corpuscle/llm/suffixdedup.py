"""Substring dedup by suffix arrays: every byte inside a long string that also starts elsewhere goes.

1. Anchors (see anchors.py) are counted over all texts. A string of `length` bytes that starts twice
   has a repeated anchor, so only the strings around repeated anchors go on.
2. Around each of those, the context holds all strings that belong to the anchor. Equal contexts are
   counted together: one that occurs twice is repeated as a whole and needs nothing more.
3. The contexts of an anchor that occur once are compared with the anchor's other contexts, in buckets
   of whole anchors, of bounded size. Equal strings have their anchor at the same place, so two suffix
   arrays of the anchors alone do: of what follows each anchor, and of what precedes it, read backwards.
   Their longest common prefixes give the classes of equal parts on either side at every extent, and
   strings are equal where both classes are.
4. An anchor with more contexts than a bucket holds is settled by counting the digests of its strings.

repeated_starts() does the same for contexts without known anchors: breadth-first backward extension on
a Burrows-Wheeler transform derives the longest common prefixes by increasing value and stops at the
minimum length: boundaries still unset then part no two equal strings.

Edge cases: null counts as the empty text; texts shorter than `length` keep everything; repeated rows
are copies of one another, also with the same id; null ids are allowed; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import anchors
from corpuscle.llm.common import id_for_python, materialize

LENGTH = 400
GRAM = 64
#: Bytes of contexts from which a bucket is full, and the most contexts of one anchor in it.
BUCKET_BYTES = 1 << 20
MOST_CONTEXTS = 512
#: A byte that no UTF-8 text holds.
_END = 255
_EMPTY = hashlib.sha256(b"").hexdigest()


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` bytes or more (prefix doubling), and the first 8 bytes of each."""
    n = len(text)
    padded = np.concatenate((text, np.full(8, _END, np.uint8))).astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for i in range(8):
        packed = (packed << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(packed, kind="stable")
    key = packed[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    size = 8
    while size < depth and rank[order[-1]] < n - 1:
        after = np.full(n, n, np.int64)  # beyond the end: larger than all
        after[: n - size] = rank[size:]
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        key = pair[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        size *= 2
    return order, packed


def equal_prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, boundary): suffixes in order, and whether each parts from the one before it within
    `length` bytes. Only suffixes whose first `length` bytes hold no end byte are told apart rightly.
    """
    n = len(text)
    order, packed = suffix_order(text, length)
    bwt = text[order - 1]  # the text ends with an end byte, which precedes its first
    # LF: where the suffix one byte longer stands
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    occurs = bwt[by_symbol].astype(np.int64) * (n + 1) + by_symbol
    after = np.full(n, n, np.int64)  # the next row with the same symbol
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    # Prefix lengths below 8 come from the packed bytes; known[i]: rows i-1 and i are known to part.
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = lcp[n] = 0
    first = packed[order]
    apart = first[1:] ^ first[:-1]
    rows = np.flatnonzero(apart)
    bits = np.frexp((apart[rows] >> np.uint64(11)).astype(np.float64))[1] + 11
    bits[apart[rows] < 2048] = np.frexp(apart[rows][apart[rows] < 2048].astype(np.float64))[1]
    lcp[rows + 1] = (64 - bits) // 8
    level = min(8, length)
    edges = np.concatenate(([0], rows + 1, [n]))
    lo, hi = edges[:-1], edges[1:]
    new = (lcp[hi] == level - 1) | (hi == n)
    lo, hi = lo[new], hi[new]
    while level < length and len(lo):
        sizes = hi - lo
        owner = np.repeat(np.arange(len(lo)), sizes)
        row = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[owner]
        # the last row of each symbol in its interval ends the interval of the longer string
        keep = (after[row] >= hi[owner]) & (bwt[row] != _END)
        row, owner = row[keep], owner[keep]
        end = lf[row] + 1
        keep = lcp[end] < 0
        row, owner, end = row[keep], owner[keep], end[keep]
        end, once = np.unique(end, return_index=True)
        row, owner = row[once], owner[once]
        lcp[end] = level
        symbol = bwt[row].astype(np.int64)
        lo = np.searchsorted(occurs, symbol * (n + 1) + lo[owner])
        hi = end
        level += 1
    return order, lcp[:n] >= 0


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Per context the starts of its strings of `length` bytes that start elsewhere in the contexts too."""
    text = np.frombuffer(b"".join(c + bytes([_END]) for c in contexts), np.uint8)
    order, boundary = equal_prefix_groups(text, length)
    group = np.cumsum(boundary)
    many = np.bincount(group, minlength=group[-1] + 1)[group] > 1
    hit = np.zeros(len(text), bool)
    hit[order] = many
    found, at = [], 0
    for c in contexts:
        found.append(np.flatnonzero(hit[at : at + max(0, len(c) - length + 1)]))
        at += len(c) + 1
    return found


def _classes(parts: list[bytes], group: np.ndarray, width: int) -> np.ndarray:
    """At [i, k] the number of the class of part i among the parts of its group that share their first k bytes.

    parts are in order of group. A part of fewer than k bytes is in no class that means anything.
    """
    order = np.array(sorted(range(len(parts)), key=list(zip(group.tolist(), parts)).__getitem__), np.int64)
    rows = np.frombuffer(b"".join(parts[i][:width].ljust(width, bytes([_END])) for i in order), np.uint8).reshape(len(parts), width)
    own = group[order]
    apart = np.zeros((len(parts), width + 1), bool)
    apart[1:, 1:] = rows[1:] != rows[:-1]
    apart[1:, 0] = own[1:] != own[:-1]
    np.logical_or.accumulate(apart, axis=1, out=apart)
    found = np.empty((len(parts), width + 1), np.int32)
    found[order] = np.cumsum(apart, axis=0, dtype=np.int32)
    return found


def aligned_starts(contexts: list[bytes], at: list[int], group: list[int], length: int, gram: int) -> list[np.ndarray]:
    """Per context the starts of its strings of `length` bytes that another context of its group holds too,
    with its anchor at the same place.

    at: where the anchor stands in its context; group: the number of the anchor's hash, in rising order.
    """
    n, most = len(contexts), length - gram
    group, at = np.asarray(group, np.int64), np.asarray(at, np.int64)
    left = _classes([c[a - 1 :: -1] if a else b"" for c, a in zip(contexts, at.tolist())], group, most)
    right = _classes([c[a:] for c, a in zip(contexts, at.tolist())], group, length)
    # a string begins k bytes before its anchor
    k = np.arange(most + 1)
    size = np.fromiter(map(len, contexts), np.int64, n)
    there = (k <= at[:, None]) & (length - k <= (size - at)[:, None])
    row, k = np.nonzero(there)
    key = (k * n + left[row, k]) * n + right[row, length - k]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    row, k = row[hit], k[hit]
    ends = np.cumsum(np.bincount(row, minlength=n))
    return [np.sort(a - x) for a, x in zip(at, np.split(k, ends[:-1]))]


def _digest(data: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(data), np.int64).tolist())


def _anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    hashes = anchors.gram_hashes(codes, gram)
    at, first, last = anchors.select(hashes, length - gram + 1)
    return hashes[at].view(np.int64) if len(at) else np.empty(0, np.int64), at, first, last


_SCAN = "id {id}, tk long, k1 long, k2 long, n_bytes long, sha256 string, hs array<long>, ps array<int>"
_CANDIDATE = "k1 long, k2 long, raw binary, contexts array<struct<h:long,d1:long,d2:long,first:int,last:int,at:int>>"


def deduplicate(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    most_contexts: int = MOST_CONTEXTS,
    with_text: bool = False,
) -> DataFrame:
    """Per row of df: id, n_bytes, n_removed, n_spans, kept_sha256 [, kept: the bytes left]."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(id_for_python(df, id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, tk, text in zip(pdf["id"], pdf["tk"], pdf["text"]):
                raw = text.encode()
                h, at, _, _ = _anchors(raw, length, gram)
                out.append((i, tk, *_digest(raw), len(raw), hashlib.sha256(raw).hexdigest(), h, at.astype(np.int32)))
            yield pd.DataFrame(out, columns=["id", "tk", "k1", "k2", "n_bytes", "sha256", "hs", "ps"])

    rows = materialize(docs.mapInPandas(scan, _SCAN.format(id=docs.schema["id"].dataType.simpleString())))
    texts = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(F.struct("id", "tk")).alias("one"))
    every = rows.select("k1", F.explode(F.arrays_zip("hs", "ps")).alias("a")).select("k1", F.col("a.hs").alias("h"), F.col("a.ps").alias("p"))
    twice = (
        every.groupBy("h")
        .agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("p").alias("c"), F.max("p").alias("d"))
        .filter("a <> b or c <> d").select("h")
    )
    places = every.join(twice, "h", "left_semi").groupBy("k1").agg(F.collect_set("p").alias("ps"))
    chosen = texts.join(places, "k1").select("k1", "k2", "one.id", "one.tk", "ps")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, k1, k2, ps in zip(pdf["text"], pdf["k1"], pdf["k2"], pdf["ps"]):
                raw = text.encode()
                if _digest(raw) != (k1, k2):
                    continue  # another text under the same id
                h, at, first, last = _anchors(raw, length, gram)
                got = [
                    (int(h[i]), *_digest(raw[first[i] : last[i] + length]), int(first[i]), int(last[i]), int(at[i] - first[i]))
                    for i in np.flatnonzero(np.isin(at, np.asarray(ps)))
                ]
                out.append((k1, k2, raw, got))
            yield pd.DataFrame(out, columns=["k1", "k2", "raw", "contexts"])

    same_id = docs["id"].eqNullSafe(chosen["id"]) & (docs["tk"] == chosen["tk"])
    candidates = materialize(
        docs.join(chosen, same_id).select("text", "k1", "k2", "ps").mapInPandas(contexts, _CANDIDATE)
    )
    occurs = candidates.select("k1", "k2", F.explode("contexts").alias("c")).select("k1", "k2", "c.*")
    kinds = materialize(
        occurs.groupBy("h", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "last", "at")).alias("one"))
    )
    per_anchor = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("single"))
    open_anchors = per_anchor.filter("kinds > 1 and single > 0").select("h", (F.col("kinds") > most_contexts).alias("hot"))
    wanted = kinds.join(open_anchors, "h").select("h", "d1", "d2", "n", "hot", "one.*")
    by_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "d1", "d2", "n", "hot", "first", "last", "at")).alias("w"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (c["h"], c["d1"], c["d2"], c["n"], c["hot"], c["at"], raw[c["first"] : c["last"] + length])
                for raw, w in zip(pdf["raw"], pdf["w"])
                for c in w
            ]
            yield pd.DataFrame(out, columns=["h", "d1", "d2", "n", "hot", "at", "context"])

    pieces = materialize(
        candidates.select("k1", "k2", "raw").join(by_text, ["k1", "k2"]).select("raw", "w").mapInPandas(cut, "h long, d1 long, d2 long, n long, hot boolean, at int, context binary")
        .dropDuplicates(["h", "d1", "d2"])
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole anchors, in order of h, until a bucket is full."""
        held: list[tuple] = []
        size = 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if size >= BUCKET_BYTES and row.h != held[-1].h:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row.context)
        if held:
            yield settle(held)

    def settle(held: list) -> pd.DataFrame:
        number = np.cumsum([0, *(a.h != b.h for a, b in zip(held[1:], held))])
        found = aligned_starts([r.context for r in held], [r.at for r in held], number, length, gram)
        return pd.DataFrame(
            [(r.h, r.d1, r.d2, s.astype(np.int32)) for r, s in zip(held, found) if r.n == 1 and len(s)], columns=["h", "d1", "d2", "starts"]
        )

    result = "h long, d1 long, d2 long, starts array<int>"
    cold = pieces.filter(~F.col("hot")).repartition("h").sortWithinPartitions("h").mapInPandas(compare, result)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                got = [_digest(r.context[i : i + length]) for i in range(len(r.context) - length + 1)]
                w = np.array(got, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"h": r.h, "d1": r.d1, "d2": r.d2, "w1": w[:, 0], "w2": w[:, 1], "at": np.arange(len(w), dtype=np.int32)})

    each = pieces.filter("hot").select("h", "d1", "d2", "context").mapInPandas(strings, "h long, d1 long, d2 long, w1 long, w2 long, at int")
    often = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    hot = each.join(often, ["w1", "w2"], "left_semi").groupBy("h", "d1", "d2").agg(F.collect_list("at").alias("starts"))
    starts = cold.unionByName(hot)
    whole = kinds.filter("n > 1").select("h", "d1", "d2", F.lit(None).cast("array<int>").alias("starts"))
    decided = whole.unionByName(starts)
    spans = (
        occurs.join(decided, ["h", "d1", "d2"])
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("first", "last", "starts")).alias("spans"))
    )

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k1, k2, raw, found in zip(pdf["k1"], pdf["k2"], pdf["raw"], pdf["spans"]):
                a = [np.arange(s["first"], s["last"] + 1) if s["starts"] is None else s["first"] + np.asarray(s["starts"], np.int64) for s in found]
                first = np.concatenate(a) if a else np.empty(0, np.int64)
                first, end = anchors.merge_spans(first, first + length)
                kept = b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*first.tolist(), len(raw)]))
                out.append((k1, k2, len(raw) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept if with_text else b""))
            yield pd.DataFrame(out, columns=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    cuts = candidates.select("k1", "k2", "raw").join(spans, ["k1", "k2"]).mapInPandas(
        remove, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    ).dropDuplicates(["k1", "k2"])
    copied = texts.filter("copies > 1").select("k1", "k2", F.lit(True).alias("copied"))
    both = rows.select("id", "k1", "k2", "n_bytes", "sha256").join(copied, ["k1", "k2"], "left").join(cuts, ["k1", "k2"], "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    out = both.select(
        F.col("id").cast(kind).alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    return out
