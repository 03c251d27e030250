"""Near copies by the Jaccard similarity of their word shingles, exact through prefix filtering.

Under any one order of all shingles, two sets of similarity t or more share a shingle among the first
|x| - ceil(t |x|) + 1 of each. So only these prefixes are shuffled; sizes and places in the prefix rule
out most pairs. Sets that must overlap by o share k among the first |x| - o + k of each, so pairs that have
fewer in common are ruled out by counting: chance meetings in one shingle grow with the square of the
texts. Counts of the shingles by hash (an upper bound of the overlap) rule out most others, and the rest are
compared whole. The order is by hash with the shingles that are common in a sample last: it decides
the cost alone, never the result.

Classes are wanted, not pairs: first each text meets the one before it and the first one of each shingle
it shares. Texts that such pairs connect go to one place, each once (a large group in blocks), and are
compared there until their classes are known. Then only texts of different classes meet, so a group of
near copies costs rows in proportion to its size.

Edge cases: null and texts without words have no shingles and no copies; fewer words than a shingle are
one shingle; links() leaves null ids out and takes longs as ids, keep_one() takes any; an empty table
gives an empty table. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import anchors, simhash
from corpuscle.llm.common import components, materialize, small, trim

SHINGLE = 5
#: Least similarity of a near copy, in twentieths.
TWENTIETHS = 16
#: Texts of the sample that shows which shingles are common, and how many of these are put last at most.
SAMPLE = 4_000
COMMON = 50_000
#: Texts that are hashed at once.
ROWS = 1_000
#: Pairs in a batch.
PAIRS = 100_000
#: Buckets in which a text's shingles are counted.
BUCKETS = 512
#: Shingles that a candidate pair must share in somewhat longer prefixes, where its sizes allow so many.
SHARED = 6
#: Shingles of the texts that one task compares with one another.
HUB_SHINGLES = 2_000_000


class _Codes(dict):
    """Word -> 64-bit code; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 300_000:
            self.clear()
        self[word] = code = xxh64_intdigest(word, 42)
        return code


_codes = _Codes()


def _forget() -> None:
    _codes.clear()
    trim()


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the text's shingles, from the XXH64 of their words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    return np.unique(anchors.gram_hashes(codes, min(shingle, len(words))).view(np.int64))


def prefix(h: np.ndarray, common: np.ndarray, twentieths: int = TWENTIETHS) -> np.ndarray:
    """The first shingles of h in the order of all, as many as a near copy must share one of.

    common: sorted hashes that come last.
    """
    n = len(h) - -(-twentieths * len(h) // 20) + 1 if len(h) else 0
    at = np.searchsorted(common, h)
    last = np.zeros(len(h), bool)
    last[at < len(common)] = common[at[at < len(common)]] == h[at < len(common)]
    return np.concatenate([h[~last], h[last]])[:n]


def overlap_counts(h: np.ndarray) -> bytes:
    """How many of the hashes fall to each bucket, up to 255."""
    return np.minimum(np.bincount(h.view(np.uint64) % np.uint64(BUCKETS), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """An upper bound of the overlap of two sets from their counts; a full bucket proves nothing."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    return 1 << 30 if max(a.max(), b.max()) == 255 else int(np.minimum(a, b).sum(dtype=np.int64))


def _may(size_a, pos_a, size_b, pos_b, twentieths: int):
    """Whether rows of one shingle may be near copies; size_a <= size_b."""
    # the first shared shingle leaves so many to share at most
    most = np.minimum(size_a - pos_a, size_b - pos_b)
    return (size_b * twentieths <= 20 * size_a) & (most * (20 + twentieths) >= twentieths * (size_a + size_b))


def least_shared(size_a, size_b, twentieths: int):
    """(overlap, k) of sizes size_a <= size_b: the overlap of near copies, and how many shingles they share
    at least among the first |x| - overlap + k of each; the prefixes hold as many."""
    overlap = -(-twentieths * (size_a + size_b) // (20 + twentieths))
    return overlap, np.clip(overlap - -(-twentieths * size_b // 20) + 1, 1, SHARED)


def group_pairs(n: np.ndarray, size: np.ndarray, pos: np.ndarray, root: np.ndarray, twentieths: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, k): pairs of the rows of one shingle, in order of size, that are of different classes and may be
    near copies if they share k such shingles."""
    for i in range(len(n) - 1):
        if root[i] == root[-1] and (root[i:] == root[i]).all():
            continue
        end = i + 1 + int(np.searchsorted(size[i + 1 :], 20 * size[i] // twentieths, "right"))
        rest = slice(i + 1, end)
        overlap, k = least_shared(size[i], size[rest], twentieths)
        ok = (root[rest] != root[i]) & (np.minimum(size[i] - pos[i], size[rest] - pos[rest]) + k > overlap)
        if ok.any():
            other = n[rest][ok]
            yield np.minimum(other, n[i]), np.maximum(other, n[i]), k[ok]


def by_shingle(rows: DataFrame, settle, schema: str) -> DataFrame:
    """settle(pdf, cuts) over whole groups of one shingle h, in order of size and number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            h = pdf["h"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1))
            rest = pdf.iloc[cuts[-1] :]
            if len(cuts) > 1:
                yield from settle(pdf.iloc[: cuts[-1]], cuts)
        if rest is not None and len(rest):
            yield from settle(rest, np.array([0, len(rest)]))

    return rows.repartition("h").sortWithinPartitions("h", "size", "n").mapInPandas(run, schema)


_SHARED = "h long, n long, size int, pos int, lead long, prev long"


def shared_prefixes(prefixes: DataFrame, twentieths: int) -> DataFrame:
    """The rows (h, n, size, pos) of shingles that are in two prefixes or more, with the first row of the
    shingle and the one before, or -1 where they cannot be near copies."""

    def settle(pdf: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        count = np.diff(cuts)
        first = np.repeat(cuts[:-1], count)
        many = np.repeat(count > 1, count)
        n, size, pos = (pdf[c].to_numpy(np.int64) for c in ("n", "size", "pos"))
        at = np.flatnonzero(many)
        out = {"h": pdf["h"].to_numpy()[at], "n": n[at], "size": size[at], "pos": pos[at]}
        for name, other in (("lead", first[at]), ("prev", np.maximum(at - 1, first[at]))):
            ok = (other != at) & _may(size[other], pos[other], size[at], pos[at], twentieths)
            out[name] = np.where(ok, n[other], -1)
        if len(at):
            yield pd.DataFrame(out)

    return by_shingle(prefixes, settle, _SHARED)


def candidates(shared: DataFrame, roots: DataFrame, twentieths: int) -> DataFrame:
    """(a, b) with a < b of different classes, from shared (h, n, size, pos) and roots (node, root)."""

    def settle(pdf: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        n, size, pos, root = (pdf[c].to_numpy(np.int64) for c in ("n", "size", "pos", "root"))
        found, held = [], 0
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            for pair in group_pairs(n[a:b], size[a:b], pos[a:b], root[a:b], twentieths) if b - a > 1 else ():
                found.append(pair)
                held += len(pair[0])
                if held >= PAIRS:
                    yield counted(found)
                    found, held = [], 0
        if found:
            yield counted(found)

    def counted(found: list) -> pd.DataFrame:
        a, b, k = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": a, "b": b, "k": k.astype(np.int32)}).groupby(["a", "b", "k"], as_index=False).agg(c=("k", "size"))

    known = small(roots.select(F.col("node").alias("n"), "root"))
    rows = shared.select("h", "n", "size", "pos").join(known, "n", "left").withColumn("root", F.coalesce("root", "n"))
    pairs = by_shingle(rows, settle, "a long, b long, k int, c int")
    return pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("k").alias("k")).filter("c >= k").select("a", "b")


def group_links(sets: list[np.ndarray], twentieths: int) -> list[tuple[int, int]]:
    """Links (i, j) that span the classes of sets under that similarity."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    counts = np.stack([np.frombuffer(overlap_counts(sets[i]), np.uint8) for i in order])
    root, found = np.arange(len(sets)), []
    for i in range(1, len(sets)):
        # against all smaller ones of other classes at once, by what their counts allow
        least = np.searchsorted(size[:i], -(-twentieths * size[i] // 20))
        at = least + np.flatnonzero(root[least:i] != root[i])
        if not len(at):
            continue
        most = np.minimum(counts[at], counts[i]).sum(axis=1, dtype=np.int64)
        unsure = (counts[at].max(axis=1) == 255) | (counts[i].max() == 255)
        for j in at[unsure | (most * (20 + twentieths) >= twentieths * (size[at] + size[i]))]:
            if root[j] == root[i]:
                continue
            x, y = sets[order[j]], sets[order[i]]
            place = np.searchsorted(y, x)
            place[place == len(y)] = 0
            shared = int((y[place] == x).sum())
            if shared * (20 + twentieths) >= twentieths * (len(x) + len(y)):
                root[root == root[j]] = root[i]
                found.append((order[j], order[i]))
    return found


def _links_of_hubs(batches: Iterator[pd.DataFrame], group: list[str], shingle: int, twentieths: int) -> Iterator[pd.DataFrame]:
    """(a, b) from rows (group, n, text) in order of the group; one group's sets are held at a time."""
    key, names, sets = None, [], []

    def settle() -> pd.DataFrame:
        found = group_links(sets, twentieths)
        a, b = ([names[p[side]] for p in found] for side in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})

    for pdf in batches:
        for *k, n, text in zip(*(pdf[c] for c in group), pdf["n"], pdf["text"]):
            if k != key:
                if len(names) > 1:
                    yield settle()
                key, names, sets = k, [], []
            if not names or names[-1] != n:  # repeated rows of one number are neighbours
                names.append(n)
                sets.append(hashes(text, shingle))
    if len(names) > 1:
        yield settle()
    names, sets = [], []
    _forget()


def links(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, twentieths: int = TWENTIETHS) -> DataFrame:
    """(src, dst): links of ids whose shingles have at least that similarity, that connect all texts which
    such pairs connect; equal sets are linked to one id."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[at : at + ROWS] for b in batches for at in range(0, len(b), ROWS)):
            yield pd.DataFrame({"h": np.concatenate([np.empty(0, np.int64), *(hashes(t, shingle) for t in pdf["text"])])})
        _forget()

    total = max(texts.count(), 1)
    part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(total)) < SAMPLE).select("text").distinct()
    seen = part.mapInPandas(spread, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    common = np.sort(np.array([r["h"] for r in seen.orderBy(F.desc("n"), "h").limit(COMMON).collect()], np.int64))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[at : at + ROWS] for b in batches for at in range(0, len(b), ROWS)):
            sets = [hashes(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({
                "id": pdf["id"], "key": [sha256(h.tobytes()).digest()[:16] for h in sets], "size": [len(h) for h in sets],
                "counts": [overlap_counts(h) for h in sets], "first": [prefix(h, common, twentieths) for h in sets],
            })
        _forget()

    rows = texts.mapInPandas(prefixes, "id long, key binary, size int, counts binary, first array<long>").filter("size > 0")
    # numbers that compress better than ids
    rows = materialize(rows.withColumn("n", F.monotonically_increasing_id()))
    least = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("one"), F.count("*").alias("c")).filter("c > 1")
    copies = materialize(rows.select("key", "id", "n").join(least, "key").filter("n <> one.n").select("id", "n", F.col("one.id").alias("dst")))
    own = rows.join(small(copies.select("n")), "n", "left_anti")
    shared = materialize(shared_prefixes(own.select("n", "size", F.posexplode("first").alias("pos", "h")), twentieths))
    about = rows.select("n", "size", "counts")

    @F.pandas_udf("int")
    def bound(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([most_shared(a, b) for a, b in zip(x, y)], dtype=np.int32)

    def near(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that may still be near copies."""
        ids = small(materialize(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()))
        own = about.join(ids, "n", "left_semi")
        x, y = (own.select(*[F.col(c).alias(c + k) for c in own.columns]) for k in ("_a", "_b"))
        both = pairs.join(x, pairs["a"] == x["n_a"]).join(y, pairs["b"] == y["n_b"]).withColumn("most", bound("counts_a", "counts_b"))
        size = F.col("size_a") + F.col("size_b")
        return both.filter(F.col("most").cast("long") * (20 + twentieths) >= twentieths * size).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b): links of all that whole sets prove alike among the texts that pairs connect."""
        hubs = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("n"), F.col("root").alias("hub"))
        members = materialize(hubs.join(rows.select("n", "id", "size"), "n"))
        full = members.groupBy("hub").agg(F.ceil(F.sum(F.col("size") + BUCKETS) / HUB_SHINGLES).cast("int").alias("k"))
        part = members.join(full, "hub").withColumn("i", F.pmod(F.xxhash64("n"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        placed = part.select("id", "n", "hub", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))
        group = ["hub", "x", "y"]
        both = texts.join(small(materialize(placed)), "id").select(*group, "n", "text").repartition(*group).sortWithinPartitions(*group, "n")
        return both.mapInPandas(lambda batches: _links_of_hubs(batches, group, shingle, twentieths), "a long, b long").distinct()

    met = shared.select("n", F.explode(F.array("lead", "prev")).alias("o")).filter("o >= 0 and o <> n")
    met = met.select(F.least("n", "o").alias("a"), F.greatest("n", "o").alias("b")).distinct()
    first = materialize(verified(materialize(near(materialize(met)))))
    roots = components(first.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rest = materialize(near(materialize(candidates(shared, roots, twentieths))))
    found = first.unionByName(verified(rest))
    named = rows.select("n", "id")
    back = found.join(named.select(F.col("n").alias("a"), F.col("id").alias("dst")), "a").join(named.select(F.col("n").alias("b"), F.col("id").alias("src")), "b")
    return back.select("src", "dst").unionByName(copies.select(F.col("id").alias("src"), "dst")).filter("src <> dst")


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of df for each class of near copies, by shingles or by SimHash: that with the smallest id.

    Different texts of one id, and rows without an id, are documents of their own (simhash.least_of_classes).
    """
    keyed, node = simhash.with_node(df, text_col, id_col)
    by_bits = simhash.near_duplicates(keyed, text_col, node).select(F.col(node).alias("src"), F.col("component_id").alias("dst"))
    edges = by_bits.filter("src <> dst").unionByName(links(keyed, text_col, node))
    return simhash.least_of_classes(keyed, node, id_col, edges).select(*df.columns)
