"""SimHash near-duplicates through covering locality-sensitive hashing.

Each of the 64 fingerprint bits gets a non-zero vector of radius+1 bits; table v (non-zero too)
compares the bits whose vector has an odd inner product with v. Any `radius` bits span less than the
whole space, so some v is orthogonal to all of them: every pair within the radius agrees in a table.

Only different fingerprints enter the tables. A bucket of two is compared by a column expression;
larger ones in blocks of bounded size, from which a spanning forest of links comes out, never all
pairs. A bucket of very many fingerprints is parted by the tables of other masks before.

Edge cases: null or empty texts have no words and the fingerprint zero, linked like any other;
repeated rows each get their row; null ids are ignored as representatives (a class of null ids alone has
no component_id); an empty table gives an empty table; other columns aren't read, and keep_one() keeps
them. keep_one() takes different texts of one id for different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import components, free, materialize, small, trim

SHINGLE = 4
RADIUS = 4
#: Most fingerprints of one bucket that a task compares with one another.
BLOCK = 2048
#: Blocks of one bucket beyond which further masks part it.
BLOCKS = 16


def fingerprints(texts: pd.Series, shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints: bit set if set in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest as digest

    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for n, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes = [digest(joined, 42)]
        else:
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(sizes) - 1
            starts = (ends + 1 - sizes)[: len(words) - shingle + 1].tolist()
            hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        h = np.array(hashes, np.uint64)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            part = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += part.sum(axis=0, dtype=np.uint32)
        out[n] = weights[counts * 2 > len(h)].sum(dtype=np.uint64)
    return out.view(np.int64)


def masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """The signed bit masks of the 2**(radius+1) - 1 tables."""
    size = 2 ** (radius + 1) - 1
    vectors = np.random.default_rng(seed).permutation(np.resize(np.arange(1, size + 1), bits))
    found = []
    for v in range(1, size + 1):
        m = sum(1 << i for i, x in enumerate(vectors) if bin(int(x) & v).count("1") % 2)
        found.append(m - (1 << 64) if m >= 1 << 63 else m)
    return found


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the classes of fps under distance <= radius."""
    x = fps.view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(x))
    return fps[own], fps[label[own]]


def _tables(radius: int, seed: int):
    """An entry (v, bucket) for each table."""
    return F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for v, m in enumerate(masks(radius, seed=seed))])


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """(src, dst): links that connect exactly the fingerprints (column fp) that are connected
    through pairs of at most `radius` differing bits."""
    keys = fps.select("fp", F.explode(_tables(radius, 7)).alias("k")).select("fp", "k.v", "k.bucket")
    sizes = materialize(
        keys.groupBy("v", "bucket").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).filter("n > 1")
    )
    pairs = sizes.filter(F.col("n") == 2).filter(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)
    most = block * blocks
    big = sizes.filter((F.col("n") > 2) & (F.col("n") <= most)).select("v", "bucket", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    plain = keys.join(big, ["v", "bucket"]).select("v", "bucket", F.lit(-1).alias("w"), F.lit(0).cast("long").alias("inner"), "salts", "fp")
    # A bucket of very many is parted by the tables of other masks first.
    hot = sizes.filter(F.col("n") > most).select("v", "bucket")
    if hot.limit(1).count():
        again = keys.join(hot, ["v", "bucket"]).select("v", "bucket", "fp", F.explode(_tables(radius, 11)).alias("k"))
        again = materialize(again.select("v", "bucket", F.col("k.v").alias("w"), F.col("k.bucket").alias("inner"), "fp"))
        parts = again.groupBy("v", "bucket", "w", "inner").agg(F.count("*").alias("n")).filter("n > 1")
        parts = parts.select("v", "bucket", "w", "inner", F.ceil(F.col("n") / block).cast("int").alias("salts"))
        plain = plain.unionByName(again.join(parts, ["v", "bucket", "w", "inner"]).select("v", "bucket", "w", "inner", "salts", "fp"))
    # What is above the block size is compared block against block.
    salt = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    group = ["v", "bucket", "w", "inner", "a", "b"]
    placed = (
        plain.withColumn("s", salt)
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("v", "bucket", "w", "inner", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "fp")
        .repartition(*group)
        .sortWithinPartitions(*group)
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            g = pdf[group].to_numpy()
            cuts = np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            rest = pdf.iloc[edges[-1] :]
            yield from spans(pdf["fp"].to_numpy(np.int64), edges)
        if rest is not None and len(rest):
            yield from spans(rest["fp"].to_numpy(np.int64), [0, len(rest)])

    def spans(fp: np.ndarray, edges: list[int]) -> Iterator[pd.DataFrame]:
        found = [_forest(fp[a:b], radius) for a, b in zip(edges, edges[1:])]
        if found:
            yield pd.DataFrame({"src": np.concatenate([f[0] for f in found]), "dst": np.concatenate([f[1] for f in found])})

    return pairs.select("src", "dst").unionByName(placed.mapInPandas(compare, "src long, dst long")).distinct()


def near_duplicates(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """Per row of df: its id, fp (the fingerprint as a signed long) and component_id."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fingerprints(texts, shingle))
        trim()

    rows = materialize(df.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fp")))
    least = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = components(links(least.select("fp"), radius))
    roots = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = roots.join(classes, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row of df for each class of near-duplicates: that with the smallest id (see least_of_classes)."""
    keyed, node = with_node(df, text_col, id_col)
    edges = near_duplicates(keyed, text_col, node, **options).select(F.col(node).alias("src"), F.col("component_id").alias("dst"))
    return least_of_classes(keyed, node, id_col, edges.filter("src <> dst")).select(*df.columns)


def with_node(df: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, str]:
    """df with a 64-bit hash of id and text, and that column's name: different texts of one id, and rows
    without an id, are nodes of their own."""
    (node,) = free(df, "node")
    return df.withColumn(node, F.xxhash64(F.struct(F.col(id_col)), F.col(text_col), F.lit(17))), node


def least_of_classes(keyed: DataFrame, node: str, id_col: str, edges: DataFrame) -> DataFrame:
    """The rows of keyed but for those that a link (src, dst) of nodes binds to a row with a smaller id.

    Null ids come last; of rows alike in id and text one stays.
    """
    found = components(edges)
    ids = keyed.select(F.col(node).alias("node"), F.col(id_col).alias("id")).join(found, "node")
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))
    first = ids.groupBy("root").agg(F.min(rank).alias("first"))
    rest = found.join(first, "root").filter(F.col("node") != F.col("first.node")).select(F.col("node").alias(node))
    kept = keyed.join(small(rest), node, "left_anti")
    # only rows that repeat are shuffled
    twice = small(materialize(keyed.groupBy(node).agg(F.count("*").alias("n")).filter("n > 1").select(node)))
    return kept.join(twice, node, "left_anti").unionByName(kept.join(twice, node, "left_semi").dropDuplicates([node]))
