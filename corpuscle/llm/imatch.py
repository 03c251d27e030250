"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band: not so common that every text has
them, not so rare that they say nothing. Its size is bounded whatever the corpus's, as at most
(mean distinct terms a document) / least_share terms can occur in least_share of the documents.
Random sub-lexicons of halving density are drawn from it; a fingerprint has, for each sub-lexicon, the
number of the text's terms in it and a hash of that set of terms. Sets are hashed by sums of their
terms' hashes, for which distinct terms are sorted once and need not be sorted for each sub-lexicon.

The likeness of two fingerprints is the share of equal sets among the sub-lexicons that tell most: those
in which neither text has more than two terms and one has some; else among all that aren't empty.
Texts without any lexicon term are compared by all their terms.

Edge cases: null counts as the empty text; equal texts have equal fingerprints and likeness 1; rows of
one id stand in the order of a hash of their texts; ids are numbers, strings, dates or bytes; null ids
come last; a single document is followed by itself; an empty table gives an empty table; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.anchors import mixed

#: The band, as shares of the documents; a term of the lexicon is in two documents at least.
LEAST_SHARE = 1 / 2000
MOST_SHARE = 1 / 20
LEVELS = 12
DRAWS = 16
SETS = 1 + LEVELS * DRAWS
#: Rows of one bucket of neighbouring ids. Beyond MOST_BUCKETS, whose bounds every worker holds, buckets
#: grow; a bucket streams through its task, sorted on disk, so its size bounds no memory.
BUCKET_ROWS = 5_000
MOST_BUCKETS = 100_000
TOKEN = re.compile(r"\w+")


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 1_000_000:
            self.clear()
        self[word] = code = xxh64_intdigest(word, 3)
        return code


def term_codes(text: str, codes: _Codes) -> np.ndarray:
    """The distinct terms of a text, as 64-bit codes."""
    words = set(TOKEN.findall(text.lower()))
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


@dataclass(frozen=True)
class Lexicon:
    """Sorted codes of the terms in the band, with the level each draw gives them."""

    codes: np.ndarray
    levels: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray) -> Lexicon:
        codes = np.sort(codes.astype(np.uint64))
        levels = np.zeros((DRAWS, len(codes)), np.int8)
        with np.errstate(over="ignore"):
            for r in range(DRAWS):
                drawn = mixed(codes ^ np.uint64(0x1234567 + 7919 * r)) >> np.uint64(64 - LEVELS)
                # a term is in level l with probability 2**-l: the top l bits are zero
                levels[r] = LEVELS - np.frexp(drawn.astype(np.float64))[1]
        return cls(codes, levels)


def document_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): in how many texts each term occurs, over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        for pdf in batches:
            parts = [term_codes(t or "", codes) for t in pdf[text_col]]
            got, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"code": got.view(np.int64), "n": n})

    return df.select(text_col).mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> Lexicon:
    total = df.count()
    band = document_frequencies(df, text_col).filter((F.col("n") >= max(2.0, least * total)) & (F.col("n") <= max(2.0, most * total)))
    return Lexicon.of(band.select("code").toPandas()["code"].to_numpy(np.int64).view(np.uint64))


def fingerprint_table(texts: list[str], lex: Lexicon, codes: _Codes) -> np.ndarray:
    """A row of SETS 16-bit numbers for each text: 4 bits of the count, 12 of the hash; 0: an empty set."""
    out = np.zeros((len(texts), SETS), np.uint16)
    own = [term_codes(t, codes) for t in texts]
    every = np.concatenate(own) if own else np.empty(0, np.uint64)
    if len(lex.codes):
        at = np.minimum(np.searchsorted(lex.codes, every), len(lex.codes) - 1)
        known = lex.codes[at] == every
    else:
        at, known = np.zeros(len(every), np.int64), np.zeros(len(every), bool)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in own])[known]
    at = at[known]
    for n in np.flatnonzero(np.bincount(owner, minlength=len(texts)) == 0):  # all terms stand in, in every set
        with np.errstate(over="ignore"):
            whole = int(mixed(own[n]).sum(dtype=np.uint64) >> np.uint64(52)) if len(own[n]) else 0
        out[n] = (min(15, max(1, len(own[n]))) << 12) | whole
    if not len(at):
        return out
    codes = lex.codes[at]

    def put(s: int, codes: np.ndarray, owner: np.ndarray) -> None:
        starts = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mixed(codes + np.uint64(s)), starts) >> np.uint64(52)
        count = np.minimum(np.diff(np.append(starts, len(owner))), 15).astype(np.uint64)
        out[owner[starts], s] = ((count << np.uint64(12)) | total).astype(np.uint16)

    put(0, codes, owner)
    for r in range(DRAWS):
        # each level's set is part of that of the level before
        level, c, o = lex.levels[r][at], codes, owner
        for depth in range(1, LEVELS + 1):
            inside = level >= depth
            level, c, o = level[inside], c[inside], o[inside]
            if not len(c):
                break
            put(r * LEVELS + depth, c, o)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from 0 to 1; two texts without terms are alike."""
    some = (a > 0) | (b > 0)
    fine = some & (a >> 12 <= 2) & (b >> 12 <= 2)
    use = np.where(fine.sum(axis=1, keepdims=True) >= 3, fine, some)
    n = use.sum(axis=1)
    same = ((a == b) & use).sum(axis=1)
    return np.where((a == b).all(axis=1), 1.0, same / np.maximum(n, 1))


def as_text(table: np.ndarray) -> list[str]:
    raw = table.astype(">u2").tobytes().hex()
    width = SETS * 4
    return [raw[i * width : (i + 1) * width] for i in range(len(table))]


def fingerprints(df: DataFrame, lex: Lexicon, text_col: str = "text") -> DataFrame:
    """df with its fingerprint, a string of hexadecimal digits."""
    sent = df.sparkSession.sparkContext.broadcast(lex)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(as_text(fingerprint_table([t or "" for t in texts], sent.value, _Codes())))

    return df.withColumn("fingerprint", run(F.col(text_col)))


def in_id_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, lent, given, id, text) so that a bucket's rows, in order, followed by one lent row, are
    consecutive documents by descending id; the last document is followed by the first.

    Buckets are ranges of (id, hash of the text), so an id of many texts is cut too.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text")).withColumn("given", F.col("id").isNotNull())
    if dict(docs.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint"):
        # whole numbers with nulls would become floats on the way
        docs = docs.withColumn("id", F.coalesce("id", F.lit(0).cast(docs.schema["id"].dataType)))
    keys = docs.filter("given").select("id", "tie")
    pieces = min(MOST_BUCKETS, max(1, keys.count() // BUCKET_ROWS))
    cuts = []
    if pieces > 1:
        # one pair a range: where it begins
        ranges = keys.repartitionByRange(pieces, "id", "tie").groupBy(F.spark_partition_id().alias("p"))
        cuts = sorted(tuple(r["first"]) for r in ranges.agg(F.min(F.struct("id", "tie")).alias("first")).collect())[1:]

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, ties: pd.Series, given: pd.Series) -> pd.Series:
        # nulls: the last bucket
        return pd.Series([len(cuts) - bisect_right(cuts, (i, t)) if g else len(cuts) for i, t, g in zip(ids.tolist(), ties.tolist(), given)])

    placed = docs.withColumn("bucket", bucket("id", "tie", "given") if cuts else F.lit(0))
    heads = placed.groupBy("bucket").agg(F.max(F.struct("given", "id", "tie", "text")).alias("head"))
    # the window sees numbers of buckets alone
    around = Window.partitionBy(F.lit(1)).orderBy("bucket")
    to = placed.select("bucket").distinct().select("bucket", F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(Window.partitionBy(F.lit(1)))).alias("to"))
    lent = heads.join(F.broadcast(to), "bucket").select(F.col("to").alias("bucket"), F.lit(1).alias("lent"), "head.*")
    both = placed.select("bucket", F.lit(0).alias("lent"), "given", "id", "tie", "text").unionByName(lent)
    return both.repartition("bucket").sortWithinPartitions("bucket", "lent", *[F.col(c).desc() for c in ("given", "id", "tie")]).select("bucket", "lent", "given", "id", "text")


def edited(text: str, following: str) -> str:
    """The last third replaced by the start of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_RESULT = "given boolean, id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its fingerprint and its edited text's, and its likeness to that and to the next document."""
    sent = df.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            rest = pdf.iloc[-1:]
            for at in range(0, len(pdf) - 1, 500):
                yield pairs(pdf.iloc[at : at + 501], codes)

    def pairs(pdf: pd.DataFrame, codes: _Codes) -> pd.DataFrame:
        texts = pdf["text"].tolist()
        new = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own = fingerprint_table(texts, sent.value, codes)
        other = fingerprint_table(new, sent.value, codes)
        out = pd.DataFrame({
            "given": pdf["given"].iloc[:-1].to_numpy(),
            "id": pdf["id"].iloc[:-1].to_numpy(),
            "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
            "fingerprint": as_text(own[:-1]),
            "edited_fingerprint": as_text(other),
            "near_edited": likeness(own[:-1], other),
            "near_next": likeness(own[:-1], own[1:]),
        })
        # a lent row ends its bucket; what follows it is another bucket's
        return out[pdf["lent"].iloc[:-1].to_numpy() == 0]

    kind = df.schema[id_col].dataType.simpleString()
    found = in_id_order(df, id_col, text_col).mapInPandas(run, _RESULT.format(id=kind))
    return found.select(F.when(F.col("given"), F.col("id")).alias(id_col), *[c for c in found.columns if c not in ("given", "id")])
