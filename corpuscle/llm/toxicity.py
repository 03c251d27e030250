"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A document is toxic if at least one of its sentences is: P(doc) = 1 - prod(1 - P(sentence)). Only the
document labels are known; the gradient of the document's loss reaches each sentence in proportion to
its own probability, so the model learns which sentences offend, and names them.

A sentence's features are its different words and their prefixes of 4 to 6 letters.

Edge cases: null and empty texts count as one sentence without words, so they get the model's base
score; repeated rows each get their row; documents with several labels count as toxic if one says so;
unlabelled rows and null labels are not learnt from; without any labels every score is 0; an empty table
gives an empty table. score() replaces columns named score and offending; drop_toxic() keeps all columns
as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import free, trim

#: Most labelled rows that a model is fitted on; more are thinned evenly by a hash of their id.
MAX_ROWS = 6_000
#: Most characters of their texts together; beyond, the rows that come last in the order of the hash are left out.
MAX_CHARS = 48_000_000
#: Most features of a model, those that separate best; so the model's size is bounded.
MAX_FEATURES = 20_000
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
ENDS = frozenset(".!?\n")
THRESHOLD = 0.5
#: Counters of the first look at the features.
BUCKETS = 1 << 22


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[str, float]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)]


def sentences(text: str) -> list[list[str]]:
    """The lower-cased words of each sentence; sentences without words are left out, but for a text without any."""
    found, now = [], []
    for t in TOKEN.findall(text.lower()):
        if t[0] in ENDS:
            if now:
                found.append(now)
                now = []
        else:
            now.append(t)
    if now or not found:
        found.append(now)
    return found


def _features_of(text: str | None) -> set[str]:
    return {f for w in {w for s in sentences(text or "") for w in s} for f in features(w)}


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass(frozen=True)
class Bags:
    """Documents as bags of sentences: (rows, cols) say which sentence has which feature, owner whose a
    sentence is, plain how many sentences of a document have none, y its label."""

    rows: np.ndarray
    cols: np.ndarray
    owner: np.ndarray
    plain: np.ndarray
    y: np.ndarray
    decay: float = 1e-5

    def loss_and_gradient(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """Mean log loss of the noisy-or, P(doc) = 1 - exp(-sum softplus(score)), with decay; the bias is last."""
        y, n = self.y, len(self.y)
        score = np.bincount(self.rows, w[self.cols], len(self.owner)) + b
        bag = np.bincount(self.owner, _softplus(score), n) + self.plain * _softplus(np.array(b))
        bag = np.maximum(bag, 1e-9)
        loss = ((1 - y) * bag - y * np.log(-np.expm1(-bag))).sum() / n + self.decay * (w @ w) / 2
        pull = (1 - y) - y / np.expm1(np.minimum(bag, 500.0))
        own = pull[self.owner] / (1 + np.exp(-score))
        grad = np.empty(len(w) + 1)
        grad[:-1] = np.bincount(self.cols, own[self.rows], len(w)) / n + self.decay * w
        grad[-1] = (own.sum() + (pull * self.plain).sum() / (1 + np.exp(-b))) / n
        return float(loss), grad


def fit(texts: list[str], labels: list[int], rounds: int = 250, least_z: float = 3.0) -> ToxicityModel:
    """Full-batch training (Adam with decay of weights) on documents in memory."""
    y = np.array(labels, np.float64)
    if not len(y):
        return ToxicityModel(-30.0, {})
    rate = y.mean()

    def strength(n: np.ndarray | int, hits: np.ndarray | int):
        want = n * rate
        return (hits - want) / np.sqrt(want * (1 - rate) + 1)

    # Counts by hash first, in two arrays of fixed size, so that only promising features are held by name.
    seen, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for text, label in zip(texts, labels):
        at = np.unique([crc32(f.encode()) % BUCKETS for f in _features_of(text)] or [0])
        seen[at] += 1
        if label:
            toxic[at] += 1
    good = (seen >= 4) & (np.abs(strength(seen, toxic)) >= least_z)
    named, toxic_named = Counter(), Counter()
    for text, label in zip(texts, labels):
        own = [f for f in _features_of(text) if good[crc32(f.encode()) % BUCKETS]]
        named.update(own)
        if label:
            toxic_named.update(own)
    z = {f: v for f, n in named.items() if n >= 4 and abs(v := strength(n, toxic_named[f])) >= least_z}
    names = sorted(z, key=lambda f: (-abs(z[f]), f))[:MAX_FEATURES]
    at = {f: i for i, f in enumerate(names)}
    # rows: sentences with a known feature; the others of a document only have the bias
    rows, cols, owner, plain = [], [], [], np.zeros(len(y))
    for d, text in enumerate(texts):
        for s in sentences(text or ""):
            ids = list({at[f] for w in s for f in features(w) if f in at})
            if ids:
                rows += [len(owner)] * len(ids)
                cols += ids
                owner.append(d)
            else:
                plain[d] += 1
    rows, cols, owner = np.array(rows, np.int64), np.array(cols, np.int64), np.array(owner, np.int64)
    bags = Bags(rows, cols, owner, plain, y)
    w, b = np.zeros(len(names)), -6.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):
        _, grad = bags.loss_and_gradient(w, b)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - change[:-1], b - change[-1]
    return ToxicityModel(float(b), {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3})


def train(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
    max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS,
) -> ToxicityModel:
    """Fit on the labelled rows of docs, or on the first max_rows of them in the order of a hash of their
    ids, and of these on as many as hold max_chars characters together."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = known.select(F.col(id_col).alias("id"), "y", F.xxhash64(id_col, F.lit("sample")).alias("h"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = texts.join(known, "id")
    n = both.count()
    if n > max_rows:
        # a little more than is wanted, so that only so much is sorted
        share = min(1.0, 1.2 * (max_rows + 50) / n)
        both = both.filter(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    rank = (F.pmod("h", F.lit(1_000_000)), F.col("h"), F.xxhash64("text"))
    sizes = both.select(*[c.alias(f"r{i}") for i, c in enumerate(rank)], F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    sizes = sizes.orderBy("r0", "r1", "r2").limit(max_rows).collect()
    rows = max(int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), max_chars, side="right")), 1) if sizes else 0
    if rows:
        # up to the last row that is wanted; only rows alike can go beyond the limit
        x, y, z = (F.lit(v).cast("long") for v in tuple(sizes[rows - 1])[:3])
        both = both.filter((rank[0] < x) | (rank[0] == x) & ((rank[1] < y) | (rank[1] == y) & (rank[2] <= z)))
    got = both.select("id", "text", "y").limit(rows).toPandas().sort_values(["id", "text"])
    return fit(got["text"].tolist(), (got["y"] > 0).astype(int).tolist())


class Scorer:
    """Scores texts; keeps each word's weight, for as long as a bounded table holds it."""

    def __init__(self, model: ToxicityModel, words: int = 100_000):
        self.model, self.words, self.known = model, words, {}

    def weight(self, word: str) -> tuple[tuple[str, float], ...]:
        got = tuple((f, self.model.weights[f]) for f in features(word) if f in self.model.weights)
        if len(self.known) >= self.words:
            self.known.clear()
        self.known[word] = got
        return got

    def sentence_scores(self, text: str | None) -> list[float]:
        out, known = [], self.known
        for words in sentences(text or ""):
            own = {}
            for w in words:
                got = known.get(w)
                if got is None:
                    got = self.weight(w)
                if got:
                    own.update(got)
            out.append(self.model.bias + sum(own.values()))
        return out


def _judged(df: DataFrame, model: ToxicityModel, text_col: str, out: str) -> DataFrame:
    """df with out: struct(score, offending)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score:double,offending:array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for texts in batches:
            scores, bad = [], []
            for t in texts:
                z = np.array(scorer.sentence_scores(t))
                scores.append(float(-np.expm1(-_softplus(z).sum())))
                bad.append([int(i) for i in np.flatnonzero(z >= 0)])
            yield pd.DataFrame({"score": scores, "offending": bad})
        del scorer
        trim()

    return df.withColumn(out, run(F.col(text_col)))


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1) and offending: the numbers, from 0, of the sentences of at least the threshold."""
    df = df.drop("score", "offending")
    (out,) = free(df, "s")
    return _judged(df, model, text_col, out).select(*df.columns, f"{out}.*")


def locate(df: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, sentence number, its words, its probability) of each offending sentence."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<sentence:int,words:string,probability:double>>")
    def run(texts: pd.Series) -> pd.Series:
        scorer, out = Scorer(sent.value), []
        for t in texts:
            z = scorer.sentence_scores(t)
            parts = sentences(t or "")
            out.append([(i, " ".join(parts[i]), float(1 / (1 + np.exp(-x)))) for i, x in enumerate(z) if x >= 0])
        return pd.Series(out)

    return df.select(F.col(id_col), F.explode(run(F.col(text_col))).alias("s")).select(id_col, "s.*")


def held_out(id_col: str = "doc_id"):
    """A fifth of the ids, by CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of df whose score is below the threshold, with all their own columns."""
    (out,) = free(df, "s")
    return _judged(df, model, text_col, out).filter(F.col(out)["score"] < THRESHOLD).select(*df.columns)
