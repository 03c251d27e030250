"""Meaning from contexts: embedded windows, their centroids, and how those move."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import stats
from corpuscle.functions.text import positions
from corpuscle.operators.corpus import Corpus, period_label, unit_of
from corpuscle.plans.storage import ranged, running, small, written

#: Keys whose sums a task holds at most, and pairs of texts that it turns together.
SUMS = 20_000
PAIRS = 8192


@dataclass(frozen=True)
class HashEmbedder:
    """A unit vector for each text, drawn from a generator that its SHA-256 seeds."""

    dim: int = 32

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        rows = np.zeros((len(texts), self.dim))
        for row, text in zip(rows, texts):
            seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
            row[:] = np.random.default_rng(seed).standard_normal(self.dim)
            row /= np.linalg.norm(row) or 1.0
        return rows


@dataclass(frozen=True)
class LetterEmbedder:
    """How often each letter from a to z is in a text: a crude form vector that needs no model."""

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float).reshape(len(texts), 26)


@dataclass(frozen=True)
class ModelEmbedder:
    """Any model with encode(list of texts) -> array; load() is called once in each worker."""

    load: Callable[[], object]

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        if not hasattr(ModelEmbedder, "_model"):
            ModelEmbedder._model = self.load()
        return np.asarray(ModelEmbedder._model.encode(list(texts)), float)


def embedded(text: Column, embedder) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        rows = np.asarray(embedder.encode(texts.tolist()), float)
        if rows.ndim != 2 or len(rows) != len(texts):
            raise ValueError("an embedder returns one row for each text")
        return pd.Series(list(rows))

    return run(text)


def mean_vector(vectors: DataFrame, keys: Sequence[str], col: str = "vector") -> DataFrame:
    """(keys, n, centroid): the mean of each coordinate, combined before the shuffle."""
    each = vectors.select(*keys, F.posexplode(col).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    rows = each.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select(*keys, "n", F.transform("v", lambda s: s["x"]).alias("centroid"))


def window_texts(corpus: Corpus, targets: Sequence[str], window: int = 5, *keep: str) -> DataFrame:
    """(keep, target, text): each occurrence with its neighbours, the target included."""
    if window < 1:
        raise ValueError("a window has at least one token")
    lists = corpus.token_lists(*keep)
    wanted = F.array(*[F.lit(t) for t in targets])
    rows = lists.filter(F.arrays_overlap("tokens", wanted)).select(*keep, "tokens", F.explode(wanted).alias("target"))
    # cut within the row, so that no occurrence carries all tokens
    found = F.transform(positions(F.col("tokens"), F.col("target")), lambda at: _around(F.col("tokens"), at, window))
    return rows.select(*keep, "target", F.explode(found).alias("text"))


def _around(tokens: Column, at: Column, window: int) -> Column:
    start = F.greatest(at - window, F.lit(1))
    return F.array_join(F.slice(tokens, start, at + window - start + 1), " ")


def _centroids(texts: DataFrame, keys: Sequence[str], embedder) -> DataFrame:
    """(keys, n, centroid): texts are embedded where they are, and only sums go on, one for each key and task.

    Equal texts of a batch are embedded once; each counts as often as it occurs.
    """

    def run(batches):
        at, sums, n = {}, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            codes, different = pd.factorize(pdf["text"])
            vectors = np.asarray(embedder.encode(list(different)), float)
            groups = pdf.groupby(list(keys), sort=False, dropna=False)
            group = groups.ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
            own = np.add.reduceat(vectors[codes[order]], first, axis=0)
            names = list(pdf.iloc[order[first]][list(keys)].itertuples(index=False, name=None))
            if sums is None or len(at) + len(names) > SUMS:
                if sums is not None:
                    yield frame(at, sums, n)
                size = max(SUMS, len(names))
                at, sums, n = {}, np.zeros((size, vectors.shape[1])), np.zeros(size, np.int64)
            rows = [at.setdefault(k, len(at)) for k in names]
            sums[rows] += own
            n[rows] += np.diff(np.r_[first, len(pdf)])
        if at:
            yield frame(at, sums, n)

    def frame(at, sums, n):
        out = pd.DataFrame(list(at), columns=list(keys))
        return out.assign(n=n[: len(at)], s=sums[: len(at)].tolist())

    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    parts = texts.select(*keys, "text").mapInPandas(run, f"{kinds}, n long, s array<double>")
    got = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("s").alias("s"))
    total = F.aggregate(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), F.col("s")[0], lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
    return got.select(*keys, "n", F.transform(total, lambda x: x / F.col("n")).alias("centroid"))


def procrustes(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The rotation that brings the rows of source nearest to those of target."""
    source, target = np.asarray(source, float), np.asarray(target, float)
    if source.shape != target.shape or source.ndim != 2:
        raise ValueError("both sides need the same rows and columns")
    u, _, v = np.linalg.svd(source.T @ target)
    return u @ v


def semantic_shift(a: Corpus, b: Corpus, target: str | Sequence[str], embedder=None, window: int = 5, align: str = "none") -> DataFrame:
    """(target, cosine_similarity, cosine_distance, n_contexts_a, n_contexts_b); NaN where a side lacks the target."""
    if align not in ("none", "procrustes"):
        raise ValueError("align is 'none' or 'procrustes'")
    targets = [target] if isinstance(target, str) else list(target)
    if not targets:
        raise ValueError("give a term or several")
    embedder = embedder or HashEmbedder()
    texts = None
    for side, name in ((a, "a"), (b, "b")):
        own = window_texts(side, targets, window).withColumn("side", F.lit(name))
        texts = own if texts is None else texts.unionByName(own)
    found = written(_centroids(texts, ["side", "target"], embedder))
    if align == "procrustes":
        warnings.warn("rows of the two sides are paired by their order; the rotation has no meaning", FutureWarning, stacklevel=2)
        found = _rotated(texts, found, embedder)
    sides = {s: found.filter(F.col("side") == s).select("target", F.col("n").alias(f"n_{s}"), F.col("centroid").alias(f"c_{s}")) for s in "ab"}
    listed = a.df.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    both = listed.join(sides["a"], "target", "left").join(sides["b"], "target", "left")
    cos = F.when(F.col("c_a").isNull() | F.col("c_b").isNull(), stats.NAN).otherwise(stats.cosine(F.col("c_a"), F.col("c_b")))
    return both.select(
        "target", cos.alias("cosine_similarity"), (1 - cos).alias("cosine_distance"),
        F.coalesce("n_a", F.lit(0)).alias("n_contexts_a"), F.coalesce("n_b", F.lit(0)).alias("n_contexts_b"),
    )


def _rotated(texts: DataFrame, found: DataFrame, embedder) -> DataFrame:
    """Side b's centroids after the rotation; texts are paired by their places in blocks, and embedded there."""
    # different texts of a side and target take places from k0 on, in their order; counted range by range
    counted = texts.groupBy(F.struct("side", "target", "text").alias("key")).agg(F.count("*").alias("w"))
    rows = running(ranged(counted, "key"), "key", "sum", "w", "end").select("key.*", "w", (F.col("end") - F.col("w")).alias("k0"))
    first = F.broadcast(rows.groupBy("side", "target").agg(F.min("k0").alias("base")))
    rows = rows.join(first, ["side", "target"]).withColumn("k0", F.col("k0") - F.col("base"))
    many = F.broadcast(texts.groupBy("target").agg(F.sum(F.expr("int(side = 'a')")).alias("a"), F.sum(F.expr("int(side = 'b')")).alias("b")))
    rows = rows.join(many, "target").filter(F.col("k0") < F.least("a", "b")).select("side", "target", "text", "w", "k0")
    blocks = F.sequence(F.expr(f"k0 div {PAIRS}"), F.expr(f"(k0 + w - 1) div {PAIRS}"))
    rows = rows.withColumn("block", F.explode(blocks))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = int(pdf["block"].iloc[0]) * PAIRS
        sides = []
        for side in ("b", "a"):
            own = pdf[pdf["side"] == side].sort_values("k0")
            vectors = np.asarray(embedder.encode(own["text"].tolist()), float)
            k0 = own["k0"].to_numpy()
            times = np.minimum(k0 + own["w"].to_numpy(), begin + PAIRS) - np.maximum(k0, begin)
            sides.append(vectors[np.repeat(np.arange(len(own)), times)])
        n = min(map(len, sides))
        return pd.DataFrame({"m": pd.Series([(sides[0][:n].T @ sides[1][:n]).ravel().tolist()] if n else [], dtype=object)})

    each = rows.groupBy("target", "block").applyInPandas(run, "m array<double>").select(F.posexplode("m").alias("i", "x"))
    parts = [r["x"] for r in each.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]
    if not parts:
        return found
    d = int(np.sqrt(len(parts)))
    u, _, v = np.linalg.svd(np.array(parts).reshape(d, d))
    turn = u @ v

    @F.pandas_udf("array<double>")
    def rotate(c: pd.Series) -> pd.Series:
        return c.map(lambda x: (np.asarray(x) @ turn).tolist())

    return found.withColumn("centroid", F.when(F.col("side") == "b", rotate("centroid")).otherwise(F.col("centroid")))


def neighborhood_drift(a: Corpus, b: Corpus, target: str, k: int = 10, embedder=None, window: int = 5, min_count: int = 2) -> DataFrame:
    """(neighbor, sim_a, sim_b, rank_a, rank_b, drift, status): the nearest words of each side, and their change.

    All candidates are embedded in one pass over each side's tokens.
    """
    if k < 1:
        raise ValueError("at least one neighbour is sought")
    embedder = embedder or HashEmbedder()
    tops, sims = {}, {}
    for side, name in ((a, "a"), (b, "b")):
        own = window_texts(side, [target], window)
        near = written(own.select(F.explode(F.split("text", " ")).alias("neighbor")).filter(F.col("neighbor") != target).distinct())
        around = F.transform("tokens", lambda t, i: F.struct(t.alias("neighbor"), _around(F.col("tokens"), i + 1, window).alias("text")))
        tokens = side.token_lists().select(F.inline(around)).join(small(near), "neighbor", "left_semi")
        each = _centroids(tokens, ["neighbor"], embedder).filter(F.col("n") >= min_count)
        center = _centroids(own, ["target"], embedder).select(F.col("centroid").alias("c"))
        sim = written(each.crossJoin(F.broadcast(center)).select("neighbor", stats.cosine(F.col("centroid"), F.col("c")).alias(f"sim_{name}")))
        first = sim.orderBy(F.desc(f"sim_{name}"), "neighbor").limit(k)
        tops[name] = first.withColumn(f"rank_{name}", F.row_number().over(Window.orderBy(F.desc(f"sim_{name}"), "neighbor"))).select("neighbor", f"rank_{name}")
        sims[name] = sim
    both = tops["a"].join(tops["b"], "neighbor", "full_outer").join(sims["a"], "neighbor", "left").join(sims["b"], "neighbor", "left")
    status = F.when(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull(), "shared").when(F.col("rank_a").isNotNull(), "gained_in_a").otherwise("lost_in_a")
    drift = F.coalesce("sim_a", F.lit(0.0)) - F.coalesce("sim_b", F.lit(0.0))
    table = both.select("neighbor", "sim_a", "sim_b", "rank_a", "rank_b", drift.alias("drift"), status.alias("status"))
    return table.orderBy(F.desc(F.abs("drift")), "neighbor")


def semantic_trajectory(
    corpus: Corpus, target: str | Sequence[str], time_col: str = "date", freq: str = "Y", embedder=None, window: int = 5, baseline_period: str | None = None
) -> DataFrame:
    """(period, period_label, target, n_contexts, similarity_to_baseline, distance_from_baseline).

    The baseline is a target's first period with contexts, or the one named.
    """
    targets = [target] if isinstance(target, str) else list(target)
    unit = unit_of(freq)
    dated = corpus.by_time(time_col, freq).docs.filter("period is not null")
    timed = Corpus(dated, corpus.text_col, tokenizer=corpus.tokenizer)
    found = written(_centroids(window_texts(timed, targets, window, "period"), ["period", "target"], embedder or HashEmbedder()))
    if baseline_period is None:
        base = found.groupBy("target").agg(F.min_by("centroid", "period").alias("base"))
    else:
        base = found.filter(period_label(F.col("period"), unit) == str(baseline_period)).select("target", F.col("centroid").alias("base"))
        if base.count() < len(set(targets)):
            raise ValueError(f"the baseline {baseline_period} has no contexts of every target")
    listed = corpus.df.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    grid = dated.select("period").distinct().crossJoin(F.broadcast(listed))
    table = grid.join(found, ["period", "target"], "left").join(base, "target", "left")
    sim = F.when(F.col("centroid").isNull(), stats.NAN).otherwise(stats.cosine(F.col("centroid"), F.col("base")))
    return table.select(
        "period", period_label(F.col("period"), unit).alias("period_label"), "target", F.coalesce("n", F.lit(0)).alias("n_contexts"),
        sim.alias("similarity_to_baseline"), (1 - sim).alias("distance_from_baseline"),
    ).orderBy("target", "period")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)
