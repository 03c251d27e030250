"""Senses as clusters of embeddings, their agreement with labels, drift and novelty over time.

Embeddings are a column of the rows they belong to. Models (centroids, a covariance) are of the size
of the dimension and go through the driver; rows do not.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import stats
from corpuscle.operators.corpus import period_label, unit_of
from corpuscle.operators.resampling import dense_index, keyed_permutation
from corpuscle.operators.semantic import mean_vector
from corpuscle.plans.storage import written

STOP = frozenset("the and for that with this from are was were have has had not but they you his her its our their which who will would can".split())
#: Rows of a block in a nearest-neighbour search, at least and at most, and blocks of a side until they are full.
BLOCK = 4096
FULL_BLOCK = 65_536
BLOCKS = 4
#: Numbers that a task computes at once, and that one of k-means has.
CELLS = 2_000_000
FIT_CELLS = 1_000_000
#: Fits or permutations whose jobs run side by side.
AT_ONCE = 6
#: Rows that silhouettes look at, and up to which Ward clustering takes each by itself; and its small clusters beyond.
SAMPLE = 2000
MICRO = 500
#: Rows that a search index is fitted on at most, and its cells.
INDEX_SAMPLE = 50_000
INDEX_CELLS = 1024


def unit(v: Column) -> Column:
    n = stats.norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def beside(one: Callable[[int], Any], times: int) -> list:
    """one(0), one(1), ... side by side, as each waits for many short jobs; in their order."""
    with ThreadPoolExecutor(max(1, min(times, AT_ONCE))) as pool:
        return list(pool.map(one, range(times)))


def kmeans_centroids(df: DataFrame, k: int, seed: int = 42, restarts: int = 10, col: str = "x") -> np.ndarray:
    """The best of several fits by cost. Each has dozens of short jobs, so rows are in as few tasks as their size needs."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(col)), F.lit(0)).alias("d")).first()
    parts = max(1, -(-size["n"] * size["d"] // FIT_CELLS))
    vectors = df.select(array_to_vector(F.col(col)).alias("features")).coalesce(parts).persist()
    try:
        vectors.count()
        fits = beside(lambda i: KMeans(k=k, seed=seed + i, maxIter=50).fit(vectors), restarts)
        best = min(fits, key=lambda m: m.summary.trainingCost)
        return np.array(best.clusterCenters())
    finally:
        vectors.unpersist()


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette under Euclidean distance; NaN with fewer than two clusters."""
    names = np.unique(labels)
    if len(names) < 2:
        return float("nan")
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)) if len(x) <= 500 else np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    means = np.stack([d[:, labels == c].sum(axis=1) for c in names], axis=1)
    sizes = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    a = means[np.arange(len(x)), own] / np.maximum(sizes[own] - 1, 1)
    other = means / sizes
    other[np.arange(len(x)), own] = np.inf
    b = other.min(axis=1)
    s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def ward(x: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Labels of k clusters by Ward's criterion, on a few thousand rows; a weight is how many rows one stands for."""
    n = len(x)
    size, alive, label = np.ones(n) if weights is None else np.asarray(weights, float), np.ones(n, bool), np.arange(n)
    size = size.copy()
    square = (x**2).sum(axis=1)
    d = np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0) * (size[:, None] * size[None] / (size[:, None] + size[None]))
    np.fill_diagonal(d, np.inf)
    for _ in range(n - k):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        s = size[i] + size[j] + size
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / s
        new[~alive] = np.inf
        d[i], d[:, i], d[i, i] = new, new, np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.searchsorted(np.unique(label), label)


def _nearest_rows(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The number of the nearest row of near, in blocks of bounded size."""
    square = (near**2).sum(axis=1)
    return np.concatenate([(square[None] - 2 * x[a : a + 512] @ near.T).argmin(axis=1) for a in range(0, len(x), 512)])


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean, a row for each of x; few rows at a time, so that their differences stay small."""
    step = max(1, CELLS // max(centroids.size, 1))
    parts = [np.linalg.norm(x[a : a + step, None] - centroids[None], axis=2) for a in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(centroids)))


def nearest(x: Column, centroids: np.ndarray) -> Column:
    """struct(sense, distance): the nearest centroid in Euclidean distance."""

    @F.pandas_udf("struct<sense:int,distance:double>")
    def run(v: pd.Series) -> pd.DataFrame:
        d = distances(np.stack(v), centroids) if len(v) else np.zeros((0, len(centroids)))
        return pd.DataFrame({"sense": d.argmin(axis=1).astype(np.int32), "distance": d.min(axis=1)})

    return run(x)


def top_terms(df: DataFrame, by: str, text_col: str, n: int = 10, pattern: str = "[a-z][a-z-]{2,}") -> DataFrame:
    """(by, terms): each group's most frequent words, comma-joined."""
    words = df.select(by, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))).alias("t")).filter(~F.col("t").isin(sorted(STOP)))
    counts = words.groupBy(by, "t").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("c"), "t"))).filter(F.col("r") <= n)
    return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda s: s["t"]), ", ").alias("top_terms"))


@dataclass(frozen=True)
class SenseResult:
    """assignments: the rows with sense and x (the vector used); clusters: sense, size, share, top_terms."""

    assignments: DataFrame
    clusters: DataFrame
    centroids: np.ndarray
    k: int
    id_col: str

    def agreement_with(self, label_col: str) -> dict[str, float]:
        return agreement(self.assignments, "sense", label_col)

    def contingency(self, label_col: str) -> DataFrame:
        return self.assignments.groupBy(label_col).pivot("sense", list(range(self.k))).count().na.fill(0)

    def leakage_audit(self, label_col: str, k: int = 20) -> DataFrame:
        return leakage_audit(self.assignments, label_col, self.id_col, "x", k)

    def share_over_time(self, time_col: str, freq: str = "Y") -> DataFrame:
        """(period, period_label, sense, count, share); unreadable dates are left out."""
        u = unit_of(freq)
        period = F.date_trunc(u, F.try_to_timestamp(F.col(time_col).cast("string"))).cast("date")
        counts = self.assignments.withColumn("period", period).filter("period is not null").groupBy("period", "sense").agg(F.count("*").alias("count"))
        share = F.col("count") / F.sum("count").over(Window.partitionBy("period"))
        return counts.select("period", period_label(F.col("period"), u).alias("period_label"), "sense", "count", share.alias("share")).orderBy("period", "sense")


def induce_senses(
    df: DataFrame, embedding_col: str = "embedding", id_col: str = "doc_id", k: int | None = None, method: str = "kmeans", normalize: bool = True,
    random_state: int = 42, k_range: tuple[int, int] = (2, 10), text_col: str | None = None, restarts: int = 10,
) -> SenseResult:
    """Cluster the embeddings; without k the number with the best silhouette on a sample.

    Agglomerative clustering sees every row up to SAMPLE of them. Beyond, all rows are summed up as
    MICRO small clusters, which Ward's criterion joins by their sizes; a row goes with its small cluster.
    """
    if method not in ("kmeans", "agglomerative"):
        raise ValueError(f"unknown method {method!r}")
    if k is not None and k < 2:
        raise ValueError("there are at least two senses")
    e = F.col(embedding_col)
    bad = df.filter(e.isNull() | F.exists(e, lambda v: v.isNull() | F.isnan(v.cast("double")))).limit(1).count()
    if bad:
        raise ValueError("an embedding is missing or has NaN")
    rows = df.withColumn("x", unit(e) if normalize else F.transform(e, lambda v: v.cast("double")))
    total = rows.count()
    if total < (k or k_range[0]):
        raise ValueError("fewer rows than senses")
    # a fixed number of rows, in the order of a hash
    seen = rows.select(F.col(id_col).alias("id"), "x", F.xxhash64(id_col, F.lit(random_state)).alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    sample = np.stack(seen["x"])
    merge = method == "agglomerative"
    if merge and total > SAMPLE:
        micro = kmeans_centroids(rows, min(MICRO, total), random_state, 1)
        counts = rows.select(nearest(F.col("x"), micro)["sense"].alias("m")).groupBy("m").count().collect()
        weights = np.zeros(len(micro))
        for r in counts:
            weights[r["m"]] = r["count"]
        micro, weights = micro[weights > 0], weights[weights > 0]
    elif merge:
        micro, weights = sample, np.ones(len(sample))

    def fit(n: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Centroids, and in merging the sense of each small cluster."""
        if not merge:
            return kmeans_centroids(rows, n, random_state, restarts), None
        labels = ward(micro, n, weights)
        return np.stack([np.average(micro[labels == g], axis=0, weights=weights[labels == g]) for g in range(n)]), labels

    def senses_of(x: np.ndarray, c: np.ndarray, labels: np.ndarray | None) -> np.ndarray:
        near = c if labels is None else micro
        at = distances(x, near).argmin(axis=1) if len(near) <= 1000 else _nearest_rows(x, near)
        return at if labels is None else labels[at]

    if k is None:
        tried = {}
        for n in range(k_range[0], min(k_range[1], len(sample) - 1) + 1):
            c, own = fit(n)
            labels = senses_of(sample, c, own)
            tried[n] = (silhouette(sample, labels) if len(np.unique(labels)) == n else float("nan"), c, own)
        k = max(tried, key=lambda n: (-np.inf if np.isnan(tried[n][0]) else tried[n][0], -n))
        _, centroids, own = tried[k]
    else:
        centroids, own = fit(k)

    @F.pandas_udf("int")
    def sense(v: pd.Series) -> pd.Series:
        return pd.Series(senses_of(np.stack(v), centroids, own).astype(np.int32) if len(v) else np.empty(0, np.int32))

    got = written(rows.withColumn("sense", sense("x")))
    clusters = got.groupBy("sense").agg(F.count("*").alias("size")).withColumn("share", F.col("size") / float(total))
    if text_col:
        clusters = clusters.join(top_terms(got, "sense", text_col), "sense", "left")
    return SenseResult(got, clusters.orderBy("sense"), centroids, k, id_col)


def agreement_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari, homogeneity, completeness, v_measure, from the contingency table alone."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    n = F.col("n")
    whole = cells.agg(F.sum("n").alias("t"), F.sum(two(n)).alias("pairs"))
    side = lambda c, p: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias(f"{p}2"), F.sum(stats.xlogy(F.col("m"), F.col("m"))).alias(f"{p}l"))
    inner = cells.agg(F.sum(stats.xlogy(n, n)).alias("nl"))
    row = whole.crossJoin(side(a, "a")).crossJoin(side(b, "b")).crossJoin(inner)
    t = F.col("t")
    h_a, h_b = F.ln(t) - F.col("al") / t, F.ln(t) - F.col("bl") / t
    h_b_given_a, h_a_given_b = (F.col("al") - F.col("nl")) / t, (F.col("bl") - F.col("nl")) / t
    chance = F.col("a2") * F.col("b2") / F.nullif(two(t), F.lit(0.0))
    top, under = F.col("pairs") - chance, (F.col("a2") + F.col("b2")) / 2 - chance
    hom = F.when(h_b <= 1e-15, 1.0).otherwise(1 - h_b_given_a / F.when(h_b <= 1e-15, 1.0).otherwise(h_b))
    com = F.when(h_a <= 1e-15, 1.0).otherwise(1 - h_a_given_b / F.when(h_a <= 1e-15, 1.0).otherwise(h_a))
    out = row.select(F.when(F.abs(under) < 1e-15, 1.0).otherwise(top / F.when(F.abs(under) < 1e-15, 1.0).otherwise(under)).alias("ari"), hom.alias("homogeneity"), com.alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    return out.withColumn("v_measure", F.when(both <= 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / F.when(both <= 0, 1.0).otherwise(both)))


def agreement(df: DataFrame, a: str, b: str) -> dict[str, float]:
    return agreement_table(df, a, b).first().asDict()


def leakage_audit(df: DataFrame, label_col: str, id_col: str = "doc_id", vector_col: str = "embedding", k: int | None = 20) -> DataFrame:
    """(doc_id, reference_sense, nearest_other_sense, margin): rows nearer to another label's centroid, worst first."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("reference_sense"), F.transform(vector_col, lambda v: v.cast("double")).alias("x"))
    means = mean_vector(rows, ["reference_sense"], "x").select(F.col("reference_sense").alias("other"), "centroid")
    if means.limit(2).count() < 2:
        raise ValueError("at least two labels are needed")
    # as many rows as labels
    d = F.sqrt(F.aggregate(F.zip_with("x", "centroid", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    pairs = rows.crossJoin(F.broadcast(means)).select("doc_id", "reference_sense", "other", d.alias("d"))
    own = F.col("other") == F.col("reference_sense")
    best = pairs.groupBy("doc_id", "reference_sense").agg(
        F.min(F.when(own, F.col("d"))).alias("own"), F.min(F.when(~own, F.struct("d", "other"))).alias("rival")
    )
    margin = F.col("own") - F.col("rival.d")
    out = best.select("doc_id", "reference_sense", F.col("rival.other").alias("nearest_other_sense"), margin.alias("margin")).filter("margin > 0")
    out = out.orderBy(F.desc("margin"), "doc_id")
    return out if k is None else out.limit(k)


# drift


def jsd(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits, smoothed."""
    p, q = np.asarray(p, float) + 1e-12, np.asarray(q, float) + 1e-12
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2)


def control_threshold(values: Sequence[float], k_sigma: float, n: int, p: float) -> float:
    """Mean and so many deviations of the reference periods; with one period its binomial error."""
    v = np.asarray(values, float)
    if len(v) >= 2:
        return float(v.mean() + k_sigma * v.std(ddof=1))
    return float((v.mean() if len(v) else p) + k_sigma * np.sqrt(p * (1 - p) / max(n, 1)))


def _upper(values: Sequence[float], share: float) -> float:
    """A percentile, or infinity of nothing."""
    return float(np.quantile(values, share / 100)) if len(values) else float("inf")


def sustained(raw: Sequence[bool], least: int) -> list[bool]:
    """Only runs of at least so many."""
    out, run = [False] * len(raw), []
    for i, r in enumerate([*raw, False]):
        if r:
            run.append(i)
        else:
            if len(run) >= least:
                for j in run:
                    out[j] = True
            run = []
    return out


def distinctive_terms(df: DataFrame, novel: str, text_col: str = "text", top: int = 12) -> list[str]:
    """Words by the log-ratio of their document frequencies where novel is true and where not."""
    words = df.select(novel, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z][a-z-]{3,}"), F.lit(0)))).alias("t")).filter(~F.col("t").isin(sorted(STOP)))
    sizes = df.agg(F.sum(F.col(novel).cast("double")).alias("a"), F.sum((~F.col(novel)).cast("double")).alias("b"))
    counts = words.groupBy("t").agg(F.sum(F.col(novel).cast("double")).alias("x"), F.sum((~F.col(novel)).cast("double")).alias("y")).filter("x >= 2")
    score = F.log2(((F.col("x") + 0.5) / (F.col("a") + 1)) / ((F.col("y") + 0.5) / (F.col("b") + 1)))
    return [r["t"] for r in counts.crossJoin(F.broadcast(sizes)).withColumn("s", score).orderBy(F.desc("s"), "t").limit(top).collect()]


@dataclass(frozen=True)
class DriftResult:
    """table: period, n, margin_density, jsd, drift; records: the rows with nearest_sense, novelty, novel."""

    table: pd.DataFrame
    records: DataFrame
    reference: tuple
    k: int
    threshold: float
    p_value: float | None
    change_type: str | None
    drift_terms: list[str] = field(default_factory=list)

    def flagged_records(self) -> DataFrame:
        return self.records.filter("novel").orderBy(F.desc("novelty"))

    def exemplars(self, n: int = 5) -> DataFrame:
        return self.flagged_records().limit(n)

    def composition(self) -> DataFrame:
        """(period, sense, n, share); sense -1 is the novel part."""
        sense = F.when(F.col("novel"), -1).otherwise(F.col("nearest_sense"))
        counts = self.records.groupBy("period", sense.alias("sense")).agg(F.count("*").alias("n"))
        return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period"))).orderBy("period", "sense")

    def sense_trajectories(self) -> DataFrame:
        """(period, sense, n, share) of the nearest senses, every sense in every period."""
        spark = self.records.sparkSession
        grid = self.records.select("period").distinct().crossJoin(F.broadcast(spark.range(self.k).select(F.col("id").cast("int").alias("sense"))))
        counts = self.records.groupBy("period", F.col("nearest_sense").alias("sense")).agg(F.count("*").alias("n"))
        full = grid.join(counts, ["period", "sense"], "left").na.fill(0, ["n"])
        return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period"))).orderBy("period", "sense")

    def decline_report(self, min_share: float = 0.05, rel_change: float = 0.3, late_periods: int = 3) -> DataFrame:
        """(sense, early_share, late_share, early_count, late_count, rel_share_change, verdict), steepest fall first."""
        rows = written(self.sense_trajectories())
        known = F.col("period").isin(list(self.reference))
        late = [r["period"] for r in rows.filter(~known).select("period").distinct().orderBy(F.desc("period")).limit(late_periods).collect()]
        last = F.col("period").isin(late)
        avg = lambda c, when: F.avg(F.when(when, F.col(c)))
        per = rows.groupBy("sense").agg(avg("share", known).alias("early_share"), avg("share", last).alias("late_share"), avg("n", known).alias("early_count"), avg("n", last).alias("late_count"))
        rel = F.when(F.col("early_share") > 0, (F.col("late_share") - F.col("early_share")) / F.when(F.col("early_share") > 0, F.col("early_share")).otherwise(1.0)).otherwise(0.0)
        per = per.withColumn("rel_share_change", rel)
        fallen = F.when(F.col("late_count") < F.col("early_count") * (1 - rel_change), "obsolescence").otherwise("dilution")
        verdict = F.when(F.col("early_share") < min_share, "minor").when(F.col("rel_share_change") <= -rel_change, fallen).when(F.col("rel_share_change") >= rel_change, "rising").otherwise("stable")
        return per.withColumn("verdict", verdict).orderBy("rel_share_change")

    def name_senses(self, annotator, n_examples: int = 8, text_col: str = "text", include_novel: bool = True) -> pd.DataFrame:
        return name_senses(self, annotator, n_examples, text_col, include_novel)


def _vectors(df: DataFrame, embedding_col: str, time_col: str, normalize: bool, background: DataFrame | None) -> DataFrame:
    e = F.col(embedding_col)
    if df.filter(e.isNull() | F.exists(e, lambda v: v.isNull() | F.isnan(v.cast("double")))).limit(1).count():
        raise ValueError("an embedding is missing or has NaN")
    rows = df.withColumn("period", F.col(time_col)).withColumn("x", F.transform(e, lambda v: v.cast("double")))
    if background is not None:
        # how the whole language moved: each period's mean, from that of all periods
        own = background.select(F.col(time_col).alias("period"), F.transform(embedding_col, lambda v: v.cast("double")).alias("v"))
        whole = mean_vector(own.withColumn("one", F.lit(1)), ["one"], "v").select(F.col("centroid").alias("w"))
        shift = mean_vector(own, ["period"], "v").crossJoin(F.broadcast(whole)).select("period", F.zip_with("centroid", "w", lambda p, q: p - q).alias("shift"))
        rows = rows.join(F.broadcast(shift), "period", "left").withColumn("x", F.when(F.col("shift").isNull(), F.col("x")).otherwise(F.zip_with("x", "shift", lambda p, q: p - q))).drop("shift")
    return rows.withColumn("x", unit(F.col("x"))) if normalize else rows


def _tied_inverse(ref: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of the pooled scatter around the nearest centroids; sums of outer products by partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = centroids.shape[1]
        total, n = np.zeros((d, d)), 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"])
                own = centroids[distances(x, centroids).argmin(axis=1)]
                total += (x - own).T @ (x - own)
                n += len(x)
        yield pd.DataFrame({"m": [total.ravel().tolist()], "n": [n]})

    parts = ref.select("x").mapInPandas(run, "m array<double>, n long").collect()
    d = centroids.shape[1]
    return np.linalg.pinv(sum(np.array(p["m"]) for p in parts).reshape(d, d) / max(1, sum(p["n"] for p in parts)) + 1e-6 * np.eye(d))


def _scored(rows: DataFrame, is_ref: Column, k: int, novelty: str, cutoff_pctile: float, seed: int, restarts: int = 10) -> tuple[DataFrame, np.ndarray]:
    ref = rows.filter(is_ref)
    centroids = kmeans_centroids(ref, k, seed, restarts)
    inverse = _tied_inverse(ref, centroids) if novelty == "mahalanobis" else None

    @F.pandas_udf("struct<nearest_sense:int,novelty:double>")
    def run(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v)
        if inverse is None:
            sims = x @ centroids.T
            return pd.DataFrame({"nearest_sense": sims.argmax(axis=1).astype(np.int32), "novelty": 1 - sims.max(axis=1)})
        diff = x[:, None] - centroids[None]
        d = np.sqrt(np.maximum(np.einsum("nkd,de,nke->nk", diff, inverse, diff), 0))
        return pd.DataFrame({"nearest_sense": d.argmin(axis=1).astype(np.int32), "novelty": d.min(axis=1)})

    got = written(rows.withColumn("_s", run(F.col("x"))).select(*rows.columns, "_s.*"))
    cutoff = got.filter(is_ref).agg(F.percentile("novelty", cutoff_pctile / 100)).first()[0]
    return got.withColumn("novel", F.col("novelty") > cutoff), centroids


def _distributions(scored: DataFrame, k: int) -> dict:
    sense = F.when(F.col("novel"), k).otherwise(F.col("nearest_sense"))
    out: dict = {}
    for r in scored.filter("period is not null").groupBy("period", sense.alias("s")).count().collect():
        out.setdefault(r["period"], np.zeros(k + 1))[r["s"]] += r["count"]
    return dict(sorted(out.items()))


def numbered_rows(rows: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """(rows with index, a number for each id; how many ids): what all shuffles of the periods share."""
    return written(rows.join(dense_index(rows, id_col), id_col)), rows.select(id_col).distinct().count()


def shuffled_periods(rows: DataFrame, id_col: str, seed: int, numbered: tuple[DataFrame, int] | None = None) -> DataFrame:
    """rows with the periods of other rows, each used once: a keyed permutation of their numbers. A table, as it is read again and again."""
    known, n = numbered or numbered_rows(rows, id_col)

    @F.pandas_udf("long")
    def moved(i: pd.Series) -> pd.Series:
        return pd.Series(keyed_permutation(i.to_numpy(), n, seed))

    given = known.select(moved("index").alias("index"), "period")
    return written(known.drop("period").join(given, "index").drop("index"))


def sense_drift(
    df: DataFrame, time_col: str, reference: Sequence, embedding_col: str = "embedding", id_col: str = "doc_id", text_col: str | None = None, k: int = 3,
    novelty: str = "mahalanobis", cutoff_pctile: float = 95, k_sigma: float = 3, min_run: int = 2, n_permutations: int = 0, null_pctile: float = 95,
    normalize: bool = True, background: DataFrame | None = None, random_state: int = 42, restarts: int = 10,
) -> DriftResult:
    """Which periods depart from the senses of the reference periods, and how."""
    if novelty not in ("mahalanobis", "cosine"):
        raise ValueError(f"unknown novelty {novelty!r}")
    known = tuple(reference)
    rows = written(_vectors(df, embedding_col, time_col, normalize, background))
    is_ref = F.col("period").isin(list(known))
    n_ref = rows.filter(is_ref).count()
    if n_ref < 5 * k:
        raise ValueError(f"the reference has {n_ref} records; {5 * k} are needed for {k} senses")
    scored, _ = _scored(rows, is_ref, k, novelty, cutoff_pctile, random_state, restarts)
    dist = _distributions(scored, k)
    base = sum((v for p, v in dist.items() if p in known), np.zeros(k + 1))
    md = {p: v[k] / v.sum() for p, v in dist.items()}
    div = {p: jsd(v, base) for p, v in dist.items()}
    others = [p for p in dist if p not in known]
    p_value = None
    if n_permutations:
        pools: tuple[list, list, list] = ([], [], [])
        numbered = numbered_rows(rows.select(id_col, "period", "x"), id_col)

        def permuted(i: int) -> dict | None:
            mixed = shuffled_periods(rows, id_col, random_state * 7919 + i, numbered)
            if mixed.filter(is_ref).count() < 5 * k:
                return None
            return _distributions(_scored(mixed, is_ref, k, novelty, cutoff_pctile, random_state, 1)[0], k)

        for d in filter(None, beside(permuted, n_permutations)):
            b = sum((v for p, v in d.items() if p in known), np.zeros(k + 1))
            own = [v[k] / v.sum() for p, v in d.items() if p not in known]
            pools[0].extend(own)
            pools[1].extend(jsd(v, b) for p, v in d.items() if p not in known)
            if own:
                pools[2].append(max(own))
        md_limit = _upper(pools[0], null_pctile)
        jsd_limit = _upper(pools[1], null_pctile)
        if pools[2]:
            p_value = (sum(m >= max((md[p] for p in others), default=0.0) for m in pools[2]) + 1) / (len(pools[2]) + 1)
    else:
        md_limit = control_threshold([md[p] for p in dist if p in known], k_sigma, n_ref, base[k] / max(base.sum(), 1))
        seen = [div[p] for p in dist if p in known]
        jsd_limit = float(np.mean(seen) + k_sigma * np.std(seen, ddof=1)) if len(seen) >= 2 else np.inf
    raw = [(md[p] > md_limit or div[p] > jsd_limit) and p not in known for p in dist]
    table = pd.DataFrame({"period": list(dist), "n": [int(v.sum()) for v in dist.values()], "margin_density": list(md.values()), "jsd": list(div.values()), "drift": sustained(raw, min_run)})
    flagged = table.loc[table["drift"], "period"].tolist()
    kind, terms = None, []
    if flagged:
        now = sum((dist[p] for p in flagged), np.zeros(k + 1))
        p, q = now / now.sum(), base / max(base.sum(), 1)
        novel = scored.filter(F.col("novel") & F.col("period").isin(flagged))
        # mean cosine to the normalised mean = length of the mean of unit vectors
        center = mean_vector(novel.withColumn("one", F.lit(1)), ["one"], "x").first()
        tight = center is not None and center["n"] >= 5 and float(np.linalg.norm(center["centroid"])) >= 0.5
        grown, moved = p[k] - q[k], float(np.abs(p[:k] - q[:k]).sum())
        kind = "emergence" if grown >= 0.05 and tight else "frequency_shift" if moved >= 0.1 and grown < 0.05 else "broadening"
        if text_col:
            both = novel.select(text_col, F.lit(True).alias("new")).unionByName(scored.filter(is_ref).select(text_col, F.lit(False).alias("new")))
            terms = distinctive_terms(both, "new", text_col)
    return DriftResult(table, scored, known, k, md_limit, p_value, kind, terms)


# nearest neighbours


def knn_index(prior: DataFrame, cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Centroids of cells for a search: k-means on at most INDEX_SAMPLE rows (id, x), in the order of a hash."""
    n = prior.count()
    cells = cells or max(1, min(INDEX_CELLS, int(np.sqrt(n) / 2)))
    sample = prior.select("x", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(INDEX_SAMPLE)
    return kmeans_centroids(sample, min(cells, n), seed, 1)


def knn_novelty(
    queries: DataFrame, prior: DataFrame, k: int = 10, earlier_only: bool = False, block: int | None = None, index: np.ndarray | None = None, probes: int = 8
) -> DataFrame:
    """(id, novelty): 1 - mean cosine to the k nearest rows of prior; never the row itself.

    Both are (id, period, x) with unit vectors. Queries and priors meet block by block, so a task holds
    one block of each; only the k best of each block go on. A row is shuffled once for each block of the
    other side: blocks grow with the input, up to FULL_BLOCK rows, and likenesses are computed in pieces. With earlier_only, prior rows must be of an
    earlier period; a query without any scores 0.

    Without an index every query meets every prior row: exact, and work as the product of both. With one
    (knn_index) each prior row is in its nearest cell, and a query looks into the `probes` nearest cells.
    """
    kind = queries.schema["id"].dataType.simpleString()
    if index is None:
        q, p = (df.select(*[F.col(c).alias(c) for c in ("id", "period", "x")], F.lit(0).alias("cell")) for df in (queries, prior))
    else:
        probes = min(probes, len(index))
        square = (index**2).sum(axis=1)

        def cells(n: int):
            @F.pandas_udf("array<int>")
            def run(v: pd.Series) -> pd.Series:
                d = square[None] - 2 * np.stack(v) @ index.T
                return pd.Series(list(np.argpartition(d, min(n, d.shape[1] - 1), axis=1)[:, :n].astype(np.int32)))

            return run("x")

        q = written(queries.select("id", "period", "x", F.explode(cells(probes)).alias("cell")))
        p = written(prior.select("id", "period", "x", F.explode(cells(1)).alias("cell")))
    # as many numbers as cells: a full cell is cut to blocks
    def blocks(df: DataFrame) -> dict:
        size = lambda n: block or min(FULL_BLOCK, max(BLOCK, -(-n // BLOCKS)))
        return {r["cell"]: -(-r["count"] // size(r["count"])) for r in df.groupBy("cell").count().collect()}

    of_q, of_p = blocks(q), blocks(p)
    listed = [(c, of_q.get(c, 1), of_p.get(c, 1)) for c in sorted({0, *of_q, *of_p})]
    sizes = F.broadcast(queries.sparkSession.createDataFrame(listed, "cell int, n_q int, n_p int"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q = q.join(sizes, "cell").select(*[F.col(c).alias(c) for c in ("id", "period", "x", "cell")], part("n_q").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("n_p") - 1)).alias("pb"))
    p = p.join(sizes, "cell").select(*[F.col(c).alias(c) for c in ("id", "period", "x", "cell")], part("n_p").alias("pb"), F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("qb"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"], "best": pd.Series([[] for _ in range(len(a))], index=a.index, dtype=object)})
        x, y = (np.stack(df.pop("x")) for df in (a, b))
        ids, others = a["id"].to_numpy(), b["id"].to_numpy()
        when, before = (a["period"].to_numpy(), b["period"].to_numpy()) if earlier_only else (None, None)
        step, wide = 512, max(k, CELLS // 512)
        out = []
        for i in range(0, len(x), step):
            best = np.empty((len(x[i : i + step]), 0))
            for j in range(0, len(y), wide):
                sims = x[i : i + step] @ y[j : j + wide].T
                sims[ids[i : i + step, None] == others[None, j : j + wide]] = -np.inf
                if earlier_only:
                    sims[~(before[None, j : j + wide] < when[i : i + step, None])] = -np.inf
                if sims.shape[1] > k:
                    sims = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k:]
                best = np.concatenate([best, sims], axis=1)
                if best.shape[1] > k:
                    best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
            out.extend(r[np.isfinite(r)].tolist() for r in -np.sort(-best, axis=1))
        return pd.DataFrame({"id": ids, "best": pd.Series(out, dtype=object)})

    keys = ["cell", "qb", "pb"]
    met = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(run, f"id {kind}, best array<double>")
    top = met.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best"))
    mean = F.aggregate("best", F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("best"), F.lit(0))
    return top.select("id", F.coalesce(1 - mean, F.lit(0.0)).alias("novelty"))


def knn_density_drift(
    df: DataFrame, time_col: str, reference: Sequence, embedding_col: str = "embedding", id_col: str = "doc_id", k: int = 10, mode: str = "reference",
    cutoff_pctile: float = 95, k_sigma: float = 3, min_run: int = 2, n_permutations: int = 0, null_pctile: float = 95, normalize: bool = True,
    background: DataFrame | None = None, random_state: int = 42, indexed: bool = False,
) -> DriftResult:
    """Periods whose records are far from their nearest neighbours in the reference, or in all earlier periods.

    indexed: neighbours are sought in the nearest cells of an index instead of among all rows.
    """
    if mode not in ("reference", "cumulative"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "cumulative" and n_permutations:
        raise ValueError("permutations go with the reference mode only")
    known = tuple(reference)
    rows = _vectors(df, embedding_col, time_col, normalize, background)
    rows = written(rows.select(F.col(id_col).alias("id"), "period", "x", *[c for c in rows.columns if c not in ("id", "period", "x")]))
    is_ref = F.col("period").isin(list(known))
    need = max(k + 1, 5)

    def score(table: DataFrame, how: str) -> tuple[DataFrame, int]:
        ref = table.filter(is_ref)
        n = ref.count()
        if n < need:
            raise ValueError(f"the reference has {n} records; {need} are needed")
        inside = knn_index(ref, seed=random_state) if indexed else None
        inner = written(knn_novelty(ref, ref, k, index=inside))
        cutoff = inner.agg(F.percentile("novelty", cutoff_pctile / 100)).first()[0]
        if how == "reference":
            found = inner.unionByName(knn_novelty(table.filter(~is_ref), ref, k, index=inside))
        else:
            found = knn_novelty(table, table, k, earlier_only=True, index=knn_index(table, seed=random_state) if indexed else None)
        return written(table.join(found, "id").withColumn("novel", F.col("novelty") > cutoff)), n

    def density(table: DataFrame) -> dict:
        got = table.filter("period is not null").groupBy("period").agg(F.count("*").alias("n"), F.avg(F.col("novel").cast("double")).alias("d")).orderBy("period").collect()
        return {r["period"]: (r["n"], r["d"]) for r in got}

    scored, n_ref = score(rows, mode)
    dens = density(scored)
    p_value = None
    if n_permutations:
        pool, most = [], []
        numbered = numbered_rows(rows.select("id", "period", "x"), "id")
        for i in range(n_permutations):
            mixed = shuffled_periods(rows, "id", random_state * 7919 + i, numbered)
            if mixed.filter(is_ref).count() < need:
                continue
            own = [d for p, (_, d) in density(score(mixed, "reference")[0]).items() if p not in known]
            pool += own
            most += [max(own)] if own else []
        limit = _upper(pool, null_pctile)
        if most:
            real = max((d for p, (_, d) in dens.items() if p not in known), default=0.0)
            p_value = (sum(m >= real for m in most) + 1) / (len(most) + 1)
    else:
        share = scored.filter(is_ref).agg(F.avg(F.col("novel").cast("double"))).first()[0]
        limit = control_threshold([d for p, (_, d) in dens.items() if p in known], k_sigma, n_ref, share)
    raw = [d > limit and p not in known for p, (_, d) in dens.items()]
    table = pd.DataFrame({"period": list(dens), "n": [n for n, _ in dens.values()], "novelty_density": [d for _, d in dens.values()], "drift": sustained(raw, min_run)})
    return DriftResult(table, scored, known, 0, limit, p_value, None)


# names


@dataclass(frozen=True)
class EchoAnnotator:
    """Answers with a label made from the prompt's hash; for tests and dry runs."""

    model_id: str = "echo"

    def __call__(self, prompt: str) -> str:
        return json.dumps({"label": "sense-" + hashlib.sha256(prompt.encode()).hexdigest()[:8], "gloss": prompt.splitlines()[0][:80]})


def label_and_gloss(answer: str) -> tuple[str, str]:
    """From JSON somewhere in the answer, or else from its first line."""
    m = re.search(r"\{.*\}", answer, re.S)
    if m:
        try:
            got = json.loads(m[0])
            return str(got.get("label", "")).strip(), str(got.get("gloss", "")).strip()
        except ValueError:
            pass
    first = (answer.strip().splitlines() or [""])[0]
    return first[:80], answer.strip()


def name_senses(result: DriftResult, annotator, n_examples: int = 8, text_col: str = "text", include_novel: bool = True, cache: dict[str, str] | None = None) -> pd.DataFrame:
    """(sense, kind, label, gloss, terms, n, n_cited, prompt_sha256): one call for each sense, over cited examples only."""
    cache = {} if cache is None else cache
    groups = [(c, "sense", (F.col("nearest_sense") == c) & ~F.col("novel")) for c in range(result.k)]
    if include_novel:
        groups.append((-1, "novel", F.col("novel")))
    out = []
    for sense, kind, which in groups:
        own = result.records.filter(which)
        cited = [r[0] for r in own.orderBy(F.asc("novelty") if kind == "sense" else F.desc("novelty")).limit(n_examples).select(F.substring(text_col, 1, 300)).collect()]
        terms = top_terms(own.withColumn("g", F.lit(1)), "g", text_col).first()
        terms = terms["top_terms"] if terms else ""
        prompt = f"Name this {kind} in a few words. Answer in JSON with label and gloss.\nTerms: {terms}\n" + "\n".join(f"- {t}" for t in cited)
        key = hashlib.sha256(prompt.encode()).hexdigest()
        if key not in cache:
            cache[key] = annotator(prompt)
        label, gloss = label_and_gloss(cache[key])
        out.append((sense, kind, label, gloss, terms, own.count(), len(cited), key))
    return pd.DataFrame(out, columns=["sense", "kind", "label", "gloss", "terms", "n", "n_cited", "prompt_sha256"])
