"""Coarsened exact matching: both sides get the same mix of covariates before they are compared."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from corpuscle.operators.corpus import Corpus

BINS = 5


@dataclass(frozen=True)
class MatchResult:
    """The matched corpora; strata: stratum, n_a_pre, n_b_pre, n_kept, matched; imbalance: covariate, l1_pre, l1_post."""

    a: Corpus
    b: Corpus
    strata: DataFrame
    imbalance: DataFrame


def quantile_edges(df: DataFrame, col: str, bins: int = BINS) -> list[float]:
    """Different quantiles of the pooled values; of a constant a narrow bin around it."""
    got = df.agg(F.percentile(F.col(f"`{col}`").cast("double"), [i / bins for i in range(bins + 1)])).first()[0]
    edges = sorted(set(got))
    return edges if len(edges) > 1 else [edges[0] - 1e-9, edges[0] + 1e-9]


def binned(c: Column, edges: Sequence[float]) -> Column:
    """The number of the bin, closed on the right, the first on both sides; "nan" outside them all."""
    c = c.cast("double")
    out = F.when((c < edges[0]) | (c > edges[-1]), "nan")
    for i, edge in enumerate(edges[1:]):
        out = out.when(c <= edge, str(i))
    return out.otherwise("nan")


def l1_imbalance(both: DataFrame, stratum: str) -> DataFrame:
    """One row, l1: half the differences of the sides' shares; 1 if a side is empty. both: side, and the stratum."""
    cells = both.groupBy(stratum).agg(F.sum((F.col("side") == 0).cast("double")).alias("a"), F.sum((F.col("side") == 1).cast("double")).alias("b"))
    sums = cells.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    share = cells.crossJoin(F.broadcast(sums))
    diff = F.sum(F.abs(F.col("a") / F.nullif("na", F.lit(0.0)) - F.col("b") / F.nullif("nb", F.lit(0.0)))) / 2
    return share.agg(F.coalesce(diff, F.lit(1.0)).alias("l1"))


def match(
    a: Corpus, b: Corpus, on: Sequence[str], cuts: Mapping[str, Sequence[float]] | None = None, seed: int = 0, subsample: bool = True
) -> MatchResult:
    """Documents of the strata that both sides have; with subsample as many of each side as the smaller has.

    Rows with a null covariate are left out. The draw follows a hash of the id and the seed, so it does
    not depend on the partitioning.
    """
    if not on:
        raise ValueError("give at least one covariate")
    cuts = dict(cuts or {})
    for side in (a, b):
        for c in on:
            if c not in side.df.columns:
                raise ValueError(f"no covariate {c!r} in {side.label}")
    a.need_id("matching")
    b.need_id("matching")
    sides = []
    for s, side in enumerate((a, b)):
        known = side.df
        for c in on:
            known = known.filter(F.col(f"`{c}`").isNotNull())
        sides.append(known.select(F.lit(s).alias("side"), F.col(side.id_col).alias("_id"), *[F.col(f"`{c}`") for c in on]))
    both = sides[0].unionByName(sides[1])
    bins = []
    for c in on:
        if c in cuts or isinstance(both.schema[c].dataType, NumericType):
            edges = sorted(cuts[c]) if c in cuts else quantile_edges(both, c)
            bins.append(binned(F.col(f"`{c}`"), edges).alias(f"_bin_{c}"))
        else:
            bins.append(F.col(f"`{c}`").cast("string").alias(f"_bin_{c}"))
    both = both.select("side", "_id", *bins).withColumn("stratum", F.concat_ws("|", *[f"_bin_{c}" for c in on]))
    strata = both.groupBy("stratum").agg(F.sum((F.col("side") == 0).cast("long")).alias("n_a_pre"), F.sum((F.col("side") == 1).cast("long")).alias("n_b_pre"))
    k = F.least("n_a_pre", "n_b_pre")
    strata = strata.withColumn("matched", k > 0)
    strata = strata.select("stratum", "n_a_pre", "n_b_pre", F.when(F.col("matched"), 2 * k if subsample else F.col("n_a_pre") + F.col("n_b_pre")).otherwise(0).alias("n_kept"), "matched")
    if strata.filter("matched").limit(1).count() == 0:
        raise ValueError("the sides share no stratum")
    kept = both.join(strata.filter("matched").withColumn("k", F.least("n_a_pre", "n_b_pre")).select("stratum", "k"), "stratum")
    if subsample:
        order = Window.partitionBy("side", "stratum").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_id").cast("string"))), "_id")
        kept = kept.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("k"))
    out = []
    for s, side in enumerate((a, b)):
        ids = kept.filter(F.col("side") == s).select("_id")
        out.append(replace(side, df=side.df.join(ids, F.col(f"`{side.id_col}`") == F.col("_id"), "left_semi")))
    table = None
    for c in [*on, None]:
        col = f"_bin_{c}" if c else "stratum"
        pre, post = l1_imbalance(both, col), l1_imbalance(kept, col)
        row = pre.withColumnRenamed("l1", "l1_pre").crossJoin(post.withColumnRenamed("l1", "l1_post")).select(F.lit(c or "(joint)").alias("covariate"), "l1_pre", "l1_post")
        table = row if table is None else table.unionByName(row)
    return MatchResult(out[0], out[1], strata.orderBy("stratum"), table)
