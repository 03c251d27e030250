"""The tables behind the usual plots; drawing is left to any plotting library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import positions
from corpuscle.operators.corpus import Corpus
from corpuscle.operators.keyness import side_counts
from corpuscle.plans.storage import ranged, running


def volcano(keyness: DataFrame) -> DataFrame:
    """(term, log_ratio, minus_log10_p)."""
    return keyness.select("term", "log_ratio", (-F.log10(F.greatest(F.col("p_value"), F.lit(1e-300)))).alias("minus_log10_p"))


def bar(keyness: DataFrame, n: int = 20, score: str = "g2") -> DataFrame:
    """The n strongest terms of either side."""
    up = keyness.filter(F.col(score) > 0).orderBy(F.desc(score), "term").limit(n).withColumn("side", F.lit("a"))
    return up.unionByName(keyness.filter(F.col(score) < 0).orderBy(score, "term").limit(n).withColumn("side", F.lit("b")))


def percent_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rank as a share of the rows, ties at their mean; ranks come from a table of different values."""
    values = ranged(df.groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_k")), "_v")
    up = running(values, "_v", "sum", "_k", "_up").crossJoin(F.broadcast(values.agg(F.sum("_k").alias("_all"))))
    ranked = up.select("_v", ((F.col("_up") - (F.col("_k") - 1) / 2) / F.col("_all")).alias(out))
    return df.join(ranked, F.col(col) == F.col("_v")).drop("_v")


def scattertext(a: Corpus, b: Corpus, min_count: int = 5) -> DataFrame:
    """(term, count_a, count_b, x, y, score): percentiles of the counts on either side."""
    counts = side_counts(a, b).filter(F.col("count_a") + F.col("count_b") >= min_count)
    both = percent_rank(percent_rank(counts, "count_a", "x"), "count_b", "y")
    return both.select("term", "count_a", "count_b", "x", "y", (F.col("x") - F.col("y")).alias("score"))


def dispersion_ticks(corpus: Corpus, targets: Sequence[str]) -> DataFrame:
    """(doc_id, target, position, share of the text before it)."""
    key = corpus.need_id("a dispersion plot")
    rows = corpus.token_lists(key).select(F.col(key).alias("doc_id"), "tokens", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    rows = rows.select("doc_id", "target", F.size("tokens").alias("n"), F.explode(positions(F.col("tokens"), F.col("target"))).alias("at"))
    return rows.select("doc_id", "target", (F.col("at") - 1).alias("position"), ((F.col("at") - 1) / F.col("n")).alias("share"))


def network_layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, weight, x1, y1, x2, y2): nodes on a circle in order of their counts."""
    import math

    n = nodes.count()
    at = Window.orderBy(F.desc("count"), "term")
    angle = (F.row_number().over(at) - 1) * (2 * math.pi / max(n, 1))
    placed = nodes.select("term", F.cos(angle).alias("x"), F.sin(angle).alias("y"))
    ends = [placed.select(F.col("term").alias(k), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i, k in ((1, "source"), (2, "target"))]
    return edges.join(F.broadcast(ends[0]), "source").join(F.broadcast(ends[1]), "target").select("source", "target", "weight", "x1", "y1", "x2", "y2")


def share_pivot(df: DataFrame, time: str, group: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts by time and group, a column for each group, zero where there are none."""
    return df.groupBy(time).pivot(group, list(values) if values else None).count().na.fill(0).orderBy(time)


def decades(df: DataFrame, year: str, group: str) -> DataFrame:
    """(decade, group, n, share)."""
    counts = df.groupBy((F.floor(F.col(year) / 10) * 10).cast("int").alias("decade"), group).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("decade"))).orderBy("decade", group)


def crossover(df: DataFrame, year: str, term: str, value: str, old: str, new: str) -> DataFrame:
    """One row: the first year in which new exceeds old, and whether it still does in the last year."""
    wide = df.groupBy(year).agg(F.sum(F.when(F.col(term) == old, F.col(value)).otherwise(0)).alias("old"), F.sum(F.when(F.col(term) == new, F.col(value)).otherwise(0)).alias("new"))
    return wide.agg(F.min(F.when(F.col("new") > F.col("old"), F.col(year))).alias("crossover"), F.max_by(F.col("new") >= F.col("old"), F.col(year)).alias("held"))


def ngram_long(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(ngram, year, frequency) from a column a year."""
    return df.unpivot([id_col], list(columns), "year", "frequency").select(F.col(id_col).alias("ngram"), F.col("year").cast("int").alias("year"), "frequency")


def cube(df: DataFrame, by: Sequence[str], **aggregates) -> DataFrame:
    """The aggregates by every subset of the groupings, null where a grouping is left out; level: how many are."""
    level = sum((F.grouping(c) for c in by[1:]), F.grouping(by[0]))
    return df.cube(*by).agg(*[a.alias(n) for n, a in aggregates.items()], level.cast("long").alias("level"))
