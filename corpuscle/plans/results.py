"""Results: a lazy table with its parameters, and the ways out of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.collocation import kwic, kwic_compare
from corpuscle.operators.corpus import Corpus


def to_html(df: DataFrame, path: str | None = None, limit: int | None = None, **options: Any) -> str:
    """All rows, or with a limit so many; the text passes through the driver."""
    text = (df if limit is None else df.limit(limit)).toPandas().to_html(**options)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def to_json(df: DataFrame, path: str | None = None, limit: int | None = None) -> str:
    """A JSON array of records: all rows, or with a limit so many; the text passes through the driver."""
    text = "[" + ",".join((df if limit is None else df.limit(limit)).toJSON().collect()) + "]"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


@dataclass(frozen=True)
class Result:
    """table: the rows; sides: the corpora they come from, for evidence."""

    table: DataFrame
    params: dict[str, Any] = field(default_factory=dict)
    sides: tuple[Corpus, ...] = ()

    def to_df(self) -> DataFrame:
        return self.table

    def to_pandas(self):
        return self.table.toPandas()

    def to_polars(self):
        import polars

        return polars.from_arrow(self.table.toArrow())

    def to_html(self, path: str | None = None, **options: Any) -> str:
        return to_html(self.table, path, **options)

    def to_json(self, path: str | None = None, limit: int | None = None) -> str:
        return to_json(self.table, path, limit)

    def write_parquet(self, path: str, mode: str = "error") -> None:
        self.table.write.mode(mode).parquet(path)

    def summary(self, n: int = 10) -> str:
        shown = ", ".join(f"{k}={v}" for k, v in self.params.items())
        return f"{type(self).__name__}({shown})\n" + self.table.limit(n).toPandas().to_string(index=False)

    def explain(self, term: str, n: int = 5, window: int = 5, collocate: str | None = None) -> DataFrame:
        """Lines of the corpora in which the term stands."""
        if not self.sides:
            raise ValueError("the corpora are not at hand")
        if len(self.sides) == 1:
            return kwic(self.sides[0], term, window, n, collocate=collocate)
        return kwic_compare(self.sides[0], self.sides[1], term, window, n, collocate)


class KeynessResult(Result):
    def top(self, n: int = 20, side: str | None = None) -> DataFrame:
        """The strongest terms, of one side if it is named."""
        score = F.col(self.params.get("score", "g2"))
        table = self.table if side is None else self.table.filter(score > 0 if side == "a" else score < 0)
        return table.orderBy(F.desc(F.abs(score)), "term").limit(n)


class CollocationShiftResult(Result):
    def explain(self, collocate: str, n: int = 5, window: int | None = None) -> DataFrame:  # type: ignore[override]
        return super().explain(self.params["target"], n, window or self.params["window"], collocate)


class SemanticShiftResult(Result):
    def neighbors(self, target: str, k: int = 10, **options: Any) -> DataFrame:
        from corpuscle.operators.semantic import neighborhood_drift

        if len(self.sides) != 2:
            raise ValueError("the corpora are not at hand")
        return neighborhood_drift(*self.sides, target, k, self.params.get("embedder"), **options)

    def neighbors_before(self, target: str, k: int = 10, **options: Any) -> DataFrame:
        found = self.neighbors(target, k, **options)
        return found.filter("rank_a is not null").select("neighbor", F.col("sim_a").alias("similarity"), F.col("rank_a").alias("rank")).orderBy("rank")

    def neighbors_after(self, target: str, k: int = 10, **options: Any) -> DataFrame:
        found = self.neighbors(target, k, **options)
        return found.filter("rank_b is not null").select("neighbor", F.col("sim_b").alias("similarity"), F.col("rank_b").alias("rank")).orderBy("rank")


@dataclass(frozen=True)
class NetworkResult:
    nodes: DataFrame
    edges: DataFrame
    params: dict[str, Any] = field(default_factory=dict)

    def to_df(self) -> DataFrame:
        return self.edges

    def to_html(self, path: str | None = None, **options: Any) -> str:
        return to_html(self.edges, path, **options)

    def to_json(self, path: str | None = None, limit: int | None = None) -> str:
        return to_json(self.edges, path, limit)

    def summary(self) -> str:
        return f"NetworkResult({self.nodes.count()} nodes, {self.edges.count()} edges)"


def first_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names, *[c for c in df.columns if c not in names])
