"""Corpus and CorpusSlice: a DataFrame of documents with a text column and metadata."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.text import RegexTokenizer, tokenize
from corpuscle.plans.storage import SMALL, ranged, running, written

#: Units of a period: the letter that users give, and the unit of date_trunc.
UNITS = {"Y": "year", "A": "year", "Q": "quarter", "M": "month", "W": "week", "D": "day"}


def unit_of(freq: str) -> str:
    key = freq.upper().split("-")[0]
    key = {"YE": "Y", "YS": "Y", "QE": "Q", "QS": "Q", "ME": "M", "MS": "M"}.get(key, key)
    if key not in UNITS:
        raise ValueError(f"unknown frequency {freq!r}")
    return UNITS[key]


def period_label(period: Column, unit: str) -> Column:
    """2020, 2020Q1, 2020-03, 2020-03-01/2020-03-07 or 2020-03-01."""
    if unit == "year":
        return F.date_format(period, "yyyy")
    if unit == "quarter":
        return F.concat(F.date_format(period, "yyyy"), F.lit("Q"), F.quarter(period).cast("string"))
    if unit == "month":
        return F.date_format(period, "yyyy-MM")
    day = F.date_format(period, "yyyy-MM-dd")
    return F.concat(day, F.lit("/"), F.date_format(F.date_add(period.cast("date"), 6), "yyyy-MM-dd")) if unit == "week" else day


@dataclass(frozen=True)
class Corpus:
    """One row a document. All methods are lazy but those that return numbers."""

    df: DataFrame
    text_col: str = "text"
    id_col: str | None = None
    meta_cols: tuple[str, ...] = ()
    tokenizer: Any = field(default_factory=RegexTokenizer)
    filters: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self) -> None:
        for name, what in ((self.text_col, "text"), (self.id_col, "id")):
            if name is not None and name not in self.df.columns:
                raise ValueError(f"no {what} column {name!r}; there are {', '.join(self.df.columns)}")

    @property
    def docs(self) -> DataFrame:
        return self.df

    @property
    def metadata_columns(self) -> list[str]:
        return list(self.meta_cols) or [c for c in self.df.columns if c != self.text_col]

    @property
    def label(self) -> str:
        return ", ".join(f"{k}={v}" for k, v in self.filters.items()) or "corpus"

    def __len__(self) -> int:
        return self.df.count()

    def with_tokenizer(self, tokenizer: Any) -> Corpus:
        return replace(self, tokenizer=tokenizer)

    def where(self, condition: Column | str, **label: Any) -> CorpusSlice:
        return CorpusSlice(**(self._parts() | {"df": self.df.filter(condition), "filters": self.filters | label}))

    def _parts(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("df", "text_col", "id_col", "meta_cols", "tokenizer", "filters")}

    def slice(self, **filters: Any) -> CorpusSlice:
        """Documents whose columns equal a value, or are among several. Nulls fit only a None among several."""
        df = self.df
        for name, value in filters.items():
            if name not in df.columns:
                raise KeyError(name)
            c = F.col(f"`{name}`")
            if isinstance(value, (list, tuple, set, frozenset, pd.Series)):
                values = list(value)
                known = [v for v in values if not _missing(v)]
                fits = c.isin(known) if known else F.lit(False)
                df = df.filter(fits | c.isNull() if len(known) < len(values) else fits)
            else:
                df = df.filter(F.lit(False) if _missing(value) else c == value)
        return CorpusSlice(**(self._parts() | {"df": df, "filters": self.filters | filters}))

    # tokens

    def tokens(self) -> DataFrame:
        """The documents with a column of their tokens."""
        return self.token_lists(*self.df.columns)

    def token_lists(self, *keep: str | Column) -> DataFrame:
        """Only the tokens and the columns named, so that nothing else is read."""
        return self.df.select(*keep, tokenize(F.col(self.text_col), self.tokenizer).alias("tokens"))

    def need_id(self, what: str) -> str:
        if self.id_col is None:
            raise ValueError(f"{what} depends on the order of the documents; give id_col")
        return self.id_col

    def terms(self, *keep: str) -> DataFrame:
        """One row a token: the columns named, and term."""
        return self.token_lists(*keep).select(*keep, F.explode("tokens").alias("term"))

    def vocab(self, min_count: int = 1) -> DataFrame:
        """(term, count), most frequent first."""
        found = self.terms().groupBy("term").agg(F.count("*").alias("count"))
        return found.filter(F.col("count") >= min_count).orderBy(F.desc("count"), "term")

    def doc_term_counts(self, min_count: int = 1) -> DataFrame:
        """(id, term, n): the non-zero cells; min_count drops terms by their count in the corpus."""
        key = self.need_id("a document-term table")
        if min_count <= 1:
            return self.terms(key).groupBy(key, "term").agg(F.count("*").alias("n"))
        return self._cells(key, written(self._frequent(min_count)), "term")

    def _frequent(self, min_count: int) -> DataFrame:
        return self.terms().groupBy("term").agg(F.count("*").alias("c")).filter(F.col("c") >= min_count).select("term")

    def _cells(self, key: str, kept: DataFrame, name: str) -> DataFrame:
        """(key, name, n) of the terms in kept, a table. Where it is small, other tokens go before anything is shuffled."""
        if kept.count() <= SMALL:
            return self.terms(key).join(F.broadcast(kept), "term").groupBy(key, name).agg(F.count("*").alias("n"))
        return self.terms(key).groupBy(key, "term").agg(F.count("*").alias("n")).join(kept, "term").select(key, name, "n")

    def doc_term_counts_sparse(self, min_count: int = 1) -> tuple[DataFrame, DataFrame]:
        """(cells: id, column, n; columns: column, term), the columns numbered from 0 in order of the terms.

        Numbers are counted range by range, so no task sees the whole vocabulary.
        """
        key = self.need_id("a document-term matrix")
        terms = ranged(self._frequent(min_count).withColumn("one", F.lit(1)), "term")
        columns = written(running(terms, "term", "sum", "one", "place").select((F.col("place") - 1).alias("column"), "term"))
        return self._cells(key, columns, "column"), columns

    def total_tokens(self) -> int:
        return self.token_lists().agg(F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0))).first()[0]

    # time

    def by_time(self, col: str = "date", freq: str = "Y") -> TemporalCorpus:
        if col not in self.df.columns:
            raise ValueError(f"no time column {col!r}")
        if self.df.limit(1).count() == 0:
            raise ValueError("the corpus is empty")
        return TemporalCorpus(self, col, freq)

    # export

    def to_pandas(self) -> pd.DataFrame:
        return self.df.toPandas()

    def to_arrow(self):
        return self.df.toArrow()

    def to_polars(self):
        import polars

        return polars.from_arrow(self.df.toArrow())

    def fingerprint(self, order_by: str | None = None) -> int:
        """A hash of the content; with order_by also of the order by that column."""
        row = F.xxhash64(*[F.col(f"`{c}`") for c in self.df.columns])
        if order_by is None:
            return self.df.select(row.alias("h")).agg(F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0))).first()[0] % (1 << 64)
        return self.df.select(F.xxhash64(F.col(f"`{order_by}`"), row).alias("h")).agg(F.coalesce(F.bit_xor("h"), F.lit(0))).first()[0] % (1 << 64)


@dataclass(frozen=True)
class CorpusSlice(Corpus):
    """A part of a corpus, with the filters that made it as its label."""


CorpusLike = Corpus


def _missing(v: Any) -> bool:
    return v is None or (isinstance(v, float) and v != v)


def require_documents(*sides: Corpus) -> None:
    for side in sides:
        if side.df.limit(1).count() == 0:
            raise ValueError(f"{side.label} holds no documents")


@dataclass(frozen=True)
class TemporalCorpus:
    """A corpus cut into the periods that have documents."""

    corpus: Corpus
    time_col: str
    freq: str = "Y"

    @property
    def unit(self) -> str:
        return unit_of(self.freq)

    @property
    def docs(self) -> DataFrame:
        """The documents with period (its first day) and period_label."""
        period = F.date_trunc(self.unit, F.col(f"`{self.time_col}`").cast("timestamp")).cast("date")
        return self.corpus.df.withColumn("period", period).withColumn("period_label", period_label(F.col("period"), self.unit))

    def periods(self) -> list[str]:
        found = self.docs.filter("period is not null").select("period", "period_label").distinct().orderBy("period")
        return [r["period_label"] for r in found.collect()]

    def slice(self, period: str) -> CorpusSlice:
        found = self.docs.filter(F.col("period_label") == str(period)).drop("period", "period_label")
        return CorpusSlice(**(self.corpus._parts() | {"df": found, "filters": self.corpus.filters | {self.time_col: str(period)}}))

    def iter_slices(self) -> Iterable[tuple[str, CorpusSlice]]:
        for p in self.periods():
            yield p, self.slice(p)


def before_after(corpus: Corpus, event: str, time_col: str = "date") -> tuple[CorpusSlice, CorpusSlice]:
    """The documents before the event, and those from it on; unreadable times are on neither side."""
    when = F.try_to_timestamp(F.col(f"`{time_col}`").cast("string"))
    at = F.lit(event).cast("timestamp")
    return corpus.where(when < at, side=f"before {event}"), corpus.where(when >= at, side=f"from {event}")


def spark_of(corpus: Corpus) -> SparkSession:
    return corpus.df.sparkSession
