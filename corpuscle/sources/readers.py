"""Ways to a Corpus: frames, files, SQL, and loaders that are passed in."""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.corpus import Corpus


def from_dataframe(spark: SparkSession, data: Any, text_col: str = "text", id_col: str | None = None, meta_cols: Sequence[str] = (), tokenizer=None) -> Corpus:
    """A Spark, pandas, Arrow or polars frame. A pandas index is dropped."""
    if isinstance(data, DataFrame):
        df = data
    elif hasattr(data, "to_arrow"):
        df = spark.createDataFrame(data.to_arrow())
    elif hasattr(data, "reset_index"):
        df = spark.createDataFrame(data.reset_index(drop=True))
    elif hasattr(data, "column_names"):
        df = spark.createDataFrame(data)
    else:
        raise TypeError(f"cannot make a corpus of {type(data).__name__}")
    return _corpus(df, text_col, id_col, meta_cols, tokenizer)


def _corpus(df: DataFrame, text_col: str, id_col: str | None, meta_cols: Sequence[str], tokenizer) -> Corpus:
    given = {"tokenizer": tokenizer} if tokenizer is not None else {}
    return Corpus(df, text_col, id_col, tuple(meta_cols), **given)


def read_csv(spark: SparkSession, path: str, text_col: str = "text", id_col: str | None = None, meta_cols: Sequence[str] = (), tokenizer=None, schema=None, **options) -> Corpus:
    """Quoted fields may hold line breaks. Without a schema the types are inferred, which reads the file twice."""
    reader = spark.read.options(**({"header": True, "multiLine": True, "escape": '"', "inferSchema": schema is None} | options))
    return _corpus((reader.schema(schema) if schema else reader).csv(path), text_col, id_col, meta_cols, tokenizer)


def read_parquet(spark: SparkSession, path: str, text_col: str = "text", id_col: str | None = None, meta_cols: Sequence[str] = (), tokenizer=None, columns: Sequence[str] | None = None, **options) -> Corpus:
    df = spark.read.options(**options).parquet(path)
    return _corpus(df.select(*columns) if columns else df, text_col, id_col, meta_cols, tokenizer)


def read_txt(spark: SparkSession, path: str, one_doc_per: str = "file", encoding: str = "utf-8", tokenizer=None) -> Corpus:
    """One document a file, with its source; or one a line that isn't blank, with its number from 1."""
    if one_doc_per not in ("file", "line"):
        raise ValueError("one_doc_per is 'file' or 'line'")
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.decode("content", encoding).alias("text"))
    if one_doc_per == "file":
        return _corpus(raw.select("text", "source"), "text", None, (), tokenizer)
    lines = raw.select("source", F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")).alias("i", "text"))
    lines = lines.filter(F.regexp_replace("text", r"\s", "") != "").select("text", "source", (F.col("i") + 1).alias("line"))
    return _corpus(lines, "text", None, (), tokenizer)


def from_sql(spark: SparkSession, query: str, args: dict | list | None = None, text_col: str = "text", id_col: str | None = None, meta_cols: Sequence[str] = (), tokenizer=None) -> Corpus:
    """Any query over the session's tables, with parameters."""
    if not isinstance(spark, SparkSession):
        raise TypeError("a SparkSession is needed")
    return _corpus(spark.sql(query, args=args), text_col, id_col, meta_cols, tokenizer)


def read_jdbc(spark: SparkSession, url: str, query: str, text_col: str = "text", id_col: str | None = None, **options) -> Corpus:
    return _corpus(spark.read.format("jdbc").options(url=url, query=query, **options).load(), text_col, id_col, (), None)


def from_dataset(
    spark: SparkSession, dataset_id: str, loader: Callable[..., Any], split: str = "train", config_name: str | None = None, text_col: str = "text",
    id_col: str | None = None, columns: Sequence[str] | None = None, n_rows: int | None = None, tokenizer=None,
) -> Corpus:
    """A dataset of a hub, through a loader that returns a frame, or a path of Parquet files."""
    if n_rows is not None and n_rows < 1:
        raise ValueError("n_rows must be positive")
    got = loader(dataset_id, config_name, split=f"{split}[:{n_rows}]" if n_rows else split)
    df = spark.read.parquet(got) if isinstance(got, str) else from_dataframe(spark, got, text_col).df
    if columns is not None:
        df = df.select(*dict.fromkeys([text_col, *columns]))
    return _corpus(df.limit(n_rows) if n_rows else df, text_col, id_col, (), tokenizer)


def clean_html(text: Column) -> Column:
    """Tags become spaces, entities their characters, and runs of white space one space."""
    bare = F.regexp_replace(text, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.when(bare.contains("&"), _unescape(bare)).otherwise(bare), r"[\s ]+", " "))


def _unescape(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: html.unescape(t) if t is not None else None)

    return run(text)


def clean_post(text: Column) -> Column:
    """Entities, then URLs out, then white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(_unescape(text), r"(?:www\.|https?://)\S+", " "), r"\s+", " "))


def classify_text(text: Column, rules: Sequence[tuple[str, str]], otherwise: str = "unknown") -> Column:
    """The label of the first expression that is found in the text."""
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def stratified_cap(df: DataFrame, by: str, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """At most n rows of each stratum, by a hash of their ids."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col))
    return df.withColumn("_r", order).filter(F.col("_r") <= n).drop("_r")


def read_vectors(spark: SparkSession, path: str, word_col: str = "word", vector_col: str = "vector") -> DataFrame:
    return spark.read.parquet(path).select(F.col(word_col).alias("word"), F.col(vector_col).cast("array<double>").alias("vector"))


def vector_shift(early: DataFrame, late: DataFrame, words: Sequence[str] | None = None) -> DataFrame:
    """(word, cosine_distance) of the words that both tables of vectors have."""
    from corpuscle.functions.stats import cosine

    both = early.select("word", F.col("vector").alias("a")).join(late.select("word", F.col("vector").alias("b")), "word")
    both = both.filter(F.col("word").isin(list(words))) if words else both
    return both.select("word", (1 - cosine(F.col("a"), F.col("b"))).alias("cosine_distance"))
