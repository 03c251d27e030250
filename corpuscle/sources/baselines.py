"""Frequency lists that a corpus is compared with."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.corpus import Corpus


@dataclass(frozen=True)
class Baseline:
    """counts: (term, count); total_tokens includes the terms that the list leaves out."""

    name: str
    counts: DataFrame
    total_tokens: int
    n_documents: int
    metadata: dict[str, Any] = field(default_factory=dict)


def baseline_from_corpus(corpus: Corpus, name: str, min_count: int = 2, metadata: dict | None = None) -> Baseline:
    total, docs = corpus.total_tokens(), corpus.df.count()
    if total <= 0:
        raise ValueError("the corpus holds no tokens")
    counts = corpus.terms().groupBy("term").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)
    return Baseline(name, counts, total, docs, {"min_count": min_count} | (metadata or {}))


def save_baseline(baseline: Baseline, folder: str) -> None:
    """counts as Parquet, most frequent first, and a JSON file beside it."""
    os.makedirs(folder, exist_ok=True)
    baseline.counts.orderBy(F.desc("count"), "term").write.mode("overwrite").parquet(os.path.join(folder, baseline.name + ".parquet"))
    facts = {"total_tokens": baseline.total_tokens, "n_documents": baseline.n_documents, "metadata": baseline.metadata}
    with open(os.path.join(folder, baseline.name + ".json"), "w") as f:
        json.dump(facts, f)


def list_baselines(folder: str) -> list[str]:
    return sorted(f[:-5] for f in os.listdir(folder) if f.endswith(".json")) if os.path.isdir(folder) else []


def load_baseline(spark: SparkSession, name: str, folder: str) -> Baseline:
    if name not in list_baselines(folder):
        raise KeyError(f"no baseline {name!r}; there are {', '.join(list_baselines(folder)) or 'none'}")
    with open(os.path.join(folder, name + ".json")) as f:
        facts = json.load(f)
    return Baseline(name, spark.read.parquet(os.path.join(folder, name + ".parquet")), **facts)


def book_body(text: Column) -> Column:
    """What stands between a digital book's start and end markers; the whole text without them."""
    after = F.regexp_replace(text, r"(?s)^.*?\*\*\* ?START OF [^\n]*\*\*\*", "")
    return F.regexp_replace(F.regexp_replace(after, r"(?s)\*\*\* ?END OF .*$", ""), r"^\s+|\s+$", "")
