"""From raw documents to tokens: toxicity, near duplicates, benchmark leaks, secrets, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, decontam, secrets, shingles, toxicity
from corpuscle.llm.common import materialize, table

#: The stages hold trained models, XXH64 fingerprints and a byte-level tokenizer: not SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is at least a half go; learnt from the labelled rows outside the held-out fifth.

    Null and empty texts have the base score and stay; without labels all stay; null ids count as held out;
    repeated rows are judged alike; all columns are kept as they are.
    """
    model = toxicity.train(docs.filter(~toxicity.held_out()), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, by five-word shingles (0.8 or more) or by SimHash, the smallest doc_id stays.

    Texts without words are copies of one another; different texts of one id, and rows without an id, are
    documents of their own; of rows alike in id and text one stays; all columns are kept as they are.
    """
    return shingles.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the hit words are cut.

    Null texts have no words and stay null; null ids and repeated rows are judged like any others; an empty
    benchmark changes nothing. n_chars becomes the new text's length, null for a null text.
    """
    kept = decontam.remove(docs, table(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; every document stays.

    Null and empty texts have none; the source stands for the path, null for the empty one. n_chars becomes
    the new text's length.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of token ids, their digest, and the digest of the bytes decoded from them.

    A null text counts as the empty one, which has no tokens; repeated rows each get their row.
    """
    found = bpe.encode(docs.select("doc_id", "lang", "source", "text"), digests_only=True)
    return found.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
