"""Trajectories, changepoints and novelty over streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuscle.functions import stats
from corpuscle.functions.text import positions, tokenize
from corpuscle.operators.senses import knn_novelty, unit
from corpuscle.operators.series import RunLengths


def _timed(stream: DataFrame, time_col: str) -> DataFrame:
    """Watermarks need times with a zone."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_counts(stream: DataFrame, time_col: str, term_col: str, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(period_start, period_end, term, count); rows later than the watermark are dropped."""
    stream = _timed(stream, time_col)
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    found = stream.withWatermark(time_col, late).groupBy(span.alias("w"), F.col(term_col).alias("term")).agg(F.count("*").alias("count"))
    return found.select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "term", "count")


def windowed_terms(stream: DataFrame, time_col: str, text_col: str, targets: list[str], window: str = "1 day", late: str = "1 hour", confidence: float = 0.95) -> DataFrame:
    """The trajectory of targets over a stream of documents, with Wilson's intervals."""
    stream = _timed(stream, time_col).select(time_col, tokenize(F.col(text_col)).alias("tokens"))
    tokens = F.col("tokens")
    hits = [F.sum(F.size(positions(tokens, t)).cast("long")).alias(f"h{i}") for i, t in enumerate(targets)]
    sums = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w")).agg(F.sum(F.size(tokens).cast("long")).alias("total"), *hits)
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"h{i}").alias("count")) for i, t in enumerate(targets)])
    long = sums.select("w", "total", F.explode(pairs).alias("p")).select(F.col("w.start").alias("period_start"), "p.term", "p.count", "total")
    low, high = stats.wilson(F.col("count"), F.col("total"), confidence)
    return long.withColumn("ci_lower", low).withColumn("ci_upper", high)


def sessions(stream: DataFrame, time_col: str, key_col: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of rows of one key without a longer gap."""
    found = _timed(stream, time_col).withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), F.col(key_col)).agg(F.count("*").alias("n"))
    return found.select(key_col, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


ONLINE = "key string, seq long, value double, map_run_length long, cp_recent double"


def online_changepoints(
    stream: DataFrame, key_col: str, value_col: str, order_col: str, mu_0: float, beta_0: float, kappa_0: float = 1.0, alpha_0: float = 1.0, hazard: float = 0.01,
    max_run_length: int = 500, recent: int = 3,
) -> DataFrame:
    """Run lengths of each key's series, value by value. Priors are given: a stream has no mean of its own yet.

    The state of a key is bounded by the longest run.
    """
    prior = RunLengths(hazard, mu_0, kappa_0, alpha_0, beta_0, max_run_length)
    start = pickle.dumps(prior)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, raw = state.get if state.exists else (0, start)
        model = pickle.loads(bytes(raw))  # noqa: S301 - written by this function alone
        out = []
        rows = pd.concat(list(batches), ignore_index=True).sort_values("o")
        for v in rows["v"]:
            p = model.advance(float(v))
            out.append((str(key[0]), seq, float(v), int(p.argmax()), float(p[: recent + 1].sum())))
            seq += 1
        state.update((seq, pickle.dumps(model)))
        yield pd.DataFrame(out, columns=["key", "seq", "value", "map_run_length", "cp_recent"])

    rows = stream.select(F.col(key_col).cast("string").alias("k"), F.col(value_col).cast("double").alias("v"), F.col(order_col).alias("o"))
    return rows.groupBy("k").applyInPandasWithState(run, ONLINE, "seq long, model binary", "append", GroupStateTimeout.NoTimeout)


def novelty_sink(store: str, out: str, k: int = 10):
    """For foreachBatch: scores a batch of (id, period, embedding) against all that came before, then adds it.

    A batch that is delivered again overwrites what it wrote.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("id", F.lit(epoch).alias("period"), unit(F.col("embedding")).alias("x")).persist()
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(store)
            there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
            if there:
                prior = spark.read.parquet(store).filter(F.col("epoch") < epoch).select("id", "period", "x")
                found = knn_novelty(rows, prior, k)
            else:
                found = rows.select("id", F.lit(0.0).alias("novelty"))
            found.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{store}/batch={epoch}")
        finally:
            rows.unpersist()

    return handle
