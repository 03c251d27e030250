"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a table that is sent to all executors at most.
SMALL = 200_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in a local session only, a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpuscle-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, as a table that survives the loss of executors; removed when the session ends.

    rows: how many go to a Python worker at once, where rows are large.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(key)
    try:
        if rows is not None:
            conf.set(key, min(rows, int(usual)) if int(usual) > 0 else rows)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if rows is not None:
            conf.set(key, usual)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df, a table of written(), to be sent to all executors if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def ranged(df: DataFrame, by: str) -> DataFrame:
    """df in ranges of a column, as a table that says in _part which range a row is in."""
    return written(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, by: str, what: str, col: str, out: str, backwards: bool = False) -> DataFrame:
    """rows of ranged() with the running sum or min of col in the order of by: what is found in a range,
    with what all ranges before it carry over. No task sees more than a range."""
    agg = {"sum": F.sum, "min": F.min}[what]
    way = (lambda c: F.col(c).desc()) if backwards else F.col
    own = agg(col).over(Window.partitionBy("_part").orderBy(way(by)).rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.groupBy("_part").agg(agg(col).alias("_t"))
    before = agg("_t").over(Window.orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1))
    carried = rows.withColumn(out, own).join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part")
    whole = F.coalesce("_before", F.lit(0)) + F.col(out) if what == "sum" else F.least("_before", out)
    return carried.withColumn(out, whole).drop("_before")


def drop_written() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session is gone
            return


atexit.register(drop_written)
