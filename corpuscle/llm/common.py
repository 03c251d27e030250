"""Shared pieces of the training-data operators: tables, shared storage, links to classes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that may be broadcast; larger sides join by shuffle.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a local session one of our own.

    On a cluster a folder of one machine would lose rows, so there the setting is required.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpuscle-shared-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def id_for_python(df: DataFrame, id_col: str) -> Column:
    """The id as it can pass through pandas: whole numbers as text, as beside nulls they would become floats."""
    whole = df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.col(id_col).cast("string") if whole else F.col(id_col)


def trim() -> None:
    """At the end of a Python task: give the memory that it no longer uses back to the system.

    A worker lives on beside its executor and serves later stages, which would pay for what earlier ones held.
    """
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give_back:
        give_back(0)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a table in the shared folder.

    Unlike a local checkpoint the table survives the loss of any executor. Tables are removed
    when the session ends, or earlier through drop_tables().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_tables() -> None:
    """Remove every table that materialize() wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session is gone; the folder's owner clears it
            return


atexit.register(drop_tables)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is known to have at most so many rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (src, dst); root is the smallest node reachable.

    Alternating large-star and small-star steps as aggregations and joins: no adjacency list is
    ever gathered, so a node with any number of links costs one partially aggregated row.
    """
    a, b = F.col("src"), F.col("dst")
    now = materialize(
        edges.filter(a != b).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct()
    )
    for _ in range(max_rounds):
        both = now.select("src", "dst").unionByName(now.select(b.alias("src"), a.alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = (
            both.filter(b > a).join(least, "src").select(b.alias("src"), F.col("m").alias("dst"))
        ).filter(a != b).distinct()
        down = large.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        new = materialize(
            down.join(low, "src").select(F.explode(F.array("src", "dst")).alias("src"), F.col("m").alias("dst"))
            .filter(a != b).distinct()
        )
        sums = [
            x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first() for x in (now, new)
        ]
        now = new
        if tuple(sums[0]) == tuple(sums[1]):
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(a.alias("node"), b.alias("root")).unionByName(
        now.select(b.alias("node"), b.alias("root")).distinct()
    )
