"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task orders for a running sum.
PART_ROWS = 100_000
#: A key that holds at least one HOT-th of the rows is hot; so at most HOT keys can be.
HOT = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder, but under a local master only, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="kgspark-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Deletes what this process has written to the shared folder; results that still read it must be written by then."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder: later plans read the table and can rerun lost tasks from it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(left: DataFrame, right: DataFrame, key: str, count: str, total: int, spread: str) -> DataFrame:
    """left, with right's columns as the struct column `found` (null where right has no such key).

    right has one row a key, and in `count` the number of left's rows (of `total`) with that key. Hot keys, at most
    HOT of them, are broadcast. Left's rows with such a key are then dealt by `spread`, a column with many values, so
    that no task gets them all. Null keys find nothing. spread must be the same whenever a task is run again.
    """
    names = [c for c in right.columns if c not in (key, count)]
    right = right.select(key, F.col(count).alias("_n"), F.struct(*names).alias("_found"))
    hot = right.where(F.col("_n") * HOT >= total).select(F.col(key).alias("_hot_key"), F.col("_found").alias("_hot"))
    cold = right.where(F.col("_n") * HOT < total).select(F.col(key).alias("_cold_key"), F.lit(-1).cast("long").alias("_cold_salt"), F.col("_found").alias("_cold"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    settled = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    out = out.withColumns({"_join_key": F.when(~settled, F.col(key)), "_salt": F.when(settled, F.pmod(F.xxhash64(spread), F.lit(10**6))).otherwise(F.lit(-1).cast("long"))})
    out = out.join(cold, (F.col("_join_key") == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return out.select(*left.columns, F.coalesce("_hot", "_cold").alias("found"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums, by name, over all rows before each in an order without ties.

    Beyond PART_ROWS the rows are dealt by ranges of the order, summed in each range and moved by the ranges' totals.
    rows must be a written table, or one that is small and the same each time it is read.
    """
    parts = rows.count() // PART_ROWS + 1
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "running") if parts > 1 else rows.withColumn("_part", F.lit(0))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({name: F.coalesce(F.sum(c).over(own), F.lit(0)) for name, c in sums.items()})
    if parts > 1:
        before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for PART_ROWS
        totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
        totals = totals.select("_part", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
        out = out.join(totals, "_part").withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop(*[f"_{name}" for name in sums])
    return out.drop("_part")
