"""Access logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.operators.logs import build_access_events


def stream_access_enrich(log: DataFrame) -> DataFrame:
    """Access events of a stream of logged queries; row by row, so any output mode does."""
    return build_access_events(log)


def stream_term_access(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", every: int = 100) -> StreamingQuery:
    """Keeps term_access of a stream of events (id, namespace, occurred_at, terms) in a table below path.

    Events repeated within the watermark count once. Each batch writes its own increments to path/kind=batch/number=N,
    replacing what an earlier try of the batch wrote, so a batch counts once; read_term_access adds them up. After each
    `every` batches compact() merges what is there, so that folders don't grow in number with the batches. Nothing is held
    in one task.
    """
    unique = events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["id"])

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("namespace", "id", "occurred_at", F.explode(F.array_distinct("terms")).alias("term_iri"))
        sums = rows.groupBy("namespace", "term_iri").agg(F.count("*").alias("access_count"), F.max("occurred_at").alias("last_accessed_at"))
        sums.write.mode("overwrite").parquet(f"{path}/kind=batch/number={number}")
        if number % every == every - 1:
            compact(batch.sparkSession, path, number)

    return unique.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_merged(spark: SparkSession, path: str) -> int:
    """The number of the newest merged folder that was written to its end; -1 without one."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=merged/number=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return max((int(x.getPath().getParent().getName().removeprefix("number=")) for x in found or ()), default=-1)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows that count: those of the newest merged folder, and of the batches after it."""
    newest = newest_merged(spark, path)
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.where(((F.col("kind") == "merged") & (F.col("number") == newest)) | ((F.col("kind") == "batch") & (F.col("number") > newest)))


def read_term_access(spark: SparkSession, path: str) -> DataFrame:
    """namespace, term_iri, access_count and last_accessed_at after all batches."""
    return current(spark, path).groupBy("namespace", "term_iri").agg(F.sum("access_count").alias("access_count"), F.max("last_accessed_at").alias("last_accessed_at"))


def compact(spark: SparkSession, path: str, number: int) -> None:
    """Merges all batches up to a number, the last one written, into path/kind=merged/number=N, and deletes what that replaces.

    Only the stream's writer may call it, between batches. Readers take the merged folder from the moment that it is there.
    """
    if newest_merged(spark, path) < number:
        read_term_access(spark, path).write.mode("overwrite").parquet(f"{path}/kind=merged/number={number}")
    if newest_merged(spark, path) != number:
        raise RuntimeError(f"no merged folder {number} was written to its end below {path}")
    folders = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=*/number=*")
    files = folders.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.globStatus(folders):
        kind, own = folder.getPath().getParent().getName(), int(folder.getPath().getName().removeprefix("number="))
        if own <= number and (kind, own) != ("kind=merged", number):
            files.delete(folder.getPath(), True)
