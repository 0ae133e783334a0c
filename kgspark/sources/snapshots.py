"""Tables whose parts are replaced whole: a part's new rows are written first, then one small file makes them the current ones.

A table is a folder with `puts`, where each put has a folder of its own, and `commits`, a numbered file each with the parts
that it replaces and the put that has their rows now (null: dropped). Readers take the newest put of each part, so they see
a part as it was before a replacement or as it is after it, never half of it. A put without rows, and a drop, are commits
too; a put that fails before its commit changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMIT = "number long, key array<string>, put string"
TRIES = 100
#: Current puts whose folders are named in a plan.
LISTED = 1000


def replace(rows: DataFrame, path: str, by: tuple[str, ...], keys: Iterable[tuple[str, ...]]) -> int:
    """Makes rows the whole of the parts `keys` (values of the columns `by`); other parts stay. Gives the commit's number.

    rows may have none for a key: then the part is empty. Rows of other keys are refused. Null is a value of its own.
    """
    spark, keys = rows.sparkSession, [tuple(k) for k in dict.fromkeys(keys)]
    put = f"p{uuid.uuid4().hex}"
    folder = f"{path}/puts/put={put}"
    rows.write.parquet(folder)
    if keys:
        written = spark.read.schema(rows.schema).parquet(folder)
        own = spark.createDataFrame(keys, ", ".join(f"_{c} string" for c in by))
        same = [F.col(c).cast("string").eqNullSafe(F.col(f"_{c}")) for c in by]
        stray = written.select(*by).distinct().join(own, same, "left_anti").first()
        if stray is not None:
            _delete(spark, folder)
            raise ValueError(f"rows of {tuple(stray)} are not of the parts to replace")
    return _commit(spark, path, [(k, put) for k in keys])


def drop(spark: SparkSession, path: str, keys: Iterable[tuple[str, ...]]) -> int:
    """Removes parts; one that isn't there is no error."""
    return _commit(spark, path, [(tuple(k), None) for k in dict.fromkeys(keys)])


def commits(spark: SparkSession, path: str) -> DataFrame:
    """number, key and put of all that was committed."""
    _folder(spark, f"{path}/commits")
    return spark.read.schema(COMMIT).json(f"{path}/commits")


def current(spark: SparkSession, path: str, schema: str, by: tuple[str, ...], until: int | None = None) -> DataFrame:
    """The table's rows: of each part those of its newest put, or of the newest one up to a commit's number.

    The commit is settled here, so later ones don't change the rows. Filters on rows reach the files; folders of puts that
    are not current are passed over where no more than LISTED are current.
    """
    _folder(spark, f"{path}/puts")
    rows = spark.read.schema(f"{schema}, put string").parquet(f"{path}/puts")
    last = _last(spark, path)
    known = commits(spark, path).where(F.col("number") <= (last if until is None else min(until, last)))
    newest = known.groupBy("key").agg(F.max_by("put", "number").alias("_put")).where("_put is not null")
    puts = newest.select("_put").distinct().limit(LISTED + 1).collect()
    if len(puts) <= LISTED:
        rows = rows.where(F.col("put").isin([r["_put"] for r in puts]))
    named = newest.select("_put", *[F.col("key")[i].alias(f"_{c}") for i, c in enumerate(by)])
    same = [F.col("put") == F.col("_put"), *[F.col(c).cast("string").eqNullSafe(F.col(f"_{c}")) for c in by]]
    return rows.join(named, same, "left_semi").drop("put")


def clear_old(spark: SparkSession, path: str) -> int:
    """Deletes puts that no part's newest commit names, and says how many. No reader or writer may be at work."""
    known = commits(spark, path)
    last = Window.partitionBy("key").orderBy(F.desc("number"))
    used = {r["put"] for r in known.withColumn("_at", F.row_number().over(last)).where("_at = 1 and put is not null").select("put").distinct().collect()}
    old = [x for x in _names(spark, f"{path}/puts") if x.startswith("put=") and x.removeprefix("put=") not in used]
    for name in old:
        _delete(spark, f"{path}/puts/{name}")
    return len(old)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folder(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.mkdirs(at)


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    _folder(spark, path)
    files, at = _files(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)]


def _last(spark: SparkSession, path: str) -> int:
    """The newest commit's number, 0 before the first."""
    return max((int(x.removesuffix(".json")) for x in _names(spark, f"{path}/commits") if x.endswith(".json")), default=0)


def _commit(spark: SparkSession, path: str, entries: list[tuple[tuple[str, ...], str | None]]) -> int:
    """Writes the next numbered file; where another writer was first, the one after it. A file that exists is never written over."""
    for _ in range(TRIES):
        number = 1 + _last(spark, path)
        files, at = _files(spark, f"{path}/commits/{number:020d}.json")
        try:
            out = files.create(at, False)
        except Exception as fault:  # py4j wraps what the file system throws
            if files.exists(at):
                continue
            raise fault
        lines = "\n".join(json.dumps({"number": number, "key": list(key), "put": put}) for key, put in entries)
        try:
            out.write(bytearray(lines.encode()))
        finally:
            out.close()
        return number
    raise RuntimeError(f"no commit after {TRIES} tries at {path}")
