"""Scratch tables and joins with hot keys."""

import os

import pytest

from pyspark.sql import functions as F

from kgspark.llm import common


def test_scratch_is_cleared(spark):
    rows = common.written(spark.range(3), "scratch")
    path = rows.inputFiles()[0].removeprefix("file://")
    assert rows.count() == 3 and os.path.exists(path)
    common.clear(spark)
    assert not os.path.exists(path)


def test_attach_with_hot_cold_null_and_missing_keys(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").when(F.col("id") < 4990, F.col("id").cast("string")).when(F.col("id") < 4995, "gone").alias("k"))
    right = left.where("k is not null and k <> 'gone'").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = common.attach(left, right, "k", "n", 5000, "id").select("id", "k", "found.least").collect()
    assert len(out) == 5000
    assert all(r.least == (0 if r.id < 4000 else r.id if r.id < 4990 else None) for r in out)


def test_running_sums_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "PART_ROWS", 30)
    rows = common.written(spark.range(200).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("k"), (F.col("id") % 7).alias("x")), "rows")
    out = common.running(rows, [F.col("k")], {"place": F.lit(1).cast("long"), "before": F.col("x")}).orderBy("k").collect()
    assert [(r.place, r.before) for r in out] == [(i, sum(r.x for r in out[:i])) for i in range(200)]


def test_attach_spreads_hot_keys_by_row(spark):
    """Null spread values would put a hot key's rows into one partition."""
    left = spark.range(5000).select(F.col("id").alias("row"), F.lit("hot").alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("row").alias("least"))
    assert common.attach(left, right, "k", "n", 5000, "row").where("found.least = 0").count() == 5000


def test_no_local_folder_on_a_cluster():
    class Cluster:
        conf = type("conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
