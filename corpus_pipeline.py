"""A corpus pipeline of five of the operators; every stage works on all that the one before it kept.

Rows with a null doc_id, null and empty texts, repeated rows and empty tables go through every stage; what becomes of them is
said there. Columns beyond those of documents, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import decontamination, mixing, quality, sharding, simhash
from kgspark.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are scored like any; repeated rows alike."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies: five-word shingle sets of similarity 0.8 or more, or a chain of them.

    Rows without a doc_id all stay. Null and empty texts are one group. Of repeated rows one stays; of rows with one doc_id
    and unlike texts, one for each group.
    """
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate. Texts without a word stay; repeated rows are judged alike."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in curriculum order, as often as the mix takes them. The order is that of the files' rows.

    Null sources are a source. Documents without a word, null texts among them, are in no mix; repeated rows are documents
    of their own.
    """
    return mixing.mixed_documents(docs)


def training_order(docs: DataFrame) -> Column:
    """A number that grows in the order in which a sorted table was written: the part's number, then the place in its file.

    Spark reads files in the order of their sizes, so the order has to be taken from them. Null where rows are of no file.
    """
    if not docs.inputFiles():
        return F.lit(None).cast("long")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-([0-9]+)", 1).try_cast("long")
    return F.shiftleft(part, 36) + F.col("_metadata.row_index")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that the hash tree puts them in, and position, which grows in training order.

    A null doc_id has the shard of the empty key. Columns named shard or position are replaced.
    """
    return sharding.with_shards(docs.withColumn("position", training_order(docs)))


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: No SQL: the classifier is fitted, and near copies are compared on hashed shingles.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
