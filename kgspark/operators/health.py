"""Health of a namespace: what is unreferenced, ownerless, stale or broken. What could not be measured is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.paths import settle

WINDOW_DAYS, MAX_LIST = 90, 50
LISTS = ("unreferenced_terms", "without_owner_terms")
COUNTS = ("shacl_violation_count", "unprojected_version_count", "competency_question_count", "disputed_mapping_count", "deprecated_target_mapping_count", "unknown_target_mapping_count")


def term_health(terms: DataFrame, access: DataFrame, owned: DataFrame, now: str) -> DataFrame:
    """iri, referenced and owned of each term: the whole lists that health_report counts and shows the first of.

    A term is unreferenced if its last access is more than WINDOW_DAYS ago, or never was; the boundary itself is inside.
    """
    last = access.groupBy(F.col("term_iri").alias("iri")).agg(F.max("last_accessed_at").alias("last"))
    have = owned.select(F.col("term_iri").alias("iri"), F.lit(True).alias("owned")).distinct()
    rows = terms.select("iri").distinct().join(last, "iri", "left").join(have, "iri", "left")
    recent = F.col("last").cast("timestamp_ntz") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {WINDOW_DAYS} days")
    return rows.select("iri", F.coalesce(recent, F.lit(False)).alias("referenced"), F.coalesce("owned", F.lit(False)).alias("owned"))


def health_report(
    terms: DataFrame | None, access: DataFrame, owned: DataFrame, now: str, approved_at: str | None = None, unavailable: tuple[str, ...] = (), most: int = MAX_LIST, **counts: DataFrame | None
) -> DataFrame:
    """One row of a namespace's figures, with the first `most` unreferenced and ownerless terms.

    terms: iri of the current revision, None if it can't be read; access: term_iri and last_accessed_at; owned: term_iri.
    Only terms of the revision count. counts: one-row, one-column DataFrames by the names in COUNTS; None is unmeasured.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    spark = access.sparkSession
    none = F.lit(None)
    if terms is None:
        row = spark.range(1).select(*[none.cast("long").alias(n) for n in ("term_count", "unreferenced_count", "without_owner_count")], *[none.cast("array<string>").alias(n) for n in LISTS])
    else:
        rows = settle(term_health(terms, access, owned, now))
        row = rows.agg(F.count("*").alias("term_count"), F.count_if(~F.col("referenced")).alias("unreferenced_count"), F.count_if(~F.col("owned")).alias("without_owner_count"))
        for name, flag in zip(LISTS, ("referenced", "owned"), strict=True):
            row = row.crossJoin(rows.where(~F.col(flag)).orderBy("iri").limit(most).agg(F.array_sort(F.collect_list("iri")).alias(name)))
    age = F.floor((F.unix_seconds(moment.cast("timestamp")) - F.unix_seconds(F.lit(approved_at).cast("timestamp_ntz").cast("timestamp"))) / 86400)
    for name in COUNTS:
        df = counts.get(name)
        row = row.crossJoin(df.toDF(name)) if df is not None else row.withColumn(name, F.lit(None).cast("long"))
    n = F.col("term_count")
    ratio = F.when(n == 0, 0.0).when(n > 0, F.col("unreferenced_count") / n)
    return row.select(
        "term_count", "unreferenced_count", ratio.alias("unreferenced_ratio"), "without_owner_count", age.cast("long").alias("approval_age_days"), *COUNTS, *LISTS,
        F.array(*[F.lit(x) for x in unavailable]).cast("array<string>").alias("unavailable"),
    )


def health_summary(report: DataFrame, lists: bool = False, most: int = MAX_LIST) -> DataFrame:
    """The figures; the lists only on request, cut at `most`, with truncated saying whether one was."""
    cut = F.coalesce(F.col("unreferenced_count") > most, F.lit(False)) | F.coalesce(F.col("without_owner_count") > most, F.lit(False))
    rest = [c for c in report.columns if c not in LISTS]
    return report.select(*rest, *([F.slice(n, 1, most).alias(n) for n in LISTS] + [cut.alias("truncated")] if lists else []))
