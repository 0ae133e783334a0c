"""The source catalog: observed schemas, statistics and digests."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.operators.paths import settle
from kgspark.sources import snapshots

# Names of relation kinds, and the digest's limit.
KINDS = {"r": "table", "p": "partitioned-table", "v": "view", "m": "materialized-view", "f": "foreign-table"}
MAX_COLUMNS = 60
#: Sources that are read at the same time.
AT_ONCE = 8
TABLE, COLUMN = ("schema_name", "table_name"), ("schema_name", "table_name", "column_name")


def decode_stats(n_distinct: Column) -> tuple[Column, Column]:
    """Estimated count and ratio of distinct values: a negative figure is a ratio, others are counts."""
    return F.when(n_distinct >= 0, n_distinct.cast("long")), F.when(n_distinct < 0, -n_distinct)


def decode_rows(reltuples: Column, analyzed: Column) -> Column:
    """Estimated rows; null where never analysed or negative, which is not zero."""
    return F.when(analyzed & (reltuples >= 0), reltuples.cast("long"))


def kind_name(kind: Column) -> Column:
    """The name of a kind's letter; an unknown letter stays."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), kind), kind)


def build_observations(tables: DataFrame, columns: DataFrame, comments: DataFrame, stats: DataFrame, constraints: DataFrame) -> DataFrame:
    """One row for each column, with its table's kind, rows and comment, statistics, primary key flag and first foreign key.

    A table without metadata has the kind `unknown`; a table without columns has one row with null columns. Of several
    foreign keys on a column the first by constraint name counts.
    """
    count, ratio = decode_stats(F.col("n_distinct"))
    known = stats.select(*COLUMN, count.alias("estimated_distinct"), ratio.alias("distinct_ratio"), F.col("null_frac").alias("null_fraction"))
    pk = constraints.where("constraint_type = 'PRIMARY KEY'").select(*COLUMN, F.lit(True).alias("pk")).distinct()
    first = Window.partitionBy(*COLUMN).orderBy("constraint_name")
    fk = constraints.where("constraint_type = 'FOREIGN KEY'").withColumn("_at", F.row_number().over(first)).where("_at = 1").select(*COLUMN, "referenced_table", "referenced_column")
    heads = tables.select(*TABLE, kind_name(F.col("kind")).alias("kind"), decode_rows(F.col("reltuples"), F.col("analyzed")).alias("estimated_rows"), "table_comment")
    rows = columns.join(comments, list(COLUMN), "left").join(known, list(COLUMN), "left").join(pk, list(COLUMN), "left").join(fk, list(COLUMN), "left").join(heads, list(TABLE), "full_outer")
    return rows.withColumns({"kind": F.coalesce("kind", F.lit("unknown")), "is_primary_key": F.when(F.col("column_name").isNotNull(), F.coalesce("pk", F.lit(False)))}).drop("pk")


def profile_table(df: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """table_name, column_name, row_count, null_fraction, distinct_count and distinct_ratio, from one pass over the data.

    Distinct counts are approximate unless exact; a table without rows has null fractions and ratios.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    row = df.agg(F.count("*").alias("n"), *[x for i, c in enumerate(df.columns) for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"null{i}"), count(F.col(c)).alias(f"distinct{i}"))])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"null{i}").alias("null_fraction"), F.col(f"distinct{i}").alias("distinct_count")) for i, c in enumerate(df.columns)])
    rows = row.select("n", F.explode(entries).alias("e"))
    return rows.select(F.lit(name).alias("table_name"), "e.column_name", F.col("n").alias("row_count"), "e.null_fraction", "e.distinct_count", F.when(F.col("n") > 0, F.col("e.distinct_count") / F.col("n")).alias("distinct_ratio"))


def profile_tables(tables: dict[str, DataFrame], exact: bool = False) -> DataFrame:
    out = None
    for name, df in tables.items():
        rows = profile_table(df, name, exact)
        out = rows if out is None else out.unionByName(rows)
    return out


#: Binary logarithm of a sketch's registers: distinct counts are then off by less than 2 % in all but rare cases.
REGISTERS = 14
SKETCHES = "table_name string, part string, column_name string, row_count long, null_count long, sketch binary"


def sketch_table(df: DataFrame, name: str, part: str) -> DataFrame:
    """A row (SKETCHES) for each column of one part of a table, from one pass over it: counts, and a mergeable sketch of its values."""
    value = lambda c: F.col(c) if dict(df.dtypes)[c] in ("int", "bigint", "string", "binary") else F.col(c).cast("string")
    aggs = [x for i, c in enumerate(df.columns) for x in (F.count_if(F.col(c).isNull()).alias(f"null{i}"), F.hll_sketch_agg(value(c), F.lit(REGISTERS)).alias(f"sketch{i}"))]
    row = df.agg(F.count("*").alias("row_count"), *aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"null{i}").alias("null_count"), F.col(f"sketch{i}").alias("sketch")) for i, c in enumerate(df.columns)])
    rows = row.select("row_count", F.explode(entries).alias("e"))
    return rows.select(F.lit(name).alias("table_name"), F.lit(part).alias("part"), "e.column_name", "row_count", "e.null_count", "e.sketch")


def profile_sketches(sketches: DataFrame) -> DataFrame:
    """The profile of whole tables (as profile_table gives it, distinct counts approximate) from the sketches of their parts."""
    rows = sketches.groupBy("table_name", "column_name").agg(F.sum("row_count").alias("row_count"), F.sum("null_count").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"))
    some = F.col("row_count") > 0
    return rows.select("table_name", "column_name", "row_count", F.when(some, F.col("nulls") / F.col("row_count")).alias("null_fraction"), "distinct_count", F.when(some, F.col("distinct_count") / F.col("row_count")).alias("distinct_ratio"))


def profile_part(df: DataFrame, name: str, part: str, path: str) -> int:
    """Stores the sketches of one part of a table; only that part is read. A part that is there is replaced, by none too."""
    return snapshots.replace(sketch_table(df, name, part), path, ("table_name", "part"), [(name, part)])


def drop_part(spark: SparkSession, name: str, part: str, path: str) -> int:
    return snapshots.drop(spark, path, [(name, part)])


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profile of all tables whose parts are stored, from the sketches alone."""
    return profile_sketches(snapshots.current(spark, path, SKETCHES, ("table_name", "part")))


def list_runs(runs: DataFrame, source: str) -> DataFrame:
    return runs.where(F.col("source") == source).orderBy(F.desc("id"))


def latest_succeeded_run(runs: DataFrame) -> DataFrame:
    """One row a source: its newest run that succeeded; running and failed ones never count."""
    return runs.where("status = 'succeeded'").groupBy("source").agg(F.max_by(F.struct(*runs.columns), "id").alias("r")).select("r.*")


def list_catalog(observations: DataFrame) -> DataFrame:
    """Tables with their columns as an ordered array."""
    own = [c for c in observations.columns if c not in (*TABLE, "kind", "estimated_rows", "table_comment")]
    entry = F.when(F.col("column_name").isNotNull(), F.struct("ordinal_position", *[c for c in own if c != "ordinal_position"]))
    return observations.groupBy(*TABLE, "kind", "estimated_rows", "table_comment").agg(F.array_sort(F.collect_list(entry)).alias("columns")).orderBy(*TABLE)


def catalog_digest(observations: DataFrame) -> DataFrame:
    """schema_name, table_name and text: a block a table, of at most MAX_COLUMNS columns, saying how many are left out."""
    put = lambda prefix, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(prefix), F.col(c).cast("string")))
    distinct = F.coalesce(put("distinct=", "estimated_distinct"), put("distinctRatio=", "distinct_ratio"))
    key = F.when(F.col("referenced_table").isNotNull(), F.concat(F.lit("FK -> "), "referenced_table", F.lit("."), "referenced_column"))
    line = F.concat_ws(" | ", F.concat(F.lit("- "), "column_name", F.lit(": "), "data_type"), F.when(~F.col("is_nullable"), "NOT NULL"), F.when(F.col("is_primary_key"), "PRIMARY KEY"), key, put("maxLength=", "character_maximum_length"), distinct)
    line = F.concat(line, F.coalesce(F.concat(F.lit("\n  comment: "), F.nullif(F.col("column_comment"), F.lit(""))), F.lit("")))
    at = F.when(F.col("column_name").isNotNull(), F.struct("ordinal_position", line.alias("line")))
    rows = observations.groupBy(*TABLE, "kind", "estimated_rows", "table_comment").agg(F.array_sort(F.collect_list(at)).alias("c"))
    head = F.concat(F.lit("## "), "schema_name", F.lit("."), "table_name", F.lit(" ("), "kind", F.lit(")"), F.coalesce(F.concat(F.lit(" [rows≈"), F.col("estimated_rows").cast("string"), F.lit("]")), F.lit(" [rows: not analyzed]")))
    more = F.when(F.size("c") > MAX_COLUMNS, F.concat(F.lit("- ["), (F.size("c") - MAX_COLUMNS).cast("string"), F.lit(" more columns omitted from this prompt]")))
    shown = F.array_join(F.transform(F.slice("c", 1, MAX_COLUMNS), lambda x: x["line"]), "\n")
    return rows.select(*TABLE, F.concat_ws("\n", head, F.concat(F.lit("comment: "), F.nullif(F.col("table_comment"), F.lit(""))), F.when(F.size("c") > 0, shown), more).alias("text")).orderBy(*TABLE)


def sweep(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """The union of all sources' observations, and source, status and error of each; a failure doesn't stop the others.

    Each source is read once, to the shared folder, so that one which fails while it is read is counted, and leaves
    nothing behind in the union. Some sources are read at once; the states are in the order of the sources.
    """
    def swept(source: tuple[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, tuple]:
        name, read = source
        try:
            return settle(read().withColumn("source", F.lit(name))), (name, "succeeded", None)
        except Exception as problem:  # noqa: BLE001
            return None, (name, "failed", str(problem)[:500])

    with ThreadPoolExecutor(AT_ONCE) as pool:
        results = list(pool.map(swept, sources.items()))
    out = None
    for rows, _ in results:
        if rows is not None:
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, spark.createDataFrame([state for _, state in results], "source string, status string, error string")


def sweep_summary(states: DataFrame) -> DataFrame:
    """One row: total, succeeded and failed."""
    return states.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == x).alias(x) for x in ("succeeded", "failed")])
