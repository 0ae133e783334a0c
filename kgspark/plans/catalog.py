"""Queries of the source catalog (K of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import catalog as K
from kgspark.plans import data as D
from kgspark.plans.registry import query


def catalog(spark, sf_dir):
    """Five results of a scan: parts as tables, with two columns each."""
    k = F.col("p_partkey")
    part = D.table(spark, sf_dir, "part")
    name = F.concat(F.lit("t"), k.cast("string"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("r", "v", "m", "x")]), (k % 4 + 1).cast("int"))
    tables = part.where(k % 10 != 0).select(F.lit("public").alias("schema_name"), name.alias("table_name"), kind.alias("kind"), (F.col("p_size") - 5).cast("double").alias("reltuples"), (k % 3 != 0).alias("analyzed"), F.when(k % 2 == 0, F.col("p_name")).alias("table_comment"))
    cols = part.where(k % 9 != 0).select("p_size", k.alias("k"), name.alias("table_name"), F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("id").alias("n")), F.struct(F.lit(2).alias("at"), F.lit("ref").alias("n")))).alias("c"))
    key = (F.lit("public").alias("schema_name"), "table_name", F.col("c.n").alias("column_name"))
    columns = cols.select(*key, F.col("c.at").alias("ordinal_position"), F.when(F.col("c.at") == 1, "bigint").otherwise("text").alias("data_type"), (F.col("c.at") == 2).alias("is_nullable"), F.when(F.col("c.at") == 2, 80).alias("character_maximum_length"))
    comments = cols.where("c.at = 2 and k % 4 = 0").select(*key, F.lit("refers").alias("column_comment"))
    stats = cols.where("c.at = 1 and k % 5 <> 0").select(*key, F.when(F.col("k") % 2 == 0, -0.5).otherwise(F.col("p_size").cast("double")).alias("n_distinct"), F.lit(0.25).alias("null_frac"))
    pk = cols.where("c.at = 1").select(*key, F.lit("pk").alias("constraint_name"), F.lit("PRIMARY KEY").alias("constraint_type"), F.lit(None).cast("string").alias("referenced_table"), F.lit(None).cast("string").alias("referenced_column"))
    fk = lambda n: cols.where("c.at = 2 and k % 3 = 0").select(*key, F.lit(n).alias("constraint_name"), F.lit("FOREIGN KEY").alias("constraint_type"), F.lit(f"to_{n}").alias("referenced_table"), F.lit("id").alias("referenced_column"))
    return tables, columns, comments, stats, pk.unionByName(fk("b")).unionByName(fk("a"))


OBSERVED = """obs AS (SELECT 't' || p_partkey AS table_name, c AS column_name, CASE WHEN k % 10 = 0 THEN 'unknown' ELSE ['table', 'view', 'materialized-view', 'x'][k % 4 + 1] END AS kind, CASE WHEN k % 10 <> 0 AND k % 3 <> 0 AND p_size >= 5 THEN p_size - 5 END AS estimated_rows,
  CASE WHEN c = 'id' AND k % 5 <> 0 AND k % 2 = 1 THEN p_size END AS estimated_distinct, CASE WHEN c = 'id' AND k % 5 <> 0 AND k % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS distinct_ratio, c = 'id' AS is_primary_key, CASE WHEN c = 'ref' AND k % 3 = 0 THEN 'to_a' END AS referenced_table, k, p_name
  FROM (SELECT *, p_partkey AS k, unnest(CASE WHEN p_partkey % 9 = 0 THEN [NULL] ELSE ['id', 'ref'] END) AS c FROM part) WHERE k % 9 <> 0 OR k % 10 <> 0)"""


@query("k01_build_observations", f"WITH {OBSERVED} SELECT table_name, column_name, kind, estimated_rows, estimated_distinct, distinct_ratio, is_primary_key, referenced_table FROM obs")
def k01(spark, sf_dir):
    return K.build_observations(*catalog(spark, sf_dir)).select("table_name", "column_name", "kind", "estimated_rows", "estimated_distinct", "distinct_ratio", "is_primary_key", "referenced_table")


@query("k02_decode_stats", "SELECT p_partkey AS k, CASE WHEN p_size >= 25 THEN p_size - 25 END AS n, CASE WHEN p_size < 25 THEN CAST(25 - p_size AS DOUBLE) END AS ratio, CASE WHEN p_partkey % 2 = 0 AND p_size >= 25 THEN p_size - 25 END AS rows FROM part")
def k02(spark, sf_dir):
    n, ratio = K.decode_stats((F.col("p_size") - 25).cast("double"))
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), n.alias("n"), ratio.alias("ratio"), K.decode_rows((F.col("p_size") - 25).cast("double"), F.col("p_partkey") % 2 == 0).alias("rows"))


PROFILED = {"customer": ("c_custkey", "c_nationkey", "c_mktsegment"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus"), "events": ("event_id", "user_id", "event_type")}


@query("k04_profile_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_fraction, count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) / count(*), 6) AS distinct_ratio FROM {t}" for t, cs in PROFILED.items() for c in cs))
def k04(spark, sf_dir):
    rows = K.profile_tables({t: D.table(spark, sf_dir, t).select(*cs) for t, cs in PROFILED.items()}, exact=True)
    return rows.withColumns({"null_fraction": F.round("null_fraction", 6), "distinct_ratio": F.round("distinct_ratio", 6)})


PARTED = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(
    "k04_profile_parts",
    " UNION ALL ".join(f"SELECT 'orders' AS table_name, '{c}' AS column_name, count(*) AS row_count, 0.0 AS null_fraction, true AS near FROM orders" for c in PARTED)
    + " UNION ALL SELECT 'orders', 'late', count(*), round(avg(CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END), 6), true FROM orders",
)
def k04_parts(spark, sf_dir):
    """Orders are profiled part by part, one part twice; near says whether distinct counts are within 2 % of the exact ones."""
    from uuid import uuid4

    from kgspark.operators.paths import scratch

    path = f"{scratch(spark)}/sketches-{uuid4().hex}"
    orders = D.table(spark, sf_dir, "orders").select(*PARTED, F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("late"), "o_orderstatus")
    for status in "FOPF":
        K.profile_part(orders.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), "orders", status, path)
    exact = K.profile_table(orders.drop("o_orderstatus"), "orders", exact=True).select("column_name", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.02 * F.col("exact")
    return K.stored_profile(spark, path).join(exact, "column_name").select("table_name", "column_name", "row_count", F.round("null_fraction", 6).alias("null_fraction"), near.alias("near"))


@query("k05_latest_succeeded_run", "SELECT 's' || o_custkey AS source, max(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def k05(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for x in ("F", "succeeded", "O", "running", "P", "failed")])[F.col("o_orderstatus")]
    runs = D.table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), "o_custkey").alias("source"), F.col("o_orderkey").alias("id"), status.alias("status"))
    return K.latest_succeeded_run(runs).select("source", "id")


@query("k06_list_catalog", f"WITH {OBSERVED} SELECT table_name, kind, coalesce(array_to_string(list(column_name ORDER BY column_name) FILTER (column_name IS NOT NULL), ','), '') AS columns FROM obs GROUP BY table_name, kind, estimated_rows")
def k06(spark, sf_dir):
    rows = K.list_catalog(K.build_observations(*catalog(spark, sf_dir)))
    return rows.select("table_name", "kind", F.array_join(F.transform("columns", lambda c: c["column_name"]), ",").alias("columns"))


@query(
    "k07_catalog_digest",
    f"""WITH {OBSERVED}, line AS (SELECT table_name, kind, estimated_rows, k, p_name, column_name, CASE column_name WHEN 'id' THEN '- id: bigint | NOT NULL | PRIMARY KEY' || coalesce(' | distinct=' || CAST(estimated_distinct AS BIGINT), '') || coalesce(' | distinctRatio=' || distinct_ratio, '')
  WHEN 'ref' THEN '- ref: text' || coalesce(' | FK -> ' || referenced_table || '.id', '') || ' | maxLength=80' || CASE WHEN k % 4 = 0 THEN chr(10) || '  comment: refers' ELSE '' END END AS line FROM obs)
  SELECT table_name, '## public.' || table_name || ' (' || kind || ')' || coalesce(' [rows≈' || estimated_rows || ']', ' [rows: not analyzed]') || CASE WHEN k % 2 = 0 AND k % 10 <> 0 THEN chr(10) || 'comment: ' || p_name ELSE '' END || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY column_name), '') AS text
  FROM line GROUP BY table_name, kind, estimated_rows, k, p_name""",
)
def k07(spark, sf_dir):
    return K.catalog_digest(K.build_observations(*catalog(spark, sf_dir))).select("table_name", "text")


def swept(spark, sf_dir):
    """Four sources: two that answer, one that can't be reached, and one that fails while it is read."""

    def unreachable():
        raise OSError("unreachable")

    own = lambda t: lambda: K.profile_table(D.table(spark, sf_dir, t), t)
    breaks = lambda: K.profile_table(D.table(spark, sf_dir, "orders").select(F.assert_true(F.col("o_orderkey") < 0).alias("x")), "orders")
    return K.sweep(spark, {"customer": own("customer"), "lost": unreachable, "orders": breaks, "part": own("part")})


@query("k08_sweep", "SELECT 'customer' AS source, 'succeeded' AS status, 5 AS columns, count(*) AS row_count FROM customer UNION ALL SELECT 'part', 'succeeded', 6, count(*) FROM part UNION ALL SELECT unnest(['lost', 'orders']), 'failed', 0, NULL")
def k08(spark, sf_dir):
    rows, states = swept(spark, sf_dir)
    counts = rows.groupBy("source").agg(F.count("*").alias("columns"), F.max("row_count").alias("row_count"))
    return states.join(counts, "source", "left").select("source", "status", F.coalesce("columns", F.lit(0)).alias("columns"), "row_count")


@query("k08_sweep_summary", "SELECT 4 AS total, count(DISTINCT t) AS succeeded, 4 - count(DISTINCT t) AS failed FROM (SELECT 'customer' AS t FROM customer UNION ALL SELECT 'part' FROM part)")
def k08_summary(spark, sf_dir):
    return K.sweep_summary(swept(spark, sf_dir)[1])


@query("k09_referenced_relations", "SELECT p_partkey AS k, array_to_string(list_sort(list_distinct(['t' || (p_partkey % 9), 'pg_catalog.x', 'u' || p_size])), ',') AS names FROM part")
def k09(spark, sf_dir):
    sql = F.concat(F.lit("select * from t"), (F.col("p_partkey") % 9).cast("string"), F.lit(" a Join LATERAL (SELECT 1 FROM pg_catalog.x) on true\n join\tu"), F.col("p_size").cast("string"))
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(T.referenced_relations(sql), ",").alias("names"))
