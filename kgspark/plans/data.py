"""Graphs, revisions, logs and mappings that the queries derive from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators.mapping import MapRow, materialize
from kgspark.operators.paths import dealt
from kgspark.sources.quads import COLUMNS, read_table

BASE, DATA, NS = "https://e.example/tpch#", "https://e.example/tpch/data/", "tpch"
WORLD = BASE + "World"
CUSTOMER, ORDER, NATION = BASE + "Customer", BASE + "Order", BASE + "Nation"
NAME, SEGMENT, OF, TOTAL, IN = BASE + "name", BASE + "segment", BASE + "customer", BASE + "total", BASE + "nation"

SPEC = [
    MapRow("customer", "customer", DATA + "customer/{c_custkey}", class_iri=(CUSTOMER,)),
    MapRow("customer", "customer", DATA + "customer/{c_custkey}", NAME, "column", "c_name"),
    MapRow("customer", "customer", DATA + "customer/{c_custkey}", SEGMENT, "column", "segment"),
    MapRow("customer", "customer", DATA + "customer/{c_custkey}", IN, "template", DATA + "nation/{c_nationkey}"),
    MapRow("order", "orders", DATA + "order/{o_orderkey}", class_iri=(ORDER,)),
    MapRow("order", "orders", DATA + "order/{o_orderkey}", OF, "template", DATA + "customer/{o_custkey}"),
    MapRow("order", "orders", DATA + "order/{o_orderkey}", TOTAL, "column", "o_totalprice", T.XSD + "double"),
    MapRow("nation", "nation", DATA + "nation/{n_nationkey}", class_iri=(NATION,)),
    MapRow("nation", "nation", DATA + "nation/{n_nationkey}", T.LABEL, "column", "n_name", None, "en"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The mapped sources; the segment BUILDING is missing, as null."""
    customer = table(spark, sf_dir, "customer").withColumn("segment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return {"customer": customer, "orders": table(spark, sf_dir, "orders"), "nation": table(spark, sf_dir, "nation")}


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as the default graph."""
    return materialize(SPEC, tables(spark, sf_dir), NS)


def cust(key: str) -> str:
    return f"'{DATA}customer/' || {key}"


def order(key: str) -> str:
    return f"'{DATA}order/' || {key}"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src and dst of nation below region below World."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    below = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit(BASE), "n_name").alias("src"), F.concat(F.lit(BASE), "r_name").alias("dst"))
    return below.unionByName(r.select(F.concat(F.lit(BASE), "r_name").alias("src"), F.lit(WORLD).alias("dst")))


HIERARCHY = f"""hierarchy AS (SELECT '{BASE}' || n_name AS src, '{BASE}' || r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT '{BASE}' || r_name, '{WORLD}' FROM region)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link from each part to another of its twenty neighbours by number, so that there are cycles in each twenty."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.cast("string").alias("src"), (k - k % 20 + (k * 7 + 3) % 20).cast("string").alias("dst")).distinct()


EDGES = "edges AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS src, CAST(p_partkey - p_partkey % 20 + (p_partkey * 7 + 3) % 20 AS VARCHAR) AS dst FROM part)"
CLOSURE = "plus AS (SELECT src, dst FROM edges UNION SELECT plus.src, edges.dst FROM plus JOIN edges ON plus.dst = edges.src)"


def revision(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """A revision of terms made from parts. Each has a label and a size, some are deprecated, some of those have a successor."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").where(k % 7 != 0 if new else k % 10 != 0)
    iri = lambda c: F.concat(F.lit(BASE + "p"), c.cast("string"))
    size = F.when(k % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")) if new else F.col("p_size")
    old = k % 11 == 0 if new else k % 22 == 0
    lit = lambda p, o: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("literal").alias("o_kind"))
    link = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"))
    made = F.array(link(T.TYPE, F.lit(T.CLASS)), lit(T.LABEL, F.col("p_name")), lit(BASE + "size", size), lit(T.DEPRECATED, F.when(old, "true")), link(T.REPLACED_BY, F.when(old & (k % 2 == 0), iri(k + 1))), lit(T.COMMENT, F.when(old & (k % 3 == 0), F.when(k % 9 == 0, " ").otherwise("gone"))), link(BASE + "like", iri(k * 3 % 97 + 1)))
    rows = rows.select(iri(k).alias("s"), F.explode(made).alias("t")).where("t.o is not null").select("s", "t.*")
    return rows.select(F.lit(NS).alias("ns"), F.lit("").alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang")).select(*COLUMNS)


def _revision_sql(name: str, keep: str, size: str, old: str) -> str:
    me = f"'{BASE}p' || p_partkey"
    return f"""{name} AS (WITH x AS (SELECT * FROM part WHERE {keep})
  SELECT {me} AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o, 'iri' AS o_kind FROM x UNION ALL SELECT {me}, '{T.LABEL}', p_name, 'literal' FROM x
  UNION ALL SELECT {me}, '{BASE}size', CAST({size} AS VARCHAR), 'literal' FROM x UNION ALL SELECT {me}, '{T.DEPRECATED}', 'true', 'literal' FROM x WHERE {old}
  UNION ALL SELECT {me}, '{T.REPLACED_BY}', '{BASE}p' || (p_partkey + 1), 'iri' FROM x WHERE {old} AND p_partkey % 2 = 0
  UNION ALL SELECT {me}, '{T.COMMENT}', CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE 'gone' END, 'literal' FROM x WHERE {old} AND p_partkey % 3 = 0
  UNION ALL SELECT {me}, '{BASE}like', '{BASE}p' || (p_partkey * 3 % 97 + 1), 'iri' FROM x)"""


REVISIONS = _revision_sql("base", "p_partkey % 10 <> 0", "p_size", "p_partkey % 22 = 0") + ", " + _revision_sql("new", "p_partkey % 7 <> 0", "CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END", "p_partkey % 11 = 0")


def described(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """A revision whose terms have blank nodes too, under other labels in each: every fourth a twin, every third one below."""
    k = F.col("p_partkey")
    label = "x" if new else "b"
    depth = F.col("p_size") + F.when(k % 6 == 0, 1).otherwise(0) if new else F.col("p_size")
    t = lambda s, sk, p, o, ok, here: F.when(here, F.struct(s.alias("s"), F.lit(sk).alias("s_kind"), F.lit(BASE + p).alias("p"), o.cast("string").alias("o"), F.lit(ok).alias("o_kind")))
    made = []
    for twin, here in (("", F.lit(True)), ("t", k % 4 == 0)):
        own, below = (F.concat(F.lit(label + twin + x), k.cast("string")) for x in ("", "c"))
        made += [
            t(F.concat(F.lit(BASE + "p"), k.cast("string")), "iri", "has", own, "bnode", here), t(own, "bnode", "depth", depth % 8, "literal", here),
            t(own, "bnode", "inner", below, "bnode", here & (k % 3 == 0)), t(below, "bnode", "note", F.concat(F.lit("n"), (k % 2).cast("string")), "literal", here & (k % 3 == 0)),
        ]
    rows = table(spark, sf_dir, "part").where(k % 7 != 0 if new else k % 10 != 0).select(F.explode(F.array(*made)).alias("t")).where("t is not null").select("t.*")
    none = F.lit(None).cast("string")
    blank = rows.select(F.lit(NS).alias("ns"), F.lit("").alias("g"), "s", "s_kind", "p", "o", "o_kind", none.alias("o_dt"), none.alias("o_lang"))
    return revision(spark, sf_dir, new).unionByName(blank.select(*COLUMNS))


def bnode_name(*lines: tuple[str, str, str]) -> str:
    """SQL for a blank node's canonical name, from (predicate, value, kind) of its triples in order."""
    return "sha256(" + " || chr(10) || ".join(f"'{p}' || chr(31) || {o} || chr(31) || '{kind}' || chr(31) || chr(31)" for p, o, kind in lines) + ")"


def bnode_final(name: str, parent: str, p: str, k: str = "'1'") -> str:
    """SQL for a blank node's name in its place: the structure's name, the parent, the predicate and the number among equal siblings."""
    return f"sha256({name} || chr(31) || {parent} || chr(31) || '{p}' || chr(31) || {k})"


def _described_sql(name: str, keep: str, depth: str) -> str:
    leaf, inner = (BASE + "depth", "d", "literal"), (BASE + "inner", "c", "bnode")
    return f"""{name}_p AS (SELECT '{BASE}p' || p_partkey AS iri, p_partkey AS k, CAST(({depth}) % 8 AS VARCHAR) AS d, CASE WHEN p_partkey % 3 = 0 THEN {bnode_name((BASE + "note", "'n' || (p_partkey % 2)", "literal"))} END AS c FROM part WHERE {keep}),
  {name}_n AS (SELECT *, CASE WHEN c IS NULL THEN {bnode_name(leaf)} ELSE {bnode_name(leaf, inner)} END AS one FROM {name}_p), {name}_k AS (SELECT *, unnest(CASE WHEN k % 4 = 0 THEN ['1', '2'] ELSE ['1'] END) AS twin FROM {name}_n),
  {name}_u AS (SELECT *, {bnode_final("one", "iri", BASE + "has", "twin")} AS n FROM {name}_k), {name}_t AS (SELECT *, {bnode_final("c", "n", BASE + "inner")} AS below FROM {name}_u),
  {name}_all AS (SELECT s, 'iri' AS s_kind, p, o, o_kind FROM {name} UNION ALL SELECT iri, 'iri', '{BASE}has', n, 'bnode' FROM {name}_t UNION ALL SELECT n, 'bnode', '{BASE}depth', d, 'literal' FROM {name}_t
  UNION ALL SELECT n, 'bnode', '{BASE}inner', below, 'bnode' FROM {name}_t WHERE c IS NOT NULL UNION ALL SELECT below, 'bnode', '{BASE}note', 'n' || (k % 2), 'literal' FROM {name}_t WHERE c IS NOT NULL)"""


DESCRIBED = f"""{REVISIONS}, {_described_sql("base", "p_partkey % 10 <> 0", "p_size")}, {_described_sql("new", "p_partkey % 7 <> 0", "p_size + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END")},
  diff AS (SELECT *, 'base' AS side FROM (SELECT * FROM base_all EXCEPT ALL SELECT * FROM new_all) UNION ALL SELECT *, 'new' FROM (SELECT * FROM new_all EXCEPT ALL SELECT * FROM base_all)),
  links AS (SELECT s, s_kind, o FROM base_all WHERE o_kind = 'bnode' UNION SELECT s, s_kind, o FROM new_all WHERE o_kind = 'bnode'), near AS (SELECT s AS owner, o AS node FROM links WHERE s_kind = 'iri'),
  owners AS (SELECT * FROM near UNION SELECT owner, links.o FROM near JOIN links ON links.s = node AND links.s_kind = 'bnode'),
  changed AS (SELECT s FROM (SELECT s FROM diff WHERE s_kind = 'iri' UNION SELECT owner FROM diff JOIN owners ON s = node WHERE s_kind = 'bnode') INTERSECT SELECT s FROM base INTERSECT SELECT s FROM new)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revisions, customers as namespaces; every third revision's origin is not recorded."""
    rows = table(spark, sf_dir, "orders")
    status = F.create_map(*[F.lit(x) for x in ("F", "approved", "O", "in-review", "P", "superseded")])[F.col("o_orderstatus")]
    name = lambda c: F.concat(F.lit("1."), c.cast("string"), F.lit(".0"))
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    recorded = F.col("o_orderkey") % 3 != 0
    return rows.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("ns"), name(F.col("o_orderkey")).alias("version"), status.alias("status"), F.col("o_orderdate").alias("approved_at"), F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("u"), (F.col("o_orderkey") % 7).cast("string")).alias("created_by"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("projected_at"), F.when(recorded, name(before)).alias("edited_from"), recorded.alias("edited_from_recorded"),
    )


VERSIONS = """versions AS (SELECT o_orderkey AS id, 'c' || o_custkey AS ns, '1.' || o_orderkey || '.0' AS version, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'in-review' WHEN 'P' THEN 'superseded' END AS status,
  o_orderdate AS approved_at, o_orderdate AS created_at, 'u' || (o_orderkey % 7) AS created_by, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS projected_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN '1.' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || '.0' END AS edited_from, o_orderkey % 3 <> 0 AS edited_from_recorded FROM orders)"""

ACTIONS = {"signup": "published", "view": "submitted", "click": "approved", "purchase": "superseded", "error": "rejected"}


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an audit trail of revisions."""
    rows = table(spark, sf_dir, "events")
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("event_type")]
    ns, k = F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")), F.get_json_object("props", "$.k").cast("long")
    version = F.concat(F.lit("1."), k.cast("string"), F.lit(".0"))
    kind = F.when(F.col("user_id") % 3 == 0, "user").when(F.col("user_id") % 3 == 1, "service-principal")
    return rows.select(F.col("event_id").alias("id"), ns.alias("namespace"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("ts").alias("occurred_at"), action.alias("action"), F.concat(ns, F.lit("@"), version).alias("subject"), version.alias("version"), kind.alias("actor_type"), F.when(F.col("event_id") % 10 == 0, "checked").alias("reason"), F.lit(None).cast("string").alias("diff"))


AUDIT = (
    "audit AS (SELECT event_id AS id, 'n' || (user_id % 5) AS namespace, 'u' || user_id AS actor, ts AS occurred_at, CASE event_type "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ACTIONS.items())
    + """ END AS action, 'n' || (user_id % 5) || '@1.' || (props::JSON->>'$.k') || '.0' AS subject, '1.' || (props::JSON->>'$.k') || '.0' AS version,
  CASE user_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'service-principal' END AS actor_type, CASE WHEN event_id % 10 = 0 THEN 'checked' END AS reason FROM events)"""
)


def access_rows(events: DataFrame) -> DataFrame:
    """Events as accesses to two terms each."""
    k = F.get_json_object("props", "$.k").cast("long")
    term = lambda c: F.concat(F.lit(BASE + "t"), c.cast("string"))
    return events.select(F.col("event_id").alias("id"), F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("namespace"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("ts").alias("occurred_at"), F.array(term(k), term((k * 3) % 11)).alias("terms"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_rows(table(spark, sf_dir, "events"))


ACCESSES = f"""accesses AS (SELECT event_id AS id, 'n' || (user_id % 5) AS namespace, 'u' || user_id AS actor, ts AS occurred_at, unnest(list_distinct(['{BASE}t' || k, '{BASE}t' || (k * 3 % 11)])) AS term_iri
  FROM (SELECT *, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events))"""

PREDICATES = ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers and suppliers of their orders as mappings between five namespaces."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = lines.count()
    pairs = dealt(orders, n, "o_orderkey").join(dealt(lines, n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"))
    pairs = dealt(pairs, n, "a", "b").distinct()
    term = lambda c: F.concat(F.lit("https://e.example/n"), (c % 5).cast("string"), F.lit("#t"), c.cast("string"))
    predicate = F.element_at(F.array(*[F.lit(p) for p in PREDICATES]), ((F.col("a") * F.col("b")) % 5 + 1).cast("int"))
    return pairs.select(F.concat(F.lit("n"), (F.col("a") % 5).cast("string")).alias("namespace"), term(F.col("a")).alias("source_term"), term(F.col("b")).alias("target_term"), predicate.alias("predicate"), F.when(F.col("a") % 2 == 0, "same thing").alias("reason"), F.concat(F.lit("u"), (F.col("b") % 3).cast("string")).alias("declared_by"))


MAPPINGS = """mappings AS (SELECT 'n' || (a % 5) AS namespace, 'https://e.example/n' || (a % 5) || '#t' || a AS source_term, 'https://e.example/n' || (b % 5) || '#t' || b AS target_term,
  ['exactMatch', 'closeMatch', 'broadMatch', 'narrowMatch', 'relatedMatch'][(a * b) % 5 + 1] AS predicate, CASE WHEN a % 2 = 0 THEN 'same thing' END AS reason, 'u' || (b % 3) AS declared_by
  FROM (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey))"""


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of the five namespaces of mappings, from the regions' keys; n1's base is also a prefix of none, n9's of all."""
    r = table(spark, sf_dir, "region").where("r_regionkey < 4")
    own = r.select(F.concat(F.lit("n"), "r_regionkey").alias("ns"), F.concat(F.lit("https://e.example/n"), "r_regionkey", F.lit("#")).alias("base_iri"))
    return own.unionByName(r.where("r_regionkey = 0").select(F.lit("n9").alias("ns"), F.lit("https://e.example/n3").alias("base_iri")))


NAMESPACES = "namespaces AS (SELECT 'n' || r_regionkey AS ns, 'https://e.example/n' || r_regionkey || '#' AS base_iri FROM region WHERE r_regionkey < 4 UNION ALL SELECT 'n9', 'https://e.example/n3')"
