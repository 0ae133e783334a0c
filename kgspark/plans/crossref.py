"""Queries of mappings, owners and roles (X of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import crossref as X
from kgspark.plans import data as D
from kgspark.plans.registry import query

OWNER = "CASE WHEN regexp_extract(iri, '/n([0-9])#', 1) IN ('0', '1', '2', '3') THEN 'n' || regexp_extract(iri, '/n([0-9])#', 1) END"


@query("x01_outgoing", f"WITH {D.MAPPINGS} SELECT source_term, target_term FROM mappings WHERE namespace = 'n2'")
def x01(spark, sf_dir):
    return X.outgoing(D.mappings(spark, sf_dir), "n2").select("source_term", "target_term")


@query("x01_incoming", f"WITH {D.MAPPINGS} SELECT namespace, source_term, target_term FROM mappings WHERE namespace <> 'n2' AND starts_with(target_term, 'https://e.example/n2#')")
def x01_incoming(spark, sf_dir):
    return X.incoming(D.mappings(spark, sf_dir), "n2", "https://e.example/n2#").select("namespace", "source_term", "target_term")


INVERSE = "CASE m.predicate WHEN 'broadMatch' THEN 'narrowMatch' WHEN 'narrowMatch' THEN 'broadMatch' ELSE m.predicate END"


@query("x02_compare_counterparts", f"WITH {D.MAPPINGS} SELECT m.source_term, m.target_term, c.predicate AS counterpart_predicate, c.predicate IS NOT NULL AS reciprocal, coalesce(c.predicate <> {INVERSE}, false) AS disputed FROM mappings m LEFT JOIN mappings c ON c.source_term = m.target_term AND c.target_term = m.source_term")
def x02(spark, sf_dir):
    return X.compare_counterparts(D.mappings(spark, sf_dir)).select("source_term", "target_term", "counterpart_predicate", "reciprocal", "disputed")


@query("x03_validate_mappings", f"WITH {D.MAPPINGS}, bad AS (SELECT *, CASE WHEN declared_by = 'u1' THEN 'sameAs' ELSE predicate END AS p, CASE WHEN reason IS NULL THEN 'no scheme' ELSE target_term END AS t FROM mappings) SELECT source_term, t AS target_term, 'predicate' AS violation FROM bad WHERE p = 'sameAs' UNION ALL SELECT source_term, t, 'target-iri' FROM bad WHERE t = 'no scheme' UNION ALL SELECT source_term, t, 'self' FROM bad WHERE source_term = t")
def x03(spark, sf_dir):
    rows = D.mappings(spark, sf_dir).withColumns({"predicate": F.when(F.col("declared_by") == "u1", "sameAs").otherwise(F.col("predicate")), "target_term": F.when(F.col("reason").isNull(), "no scheme").otherwise(F.col("target_term"))})
    return X.validate_mappings(rows).select("source_term", "target_term", "violation")


@query("x04_owning_namespace", f"WITH {D.MAPPINGS}, i AS (SELECT DISTINCT target_term AS iri FROM mappings UNION ALL SELECT 'https://e.example/n3x') SELECT iri, CASE WHEN iri = 'https://e.example/n3x' THEN 'n9' ELSE {OWNER} END AS owner FROM i")
def x04(spark, sf_dir):
    iris = D.mappings(spark, sf_dir).select(F.col("target_term").alias("iri")).distinct().unionByName(spark.createDataFrame([("https://e.example/n3x",)], "iri string"))
    return X.owning_namespace(iris, D.namespaces(spark, sf_dir))


@query(
    "x05_target_lifecycles",
    f"""WITH {D.MAPPINGS}, i AS (SELECT DISTINCT target_term AS iri, CAST(regexp_extract(target_term, 't([0-9]+)$', 1) AS INT) AS k FROM mappings), o AS (SELECT *, {OWNER} AS owner FROM i)
  SELECT iri, owner, CASE WHEN owner IS NULL OR owner IN ('n2', 'n3') THEN 'unknown' WHEN k % 4 = 0 THEN 'deprecated' WHEN k % 4 = 1 THEN 'active' ELSE 'absent' END AS status,
  CASE WHEN owner IS NULL THEN 'external' WHEN owner = 'n3' THEN 'no-permission' WHEN owner = 'n2' THEN 'unreadable' END AS note FROM o""",
)
def x05(spark, sf_dir):
    targets = D.mappings(spark, sf_dir).select(F.col("target_term").alias("iri"))
    k = F.regexp_extract("iri", "t([0-9]+)$", 1).cast("int")
    known = targets.distinct().where(k % 4 < 2).select("iri", F.when(k % 4 == 0, "deprecated").otherwise("active").alias("status"), F.lit(None).cast("string").alias("successor"))
    ns = D.namespaces(spark, sf_dir)
    have = ns.select("ns")
    return X.target_lifecycles(targets, ns, have.where("ns <> 'n3'"), have, have.where("ns <> 'n2'"), known).select("iri", "owner", "status", "note")


@query(
    "x06_resolve_owner",
    """WITH t AS (SELECT 'n' || (p_partkey % 5) AS namespace, 't' || p_partkey AS term_iri, p_partkey AS k FROM part), own AS (SELECT namespace, term_iri, unnest(['u' || (k % 7), 'u' || (k % 3)]) AS u FROM t WHERE k % 4 = 0),
  o AS (SELECT namespace, term_iri, array_to_string(list_sort(list(DISTINCT u)), ',') AS owners FROM own GROUP BY ALL), w AS (SELECT 'n' || r_regionkey AS namespace, 'boss' || r_regionkey AS owners FROM region WHERE r_regionkey < 3)
  SELECT t.namespace, t.term_iri, coalesce(o.owners, w.owners, '') AS owners, CASE WHEN o.owners IS NOT NULL THEN 'term' WHEN w.owners IS NOT NULL THEN 'namespace' ELSE 'unresolved' END AS via FROM t LEFT JOIN o USING (namespace, term_iri) LEFT JOIN w ON w.namespace = t.namespace""",
)
def x06(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    terms = D.table(spark, sf_dir, "part").select(name("n", k % 5).alias("namespace"), name("t", k).alias("term_iri"), k.alias("k"))
    own = terms.where("k % 4 = 0").select("namespace", "term_iri", F.explode(F.array(name("u", F.col("k") % 7), name("u", F.col("k") % 3))).alias("principal_id"))
    roles = D.table(spark, sf_dir, "region").select(name("n", F.col("r_regionkey")).alias("namespace"), name("boss", F.col("r_regionkey")).alias("principal_id"), F.when(F.col("r_regionkey") < 3, "owner").otherwise("steward").alias("role"))
    return X.resolve_owner(terms.drop("k"), own, roles).withColumn("owners", F.array_join("owners", ","))


def grants(spark, sf_dir):
    """Three customers are one principal, each with a grant in a namespace by its remainder; one role is unknown."""
    k = F.col("c_custkey")
    role = F.element_at(F.array(*[F.lit(r) for r in ("analyst", "steward", "maintainer", "owner", "guest")]), (k % 5 + 1).cast("int"))
    return D.table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), (k - k % 3).cast("string")).alias("principal_id"), F.concat(F.lit("n"), (k % 4).cast("string")).alias("namespace"), role.alias("role"))


GRANTS = """g AS (SELECT 'u' || (c_custkey - c_custkey % 3) AS principal_id, 'n' || (c_custkey % 4) AS namespace, c_custkey % 5 AS rank FROM customer),
  best AS (SELECT principal_id, namespace, max(rank) AS rank FROM g WHERE rank < 4 GROUP BY ALL), p AS (SELECT DISTINCT 'u' || (c_custkey - c_custkey % 3) AS principal_id, (c_custkey - c_custkey % 3) % 75 = 0 AS admin FROM customer UNION ALL SELECT 'v' || c_custkey, false FROM customer WHERE c_custkey % 7 = 0),
  roles AS (SELECT principal_id, ns AS namespace, 3 AS rank FROM p CROSS JOIN namespaces WHERE admin UNION ALL SELECT principal_id, namespace, rank FROM best JOIN p USING (principal_id) JOIN namespaces ON ns = namespace WHERE NOT admin)"""


def principals(spark, sf_dir):
    """Those that have grants, an admin among each 25 of them, and some that have none."""
    k, c = F.col("c_custkey"), D.table(spark, sf_dir, "customer")
    some = c.select(F.concat(F.lit("u"), (k - k % 3).cast("string")).alias("principal_id"), ((k - k % 3) % 75 == 0).alias("platform_admin")).distinct()
    return some.unionByName(c.where(k % 7 == 0).select(F.concat(F.lit("v"), k.cast("string")).alias("principal_id"), F.lit(False).alias("platform_admin")))


@query("x07_effective_role", f"WITH {D.NAMESPACES}, {GRANTS} SELECT principal_id, namespace, ['analyst', 'steward', 'maintainer', 'owner'][rank + 1] AS role, rank >= 2 AS maintains FROM roles")
def x07(spark, sf_dir):
    rows = X.effective_role(principals(spark, sf_dir), grants(spark, sf_dir), D.namespaces(spark, sf_dir))
    return rows.withColumn("maintains", X.covers(F.col("role"), "maintainer"))


@query("x08_upsert", "SELECT o_custkey AS k, arg_max(o_orderkey, o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 3 = 0) > 0 AND max(o_orderkey) FILTER (o_orderkey % 3 = 0) = max(o_orderkey) UNION ALL SELECT o_custkey, coalesce(max(o_orderkey) FILTER (o_orderkey % 3 = 0), max(o_orderkey)) FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 GROUP BY o_custkey HAVING NOT (count(*) FILTER (o_orderkey % 3 = 0) > 0 AND max(o_orderkey) FILTER (o_orderkey % 3 = 0) = max(o_orderkey))")
def x08(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    current = rows.where("v % 5 = 0 and v % 3 <> 0").groupBy("k").agg(F.max("v").alias("v"))
    return X.upsert(current, rows.where("v % 3 = 0"), ["k"], "v")


@query(
    "x09_mapping_triples",
    f"""WITH {D.MAPPINGS}, m AS (SELECT *, '{X.MAPPING_BASE}' || namespace || '/' || replace(replace(replace(source_term, ':', '%3A'), '/', '%2F'), '#', '%23') || '/' || replace(replace(replace(target_term, ':', '%3A'), '/', '%2F'), '#', '%23') AS node FROM mappings)
  SELECT source_term AS s, '{T.SKOS}' || predicate AS p, target_term AS o FROM m UNION SELECT '{X.MAPPING_BASE}export', '{X.MAPPING_ONT}includes', node FROM m UNION SELECT node, '{T.TYPE}', '{X.MAPPING_ONT}Mapping' FROM m
  UNION SELECT node, '{X.MAPPING_ONT}source', source_term FROM m UNION SELECT node, '{X.MAPPING_ONT}target', target_term FROM m UNION SELECT node, '{X.MAPPING_ONT}predicate', '{T.SKOS}' || predicate FROM m UNION SELECT node, '{X.MAPPING_ONT}declaredIn', namespace FROM m
  UNION SELECT node, '{X.MAPPING_ONT}declaredBy', declared_by FROM m UNION SELECT node, '{T.COMMENT}', reason FROM m WHERE reason IS NOT NULL UNION SELECT '{X.MAPPING_BASE}export', '{T.TYPE}', '{X.MAPPING_ONT}MappingExport' UNION SELECT '{X.MAPPING_BASE}export', '{X.MAPPING_ONT}mappingCount', CAST(count(*) AS VARCHAR) FROM m""",
)
def x09(spark, sf_dir):
    return X.mapping_triples(D.mappings(spark, sf_dir)).select("s", "p", "o")


@query("x10_visible_namespaces", f"WITH {D.NAMESPACES}, {GRANTS} SELECT principal_id, coalesce(array_to_string(list_sort(list(DISTINCT namespace) FILTER (namespace IS NOT NULL)), ','), '') AS namespaces FROM p LEFT JOIN roles USING (principal_id) GROUP BY principal_id")
def x10(spark, sf_dir):
    rows = X.visible_namespaces(principals(spark, sf_dir), grants(spark, sf_dir), D.namespaces(spark, sf_dir))
    return rows.select("principal_id", F.array_join("namespaces", ",").alias("namespaces"))
