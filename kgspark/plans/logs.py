"""Queries of logs, provenance, health and streams (L and T of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import crossref as X
from kgspark.operators import health as H
from kgspark.operators import lifecycle as C
from kgspark.operators import logs as L
from kgspark.plans import data as D
from kgspark.plans.registry import query


def log(spark, sf_dir):
    """Conversations as queries: the form, comment and length of each depend on its turn."""
    k = F.col("conv_id") + F.col("turn")
    form = F.element_at(F.array(*[F.lit(x) for x in ("SELECT ?s { ?s ?p '", "ASK { GRAPH ?g { ?s ?p '", "# ask\ncOnStruct { ?s ?p ?o } where { ?s ?p '", "DROP GRAPH <urn:select> # '", "WHAT '")]), (k % 5 + 1).cast("int"))
    body = F.regexp_replace("text", r"['\"<>#\\\n]", " ")
    return D.table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn"), F.col("role"), F.concat(form, F.coalesce(body, F.lit("")), F.lit("' }")).alias("query"), k.alias("k"))


LOG = """log AS (SELECT conv_id, turn, role, ['SELECT ?s { ?s ?p ''', 'ASK { GRAPH ?g { ?s ?p ''', '# ask' || chr(10) || 'cOnStruct { ?s ?p ?o } where { ?s ?p ''', 'DROP GRAPH <urn:select> # ''', 'WHAT ''']
  [(conv_id + turn) % 5 + 1] || coalesce(regexp_replace(text, '[''"<>#\\\\\\n]', ' ', 'g'), '') || ''' }' AS query, conv_id + turn AS k FROM conversations)"""


@query("l01_query_fingerprint", f"WITH {LOG} SELECT conv_id, turn, sha256(query) AS query_hash, left(query, 2000) AS query_text, length(query) > 2000 AS query_truncated FROM log")
def l01(spark, sf_dir):
    return log(spark, sf_dir).select("conv_id", "turn", T.query_fingerprint(F.col("query")).alias("f")).select("conv_id", "turn", "f.*")


@query("l02_l03_l04_query_class", f"WITH {LOG} SELECT conv_id, turn, CASE k % 5 WHEN 0 THEN 'select' WHEN 1 THEN 'ask' WHEN 2 THEN 'construct' ELSE 'unknown' END AS form, k % 5 < 3 AS read_only, k % 5 IN (1, 3) OR regexp_matches(query, '(?i)(^|[^\\w?$:])graph($|\\W)') AS graph_clause FROM log")
def l02(spark, sf_dir):
    q = F.col("query")
    return log(spark, sf_dir).select("conv_id", "turn", T.query_form(q).alias("form"), T.is_read_only(q).alias("read_only"), T.uses_graph_clause(q).alias("graph_clause"))


@query("l05_returned_terms", f"WITH {D.ACCESSES} SELECT id AS query_id, array_to_string(list_sort(list(DISTINCT term_iri)), ',') AS terms FROM accesses GROUP BY id")
def l05(spark, sf_dir):
    cells = D.accesses(spark, sf_dir).select(F.col("id").alias("query_id"), F.explode(F.concat("terms", F.array(F.lit("urn:elsewhere")))).alias("value"))
    kinds = cells.select("query_id", "value", F.lit("iri").alias("type")).unionByName(cells.select("query_id", F.concat("value", F.lit("x")).alias("value"), F.lit("literal").alias("type")))
    return L.returned_terms(kinds, D.BASE).select("query_id", F.array_join("terms", ",").alias("terms"))


@query(
    "l06_access_events",
    f"""WITH {LOG} SELECT conv_id * 1000 + turn AS id, CASE WHEN k % 5 = 0 THEN 3 END AS returned_row_count, CASE WHEN k % 5 = 2 THEN 9 END AS returned_triple_count, CASE WHEN k % 3 <> 0 THEN 2 END AS returned_term_count, CASE WHEN k % 3 = 0 THEN 'db' END AS vkg_source, CASE WHEN k % 3 = 0 THEN 4 END AS vkg_mapping_revision,
  CASE WHEN k % 3 <> 0 THEN '1.0.0' END AS default_graph_version FROM log""",
)
def l06(spark, sf_dir):
    k = F.col("k")
    rows = log(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("n0").alias("namespace"), F.col("role").alias("actor"), F.lit(None).cast("timestamp").alias("occurred_at"), "query", F.lit(3).alias("row_count"), F.lit(9).alias("triple_count"), F.array(F.lit("a"), F.lit("b")).alias("terms"), F.lit("1.0.0").alias("default_graph_version"), F.when(k % 3 == 0, "db").alias("vkg_source"), F.lit(4).alias("vkg_mapping_revision"))
    return L.build_access_events(rows).select("id", "returned_row_count", "returned_triple_count", "returned_term_count", "vkg_source", "vkg_mapping_revision", "default_graph_version")


ACCESS = f"WITH {D.ACCESSES} SELECT namespace, term_iri, count(DISTINCT id) AS access_count, max(occurred_at) AS last_accessed_at FROM accesses GROUP BY ALL"


@query("l07_term_access", ACCESS)
def l07(spark, sf_dir):
    return L.term_access(D.accesses(spark, sf_dir))


@query("l08_page", f"WITH {D.AUDIT} SELECT id, action FROM audit WHERE id < 800 AND occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at < TIMESTAMP '2024-01-20' AND namespace = 'n1' ORDER BY id DESC LIMIT 26")
def l08(spark, sf_dir):
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-03", "2024-01-20"))
    return L.page(D.audit(spark, sf_dir), 25, 800, since, until, namespace="n1").select("id", "action")


@query("l09_decisions", f"WITH {D.AUDIT} SELECT id, action FROM audit WHERE namespace = 'n1' AND subject = 'n1@1.3.0'")
def l09(spark, sf_dir):
    return L.decisions(D.audit(spark, sf_dir), "n1", "n1@1.3.0").select("id", "action")


@query("l10_purge_before", "SELECT event_id AS id FROM events WHERE NOT (user_id % 5 = 2 AND ts < TIMESTAMP '2024-01-15')")
def l10(spark, sf_dir):
    return L.purge_before(D.accesses(spark, sf_dir), "n2", F.lit("2024-01-15").cast("timestamp_ntz"))[0].select("id")


@query("l10_purged_count", "SELECT count(*) AS purged FROM events WHERE user_id % 5 = 2 AND ts < TIMESTAMP '2024-01-15'")
def l10_count(spark, sf_dir):
    return L.purge_before(D.accesses(spark, sf_dir), "n2", F.lit("2024-01-15").cast("timestamp_ntz"))[1]


def health(spark, sf_dir):
    """The namespace n1, with all parts as its terms and all its accesses; the moment is late enough for some terms to be out of use."""
    terms = D.table(spark, sf_dir, "part").select(F.concat(F.lit(D.BASE + "t"), F.col("p_partkey").cast("string")).alias("iri"))
    access = L.term_access(D.accesses(spark, sf_dir).where("namespace = 'n1'"))
    owned = terms.where(F.substring_index("iri", "#t", -1).cast("int") % 3 == 0).select(F.col("iri").alias("term_iri"))
    disputed = X.compare_counterparts(D.mappings(spark, sf_dir)).where("disputed").agg(F.count("*"))
    waiting = C.unprojected(D.versions(spark, sf_dir)).agg(F.count("*"))
    return H.health_report(terms, access, owned, "2024-04-10 00:00:00", "2024-01-01 12:00:00", ("shacl",), disputed_mapping_count=disputed, unprojected_version_count=waiting)


HEALTH = f"""{D.ACCESSES}, {D.MAPPINGS}, {D.VERSIONS}, t AS (SELECT '{D.BASE}t' || p_partkey AS iri, p_partkey % 3 = 0 AS owned FROM part), a AS (SELECT term_iri, max(occurred_at) AS last FROM accesses WHERE namespace = 'n1' GROUP BY 1),
  rows AS (SELECT iri, owned, coalesce(last >= TIMESTAMP '2024-01-11', false) AS recent FROM t LEFT JOIN a ON term_iri = iri)"""
DISPUTED = "(SELECT count(*) FROM mappings m JOIN mappings c ON c.source_term = m.target_term AND c.target_term = m.source_term WHERE c.predicate <> CASE m.predicate WHEN 'broadMatch' THEN 'narrowMatch' WHEN 'narrowMatch' THEN 'broadMatch' ELSE m.predicate END)"


@query("l11_health_report", f"WITH {HEALTH} SELECT count(*) AS term_count, count(*) FILTER (NOT recent) AS unreferenced_count, round(count(*) FILTER (NOT recent) / count(*), 6) AS unreferenced_ratio, count(*) FILTER (NOT owned) AS without_owner_count, 99 AS approval_age_days, NULL::BIGINT AS shacl_violation_count, {DISPUTED} AS disputed_mapping_count, (SELECT count(*) FROM versions WHERE projected_at IS NULL) AS unprojected_version_count FROM rows")
def l11(spark, sf_dir):
    return health(spark, sf_dir).select("term_count", "unreferenced_count", F.round("unreferenced_ratio", 6).alias("unreferenced_ratio"), "without_owner_count", "approval_age_days", "shacl_violation_count", "disputed_mapping_count", "unprojected_version_count")


@query("l12_health_summary", f"WITH {HEALTH} SELECT count(*) AS term_count, array_to_string(list(iri ORDER BY iri) FILTER (NOT recent)[1:20], ',') AS unreferenced_terms, count(*) FILTER (NOT recent) > 20 OR count(*) FILTER (NOT owned) > 20 AS truncated FROM rows")
def l12(spark, sf_dir):
    row = H.health_summary(health(spark, sf_dir), True, 20)
    return row.select("term_count", F.array_join("unreferenced_terms", ",").alias("unreferenced_terms"), "truncated")


@query(
    "l13_prov_triples",
    f"""WITH {D.AUDIT}, e AS (SELECT *, '{L.ACTIVITY}' || id AS act, '{L.AGENT}' || actor AS agent, '{L.REVISION}n1/' || version AS rev FROM audit WHERE namespace = 'n1')
  SELECT '{L.BUNDLE}n1' AS s, '{L.ONT}includes' AS p, act AS o FROM e UNION SELECT act, '{T.TYPE}', '{T.PROV}Activity' FROM e UNION SELECT act, '{T.TYPE}', '{L.ONT}' || CASE action WHEN 'approved' THEN 'Approve' WHEN 'published' THEN 'Publish' WHEN 'rejected' THEN 'Reject' WHEN 'submitted' THEN 'Submit' ELSE 'Supersede' END FROM e
  UNION SELECT act, '{L.ONT}action', action FROM e UNION SELECT act, '{L.ONT}subject', subject FROM e UNION SELECT act, '{T.PROV}endedAtTime', strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') FROM e UNION SELECT agent, '{T.TYPE}', '{T.PROV}Agent' FROM e UNION SELECT agent, '{L.ONT}principalId', actor FROM e
  UNION SELECT act, '{T.PROV}wasAssociatedWith', agent FROM e UNION SELECT act, '{L.ONT}actorType', actor_type FROM e WHERE actor_type IS NOT NULL UNION SELECT act, '{T.COMMENT}', reason FROM e WHERE reason IS NOT NULL
  UNION SELECT act, '{T.PROV}' || CASE WHEN action = 'published' THEN 'generated' ELSE 'used' END, rev FROM e UNION SELECT rev, '{T.TYPE}', '{T.PROV}Entity' FROM e UNION SELECT rev, '{L.ONT}version', version FROM e UNION SELECT rev, '{L.ONT}namespace', 'n1' FROM e
  UNION SELECT agent, '{T.TYPE}', '{T.PROV}' || CASE min(actor_type) WHEN 'user' THEN 'Person' ELSE 'SoftwareAgent' END FROM e GROUP BY agent HAVING count(actor_type) = count(*) AND min(actor_type) = max(actor_type)
  UNION SELECT '{L.BUNDLE}n1', '{T.TYPE}', '{T.PROV}Bundle' UNION SELECT '{L.BUNDLE}n1', '{L.ONT}namespace', 'n1' UNION SELECT '{L.BUNDLE}n1', '{L.ONT}eventCount', CAST(count(*) AS VARCHAR) FROM e UNION SELECT '{L.BUNDLE}n1', '{L.ONT}truncated', 'false' UNION SELECT '{L.BUNDLE}n1', '{L.ONT}exportedAt', '2024-02-01T00:00:00'""",
)
def l13(spark, sf_dir):
    none = D.versions(spark, sf_dir).withColumnRenamed("ns", "namespace")
    return L.prov_triples(D.audit(spark, sf_dir), none, "n1", False, "2024-02-01T00:00:00").select("s", "p", "o")


@query("l14_referenced_versions", f"WITH {D.AUDIT} SELECT DISTINCT namespace, version FROM audit")
def l14(spark, sf_dir):
    return L.referenced_versions(D.audit(spark, sf_dir))


@query(
    "l16_generation_provenance",
    f"SELECT event_id AS id, event_id % 3 = 0 AS generated, CASE WHEN event_id % 6 = 0 THEN event_id % 5 END AS attempts, CASE WHEN event_id % 3 = 0 THEN 'm' || (event_id % 4) END AS model, CASE WHEN event_id % 6 = 0 THEN event_id % 5 >= 3 END AS struggled FROM events",
)
def l16(spark, sf_dir):
    k = F.col("event_id")
    reason = F.when(k % 3 == 0, F.concat(F.lit(T.GENERATED + "(試行 "), F.when(k % 6 == 0, (k % 5).cast("string")).otherwise("?"), F.lit(" 回、model=m"), (k % 4).cast("string"), F.lit(")"))).otherwise("by hand")
    return D.table(spark, sf_dir, "events").select(k.alias("id"), T.generation_provenance(reason).alias("x")).select("id", "x.generated", F.col("x.attempts").cast("long").alias("attempts"), "x.model", "x.struggled")


def _feed(spark, rows, name):
    """A folder, and a stream that reads there what rows holds."""
    from uuid import uuid4

    from kgspark.operators.paths import scratch

    folder = f"{scratch(spark)}/{name}-{uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    return folder, spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


@query("t01_stream_access_enrich", f"WITH {LOG} SELECT conv_id * 1000 + turn AS id, sha256(query) AS query_hash, k % 5 IN (1, 3) OR regexp_matches(query, '(?i)(^|[^\\w?$:])graph($|\\W)') AS used_graph_clause FROM log")
def t01(spark, sf_dir):
    from kgspark.streaming.access import stream_access_enrich

    rows = log(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("n0").alias("namespace"), F.col("role").alias("actor"), F.lit(None).cast("timestamp").alias("occurred_at"), "query", F.lit(0).alias("row_count"), F.lit(0).alias("triple_count"), F.array(F.lit("a")).alias("terms"), F.lit("1").alias("default_graph_version"), F.lit(None).cast("string").alias("vkg_source"), F.lit(None).cast("int").alias("vkg_mapping_revision"))
    folder, stream = _feed(spark, rows, "log")
    run = stream_access_enrich(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "query_hash", "used_graph_clause")


@query("t02_stream_term_access", f"WITH {D.ACCESSES} SELECT namespace, term_iri, count(DISTINCT id) AS access_count, max(occurred_at) AS last_accessed_at FROM accesses GROUP BY ALL")
def t02(spark, sf_dir):
    from kgspark.streaming import access as A

    folder, stream = _feed(spark, D.table(spark, sf_dir, "events"), "events")
    events = D.access_rows(stream).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    A.stream_term_access(events, f"{folder}/out", f"{folder}/checkpoint", "60 days").awaitTermination()
    return A.read_term_access(spark, f"{folder}/out").withColumn("last_accessed_at", F.col("last_accessed_at").cast("timestamp_ntz"))
