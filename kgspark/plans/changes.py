"""Queries of change between revisions (C of the inventory, and manifests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import lifecycle as C
from kgspark.operators import paths as P
from kgspark.plans import data as D
from kgspark.plans.registry import query

OLD = f"(SELECT s FROM new WHERE p = '{T.DEPRECATED}')"


def both(spark, sf_dir):
    return D.revision(spark, sf_dir, False), D.revision(spark, sf_dir, True)


@query("c01_added_terms", f"WITH {D.REVISIONS} SELECT s AS iri FROM new EXCEPT SELECT s FROM base")
def c01(spark, sf_dir):
    return C.added_terms(*both(spark, sf_dir))


@query("c01_removed_terms", f"WITH {D.REVISIONS} SELECT s AS iri FROM base EXCEPT SELECT s FROM new")
def c01_removed(spark, sf_dir):
    return C.removed_terms(*both(spark, sf_dir))


@query("c02_newly_deprecated", f"WITH {D.REVISIONS} SELECT s AS iri FROM new WHERE p = '{T.DEPRECATED}' EXCEPT SELECT s FROM base WHERE p = '{T.DEPRECATED}'")
def c02(spark, sf_dir):
    return C.newly_deprecated(*both(spark, sf_dir))


def both_described(spark, sf_dir):
    return D.described(spark, sf_dir, False), D.described(spark, sf_dir, True)


def canonical(spark, sf_dir):
    """Both revisions with their blank nodes named by structure."""
    base, new, status = C.canonical_pair(*both_described(spark, sf_dir))
    assert status == "computed"
    return base, new


@query("c03_triple_diff", f"WITH {D.DESCRIBED} SELECT s, p, o, side FROM diff")
def c03(spark, sf_dir):
    return C.triple_diff(*canonical(spark, sf_dir)).select("s", "p", "o", "side")


SHAPE = f"'{D.BASE}C' || p_partkey || 'S'"
COUNT = "CASE p_partkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE 'many' END"
PATH = f"'{D.BASE}q' || (p_partkey % 30)"
NODE = D.bnode_final(D.bnode_name((T.SH + "minCount", f"({COUNT})", "literal"), (T.SH + "path", PATH, "iri")), SHAPE, T.SH + "property")
BARE = D.bnode_final("sha256(chr(31))", SHAPE, T.SH + "targetClass")


@query(
    "c04_canonical_bnodes",
    f"""SELECT {SHAPE} AS s, '{T.TYPE}' AS p, '{T.SH}NodeShape' AS o FROM part UNION ALL SELECT {SHAPE}, '{T.SH}targetClass', CASE WHEN p_partkey % 5 = 0 THEN {BARE} ELSE '{D.BASE}C' || p_partkey END FROM part
  UNION ALL SELECT {SHAPE}, '{T.SH}property', {NODE} FROM part UNION ALL SELECT {NODE}, '{T.SH}path', {PATH} FROM part UNION ALL SELECT {NODE}, '{T.SH}minCount', {COUNT} FROM part""",
)
def c04(spark, sf_dir):
    from kgspark.plans.quality import shaped

    return C.canonical_bnodes(shaped(spark, sf_dir))[0].select("s", "p", "o")


@query("c05_modified_terms", f"WITH {D.DESCRIBED} SELECT s AS iri FROM changed")
def c05(spark, sf_dir):
    return C.modified_terms(*canonical(spark, sf_dir))


@query(
    "c06_diff_summary",
    f"""WITH {D.DESCRIBED}, added AS (SELECT s FROM new EXCEPT SELECT s FROM base), removed AS (SELECT s FROM base EXCEPT SELECT s FROM new), old AS (SELECT s FROM new WHERE p = '{T.DEPRECATED}' EXCEPT SELECT s FROM base WHERE p = '{T.DEPRECATED}'),
  n AS (SELECT (SELECT count(*) FROM added) AS added_count, (SELECT count(*) FROM removed) AS removed_count, (SELECT count(*) FROM old) AS deprecated_count, (SELECT count(*) FROM changed) AS modified_count, (SELECT array_to_string(list(s ORDER BY s)[1:50], ',') FROM added) AS added,
  (SELECT array_to_string(list(s ORDER BY s)[1:50], ',') FROM changed) AS modified, (SELECT count(*) FROM diff WHERE side = 'new') AS triples_added, (SELECT count(*) FROM diff WHERE side = 'base') AS triples_removed)
  SELECT 'computed' AS status, *, added_count > 50 OR removed_count > 50 OR deprecated_count > 50 OR modified_count > 50 AS truncated, triples_added = 0 AND triples_removed = 0 AS "empty" FROM n""",
)
def c06(spark, sf_dir):
    row = C.diff_summary(*both_described(spark, sf_dir))
    schema = "status string, added_count long, removed_count long, deprecated_count long, modified_count long, added array<string>, modified array<string>, triples_added long, triples_removed long, truncated boolean, empty boolean"
    return row.select(F.from_json("summary", schema).alias("x")).select("x.*").withColumns({"added": F.array_join("added", ","), "modified": F.array_join("modified", ",")})


@query("c07_deprecated_terms", f"WITH {D.REVISIONS} SELECT s AS iri FROM new WHERE p = '{T.DEPRECATED}'")
def c07(spark, sf_dir):
    return C.deprecated_terms(D.revision(spark, sf_dir, True))


@query(
    "c08_term_lifecycle",
    f"""WITH {D.REVISIONS} SELECT iri, CASE WHEN iri IN {OLD} THEN 'deprecated' WHEN iri IN (SELECT s FROM new) THEN 'active' ELSE 'absent' END AS status,
  CASE WHEN iri IN {OLD} THEN (SELECT min(o) FROM new WHERE s = iri AND p = '{T.REPLACED_BY}') END AS successor FROM (SELECT DISTINCT s AS iri FROM base)""",
)
def c08(spark, sf_dir):
    base, new = both(spark, sf_dir)
    return C.term_lifecycle(C.subjects(base), new)


@query(
    "c09_check_deprecation",
    f"""WITH {D.REVISIONS} SELECT 'removed' AS kind, s AS iri, NULL::VARCHAR AS other, true AS blocking FROM (SELECT s FROM base EXCEPT SELECT s FROM new)
  UNION ALL SELECT 'no-successor-or-reason', s, NULL, true FROM {OLD} WHERE s NOT IN (SELECT s FROM new WHERE p = '{T.REPLACED_BY}') AND s NOT IN (SELECT s FROM new WHERE p = '{T.COMMENT}' AND trim(o) <> '')
  UNION ALL SELECT DISTINCT 'references-deprecated', s, o, false FROM new WHERE o_kind = 'iri' AND s NOT IN {OLD} AND o IN {OLD} AND p NOT IN ('{T.REPLACES}', '{T.SEE_ALSO}')""",
)
def c09(spark, sf_dir):
    base, new = both(spark, sf_dir)
    return C.check_deprecation(new, base)


@query("c10_mapped_by_others", f"WITH {D.MAPPINGS}, old AS (SELECT 'https://e.example/n0#t' || s_suppkey AS iri FROM supplier WHERE s_suppkey % 10 = 0) SELECT iri, array_to_string(list_sort(list(DISTINCT namespace)), ',') AS namespaces FROM old JOIN mappings ON target_term = iri WHERE namespace <> 'n0' GROUP BY iri")
def c10(spark, sf_dir):
    old = D.table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("https://e.example/n0#t"), F.col("s_suppkey").cast("string")).alias("iri"))
    return C.mapped_by_others(old, D.mappings(spark, sf_dir), "n0").select("iri", F.array_join("namespaces", ",").alias("namespaces"))


TARGET = """targets AS (SELECT *, CASE status WHEN 'approved' THEN CASE WHEN k = 1 THEN 'named-and-default' ELSE 'named' END WHEN 'in-review' THEN 'named' WHEN 'superseded' THEN CASE WHEN k <= 1 THEN 'named' ELSE 'skip-beyond-retain' END END AS target
  FROM (SELECT *, row_number() OVER (PARTITION BY ns, status ORDER BY approved_at DESC NULLS LAST, version DESC) AS k FROM versions))"""


@query("c11_decide_projection", f"WITH {D.VERSIONS}, {TARGET} SELECT ns, version, target FROM targets")
def c11(spark, sf_dir):
    return C.decide_projection(D.versions(spark, sf_dir), 1)


@query(
    "c12_reconcile_plan",
    f"""WITH {D.VERSIONS}, {TARGET}, e AS (SELECT ns, 'urn:g/' || ns || '/' || version AS graph_iri, target <> 'skip-beyond-retain' AS keep FROM targets UNION ALL SELECT DISTINCT ns, '', true FROM targets),
  a AS (SELECT ns, 'urn:g/' || ns || '/' || version AS graph_iri, 3 AS triples FROM versions WHERE id % 3 <> 0 UNION ALL SELECT DISTINCT ns, 'urn:g/' || ns || '/lost', 1 FROM versions WHERE id % 9 = 0 UNION ALL SELECT DISTINCT ns, 'urn:other', 1 FROM versions WHERE id % 17 = 0)
  SELECT * FROM (SELECT ns, graph_iri, CASE WHEN graph_iri = '' THEN CASE WHEN triples IS NULL THEN 'load-default' END WHEN keep AND triples IS NULL THEN 'load' WHEN triples > 0 AND NOT keep THEN 'drop-beyond-retention'
  WHEN triples > 0 AND keep IS NULL THEN CASE WHEN graph_iri LIKE 'urn:g/%' THEN 'drop-residual' ELSE 'foreign' END END AS action FROM e FULL JOIN a USING (ns, graph_iri)) WHERE action IS NOT NULL""",
)
def c12(spark, sf_dir):
    v = D.versions(spark, sf_dir)
    name = F.concat(F.lit("urn:g/"), "ns", F.lit("/"), "version")
    spaces = v.select("ns").distinct()
    expected = C.decide_projection(v, 1).select("ns", name.alias("graph_iri"), (F.col("target") != "skip-beyond-retain").alias("keep")).unionByName(spaces.select("ns", F.lit("").alias("graph_iri"), F.lit(True).alias("keep")))
    actual = v.where("id % 3 <> 0").select("ns", name.alias("graph_iri"), F.lit(3).alias("triples"))
    actual = actual.unionByName(v.where("id % 9 = 0").select("ns", F.concat(F.lit("urn:g/"), "ns", F.lit("/lost")).alias("graph_iri"), F.lit(1).alias("triples")).distinct())
    actual = actual.unionByName(v.where("id % 17 = 0").select("ns", F.lit("urn:other").alias("graph_iri"), F.lit(1).alias("triples")).distinct())
    return C.reconcile_plan(expected, actual, spaces.select("ns", F.concat(F.lit("urn:g/"), "ns", F.lit("/")).alias("graph_prefix"), F.lit(False).alias("retired")))


FILES = """f AS (SELECT ns, id, 'versions/' || ns || '/' || version || '.ttl' AS path FROM versions)"""


@query(
    "c12_reconcile_files",
    f"""WITH {D.VERSIONS}, {FILES} SELECT 'versions/' || ns || '/lost' || id || '.ttl' AS path, NULL::VARCHAR AS ns, 'orphan-blob' AS action FROM f WHERE id % 9 = 0
  UNION ALL SELECT 'versions/gone' || id || '/_state.json', 'gone' || id, 'drop-manifest' FROM f WHERE id % 17 = 0 UNION ALL SELECT 'versions/No_' || id || '/_state.json', 'No_' || id, 'report-manifest' FROM f WHERE id % 19 = 0""",
)
def c12_files(spark, sf_dir):
    v = D.versions(spark, sf_dir)
    path = lambda *parts: F.concat(F.lit("versions/"), *[F.col(x).cast("string") if x in ("ns", "id", "version") else F.lit(x) for x in parts]).alias("path")
    named = v.select("id", "ns", F.concat(F.lit("versions/"), "ns", F.lit("/"), "version", F.lit(".ttl")).alias("blob_path"))
    blobs = named.where("id % 3 <> 0").select(F.col("blob_path").alias("path")).unionByName(v.where("id % 9 = 0").select(path("ns", "/lost", "id", ".ttl")))
    manifests = v.select(path("ns", "/_state.json")).distinct().unionByName(v.where("id % 17 = 0").select(path("gone", "id", "/_state.json"))).unionByName(v.where("id % 19 = 0").select(path("No_", "id", "/_state.json")))
    return C.reconcile_files(named, blobs, manifests, v.select("ns"))


@query("c13_unprojected", f"WITH {D.VERSIONS} SELECT ns, version FROM versions WHERE projected_at IS NULL AND status <> 'draft'")
def c13(spark, sf_dir):
    return C.unprojected(D.versions(spark, sf_dir)).select("ns", "version")


@query(
    "c14_assign_versions",
    """WITH d AS (SELECT source AS ns, doc_id AS seq, sha256(text) AS h FROM documents), f AS (SELECT ns, h, min(seq) AS first_seq FROM d GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY first_seq) AS k FROM f)
  SELECT ns, seq, '1.' || (k - 1) || '.0' AS version, seq > first_seq AS repeated, k = 1 AS recorded FROM d JOIN n USING (ns, h)""",
)
def c14(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select(F.col("source").alias("ns"), F.col("doc_id").alias("seq"), F.col("text").alias("body"), F.lit(None).cast("string").alias("edited_from"))
    return C.assign_versions(docs).select("ns", "seq", "version", "repeated", "recorded")


@query(
    "c14_assign_versions_after_others",
    """WITH d AS (SELECT source AS ns, doc_id AS seq, sha256(text) AS h FROM documents), f AS (SELECT ns, h, min(seq) AS first_seq FROM d WHERE seq % 2 = 0 GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY first_seq) - 1 AS minor FROM f),
  top AS (SELECT ns, max(minor) AS top FROM e GROUP BY ns), g AS (SELECT ns, h, min(seq) AS first_seq FROM d WHERE seq % 2 = 1 GROUP BY ALL), n AS (SELECT g.*, e.minor, top, row_number() OVER (PARTITION BY g.ns, e.minor IS NULL ORDER BY g.first_seq) AS k FROM g LEFT JOIN e USING (ns, h) LEFT JOIN top ON top.ns = g.ns)
  SELECT d.ns, seq, '1.' || coalesce(minor, coalesce(top, -1) + k) || '.0' AS version, minor IS NOT NULL OR seq > first_seq AS repeated, top IS NULL AND k = 1 AS recorded FROM d JOIN n ON n.ns = d.ns AND n.h = d.h WHERE seq % 2 = 1""",
)
def c14_after(spark, sf_dir):
    """Half of the documents are published, then the other half onto that history."""
    docs = D.table(spark, sf_dir, "documents").select(F.col("source").alias("ns"), F.col("doc_id").alias("seq"), F.col("text").alias("body"), F.lit(None).cast("string").alias("edited_from"))
    first = C.assign_versions(docs.where("seq % 2 = 0")).where("not repeated").select("ns", "seq", "version")
    hashes = docs.select("ns", "seq", F.sha2("body", 256).alias("content_hash"))
    there = P.settle(first.join(hashes, ["ns", "seq"]).select("ns", "version", "content_hash", F.col("seq").alias("created_at")))
    return C.assign_versions(docs.where("seq % 2 = 1"), there).select("ns", "seq", "version", "repeated", "recorded")


@query("c15_current_approved", f"WITH {D.VERSIONS} SELECT ns, version FROM versions WHERE status = 'approved' QUALIFY row_number() OVER (PARTITION BY ns ORDER BY approved_at DESC NULLS LAST, version DESC) = 1")
def c15(spark, sf_dir):
    return C.current_approved(D.versions(spark, sf_dir)).select("ns", "version")


@query("c15_latest_for", f"WITH {D.VERSIONS} SELECT ns, arg_max(version, id) AS version FROM versions GROUP BY ns")
def c15_latest(spark, sf_dir):
    return C.latest_for(D.versions(spark, sf_dir), ["ns"], "id").select("ns", "version")


@query(
    "c16_replay_status",
    f"""WITH {D.AUDIT}, st AS (SELECT *, CASE action WHEN 'published' THEN 'draft' WHEN 'submitted' THEN 'in-review' WHEN 'rejected' THEN 'draft' ELSE action END AS state FROM audit),
  l AS (SELECT *, lag(state) OVER (PARTITION BY namespace, version ORDER BY id) AS before FROM st)
  SELECT namespace AS ns, version, arg_max(state, id) AS status, count(*) FILTER (NOT CASE action WHEN 'published' THEN before IS NULL WHEN 'submitted' THEN coalesce(before = 'draft', false) WHEN 'approved' THEN coalesce(before = 'in-review', false)
  WHEN 'superseded' THEN coalesce(before = 'approved', false) ELSE coalesce(before = 'in-review', false) END) AS illegal FROM l GROUP BY ALL""",
)
def c16(spark, sf_dir):
    return C.replay_status(D.audit(spark, sf_dir).withColumnRenamed("namespace", "ns"))


@query(
    "c17_lineage",
    f"""WITH RECURSIVE {D.VERSIONS}, up AS (SELECT ns, version, edited_from AS ancestor, 1 AS depth FROM versions WHERE edited_from IS NOT NULL
  UNION SELECT up.ns, up.version, v.edited_from, depth + 1 FROM up JOIN versions v ON v.ns = up.ns AND v.version = up.ancestor WHERE v.edited_from IS NOT NULL)
  SELECT up.ns, up.version, ancestor, depth, CASE WHEN v.edited_from_recorded THEN v.edited_from IS NULL END AS root FROM up JOIN versions v ON v.ns = up.ns AND v.version = up.ancestor""",
)
def c17(spark, sf_dir):
    return P.lineage(D.versions(spark, sf_dir))


@query(
    "c17_origins",
    f"""WITH RECURSIVE {D.VERSIONS}, up AS (SELECT ns, version, version AS origin, 0 AS depth FROM versions
  UNION SELECT up.ns, up.version, v.edited_from, depth + 1 FROM up JOIN versions v ON v.ns = up.ns AND v.version = up.origin WHERE v.edited_from IS NOT NULL)
  SELECT up.ns, up.version, origin, depth, CASE WHEN v.edited_from_recorded THEN v.edited_from IS NULL END AS root
  FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY ns, version ORDER BY depth DESC) = 1) up JOIN versions v ON v.ns = up.ns AND v.version = origin""",
)
def c17_origins(spark, sf_dir):
    return P.origins(D.versions(spark, sf_dir))


@query("c18_revision_history", "SELECT source AS ns, doc_id AS revision, max(doc_id) OVER (PARTITION BY source) + 1 AS next_revision FROM documents")
def c18(spark, sf_dir):
    rows = D.table(spark, sf_dir, "documents").select(F.col("source").alias("ns"), F.col("doc_id").alias("revision"), F.col("text").alias("body"))
    return C.revision_history(rows)


@query(
    "c19_available_actions",
    f"""WITH {D.VERSIONS}, pair AS (SELECT ns || '@' || version AS version, CASE WHEN id % 5 = 0 THEN 'draft' ELSE status END AS status, created_by, id % 2 = 0 AS two, principal FROM versions CROSS JOIN (VALUES ('u1'), ('u2'), (NULL)) p(principal))
  SELECT version, principal, 'submit' AS action, status = 'draft' AS enabled, CASE WHEN status <> 'draft' THEN 'not-draft' END AS reason FROM pair
  UNION ALL SELECT version, principal, 'approve', status = 'in-review' AND (NOT two OR principal IS NULL OR principal <> created_by), CASE WHEN status = 'draft' THEN 'not-submitted' WHEN status <> 'in-review' THEN 'not-in-review' WHEN NOT two THEN NULL WHEN principal IS NULL THEN 'unknown-principal' WHEN principal = created_by THEN 'own-version' END FROM pair
  UNION ALL SELECT version, principal, 'reject', status = 'in-review', CASE WHEN status <> 'in-review' THEN 'not-in-review' END FROM pair""",
)
def c19(spark, sf_dir):
    status = F.when(F.col("id") % 5 == 0, "draft").otherwise(F.col("status")).alias("status")
    who = F.explode(F.array(F.lit("u1"), F.lit("u2"), F.lit(None))).alias("principal")
    return C.available_actions(D.versions(spark, sf_dir).select(F.concat("ns", F.lit("@"), "version").alias("version"), status, "created_by", (F.col("id") % 2 == 0).alias("two_person"), who))


@query(
    "s09_manifest",
    f"WITH {D.VERSIONS}, {TARGET} SELECT ns, max(version) FILTER (target = 'named-and-default') AS current, count(*) AS n, array_to_string(list(version || ':' || target ORDER BY version, status), ',') AS versions FROM targets GROUP BY ns",
)
def s09(spark, sf_dir):
    rows = C.manifest_json(D.versions(spark, sf_dir), 1)
    schema = "ns string, current string, versions array<struct<version: string, status: string, target: string>>"
    x = rows.select(F.from_json("manifest", schema).alias("x")).select("x.*")
    return x.select("ns", "current", F.size("versions").cast("long").alias("n"), F.array_join(F.transform("versions", lambda v: F.concat(v["version"], F.lit(":"), v["target"])), ",").alias("versions"))
