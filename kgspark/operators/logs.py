"""Access logs, audit trails and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import terms as T

# The provenance vocabulary, activity types by action, and page sizes.
ONT, REVISION, ACTIVITY, AGENT, BUNDLE = "urn:ontology:prov#", "urn:ontology:revision/", "urn:ontology:activity/", "urn:ontology:agent/", "urn:ontology:provenance/"
ACTIVITY_TYPES = {"access-log-purged": "PurgeAccessLog", "approved": "Approve", "mapping-declared": "DeclareMapping", "mapping-revoked": "RevokeMapping", "published": "Publish", "questions-revised": "ReviseQuestions", "rejected": "Reject", "scan-source-registered": "RegisterScanSource", "scan-source-removed": "RemoveScanSource", "submitted": "Submit", "superseded": "Supersede"}
VERSION_ACTIONS = ("approved", "published", "rejected", "submitted", "superseded")
AGENT_CLASSES = {"user": "Person", "service-principal": "SoftwareAgent"}
DEFAULT_PAGE, MAX_PAGE = 50, 500


def returned_terms(cells: DataFrame, base: str) -> DataFrame:
    """query_id and the sorted distinct IRIs under the base in its cells of type iri. An empty base has none."""
    own = cells.where((F.col("type") == "iri") & F.col("value").startswith(base) & F.lit(base != ""))
    return own.groupBy("query_id").agg(F.array_sort(F.collect_set("value")).alias("terms"))


def build_access_events(log: DataFrame) -> DataFrame:
    """The access event of each logged query.

    log: id, namespace, actor, occurred_at, query, row_count, triple_count, terms, default_graph_version, vkg_source,
    vkg_mapping_revision. SELECT has a row count, CONSTRUCT and DESCRIBE a triple count, ASK neither: null is not zero.
    Queries of a virtual graph carry its source and revision, and no terms.
    """
    form, virtual = T.query_form(F.col("query")), F.col("vkg_source").isNotNull()
    return log.withColumn("_f", T.query_fingerprint(F.col("query"))).select(
        "id", "namespace", "actor", "occurred_at", "_f.*", F.when(~virtual, F.col("default_graph_version")).alias("default_graph_version"), T.uses_graph_clause(F.col("query")).alias("used_graph_clause"),
        F.when(form == "select", F.col("row_count")).alias("returned_row_count"), F.when(form.isin("construct", "describe"), F.col("triple_count")).alias("returned_triple_count"),
        F.when(~virtual & F.col("terms").isNotNull(), F.size("terms")).alias("returned_term_count"), F.when(~virtual, F.col("terms")).alias("terms"), "vkg_source", F.when(virtual, F.col("vkg_mapping_revision")).alias("vkg_mapping_revision"),
    )


def term_access(events: DataFrame) -> DataFrame:
    """namespace, term_iri, access_count (one a query) and last_accessed_at from events (id, namespace, occurred_at, terms)."""
    rows = events.select("namespace", "id", "occurred_at", F.explode(F.array_distinct("terms")).alias("term_iri"))
    return rows.groupBy("namespace", "term_iri").agg(F.countDistinct("id").alias("access_count"), F.max("occurred_at").alias("last_accessed_at"))


def page(rows: DataFrame, limit: int | None = None, cursor: int | None = None, since=None, until=None, time: str = "occurred_at", **equal) -> DataFrame:
    """The newest rows by id below the cursor, one more than the limit (that there is more). since counts, until doesn't."""
    n = max(1, min(MAX_PAGE, DEFAULT_PAGE if limit is None else limit))
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    if cursor is not None:
        rows = rows.where(F.col("id") < cursor)
    if since is not None:
        rows = rows.where(F.col(time) >= since)
    if until is not None:
        rows = rows.where(F.col(time) < until)
    return rows.orderBy(F.desc("id")).limit(n + 1)


def decisions(audit: DataFrame, namespace: str, subject: str) -> DataFrame:
    return audit.where((F.col("namespace") == namespace) & (F.col("subject") == subject)).orderBy("occurred_at", "id")


def purge_before(events: DataFrame, namespace: str, before) -> tuple[DataFrame, DataFrame]:
    """Events that stay, and one row with the number that goes. Aggregates made from them before stay as they are."""
    gone = (F.col("namespace") == namespace) & (F.col("occurred_at") < before)
    return events.where(~F.coalesce(gone, F.lit(False))), events.where(gone).agg(F.count("*").alias("purged"))


def subject_version(namespace: Column, subject: Column) -> Column:
    """The version in a subject of the form namespace@version, else null."""
    tail = F.when(subject.startswith(F.concat(namespace, F.lit("@"))), F.substring(subject, F.length(namespace) + 2, F.lit(2**31 - 1)))
    return F.when(T.valid_version(tail), tail)


def referenced_versions(audit: DataFrame) -> DataFrame:
    """Distinct namespace and version that version actions name."""
    found = audit.where(F.col("action").isin(*VERSION_ACTIONS)).select("namespace", subject_version(F.col("namespace"), F.col("subject")).alias("version"))
    return found.where("version is not null").distinct()


def prov_triples(audit: DataFrame, versions: DataFrame, namespace: str, truncated: bool, exported_at: str) -> DataFrame:
    """Distinct (s, p, o, o_kind) of a namespace's audit events as PROV-O.

    Publishing generates a revision, other version actions use one. An agent has a subclass only if all of its events
    carry the same known type; a null type was never asked for and is not `unknown`. Lineage of a revision is given only
    if its row is there, and a parent only if recorded.
    """
    events = audit.where(F.col("namespace") == namespace)
    own = F.lit(namespace)
    bundle, activity = F.concat(F.lit(BUNDLE), T.percent_encode(own)), F.concat(F.lit(ACTIVITY), F.col("id").cast("string"))
    agent = F.concat(F.lit(AGENT), T.percent_encode(F.col("actor")))
    revision = lambda v: F.concat(F.lit(REVISION), T.percent_encode(own), F.lit("/"), T.percent_encode(v))
    ont, prov, rdf_type = (lambda x: F.lit(ONT + x)), (lambda x: F.lit(T.PROV + x)), F.lit(T.TYPE)
    triple = lambda s, p, o, kind="literal": F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))
    flat = lambda df, *ts: df.select(F.explode(F.array(*ts)).alias("t")).select("t.*").where("s is not null and o is not null")
    time = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss")

    kinds = events.groupBy("actor").agg(F.collect_set(F.coalesce("actor_type", F.lit("?"))).alias("kinds"))
    table = F.create_map(*[x for k, v in AGENT_CLASSES.items() for x in (F.lit(k), prov(v))])
    classes = kinds.where(F.size("kinds") == 1).select("actor", F.element_at(table, F.col("kinds")[0]).alias("cls"))
    types = F.create_map(*[x for k, v in ACTIVITY_TYPES.items() for x in (F.lit(k), ont(v))])
    version = F.when(F.col("action").isin(*VERSION_ACTIONS), subject_version(F.col("namespace"), F.col("subject")))
    out = flat(
        events.withColumn("version", version),
        triple(bundle, ont("includes"), activity, "iri"), triple(activity, rdf_type, prov("Activity"), "iri"), triple(activity, rdf_type, F.element_at(types, F.col("action")), "iri"),
        triple(activity, ont("action"), F.col("action")), triple(activity, ont("subject"), F.col("subject")), triple(activity, prov("endedAtTime"), time), triple(agent, rdf_type, prov("Agent"), "iri"),
        triple(agent, ont("principalId"), F.col("actor")), triple(activity, prov("wasAssociatedWith"), agent, "iri"), triple(activity, ont("actorType"), F.col("actor_type")),
        triple(activity, F.lit(T.COMMENT), F.nullif(F.col("reason"), F.lit(""))), triple(activity, ont("diffSummary"), F.col("diff")),
        triple(activity, F.when(F.col("action") == "published", prov("generated")).otherwise(prov("used")), revision(F.col("version")), "iri"),
        triple(revision(F.col("version")), rdf_type, prov("Entity"), "iri"), triple(revision(F.col("version")), ont("version"), F.col("version")), triple(revision(F.col("version")), ont("namespace"), F.when(F.col("version").isNotNull(), own)),
    )
    out = out.unionByName(flat(classes, triple(agent, rdf_type, F.col("cls"), "iri")))
    named = versions.where(F.col("namespace") == namespace).join(referenced_versions(events), ["namespace", "version"], "left_semi")
    parent = F.when(F.col("edited_from_recorded"), F.col("edited_from"))
    out = out.unionByName(flat(named, triple(revision(F.col("version")), ont("editedFromRecorded"), F.col("edited_from_recorded")), triple(revision(F.col("version")), prov("wasDerivedFrom"), revision(parent), "iri"), triple(revision(parent), rdf_type, prov("Entity"), "iri"), triple(revision(parent), ont("version"), parent), triple(revision(parent), ont("namespace"), F.when(parent.isNotNull(), own))))
    count = events.agg(F.count("*").alias("n"))
    out = out.unionByName(flat(count, triple(bundle, rdf_type, prov("Bundle"), "iri"), triple(bundle, ont("namespace"), own), triple(bundle, ont("eventCount"), F.col("n")), triple(bundle, ont("truncated"), F.lit(truncated)), triple(bundle, ont("exportedAt"), F.lit(exported_at))))
    return out.distinct()
