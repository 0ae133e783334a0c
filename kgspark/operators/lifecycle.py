"""Change between revisions: differences, deprecation, retention, reconciliation and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators.paths import dealt, path_star, settle
from kgspark.sources.quads import TERM

TRIPLE = ("s", "s_kind", "p", *TERM)
MAX_TERMS = 50


def subjects(quads: DataFrame) -> DataFrame:
    return quads.where("s_kind = 'iri'").select(F.col("s").alias("iri")).distinct()


def added_terms(base: DataFrame, new: DataFrame) -> DataFrame:
    return subjects(new).join(subjects(base), "iri", "left_anti")


def removed_terms(base: DataFrame, new: DataFrame) -> DataFrame:
    return added_terms(new, base)


def deprecated_terms(quads: DataFrame) -> DataFrame:
    """IRI subjects that are deprecated: the value false says nothing."""
    return quads.where((F.col("p") == T.DEPRECATED) & (F.col("s_kind") == "iri") & T.is_true(F.col("o"), F.col("o_kind"))).select(F.col("s").alias("iri")).distinct()


def newly_deprecated(base: DataFrame, new: DataFrame) -> DataFrame:
    return deprecated_terms(new).join(deprecated_terms(base), "iri", "left_anti")


def canonical_bnodes(quads: DataFrame, max_bnodes: int | None = None) -> tuple[DataFrame, str]:
    """Triples with blank nodes renamed by structure and place, and the status: computed, skipped-shared or skipped-too-many.

    From the leaves up, a blank node gets the hash of its sorted triples. From the roots down, its name becomes the hash of
    that, its parent's name, the predicate and a number among equal siblings; so equal nodes in different places stay apart,
    and no triple is lost. It is exact for trees only: a blank node with two parents, or on a cycle, skips the whole. Skipped
    triples are as they were. Hashing has no limit of nodes, as a search for isomorphisms has; max_bnodes sets one for
    callers that want it.
    """
    return _canonical(quads.select(*TRIPLE), (), F.lit(0), max_bnodes)


def canonical_pair(base: DataFrame, new: DataFrame, max_bnodes: int | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Both graphs' triples with blank nodes renamed, as canonical_bnodes() does, in one pass; and the status of the two."""
    own = lambda c, side: F.when(F.col(f"{c}_kind") == "bnode", F.concat(F.lit(f"{side} "), c)).otherwise(F.col(c)).alias(c)
    mark = lambda df, side: df.select(own("s", side), "s_kind", "p", own("o", side), "o_kind", "o_dt", "o_lang", F.lit(side).alias("side"))
    both, status = _canonical(mark(base, "base").unionByName(mark(new, "new")), ("side",), F.substring_index("node", " ", 1), max_bnodes)
    if status != "computed":
        return base.select(*TRIPLE), new.select(*TRIPLE), status
    both = settle(both)
    return both.where("side = 'base'").drop("side"), both.where("side = 'new'").drop("side"), status


def _canonical(triples: DataFrame, keep: tuple[str, ...], graph: Column, max_bnodes: int | None) -> tuple[DataFrame, str]:
    """canonical_bnodes of one or more graphs; graph tells a node's graph, and the columns keep stay."""
    columns = [c for c in triples.columns if c not in keep]
    rows = settle(dealt(triples, triples.count(), *columns).distinct())
    n = rows.count()
    parents = rows.where("o_kind = 'bnode'").select(F.col("o").alias("node"), "s", "s_kind", "p")
    nodes = rows.where("s_kind = 'bnode'").select(F.col("s").alias("node")).unionByName(parents.select("node")).distinct()
    if max_bnodes is not None and not nodes.groupBy(graph.alias("graph")).count().where(F.col("count") > max_bnodes).isEmpty():
        return rows, "skipped-too-many"
    if not dealt(parents, n, "node").groupBy("node").count().where("count > 1").isEmpty():
        return rows, "skipped-shared"
    places = _places(dealt(nodes, n, "node").join(dealt(parents, n, "node"), "node", "left"), n)
    if places is None:
        return rows, "skipped-shared"
    deepest = places.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows, "computed"
    names = _structure(rows, places, deepest, n)
    same = Window.partitionBy("name", graph, "s", "p").orderBy("node")  # equal siblings, whose subtrees are equal too
    named = dealt(places, n, "node").join(dealt(names, n, "node"), "node")
    numbered_ = settle(dealt(named, n, "name", "s", "p").withColumn("k", F.row_number().over(same)))
    final = None
    for depth in range(deepest + 1):
        own = numbered_.where(F.col("depth") == depth)
        if final is None:
            own = own.withColumn("parent", F.col("s"))
        else:
            own = dealt(own, n, "s").join(dealt(level.select(F.col("node").alias("s"), F.col("final").alias("parent")), n, "s"), "s")
        place = [F.coalesce(c, F.lit("")) for c in (F.col("parent"), F.col("p"))]
        level = own.select("node", F.sha2(F.concat_ws("\x1f", "name", *place, F.col("k").cast("string")), 256).alias("final"))
        level = settle(level) if depth < deepest else level
        final = level if final is None else final.unionByName(level)
    final = settle(final)
    out = rows
    for c in ("s", "o"):  # blank nodes alone are looked up: many triples share a class or a value
        found = dealt(final.select(F.col("node").alias(c), "final"), n, c)
        blank, others = (out.where(F.col(f"{c}_kind").eqNullSafe(F.lit("bnode")) == x) for x in (True, False))
        blank = dealt(blank, n, c).join(found, c, "left").withColumn(c, F.coalesce("final", c))
        out = others.select(rows.columns).unionByName(blank.select(rows.columns))
    return out.select("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", *keep), "computed"


def _places(nodes: DataFrame, n: int) -> DataFrame | None:
    """node, s, p (its parent and the way there, if any) and depth: how many blank nodes are above. None where nodes are on a cycle.

    Each round looks twice as far up as the one before it.
    """
    above = F.when(F.col("s_kind") == "bnode", F.col("s"))
    at = settle(nodes.select("node", "s", "p", above.alias("up"), F.when(above.isNotNull(), 1).otherwise(0).alias("depth")))
    far = 1
    while True:
        total, waiting = at.agg(F.count("*"), F.count("up")).first()
        if not waiting:
            return at.drop("up")
        if far > total:
            return None
        higher = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = dealt(at.where("up is not null"), n, "up").join(dealt(higher, n, "up"), "up", "left")  # nodes at the top, often most, stay
        moved = moved.select("node", "s", "p", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        at = settle(at.where("up is null").select(moved.columns).unionByName(moved))
        far *= 2


def _structure(rows: DataFrame, places: DataFrame, deepest: int, n: int) -> DataFrame:
    """node and name: the hash of its sorted triples, with blank objects by their names, from the deepest nodes up."""
    triples = rows.where("s_kind = 'bnode'").select("s", "p", "o", "o_kind", "o_dt", "o_lang")
    own = settle(dealt(places.select(F.col("node").alias("s"), "depth"), n, "s").join(dealt(triples, n, "s"), "s", "left"))
    names = None
    for depth in range(deepest, -1, -1):
        lines = own.where(F.col("depth") == depth).withColumn("value", F.col("o"))
        if names is not None:  # only blank objects are looked up: many nodes share a value
            blank, others = (lines.where(F.col("o_kind").eqNullSafe(F.lit("bnode")) == x) for x in (True, False))
            blank = dealt(blank, n, "o").join(dealt(level.select(F.col("node").alias("o"), "name"), n, "o"), "o", "left").withColumn("value", F.col("name"))
            lines = others.unionByName(blank.select(lines.columns))
        line = F.concat_ws("\x1f", "p", "value", "o_kind", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit("")))
        level = settle(dealt(lines.select("s", "p", "value", "o_kind", "o_dt", "o_lang"), n, "s").groupBy(F.col("s").alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("name")))
        names = level if names is None else names.unionByName(level)
    return names


def triple_diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """TRIPLE columns and side (base or new) of each triple in one graph alone. Blank nodes must be canonical; repeated triples are one."""
    both = base.select(*TRIPLE, F.lit(1).alias("side")).unionByName(new.select(*TRIPLE, F.lit(2).alias("side")))
    sides = dealt(both, both.count(), *TRIPLE).groupBy(*TRIPLE).agg(F.bit_or("side").alias("side")).where("side < 3")
    return sides.withColumn("side", F.when(F.col("side") == 1, "base").otherwise("new"))


def touched_terms(changed: DataFrame, whole: DataFrame) -> DataFrame:
    """IRIs that own changed triples, through any number of blank nodes. whole: both graphs' triples.

    Only what is above changed blank nodes is walked.
    """
    changed = settle(changed.select("s", "s_kind").distinct())
    direct = changed.where("s_kind = 'iri'").select(F.col("s").alias("iri"))
    inner = changed.where("s_kind = 'bnode'").select(F.col("s").alias("src"))
    links = settle(whole.where("o_kind = 'bnode'").select("s", "s_kind", "o").distinct())
    above = path_star(links.where("s_kind = 'bnode'").select(F.col("o").alias("src"), F.col("s").alias("dst")), inner)
    owners = links.where("s_kind = 'iri'").join(above.select(F.col("dst").alias("o")).distinct(), "o", "left_semi").select(F.col("s").alias("iri"))
    return direct.unionByName(owners).distinct()


def modified_terms(base: DataFrame, new: DataFrame) -> DataFrame:
    """Terms in both graphs that own a changed triple."""
    return _modified(base, new, triple_diff(base, new), subjects(base), subjects(new))


def _modified(base: DataFrame, new: DataFrame, changed: DataFrame, old: DataFrame, now: DataFrame) -> DataFrame:
    """modified_terms, given the changed triples and the subjects of both graphs."""
    touched = touched_terms(changed, base.select(*TRIPLE).unionByName(new.select(*TRIPLE)))
    return touched.join(old, "iri", "left_semi").join(now, "iri", "left_semi")


def diff_summary(base: DataFrame, new: DataFrame, max_terms: int = MAX_TERMS, max_bnodes: int | None = None) -> DataFrame:
    """One row: a JSON summary with counts, the first terms of each list, truncated, and status.

    Triple counts and modified terms are null where blank nodes could not be made canonical; then `empty` is false. Only
    the first max_terms of each list come together in the row. The difference and each list are made once and written, and then
    counted and shown from there.
    """
    a, b, status = canonical_pair(base, new, max_bnodes)
    done = status == "computed"
    old, now = settle(subjects(a)), settle(subjects(b))
    lists = {"added": now.join(old, "iri", "left_anti"), "removed": old.join(now, "iri", "left_anti"), "deprecated": newly_deprecated(a, b)}
    if done:
        changed = settle(triple_diff(a, b).select("s", "s_kind", "side"))
        lists["modified"] = _modified(a, b, changed, old, now)
    lists = {name: settle(df) for name, df in lists.items()}
    row = base.sparkSession.range(1).select()
    for name, df in lists.items():
        shown = df.orderBy("iri").limit(max_terms).agg(F.array_sort(F.collect_list("iri")).alias(name))
        row = row.crossJoin(df.agg(F.count("*").alias(f"{name}_count"))).crossJoin(shown)
    if done:
        row = row.crossJoin(changed.agg(F.count_if(F.col("side") == "new").alias("triples_added"), F.count_if(F.col("side") == "base").alias("triples_removed")))
    else:
        unknown = F.lit(None).cast("long")
        row = row.withColumns({"modified_count": unknown, "modified": F.lit(None).cast("array<string>"), "triples_added": unknown, "triples_removed": unknown})
    names = ("added", "removed", "deprecated", "modified")
    fields = [F.lit(status).alias("status"), *[x for n in names for x in (f"{n}_count", n)]]
    cut = [F.coalesce(F.col(f"{n}_count") > max_terms, F.lit(False)) for n in names]
    truncated = cut[0] | cut[1] | cut[2] | cut[3]
    empty = F.coalesce((F.col("triples_added") == 0) & (F.col("triples_removed") == 0), F.lit(False))
    return row.select(F.to_json(F.struct(*fields, "triples_added", "triples_removed", truncated.alias("truncated"), empty.alias("empty")), {"ignoreNullFields": "false"}).alias("summary"))


def term_lifecycle(iris: DataFrame, quads: DataFrame | None) -> DataFrame:
    """iri, status and successor: deprecated (with the smallest successor IRI), active, absent; unknown without a graph."""
    if quads is None:
        return iris.select("iri", F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("successor"))
    old = deprecated_terms(quads).withColumn("old", F.lit(True))
    here = subjects(quads).withColumn("here", F.lit(True))
    after = quads.where((F.col("p") == T.REPLACED_BY) & (F.col("o_kind") == "iri")).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("next"))
    rows = iris.select("iri").distinct().join(old, "iri", "left").join(here, "iri", "left").join(after, "iri", "left")
    return rows.select("iri", F.when(F.col("old"), "deprecated").when(F.col("here"), "active").otherwise("absent").alias("status"), F.when(F.col("old"), F.col("next")).alias("successor"))


def check_deprecation(new: DataFrame, base: DataFrame) -> DataFrame:
    """kind, iri, other and blocking of each problem.

    removed, and no-successor-or-reason (a blank comment is none) block; references-deprecated warns: a living IRI subject
    points to a deprecated term by anything but dcterms:replaces and rdfs:seeAlso.
    """
    gone = removed_terms(base, new).select(F.lit("removed").alias("kind"), "iri", F.lit(None).cast("string").alias("other"), F.lit(True).alias("blocking"))
    old = deprecated_terms(new)
    next_ = new.where((F.col("p") == T.REPLACED_BY) & (F.col("o_kind") == "iri")).select(F.col("s").alias("iri"))
    reason = new.where((F.col("p") == T.COMMENT) & (F.col("o_kind") == "literal") & (F.trim("o") != "")).select(F.col("s").alias("iri"))
    bare = old.join(next_.unionByName(reason), "iri", "left_anti").select(F.lit("no-successor-or-reason").alias("kind"), "iri", F.lit(None).cast("string").alias("other"), F.lit(True).alias("blocking"))
    uses = new.where((F.col("s_kind") == "iri") & (F.col("o_kind") == "iri") & ~F.col("p").isin(T.REPLACES, T.SEE_ALSO)).select(F.col("s").alias("iri"), F.col("o").alias("other")).distinct()
    refs = uses.join(old, "iri", "left_anti").join(old.select(F.col("iri").alias("other")), "other", "left_semi")
    return gone.unionByName(bare).unionByName(refs.select(F.lit("references-deprecated").alias("kind"), "iri", "other", F.lit(False).alias("blocking")))


def mapped_by_others(deprecated: DataFrame, mappings: DataFrame, ns: str) -> DataFrame:
    """iri and namespaces (sorted) of deprecated terms that other namespaces' mappings point to."""
    foreign = mappings.where(F.col("namespace") != ns).select("namespace", F.col("target_term").alias("iri"))
    return foreign.join(deprecated.select("iri").distinct(), "iri").groupBy("iri").agg(F.array_sort(F.collect_set("namespace")).alias("namespaces"))


def decide_projection(versions: DataFrame, retain_superseded: int) -> DataFrame:
    """ns, version and target of each revision. The newest approved one is current (a missing date is the oldest)."""
    newest = Window.partitionBy("ns", "status").orderBy(F.desc_nulls_last("approved_at"), F.desc("version"))
    at, status = F.col("_at"), F.col("status")
    target = F.when(status == "approved", F.when(at == 1, "named-and-default").otherwise("named")).when(status == "in-review", "named").when(status == "superseded", F.when(at <= max(0, retain_superseded), "named").otherwise("skip-beyond-retain")).when(status == "draft", "skip-draft").when(status == "rejected", "skip-rejected")
    return versions.withColumn("_at", F.row_number().over(newest)).select("ns", "version", target.alias("target"))


def current_approved(versions: DataFrame, by: str = "approved_at") -> DataFrame:
    """One row a namespace: its newest approved revision by date, or the first by id (by='id')."""
    order = (F.desc_nulls_last("approved_at"), F.desc("version")) if by == "approved_at" else (F.asc("id"),)
    return versions.where("status = 'approved'").withColumn("_at", F.row_number().over(Window.partitionBy("ns").orderBy(*order))).where("_at = 1").drop("_at")


def latest_for(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order of each key."""
    struct = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(struct, order).alias("_row")).select("_row.*")


def revision_history(rows: DataFrame, key: str = "ns") -> DataFrame:
    """Revisions newest first, without the body, with the key's next free number."""
    return rows.drop("body").withColumn("next_revision", F.max("revision").over(Window.partitionBy(key)) + 1).orderBy(key, F.desc("revision"))


def manifest_json(versions: DataFrame, retain_superseded: int, retired: DataFrame | None = None) -> DataFrame:
    """ns and manifest (JSON: current, and each projected or skipped revision but drafts). A retired namespace has no current one."""
    rows = versions.join(decide_projection(versions, retain_superseded), ["ns", "version"])
    gone = F.lit(False)
    if retired is not None:
        rows = rows.join(retired.select("ns", F.lit(True).alias("_gone")).distinct(), "ns", "left")
        gone = F.coalesce("_gone", F.lit(False))
    current = F.max(F.when((F.col("target") == "named-and-default") & ~gone, F.col("version")))
    entry = F.when(F.col("status") != "draft", F.struct("version", "status", "target"))
    grouped = rows.groupBy("ns").agg(current.alias("current"), F.array_sort(F.collect_list(entry)).alias("versions"))
    return grouped.select("ns", F.to_json(F.struct("ns", "current", "versions"), {"ignoreNullFields": "false"}).alias("manifest"))


def unprojected(versions: DataFrame) -> DataFrame:
    return versions.where("projected_at is null and status <> 'draft'")


def reconcile_plan(expected: DataFrame, actual: DataFrame, namespaces: DataFrame) -> DataFrame:
    """ns, graph_iri and action where a store differs from what should be there.

    expected: ns, graph_iri, keep (false: beyond retention); actual: ns, graph_iri, triples; graph_iri '' is the default
    graph. namespaces: ns, graph_prefix, retired. Actions: load, drop-beyond-retention, drop-residual (own prefix),
    foreign (reported only), load-default (empty default graph), drop-retired, orphan-dataset (unknown namespace).
    """
    both = expected.select("ns", "graph_iri", "keep").join(actual.select("ns", "graph_iri", "triples"), ["ns", "graph_iri"], "full_outer").join(namespaces, "ns", "left")
    here, want = F.coalesce("triples", F.lit(0)) > 0, F.coalesce("keep", F.lit(False))
    action = (
        F.when(F.col("graph_prefix").isNull(), F.when(F.col("triples").isNotNull(), "orphan-dataset")).when(F.col("retired"), F.when(F.col("triples").isNotNull(), "drop-retired"))
        .when(F.col("graph_iri") == "", F.when(want & ~here, "load-default"))
        .when(want & ~here, "load").when(here & F.col("keep").isNotNull() & ~F.col("keep"), "drop-beyond-retention")
        .when(here & F.col("keep").isNull(), F.when(F.col("graph_iri").startswith(F.col("graph_prefix")), "drop-residual").otherwise("foreign"))
    )
    return both.select("ns", "graph_iri", action.alias("action")).where("action is not null")


def reconcile_files(versions: DataFrame, blobs: DataFrame, manifests: DataFrame, namespaces: DataFrame) -> DataFrame:
    """path, ns and action where stored files differ from what should be there.

    versions: blob_path of each revision; blobs and manifests: path; namespaces: ns. A body that no revision names is
    orphan-blob, which is reported and never deleted. A manifest (<folder>/<ns>/<file>) of an unknown namespace is
    drop-manifest, or report-manifest where that name can't be a namespace's, so that no path is built from it.
    """
    lost = blobs.select("path").distinct().join(versions.select(F.col("blob_path").alias("path")), "path", "left_anti")
    lost = lost.select("path", F.lit(None).cast("string").alias("ns"), F.lit("orphan-blob").alias("action"))
    steps = F.split(F.rtrim("path", F.lit("/")), "/")
    named = manifests.select("path").distinct().where(F.size(steps) >= 2).withColumn("ns", F.element_at(steps, -2))
    stray = named.join(namespaces.select("ns").distinct(), "ns", "left_anti")
    return lost.unionByName(stray.select("path", "ns", F.when(T.valid_namespace(F.col("ns")), "drop-manifest").otherwise("report-manifest").alias("action")))


def next_version(version: Column) -> Column:
    """major.(minor + 1).0, 1.0.0 for null; null where the version isn't numeric, which the caller must refuse."""
    return F.when(version.isNull(), "1.0.0").otherwise(raised(version, F.lit(1)))


def raised(version: Column, steps: Column) -> Column:
    """major.(minor + steps).0; null where the version isn't numeric."""
    part = lambda i: F.regexp_extract(version, r"\A([0-9]+)\.([0-9]+)(?:\..*)?\z", i)
    return F.when(part(1) != "", F.concat(part(1), F.lit("."), (part(2).try_cast("long") + steps).cast("string"), F.lit(".0")))


def assign_versions(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """ns, seq, version, repeated, edited_from and recorded of published bodies (ns, seq, body, edited_from), in order of seq.

    existing: ns, version, content_hash and created_at of revisions that are there. A body that is there, or was published
    before, is repeated and keeps its version; the newest revision's number is raised for each other one. The first of a
    namespace is 1.0.0. Where a number is needed and the newest version isn't numeric the version is null: the caller must
    refuse it or name one. recorded says whether the origin is known: it is where it was declared, and for a namespace's
    first revision, which has none.
    """
    hashed = docs.withColumn("hash", F.sha2("body", 256))
    if existing is None:
        existing = docs.sparkSession.createDataFrame([], "ns string, version string, content_hash string, created_at timestamp")
    there = existing.groupBy("ns", F.col("content_hash").alias("hash")).agg(F.min_by("version", "created_at").alias("kept"))
    newest = existing.groupBy("ns").agg(F.max_by("version", F.struct("created_at", "version")).alias("newest"))
    first = hashed.groupBy("ns", "hash").agg(F.min("seq").alias("first_seq")).join(there, ["ns", "hash"], "left").join(newest, "ns", "left")
    order = Window.partitionBy("ns").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = first.withColumn("k", F.sum(F.when(F.col("kept").isNull(), 1).otherwise(0)).over(order))
    version = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("newest").isNull(), raised(F.lit("1.0.0"), F.col("k") - 1)).otherwise(raised(F.col("newest"), F.col("k")))
    named = named.select("ns", "hash", "first_seq", version.alias("version"), F.col("kept").isNotNull().alias("was"), (F.col("newest").isNull() & (F.col("k") == 1)).alias("root"))
    rows = hashed.join(named, ["ns", "hash"])
    return rows.select("ns", "seq", "version", (F.col("was") | (F.col("seq") > F.col("first_seq"))).alias("repeated"), "edited_from", (F.col("edited_from").isNotNull() | F.col("root")).alias("recorded"))


# What each audit action makes of a revision, and the states that it may come from.
STATE = {"published": "draft", "submitted": "in-review", "approved": "approved", "superseded": "superseded", "rejected": "draft"}
FROM = {"published": (None,), "submitted": ("draft",), "approved": ("in-review",), "superseded": ("approved",), "rejected": ("in-review",)}


def replay_status(audit: DataFrame) -> DataFrame:
    """ns, version, status and illegal (how many actions the state before did not allow) from audit rows (id, ns, version, action)."""
    rows = audit.where(F.col("action").isin(*STATE))
    state = F.element_at(F.create_map(*[F.lit(x) for pair in STATE.items() for x in pair]), F.col("action"))
    before = F.lag("state").over(Window.partitionBy("ns", "version").orderBy("id"))
    legal = F.lit(False)
    for action, states in FROM.items():
        legal = F.when(F.col("action") == action, F.col("before").isNull() if states == (None,) else F.coalesce(F.col("before").isin(*states), F.lit(False))).otherwise(legal)
    rows = rows.withColumn("state", state).withColumn("before", before)
    return rows.groupBy("ns", "version").agg(F.max_by("state", "id").alias("status"), F.count_if(~legal).alias("illegal"))


def available_actions(pairs: DataFrame) -> DataFrame:
    """version, principal, action, enabled and reason of submit, approve and reject for given pairs.

    pairs: version, status, created_by, two_person and principal (null: unknown).
    """
    status, own = F.col("status"), F.col("principal") == F.col("created_by")
    review = status == "in-review"
    approve = F.when(~review, F.when(status == "draft", "not-submitted").otherwise("not-in-review")).when(~F.col("two_person"), None).when(F.col("principal").isNull(), "unknown-principal").when(own, "own-version")
    made = lambda name, ok, why: F.struct(F.lit(name).alias("action"), ok.alias("enabled"), why.alias("reason"))
    actions = F.array(
        made("submit", status == "draft", F.when(status != "draft", "not-draft")),
        made("approve", review & (~F.col("two_person") | F.col("principal").isNull() | ~own), approve),
        made("reject", review, F.when(~review, "not-in-review")),
    )
    return pairs.select("version", "principal", F.explode(actions).alias("a")).select("version", "principal", "a.*")


def criteria_self_revision(versions: DataFrame, questions: DataFrame) -> DataFrame:
    """ns, version, author and revision where a version's author rewrote the active question set at or after publishing it.

    versions: ns, version, created_by, created_at; questions: ns, revision, revised_by, revised_at.
    """
    active = latest_for(questions, ["ns"], "revision")
    return versions.join(active, "ns").where("revised_by = created_by and revised_at >= created_at").select("ns", "version", F.col("created_by").alias("author"), "revision")
