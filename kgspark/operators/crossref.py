"""Mappings between namespaces, owners and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators.paths import dealt, settle

# SKOS mapping predicates with their inverses, roles in rising order, and the export's vocabulary.
INVERSE = {"exactMatch": "exactMatch", "closeMatch": "closeMatch", "broadMatch": "narrowMatch", "narrowMatch": "broadMatch", "relatedMatch": "relatedMatch"}
ROLES = ("analyst", "steward", "maintainer", "owner")
MAPPING_BASE, MAPPING_ONT = "urn:ontology:mapping/", "urn:ontology:mapping#"
#: Targets are looked up in so many namespaces.
MAX_TARGETS = 10


def outgoing(mappings: DataFrame, ns: str) -> DataFrame:
    return mappings.where(F.col("namespace") == ns).orderBy("source_term", "target_term")


def incoming(mappings: DataFrame, ns: str, base: str) -> DataFrame:
    """Declared elsewhere, with a target under the base; the base is taken literally."""
    return mappings.where((F.col("namespace") != ns) & F.col("target_term").startswith(base)).orderBy("namespace", "source_term", "target_term")


def inverse(predicate: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair]), predicate)


def compare_counterparts(mappings: DataFrame) -> DataFrame:
    """mappings with counterpart_predicate (of the smallest namespace that declares the reverse), reciprocal and disputed."""
    mappings, pair = settle(mappings), ["source_term", "target_term"]
    n = mappings.count()
    back = dealt(mappings.select(F.col("target_term").alias("source_term"), F.col("source_term").alias("target_term"), "namespace", "predicate"), n, *pair)
    back = back.groupBy(*pair).agg(F.min_by("predicate", F.struct("namespace", "predicate")).alias("counterpart_predicate"))
    out = dealt(mappings, n, *pair).join(back, pair, "left")
    found = F.col("counterpart_predicate").isNotNull()
    return out.select(*mappings.columns, "counterpart_predicate", found.alias("reciprocal"), F.coalesce(F.col("counterpart_predicate") != inverse(F.col("predicate")), F.lit(False)).alias("disputed"))


def validate_mappings(mappings: DataFrame) -> DataFrame:
    """The columns of mappings and each violation: predicate, source-iri, target-iri or self."""
    checks = (("predicate", ~F.coalesce(F.col("predicate").isin(*INVERSE), F.lit(False))), ("source-iri", ~T.valid_term_iri(F.col("source_term"))), ("target-iri", ~T.valid_term_iri(F.col("target_term"))), ("self", F.col("source_term").eqNullSafe(F.col("target_term"))))
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    return mappings.select("*", F.explode(found).alias("violation"))


def owning_namespace(iris: DataFrame, namespaces: DataFrame) -> DataFrame:
    """iris with owner: the namespace of the longest base_iri that starts the iri, or null for an external one.

    Prefixes meet IRIs by equality: an IRI is cut at each length that some base has. So there is no comparison of every
    IRI with every base. Equal bases go to the smallest namespace.
    """
    bases = namespaces.where("base_iri <> ''").groupBy("base_iri").agg(F.min("ns").alias("owner"))
    lengths = bases.agg(F.sort_array(F.collect_set(F.length("base_iri")), asc=False).alias("lengths"))
    distinct = iris.select("iri").distinct().crossJoin(F.broadcast(lengths))
    cut = distinct.select("iri", F.explode("lengths").alias("n")).where(F.length("iri") >= F.col("n")).select("iri", F.expr("substring(iri, 1, n)").alias("base_iri"))
    best = cut.join(bases, "base_iri").groupBy("iri").agg(F.max_by("owner", F.length("base_iri")).alias("owner"))
    return iris.join(best, "iri", "left").select(*iris.columns, "owner")


def target_lifecycles(targets: DataFrame, namespaces: DataFrame, permitted: DataFrame, approved: DataFrame, readable: DataFrame, lifecycle: DataFrame, most: int = MAX_TARGETS) -> DataFrame:
    """iri, owner, status, successor and note of each target term.

    permitted, approved and readable: namespaces ns; lifecycle: iri, status and successor. Namespaces beyond the first
    `most` in order are not looked up. What can't be known is `unknown`, with the reason in note.
    """
    rows = owning_namespace(targets.select("iri").distinct(), namespaces)
    first = rows.where("owner is not null").select("owner").distinct().orderBy("owner").limit(most).withColumn("looked", F.lit(True))
    flag = lambda df, name: df.select(F.col("ns").alias("owner"), F.lit(True).alias(name)).distinct()
    rows = rows.join(first, "owner", "left").join(flag(permitted, "may"), "owner", "left").join(flag(approved, "has"), "owner", "left").join(flag(readable, "reads"), "owner", "left").join(lifecycle.select("iri", F.col("status").alias("found"), F.col("successor").alias("next")), "iri", "left")
    note = F.when(F.col("owner").isNull(), "external").when(F.col("looked").isNull(), "beyond-limit").when(F.col("may").isNull(), "no-permission").when(F.col("has").isNull(), "no-approved-version").when(F.col("reads").isNull(), "unreadable")
    return rows.select("iri", "owner", F.when(note.isNotNull(), "unknown").otherwise(F.coalesce("found", F.lit("absent"))).alias("status"), F.when(note.isNull(), F.col("next")).alias("successor"), note.alias("note"))


def resolve_owner(terms: DataFrame, term_owners: DataFrame, roles: DataFrame) -> DataFrame:
    """namespace, term_iri, owners (sorted) and via: term, namespace or unresolved."""
    own = term_owners.groupBy("namespace", "term_iri").agg(F.array_sort(F.collect_set("principal_id")).alias("own"))
    whole = roles.where("role = 'owner'").groupBy("namespace").agg(F.array_sort(F.collect_set("principal_id")).alias("whole"))
    rows = terms.join(own, ["namespace", "term_iri"], "left").join(whole, "namespace", "left")
    return rows.select("namespace", "term_iri", F.coalesce("own", "whole", F.array().cast("array<string>")).alias("owners"), F.when(F.col("own").isNotNull(), "term").when(F.col("whole").isNotNull(), "namespace").otherwise("unresolved").alias("via"))


def role_rank(role: Column) -> Column:
    """1 for the lowest role; null for an unknown one."""
    return F.element_at(F.create_map(*[x for i, r in enumerate(ROLES, 1) for x in (F.lit(r), F.lit(i))]), role)


def effective_role(principals: DataFrame, grants: DataFrame, namespaces: DataFrame, every: bool = False) -> DataFrame:
    """principal_id, namespace and role. principals: principal_id, platform_admin. An admin is an owner everywhere.

    Pairs without a role have no row; with `every` they have one with a null role, which makes as many rows as principals
    times namespaces.
    """
    spaces = namespaces.select(F.col("ns").alias("namespace"))
    known = grants.where(role_rank(F.col("role")).isNotNull())
    best = known.groupBy("principal_id", "namespace").agg(F.max_by("role", role_rank(F.col("role"))).alias("role"))
    if every:
        rows = principals.crossJoin(spaces).join(best, ["principal_id", "namespace"], "left")
        return rows.select("principal_id", "namespace", F.when(F.col("platform_admin"), "owner").otherwise(F.col("role")).alias("role"))
    admins = principals.where("platform_admin").select("principal_id").crossJoin(spaces).withColumn("role", F.lit("owner"))
    others = best.join(principals.where("not platform_admin").select("principal_id"), "principal_id", "left_semi").join(spaces, "namespace", "left_semi")
    return admins.unionByName(others.select("principal_id", "namespace", "role"))


def covers(role: Column, needed: str) -> Column:
    """Whether a role is at least the needed one; no or an unknown role covers nothing."""
    return F.coalesce(role_rank(role) >= ROLES.index(needed) + 1, F.lit(False))


def visible_namespaces(principals: DataFrame, grants: DataFrame, namespaces: DataFrame) -> DataFrame:
    """principal_id and the sorted namespaces in which it may read; none is an empty array."""
    rows = effective_role(principals, grants, namespaces)
    own = rows.where(covers(F.col("role"), "analyst")).groupBy("principal_id").agg(F.array_sort(F.collect_set("namespace")).alias("namespaces"))
    return principals.select("principal_id").distinct().join(own, "principal_id", "left").select("principal_id", F.coalesce("namespaces", F.array().cast("array<string>")).alias("namespaces"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """current with changes put in by key; of several changes to a key the one last in order counts."""
    both = current.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("_side"), F.desc(order))
    return both.withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at", "_side")


def mapping_triples(mappings: DataFrame) -> DataFrame:
    """Distinct (s, p, o, o_kind) of an export: each SKOS edge, a node that describes it, and the bundle with its count.

    All triples of a pair of terms are made in one place, from the distinct rows of the pair, so that equal ones meet there and
    triples are not shuffled. Rows that lack a namespace or a term can share their node with other pairs: they meet by the node.
    """
    ont, bundle = (lambda x: F.lit(MAPPING_ONT + x)), F.lit(MAPPING_BASE + "export")
    extras = {"reciprocal": "literal", "disputed": "literal", "counterpart_predicate": "literal", "target_status": "literal", "target_successor": "iri", "target_status_note": "literal"}
    extras = {c: kind for c, kind in extras.items() if c in mappings.columns}
    mappings = settle(mappings.select("namespace", "source_term", "target_term", "predicate", "declared_by", "reason", *extras))
    n = mappings.count()

    path = lambda get: F.concat_ws("/", *[T.percent_encode(get(c)) for c in ("namespace", "source_term", "target_term")])
    named = lambda x: F.concat(F.lit(MAPPING_BASE), path(lambda c: x["m"][c]))
    key = lambda edge, described, a, b: F.struct(F.lit(edge).alias("edge"), F.lit(described).alias("described"), a.alias("a"), b.alias("b"))
    whole = F.col("namespace").isNotNull() & F.col("source_term").isNotNull() & F.col("target_term").isNotNull()
    pair = F.col("source_term"), F.col("target_term")
    keys = F.when(whole, F.array(key(True, True, *pair))).otherwise(F.array(key(True, False, *pair), key(False, True, path(F.col), F.lit(None).cast("string"))))
    rows = mappings.select(F.explode(keys).alias("k"), F.struct(*mappings.columns).alias("m")).select("k.*", "m")
    groups = dealt(rows, n, "a", "b").groupBy("a", "b").agg(F.collect_set(F.struct("edge", "described", "m")).alias("found"))

    triple = lambda s, p, o, k: F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(k).alias("o_kind"))

    def made(x: Column, node: Column) -> Column:
        m = x["m"]
        skos = F.concat(F.lit(T.SKOS), m["predicate"])
        about = [(bundle, ont("includes"), node, "iri"), (node, F.lit(T.TYPE), ont("Mapping"), "iri"), (node, ont("source"), m["source_term"], "iri"), (node, ont("target"), m["target_term"], "iri"), (node, ont("predicate"), skos, "iri"), (node, ont("declaredIn"), m["namespace"], "literal"), (node, ont("declaredBy"), m["declared_by"], "literal"), (node, F.lit(T.COMMENT), F.nullif(m["reason"], F.lit("")), "literal")]
        for extra, kind in extras.items():
            words = extra.split("_")
            about.append((node, ont(words[0] + "".join(w.title() for w in words[1:])), m[extra].cast("string"), kind))
        edge = F.when(x["edge"], triple(m["source_term"], skos, m["target_term"], "iri"))
        return F.array(edge, *[F.when(x["described"], triple(*t)) for t in about])

    groups = groups.select("found", F.col("found")[0].alias("x")).withColumn("node", named(F.col("x")))  # mostly one row: its triples differ
    every = F.transform(F.transform("found", lambda x: F.struct(x.alias("x"), named(x).alias("node"))), lambda y: made(y["x"], y["node"]))
    each = F.when(F.size("found") == 1, made(F.col("x"), F.col("node"))).otherwise(F.array_distinct(F.flatten(every)))
    triples = groups.select(F.explode(each).alias("t")).select("t.*").where("o is not null")
    count = mappings.agg(F.count("*").alias("n")).select(F.explode(F.array(triple(bundle, F.lit(T.TYPE), ont("MappingExport"), "iri"), triple(bundle, ont("mappingCount"), F.col("n").cast("string"), "literal"))).alias("t")).select("t.*")
    return triples.unionByName(count)
