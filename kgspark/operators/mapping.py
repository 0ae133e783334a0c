"""Tables as graphs: triples from rows, and checks of the mapping that makes them.

A mapping is a table of rows (map_id, table_name, subject_template, class_iri, predicate_iri, object_kind, object_value,
o_dt, o_lang); object_kind is column, template or constant. A row without predicate_iri only gives the class.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators.paths import path_star
from kgspark.sources.quads import COLUMNS

#: A mapping document's greatest length in characters.
MAX_MAPPING = 256 * 1024


@dataclass(frozen=True)
class MapRow:
    map_id: str
    table_name: str
    subject_template: str
    predicate_iri: str | None = None
    object_kind: str | None = None
    object_value: str | None = None
    o_dt: str | None = None
    o_lang: str | None = None
    class_iri: tuple[str, ...] = ()


def from_template(template: str) -> Column:
    """The IRI of a row: placeholders are percent-encoded column values. A null column makes it null."""
    parts = re.split(r"\{([^}]*)\}", template)
    return F.concat(*[T.percent_encode(F.col(x).cast("string")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def key_of(template: str, iri: str) -> dict[str, str] | None:
    """The column values that a template gives this IRI for, so that a search by IRI becomes a filter on columns."""
    from urllib.parse import unquote

    names = re.findall(r"\{([^}]*)\}", template)
    pattern = "".join(re.escape(x) if i % 2 == 0 else "([^/]*)" for i, x in enumerate(re.split(r"\{([^}]*)\}", template)))
    found = re.fullmatch(pattern, iri)
    return dict(zip(names, map(unquote, found.groups()), strict=True)) if found else None


def materialize(spec: list[MapRow], tables: dict[str, DataFrame], ns: str, g: str = "", one_pass: bool = False) -> DataFrame:
    """Quads of all rows, lazily. A null column gives no triple, and a null subject none at all.

    By default each predicate is a branch of a union with its predicate as a constant: a pattern that names one prunes the
    other branches and reads only the columns it needs, so a join of patterns becomes a join of the tables. one_pass reads
    each table once and makes all its triples from a row, for writing a whole graph. A mapping over keyed tables gives
    distinct quads; call distinct() where rows repeat.
    """
    groups: dict[tuple[str, str], list[tuple]] = {}
    for row in spec:
        made = groups.setdefault((row.table_name, row.subject_template), [])
        made += [(T.TYPE, F.lit(c), "iri", None, None) for c in row.class_iri]
        if row.predicate_iri is None:
            continue
        if row.object_kind == "column":
            made.append((row.predicate_iri, F.col(row.object_value).cast("string"), "literal", row.o_dt, row.o_lang))
        elif row.object_kind == "template":
            made.append((row.predicate_iri, from_template(row.object_value), "iri", None, None))
        else:
            made.append((row.predicate_iri, F.lit(row.object_value), "literal" if row.o_dt or row.o_lang else "iri", row.o_dt, row.o_lang))

    def columns(p: str, o: Column, kind: str, dt: str | None, lang: str | None) -> list[Column]:
        return [F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), F.lit(lang).cast("string").alias("o_lang")]

    branches = []
    for (table, template), made in groups.items():
        subject = from_template(template).alias("s")
        if one_pass:
            triples = F.array(*[F.struct(*columns(*x)) for x in made])
            branches.append(tables[table].select(subject, F.explode(triples).alias("t")).select("s", "t.*"))
        else:
            branches += [tables[table].select(subject, *columns(*x)) for x in made]
    out = branches[0]
    for x in branches[1:]:
        out = out.unionByName(x)
    out = out.where("s is not null and o is not null")
    return out.select(F.lit(ns).alias("ns"), F.lit(g).alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_dt", "o_lang").select(*COLUMNS)


def instances_of(quads: DataFrame, cls: str, hierarchy: DataFrame) -> DataFrame:
    """Distinct instances of a class and of the classes below it. hierarchy: src and dst of subclass edges, not data."""
    down = hierarchy.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    below = path_star(down, hierarchy.sparkSession.createDataFrame([(cls,)], "src string")).select(F.col("dst").alias("o"))
    return quads.where(F.col("p") == T.TYPE).join(below, "o", "left_semi").select("s").distinct()


def mapping_summary(spec: DataFrame) -> DataFrame:
    """One row: number of maps, and sorted distinct tables, subject prefixes, classes and predicates."""
    rows = spec.withColumns({"tab": T.normalize_table_name(F.col("table_name")), "prefix": T.template_prefix(F.col("subject_template")), "cls": F.explode_outer("class_iri")})
    some = lambda c: F.array_sort(F.collect_set(c))
    return rows.agg(F.countDistinct("map_id").alias("maps"), some("tab").alias("tables"), some("prefix").alias("subject_prefixes"), some("cls").alias("classes"), some("predicate_iri").alias("predicates"))


def validate_mapping_spec(maps: DataFrame) -> DataFrame:
    """map_id and violation of each fault. maps: map_id, sql_query, table_name, graph_map, parent_map, subject_kind, subject_template, predicate_iri, predicate_template, size."""
    checks = {
        "sql-query": "sql_query is not null",
        "graph-map": "graph_map is not null",
        "parent-map": "parent_map is not null",
        "blank-node-subject": "subject_kind = 'bnode'",
        "no-subject": "subject_template is null and coalesce(subject_kind, '') <> 'bnode'",
        "no-subject-iri": "subject_template = ''",
        "template-predicate": "predicate_template is not null",
        "no-predicate": "predicate_iri is null and predicate_template is null",
        "no-table": "sql_query is null and trim(coalesce(table_name, '')) = ''",
        "too-large": f"size > {MAX_MAPPING}",
    }
    found = F.filter(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return maps.select("map_id", F.explode(found).alias("violation")).distinct()


def validate_mapping_refs(spec: DataFrame, base: str, namespaces: DataFrame, ns: str, observed: DataFrame, terms: DataFrame) -> DataFrame:
    """kind and value of each bad reference: subject-outside, foreign-vocabulary, unobserved-table, unknown-term, deprecated-term.

    namespaces: ns and base_iri; observed: table_name of the latest successful scan; terms: iri and deprecated of the
    approved revision.
    """
    from kgspark.operators.crossref import owning_namespace

    vocabulary = spec.select(F.explode(F.concat(F.coalesce("class_iri", F.array()), F.array("predicate_iri"))).alias("iri")).where("iri is not null").distinct()
    owned = owning_namespace(vocabulary, namespaces)
    prefix = T.data_iri_prefix(F.lit(base))
    subjects = spec.select(T.template_prefix(F.col("subject_template")).alias("value")).distinct().where(~F.col("value").startswith(prefix))
    foreign = owned.where(F.col("owner").isNotNull() & (F.col("owner") != ns)).select(F.col("iri").alias("value"))
    tables = spec.select(T.normalize_table_name(F.col("table_name")).alias("value")).distinct()
    missing = tables.join(observed.select(F.col("table_name").alias("value")), "value", "left_anti")
    own = owned.where(F.col("owner") == ns).select("iri")
    unknown = own.join(terms.select("iri"), "iri", "left_anti").select(F.col("iri").alias("value"))
    old = own.join(terms.where("deprecated").select("iri"), "iri", "left_semi").select(F.col("iri").alias("value"))
    named = (("subject-outside", subjects), ("foreign-vocabulary", foreign), ("unobserved-table", missing), ("unknown-term", unknown), ("deprecated-term", old))
    out = None
    for kind, rows in named:
        rows = rows.select(F.lit(kind).alias("kind"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out
