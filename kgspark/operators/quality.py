"""Checks of definitions and data: shapes, competency questions, divergence, contradictions and the approval gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators.paths import dealt, numbered, path_star, settle

PROBES = 100
#: A pair of value and class that holds at least one HOT-th of the rows is looked up by broadcast; so at most HOT can be.
HOT = 1000


def objects(quads: DataFrame, predicate: str, value: str, **more: str) -> DataFrame:
    """s and the object of one predicate, with further columns named in more."""
    return quads.where(F.col("p") == predicate).select("s", F.col("o").alias(value), *[F.col(c).alias(n) for n, c in more.items()])


def shacl_targets(quads: DataFrame) -> DataFrame:
    """Distinct class and shape of each IRI node shape with an IRI target class, in order."""
    shapes = quads.where((F.col("p") == T.TYPE) & (F.col("o") == T.SH + "NodeShape") & (F.col("s_kind") == "iri")).select("s")
    targets = quads.where((F.col("p") == T.SH + "targetClass") & (F.col("o_kind") == "iri")).select("s", F.col("o").alias("class"))
    return shapes.join(targets, "s").select("class", F.col("s").alias("shape")).distinct().orderBy("class", "shape")


def property_shapes(quads: DataFrame) -> DataFrame:
    """shape, prop and path of each property shape with an IRI path."""
    props = objects(quads, T.SH + "property", "prop")
    paths = quads.where((F.col("p") == T.SH + "path") & (F.col("o_kind") == "iri")).select(F.col("s").alias("prop"), F.col("o").alias("path"))
    return props.join(paths, "prop").select(F.col("s").alias("shape"), "prop", "path").distinct()


def required_paths(quads: DataFrame) -> DataFrame:
    """Distinct shape and path with sh:minCount of at least 1; a value that is no integer counts as absent."""
    least = quads.where((F.col("p") == T.SH + "minCount") & (F.col("o_kind") == "literal") & (F.col("o").try_cast("int") >= 1)).select(F.col("s").alias("prop"))
    return property_shapes(quads).join(least, "prop", "left_semi").select("shape", "path").distinct()


def _typed(value: str, kind: str, dt: str, wanted: Column) -> Column:
    """Whether a value has the wanted datatype, in tag and in form."""
    own = F.coalesce(F.col(dt), F.lit(T.XSD + "string"))
    form = F.when(wanted == T.XSD + "integer", F.col(value).rlike(r"\A[+-]?[0-9]+\z")).when(wanted == T.XSD + "decimal", F.col(value).rlike(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z")).when(wanted == T.XSD + "boolean", F.col(value).isin("true", "false", "0", "1")).when(wanted.isin(T.XSD + "double", T.XSD + "float"), F.col(value).try_cast("double").isNotNull()).when(wanted == T.XSD + "dateTime", F.col(value).try_cast("timestamp").isNotNull()).when(wanted == T.XSD + "date", F.col(value).try_cast("date").isNotNull()).otherwise(True)
    return (F.col(kind) == "literal") & (own == wanted) & form


# Which kinds of term each sh:nodeKind admits.
NODE_KINDS = {"IRI": ("iri",), "BlankNode": ("bnode",), "Literal": ("literal",), "BlankNodeOrIRI": ("bnode", "iri"), "IRIOrLiteral": ("iri", "literal"), "BlankNodeOrLiteral": ("bnode", "literal")}


def _row_checks() -> dict[str, Column]:
    """For components that judge one value by itself: the condition on value, kind, dt and wanted that violates them."""
    value, kind, wanted = F.col("value"), F.col("kind"), F.col("wanted")
    literal, size, number, bound = kind == "literal", F.length("value"), value.try_cast("double"), wanted.try_cast("double")
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    node_kind = F.lit(False)
    for name, kinds in NODE_KINDS.items():
        node_kind = F.when(wanted == T.SH + name, kind.isin(*kinds)).otherwise(node_kind)
    return {
        "datatype": fails(_typed("value", "kind", "dt", wanted)), "pattern": fails((kind != "bnode") & F.expr("value rlike wanted")), "nodeKind": fails(node_kind),
        "minLength": fails((kind != "bnode") & (size >= wanted.try_cast("int"))), "maxLength": fails((kind != "bnode") & (size <= wanted.try_cast("int"))),
        "minInclusive": fails(literal & (number >= bound)), "maxInclusive": fails(literal & (number <= bound)), "minExclusive": fails(literal & (number > bound)), "maxExclusive": fails(literal & (number < bound)),
    }


def shacl_validate(shapes: DataFrame, data: DataFrame) -> DataFrame:
    """focus, shape, path, component, value and message of each violation.

    Components minCount, maxCount, hasValue, datatype, pattern, nodeKind, minLength, maxLength, the four numeric bounds,
    class, in, and or (of datatypes and classes in an RDF list). A shape's focus nodes are the instances of its target class
    and of the classes below it. Counts are of distinct values; a violated count or hasValue has no value. Only components
    that the shapes use become part of the plan; at most all names above come to the driver for that.
    """
    checks = _row_checks()
    names = ("minCount", "maxCount", "hasValue", "class", "in", "or", *checks)
    shapes = settle(shapes)
    used = {r["p"].removeprefix(T.SH) for r in shapes.where(F.col("p").isin(*[T.SH + n for n in names])).select("p").distinct().collect()}
    targets, props = settle(shacl_targets(shapes)), settle(property_shapes(shapes))
    of = lambda name, column: objects(shapes, T.SH + name, column).select(F.col("s").alias("prop"), column)

    # instances of the classes that shapes name, and no others
    both = shapes.select("s", "p", "o", "o_kind").unionByName(data.select("s", "p", "o", "o_kind"))
    named = targets.select("class").unionByName(objects(shapes, T.SH + "class", "class").select("class")).distinct()
    down = both.where((F.col("p") == T.SUBCLASS) & (F.col("o_kind") == "iri")).select(F.col("o").alias("src"), F.col("s").alias("dst"))
    below = path_star(down, named.select(F.col("class").alias("src"))).select(F.col("src").alias("class"), "dst")
    types = data.where(F.col("p") == T.TYPE).select(F.col("s").alias("focus"), F.col("o").alias("dst"))
    member = settle(types.join(below, "dst").select("focus", "class").distinct())
    n = data.count()
    at = settle(dealt(targets.join(member, "class").select("focus", "shape"), n, "focus", "shape").distinct().join(props, "shape"))
    values = data.select(F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
    values = dealt(values.join(props.select("path").distinct(), "path", "left_semi"), n, "focus", "path").distinct()
    has = settle(dealt(at, n, "focus", "path").join(values, ["focus", "path"]))
    own, n = ("focus", "shape", "prop"), max(at.count(), has.count())

    keep = lambda df, component, value: df.select("focus", "shape", "prop", "path", component.alias("component"), value.alias("value"))
    none = F.lit(None).cast("string")
    facts = lambda names: shapes.where(F.col("p").isin(*[T.SH + n for n in names])).select(F.col("s").alias("prop"), F.substring_index("p", "#", -1).alias("component"), F.col("o").alias("wanted"))
    found = []
    if used & {"minCount", "maxCount"}:
        counted = dealt(at.join(facts(("minCount", "maxCount")), "prop"), n, *own).join(dealt(has.select(*own), n, *own).groupBy(*own).agg(F.count("*").alias("n")), [*own], "left")
        many, limit, least = F.coalesce("n", F.lit(0)), F.col("wanted").try_cast("int"), F.col("component") == "minCount"
        found.append(keep(counted.where((least & (many < limit)) | (~least & (many > limit))), F.col("component"), none))
    if "hasValue" in used:
        want = of("hasValue", "value")
        found.append(keep(at.join(want, "prop").join(has.select("focus", "prop", "value").distinct(), ["focus", "prop", "value"], "left_anti"), F.lit("hasValue"), none))
    if single := used & checks.keys():  # all of them in one pass over the values
        violated = F.lit(False)
        for name in single:
            violated = F.when(F.col("component") == name, checks[name]).otherwise(violated)
        found.append(keep(has.join(facts(single), "prop").where(violated), F.col("component"), F.col("value")))
    classes = member.select(F.col("focus").alias("value"), F.col("class").alias("wanted"), F.lit(True).alias("is"))
    if "class" in used:
        judged = _with_members(has.join(of("class", "wanted"), "prop"), classes, n)
        found.append(keep(judged.where((F.col("kind") == "literal") | F.col("is").isNull()), F.lit("class"), F.col("value")))
    if "in" in used:
        listed = settle(_list_items(shapes, of("in", "head")).select("prop", F.col("item").alias("value"), F.lit(True).alias("is")))
        judged = has.join(of("in", "head").select("prop").distinct(), "prop").join(listed, ["prop", "value"], "left")
        found.append(keep(judged.where("is is null"), F.lit("in"), F.col("value")))
    if "or" in used:
        items = settle(_list_items(shapes, of("or", "head")))
        dtypes, kinds = of("datatype", "dtype").withColumnRenamed("prop", "item"), of("class", "wanted").withColumnRenamed("prop", "item")
        choice = items.join(dtypes, "item", "left").join(kinds, "item", "left").select("prop", "dtype", "wanted")
        fits = F.coalesce(_typed("value", "kind", "dt", F.col("dtype")), F.lit(False)) | ((F.col("kind") != "literal") & F.col("is").isNotNull())
        judged = _with_members(has.join(choice, "prop"), classes, n)
        folded = dealt(judged, n, *own).groupBy(*own, "path", "value", "kind", "dt", "lang").agg(F.bool_or(fits).alias("fits"))
        found.append(keep(folded.where("not fits"), F.lit("or"), F.col("value")))

    out = at.limit(0).select("focus", "shape", "prop", "path", none.alias("component"), none.alias("value"))
    for x in found:
        out = out.unionByName(x)
    messages = objects(shapes, T.SH + "message", "message").select(F.col("s").alias("prop"), "message").groupBy("prop").agg(F.min("message").alias("message"))
    return dealt(out.join(messages, "prop", "left").select("focus", "shape", "path", "component", "value", "message"), n, "focus", "path").distinct()


def _with_members(rows: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """rows with classes' column is, by value and wanted: null for literals, where no class is wanted, and for other than members.

    Each pair is looked up once, so that a value that very many rows have is one row there. Frequent pairs come back to
    the rows by broadcast, the others by a join.
    """
    pair = ["value", "wanted"]
    asked = (F.col("kind") != "literal") & F.col("wanted").isNotNull() & F.col("value").isNotNull()
    links = rows.where(asked)
    pairs = settle(links.groupBy(*pair).agg(F.count("*").alias("_n")).join(classes, pair, "left").select(*pair, "_n", "is"))
    total = pairs.agg(F.sum("_n")).first()[0] or 0
    often = pairs.where(F.col("_n") * HOT >= total).select(*pair, F.struct("is").alias("_often"))
    seldom = pairs.where((F.col("_n") * HOT < total) & F.col("is")).select(*pair, "is")
    links = links.join(F.broadcast(often), pair, "left")
    judged = links.where("_often is not null").withColumn("is", F.col("_often.is")).select(*rows.columns, "is")
    judged = judged.unionByName(dealt(links.where("_often is null"), n, *pair).join(dealt(seldom, n, *pair), pair, "left").select(*rows.columns, "is"))
    return judged.unionByName(rows.where(~F.coalesce(asked, F.lit(False))).withColumn("is", F.lit(None).cast("boolean")))


def _list_items(quads: DataFrame, heads: DataFrame) -> DataFrame:
    """prop and item of RDF lists that begin at (prop, head)."""
    rest = quads.where((F.col("p") == T.RDF + "rest") & (F.col("o_kind") == "bnode")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    cells = path_star(rest, heads.select(F.col("head").alias("src")).distinct())
    first = objects(quads, T.RDF + "first", "item").select(F.col("s").alias("dst"), "item")
    return heads.join(cells.select(F.col("src").alias("head"), "dst"), "head").join(first, "dst").select("prop", "item").distinct()


def malformed_shapes(shapes: DataFrame) -> DataFrame:
    """s and fault of what no data can be judged by: counts that are no integers, target classes that are no IRIs, patterns that can't compile.

    The shapes' distinct patterns come to the driver one after another to be compiled.
    """
    count = shapes.where(F.col("p").isin(T.SH + "minCount", T.SH + "maxCount") & ~((F.col("o_kind") == "literal") & F.coalesce(F.col("o").try_cast("int") >= 0, F.lit(False)))).select("s", F.lit("count").alias("fault"))
    target = shapes.where((F.col("p") == T.SH + "targetClass") & (F.col("o_kind") != "iri")).select("s", F.lit("target").alias("fault"))
    found = shapes.where(F.col("p") == T.SH + "pattern").select("s", F.when(F.col("o_kind") == "literal", F.col("o")).alias("o"))
    bad = [x for x in (r["o"] for r in found.where("o is not null").select("o").distinct().toLocalIterator()) if not compiles(shapes.sparkSession, x)]
    pattern = found.where(F.col("o").isNull() | F.col("o").isin(bad)).select("s", F.lit("pattern").alias("fault"))
    return count.unionByName(target).unionByName(pattern).distinct()


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM, whose patterns judge the values, takes a pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - whatever the compiler throws
        return False
    return True


def shacl_report(shapes: DataFrame, data: DataFrame) -> DataFrame:
    """One row: shapes_conform, data_conform (null where shapes are malformed), conforms, violations (null likewise)."""
    malformed = settle(malformed_shapes(shapes))
    faults = malformed.agg(F.count("*").alias("faults"))
    if malformed.isEmpty():
        rows = shacl_validate(shapes, data).agg(F.count("*").alias("n"))
    else:  # nothing is judged by them
        rows = shapes.sparkSession.range(1).select(F.lit(None).cast("long").alias("n"))
    return faults.crossJoin(rows).select((F.col("faults") == 0).alias("shapes_conform"), F.when(F.col("faults") == 0, F.col("n") == 0).alias("data_conform"), F.coalesce((F.col("faults") == 0) & (F.col("n") == 0), F.lit(False)).alias("conforms"), F.when(F.col("faults") == 0, F.col("n")).alias("violations"))


def class_probe(quads: DataFrame, cls: str) -> DataFrame:
    """One row: whether the class has an instance."""
    return quads.where((F.col("p") == T.TYPE) & (F.col("o") == cls)).limit(1).agg((F.count("*") > 0).alias("answer"))


def missing_property_count(quads: DataFrame, cls: str, path: str) -> DataFrame:
    """One row: how many distinct instances of the class lack the path."""
    own = quads.where((F.col("p") == T.TYPE) & (F.col("o") == cls)).select("s").distinct()
    return own.join(quads.where(F.col("p") == path).select("s"), "s", "left_anti").agg(F.count("*").alias("missing"))


def plan_probes(targets: DataFrame, paths: DataFrame, mapped: DataFrame, limit: int = PROBES) -> DataFrame:
    """class, shape, path (null: the class probe), n and planned: probes in order, cut at limit.

    targets: class, shape; paths: shape, path; mapped: iri of classes and predicates that the mapping gives. Only mapped
    classes and mapped paths are probed: first the class, then its paths in order.
    """
    classes = targets.join(mapped.select(F.col("iri").alias("class")), "class", "left_semi").select("class", "shape").distinct()
    props = classes.join(paths, "shape").join(mapped.select(F.col("iri").alias("path")), "path", "left_semi").select("class", "shape", "path").distinct()
    rows = classes.withColumn("path", F.lit(None).cast("string")).unionByName(props)
    order = [F.col("class"), F.col("shape"), F.col("path").asc_nulls_first()]
    return numbered(rows, order, "n").withColumn("n", F.col("n").cast("int")).withColumn("planned", F.col("n") <= limit)


def divergence_report(shapes: DataFrame, data: DataFrame, mapped: DataFrame, limit: int = PROBES) -> DataFrame:
    """class, shape, path, status and missing, a row for each target class (path null) and for each required path of a matched one.

    A class is matched, empty (no instance), unmapped, or unknown (not probed). A path is matched, empty (some instance
    lacks it, missing says how many), unmapped or unknown; paths cut off after their class was probed have no row. All
    probes are one grouped plan.
    """
    targets, paths = settle(shacl_targets(shapes)), settle(required_paths(shapes))
    plan = settle(plan_probes(targets, paths, mapped, limit))
    wanted = plan.where("path is not null and planned").select("class", "path").distinct()
    # one row an instance of a probed class, with its probed paths: read and grouped once for all probes
    classes = plan.select("class").distinct()
    own = data.where(F.col("p") == T.TYPE).select("s", F.col("o").alias("class")).join(classes, "class", "left_semi").select("s", F.struct("class", F.lit(None).cast("string").alias("path")).alias("x"))
    held = data.select("s", F.col("p").alias("path")).join(wanted.select("path").distinct(), "path", "left_semi").select("s", F.struct(F.lit(None).cast("string").alias("class"), "path").alias("x"))
    nodes = own.unionByName(held).groupBy("s").agg(F.collect_set("x.class").alias("classes"), F.collect_set("x.path").alias("paths")).where("size(classes) > 0")
    counted = settle(nodes.select(F.explode("classes").alias("class"), "paths").select("class", F.explode(F.concat(F.array(F.lit(None).cast("string")), "paths")).alias("path")).groupBy("class", "path").agg(F.count("*").alias("n")))
    sizes = counted.where("path is null").select("class", F.col("n").alias("instances"))
    have = counted.where("path is not null").join(wanted, ["class", "path"], "left_semi").select("class", "path", F.col("n").alias("have"))
    probed = plan.where("path is null").select("class", "shape", "planned")
    is_mapped = mapped.select(F.col("iri").alias("class"), F.lit(True).alias("is_mapped")).distinct()
    classes = targets.join(is_mapped, "class", "left").join(probed, ["class", "shape"], "left").join(sizes, "class", "left")
    status = F.when(F.col("is_mapped").isNull(), "unmapped").when(~F.coalesce("planned", F.lit(False)), "unknown").when(F.coalesce("instances", F.lit(0)) > 0, "matched").otherwise("empty")
    classes = classes.withColumn("status", status)
    top = classes.select("class", "shape", F.lit(None).cast("string").alias("path"), "status", F.lit(None).cast("long").alias("missing"))
    mapped_paths = mapped.select(F.col("iri").alias("path"), F.lit(True).alias("path_mapped")).distinct()
    steps = plan.where("path is not null").select("class", "shape", "path", F.col("planned").alias("path_planned"))
    props = classes.where("status = 'matched'").join(paths, "shape").join(mapped_paths, "path", "left").join(steps, ["class", "shape", "path"], "left").join(have, ["class", "path"], "left")
    props = props.where(F.col("path_mapped").isNull() | F.col("path_planned"))
    missing = F.when(F.col("path_mapped").isNotNull(), F.col("instances") - F.coalesce("have", F.lit(0)))
    below = props.select("class", "shape", "path", F.when(F.col("path_mapped").isNull(), "unmapped").when(missing > 0, "empty").otherwise("matched").alias("status"), missing.alias("missing"))
    return top.unionByName(below)


def divergence_summary(report: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: no_shapes, diverged, unknown, issued, skipped and conclusive.

    skipped counts probes beyond the limit; issued counts planned ones, without the paths of classes found empty.
    """
    rows = report.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("empty", "unmapped")).alias("diverged"), F.count_if(F.col("status") == "unknown").alias("unknown"))
    empty = report.where("path is null and status <> 'matched'").select("class", "shape", F.lit(True).alias("idle"))
    used = plan.join(empty, ["class", "shape"], "left").agg(F.count_if(F.col("planned") & (F.col("path").isNull() | F.col("idle").isNull())).alias("issued"), F.count_if(~F.col("planned")).alias("skipped"))
    return rows.crossJoin(used).select((F.col("n") == 0).alias("no_shapes"), "diverged", "unknown", "issued", "skipped", ((F.col("unknown") == 0) & (F.col("skipped") == 0)).alias("conclusive"))


def evaluate_questions(questions: list[tuple[str, str, DataFrame | bool | None]], quads: DataFrame) -> DataFrame:
    """id, expect, passed and evaluated of each question (id, expect, answer).

    expect is ask_true, non_empty or empty. An answer of rows suits the last two, one named `answer` suits ask_true; the
    wrong shape, or None (it could not be asked), fails. Only existence is tested: one row is looked for.
    """
    spark, out = quads.sparkSession, None
    for name, expect, answer in questions:
        evaluated = isinstance(answer, DataFrame)
        asked = evaluated and answer.columns == ["answer"]
        if not evaluated or asked != (expect == "ask_true"):
            row = spark.range(1).select(F.lit(False).alias("passed"))
        elif asked:
            row = answer.select(F.col("answer").alias("passed"))
        else:
            row = answer.limit(1).agg((F.count("*") > 0 if expect == "non_empty" else F.count("*") == 0).alias("passed"))
        row = row.select(F.lit(name).alias("id"), F.lit(expect).alias("expect"), "passed", F.lit(evaluated).alias("evaluated"))
        out = row if out is None else out.unionByName(row)
    return out


def competency_report(results: DataFrame) -> DataFrame:
    """One row: conforms (all evaluated and passed), evaluated_all, failed and not_evaluated ids."""
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    return results.agg(F.coalesce(F.bool_and(F.col("evaluated") & F.col("passed")), F.lit(True)).alias("conforms"), F.coalesce(F.bool_and("evaluated"), F.lit(True)).alias("evaluated_all"), ids(F.col("evaluated") & ~F.col("passed")).alias("failed"), ids(~F.col("evaluated")).alias("not_evaluated"))


def contradictions(quads: DataFrame, max_terms: int = 50) -> tuple[DataFrame, DataFrame]:
    """(kind, node) of contradictions, and a one-row verdict: consistent, conclusive, unsatisfiable, unsatisfiable_classes.

    Sound but incomplete: individuals in two disjoint classes, and classes below two disjoint ones. Unions on the left of a
    subclass axiom count as an edge for each member. Other axioms than types, subclass, disjointness, labels and
    declarations leave the verdict inconclusive. The count and list of classes are null where there are
    contradictory individuals; the list has the first max_terms, the rows of kind class are all.
    """
    iri = F.col("o_kind") == "iri"
    sub = quads.where((F.col("p") == T.SUBCLASS) & iri).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    unions = quads.where(F.col("p") == T.UNION_OF).select(F.col("s").alias("prop"), F.col("o").alias("head"))
    members = _list_items(quads, unions)
    sub = sub.unionByName(members.join(sub.select(F.col("src").alias("prop"), "dst"), "prop").select(F.col("item").alias("src"), "dst"))
    apart = quads.where((F.col("p") == T.DISJOINT) & iri).select(F.col("s").alias("a"), F.col("o").alias("b"))
    apart = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    classes = quads.where((F.col("p") == T.TYPE) & (F.col("o") == T.CLASS)).select(F.col("s").alias("src"))
    up = path_star(sub, classes.unionByName(sub.select("src")).unionByName(apart.select(F.col("a").alias("src"))).distinct())
    typed = quads.where((F.col("p") == T.TYPE) & iri & ~F.col("o").startswith(T.OWL)).select(F.col("s").alias("node"), F.col("o").alias("src"))
    of = typed.join(up, "src").select("node", F.col("dst").alias("class")).unionByName(typed.select("node", F.col("src").alias("class"))).distinct()
    clash = lambda df: df.select("node", F.col("class").alias("a")).join(apart, "a").join(df.select("node", F.col("class").alias("b")), ["node", "b"]).select("node").distinct()
    people, kinds = settle(clash(of)), settle(clash(up.select(F.col("src").alias("node"), F.col("dst").alias("class"))))
    found = people.select(F.lit("individual").alias("kind"), "node").unionByName(kinds.select(F.lit("class").alias("kind"), "node"))
    known = (T.TYPE, T.SUBCLASS, T.DISJOINT, T.LABEL, T.COMMENT, T.UNION_OF, T.RDF + "first", T.RDF + "rest")
    other = quads.where((F.col("p").startswith(T.OWL) | F.col("p").startswith(T.RDFS)) & ~F.col("p").isin(*known)).agg(F.count("*").alias("other"))
    shown = kinds.orderBy("node").limit(max_terms).agg(F.array_sort(F.collect_list("node")).alias("classes"))
    verdict = people.agg(F.count("*").alias("people")).crossJoin(kinds.agg(F.count("*").alias("n"))).crossJoin(shown).crossJoin(other)
    fine = F.col("people") == 0
    return found, verdict.select(fine.alias("consistent"), (F.col("other") == 0).alias("conclusive"), F.when(fine, F.col("n")).alias("unsatisfiable"), F.when(fine, F.col("classes")).alias("unsatisfiable_classes"))


def foreign_subjects(quads: DataFrame, base: str) -> DataFrame:
    """Distinct IRI subjects outside a namespace's base."""
    return quads.where((F.col("s_kind") == "iri") & ~F.col("s").startswith(base)).select("s").distinct()


GATES = ("in-review", "two-person", "shacl", "deprecation", "criteria-authorship", "competency")


def approval_gate(candidates: DataFrame) -> DataFrame:
    """version, allowed and gate: the first gate in GATES that a candidate fails, else null.

    candidates: version, status, created_by, actor, two_person, shacl_conforms, blocking_problems, self_revised,
    has_questions, evaluated_all, questions_conform. A check that could not be made (null) fails.
    """
    two = F.coalesce("two_person", F.lit(False))
    passes = (
        F.col("status").eqNullSafe(F.lit("in-review")), ~(two & F.col("created_by").eqNullSafe(F.col("actor"))), F.coalesce("shacl_conforms", F.lit(False)), F.coalesce(F.col("blocking_problems") == 0, F.lit(False)),
        ~(two & F.coalesce("self_revised", F.lit(True))), ~F.coalesce("has_questions", F.lit(True)) | (F.coalesce("evaluated_all", F.lit(False)) & F.coalesce("questions_conform", F.lit(False))),
    )
    gate = F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in zip(GATES, passes, strict=True)])
    return candidates.select("version", gate.isNull().alias("allowed"), gate.alias("gate"))
