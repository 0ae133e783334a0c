"""Shapes, divergence, questions, contradictions and gates."""

from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import quality as V
from tests.conftest import rows
from tests.test_graph import EX, graph


def shape(spark, cls, *paths):
    made = [(f"{EX}{cls}S", T.TYPE, T.SH + "NodeShape"), (f"{EX}{cls}S", T.SH + "targetClass", EX + cls)]
    for i, (path, least) in enumerate(paths):
        made += [(f"{EX}{cls}S", T.SH + "property", f"_:{cls}{i}"), (f"_:{cls}{i}", T.SH + "path", EX + path), (f"_:{cls}{i}", T.SH + "minCount", f'"{least}"')]
    return graph(spark, *made)


def test_targets_and_required_paths(spark):
    q = shape(spark, "A", ("p", 1), ("q", 0), ("r", "x")).unionByName(graph(spark, ("_:s", T.TYPE, T.SH + "NodeShape"), ("_:s", T.SH + "targetClass", EX + "B"), (EX + "AS", T.SH + "targetClass", "_:b")))
    assert rows(V.shacl_targets(q)) == [(EX + "A", EX + "AS")]
    assert rows(V.required_paths(q)) == [(EX + "AS", EX + "p")]


def test_probe_budget_cuts_in_the_middle(spark):
    q = shape(spark, "A", ("p", 1), ("q", 1)).unionByName(shape(spark, "B", ("p", 1)))
    mapped = spark.createDataFrame([(EX + x,) for x in ("A", "B", "p", "q")], "iri string")
    data = graph(spark, (EX + "a", T.TYPE, EX + "A"), (EX + "a", EX + "p", '"1"'), (EX + "b", T.TYPE, EX + "B"))
    short = {(r["class"][-1], (r.path or "-")[-1]): (r.status, r.missing) for r in V.divergence_report(q, data, mapped, 2).collect()}
    assert short == {("A", "-"): ("matched", None), ("A", "p"): ("matched", 0), ("B", "-"): ("unknown", None)}
    full = {(r["class"][-1], (r.path or "-")[-1]): (r.status, r.missing) for r in V.divergence_report(q, data, mapped).collect()}
    assert full[("A", "q")] == ("empty", 1) and full[("B", "p")] == ("empty", 1)
    plan = V.plan_probes(V.shacl_targets(q), V.required_paths(q), mapped, 2)
    assert tuple(V.divergence_summary(V.divergence_report(q, data, mapped, 2), plan).first()) == (False, 0, 1, 2, 3, False)


def test_no_shapes_is_not_conclusively_bad(spark):
    none, mapped = graph(spark, ("a", "p", "b")), spark.createDataFrame([], "iri string")
    plan = V.plan_probes(V.shacl_targets(none), V.required_paths(none), mapped)
    assert tuple(V.divergence_summary(V.divergence_report(none, none, mapped), plan).first()) == (True, 0, 0, 0, 0, True)


def test_counts_are_of_distinct_values_and_patterns_hold(spark):
    shapes = shape(spark, "A", ("p", 2)).unionByName(graph(spark, ("_:A0", T.SH + "pattern", '"^[A-Z]+$"'), ("_:A0", T.SH + "message", '"bad p"')))
    data = graph(spark, (EX + "x", T.TYPE, EX + "Sub"), (EX + "Sub", T.SUBCLASS, EX + "A"), (EX + "x", EX + "p", '"AB"'), (EX + "x", EX + "p", '"AB"'), (EX + "y", T.TYPE, EX + "A"), (EX + "y", EX + "p", '"AB"'), (EX + "y", EX + "p", '"low"'))
    assert {(r.focus[-1], r.component, r.value, r.message) for r in V.shacl_validate(shapes, data).collect()} == {("x", "minCount", None, "bad p"), ("y", "pattern", "low", "bad p")}
    assert tuple(V.shacl_report(shapes, data).first()) == (True, False, False, 2)


def test_malformed_shapes_judge_no_data(spark):
    broken = shape(spark, "A", ("p", "many"))
    assert tuple(V.shacl_report(broken, graph(spark, ("a", "p", "b"))).first()) == (False, None, False, None)
    data = graph(spark, (EX + "x", T.TYPE, EX + "A"), (EX + "x", EX + "p", '"v"'))
    for pattern in ("a{2,1}", "(?<n", "*"):
        bad = shape(spark, "A", ("p", 1)).unionByName(graph(spark, ("_:A0", T.SH + "pattern", f'"{pattern}"')))
        assert tuple(V.shacl_report(bad, data).first()) == (False, None, False, None)
    assert [r.fault for r in V.malformed_shapes(graph(spark, ("_:a", T.SH + "pattern", '"a(b"'), ("_:b", T.SH + "pattern", '"[a-z(]+\\(x\\)"'))).collect()] == ["pattern"]


def test_questions_that_can_not_be_asked_never_pass(spark):
    one, none = spark.range(1), spark.range(0)
    out = V.evaluate_questions([("a", "non_empty", one), ("b", "empty", none), ("c", "empty", one), ("d", "ask_true", one), ("e", "empty", None)], one)
    assert rows(out.select("id", "passed", "evaluated")) == [("a", True, True), ("b", True, True), ("c", False, True), ("d", False, True), ("e", False, False)]
    assert tuple(V.competency_report(out).first()) == (False, False, ["c", "d"], ["e"])


def test_contradictions(spark):
    disjoint = (EX + "A", T.DISJOINT, EX + "B")
    found, verdict = V.contradictions(graph(spark, disjoint, (EX + "i", T.TYPE, EX + "B"), (EX + "i", T.TYPE, EX + "C"), (EX + "C", T.SUBCLASS, EX + "A")))
    assert rows(found) == [("individual", EX + "i")] and tuple(verdict.first()) == (False, True, None, None)
    found, verdict = V.contradictions(graph(spark, disjoint, (EX + "U", T.SUBCLASS, EX + "A"), (EX + "U", T.SUBCLASS, EX + "B"), (EX + "p", T.RANGE, EX + "A")))
    assert rows(found) == [("class", EX + "U")] and tuple(verdict.first()) == (True, False, 1, [EX + "U"])
    union = (("_:u", T.SUBCLASS, EX + "A"), ("_:u", T.UNION_OF, "_:l"), ("_:l", T.RDF + "first", EX + "M"), ("_:l", T.RDF + "rest", T.RDF + "nil"), (EX + "i", T.TYPE, EX + "M"), (EX + "i", T.TYPE, EX + "B"))
    assert rows(V.contradictions(graph(spark, disjoint, *union))[0]) == [("individual", EX + "i")]


def test_gate_order_and_unknown(spark):
    names = "version string, status string, created_by string, actor string, two_person boolean, shacl_conforms boolean, blocking_problems int, self_revised boolean, has_questions boolean, evaluated_all boolean, questions_conform boolean"
    base = ("v", "in-review", "a", "b", True, True, 0, False, True, True, True)
    alter = lambda **x: tuple(x.get(n.split()[0], v) for n, v in zip(names.split(", "), base, strict=True))
    cases = [(base, None), (alter(status="draft", shacl_conforms=False), "in-review"), (alter(actor="a"), "two-person"), (alter(shacl_conforms=None), "shacl"), (alter(blocking_problems=1), "deprecation"), (alter(self_revised=True), "criteria-authorship"), (alter(self_revised=True, two_person=False), None), (alter(evaluated_all=False), "competency"), (alter(has_questions=False, questions_conform=False), None)]
    for row, gate in cases:
        assert V.approval_gate(spark.createDataFrame([row], names)).first().gate == gate


def test_members_are_looked_up_once_a_value(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT", 4)
    rows = [(f"f{i}", "hot" if i % 2 else f"v{i}", "iri", "c") for i in range(400)] + [("l", "hot", "literal", "c"), ("n", "hot", "iri", None)]
    rows = spark.createDataFrame(rows, "focus string, value string, kind string, wanted string").repartition(4)
    out = V._with_members(rows, spark.createDataFrame([("hot", "c", True), ("v2", "c", True)], "value string, wanted string, is boolean"), 402)
    assert out.count() == 402 and {r.focus for r in out.where("is").collect()} == {f"f{i}" for i in range(1, 400, 2)} | {"f2"}
    assert out.where("value = 'hot' and is").select(F.spark_partition_id()).distinct().count() > 1
