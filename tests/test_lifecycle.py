"""Differences, deprecation, retention, versions, owners and mappings."""

import json

from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import crossref as X
from kgspark.operators import lifecycle as C
from kgspark.operators import paths as P
from tests.conftest import rows
from tests.test_graph import EX, graph


def test_blank_labels_and_order_do_not_matter(spark):
    base = graph(spark, (EX + "A", EX + "has", "_:x"), ("_:x", EX + "size", '"1"'), (EX + "A", EX + "has", "_:y"), ("_:y", EX + "size", '"1"'), (EX + "B", T.LABEL, '"b"'))
    same = graph(spark, (EX + "B", T.LABEL, '"b"'), (EX + "A", EX + "has", "_:k"), ("_:k", EX + "size", '"1"'), (EX + "A", EX + "has", "_:j"), ("_:j", EX + "size", '"1"'))
    summary = json.loads(C.diff_summary(base, same).first().summary)
    assert summary["status"] == "computed" and summary["empty"] and summary["triples_added"] == summary["triples_removed"] == 0
    fewer = same.where("s <> 'j' and o <> 'j'")
    summary = json.loads(C.diff_summary(base, fewer).first().summary)
    assert not summary["empty"] and summary["modified"] == [EX + "A"]


def test_shared_or_too_many_blank_nodes_are_skipped(spark):
    shared = graph(spark, (EX + "A", "p", "_:x"), (EX + "B", "p", "_:x"))
    cycle = graph(spark, ("_:x", "p", "_:y"), ("_:y", "p", "_:x"))
    assert C.canonical_bnodes(shared)[1] == C.canonical_bnodes(cycle)[1] == "skipped-shared"
    assert C.canonical_bnodes(graph(spark, ("a", "p", "_:x"), ("a", "p", "_:y")), 1)[1] == "skipped-too-many"
    summary = json.loads(C.diff_summary(shared, shared).first().summary)
    assert summary["triples_added"] is None and summary["modified"] is None and summary["empty"] is False


def test_repeated_triples_are_no_difference(spark):
    base, new = graph(spark, (EX + "A", T.LABEL, '"a"'), (EX + "A", T.LABEL, '"a"')), graph(spark, (EX + "A", T.LABEL, '"a"'))
    assert C.triple_diff(base, new).count() == C.triple_diff(new, base).count() == 0


def test_a_thousand_blank_nodes(spark):
    rows_ = [(EX + f"T{i}", EX + "has", f"_:a{i}") for i in range(1000)] + [(f"_:a{i}", EX + "size", f'"{i % 50}"') for i in range(1000)]
    again = [tuple(x.replace("_:a", "_:z") for x in t) for t in reversed(rows_)]
    again[0] = (again[0][0], EX + "size", '"many"')
    summary = json.loads(C.diff_summary(graph(spark, *rows_), graph(spark, *again)).first().summary)
    assert summary["status"] == "computed" and (summary["triples_added"], summary["triples_removed"], summary["modified"]) == (2, 2, [EX + "T999"])


def counted(spark, base, new):
    summary = json.loads(C.diff_summary(graph(spark, *base), graph(spark, *new)).first().summary)
    assert summary["status"] == "computed"
    return summary["triples_added"], summary["triples_removed"], summary["modified"]


def test_equal_nodes_in_other_places_stay_apart(spark):
    one = [(EX + "T1", "p", "_:a"), ("_:a", "q", '"v"'), (EX + "T2", T.LABEL, '"t"')]
    assert counted(spark, one, [*one, (EX + "T2", "p", "_:b"), ("_:b", "q", '"v"')]) == (2, 0, [EX + "T2"])
    assert counted(spark, one, [*one, (EX + "T1", "p2", "_:b"), ("_:b", "q", '"v"')]) == (2, 0, [EX + "T1"])
    assert counted(spark, one, [*one, (EX + "T1", "p", "_:b"), ("_:b", "q", '"v"')]) == (2, 0, [EX + "T1"])
    # below blank nodes: each has an equal child, and one more child is as many triples more
    deep = [(EX + "T1", "p", "_:a"), (EX + "T2", "p", "_:b"), ("_:a", "in", "_:c"), ("_:b", "in", "_:d"), ("_:c", "q", '"v"'), ("_:d", "q", '"v"')]
    assert counted(spark, deep, [tuple(x.replace("_:", "_:z") for x in t) for t in reversed(deep)]) == (0, 0, [])
    assert counted(spark, deep[:1] + deep[2:3] + deep[4:5], deep) == (3, 0, [])
    # nodes that nothing leads to
    assert counted(spark, [("_:a", "q", '"v"')], [("_:k", "q", '"v"'), ("_:l", "q", '"v"')]) == (1, 0, [])


def test_names_count_nodes(spark):
    """As many canonical triples as there were, whatever repeats."""
    import random

    rng = random.Random(3)
    for _ in range(3):
        made = [(EX + f"T{rng.randrange(3)}" if i < 4 else f"_:n{rng.randrange(i)}", f"p{rng.randrange(2)}", f"_:n{i}") for i in range(30)]
        made += [(f"_:n{rng.randrange(30)}", "q", f'"{rng.randrange(2)}"') for _ in range(20)]
        made = list(dict.fromkeys(made))
        other = [tuple(x.replace("_:n", "_:m") for x in t) for t in rng.sample(made, len(made))]
        a, b, status = C.canonical_pair(graph(spark, *made), graph(spark, *other))
        assert status == "computed" and a.distinct().count() == len(made) and C.triple_diff(a, b).isEmpty()


def test_long_chain_of_blank_nodes(spark):
    chain = [(EX + "A", "p", "_:n0"), *[(f"_:n{i}", "rest", f"_:n{i + 1}") for i in range(12)]]
    assert counted(spark, chain, [*chain, ("_:n12", "v", '"1"')])[2] == [EX + "A"]


def test_long_lists_are_cut_in_order(spark):
    base, new = graph(spark, (EX + "A", T.LABEL, '"a"')), graph(spark, *[(EX + f"N{i}", T.LABEL, '"n"') for i in range(30)])
    summary = json.loads(C.diff_summary(base, new, 5).first().summary)
    assert summary["added_count"] == 30 and summary["added"] == sorted(EX + f"N{i}" for i in range(30))[:5] and summary["truncated"]


def test_touched_through_blank_nodes(spark):
    base = graph(spark, (EX + "A", "p", "_:x"), ("_:x", "q", "_:y"), ("_:y", "v", '"1"'), (EX + "B", T.LABEL, '"b"'))
    new = graph(spark, (EX + "A", "p", "_:x"), ("_:x", "q", "_:y"), ("_:y", "v", '"2"'), (EX + "B", T.LABEL, '"b"'))
    a, b = C.canonical_bnodes(base)[0], C.canonical_bnodes(new)[0]
    assert rows(C.modified_terms(a, b)) == [(EX + "A",)]


def test_deprecation_rules(spark):
    base = graph(spark, (EX + "gone", T.LABEL, '"x"'), (EX + "A", T.LABEL, '"a"'))
    new = graph(spark, (EX + "A", T.DEPRECATED, '"true"'), (EX + "A", T.COMMENT, '"  "'), (EX + "B", T.DEPRECATED, '"true"'), (EX + "B", T.REPLACED_BY, EX + "Z"), (EX + "B", T.REPLACED_BY, EX + "Y"), (EX + "C", T.DEPRECATED, '"false"'), (EX + "C", T.DOMAIN, EX + "A"), (EX + "C", T.SEE_ALSO, EX + "B"), ("_:n", "p", EX + "A"), (EX + "B", "p", EX + "A"))
    assert rows(C.check_deprecation(new, base).select("kind", "iri", "blocking")) == [("no-successor-or-reason", EX + "A", True), ("references-deprecated", EX + "C", False), ("removed", EX + "gone", True)]
    iris = spark.createDataFrame([(EX + x,) for x in ("A", "B", "C", "none")], "iri string")
    assert rows(C.term_lifecycle(iris, new)) == [(EX + "A", "deprecated", None), (EX + "B", "deprecated", EX + "Y"), (EX + "C", "active", None), (EX + "none", "absent", None)]
    assert {r.status for r in C.term_lifecycle(iris, None).collect()} == {"unknown"}


def versions(spark, *items):
    return spark.createDataFrame([("n", v, s, at) for v, s, at in items], "ns string, version string, status string, approved_at string")


def test_projection_and_manifest(spark):
    v = versions(spark, ("1", "approved", "2024-01-01"), ("2", "approved", None), ("3", "superseded", "2024-01-01"), ("4", "superseded", "2024-01-02"), ("5", "draft", None), ("6", "rejected", None), ("7", "in-review", None))
    target = {r.version: r.target for r in C.decide_projection(v, 1).collect()}
    assert target == {"1": "named-and-default", "2": "named", "3": "skip-beyond-retain", "4": "named", "5": "skip-draft", "6": "skip-rejected", "7": "named"}
    assert {r.version: r.target for r in C.decide_projection(v, -3).collect()}["4"] == "skip-beyond-retain"
    made = json.loads(C.manifest_json(v, 1).first().manifest)
    assert made["current"] == "1" and [x["version"] for x in made["versions"]] == ["1", "2", "3", "4", "6", "7"]
    assert json.loads(C.manifest_json(v, 1, spark.createDataFrame([("n",)], "ns string")).first().manifest)["current"] is None


def test_reconcile(spark):
    expected = spark.createDataFrame([("n", "g/n/1", True), ("n", "g/n/2", False), ("n", "", True), ("old", "g/old/1", True)], "ns string, graph_iri string, keep boolean")
    actual = spark.createDataFrame([("n", "g/n/2", 3), ("n", "g/n/9", 1), ("n", "elsewhere", 1), ("old", "g/old/1", 1), ("who", "x", 2)], "ns string, graph_iri string, triples int")
    spaces = spark.createDataFrame([("n", "g/n/", False), ("old", "g/old/", True)], "ns string, graph_prefix string, retired boolean")
    assert rows(C.reconcile_plan(expected, actual, spaces)) == [("n", "", "load-default"), ("n", "elsewhere", "foreign"), ("n", "g/n/1", "load"), ("n", "g/n/2", "drop-beyond-retention"), ("n", "g/n/9", "drop-residual"), ("old", "g/old/1", "drop-retired"), ("who", "x", "orphan-dataset")]


def test_stray_files(spark):
    versions = spark.createDataFrame([("v/n/1.ttl",)], "blob_path string")
    blobs, manifests = spark.createDataFrame([("v/n/1.ttl",), ("v/n/2.ttl",)], "path string"), spark.createDataFrame([("v/n/_state.json",), ("v/gone/_state.json",), ("v/..Bad/_state.json",), ("alone",)], "path string")
    found = C.reconcile_files(versions, blobs, manifests, spark.createDataFrame([("n",)], "ns string"))
    assert rows(found) == [("v/..Bad/_state.json", "..Bad", "report-manifest"), ("v/gone/_state.json", "gone", "drop-manifest"), ("v/n/2.ttl", None, "orphan-blob")]


def test_versions_and_states(spark):
    docs = spark.createDataFrame([("n", 1, "a", None), ("n", 2, "b", "1.0.0"), ("n", 3, "a", None), ("n", 4, "c", None)], "ns string, seq int, body string, edited_from string")
    assert rows(C.assign_versions(docs).select("seq", "version", "repeated", "recorded")) == [(1, "1.0.0", False, True), (2, "1.1.0", False, True), (3, "1.0.0", True, True), (4, "1.2.0", False, False)]
    there = spark.createDataFrame([("n", "1.9.0", "x", 1), ("n", "2.3.1", "y", 2), ("m", "beta", "z", 1)], "ns string, version string, content_hash string, created_at int").selectExpr("ns", "version", "sha2(content_hash, 256) as content_hash", "created_at")
    more = spark.createDataFrame([("n", 1, "x", None), ("n", 2, "a", None), ("n", 3, "b", "2.3.1"), ("m", 1, "z", None), ("m", 2, "q", None), ("k", 1, "q", None)], "ns string, seq int, body string, edited_from string")
    assert rows(C.assign_versions(more, there).select("ns", "seq", "version", "repeated", "recorded")) == [("k", 1, "1.0.0", False, True), ("m", 1, "beta", True, False), ("m", 2, None, False, False), ("n", 1, "1.9.0", True, False), ("n", 2, "2.4.0", False, False), ("n", 3, "2.5.0", False, True)]
    nexts = spark.createDataFrame([(None,), ("2.9.1",), ("beta",)], "v string").select(C.next_version(C.F.col("v")))
    assert [r[0] for r in nexts.collect()] == ["1.0.0", "2.10.0", None]
    audit = spark.createDataFrame([(1, "published"), (2, "submitted"), (3, "rejected"), (4, "approved"), (5, "mapping-declared")], "id int, action string").selectExpr("id", "'n' as ns", "'1' as version", "action")
    assert rows(C.replay_status(audit)) == [("n", "1", "approved", 1)]


def test_actions(spark):
    v = spark.createDataFrame([("1", "in-review", "me", True), ("2", "draft", "me", False)], "version string, status string, created_by string, two_person boolean")
    out = {(r.version, r.principal, r.action): (r.enabled, r.reason) for r in C.available_actions(v.crossJoin(spark.createDataFrame([("me",), ("you",), (None,)], "principal string"))).collect()}
    assert out[("1", "me", "approve")] == (False, "own-version") and out[("1", "you", "approve")] == (True, None) and out[("1", None, "approve")] == (True, "unknown-principal")
    assert out[("2", "me", "submit")] == (True, None) and out[("2", "me", "approve")] == (False, "not-submitted") and len(out) == 18


def test_longest_prefix_owns(spark):
    ns = spark.createDataFrame([("a", "https://e/"), ("b", "https://e/b#"), ("c", "")], "ns string, base_iri string")
    iris = spark.createDataFrame([("https://e/b#x",), ("https://e/c",), ("urn:z",), (None,)], "iri string")
    assert {r.iri: r.owner for r in X.owning_namespace(iris, ns).collect()} == {"https://e/b#x": "b", "https://e/c": "a", "urn:z": None, None: None}


def test_counterparts(spark):
    m = spark.createDataFrame([("n", "a", "b", "broadMatch"), ("m", "b", "a", "narrowMatch"), ("n", "c", "d", "exactMatch"), ("m", "d", "c", "closeMatch"), ("n", "e", "f", "exactMatch")], "namespace string, source_term string, target_term string, predicate string")
    out = {r.source_term: (r.reciprocal, r.disputed) for r in X.compare_counterparts(m).collect()}
    assert out == {"a": (True, False), "b": (True, False), "c": (True, True), "d": (True, True), "e": (False, False)}


def test_roles_and_owners(spark):
    people = spark.createDataFrame([("root", True), ("ann", False), ("bob", False)], "principal_id string, platform_admin boolean")
    grants = spark.createDataFrame([("ann", "n", "analyst"), ("ann", "n", "maintainer"), ("bob", "n", "guest")], "principal_id string, namespace string, role string")
    ns = spark.createDataFrame([("n",), ("m",)], "ns string")
    assert {r.principal_id: r.namespaces for r in X.visible_namespaces(people, grants, ns).collect()} == {"root": ["m", "n"], "ann": ["n"], "bob": []}
    terms = spark.createDataFrame([("n", "t1"), ("n", "t2"), ("m", "t3")], "namespace string, term_iri string")
    own = spark.createDataFrame([("n", "t1", "u2"), ("n", "t1", "u1")], "namespace string, term_iri string, principal_id string")
    bosses = spark.createDataFrame([("n", "boss", "owner")], "namespace string, principal_id string, role string")
    assert {r.term_iri: (r.owners, r.via) for r in X.resolve_owner(terms, own, bosses).collect()} == {"t1": (["u1", "u2"], "term"), "t2": (["boss"], "namespace"), "t3": ([], "unresolved")}


def partitions(df):
    return df.select(F.spark_partition_id().alias("at")).distinct().count()


def test_mapping_triples_of_odd_rows_are_distinct_and_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 20)
    schema = "namespace string, source_term string, target_term string, predicate string, declared_by string, reason string"
    odd = [("n", "a", "b", "exactMatch", "u", "why"), ("n", "a", "b", "exactMatch", "u", "why"), ("n", "a", "b", "closeMatch", "v", ""), ("m", "a", "b", "exactMatch", "u", None), (None, "n", "a", "exactMatch", "u", None), ("n", "a", None, "exactMatch", "u", None), ("n", None, "a", "exactMatch", "u", None)]
    many = [("n", f"s{i}", f"t{i}", "exactMatch", "u", None) for i in range(200)]
    out = X.mapping_triples(spark.createDataFrame(odd + many, schema))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and partitions(out) > 6
    assert ("a", T.SKOS + "exactMatch", "b", "iri") in got and (X.MAPPING_BASE + "export", X.MAPPING_ONT + "mappingCount", "207", "literal") in got
    assert sum(t[1] == X.MAPPING_ONT + "includes" for t in got) == 203  # n/a/b, m/a/b and n/a, which three rows share
    assert partitions(X.compare_counterparts(spark.createDataFrame(many, schema))) > 6


def nodes(spark, count, value="many"):
    rows = [("ns", "", f"s{i}", "iri", "p", f"b{i}", "bnode", None, None) for i in range(count)] + [("ns", "", f"s{i}", "iri", T.TYPE, "c", "iri", None, None) for i in range(count)]
    rows += [("ns", "", f"b{i}", "bnode", "q", value if i % 3 else "few", "literal", None, None) for i in range(count)]
    return spark.createDataFrame(rows, "ns string, g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")


def test_triples_of_one_class_are_not_joined_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, status = C.canonical_bnodes(nodes(spark, 400))
        assert status == "computed" and out.count() == 1200 and partitions(out.where(F.col("p") == T.TYPE)) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_differences_are_dealt_by_their_number_and_made_once(spark, monkeypatch):
    base, new = nodes(spark, 60), nodes(spark, 60, "more")
    monkeypatch.setattr(P, "TASK_ROWS", 20)
    assert partitions(C.triple_diff(base, new)) > 6
    calls, settled, diff, settle = [], [], C.triple_diff, C.settle
    monkeypatch.setattr(C, "triple_diff", lambda *a: calls.append(1) or diff(*a))
    assert '"modified_count":40' in C.diff_summary(base, new).first()[0] and len(calls) == 1
    monkeypatch.setattr(C, "settle", lambda df: settled.append(df.columns) or settle(df))
    assert C.modified_terms(*C.canonical_pair(base, new)[:2]).count() == 40 and ["s", "s_kind"] in settled
