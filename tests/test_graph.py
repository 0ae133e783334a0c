"""Patterns, paths, files and mapping on small graphs."""

import re

import pytest
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import mapping as M
from kgspark.operators import paths as P
from kgspark.operators import pattern as G
from kgspark.sources import quads as S
from kgspark.sources import snapshots
from tests.conftest import rows

EX = "https://e.example/r#"


def graph(spark, *triples, ns="n", g=""):
    made = []
    for s, p, o in triples:
        kind, lang = ("bnode", None) if o.startswith("_:") else ("literal", None) if o.startswith('"') else ("iri", None)
        if kind == "literal" and "@" in o:
            o, lang = o.split("@")
        made.append(S.quad(ns, g, s.removeprefix("_:"), p, o.strip('"').removeprefix("_:"), kind, "bnode" if s.startswith("_:") else "iri", None, lang))
    return S.from_rows(spark, made)


@pytest.fixture
def shop(spark):
    return graph(spark, (EX + "Premium", T.SUBCLASS, EX + "Customer"), (EX + "Customer", T.SUBCLASS, EX + "Party"), (EX + "alice", T.TYPE, EX + "Premium"), (EX + "Customer", T.LABEL, '"顧客"@ja'), (EX + "Party", T.LABEL, '"Party"@en'), (EX + "x", T.LABEL, f'"{EX}Party"'))


def test_no_entailment_unless_asked(shop):
    q = G.GraphQuery(shop, "n")
    assert rows(q.match("?a", T.SUBCLASS, EX + "Party").select("a")) == [(EX + "Customer",)]
    assert rows(q.path("?a", T.SUBCLASS, EX + "Party", "+").select("a")) == [(EX + "Customer",), (EX + "Premium",)]
    assert rows(q.path("?i", T.SUBCLASS, EX + "Party", first=T.TYPE).select("i")) == [(EX + "alice",)]
    assert rows(q.path("?i", T.SUBCLASS, EX + "Premium", first=T.TYPE).select("i")) == [(EX + "alice",)]


def test_default_graph_is_not_the_union(spark, shop):
    named = graph(spark, (EX + "b", T.TYPE, EX + "Party"), g="urn:g/1")
    q = G.GraphQuery(shop.unionByName(named), "n")
    assert rows(q.match("?s", T.TYPE, "?c").select("s")) == [(EX + "alice",)]
    assert rows(q.graph("?g").match("?s", T.TYPE, "?c").select("g", "s")) == [("urn:g/1", EX + "b")]
    assert rows(q.graph("urn:g/2").match("?s", T.TYPE, "?c").count()) == [(0,)]
    assert rows(G.GraphQuery(shop, "other").match("?s", T.TYPE, "?c").ask()) == [(False,)]


def test_a_literal_that_looks_like_an_iri_is_none(shop):
    q = G.GraphQuery(shop, "n")
    assert rows(q.match("?s", T.LABEL, EX + "Party").select("s")) == []
    assert (EX + "x",) in rows(q.match("?s", T.LABEL, EX + "Party", o_kind="literal").select("s"))
    assert rows(G.terms_with_prefix(shop, "")) == []


def test_negation_union_and_repeated_variables(spark, shop):
    from pyspark.sql import functions as F

    q = G.GraphQuery(shop, "n")
    assert rows(q.match("?c", T.SUBCLASS, "?d").not_exists("?c", T.LABEL, "?l", where=F.col("l_lang") == "ja").select("c")) == [(EX + "Premium",)]
    assert rows(q.match("?c", T.SUBCLASS, "?d").optional("?c", T.LABEL, "?l").filter("l is null").select("c", "l", "none")) == [(EX + "Premium", None, None)]
    assert rows(q.match("?c", T.SUBCLASS, "?d").lacks_any(("?c", T.LABEL, "?l"), ("?d", T.LABEL, "?m")).select("c")) == [(EX + "Premium",)]
    loop = G.GraphQuery(graph(spark, ("a", "p", "a"), ("a", "p", "b")), "n")
    assert rows(loop.match("?x", "p", "?x").select("x")) == [("a",)]
    both = loop.match("?x", "p", "?y").union(loop.match("?x", "p", "b"))
    assert rows(both.select("x", "y")) == [("a", "a"), ("a", "b"), ("a", None)]
    assert rows(loop.match("?x", "p", "?y").exists("?y", "p", "?z").select("y")) == [("a",)]


def test_an_unbound_variable_fits_any_value(spark):
    made = graph(spark, (EX + "a", EX + "p", EX + "x"), (EX + "b", EX + "p", EX + "y"), (EX + "a", EX + "q", EX + "v"), (EX + "r", EX + "s", EX + "v"), (EX + "r", EX + "s", EX + "w"))
    start = G.GraphQuery(made, "n").match("?a", EX + "p", "?x").optional("?a", EX + "q", "?o")
    found = rows(start.match("?r", EX + "s", "?o").select("a", "o"))
    assert found == [(EX + "a", EX + "v"), (EX + "b", EX + "v"), (EX + "b", EX + "w")]
    assert rows(start.not_exists("?r", EX + "s", "?o").select("a")) == [] and len(rows(start.exists("?r", EX + "s", "?o").select("a"))) == 2
    again = start.optional("?r", EX + "s", "?o").match("?a", EX + "p", "?x").select("a", "o", "r")
    assert rows(again) == [(EX + "a", EX + "v", EX + "r"), (EX + "b", EX + "v", EX + "r"), (EX + "b", EX + "w", EX + "r")]
    both = G.GraphQuery(made, "n").match("?a", EX + "q", "?o").union(G.GraphQuery(made, "n").match("?a", EX + "p", "?x"))
    assert len(rows(both.match("?r", EX + "s", "?o").select("a", "o"))) == 5


def test_patterns_are_joined_where_they_share_a_variable(spark):
    made = graph(spark, *[(f"{EX}a{i}", EX + "p", f"{EX}x{i}") for i in range(9)], *[(f"{EX}b{i}", EX + "q", f"{EX}y{i}") for i in range(9)], *[(f"{EX}x{i}", EX + "r", f"{EX}b{i}") for i in range(9)])
    q = G.GraphQuery(made, "n").bgp([("?a", EX + "p", "?x"), ("?b", EX + "q", "?y"), ("?x", EX + "r", "?b")])
    assert len(rows(q.select("a", "y"))) == 9
    plan = q.rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and "Join Cross" not in plan
    assert len(rows(G.GraphQuery(made, "n").bgp([("?a", EX + "p", "?x"), ("?b", EX + "q", "?y")]).select("a", "b"))) == 81


def test_numbers_in_ranges(spark):
    from pyspark.sql import functions as F

    made = spark.range(500).selectExpr("(id * 7919) % 500 as k")
    for part in (100_000, 40):
        assert [r.n for r in P.numbered(made, [F.col("k")], "n", part).orderBy("k").collect()] == list(range(1, 501))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_many_unbound_variables_in_one_join(spark, how):
    """Six variables that rows may leave unbound, against all pairs of rows, and one join by equality in the plan."""
    import random

    rng, names = random.Random(4), list("abcdef")
    left = [tuple(rng.choice(("1", "2", None)) for _ in names) + (f"r{i}",) for i in range(30)]
    right = [tuple(rng.choice("12") for _ in names) + (f"o{i}",) for i in range(25)]
    schema = lambda *more: ", ".join(f"{c} string" for c in (*names, *more))
    query = G.GraphQuery(graph(spark, ("x", "y", "z")), "n", spark.createDataFrame(left, schema("row")), loose=frozenset(names))
    out = query._join(spark.createDataFrame(right, schema("other")), how).rows
    want = []
    for x in left:
        fits = [y for y in right if all(a in (None, b) for a, b in zip(x[:6], y[:6], strict=True))]
        want += [(*y[:6], x[6], y[6]) for y in fits] or ([(*x, None)] if how == "left" else [])
    assert rows(out.select(*names, "row", "other")) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join (Inner|LeftOuter), .*_free", plan)) == 1 and "Union" not in plan
    assert rows(query._joined(query.rows, spark.createDataFrame(right, schema("other")), "left_anti").select("row")) == sorted({(x[6],) for x in left if not any(all(a in (None, b) for a, b in zip(x[:6], y[:6], strict=True)) for y in right)}, key=repr)
    assert "_free" not in out.columns


def test_construct_leaves_out_unbound(shop):
    q = G.GraphQuery(shop, "n").match("?c", T.SUBCLASS, "?d").optional("?c", T.LABEL, "?l")
    assert rows(q.construct(("?c", "urn:l", "?l"), ("?d", "urn:k", EX + "Thing"))) == [(EX + "Customer", "urn:k", EX + "Thing"), (EX + "Customer", "urn:l", "顧客"), (EX + "Party", "urn:k", EX + "Thing")]


def test_caps(shop):
    q = G.GraphQuery(shop, "n").match("?s", "?p", "?o").select("s", "p")
    kept = G.cap_rows(q, 2, "s", "p").collect()
    assert len(kept) == 2 and kept[0].total == 6 and kept[0].truncated
    assert not G.cap_rows(q, 6, "s", "p").first().truncated
    assert G.cap_triples(shop, 6).count() == 6
    with pytest.raises(ValueError):
        G.cap_triples(shop, 5)


def test_describe_takes_blank_nodes_along(spark):
    q = graph(spark, ("a", "p", "_:x"), ("_:x", "q", "_:y"), ("_:y", "q", "_:x"), ("_:y", "r", '"v"'), ("b", "p", "_:z"), ("_:z", "q", '"w"'))
    assert {(r.s, r.p) for r in G.describe(q, "n", "a").collect()} == {("a", "p"), ("x", "q"), ("y", "q"), ("y", "r")}


def test_edge_list_keeps_edges_with_both_ends(spark):
    q = graph(spark, ("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("a", "q", '"lit"'))
    nodes, edges = G.edge_list(q, 3)
    assert {r.node for r in nodes.collect()} == {"a", "b", "c"} and nodes.first().total_nodes == 4
    assert rows(edges.select("s", "o")) == [("a", "b"), ("b", "c")] and edges.first().total_edges == 3


def test_paths_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), (None, "a")], "src string, dst string")
    plus = {tuple(r) for r in P.path_plus(edges).collect()}
    assert plus == {(x, y) for x in "abc" for y in "abcd"} | {("e", "e")}
    assert {r.dst for r in P.path_star(edges, spark.createDataFrame([("d",)], "src string")).collect()} == {"d"}
    assert {tuple(r) for r in P.path_star(edges.where("src = 'c' and dst = 'd'")).collect()} == {("c", "d"), ("c", "c"), ("d", "d")}
    assert P.path_plus(edges.limit(0)).count() == 0


def test_long_chain(spark):
    edges = spark.range(70).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst")
    assert P.path_plus(edges).count() == 70 * 71 // 2


def test_lineage(spark):
    v = spark.createDataFrame([("n", "1", None, True), ("n", "2", "1", True), ("n", "3", "2", True), ("n", "4", None, False), ("n", "5", "4", True)], "ns string, version string, edited_from string, edited_from_recorded boolean")
    assert rows(P.lineage(v).select("version", "ancestor", "depth", "root")) == [("2", "1", 1, True), ("3", "1", 2, True), ("3", "2", 1, False), ("5", "4", 1, None)]


def test_ntriples_round_trip(spark, tmp_path):
    text = 'tab\t "q" back\\slash\nnew é \U0001f600' + 'long "' * 50_000
    q = S.from_rows(spark, [S.quad("n", "", "urn:a", "urn:p", text, "literal"), S.quad("n", "", "urn:a", "urn:p", "x", "literal", o_lang="en-gb"), S.quad("n", "", "b1", "urn:p", "5", "literal", "bnode", T.XSD + "integer"), S.quad("n", "", "urn:a", "urn:p", "b1", "bnode")])
    S.write_ntriples(q, f"{tmp_path}/nt")
    read, bad = S.read_ntriples(spark, f"{tmp_path}/nt", "n")
    assert rows(read) == rows(q) and bad.count() == 0
    (tmp_path / "more.nt").write_text('<urn:a> <urn:p> "\\u00e9\\U0001F600" . # c\n# only\n\n<urn:a> <urn:p> oops .\n')
    read, bad = S.read_ntriples(spark, f"{tmp_path}/more.nt", "n")
    assert [r.o for r in read.collect()] == ["é\U0001f600"] and [r.malformed for r in bad.collect()] == ["<urn:a> <urn:p> oops ."]


def test_graphs_are_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/graphs"
    S.write_graphs(graph(spark, ("a", "p", "b")).unionByName(graph(spark, ("a", "p", "c"), g="urn:g/1")).unionByName(graph(spark, ("x", "p", "y"), ns="m")), path)
    S.write_graph(graph(spark, ("a", "p", "d"), g="urn:g/1"), path, "n", "urn:g/1")
    out = S.read_graphs(spark, path)
    assert rows(out.select("ns", "g", "o")) == [("m", "", "y"), ("n", "", "b"), ("n", "urn:g/1", "d")]
    assert rows(S.list_graphs(out, "n")) == [("urn:g/1",)] and S.has_default_graph_content(out, "n") and not S.has_default_graph_content(out, "q")
    assert S.drop_graph(out, "n", "urn:absent").count() == 3


def test_snapshots(spark, tmp_path):
    """Empty puts and drops count, failed puts don't, and earlier commits stay readable until they are cleared."""
    path = f"{tmp_path}/graphs"
    assert S.read_graphs(spark, path).count() == 0
    S.write_graph(graph(spark, ("a", "p", "b"), ("a", "p", "b")), path, "n")
    S.write_graph(graph(spark, ("a", "p", "c")), path, "n", "urn:g/é 1")
    assert rows(S.read_graphs(spark, path).select("g", "o")) == [("", "b"), ("urn:g/é 1", "c")]
    before = S.read_graphs(spark, path).where("g = ''")
    broken = graph(spark, ("a", "p", "d")).withColumn("o", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        S.write_graph(broken, path, "n")
    assert rows(S.read_graphs(spark, path).where("g = ''").select("o")) == [("b",)]
    number = S.write_graph(graph(spark, ("a", "p", "b")).limit(0), path, "n")
    assert rows(S.read_graphs(spark, path).select("g", "o")) == [("urn:g/é 1", "c")]
    assert rows(S.read_graphs(spark, path, until=number - 1).select("o")) == [("b",), ("c",)] and before.count() == 1
    S.delete_graph(spark, path, "n", "urn:g/é 1")
    S.delete_graph(spark, path, "n", "urn:absent")
    assert S.read_graphs(spark, path).count() == 0
    with pytest.raises(ValueError, match="not of the parts"):
        snapshots.replace(graph(spark, ("a", "p", "b"), ns="m"), path, S.BY, [("n", "")])
    S.write_graph(graph(spark, ("a", "p", "e")), path, "n")
    assert snapshots.clear_old(spark, path) > 0
    assert rows(S.read_graphs(spark, path).select("o")) == [("e",)]


def test_snapshots_are_pruned(spark, tmp_path):
    """Folders of puts that are no more current are not read."""
    path = f"{tmp_path}/graphs"
    for i in range(4):
        S.write_graph(graph(spark, ("a", "p", f"o{i}")), path, "n")
    out = S.read_graphs(spark, path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert rows(out.select("o")) == [("o3",)] and re.search(r"PartitionFilters: \[[^\]]*put#", plan)


def test_two_writers_make_two_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{tmp_path}/graphs"
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: S.write_graph(graph(spark, ("a", "p", f"o{i}")), path, "n", f"urn:g/{i}"), range(4)))
    assert sorted(numbers) == [1, 2, 3, 4] and S.read_graphs(spark, path).count() == 4


def test_mapping_like_the_three_customers(spark):
    customer = spark.createDataFrame([(1, "A b*~", "gold"), (2, "C/d", "silver"), (3, "é", None)], "id int, full_name string, tier string")
    order = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, customer_id int")
    spec = [M.MapRow("c", "customer", "urn:c/{id}/{full_name}", EX + "tier", "column", "tier", class_iri=(EX + "Customer",)), M.MapRow("o", "order", "urn:o/{id}", EX + "by", "template", "urn:k/{customer_id}")]
    q = M.materialize(spec, {"customer": customer, "order": order}, "n")
    assert {r.s for r in q.where(f"p = '{T.TYPE}'").collect()} == {"urn:c/1/A%20b%2A~", "urn:c/2/C%2Fd", "urn:c/3/%C3%A9"}
    assert q.where(f"p = '{EX}tier'").count() == 2 and q.where(f"p = '{EX}by'").count() == 3
    assert M.key_of("urn:c/{id}/{full_name}", "urn:c/1/A%20b%2A~") == {"id": "1", "full_name": "A b*~"}
    assert M.key_of("urn:c/{id}", "urn:d/1") is None
    assert rows(M.instances_of(q, EX + "Party", spark.createDataFrame([(EX + "Customer", EX + "Party")], "src string, dst string"))) == rows(M.instances_of(q, EX + "Customer", spark.createDataFrame([], "src string, dst string")))


def test_components_of_many_short_cycles_take_few_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(f"{i:04}", f"{i - i % 4 + (i + 1) % 4:04}") for i in range(1024)], "src string, dst string")
    calls, settle = [], P.settle
    monkeypatch.setattr(P, "settle", lambda df: calls.append(1) or settle(df))
    got = dict(map(tuple, P.components(edges).collect()))
    assert got == {f"{i:04}": f"{i - i % 4:04}" for i in range(1024)} and len(calls) < 22
