"""Many questions in one scan, against one pattern query each; long histories; the index of trigrams."""

import random
import re

import pytest

from kgspark.functions import terms as T
from kgspark.operators import paths as P
from kgspark.operators import pattern as G
from kgspark.operators import search as R
from kgspark.operators.questions import Question, ask_all
from tests.conftest import rows
from tests.test_graph import graph

NODES, WAYS, WORDS = [f"urn:n{i}" for i in range(6)], ["urn:p", "urn:q", T.TYPE], ['"a"', '"b"']


def random_graph(spark, rng, n):
    return graph(spark, *dict.fromkeys((rng.choice(NODES), rng.choice(WAYS), rng.choice(NODES + WORDS)) for _ in range(n)))


def random_pattern(rng, hub):
    """A pattern with the hub in some place; other places hold constants or variables of their own."""
    term = lambda some, name: rng.choice(some) if rng.random() < 0.6 else f"?{name}{rng.random()}"
    s, p, o = term(NODES, "s"), term(WAYS, "p"), term(NODES + WORDS, "o")
    at = rng.choice("so")
    s, o = (hub, o) if at == "s" else (s, hub)
    kind = ("literal",) if o.startswith('"') else ()
    return (s, p, o.strip('"'), *kind)


def plain(quads, question):
    """Whether a question has a match, by pattern queries."""
    q = G.GraphQuery(quads, "n")
    for s, p, o, *kind in question.patterns:
        q = q.match(s, p, o, **({"o_kind": kind[0]} if kind else {}))
    for s, p, o, *kind in question.absent:
        q = q.not_exists(s, p, o, **({"o_kind": kind[0]} if kind else {}))
    return not q.rows.isEmpty()


def test_like_one_query_each(spark):
    rng = random.Random(5)
    quads = random_graph(spark, rng, 25).cache()
    asked = [Question(f"q{i}", rng.choice(("ask_true", "non_empty", "empty")), [random_pattern(rng, "?x") for _ in range(rng.choice((1, 1, 2, 3)))], [random_pattern(rng, "?x") for _ in range(rng.choice((0, 0, 1)))]) for i in range(30)]
    out = {r.id: r.passed for r in ask_all(asked, quads, "n").collect()}
    assert out == {q.id: plain(quads, q) != (q.expect == "empty") for q in asked}


def test_places_that_must_be_equal_and_literals(spark):
    quads = graph(spark, ("urn:a", "urn:p", "urn:a"), ("urn:b", "urn:p", '"urn:b"'), ("urn:c", "urn:q", '"1"'), ("urn:d", "urn:q", '"1"@en'), ("urn:e", "urn:e", "urn:z"))
    asked = {
        "loop": ([("?x", "urn:p", "?x")], True), "literal loop": ([("urn:b", "urn:p", "urn:b")], False), "subject is way": ([("?x", "?x", "?y")], True), "all": ([("?x", "?x", "?x")], False),
        "one value": ([("urn:c", "urn:q", "?v"), ("urn:d", "urn:q", "?v")], False), "kind": ([("?s", "urn:q", "?v", "iri")], False), "no variable": ([("urn:c", "urn:q", "1", "literal")], True), "apart": ([("?a", "urn:p", "urn:a"), ("?b", "urn:q", "?c")], True),
    }
    out = {r.id: r.passed for r in ask_all([Question(k, "non_empty", v[0]) for k, v in asked.items()], quads, "n").collect()}
    assert out == {k: v[1] for k, v in asked.items()}
    other = ask_all([Question("x", "non_empty", []), Question("y", "some", [("?s", "?p", "?o")]), Question("z", "empty", [("?s", "?p", "?o")])], quads, "m").collect()
    assert {r.id: (r.passed, r.evaluated) for r in other} == {"x": (False, False), "y": (False, False), "z": (True, True)}
    assert not ask_all([Question("x", "non_empty", [])], quads, "n").first().evaluated
    with pytest.raises(ValueError, match="one variable"):
        ask_all([Question("x", "non_empty", [("?a", "urn:p", "?b"), ("?b", "urn:p", "?a")])], quads, "n")


def test_one_scan_for_two_hundred(spark, tmp_path):
    graph(spark, *[(f"urn:n{i}", "urn:p", f"urn:m{i % 7}") for i in range(50)]).write.parquet(f"{tmp_path}/g")
    asked = [Question(f"q{i}", "non_empty", [("?x", "urn:p", f"urn:m{i}")], [("?x", "urn:q", "?y")]) for i in range(200)]
    out = ask_all(asked, spark.read.parquet(f"{tmp_path}/g"), "n")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(r.id for r in out.where("passed").collect()) == [f"q{i}" for i in range(7)]


def history(spark, *pairs):
    return spark.createDataFrame([("n", v, up, recorded) for v, up, recorded in pairs], "ns string, version string, edited_from string, edited_from_recorded boolean")


def test_lineage_of_long_histories(spark):
    n = 600
    chain = history(spark, ("0", None, True), *[(str(i), str(i - 1), True) for i in range(1, n)])
    out = P.lineage(chain)
    assert out.count() == n * (n - 1) // 2 and out.where("cast(version as int) - cast(ancestor as int) <> depth").isEmpty()
    assert out.where("root").count() == n - 1


def test_origins_in_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    settle = P.settle
    monkeypatch.setattr(P, "settle", lambda df: rounds.append(1) or settle(df))
    out = P.origins(history(spark, ("0", None, True), *[(str(i), str(i - 1), True) for i in range(1, n)]))
    assert len(rounds) <= 15 + 1 and out.where("origin = '0' and cast(version as int) = depth and root").count() == n


def test_origins_of_cycles_and_unrecorded(spark):
    v = history(spark, ("a", "b", True), ("b", "a", True), ("c", "a", True), ("d", None, False), ("e", "d", True), ("f", "gone", True), ("g", None, True))
    assert rows(P.origins(v).drop("ns").select("version", "origin", "depth", "root")) == sorted([("a", None, None, None), ("b", None, None, None), ("c", None, None, None), ("d", "d", 0, None), ("e", "d", 1, None), ("f", "gone", 1, None), ("g", "g", 0, True)], key=repr)
    assert rows(P.lineage(v).select("version", "ancestor", "depth")) == sorted([("a", "b", 1), ("a", "a", 2), ("b", "a", 1), ("b", "b", 2), ("c", "a", 1), ("c", "b", 2), ("e", "d", 1), ("f", "gone", 1)], key=repr)


def reachable(pairs):
    plus = set(pairs)
    while True:
        more = {(a, d) for a, b in plus for c, d in plus if b == c} - plus
        if not more:
            return plus
        plus |= more


def test_components_and_closure_of_random_graphs(spark):
    rng = random.Random(9)
    for n, m in ((12, 14), (14, 24)):
        pairs = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
        edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
        plus = reachable(pairs)
        members, between = P.reach(edges)
        made = between.join(members.selectExpr("component as src", "node as a"), "src").join(members.selectExpr("component as dst", "node as b"), "dst").select("a", "b")
        assert rows(made) == sorted(plus, key=repr) == rows(P.path_plus(edges))
        nodes = {x for pair in pairs for x in pair}
        least = lambda x: min([x, *(y for y in nodes if (x, y) in plus and (y, x) in plus)])  # noqa: B023, E731
        assert rows(P.components(edges)) == sorted([(x, least(x)) for x in nodes], key=repr)


def test_a_long_cycle_is_one_pair(spark):
    n = 40
    cycle = spark.range(n).selectExpr("id as src", f"(id + 1) % {n} as dst")
    tail = spark.range(n, 2 * n).selectExpr("id as src", f"case when id = {2 * n - 1} then 0 else id + 1 end as dst")
    members, pairs = P.reach(cycle.unionByName(tail))
    assert members.where(f"node < {n}").select("component").distinct().collect()[0][0] == 0 and pairs.where("src = 0 and dst = 0").count() == 1
    assert members.where(f"node < {n} and component <> 0").isEmpty() and members.where(f"node >= {n} and component <> node").isEmpty()


def run_by_run(query, text):
    wanted, seen, best = set(R.ordered_trigrams(query)), R.ordered_trigrams(text), 0.0
    for i in range(len(seen)):
        for j in range(i, len(seen)):
            own = set(seen[i : j + 1])
            best = max(best, len(own & wanted) / len(own | wanted))
    return best


def test_best_run_is_exact(spark):
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice(("ab ", "abc  ", "abcdefgh ", "a b"))
        query, text = ("".join(rng.choice(letters) for _ in range(rng.randint(1, n))) for n in (12, 30))
        if query.strip():
            exact = run_by_run(query, text)
            assert R.word_similarity(query, text) == exact
            assert R.word_similarity(query, text, 0.6) == (exact if exact >= 0.6 else 0.0)
            seen = R.ordered_trigrams(text)
            repeats, wanted = len(seen) - len(set(seen)), set(R.ordered_trigrams(query))
            bound = R.best_run(wanted, [(i, t) for i, t in enumerate(seen) if t in wanted], 0.0, repeats)
            assert bound == exact if repeats == 0 else bound >= exact


def test_index_finds_the_same(spark, tmp_path):
    rng = random.Random(2)
    words = ["order", "customer", "orders", "id", "ordering", "Bestellung", "注文", "ab", "abab"]
    terms = spark.createDataFrame([(f"t{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(200)] + [("none", None), ("empty", "")], "iri string, source_text string")
    path = f"{tmp_path}/index"
    R.build_trigram_index(terms, path)
    for query in ("order id", "注文", "ababab", "customer", "nothing like it", "--"):
        for threshold in (0.3, 0.6, 1.0):
            assert R.search_index(spark, path, query, 20, threshold).collect() == R.search_trigram(terms, query, 20, threshold).collect(), query
    plan = R.search_index(spark, path, "order", 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)
    with pytest.raises(ValueError, match="blank"):
        R.search_index(spark, path, "  ", 5)
