"""Search, logs, health, catalog and streams."""

import pytest
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import catalog as K
from kgspark.operators import health as H
from kgspark.operators import logs as L
from kgspark.operators import search as R
from kgspark.streaming import access as A
from tests.conftest import rows
from tests.test_graph import EX, graph


def test_word_similarity_is_one_sided(spark):
    assert R.word_similarity("顧客id", "これは 顧客ID である") == 1.0
    assert R.word_similarity("word", "two words") == 0.8
    assert R.word_similarity("", "x") == 0.0
    terms = spark.createDataFrame([("b", "顧客ID / customer"), ("a", "顧客id"), ("c", "注文"), ("d", None)], "iri string, source_text string")
    assert rows(R.search_trigram(terms, "顧客ID", 5)) == [("a", 1.0), ("b", 1.0)]
    with pytest.raises(ValueError):
        R.search_trigram(terms, "  ", 5)


def test_vector_axes(spark):
    terms = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("w", [1.0])], "iri string, embedding array<double>")
    assert [tuple(r) for r in R.search_vector(terms, [1.0, 0.0], 3).collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]


def test_fusion(spark):
    side = lambda *xs: spark.createDataFrame([(i, s, f"{i} text") for i, s in xs], "iri string, similarity double, source_text string")
    hits = R.fuse_rrf(side(("a", 0.9), ("b", 0.8)), side(("b", 0.7), ("c", 0.6)), 0).collect()
    assert [(r.iri, r.route) for r in hits] == [("b", "both")]
    hits = R.fuse_rrf(side(("a", 0.9), ("b", 0.8)), side(("b", 0.7), ("c", 0.6)))
    assert [(r.iri, r.route, r.vector_similarity) for r in hits.collect()] == [("b", "both", 0.8), ("a", "vector", 0.9), ("c", "trigram", None)]
    assert tuple(R.route_summary(hits).first()) == (1, 1, 1)
    out = R.search_outcome(hits, spark.createDataFrame([("a",)], "iri string"), False).first()
    assert (out.hits, out.deprecated_hits, out.conclusive) == (3, ["a"], False) and out.note


def test_term_texts(spark):
    q = graph(spark, (EX + "A", T.TYPE, T.CLASS), (EX + "A", T.LABEL, '"b"@en'), (EX + "A", T.LABEL, '"あ"@ja'), (EX + "A", T.COMMENT, '"' + "c" * 5000 + '"'), (EX + "o", T.TYPE, T.OWL + "Ontology"), ("_:x", T.TYPE, T.CLASS))
    out = R.term_texts(q).collect()
    assert len(out) == 1 and out[0].source_text.startswith("A / b / あ / ccc") and len(out[0].source_text) == 4000 and out[0].truncated


def test_rebuild_replaces_a_namespace(spark, tmp_path):
    q = graph(spark, (EX + "A", T.TYPE, T.CLASS), (EX + "B", T.TYPE, T.CLASS))
    embed = lambda texts: [[float(len(t))] for t in texts]
    for ns, rows_ in (("n", q), ("m", q), ("n", q.where(f"s = '{EX}A'"))):
        R.rebuild_embeddings(rows_, ns, "1.0.0", embed, "len", f"{tmp_path}/e")
    assert rows(R.embeddings(spark, f"{tmp_path}/e").groupBy("ns").count()) == [("m", 2), ("n", 1)]
    R.rebuild_embeddings(q.limit(0), "m", "1.1.0", embed, "len", f"{tmp_path}/e")
    assert rows(R.embeddings(spark, f"{tmp_path}/e").select("ns", "iri")) == [("n", EX + "A")]

    def broken(texts):
        raise OSError("no model")

    with pytest.raises(Exception, match="no model"):
        R.rebuild_embeddings(q, "n", "1.2.0", broken, "len", f"{tmp_path}/e")
    assert rows(R.embeddings(spark, f"{tmp_path}/e").select("built_from_version")) == [("1.0.0",)]


def test_query_forms(spark):
    cases = [("SELECT * {}", "select", True), ("# SELECT\nask {}", "ask", True), ("CONSTRUCT { ?s ?p 'SELECT' } WHERE { SELECT * {} }", "construct", True), ('DESCRIBE <urn:DROP>', "describe", True), ("SELECT * { SERVICE <u> {} }", "select", False), ("INSERT DATA {}", "unknown", False), ("", "unknown", False), ("SELECT '''a ' DELETE''' {}", "select", True), ("SELECT '" + "x\\' DROP " * 60_000 + "' {}", "select", True), ('SELECT """a "" \\""" DROP ' + '"' * 3 + ' {}', "select", True), ('SELECT "open DROP', "select", False), ("WITH <g> DELETE { ?s ?p ?o } WHERE { SELECT * {} }", "select", False)]
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(cases)], "i int, q string")
    out = df.select("i", T.query_form(F.col("q")), T.is_read_only(F.col("q"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in out] == [c[1:] for c in cases]
    graphs = spark.createDataFrame([("{ GRAPH ?g {} }",), ("?graph",), ("ex:graph",), ("paragraph",), ("# graph",)], "q string").select(T.uses_graph_clause(F.col("q")))
    assert [r[0] for r in graphs.collect()] == [True, False, False, False, True]


def test_identifiers(spark):
    iris = [("https://e/a#b", True), ("urn:x", True), ("no-scheme", False), ("urn:a b", False), ("urn:" + "a" * 1021, False), ("", False), (None, False), ("urn:x\n", False)]
    assert [r[0] for r in spark.createDataFrame(iris, "i string, w boolean").select(T.valid_term_iri(F.col("i"))).collect()] == [w for _, w in iris]
    names = [("ab", True), ("a", False), ("ds", False), ("ds\n", False), ("Ab", False), ("a" * 64, False)]
    assert [r[0] for r in spark.createDataFrame(names, "n string, w boolean").select(T.valid_namespace(F.col("n"))).collect()] == [w for _, w in names]
    local = [("https://e/a#b", "b"), ("https://e/a/", "https://e/a/"), ("urn:x", "urn:x")]
    assert [r[0] for r in spark.createDataFrame(local, "i string, w string").select(T.local_name(F.col("i"))).collect()] == [w for _, w in local]


def test_page_bounds(spark):
    events = spark.range(1, 21).selectExpr("id", "timestamp_seconds(id * 10) as occurred_at", "'n' as namespace")
    assert [r.id for r in L.page(events, 2, 10).collect()] == [9, 8, 7]
    assert L.page(events, 0).count() == 2 and L.page(events).count() == 20
    since, until = (F.timestamp_seconds(F.lit(x)) for x in (50, 80))
    assert [r.id for r in L.page(events, 9, None, since, until).collect()] == [7, 6, 5]
    kept, gone = L.purge_before(events, "n", since)
    assert kept.count() == 16 and gone.first().purged == 4


def test_agents_need_agreement(spark):
    audit = spark.createDataFrame([(1, "n", "a", "published", "n@1.0.0", "user", None), (2, "n", "a", "approved", "n@1.0.0", None, "ok"), (3, "n", "b c", "questions-revised", "n#questions@3", "service-principal", ""), (4, "m", "x", "published", "m@1", "user", None)], "id int, namespace string, actor string, action string, subject string, actor_type string, reason string").selectExpr("*", "timestamp'2024-01-01 00:00:00' as occurred_at", "cast(null as string) as diff")
    versions = spark.createDataFrame([("n", "1.0.0", "0.9", False)], "namespace string, version string, edited_from string, edited_from_recorded boolean")
    out = {tuple(r)[:3] for r in L.prov_triples(audit, versions, "n", True, "2024-01-02T00:00:00").collect()}
    agent = L.AGENT + "b%20c"
    assert (agent, T.TYPE, T.PROV + "SoftwareAgent") in out and (L.AGENT + "a", T.TYPE, T.PROV + "Person") not in out and (L.AGENT + "a", T.TYPE, T.PROV + "Agent") in out
    revision = L.REVISION + "n/1.0.0"
    assert (L.ACTIVITY + "1", T.PROV + "generated", revision) in out and (L.ACTIVITY + "2", T.PROV + "used", revision) in out
    assert (revision, L.ONT + "editedFromRecorded", "false") in out and not any(p == T.PROV + "wasDerivedFrom" for _, p, _ in out)
    assert (L.BUNDLE + "n", L.ONT + "eventCount", "3") in out and (L.BUNDLE + "n", L.ONT + "truncated", "true") in out
    assert rows(L.referenced_versions(audit)) == [("m", "1"), ("n", "1.0.0")]


def test_health_boundary_and_unmeasured(spark):
    terms = spark.createDataFrame([(x,) for x in ("in", "out", "never", "edge")], "iri string")
    access = spark.createDataFrame([("in", "2024-03-01 00:00:00"), ("out", "2024-01-01 11:59:59"), ("edge", "2024-01-01 12:00:00"), ("alien", "2024-03-01 00:00:00")], "term_iri string, last_accessed_at string")
    access = access.withColumn("last_accessed_at", F.col("last_accessed_at").cast("timestamp_ntz"))
    owned = spark.createDataFrame([("in",), ("alien",)], "term_iri string")
    row = H.health_report(terms, access, owned, "2024-03-31 12:00:00", "2024-03-30 13:00:00").first()
    assert row.unreferenced_terms == ["never", "out"] and row.unreferenced_ratio == 0.5 and row.without_owner_terms == ["edge", "never", "out"] and row.approval_age_days == 0 and row.shacl_violation_count is None
    row = H.health_report(None, access, owned, "2024-03-31 12:00:00", None, ("terms",)).first()
    assert row.term_count is None and row.unreferenced_ratio is None and row.unavailable == ["terms"] and row.approval_age_days is None
    assert H.health_report(terms.limit(0), access, owned, "2024-03-31 12:00:00").first().unreferenced_ratio == 0.0


def test_statistics(spark):
    df = spark.createDataFrame([(5.0, 10.0, True), (0.0, -1.0, True), (-1.0, 3.0, False), (-0.5, 0.0, True), (None, None, None)], "n double, r double, a boolean")
    count, ratio = K.decode_stats(F.col("n"))
    assert [tuple(r) for r in df.select(count, ratio, K.decode_rows(F.col("r"), F.col("a"))).collect()] == [(5, None, 10), (0, None, None), (None, 1.0, None), (None, 0.5, 0), (None, None, None)]


def test_profiles_from_sketches_of_parts(spark, tmp_path):
    """The union of parts is as near to the exact counts as a whole, whatever parts share; an empty part and a dropped one count nothing."""
    path, rows_ = f"{tmp_path}/sketches", spark.range(60_000).selectExpr("id", "id % 7 as few", "cast(id % 25000 as double) as half", "case when id % 4 = 0 then cast(id as string) end as some")
    for part, keep in (("a", "id < 20000"), ("b", "id >= 20000 and id < 50000"), ("c", "id >= 50000"), ("none", "false"), ("b", "id >= 15000 and id < 50000"), ("b", "id >= 20000 and id < 50000")):
        K.profile_part(rows_.where(keep), "t", part, path)
    exact = {r.column_name: r for r in K.profile_table(rows_, "t", exact=True).collect()}
    whole = {r.column_name: r for r in K.profile_sketches(K.sketch_table(rows_, "t", "all")).collect()}
    for r in K.stored_profile(spark, path).collect():
        want = exact[r.column_name]
        assert (r.row_count, r.null_fraction) == (want.row_count, want.null_fraction)
        assert abs(r.distinct_count / want.distinct_count - 1) < 0.02 and abs(r.distinct_count / whole[r.column_name].distinct_count - 1) < 0.02
        assert abs(r.distinct_ratio - r.distinct_count / 60_000) < 1e-12
    K.drop_part(spark, "t", "c", path)
    assert {r.row_count for r in K.stored_profile(spark, path).collect()} == {50_000}
    for r in K.profile_table(rows_, "t").collect():
        assert abs(r.distinct_count / exact[r.column_name].distinct_count - 1) < 0.15
    assert K.profile_sketches(K.sketch_table(rows_.limit(0), "t", "x")).where("null_fraction is not null or distinct_count <> 0").isEmpty()


def test_sources_are_read_together_and_in_order(spark):
    import threading

    gate = threading.Barrier(3, timeout=60)

    def waits():
        gate.wait()
        return spark.range(1)

    out, states = K.sweep(spark, {name: waits for name in "cab"})
    assert [r.source for r in states.collect()] == ["c", "a", "b"] and out.count() == 3


def test_relations_and_sweep(spark):
    sql = "select * from a.b join C x on 1=1 left join lateral (select 1 from (select 2 FROM d)) y -- from e"
    assert spark.createDataFrame([(sql,)], "q string").select(T.referenced_relations(F.col("q"))).first()[0] == ["C", "a.b", "d", "e"]

    def lost():
        raise OSError("no route")

    breaks = lambda: spark.range(2).selectExpr("raise_error('gone while read') as id")
    out, states = K.sweep(spark, {"a": lambda: spark.range(2), "b": lost, "c": breaks})
    assert out.count() == 2 and rows(states.select("source", "status")) == [("a", "succeeded"), ("b", "failed"), ("c", "failed")]
    assert "gone while read" in states.where("source = 'c'").first().error
    assert tuple(K.sweep_summary(states).first()) == (3, 1, 2)


def test_generation_marks(spark):
    reasons = ["LLM による生成(試行 3 回、model=gpt、deployment=d1)", "LLM による生成(試行 x 回)", "by hand model=z", None]
    out = spark.createDataFrame([(r,) for r in reasons], "r string").select(T.generation_provenance(F.col("r")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in out] == [(True, 3, "gpt", "d1", True), (True, None, None, None, None), (False, None, None, None, None), (False, None, None, None, None)]


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    events = spark.range(40).selectExpr("id % 30 as id", "'n' as namespace", "timestamp_seconds(1000000 + id % 30) as occurred_at", "array('t' || id % 3, 't' || id % 3, 'u') as terms")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        A.stream_term_access(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    want = rows(L.term_access(events))
    assert rows(A.read_term_access(spark, f"{tmp_path}/out")) == want
    A.compact(spark, f"{tmp_path}/out", 0)
    assert rows(A.read_term_access(spark, f"{tmp_path}/out")) == want


def test_batches_are_merged(spark, tmp_path):
    """Every second batch merges; a merge that stopped half way is not seen, and repeated deletes nothing that counts."""
    events = spark.range(60).selectExpr("id", "'n' as namespace", "timestamp_seconds(1000000 + id) as occurred_at", "array('t' || id % 3) as terms")
    for i in range(5):
        events.where(f"id % 5 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/f={i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    A.stream_term_access(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "1 hour", 2).awaitTermination()
    last = A.newest_merged(spark, f"{tmp_path}/out")
    folders = {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").glob("*/*")}
    assert last in (3, 5) and f"kind=merged/number={last}" in folders and folders <= {f"kind=merged/number={last}", *(f"kind=batch/number={n}" for n in range(last + 1, 9))}
    want = rows(L.term_access(events))
    assert rows(A.read_term_access(spark, f"{tmp_path}/out")) == want
    events.limit(3).selectExpr("namespace", "'t0' as term_iri", "1L as access_count", "occurred_at as last_accessed_at").write.parquet(f"{tmp_path}/out/kind=merged/number=8")
    (tmp_path / "out/kind=merged/number=8/_SUCCESS").unlink()
    assert rows(A.read_term_access(spark, f"{tmp_path}/out")) == want
    A.compact(spark, f"{tmp_path}/out", 8)
    A.compact(spark, f"{tmp_path}/out", 8)
    assert rows(A.read_term_access(spark, f"{tmp_path}/out")) == want
