"""Queries of graph patterns, paths, files and table mapping (S, G and M of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import mapping as M
from kgspark.operators import paths as P
from kgspark.operators import pattern as G
from kgspark.plans import data as D
from kgspark.plans.registry import query
from kgspark.sources import quads as S


def ask(spark, sf_dir) -> G.GraphQuery:
    return G.GraphQuery(D.graph(spark, sf_dir), D.NS)


ORDERS = f"SELECT {D.order('o_orderkey')} AS o, {D.cust('o_custkey')} AS c, CAST(o_totalprice AS VARCHAR) AS t FROM orders"


@query("g01_pattern", f"SELECT {D.cust('c_custkey')} AS c, c_name AS n FROM customer")
def g01(spark, sf_dir):
    return ask(spark, sf_dir).match("?c", D.NAME, "?n").select("c", "n")


@query("g02_orders_with_customers", f"SELECT {D.order('o_orderkey')} AS o, c_name AS n, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey")
def g02(spark, sf_dir):
    q = ask(spark, sf_dir).bgp([("?o", D.OF, "?c"), ("?o", D.TOTAL, "?t"), ("?c", D.NAME, "?n")])
    return q.select("o", "n", "t").select("o", "n", F.round(F.col("t").try_cast("double"), 2).alias("total"))


@query("g02_cross_product", "SELECT c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def g02_cross(spark, sf_dir):
    """The first two patterns have no variable in common; the third ties them, so that their product is never made."""
    return ask(spark, sf_dir).bgp([("?x", D.NAME, "?c"), ("?y", T.LABEL, "?n"), ("?x", D.IN, "?y")]).select("c", "n")


@query("g03_optional", f"SELECT {D.cust('c_custkey')} AS c, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer")
def g03(spark, sf_dir):
    return ask(spark, sf_dir).match("?c", T.TYPE, D.CUSTOMER).optional("?c", D.SEGMENT, "?seg").select("c", "seg")


@query(
    "g03_match_after_optional",
    f"SELECT {D.cust('c_custkey')} AS c, seg, n FROM customer JOIN (SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) ON c_mktsegment = seg OR c_mktsegment = 'BUILDING'",
)
def g03_after(spark, sf_dir):
    """A customer without a segment fits every segment's figure, as an unbound variable fits any value."""
    q = ask(spark, sf_dir)
    sizes = P.settle(q.match("?d", D.SEGMENT, "?seg").rows.groupBy("seg").agg(F.count("*").alias("n")))
    return q.match("?c", T.TYPE, D.CUSTOMER).optional("?c", D.SEGMENT, "?seg").join(sizes).select("c", "seg", "n")


@query("g04_not_bound", f"SELECT {D.cust('c_custkey')} AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def g04(spark, sf_dir):
    return ask(spark, sf_dir).match("?c", T.TYPE, D.CUSTOMER).optional("?c", D.SEGMENT, "?seg").filter("seg is null").select("c")


@query("g05_not_exists", f"SELECT '{D.DATA}nation/' || n_nationkey AS n FROM nation WHERE n_name NOT LIKE 'NATION_1%'")
def g05(spark, sf_dir):
    where = (F.col("l_lang") == "en") & F.col("l").startswith("NATION_1")
    return ask(spark, sf_dir).match("?n", T.TYPE, D.NATION).not_exists("?n", T.LABEL, "?l", where=where).select("n")


@query("g06_lacks_either", f"SELECT {D.cust('c_custkey')} AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def g06(spark, sf_dir):
    return ask(spark, sf_dir).match("?c", T.TYPE, D.CUSTOMER).lacks_any(("?c", D.SEGMENT, "?seg"), ("?c", D.NAME, "?n")).select("c")


@query("g07_union", f"SELECT {D.cust('c_custkey')} AS x, c_name AS name, NULL::VARCHAR AS label FROM customer UNION ALL SELECT '{D.DATA}nation/' || n_nationkey, NULL, n_name FROM nation")
def g07(spark, sf_dir):
    q = ask(spark, sf_dir)
    return q.match("?x", D.NAME, "?name").union(q.match("?x", T.LABEL, "?label")).select("x", "name", "label")


@query("g08_ask", "SELECT count(*) > 0 AS answer FROM customer WHERE c_mktsegment = 'MACHINERY'")
def g08(spark, sf_dir):
    return ask(spark, sf_dir).match("?c", D.SEGMENT, "MACHINERY", o_kind="literal").ask()


@query("g09_distinct", "SELECT DISTINCT c_mktsegment AS seg FROM customer WHERE c_mktsegment <> 'BUILDING'")
def g09(spark, sf_dir):
    return ask(spark, sf_dir).match("?c", D.SEGMENT, "?seg").select_distinct("seg")


@query("g10_counts", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def g10(spark, sf_dir):
    q = ask(spark, sf_dir).match("?o", D.OF, "?c")
    return q.count("n").crossJoin(q.count_distinct("c", "customers"))


@query("g11_top_orders", f"SELECT {D.order('o_orderkey')} AS o, round(o_totalprice, 2) AS total FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 20")
def g11(spark, sf_dir):
    q = ask(spark, sf_dir).match("?o", D.TOTAL, "?t").bind(total=F.col("t").try_cast("double"))
    return q.rows.orderBy(F.desc("total"), "o").limit(20).select("o", F.round("total", 2).alias("total"))


def two_graphs(spark, sf_dir):
    q = D.graph(spark, sf_dir).where(F.col("p") == D.SEGMENT)
    even = F.substring_index("s", "/", -1).cast("long") % 2 == 0
    return q.withColumn("g", F.when(even, "https://e.example/graph/even").otherwise("https://e.example/graph/odd"))


TWO = "CASE WHEN c_custkey % 2 = 0 THEN 'https://e.example/graph/even' ELSE 'https://e.example/graph/odd' END"


@query("g12_named_graphs", f"SELECT {TWO} AS g, {D.cust('c_custkey')} AS c, c_mktsegment AS seg FROM customer WHERE c_mktsegment <> 'BUILDING'")
def g12(spark, sf_dir):
    return G.GraphQuery(two_graphs(spark, sf_dir), D.NS).graph("?g").match("?c", D.SEGMENT, "?seg").select("g", "c", "seg")


@query("g13_construct", f"SELECT {D.cust('c_custkey')} AS s, 'urn:in' AS p, '{D.DATA}nation/' || c_nationkey AS o FROM customer UNION SELECT {D.cust('c_custkey')}, 'urn:segment', c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def g13(spark, sf_dir):
    q = ask(spark, sf_dir).match("?c", D.IN, "?n").optional("?c", D.SEGMENT, "?seg")
    return q.construct(("?c", "urn:in", "?n"), ("?c", "urn:segment", "?seg"))


@query("g14_describe", f"SELECT p, o FROM (SELECT '{T.TYPE}' AS p, '{D.CUSTOMER}' AS o UNION ALL SELECT '{D.NAME}', c_name FROM customer WHERE c_custkey = 7 UNION ALL SELECT '{D.SEGMENT}', nullif(c_mktsegment, 'BUILDING') FROM customer WHERE c_custkey = 7 UNION ALL SELECT '{D.IN}', '{D.DATA}nation/' || c_nationkey FROM customer WHERE c_custkey = 7) WHERE o IS NOT NULL")
def g14(spark, sf_dir):
    return G.describe(D.graph(spark, sf_dir), D.NS, f"{D.DATA}customer/7").select("p", "o")


@query("g15_path_plus", f"WITH RECURSIVE {D.EDGES}, {D.CLOSURE} SELECT src, dst FROM plus")
def g15(spark, sf_dir):
    return P.path_plus(D.edges(spark, sf_dir))


MUTUAL = "mutual AS (SELECT a.src AS node, a.dst AS other FROM plus a JOIN plus b ON a.src = b.dst AND a.dst = b.src)"
ENDS = "ends AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"


@query("g15_components", f"WITH RECURSIVE {D.EDGES}, {D.CLOSURE}, {MUTUAL}, {ENDS} SELECT node, least(node, coalesce(min(other), node)) AS component FROM ends LEFT JOIN mutual USING (node) GROUP BY node")
def g15_components(spark, sf_dir):
    return P.components(D.edges(spark, sf_dir))


@query("g15_reach_counts", f"WITH RECURSIVE {D.EDGES}, {D.CLOSURE} SELECT src AS node, count(*) AS reached FROM plus GROUP BY src")
def g15_counts(spark, sf_dir):
    """How many nodes each node reaches, from components and their sizes: the pairs are never made."""
    members, pairs = P.reach(D.edges(spark, sf_dir))
    sizes = members.groupBy(F.col("component").alias("dst")).agg(F.count("*").alias("size"))
    sums = pairs.join(sizes, "dst").groupBy(F.col("src").alias("component")).agg(F.sum("size").alias("reached"))
    return members.join(sums, "component").select("node", "reached")


@query("g15_path_star_from", f"WITH RECURSIVE {D.EDGES}, {D.CLOSURE} SELECT dst FROM plus WHERE src = '3' UNION SELECT '3'")
def g15_from(spark, sf_dir):
    return P.path_star(D.edges(spark, sf_dir), spark.createDataFrame([("3",)], "src string")).select("dst")


@query("g16_path_sequence", f"WITH RECURSIVE {D.HIERARCHY}, up AS (SELECT src, dst FROM hierarchy UNION SELECT up.src, h.dst FROM up JOIN hierarchy h ON up.dst = h.src), typed AS (SELECT {D.cust('c_custkey')} AS src, '{D.BASE}' || n_name AS cls FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT src, cls AS dst FROM typed UNION SELECT typed.src, up.dst FROM typed JOIN up ON typed.cls = up.src")
def g16(spark, sf_dir):
    c, n = D.table(spark, sf_dir, "customer"), D.table(spark, sf_dir, "nation")
    typed = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(F.lit(D.DATA + "customer/"), c.c_custkey.cast("string")).alias("src"), F.concat(F.lit(D.BASE), "n_name").alias("dst"))
    return P.path_seq(typed, D.hierarchy(spark, sf_dir))


@query("g17_term_filter", "SELECT n_name AS label FROM nation")
def g17(spark, sf_dir):
    q = ask(spark, sf_dir).match("?x", T.LABEL, "?label", details=True)
    return q.filter((F.col("label_kind") == "literal") & (F.col("label_lang") == "en")).select("label")


@query("g18_cap_rows", f"SELECT {D.cust('c_custkey')} AS c, (SELECT count(*) FROM customer) AS total, true AS truncated FROM customer ORDER BY 1 LIMIT 50")
def g18(spark, sf_dir):
    return G.cap_rows(ask(spark, sf_dir).match("?c", T.TYPE, D.CUSTOMER).select("c"), 50, "c").select("c", "total", "truncated")


@query("g19_cap_triples", f"SELECT '{D.DATA}nation/' || n_nationkey AS s, n_name AS o, 'en' AS o_lang FROM nation")
def g19(spark, sf_dir):
    return G.cap_triples(D.graph(spark, sf_dir).where(F.col("p") == T.LABEL), 50_000).select("s", "o", "o_lang")


@query("g20_deprecated_in_result", f"WITH {D.REVISIONS} SELECT DISTINCT o AS iri FROM new WHERE p = '{D.BASE}like' AND o IN (SELECT s FROM new WHERE p = '{T.DEPRECATED}')")
def g20(spark, sf_dir):
    from kgspark.operators.lifecycle import deprecated_terms

    quads = D.revision(spark, sf_dir, True)
    result = G.GraphQuery(quads, D.NS).match("?a", D.BASE + "like", "?b", details=True).rows
    return G.deprecated_in_result(G.long_cells(result, "b"), deprecated_terms(quads))


@query("g21_terms_with_prefix", f"WITH {D.REVISIONS} SELECT s AS iri FROM new UNION SELECT o FROM new WHERE o_kind = 'iri' AND starts_with(o, '{D.BASE}') UNION SELECT p FROM new WHERE starts_with(p, '{D.BASE}')")
def g21(spark, sf_dir):
    return G.terms_with_prefix(D.revision(spark, sf_dir, True), D.BASE)


@query(
    "g22_edge_list",
    f"""WITH {D.REVISIONS}, links AS (SELECT DISTINCT s, p, o FROM new WHERE o_kind = 'iri'), named AS (SELECT s AS node, s, p, o, 0 AS i FROM links UNION ALL SELECT o, s, p, o, 1 FROM links),
  nodes AS (SELECT node, min((s, p, o, i)) AS place FROM named GROUP BY node ORDER BY place, node LIMIT 200)
  SELECT s, p, o, (SELECT count(*) FROM links) AS total_edges FROM links WHERE s IN (SELECT node FROM nodes) AND o IN (SELECT node FROM nodes)""",
)
def g22(spark, sf_dir):
    return G.edge_list(D.revision(spark, sf_dir, True))[1]


@query("s01_read_table", "SELECT c_custkey, c_name FROM customer")
def s01(spark, sf_dir):
    return S.read_table(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")


@query("s02_s07_ntriples", f"SELECT {D.cust('c_custkey')} AS s, '{D.NAME}' AS p, c_name AS o, 'literal' AS o_kind FROM customer UNION ALL SELECT '{D.DATA}nation/' || n_nationkey, '{T.LABEL}', n_name, 'literal' FROM nation")
def s02(spark, sf_dir):
    """Triples are written to N-Triples files, which are then read."""
    from uuid import uuid4

    path = f"{P.scratch(spark)}/ntriples-{uuid4().hex}"
    S.write_ntriples(D.graph(spark, sf_dir).where(F.col("p").isin(D.NAME, T.LABEL)), path)
    return S.read_ntriples(spark, path, D.NS)[0].select("s", "p", "o", "o_kind")


@query("s03_write_graph", f"SELECT {TWO} AS g, {D.cust('c_custkey')} AS s, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS o FROM customer WHERE c_mktsegment <> 'BUILDING'")
def s03(spark, sf_dir):
    """Two graphs are written, then one of them is replaced."""
    from uuid import uuid4

    path = f"{P.scratch(spark)}/graphs-{uuid4().hex}"
    quads = two_graphs(spark, sf_dir)
    S.write_graphs(quads, path)
    S.write_graph(quads.where(F.col("g") == EVEN).withColumn("o", F.concat(F.upper("o"), F.lit("!"))), path, D.NS, EVEN)
    return S.read_graphs(spark, path).where(F.col("ns") == D.NS).select("g", "s", "o")


EVEN, ODD = "https://e.example/graph/even", "https://e.example/graph/odd"
KEPT = f"SELECT {TWO} AS g, {D.cust('c_custkey')} AS s, c_mktsegment AS o FROM customer WHERE c_mktsegment <> 'BUILDING'"


def stored(spark, sf_dir):
    """The two graphs in a table, and its path."""
    from uuid import uuid4

    path = f"{P.scratch(spark)}/graphs-{uuid4().hex}"
    S.write_graphs(two_graphs(spark, sf_dir), path)
    return path


@query("s03_put_empty_graph", f"SELECT * FROM ({KEPT}) WHERE g <> '{EVEN}'")
def s03_empty(spark, sf_dir):
    """One of two graphs is replaced by an empty one."""
    path = stored(spark, sf_dir)
    S.write_graph(two_graphs(spark, sf_dir).limit(0), path, D.NS, EVEN)
    return S.read_graphs(spark, path).select("g", "s", "o")


@query("s03_read_as_of", KEPT)
def s03_until(spark, sf_dir):
    """The table as it was before a graph was replaced."""
    path = stored(spark, sf_dir)
    S.write_graph(two_graphs(spark, sf_dir).where(F.col("g") == ODD), path, D.NS, EVEN)
    return S.read_graphs(spark, path, until=1).select("g", "s", "o")


@query("s04_delete_stored_graph", f"SELECT * FROM ({KEPT}) WHERE g <> '{ODD}'")
def s04_stored(spark, sf_dir):
    """One of two graphs is removed from the table, and one that isn't there."""
    path = stored(spark, sf_dir)
    S.delete_graph(spark, path, D.NS, ODD)
    S.delete_graph(spark, path, D.NS, "urn:absent")
    return S.read_graphs(spark, path).select("g", "s", "o")


@query("s04_drop_graph", f"SELECT {D.cust('c_custkey')} AS s, c_mktsegment AS o FROM customer WHERE c_custkey % 2 = 1 AND c_mktsegment <> 'BUILDING'")
def s04(spark, sf_dir):
    return S.drop_graph(two_graphs(spark, sf_dir), D.NS, "https://e.example/graph/even").select("s", "o")


@query("s05_list_graphs", f"SELECT DISTINCT {TWO} AS g FROM customer WHERE c_mktsegment <> 'BUILDING'")
def s05(spark, sf_dir):
    return S.list_graphs(two_graphs(spark, sf_dir), D.NS)


@query("s06_default_graph_content", "SELECT count(*) > 0 AS answer FROM customer")
def s06(spark, sf_dir):
    return D.graph(spark, sf_dir).where("g = ''").limit(1).agg((F.count("*") > 0).alias("answer"))


def _doc(*fields: tuple[str, str, str]) -> str:
    """SQL for a node's JSON object from (predicate, value, rest of the entry), in order of predicates."""
    entry = lambda p, value, rest: f"CASE WHEN {value} IS NOT NULL THEN '\"{p}\":[{{\"value\":' || to_json({value})::VARCHAR || '{rest}}}]' END"
    return "'{' || array_to_string(list_filter([" + ", ".join(entry(*x) for x in sorted(fields)) + "], lambda x: x IS NOT NULL), ',') || '}'"


IRI_ENTRY, TEXT_ENTRY, EN_ENTRY = ',"kind":"iri"', ',"kind":"literal"', ',"kind":"literal","language":"en"'


@query(
    "s08_node_documents",
    f"""SELECT {D.cust('c_custkey')} AS s, {_doc((T.TYPE, f"'{D.CUSTOMER}'", IRI_ENTRY), (D.NAME, "c_name", TEXT_ENTRY), (D.SEGMENT, "nullif(c_mktsegment, 'BUILDING')", TEXT_ENTRY), (D.IN, f"'{D.DATA}nation/' || c_nationkey", IRI_ENTRY))} AS doc FROM customer
  UNION ALL SELECT {D.order('o_orderkey')}, {_doc((T.TYPE, f"'{D.ORDER}'", IRI_ENTRY), (D.OF, D.cust('o_custkey'), IRI_ENTRY))} FROM orders
  UNION ALL SELECT '{D.DATA}nation/' || n_nationkey, {_doc((T.TYPE, f"'{D.NATION}'", IRI_ENTRY), (T.LABEL, "n_name", EN_ENTRY))} FROM nation""",
)
def s08(spark, sf_dir):
    """All but the totals, which two engines may write differently."""
    return S.node_documents(D.graph(spark, sf_dir).where(F.col("p") != D.TOTAL))


@query("s10_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def s10(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


TRIPLES = f"""SELECT {D.cust('c_custkey')} AS s, '{T.TYPE}' AS p, '{D.CUSTOMER}' AS o FROM customer UNION ALL SELECT {D.cust('c_custkey')}, '{D.NAME}', c_name FROM customer
  UNION ALL SELECT {D.cust('c_custkey')}, '{D.SEGMENT}', c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT {D.cust('c_custkey')}, '{D.IN}', '{D.DATA}nation/' || c_nationkey FROM customer
  UNION ALL SELECT {D.order('o_orderkey')}, '{T.TYPE}', '{D.ORDER}' FROM orders UNION ALL SELECT {D.order('o_orderkey')}, '{D.OF}', {D.cust('o_custkey')} FROM orders
  UNION ALL SELECT '{D.DATA}nation/' || n_nationkey, '{T.TYPE}', '{D.NATION}' FROM nation UNION ALL SELECT '{D.DATA}nation/' || n_nationkey, '{T.LABEL}', n_name FROM nation"""


@query("m01_m02_materialize", TRIPLES)
def m01(spark, sf_dir):
    return M.materialize(D.SPEC, D.tables(spark, sf_dir), D.NS, one_pass=True).where(F.col("p") != D.TOTAL).select("s", "p", "o")


@query("m03_virtual_join", f"SELECT {D.order('o_orderkey')} AS o, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def m03(spark, sf_dir):
    return ask(spark, sf_dir).bgp([("?o", D.OF, "?c"), ("?c", D.IN, "?n"), ("?n", T.LABEL, "?nation")]).select("o", "nation")


@query("m04_instances_of", f"SELECT {D.cust('c_custkey')} AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def m04(spark, sf_dir):
    c, n = D.table(spark, sf_dir, "customer"), D.table(spark, sf_dir, "nation")
    typed = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(F.lit(D.DATA + "customer/"), c.c_custkey.cast("string")).alias("s"), F.lit(T.TYPE).alias("p"), F.concat(F.lit(D.BASE), "n_name").alias("o"))
    return M.instances_of(typed, D.BASE + "ASIA", D.hierarchy(spark, sf_dir))


def spec_rows(spark, sf_dir):
    """A mapping of each nation's own view: table names are quoted or not, some refer to what is not there."""
    k = F.col("n_nationkey")
    table = F.when(k % 2 == 0, F.concat(F.lit('"public"."t'), k.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit(" t"), k.cast("string"), F.lit(" ")))
    base = F.when(k % 4 == 0, F.lit("https://other.example/x/")).otherwise(F.lit("https://e.example/n0/data/"))
    return D.table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), k.cast("string")).alias("map_id"), table.alias("table_name"), F.concat(base, F.lower("n_name"), F.lit("/{id}")).alias("subject_template"), F.array(F.concat(F.lit("https://e.example/n"), (k % 3).cast("string"), F.lit("#"), "n_name")).alias("class_iri"), F.concat(F.lit("https://e.example/n"), (k % 6).cast("string"), F.lit("#p"), (k % 4).cast("string")).alias("predicate_iri"))


SPEC_SQL = """spec AS (SELECT 'm' || n_nationkey AS map_id, CASE WHEN n_nationkey % 2 = 0 THEN 'public.t' || n_nationkey ELSE 't' || n_nationkey END AS tab,
  CASE WHEN n_nationkey % 4 = 0 THEN 'https://other.example/x/' ELSE 'https://e.example/n0/data/' END || lower(n_name) || '/' AS prefix,
  'https://e.example/n' || (n_nationkey % 3) || '#' || n_name AS cls, 'https://e.example/n' || (n_nationkey % 6) || '#p' || (n_nationkey % 4) AS pred, n_nationkey AS k FROM nation)"""


@query("m05_m06_m07_mapping_summary", f"WITH {SPEC_SQL} SELECT count(DISTINCT map_id) AS maps, array_to_string(list_sort(list(DISTINCT tab)), ',') AS tables, array_to_string(list_sort(list(DISTINCT prefix)), ',') AS subject_prefixes, array_to_string(list_sort(list(DISTINCT cls)), ',') AS classes, array_to_string(list_sort(list(DISTINCT pred)), ',') AS predicates FROM spec")
def m05(spark, sf_dir):
    row = M.mapping_summary(spec_rows(spark, sf_dir))
    return row.select("maps", *[F.array_join(c, ",").alias(c) for c in row.columns if c != "maps"])


@query("m08_data_iri_prefix", "SELECT n_name AS n, 'https://e.example/' || n_name || '/data/' AS prefix FROM nation")
def m08(spark, sf_dir):
    n = D.table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("n"), T.data_iri_prefix(F.concat(F.lit("https://e.example/"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, "#").otherwise("/#/"))).alias("prefix"))


@query(
    "m09_validate_mapping_spec",
    """SELECT 'm' || p_partkey AS map_id, unnest(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'sql-query' END, CASE WHEN p_partkey % 7 = 0 THEN 'blank-node-subject' END,
  CASE WHEN p_partkey % 11 = 0 AND p_partkey % 7 <> 0 THEN 'no-subject' END, CASE WHEN p_partkey % 13 = 0 THEN 'template-predicate' END,
  CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 17 = 0 THEN 'no-table' END, CASE WHEN p_size > 40 THEN 'too-large' END], lambda x: x IS NOT NULL)) AS violation FROM part""",
)
def m09(spark, sf_dir):
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    maps = D.table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), k.cast("string")).alias("map_id"), F.when(k % 5 == 0, "select 1").alias("sql_query"), F.when(k % 17 != 0, "t").alias("table_name"), none.alias("graph_map"), none.alias("parent_map"), F.when(k % 7 == 0, "bnode").alias("subject_kind"),
        F.when(k % 11 != 0, "https://e.example/{id}").alias("subject_template"), F.when(k % 13 != 0, "urn:p").alias("predicate_iri"), F.when(k % 13 == 0, "urn:{p}").alias("predicate_template"), F.when(F.col("p_size") > 40, M.MAX_MAPPING + 1).otherwise(10).alias("size"),
    )
    return M.validate_mapping_spec(maps)


@query(
    "m10_validate_mapping_refs",
    f"""WITH {SPEC_SQL}, vocab AS (SELECT cls AS iri FROM spec UNION SELECT pred FROM spec), owned AS (SELECT iri, CASE WHEN regexp_extract(iri, 'n([0-9])', 1) IN ('0', '1', '2', '3') THEN 'n' || regexp_extract(iri, 'n([0-9])', 1) END AS owner FROM vocab)
  SELECT 'subject-outside' AS kind, prefix AS value FROM spec WHERE k % 4 = 0 UNION SELECT 'foreign-vocabulary', iri FROM owned WHERE owner <> 'n0'
  UNION SELECT 'unobserved-table', tab FROM spec WHERE k % 3 <> 0 UNION SELECT 'unknown-term', iri FROM owned WHERE owner = 'n0' AND iri NOT IN (SELECT 'https://e.example/n0#p' || r_regionkey FROM region WHERE r_regionkey < 3)
  UNION SELECT 'deprecated-term', iri FROM owned WHERE iri = 'https://e.example/n0#p2'""",
)
def m10(spark, sf_dir):
    n = D.table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0")
    observed = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("public.t"), "n_nationkey")).otherwise(F.concat(F.lit("t"), "n_nationkey")).alias("table_name"))
    r = D.table(spark, sf_dir, "region").where("r_regionkey < 3")
    known = r.select(F.concat(F.lit("https://e.example/n0#p"), "r_regionkey").alias("iri"), (F.col("r_regionkey") == 2).alias("deprecated"))
    return M.validate_mapping_refs(spec_rows(spark, sf_dir), "https://e.example/n0#", D.namespaces(spark, sf_dir).where("ns <> 'n9'"), "n0", observed, known)
