"""Queries of checks (V of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import pattern as G
from kgspark.operators import quality as V
from kgspark.operators import questions as Q
from kgspark.plans import data as D
from kgspark.plans.registry import query
from kgspark.sources import quads as S

SHIPMENT = D.BASE + "Shipment"
PRODUCT, CODE, PRICE, MAKER, RATING = (D.BASE + x for x in ("Product", "code", "price", "maker", "rating"))
INT, DOUBLE = T.XSD + "integer", T.XSD + "double"


def shapes(spark, sf_dir):
    """Shapes of customers, orders, products, shipments and an unmapped class; one prop for each row of region names them."""
    q = lambda s, p, o, kind="iri", sk="iri", dt=None: S.quad(D.NS, "shapes", s, p, o, kind, sk, dt)
    rows, n = [], 0
    for cls, props in ((D.CUSTOMER, ((D.NAME, {"minCount": "1"}), (D.SEGMENT, {"minCount": "1", "maxCount": "1"}))), (D.ORDER, ((D.OF, {"minCount": "1", "class": D.CUSTOMER}), (D.BASE + "note", {"minCount": "1"}))), (SHIPMENT, ((D.NAME, {"minCount": "1"}),)), (D.BASE + "Ghost", ((D.NAME, {"minCount": "1"}),)),
                       (PRODUCT, ((CODE, {"pattern": "^P[0-9]+$", "minCount": "x"}), (PRICE, {"datatype": DOUBLE, "maxCount": "1"}), (MAKER, {"class": D.BASE + "Maker"}), (RATING, {"minCount": "1", "or": (INT, T.XSD + "string"), "message": "rate it"})))):
        shape = cls + "Shape"
        rows += [q(shape, T.TYPE, T.SH + "NodeShape"), q(shape, T.SH + "targetClass", cls)]
        for path, facts in props:
            n += 1
            rows += [q(shape, T.SH + "property", f"b{n}", "bnode"), q(f"b{n}", T.SH + "path", path, "iri", "bnode")]
            for name, value in facts.items():
                if name == "or":
                    rows.append(q(f"b{n}", T.SH + "or", f"l{n}.0", "bnode", "bnode"))
                    for i, dt in enumerate(value):
                        rows += [q(f"l{n}.{i}", T.RDF + "first", f"i{n}.{i}", "bnode", "bnode"), q(f"i{n}.{i}", T.SH + "datatype", dt, "iri", "bnode"), q(f"l{n}.{i}", T.RDF + "rest", f"l{n}.{i + 1}" if i + 1 < len(value) else T.RDF + "nil", "bnode" if i + 1 < len(value) else "iri", "bnode")]
                else:
                    iri = name in ("class", "datatype")
                    rows.append(q(f"b{n}", T.SH + name, value, "iri" if iri else "literal", "bnode", None if iri else INT))
    return S.from_rows(spark, rows)


def products(spark, sf_dir):
    """Parts as products with faults by remainder, in a class below the shapes' target."""
    k = F.col("p_partkey")
    row = lambda p, o, kind, dt=None: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"))
    made = F.array(
        row(T.TYPE, F.lit(D.BASE + "Gadget"), "iri"), row(CODE, F.concat(F.when(k % 6 == 0, "p").otherwise("P"), k.cast("string")), "literal"), row(PRICE, F.when(k % 8 == 0, "dear").otherwise(F.col("p_size").cast("string")), "literal", DOUBLE), row(PRICE, F.when(k % 9 == 0, "1"), "literal", DOUBLE),
        row(MAKER, F.concat(F.lit(D.BASE + "m"), (k % 10).cast("string")), "iri"), row(RATING, F.when(k % 4 == 0, "4"), "literal", INT), row(RATING, F.when(k % 4 == 1, "fine"), "literal"), row(RATING, F.when(k % 4 == 2, "4.5"), "literal", DOUBLE),
    )
    rows = D.table(spark, sf_dir, "part").select(F.concat(F.lit(D.BASE + "item"), k.cast("string")).alias("s"), F.explode(made).alias("t")).where("t.o is not null").select("s", "t.*")
    makers = D.table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.concat(F.lit(D.BASE + "m"), "r_regionkey").alias("s"), F.lit(T.TYPE).alias("p"), F.lit(D.BASE + "Maker").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))
    below = S.from_rows(spark, [S.quad(D.NS, "", D.BASE + "Gadget", T.SUBCLASS, PRODUCT)])
    own = rows.unionByName(makers).select(F.lit(D.NS).alias("ns"), F.lit("").alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_dt", F.lit(None).cast("string").alias("o_lang"))
    return own.unionByName(below)


def mapped(spark, sf_dir):
    """What the mapping gives: all but the ghost class; shipments are mapped, but never made."""
    return spark.createDataFrame([(x,) for x in (D.CUSTOMER, D.ORDER, SHIPMENT, D.NAME, D.SEGMENT, D.OF)], "iri string")


def domain_shapes(spark, sf_dir):
    return shapes(spark, sf_dir).where(~F.col("s").startswith(PRODUCT))


def shaped(spark, sf_dir):
    """Shapes made from parts: a row for each part's class."""
    k = F.col("p_partkey")
    name = F.concat(F.lit(D.BASE + "C"), k.cast("string"))
    row = lambda s, sk, p, o, ok: F.struct(s.alias("s"), F.lit(sk).alias("s_kind"), F.lit(p).alias("p"), o.cast("string").alias("o"), ok.alias("o_kind"))
    b, iri, lit, node = F.concat(F.lit("b"), k.cast("string")), F.lit("iri"), F.lit("literal"), F.lit("bnode")
    made = F.array(row(F.concat(name, F.lit("S")), "iri", T.TYPE, F.lit(T.SH + "NodeShape"), iri), row(F.concat(name, F.lit("S")), "iri", T.SH + "targetClass", name, F.when(k % 5 == 0, "bnode").otherwise("iri")), row(F.concat(name, F.lit("S")), "iri", T.SH + "property", b, node), row(b, "bnode", T.SH + "path", F.concat(F.lit(D.BASE + "q"), (k % 30).cast("string")), iri), row(b, "bnode", T.SH + "minCount", F.when(k % 3 == 0, "0").when(k % 3 == 1, "1").otherwise("many"), lit))
    rows = D.table(spark, sf_dir, "part").select(F.explode(made).alias("t")).select("t.*")
    return rows.select(F.lit(D.NS).alias("ns"), F.lit("").alias("g"), "*", F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


@query("v01_shacl_targets", f"SELECT '{D.BASE}C' || p_partkey AS class, '{D.BASE}C' || p_partkey || 'S' AS shape FROM part WHERE p_partkey % 5 <> 0")
def v01(spark, sf_dir):
    return V.shacl_targets(shaped(spark, sf_dir))


@query("v02_required_paths", f"SELECT '{D.BASE}C' || p_partkey || 'S' AS shape, '{D.BASE}q' || (p_partkey % 30) AS path FROM part WHERE p_partkey % 3 = 1")
def v02(spark, sf_dir):
    return V.required_paths(shaped(spark, sf_dir))


ITEM = f"'{D.BASE}item' || p_partkey"
PSHAPE = f"'{PRODUCT}Shape'"
VIOLATIONS = f"""SELECT {ITEM} AS focus, {PSHAPE} AS shape, '{CODE}' AS path, 'pattern' AS component, 'p' || p_partkey AS value, NULL::VARCHAR AS message FROM part WHERE p_partkey % 6 = 0
  UNION ALL SELECT {ITEM}, {PSHAPE}, '{PRICE}', 'datatype', 'dear', NULL FROM part WHERE p_partkey % 8 = 0
  UNION ALL SELECT {ITEM}, {PSHAPE}, '{PRICE}', 'maxCount', NULL, NULL FROM part WHERE p_partkey % 9 = 0 AND (p_partkey % 8 = 0 OR p_size <> 1)
  UNION ALL SELECT {ITEM}, {PSHAPE}, '{MAKER}', 'class', '{D.BASE}m' || (p_partkey % 10), NULL FROM part WHERE p_partkey % 10 > 2
  UNION ALL SELECT {ITEM}, {PSHAPE}, '{RATING}', 'minCount', NULL, 'rate it' FROM part WHERE p_partkey % 4 = 3
  UNION ALL SELECT {ITEM}, {PSHAPE}, '{RATING}', 'or', '4.5', 'rate it' FROM part WHERE p_partkey % 4 = 2"""


@query("v03_shacl_validate", VIOLATIONS)
def v03(spark, sf_dir):
    return V.shacl_validate(shapes(spark, sf_dir), products(spark, sf_dir))


def bounds(spark, sf_dir):
    """Shapes of products with one component of each further kind."""
    q = lambda s, p, o, kind="iri", sk="bnode": S.quad(D.NS, "shapes", s, p, o, kind, sk)
    shape = PRODUCT + "Shape"
    rows = [q(shape, T.TYPE, T.SH + "NodeShape", sk="iri"), q(shape, T.SH + "targetClass", PRODUCT, sk="iri")]
    facts = ((CODE, "minLength", "3"), (CODE, "maxLength", "4"), (PRICE, "minInclusive", "5"), (PRICE, "maxExclusive", "40"), (MAKER, "nodeKind", T.SH + "IRI"), (RATING, "nodeKind", T.SH + "IRI"), (MAKER, "in", ("m1", "m2", "m3")), (RATING, "hasValue", "fine"))
    for n, (path, name, value) in enumerate(facts):
        rows += [q(shape, T.SH + "property", f"b{n}", "bnode", "iri"), q(f"b{n}", T.SH + "path", path)]
        if name == "in":
            rows.append(q(f"b{n}", T.SH + "in", "l0", "bnode"))
            for i, x in enumerate(value):
                rows += [q(f"l{i}", T.RDF + "first", D.BASE + x), q(f"l{i}", T.RDF + "rest", f"l{i + 1}" if i + 1 < len(value) else T.RDF + "nil", "bnode" if i + 1 < len(value) else "iri")]
        else:
            rows.append(q(f"b{n}", T.SH + name, value, "iri" if name == "nodeKind" else "literal"))
    return S.from_rows(spark, rows)


CODES = "(CASE WHEN p_partkey % 6 = 0 THEN 'p' ELSE 'P' END || p_partkey)"


@query(
    "v03_shacl_bounds",
    f"""SELECT {ITEM} AS focus, '{CODE}' AS path, 'minLength' AS component, {CODES} AS value FROM part WHERE length({CODES}) < 3 UNION ALL SELECT {ITEM}, '{CODE}', 'maxLength', {CODES} FROM part WHERE length({CODES}) > 4
  UNION ALL SELECT DISTINCT {ITEM}, '{PRICE}', c, v FROM (SELECT p_partkey, v, unnest(['minInclusive', 'maxExclusive']) AS c FROM (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'dear' ELSE p_size::VARCHAR END AS v FROM part UNION SELECT p_partkey, '1' FROM part WHERE p_partkey % 9 = 0)) WHERE NOT coalesce(CASE c WHEN 'minInclusive' THEN TRY_CAST(v AS DOUBLE) >= 5 ELSE TRY_CAST(v AS DOUBLE) < 40 END, false)
  UNION ALL SELECT {ITEM}, '{RATING}', 'nodeKind', ['4', 'fine', '4.5'][p_partkey % 4 + 1] FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT {ITEM}, '{MAKER}', 'in', '{D.BASE}m' || (p_partkey % 10) FROM part WHERE p_partkey % 10 NOT IN (1, 2, 3)
  UNION ALL SELECT {ITEM}, '{RATING}', 'hasValue', NULL FROM part WHERE p_partkey % 4 <> 1""",
)
def v03_bounds(spark, sf_dir):
    return V.shacl_validate(bounds(spark, sf_dir), products(spark, sf_dir)).select("focus", "path", "component", "value")


@query("v04_shacl_report", f"SELECT true AS shapes_conform, count(*) = 0 AS data_conform, count(*) = 0 AS conforms, count(*) AS violations FROM ({VIOLATIONS})")
def v04(spark, sf_dir):
    return V.shacl_report(shapes(spark, sf_dir).where(F.col("o") != "x"), products(spark, sf_dir))


@query("v04_malformed_report", "SELECT false AS shapes_conform, NULL::BOOLEAN AS data_conform, false AS conforms, NULL::BIGINT AS violations FROM (SELECT count(*) FROM part)")
def v04_bad(spark, sf_dir):
    return V.shacl_report(shapes(spark, sf_dir), products(spark, sf_dir))


@query("v05_class_probe", "SELECT count(*) > 0 AS answer FROM orders")
def v05(spark, sf_dir):
    return V.class_probe(D.graph(spark, sf_dir), D.ORDER)


@query("v06_missing_property", "SELECT count(*) AS missing FROM customer WHERE c_mktsegment = 'BUILDING'")
def v06(spark, sf_dir):
    return V.missing_property_count(D.graph(spark, sf_dir), D.CUSTOMER, D.SEGMENT)


PLAN = f"""plan AS (SELECT *, row_number() OVER (ORDER BY class, shape, path NULLS FIRST) AS n FROM (
  SELECT '{D.BASE}C' || p_partkey AS class, '{D.BASE}C' || p_partkey || 'S' AS shape, NULL AS path FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 0
  UNION ALL SELECT '{D.BASE}C' || p_partkey, '{D.BASE}C' || p_partkey || 'S', '{D.BASE}q' || (p_partkey % 30) FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 3 = 1 AND p_partkey % 30 <> 4))"""


@query("v07_plan_probes", f"WITH {PLAN} SELECT class, shape, path, n, n <= 100 AS planned FROM plan")
def v07(spark, sf_dir):
    q, k = shaped(spark, sf_dir), F.col("p_partkey")
    part = D.table(spark, sf_dir, "part")
    have = part.where(k % 2 == 0).select(F.concat(F.lit(D.BASE + "C"), k.cast("string")).alias("iri")).unionByName(part.where(k % 30 != 4).select(F.concat(F.lit(D.BASE + "q"), (k % 30).cast("string")).alias("iri"))).distinct()
    return V.plan_probes(V.shacl_targets(q), V.required_paths(q), have)


DIVERGENCE = f"""SELECT '{D.CUSTOMER}' AS class, '{D.CUSTOMER}Shape' AS shape, NULL::VARCHAR AS path, CASE WHEN count(*) > 0 THEN 'matched' ELSE 'empty' END AS status, NULL::BIGINT AS missing FROM customer
  UNION ALL SELECT '{D.ORDER}', '{D.ORDER}Shape', NULL, CASE WHEN count(*) > 0 THEN 'matched' ELSE 'empty' END, NULL FROM orders
  UNION ALL SELECT '{SHIPMENT}', '{SHIPMENT}Shape', NULL, 'empty', NULL UNION ALL SELECT '{D.BASE}Ghost', '{D.BASE}GhostShape', NULL, 'unmapped', NULL
  UNION ALL SELECT '{D.CUSTOMER}', '{D.CUSTOMER}Shape', '{D.NAME}', 'matched', 0 UNION ALL SELECT '{D.CUSTOMER}', '{D.CUSTOMER}Shape', '{D.SEGMENT}', CASE WHEN count(*) > 0 THEN 'empty' ELSE 'matched' END, count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT '{D.ORDER}', '{D.ORDER}Shape', '{D.OF}', 'matched', 0 UNION ALL SELECT '{D.ORDER}', '{D.ORDER}Shape', '{D.BASE}note', 'unmapped', NULL"""


@query("v08_divergence", DIVERGENCE)
def v08(spark, sf_dir):
    return V.divergence_report(domain_shapes(spark, sf_dir), D.graph(spark, sf_dir), mapped(spark, sf_dir))


@query(
    "v09_divergence_summary",
    f"""WITH report AS ({DIVERGENCE}), plan AS (SELECT *, row_number() OVER (ORDER BY class, path NULLS FIRST) AS n FROM (VALUES ('{D.CUSTOMER}', NULL), ('{D.CUSTOMER}', '{D.NAME}'), ('{D.CUSTOMER}', '{D.SEGMENT}'), ('{D.ORDER}', NULL), ('{D.ORDER}', '{D.OF}'), ('{SHIPMENT}', NULL), ('{SHIPMENT}', '{D.NAME}')) t(class, path)),
  used AS (SELECT count(*) FILTER (n <= 6 AND (path IS NULL OR class IN (SELECT class FROM report WHERE path IS NULL AND status = 'matched'))) AS issued, count(*) FILTER (n > 6) AS skipped FROM plan),
  r AS (SELECT count(*) AS n, count(*) FILTER (status IN ('empty', 'unmapped')) AS diverged, count(*) FILTER (status = 'unknown') AS "unknown" FROM report)
  SELECT n = 0 AS no_shapes, diverged, "unknown", issued, skipped, "unknown" = 0 AND skipped = 0 AS conclusive FROM r, used""",
)
def v09(spark, sf_dir):
    q = domain_shapes(spark, sf_dir)
    plan = V.plan_probes(V.shacl_targets(q), V.required_paths(q), mapped(spark, sf_dir), 6)
    return V.divergence_summary(V.divergence_report(q, D.graph(spark, sf_dir), mapped(spark, sf_dir), 6), plan)


def questions(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    q = G.GraphQuery(g, D.NS)
    asked = [("q1", "ask_true", q.match("?c", T.TYPE, D.CUSTOMER).ask()), ("q2", "non_empty", q.match("?c", D.SEGMENT, "?s").select("c")), ("q3", "empty", q.match("?c", D.SEGMENT, "BUILDING", o_kind="literal").select("c")), ("q4", "empty", q.match("?c", D.NAME, "?n").select("c")), ("q5", "ask_true", q.match("?c", D.NAME, "?n").select("c")), ("q6", "non_empty", None)]
    return V.evaluate_questions(asked, g)


ANSWERS = """(VALUES ('q1', 'ask_true', (SELECT count(*) > 0 FROM customer), true), ('q2', 'non_empty', (SELECT count(*) > 0 FROM customer WHERE c_mktsegment <> 'BUILDING'), true), ('q3', 'empty', true, true),
  ('q4', 'empty', (SELECT count(*) = 0 FROM customer), true), ('q5', 'ask_true', false, true), ('q6', 'non_empty', false, false)) t(id, expect, passed, evaluated)"""


@query("v10_evaluate_questions", f"SELECT * FROM {ANSWERS}")
def v10(spark, sf_dir):
    return questions(spark, sf_dir)


def nation_questions() -> list[Q.Question]:
    """Eight questions for each of 25 nations."""
    out = []
    for k in range(25):
        nation = f"{D.DATA}nation/{k}"
        there, order, segment = ("?c", D.IN, nation), ("?o", D.OF, "?c"), ("?c", D.SEGMENT, "?s")
        out += [
            Q.Question(f"a{k}", "non_empty", [there]), Q.Question(f"b{k}", "ask_true", [there, ("?c", D.SEGMENT, "MACHINERY", "literal")]), Q.Question(f"c{k}", "empty", [there], [segment]),
            Q.Question(f"d{k}", "non_empty", [(nation, T.LABEL, "?l")]), Q.Question(f"e{k}", "non_empty", [there, order]), Q.Question(f"f{k}", "empty", [there, segment], [order]),
            Q.Question(f"g{k}", "empty", [("?c", D.NAME, f"Customer#{k * k:09d}", "literal")]), Q.Question(f"h{k}", "ask_true", [(nation, T.TYPE, D.NATION), ("?c", D.SEGMENT, "NONE", "literal")]),
        ]
    return out


@query(
    "v10_many_questions",
    """WITH n AS (SELECT range AS k FROM range(25)), c AS (SELECT c_nationkey AS k, c_mktsegment AS seg, c_name AS name, c_custkey IN (SELECT o_custkey FROM orders) AS ordered FROM customer),
  a AS (SELECT 'a' || k AS id, 'non_empty' AS expect, k IN (SELECT k FROM c) AS passed FROM n UNION ALL SELECT 'b' || k, 'ask_true', k IN (SELECT k FROM c WHERE seg = 'MACHINERY') FROM n
  UNION ALL SELECT 'c' || k, 'empty', k NOT IN (SELECT k FROM c WHERE seg = 'BUILDING') FROM n UNION ALL SELECT 'd' || k, 'non_empty', k IN (SELECT n_nationkey FROM nation) FROM n
  UNION ALL SELECT 'e' || k, 'non_empty', k IN (SELECT k FROM c WHERE ordered) FROM n UNION ALL SELECT 'f' || k, 'empty', k NOT IN (SELECT k FROM c WHERE seg <> 'BUILDING' AND NOT ordered) FROM n
  UNION ALL SELECT 'g' || k, 'empty', printf('Customer#%09d', k * k) NOT IN (SELECT name FROM c) FROM n UNION ALL SELECT 'h' || k, 'ask_true', false FROM n)
  SELECT id, expect, passed, true AS evaluated FROM a""",
)
def v10_many(spark, sf_dir):
    """200 questions in one scan of the graph."""
    return Q.ask_all(nation_questions(), D.graph(spark, sf_dir), D.NS)


@query("v11_competency_report", f"SELECT bool_and(evaluated AND passed) AS conforms, bool_and(evaluated) AS evaluated_all, coalesce(string_agg(id, ',' ORDER BY id) FILTER (evaluated AND NOT passed), '') AS failed, coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT evaluated), '') AS not_evaluated FROM {ANSWERS}")
def v11(spark, sf_dir):
    return V.competency_report(questions(spark, sf_dir)).select("conforms", "evaluated_all", F.array_join("failed", ",").alias("failed"), F.array_join("not_evaluated", ",").alias("not_evaluated"))


def ontology(spark, sf_dir):
    """Suppliers as individuals of two classes by remainder, below disjoint classes or not."""
    k = F.col("s_suppkey")
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    s = F.concat(F.lit(D.BASE + "s"), k.cast("string"))
    cls = lambda m, c: F.concat(F.lit(D.BASE + c), (k % m).cast("string"))
    rows = D.table(spark, sf_dir, "supplier").select(F.explode(F.array(row(s, T.TYPE, cls(4, "A")), row(s, T.TYPE, cls(3, "B")))).alias("t")).select("t.*")
    rows = rows.select(F.lit(D.NS).alias("ns"), F.lit("").alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    q = lambda a, p, b: S.quad(D.NS, "", D.BASE + a, p, D.BASE + b)
    axioms = [q("A0", T.SUBCLASS, "Left"), q("A1", T.SUBCLASS, "A0"), q("B2", T.SUBCLASS, "Right"), q("Left", T.DISJOINT, "Right"), q("Odd", T.SUBCLASS, "A1"), q("Odd", T.SUBCLASS, "B2")]
    return rows.unionByName(S.from_rows(spark, axioms))


@query("v13_contradictions", f"SELECT 'individual' AS kind, '{D.BASE}s' || s_suppkey AS node FROM supplier WHERE s_suppkey % 4 < 2 AND s_suppkey % 3 = 2 UNION ALL SELECT 'class', '{D.BASE}Odd'")
def v13(spark, sf_dir):
    return V.contradictions(ontology(spark, sf_dir))[0]


IRI = "length({0}) <= 1024 AND regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches({0}, '[\\x00-\\x20\\x7f<>\"{{}}|^`\\\\]')"


@query(
    "v14_valid_identifiers",
    f"""SELECT doc_id AS id, 'document' AS kind, {IRI.format("text")} AS iri, regexp_full_match(lower(source), '[a-z0-9][a-z0-9-]{{1,62}}') AS ns, regexp_full_match(text, '[A-Za-z0-9][A-Za-z0-9.+-]{{0,63}}') AS version FROM documents
  UNION ALL SELECT page_id, 'page', {IRI.format("url")}, regexp_full_match(url, '[a-z0-9][a-z0-9-]{{1,62}}'), regexp_full_match(url, '[A-Za-z0-9][A-Za-z0-9.+-]{{0,63}}') FROM pages
  UNION ALL SELECT p_partkey, 'part', {IRI.format("(p_type || ':' || p_name)")}, regexp_full_match(lower(p_type), '[a-z0-9][a-z0-9-]{{1,62}}'), regexp_full_match(p_size || '.' || p_type, '[A-Za-z0-9][A-Za-z0-9.+-]{{0,63}}') FROM part""",
)
def v14(spark, sf_dir):
    def judged(rows, kind, key, iri, ns, version):
        return rows.select(F.col(key).alias("id"), F.lit(kind).alias("kind"), T.valid_term_iri(iri).alias("iri"), T.valid_namespace(ns).alias("ns"), T.valid_version(version).alias("version"))

    docs, pages, parts = (D.table(spark, sf_dir, x) for x in ("documents", "pages", "part"))
    text, url = F.col("text"), F.col("url")
    made = judged(parts, "part", "p_partkey", F.concat("p_type", F.lit(":"), "p_name"), F.lower("p_type"), F.concat(F.col("p_size").cast("string"), F.lit("."), "p_type"))
    return judged(docs, "document", "doc_id", text, F.lower("source"), text).unionByName(judged(pages, "page", "page_id", url, url, url)).unionByName(made)


@query("v15_foreign_subjects", f"SELECT {D.order('o_orderkey')} AS s FROM orders UNION SELECT '{D.DATA}nation/' || n_nationkey FROM nation")
def v15(spark, sf_dir):
    return V.foreign_subjects(D.graph(spark, sf_dir), D.DATA + "customer/")


@query(
    "v16_approval_gate",
    """SELECT version, gate IS NULL AS allowed, gate FROM (SELECT 'v' || p_partkey AS version, CASE WHEN p_partkey % 3 = 0 THEN 'in-review' WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 'two-person' WHEN p_size > 40 OR p_size IS NULL THEN 'shacl'
  WHEN p_partkey % 7 = 0 THEN 'deprecation' WHEN p_partkey % 2 = 0 AND p_partkey % 11 = 0 THEN 'criteria-authorship' WHEN p_partkey % 13 = 0 THEN 'competency' END AS gate FROM part)""",
)
def v16(spark, sf_dir):
    k = F.col("p_partkey")
    return V.approval_gate(
        D.table(spark, sf_dir, "part").select(
            F.concat(F.lit("v"), k.cast("string")).alias("version"), F.when(k % 3 == 0, "draft").otherwise("in-review").alias("status"), F.when(k % 5 == 0, "me").otherwise("you").alias("created_by"), F.lit("me").alias("actor"), (k % 2 == 0).alias("two_person"), F.when(F.col("p_size") <= 40, True).alias("shacl_conforms"),
            F.when(k % 7 == 0, 2).otherwise(0).alias("blocking_problems"), (k % 11 == 0).alias("self_revised"), (k % 13 == 0).alias("has_questions"), F.lit(True).alias("evaluated_all"), F.lit(None).cast("boolean").alias("questions_conform"),
        )
    )


@query(
    "v17_criteria_self_revision",
    f"WITH {D.VERSIONS}, q AS (SELECT 'c' || o_custkey AS ns, o_orderkey AS revision, 'u' || (o_orderkey % 5) AS revised_by, o_orderdate AS revised_at FROM orders WHERE o_orderkey % 2 = 0), active AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY ns ORDER BY revision DESC) = 1) SELECT ns, version, created_by AS author, revision FROM versions JOIN active USING (ns) WHERE revised_by = created_by AND revised_at >= created_at",
)
def v17(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    q = o.select(F.concat(F.lit("c"), "o_custkey").alias("ns"), F.col("o_orderkey").alias("revision"), F.concat(F.lit("u"), (F.col("o_orderkey") % 5).cast("string")).alias("revised_by"), F.col("o_orderdate").alias("revised_at"))
    from kgspark.operators.lifecycle import criteria_self_revision

    return criteria_self_revision(D.versions(spark, sf_dir), q)
