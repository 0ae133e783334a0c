"""Queries of search (R of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators import lifecycle as C
from kgspark.operators import search as R
from kgspark.plans import data as D
from kgspark.plans.registry import query

WORDS = "large anvil"


@query("r01_term_texts", f"WITH {D.REVISIONS} SELECT s AS iri, array_to_string(list_filter(list_concat(['p' || regexp_extract(s, '[0-9]+$')], list(DISTINCT o ORDER BY o) FILTER (p = '{T.LABEL}'), coalesce(list(DISTINCT trim(o)) FILTER (p = '{T.COMMENT}' AND trim(o) <> ''), [])), lambda x: x <> ''), ' / ') AS source_text, false AS truncated, bool_or(p = '{T.DEPRECATED}') AS deprecated FROM new GROUP BY s")
def r01(spark, sf_dir):
    return R.term_texts(D.revision(spark, sf_dir, True))


@query("r02_local_name", "SELECT page_id, CASE WHEN regexp_extract(url, '[^#/]+$') = '' THEN url ELSE regexp_extract(url, '[^#/]+$') END AS name FROM pages")
def r02(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", T.local_name(F.col("url")).alias("name"))


def _query_vector(spark, sf_dir):
    """The vector with vec_id 0: one row of a fixed length."""
    return [float(x) for x in D.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def vector_hits(spark, sf_dir, k):
    terms = D.table(spark, sf_dir, "embeddings").select(F.concat(F.lit(D.BASE + "p"), "vec_id").alias("iri"), "embedding")
    return R.search_vector(terms, _query_vector(spark, sf_dir), k)


COSINE = f"cos AS (SELECT '{D.BASE}p' || e.vec_id AS iri, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, iri LIMIT 20)"


@query("r03_search_vector", f"WITH {COSINE} SELECT iri, round(similarity, 6) AS similarity FROM cos")
def r03(spark, sf_dir):
    return vector_hits(spark, sf_dir, 20).select("iri", F.round("similarity", 6).alias("similarity"))


def names(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select(F.concat(F.lit(D.BASE + "p"), "p_partkey").alias("iri"), F.col("p_name").alias("source_text"))


TRIGRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("r04_trigram_similarity", f"WITH t AS (SELECT p_partkey AS k, {TRIGRAMS.format('p_name')} AS a, {TRIGRAMS.format(chr(39) + WORDS + chr(39))} AS b FROM part) SELECT k, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM t")
def r04(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(R.trigram_similarity(F.col("p_name"), F.lit(WORDS)), 6).alias("similarity"))


ORDERED = "flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


EXTENT = f"""WITH t AS (SELECT '{D.BASE}p' || p_partkey AS iri, {ORDERED.format('p_name')} AS seen, list_distinct({ORDERED.format(chr(39) + WORDS + chr(39))}) AS wanted FROM part), a AS (SELECT *, unnest(range(1, len(seen) + 1)) AS i FROM t),
  runs AS (SELECT iri, wanted, list_distinct(seen[i:j]) AS run FROM (SELECT *, unnest(range(i, len(seen) + 1)) AS j FROM a)), s AS (SELECT iri, len(list_intersect(run, wanted)) AS shared, len(wanted) + len(run) AS n FROM runs)
  SELECT iri, round(max(shared / (n - shared)), 6) AS similarity FROM s GROUP BY iri HAVING max(shared / (n - shared)) >= {R.THRESHOLD} ORDER BY max(shared / (n - shared)) DESC, iri LIMIT 20"""


@query("r04_search_trigram", EXTENT)
def r04_extent(spark, sf_dir):
    return R.search_trigram(names(spark, sf_dir), WORDS, 20).select("iri", F.round("similarity", 6).alias("similarity"))


@query("r04_search_index", EXTENT)
def r04_index(spark, sf_dir):
    """The same from an inverted index of trigrams, which is built first."""
    from uuid import uuid4

    from kgspark.operators.paths import scratch

    path = f"{scratch(spark)}/trigrams-{uuid4().hex}"
    R.build_trigram_index(names(spark, sf_dir), path)
    return R.search_index(spark, path, WORDS, 20).select("iri", F.round("similarity", 6).alias("similarity"))


def fused(spark, sf_dir):
    """Both sides by what SQL can say: cosine, and similarity of trigram sets."""
    text = names(spark, sf_dir)
    vector = vector_hits(spark, sf_dir, 20).join(text, "iri", "left")
    trigram = text.withColumn("similarity", R.trigram_similarity(F.col("source_text"), F.lit(WORDS))).orderBy(F.desc("similarity"), "iri").limit(20)
    return R.fuse_rrf(vector, trigram, 20)


FUSED = f"""{COSINE}, v AS (SELECT iri, row_number() OVER (ORDER BY similarity DESC, iri) AS r FROM cos), tri AS (SELECT '{D.BASE}p' || p_partkey AS iri, {TRIGRAMS.format('p_name')} AS a, {TRIGRAMS.format(chr(39) + WORDS + chr(39))} AS b FROM part),
  t AS (SELECT iri, row_number() OVER (ORDER BY len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) DESC, iri) AS r FROM tri ORDER BY r LIMIT 20),
  fused AS (SELECT iri, coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + t.r), 0) AS score, CASE WHEN t.r IS NULL THEN 'vector' WHEN v.r IS NULL THEN 'trigram' ELSE 'both' END AS route FROM v FULL JOIN t USING (iri) ORDER BY round(score, 12) DESC, iri LIMIT 20)"""


@query("r05_fuse_rrf", f"WITH {FUSED} SELECT iri, round(CAST(score AS DOUBLE), 6) AS score, route FROM fused")
def r05(spark, sf_dir):
    return fused(spark, sf_dir).select("iri", F.round("score", 6).alias("score"), "route")


@query("r07_route_summary", f"WITH {FUSED} SELECT count(*) FILTER (route = 'vector') AS vector, count(*) FILTER (route = 'trigram') AS trigram, count(*) FILTER (route = 'both') AS \"both\" FROM fused")
def r07(spark, sf_dir):
    return R.route_summary(fused(spark, sf_dir))


@query("r08_search_outcome", f"WITH {FUSED}, {D.REVISIONS} SELECT count(*) AS hits, coalesce(array_to_string(list_sort(list(iri) FILTER (iri IN (SELECT s FROM new WHERE p = '{T.DEPRECATED}'))), ','), '') AS deprecated_hits, true AS conclusive FROM fused")
def r08(spark, sf_dir):
    row = R.search_outcome(fused(spark, sf_dir), C.deprecated_terms(D.revision(spark, sf_dir, True)), True)
    return row.select("hits", F.array_join("deprecated_hits", ",").alias("deprecated_hits"), "conclusive")


def first_length(texts: list[str]) -> list[list[float]]:
    """A model that gives the length of the local name."""
    return [[float(len(t.split(" / ")[0]))] for t in texts]


def rebuilt(spark, revisions) -> str:
    """The table of embeddings after each (namespace, version, quads) was built in turn."""
    from uuid import uuid4

    from kgspark.operators.paths import scratch

    path = f"{scratch(spark)}/embeddings-{uuid4().hex}"
    for ns, version, quads in revisions:
        R.rebuild_embeddings(quads, ns, version, first_length, "length", path)
    return path


@query("r09_rebuild_embeddings", f"WITH {D.REVISIONS} SELECT s AS iri, CAST(length(s) - {len(D.BASE)} AS INTEGER) AS first, '1.1.0' AS built_from_version FROM new GROUP BY s")
def r09(spark, sf_dir):
    """A namespace is built from one revision, then replaced by the next."""
    path = rebuilt(spark, [(D.NS, "1.0.0", D.revision(spark, sf_dir, False)), (D.NS, "1.1.0", D.revision(spark, sf_dir, True))])
    return R.embeddings(spark, path).select("iri", F.col("embedding")[0].cast("int").alias("first"), "built_from_version")


@query("r09_rebuild_by_none", f"WITH {D.REVISIONS} SELECT 'other' AS ns, s AS iri, '1.0.0' AS built_from_version FROM base GROUP BY s")
def r09_none(spark, sf_dir):
    """Two namespaces are built, then one of them from a revision that has no terms."""
    base = D.revision(spark, sf_dir, False)
    path = rebuilt(spark, [(D.NS, "1.0.0", base), ("other", "1.0.0", base), (D.NS, "1.1.0", base.where(F.col("p") == T.LABEL))])
    return R.embeddings(spark, path).select("ns", "iri", "built_from_version")


@query("r10_embedding_validate", f"SELECT '{D.BASE}p' || vec_id AS iri, CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 5 = 0 THEN 'dimension' ELSE 'gap' END AS fault FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 5 = 0 OR vec_id % 11 = 0")
def r10(spark, sf_dir):
    k, v = F.col("vec_id"), F.col("embedding")
    gap = F.transform(v, lambda x, i: F.when(i != 3, x))
    rows = D.table(spark, sf_dir, "embeddings").select(F.concat(F.lit(D.BASE + "p"), "vec_id").alias("iri"), F.when(k % 7 != 0, F.when(k % 5 == 0, F.slice(v, 1, 60)).when(k % 11 == 0, gap).otherwise(v)).alias("embedding"))
    return R.embedding_validate(rows, 64)
