"""Term search: source texts, cosine and trigram rankings, and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.operators.lifecycle import deprecated_terms
from kgspark.sources import snapshots

# Term types, and the constants of search.
TERM_TYPES = (T.OWL + "Class", T.OWL + "ObjectProperty", T.OWL + "DatatypeProperty", T.OWL + "AnnotationProperty", T.RDF + "Property")
MAX_TEXT, RRF, DEFAULT_K, MAX_K, THRESHOLD = 4000, 60, 10, 50, 0.6


def term_texts(quads: DataFrame) -> DataFrame:
    """iri, source_text, truncated and deprecated of each IRI subject of a term type: local name, labels, comments.

    Labels and comments are distinct and sorted, of all languages; the text is cut at MAX_TEXT characters.
    """
    terms = quads.where((F.col("p") == T.TYPE) & F.col("o").isin(*TERM_TYPES) & (F.col("s_kind") == "iri")).select("s").distinct()
    labels, comments = (T.LABEL, T.SKOS + "prefLabel"), (T.COMMENT, T.SKOS + "definition")
    notes = quads.where(F.col("p").isin(*labels, *comments) & (F.col("o_kind") == "literal"))
    own = terms.join(notes, "s", "left").groupBy("s").agg(*[F.array_sort(F.collect_set(F.when(F.col("p").isin(*ps), F.col("o")))).alias(n) for n, ps in (("labels", labels), ("comments", comments))])
    parts = F.filter(F.transform(F.concat(F.array(T.local_name(F.col("s"))), "labels", "comments"), lambda x: F.trim(x)), lambda x: x != "")
    rows = own.select(F.col("s").alias("iri"), F.array_join(parts, " / ").alias("text"))
    return rows.join(deprecated_terms(quads).withColumn("old", F.lit(True)), "iri", "left").select("iri", F.substring("text", 1, MAX_TEXT).alias("source_text"), (F.length("text") > MAX_TEXT).alias("truncated"), F.coalesce("old", F.lit(False)).alias("deprecated"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamp_k(k: int | None) -> int:
    return max(1, min(MAX_K, DEFAULT_K if k is None else k))


def search_vector(terms: DataFrame, query: list[float], k: int) -> DataFrame:
    """iri and similarity (cosine) of the k nearest, ties by iri. Vectors without length, or of another one, don't take part."""
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query])
    own = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    rows = terms.where(F.size("embedding") == len(query)).select("iri", F.when((own > 0) & F.lit(norm > 0), dot(F.col("embedding"), q) / (own * norm)).alias("similarity"))
    return rows.where("similarity is not null").orderBy(F.desc("similarity"), "iri").limit(k)


def trigram_list(text: Column) -> Column:
    """All trigrams of a text's words in order, repeats included; each word is padded by two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}\p{N}_]+"), 0)
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(words, of))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's words."""
    return F.array_distinct(trigram_list(text))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 where there are none."""
    shared = F.size(F.array_intersect(trigrams(a), trigrams(b)))
    both = F.size(F.array_union(trigrams(a), trigrams(b)))
    return F.when(both > 0, shared / both).otherwise(0.0)


def ordered_trigrams(text: str) -> list[str]:
    import re

    return [p[i : i + 3] for w in re.findall(r"\w+", text.lower()) for p in (f"  {w} ",) for i in range(len(p) - 2)]


def word_similarity(query: str, text: str, least: float = 0.0) -> float:
    """The greatest similarity of the query's trigrams with any run of the text's ordered trigrams; 0 if below `least`."""
    return best_run(set(ordered_trigrams(query)), list(enumerate(ordered_trigrams(text))), least)


def best_run(wanted: set[str], seen: list[tuple[int, str]], least: float = 0.0, repeats: int = 0) -> float:
    """The greatest similarity of `wanted` with any run of trigrams (place, trigram) in order; 0 if below `least`.

    Places that are left out of `seen` count as trigrams that are not wanted; at most `repeats` of all places hold a trigram
    that stood before, and so many are taken off. With all places given, or repeats 0, the result is exact, else a bound from
    above. A best run begins and ends with a wanted trigram, and its first one does not come again in it. A run is given up
    when even all wanted trigrams that follow could not make it better: so a start looks at few trigrams, not at the text.
    """
    best, whole = least, bool(seen) and len(seen) == seen[-1][0] - seen[0][0] + 1
    found, follow, later = False, {}, [0] * len(seen)
    rest: set[str] = set()
    for at in range(len(seen) - 1, -1, -1):  # how many wanted trigrams there are from here on
        if seen[at][1] in wanted:
            rest.add(seen[at][1])
        later[at] = len(rest)
    for at in range(len(seen) - 1, -1, -1):
        place, first = seen[at]
        if first not in wanted:
            follow[first] = at
            continue
        end, follow[first] = follow.get(first, len(seen)), at
        most = later[at]
        if most / len(wanted) < best or (found and most / len(wanted) <= best):
            continue
        distinct: set[str] = set()
        shared = 0
        for j in range(at, end):
            trigram = seen[j][1]
            if trigram not in distinct:
                distinct.add(trigram)
                shared += trigram in wanted
            size = len(distinct) if whole else max(len(distinct), seen[j][0] - place + 1 - repeats)
            if trigram in wanted:
                score = shared / (len(wanted) + size - shared)
                if score > best or (score == best and not found):
                    best, found = score, True
            bound = most / (len(wanted) + size - shared)
            if shared == most or bound < best or (found and bound <= best):
                break
    return best if found else 0.0


def _wanted(query: str) -> list[str]:
    if not query.strip():
        raise ValueError("the query is blank")
    return sorted(set(ordered_trigrams(query)))


def _measured(terms: DataFrame, query: str, threshold: float) -> DataFrame:
    def measure(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: word_similarity(query, t, threshold)).astype("float64")

    return terms.select("iri", F.pandas_udf(measure, "double")("source_text").alias("similarity"))


def search_trigram(terms: DataFrame, query: str, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """iri and similarity of the k best by word similarity, ties by iri. Extents are scanned only for texts that share enough trigrams."""
    need = _wanted(query)
    wanted = F.array(*[F.lit(x) for x in need]) if need else F.array().cast("array<string>")
    shared = F.size(F.array_intersect(trigrams(F.col("source_text")), wanted))
    rows = _measured(terms.where(F.col("source_text").isNotNull() & (shared >= threshold * len(need))), query, threshold)
    return rows.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "iri").limit(k)


#: Folders that the trigrams of an index are dealt to, and parts of each, so that a frequent trigram is not one task's.
BUCKETS, PARTS = 256, 8


def _bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def build_trigram_index(terms: DataFrame, path: str) -> None:
    """Writes an inverted index of terms (iri, source_text): a folder for each bucket of trigrams, and the texts by iri.

    A posting is (trigram, iri, place, repeats): where the trigram stands in the text's ordered trigrams, and how many of the
    text's places hold a trigram that stood before. Null texts have none.
    """
    rows = terms.where("source_text is not null").select("iri", trigram_list(F.col("source_text")).alias("seen"))
    rows = rows.withColumn("repeats", F.size("seen") - F.size(F.array_distinct("seen")))
    rows = rows.select("iri", "repeats", F.posexplode("seen").alias("place", "trigram")).withColumn("bucket", _bucket(F.col("trigram")))
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("iri"), F.lit(PARTS))).sortWithinPartitions("bucket", "trigram", "iri")
    rows.write.partitionBy("bucket").parquet(f"{path}/postings")
    texts = terms.where("source_text is not null").select("iri", "source_text", _bucket(F.col("iri")).alias("bucket"))
    texts.repartition("bucket").sortWithinPartitions("bucket", "iri").write.partitionBy("bucket").parquet(f"{path}/texts")


def search_index(spark: SparkSession, path: str, query: str, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """search_trigram over an index: only the buckets of the query's trigrams are read.

    Texts with enough of the query's trigrams are candidates. Their places give the similarity itself where a text repeats
    no trigram, and a bound from above where it does; only the texts whose bound reaches the threshold are then read.
    """
    need = _wanted(query)
    wanted = set(need)
    one = spark.range(1).select(F.array(*[F.lit(x) for x in need]).cast("array<string>").alias("need"))
    buckets = [r["b"] for r in one.select(F.explode("need").alias("t")).select(_bucket(F.col("t")).alias("b")).distinct().collect()]
    postings = spark.read.schema("iri string, repeats int, place int, trigram string, bucket int").parquet(f"{path}/postings")
    hits = postings.where(F.col("bucket").isin(buckets) & F.col("trigram").isin(need))
    own = hits.groupBy("iri").agg(F.first("repeats").alias("repeats"), F.array_sort(F.collect_list(F.struct("place", "trigram"))).alias("hits"))
    own = own.where(F.size(F.array_distinct(F.transform("hits", lambda x: x["trigram"]))) >= threshold * len(need))

    def bounded(hits: pd.Series, repeats: pd.Series) -> pd.Series:
        return pd.Series([best_run(wanted, [(x["place"], x["trigram"]) for x in h], threshold, r) for h, r in zip(hits, repeats, strict=True)], dtype="float64")

    own = own.select("iri", "repeats", F.pandas_udf(bounded, "double")("hits", "repeats").alias("bound")).where(F.col("bound") >= threshold)
    texts = spark.read.schema("iri string, source_text string, bucket int").parquet(f"{path}/texts")
    again = own.where("repeats > 0").select(_bucket(F.col("iri")).alias("bucket"), "iri")
    rows = _measured(texts.join(again, ["bucket", "iri"]), query, threshold).unionByName(own.where("repeats = 0").select("iri", F.col("bound").alias("similarity")))
    return rows.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "iri").limit(k)


def fuse_rrf(vector: DataFrame, trigram: DataFrame, k: int | None = None) -> DataFrame:
    """iri, score, route, the two similarities and source_text of the k best by reciprocal rank fusion, ties by iri.

    Each side (iri, similarity, source_text) is already cut to k; ranks start at 1. A side that did not find a term has a
    null similarity. The text is the vector side's where it has one.
    """
    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select("iri", F.col("similarity").alias(f"{name}_similarity"), F.col("source_text").alias(f"{name}_text"), F.row_number().over(Window.orderBy(F.desc("similarity"), "iri")).alias(f"{name}_rank"))

    both = ranked(vector, "vector").join(ranked(trigram, "trigram"), "iri", "full_outer")
    part = lambda n: F.coalesce(1.0 / (RRF + F.col(f"{n}_rank")), F.lit(0.0))
    route = F.when(F.col("trigram_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "trigram").otherwise("both")
    return both.select("iri", (part("vector") + part("trigram")).alias("score"), route.alias("route"), "vector_similarity", "trigram_similarity", F.coalesce("vector_text", "trigram_text").alias("source_text")).orderBy(F.desc("score"), "iri").limit(clamp_k(k))


def route_summary(hits: DataFrame) -> DataFrame:
    """One row with the number of hits by route, zeros included."""
    return hits.agg(*[F.count_if(F.col("route") == r).alias(r) for r in ("vector", "trigram", "both")])


def search_outcome(hits: DataFrame, deprecated: DataFrame, vector_available: bool) -> DataFrame:
    """One row: hits, deprecated_hits (sorted; hits stay hits), vector_available, note and conclusive."""
    old = hits.join(deprecated.select("iri").withColumn("old", F.lit(True)).distinct(), "iri", "left")
    note = None if vector_available else "vector route unavailable"
    return old.agg(F.count("*").alias("hits"), F.array_sort(F.collect_set(F.when(F.col("old"), F.col("iri")))).alias("deprecated_hits")).select("hits", "deprecated_hits", F.lit(vector_available).alias("vector_available"), F.lit(note).cast("string").alias("note"), F.lit(vector_available).alias("conclusive"))


def embedding_validate(rows: DataFrame, dim: int) -> DataFrame:
    """iri and fault (missing, dimension or gap) of unusable vectors."""
    fault = F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != dim, "dimension").when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double"))), "gap")
    return rows.select("iri", fault.alias("fault")).where("fault is not null")


#: The table of embeddings.
EMBEDDINGS = "iri string, source_text string, truncated boolean, deprecated boolean, embedding array<float>, built_from_version string, model string, ns string"


def rebuild_embeddings(quads: DataFrame, ns: str, version: str, embed: Callable[[list[str]], list[list[float]]], model: str, path: str, batch: int = 64) -> int:
    """Replaces all embeddings of a namespace in a table by those of one revision's term texts, and gives the commit's number.

    embed gets up to `batch` texts. A revision without terms leaves none. Readers see the old rows until all new ones are
    written; where embed fails they stay.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            yield pd.Series([v for a in range(0, len(texts), batch) for v in embed(texts[a : a + batch])])

    made = F.pandas_udf(run, "array<float>")("source_text")
    rows = term_texts(quads).withColumns({"embedding": made, "built_from_version": F.lit(version), "model": F.lit(model), "ns": F.lit(ns)})
    return snapshots.replace(rows, path, ("ns",), [(ns,)])


def embeddings(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The rows of a table that rebuild_embeddings made, now or as of a commit."""
    return snapshots.current(spark, path, EMBEDDINGS, ("ns",), until)
