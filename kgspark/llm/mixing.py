"""A time-varying curriculum: sources are mixed to target weights, and documents get training positions.

A source of weight share T and slope a has at time t in [0, 1] the weight T * (1 + a * (2t - 1)). Its integral is the
cumulative demand T * (t + a * (t^2 - t)), which reaches T at the end. A document that starts when its source has given
c words gets the position t at which the demand is c: the quadratic's inverse. Sorting by position interleaves the
sources as the schedule asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import running, written

#: Weights by the source's rank, repeated; the slope of each weight's schedule: heavy sources lead, light ones follow.
WEIGHTS, SLOPES = (5, 2, 1), (-0.5, 0.0, 0.5)
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(totals: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, _src, source_size, target and slope from (source, _src, source_size); the null source last.

    Weights share `share` of all sizes. What would pass `most` times a source's size stays there and the excess is
    shared again by weight: with sources in order of cap / weight, those before the first that its share fits are capped.
    """
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (F.col("place") % len(xs) + 1).cast("int"))
    last = F.col("source").asc_nulls_last()
    rows = running(totals, [last], {"place": F.lit(1).cast("long")})
    rows = rows.select("source", "_src", "source_size", pick(WEIGHTS).alias("weight"), pick(SLOPES).alias("slope"), (F.col("source_size") * most).cast("double").alias("cap"))
    rows = written(rows, "mix-weights")
    whole = rows.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    at = F.col("cap") / F.col("weight")
    rows = running(rows, [at, last], {"caps_before": F.col("cap"), "weights_before": F.col("weight")}).crossJoin(F.broadcast(whole))
    rows = rows.withColumn("level", (share * F.col("all_sizes") - F.col("caps_before")) / (F.col("all_weights") - F.col("weights_before")))
    fits = rows.agg(F.min(F.when(F.col("level") <= at, F.struct(at.alias("at"), F.col("level").alias("level")))).alias("fits"))
    target = F.when(F.col("fits").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fits.level") * F.col("weight")))
    return rows.crossJoin(F.broadcast(fits)).select("source", "_src", "source_size", target.alias("target"), "slope")


def position(share: Column, slope: Column) -> Column:
    """The time in [0, 1] at which a source has given this share of its target."""
    rest = 1 - slope
    return F.when(share <= 0, F.lit(0.0)).otherwise(2 * share / (rest + F.sqrt(rest * rest + 4 * slope * share)))


def mix(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes and positions of each row of docs, with the columns `carry`.

    Each source's documents stand in the order of the md5 of doc_id and the text's md5, then doc_id and size. The mix takes
    whole passes over a source and then documents in that order up to the target, the last one in part. `positions` has
    one for each time that any of a document is taken. A null text has size 0 and is never taken; null sources are a
    source, and a null doc_id is like an empty one. A source's running sums are made in 4096 parts, so one large source, or
    one doc_id with many texts, is not one task. Of rows equal in doc_id and text, which comes first is left open: their
    results together are the same, and one task orders them, on disk where they are many.
    """
    key = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), *carry)
    sized = sized.withColumns({"_src": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")), "part": F.substring("key", 1, 3)})
    slim = written(sized.select("source", "_src", "part", "size").groupBy("source", "_src", "part").agg(F.sum("size").alias("part_size")), "mix-parts")
    totals = written(slim.groupBy("source", "_src").agg(F.sum("part_size").alias("source_size")), "mix-sources")
    before = F.sum("part_size").over(Window.partitionBy("_src").orderBy("part")) - F.col("part_size")
    targets = written(source_targets(totals), "mix-targets")
    parts = slim.withColumn("before", before).drop("source").join(targets.drop("source"), "_src").select("_src", "part", "before", "source_size", "target", "slope")
    own = Window.partitionBy("_src", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("own_before", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(parts, ["_src", "part"])
    budget = F.round("target").cast("long")
    rows = rows.withColumns({"start": F.col("before") + F.col("own_before"), "passes": F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")})
    last = F.greatest(F.lit(0), F.least("size", budget - F.col("passes") * F.col("source_size") - F.col("start")))
    rows = rows.withColumn("taken", (F.col("passes") * F.col("size") + last).cast("long"))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    at = F.transform(F.slice(F.array(*[F.lit(i) for i in range(MOST)]), F.lit(1), times), lambda i: position((i * F.col("source_size") + F.col("start")) / F.col("target"), F.col("slope")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", at.alias("positions"), "source", *carry)


def curriculum(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position and again of each row of docs, range-sorted by position.

    position is that of the first time a document is taken, again that of the second; null, and last, where it isn't taken.
    """
    at = lambda i: F.try_element_at("positions", F.lit(i))
    rows = mix(docs).select("doc_id", "size", "source_size", "target", "taken", at(1).alias("position"), at(2).alias("again"))
    return rows.orderBy(F.col("position").asc_nulls_last(), F.xxhash64("doc_id"), "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs in training order, a row for each time that a document is taken; the last one of a source is kept whole.

    Documents without a word are taken no words of, so they are not there. Rows are range-sorted by position: their order
    is that of the partitions, and inside each that of its rows, and so in files that are written from them.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "source")]
    kept = mix(docs.select("doc_id", "source", *carry).withColumn("_row", F.struct(*docs.columns)).select("doc_id", "source", "text", "_row"), "_row")
    placed = kept.select("_row", F.explode("positions").alias("_at"))
    order = ("_at", F.xxhash64("_row.doc_id"))
    return placed.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).sortWithinPartitions(*order).select("_row.*")
