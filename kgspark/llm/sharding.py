"""A hierarchical weighted hash tree: each row descends region, rack and shard by weighted hash draws.

At each node, child c of weight w gets the score -ln(u) / w, u being a hash of the row's key and the child's path, and
the least score wins; so children get rows in proportion to their weights. Weight that is added later forms a new layer:
its children draw beside the old ones at the root, and a row that a new layer wins descends in that layer alone. So an
added shard takes rows only into itself. Weight that is taken away lowers its leaf and what stands above it in their
layers: at each level rows leave only the children whose weights fell. So no row moves among subtrees whose weights stay.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import written

#: (region, rack, shard, weight) for each leaf; a layer is a list of leaves.
Leaf = tuple[str, str, int, float]
#: Rows of a shard are numbered in so many parts; so many equal rows are numbered by one task.
BUCKETS, REPEATS = 256, 100_000


def even_tree(regions: int = 2, racks: int = 4, shards: int = 5) -> list[Leaf]:
    """A tree of leaves of weight 1, numbered from 0."""
    return [(f"g{i // (racks * shards)}", f"k{i // shards % racks}", i, 1.0) for i in range(regions * racks * shards)]


def added(before: list[Leaf], after: list[Leaf]) -> list[Leaf]:
    """The layer of weight that leads from one tree to a larger one."""
    old = {x[:3]: x[3] for x in before}
    if any(old.get(x[:3], 0) > x[3] for x in after) or old.keys() - {x[:3] for x in after}:
        raise ValueError("a weight would shrink: resized() takes that")
    return [(*x[:3], x[3] - old.get(x[:3], 0)) for x in after if x[3] > old.get(x[:3], 0)]


def resized(layers: list[list[Leaf]], after: list[Leaf]) -> list[list[Leaf]]:
    """The layers of a tree whose leaves get the weights in after; a leaf that isn't there goes.

    What a leaf loses is taken from its newest layers first, and what it gains is a new layer.
    """
    want, out, now = {x[:3]: x[3] for x in after}, [], {}
    for layer in layers:
        kept = []
        for leaf in layer:
            weight = min(leaf[3], want.get(leaf[:3], 0.0) - now.get(leaf[:3], 0.0))
            if weight > 0:
                kept.append((*leaf[:3], weight))
                now[leaf[:3]] = now.get(leaf[:3], 0.0) + weight
        out.append(kept)
    more = [(*leaf, weight - now.get(leaf, 0.0)) for leaf, weight in want.items() if weight > now.get(leaf, 0.0)]
    return [*out, more] if more else out


def _children(layers: list[list[Leaf]]) -> list[dict[str, dict[str, float]]]:
    """For each level: path to its children's paths and weights."""
    levels: list[dict[str, dict[str, float]]] = [{"": {}}, {}, {}]
    for n, layer in enumerate(layers):
        for path, leaves in groupby(sorted(layer), key=lambda x: x[:2]):
            region, rack = f"{n}:{path[0]}", f"{n}:{path[0]}/{path[1]}"
            for _, _, shard, weight in leaves:
                for level, parent, child in ((0, "", region), (1, region, rack), (2, rack, f"{rack}/{shard}")):
                    own = levels[level].setdefault(parent, {})
                    own[child] = own.get(child, 0) + weight
    return levels


def _draw(key: Column, children: Column) -> Column:
    u = lambda c: (F.conv(F.substring(F.md5(F.concat_ws("/", key, c["path"])), 1, 12), 16, 10).cast("double") + 1) / (2.0**48 + 1)
    return F.array_min(F.transform(children, lambda c: F.struct((-F.log(u(c)) / c["weight"]).alias("score"), c["path"].alias("path"))))["path"]


def leaf_path(key: Column, layers: list[list[Leaf]]) -> Column:
    """The path layer:region/rack/shard that a key descends to."""
    at = F.lit("")
    for level in _children(layers):
        table = F.create_map(*[x for p, own in level.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(c).alias("path"), F.lit(float(w)).alias("weight")) for c, w in own.items()]))])
        at = _draw(key, F.element_at(table, at))
    return at


def shard_of(doc_id: Column, layers: list[list[Leaf]]) -> Column:
    """The shard's number. A null doc_id has the empty key."""
    return F.element_at(F.split(leaf_path(F.coalesce(doc_id.cast("string"), F.lit("")), layers), "/"), -1).cast("int")


def with_shards(docs: DataFrame, tree: list[Leaf] | None = None) -> DataFrame:
    """docs with the column shard (which replaces one of that name), without any shuffle."""
    return docs.withColumn("shard", shard_of(F.col("doc_id"), [tree or even_tree()]))


def bucket_of(key: Column, text_crc32: Column, n_bytes: Column) -> Column:
    """The part of its shard that numbers a row: rows differ in part if they differ at all, whatever their ids are."""
    digest = F.md5(F.concat_ws("/", key, text_crc32.cast("string"), n_bytes.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % BUCKETS


def shard_slots(docs: DataFrame, before: list[Leaf] | None = None, after: list[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    Rows with equal doc_id go to the same shard; doc_id may be of any type, a null one counts as the empty key, a null text
    as empty. Slots count from 0 in a shard by bucket_of, doc_id, checksum and size. Each (shard, bucket) is numbered by
    itself and moved by the counts of those before it, and equal rows are one with a count until they have their numbers;
    so no task holds a shard, or all the copies of a row. Other columns are ignored.
    """
    before = before or even_tree()
    after = after or [*before, (before[-1][0], before[-1][1], max(x[2] for x in before) + 1, 1.0)]
    placed = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
        shard_of(F.col("doc_id"), [before]).alias("shard"),
        shard_of(F.col("doc_id"), [before, added(before, after)]).alias("grown_shard"),
    ).withColumn("bucket", bucket_of(F.col("key"), F.col("text_crc32"), F.col("n_bytes")))
    kinds = written(placed.groupBy("shard", "bucket", "doc_id", "text_crc32", "n_bytes", "grown_shard").agg(F.count("*").alias("n")), "shard-rows")
    counts = kinds.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    offsets = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "n_bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = kinds.withColumn("before", F.sum("n").over(own) - F.col("n")).join(offsets, ["shard", "bucket"])
    numbered = numbered.withColumn("slot", F.col("first") + F.col("before"))
    repeat = lambda rows, n: rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    few = repeat(numbered.where(F.col("n") <= REPEATS), F.col("n")).withColumn("slot", F.col("slot") + F.col("i"))
    out = few
    if not kinds.where(F.col("n") > REPEATS).isEmpty():
        runs = repeat(numbered.where(F.col("n") > REPEATS), F.ceil(F.col("n") / REPEATS)).withColumns({"slot": F.col("slot") + F.col("i") * REPEATS, "n": F.least(F.lit(REPEATS), F.col("n") - F.col("i") * REPEATS)})
        out = few.unionByName(repeat(runs.drop("i").repartition(runs.sparkSession.sparkContext.defaultParallelism), F.col("n")).withColumn("slot", F.col("slot") + F.col("i")))
    return out.select("doc_id", (F.col("n_bytes") + 16).alias("size"), "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
