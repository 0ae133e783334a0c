"""SimHash fingerprints, linked at few differing bits by BK-trees, and grouped into components.

A BK-tree keeps each child under the integer Hamming distance to its parent, so that a search of radius r follows only
the edges k with |d - k| <= r. The trees are shards of bounded size: fingerprints that differ in at most 3 of 64 bits
agree on one of four 16-bit blocks, so each block's values are dealt into shards of some thousand fingerprints, and each
shard gets a tree, which all its fingerprints search. The trees together hold every fingerprint, so they can't be
collected to be broadcast: a shard's rows and its tree meet in one task. Each shard returns a star for each group that it
finds, never all pairs.

keep_one() has no digest contract: it groups texts whose sets of five-word shingles have a similarity of 0.8 or more.
Its candidates are what the BK-trees link, as above. At that similarity about 10 of 64 bits are expected to differ, which no
tree of bounded work finds, so MinHash bands add the candidates that the trees can't have; each candidate group is then
compared on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import attach, written

RADIUS = 3
#: Fingerprints in a tree; a block's value that more fingerprints have than HOT_ROWS is dealt by finer blocks.
TREE_ROWS, HOT_ROWS = 4096, 50_000
#: Queries that search a tree at once.
QUERY_ROWS = 512
BLOCKS6 = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: keep_one: words in a shingle, and the similarity of near copies as numerator and denominator.
COPY_WORDS, ALIKE = 5, (4, 5)
#: Texts, and bytes of them, that a task compares with each other at a time.
UNIT_TEXTS, UNIT_BYTES = 512, 16 << 20
#: MinHash bands and values in each: a pair at similarity 0.8 agrees on no band with probability (1 - 0.8 ** 4) ** 20, 0.00003.
BANDS, BAND_ROWS = 20, 4
_seeds = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * BAND_ROWS), dtype=np.uint64)
FLIPS, FACTORS = _seeds[0], _seeds[1] | np.uint64(1)


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """The hashes of a text's word shingles in their order; none for a text without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def simhash(text: str | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint of a text's word shingles; 0 for a text without words."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    h = np.array(hashes, dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        counts += np.unpackbits(h[at : at + 8192].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h)).view(">i8")[0])


def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(x) for x in texts], dtype="int64")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKTree:
    """A BK-tree over distinct fingerprints: each child hangs under the integer Hamming distance to its parent.

    Nodes are numbered as the values are; child[node, edge + radius] is a node or -1. `followed` counts the edges that
    searches went along.
    """

    def __init__(self, values: np.ndarray, radius: int = RADIUS):
        self.values, self.radius, self.followed = values, radius, 0
        self.child = np.full((len(values), 65 + 2 * radius), -1, dtype=np.int32)
        flat, width = self.child.reshape(-1), self.child.shape[1]
        items = np.arange(1, len(values))  # what waits at a node goes under it by distance, the first of each edge as the child
        at = np.zeros(len(items), dtype=np.int64)
        while len(items):
            slot = at * width + radius + near(values[items], values[at])
            order = np.argsort(slot, kind="stable")
            items, slot = items[order], slot[order]
            first = np.concatenate(([True], slot[1:] != slot[:-1]))
            flat[slot[first]] = items[first]
            items, at = items[~first], flat[slot[~first]].astype(np.int64)

    def links(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, entries), by number, at radius or less: a level of the tree at a time for a block of queries."""
        for start in range(0, len(queries), QUERY_ROWS):
            q = np.arange(start, min(start + QUERY_ROWS, len(queries)))
            node = np.zeros(len(q) if len(self.values) else 0, dtype=np.int64)
            while len(node):
                d = near(queries[q], self.values[node]).astype(np.int64)
                yield q[d <= self.radius], node[d <= self.radius]
                below = [(q, self.child[node, d + k]) for k in range(2 * self.radius + 1)]  # edges d - radius to d + radius
                q = np.concatenate([x[c >= 0] for x, c in below])
                node = np.concatenate([c[c >= 0] for _, c in below]).astype(np.int64)
                self.followed += len(node)


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i] in place; root holds the least member of each one's group."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def tree_groups(tree: BKTree) -> np.ndarray:
    """For each of the tree's values the index of its group's first one."""
    root = np.arange(len(tree.values))
    for a, b in tree.links(tree.values):
        join_roots(root, a, b)
    return root


def link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, a, b, side, fp), sorted, to stars (u, v) for the links of each unit (shard, a, b).

    Side 0 goes into a tree. Side 1 is asked of it, and then is linked to the first of each group that it meets.
    """

    def stars(rows: np.ndarray) -> pa.RecordBatch:
        entries, queries = (rows[rows["side"] == side]["fp"].view(np.uint64) for side in (0, 1))
        tree = BKTree(entries)
        root = tree_groups(tree)
        if len(queries):
            met = [np.unique(q * len(entries) + root[e]) for q, e in tree.links(queries)]
            met = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *met]))
            u, v = queries[met // max(1, len(entries))], entries[met % max(1, len(entries))]
        else:
            linked = root != np.arange(len(root))
            u, v = entries[linked], entries[root[linked]]
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    kind = np.dtype([("shard", np.int64), ("a", np.int32), ("b", np.int32), ("side", np.int32), ("fp", np.int64)])
    held = np.zeros(0, dtype=kind)
    for batch in batches:
        new = np.zeros(batch.num_rows, dtype=kind)
        for i, name in enumerate(kind.names):
            new[name] = batch.column(i).to_numpy()
        held = np.concatenate((held, new))
        unit = held[["shard", "a", "b"]]
        cuts = np.nonzero(unit[1:] != unit[:-1])[0] + 1  # the last unit may go on in the next batch
        starts = np.concatenate(([0], cuts))
        for first, end in zip(starts[:-1], cuts, strict=True):
            yield stars(held[first:end])
        held = held[cuts[-1] :] if len(cuts) else held
    if len(held):
        yield stars(held)


def shards(fps: DataFrame, n: int, tree_rows: int, hot_rows: int) -> DataFrame:
    """(fp, shard) so that fingerprints within RADIUS bits meet in a shard; shards have about tree_rows rows each.

    One tree holds up to tree_rows fingerprints. More are dealt by each of four 16-bit blocks: at 3 differing bits one
    block agrees. Fingerprints with a block's value that over hot_rows have are dealt by three of six blocks instead:
    of six, three agree.
    """
    if n <= tree_rows:
        return fps.select("fp", F.lit(0).cast("long").alias("shard"))
    dealt = lambda value, i, parts: F.pmod(F.xxhash64(value), F.lit(parts)) + F.shiftleft(F.lit(i).cast("long"), 40)
    block = lambda at, width: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
    four = fps.select("fp", F.posexplode(F.array(*[block(16 * i, 16) for i in range(4)])).alias("i", "value"))
    hot = written(four.groupBy("i", "value").count().where(F.col("count") > hot_rows).select("i", "value"), "hot-blocks")
    parts = -(-n // tree_rows)
    place = lambda rows, parts: rows.select("fp", dealt(F.col("value"), F.col("i"), parts).alias("shard"))
    if hot.isEmpty():
        return place(four, parts)
    some = written(four.join(F.broadcast(hot), ["i", "value"], "left_semi").select("fp").distinct(), "fine-fingerprints")  # hot: at most 4 * 65536 values
    six = [F.array(*[block(*BLOCKS6[i]) for i in c]) for c in combinations(range(6), 3)]
    fine = some.select("fp", F.posexplode(F.array(*[F.xxhash64(x) for x in six])).alias("i", "value")).withColumn("i", F.col("i") + 4)
    return place(four.join(F.broadcast(hot), ["i", "value"], "left_anti"), parts).unionByName(place(fine, -(-some.count() // tree_rows)))


def near_links(fps: DataFrame, tree_rows: int = TREE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stars (u, v) whose components are those of all links at RADIUS or fewer bits. fps: distinct fingerprints fp.

    Each shard becomes a tree in the task that has its rows. A shard of over 4 * tree_rows is cut into parts, and every
    part's tree is asked by every later part, so that a task holds two parts at most.
    """
    n = fps.count()
    rows = written(shards(fps, n, tree_rows, hot_rows), "shards")
    large = rows.groupBy("shard").count().where(F.col("count") > 4 * tree_rows).select("shard", F.ceil(F.col("count") / tree_rows).cast("int").alias("parts"))
    large = written(large, "large-shards")
    whole = lambda df: df.select("shard", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "fp")
    units = whole(rows)
    if not large.isEmpty():
        part = F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part")
        cut = rows.join(large, "shard").select("shard", "fp", "parts", part)
        entry = cut.select("shard", F.col("part").alias("a"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("b"), F.lit(0).alias("side"), "fp")
        asked = cut.where("part > 0").select("shard", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("a"), F.col("part").alias("b"), F.lit(1).alias("side"), "fp")
        units = whole(rows.join(large, "shard", "left_anti")).unionByName(entry).unionByName(asked)
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, 4 * n // (4 * tree_rows)))
    units = units.repartition(tasks, "shard", "a", "b").sortWithinPartitions("shard", "a", "b", "side", "fp")
    return units.mapInArrow(link_units, "u long, v long").distinct()


def star_step(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v), with m, the least of u and its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = attach(edges, written(least, "least"), "u", "n", total, "v")
    return out.select("u", "v", F.least("u", "found.m").alias("m"))


def edge_state(edges: DataFrame) -> tuple:
    """What tells two sets of distinct edges apart: their number, and the exclusive or of their hashes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (u, v): root is the least node that it reaches.

    Alternates large stars and small stars until nothing changes; each round is written to the shared folder. A node
    with very many neighbours is handled by attach().
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, now = None, edge_state(edges)
    while now != before:
        both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = star_step(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        small = star_step(large, large.count())
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct(), "small-star")
        before, now = now, edge_state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(docs: DataFrame, tree_rows: int = TREE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id of the document's group.

    Words are what stands between ASCII white space, with A-Z lower-cased; shingles have three words, a shorter text is
    one. Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id are grouped too;
    component_id is null only if the whole group has no doc_id. Repeated rows each get a row. Other columns are ignored.
    """
    base = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.pandas_udf(fingerprints, "long")("text").alias("fp")), "fingerprints")
    fps = written(base.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fingerprints")
    found = written(components(near_links(fps.select("fp"), tree_rows, hot_rows)), "components")
    linked = written(fps.join(found, F.col("fp") == F.col("node")).select("fp", "rep", "n", "root"), "linked")
    roots = written(linked.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("members")), "roots")
    low = attach(linked, roots, "root", "members", linked.count(), "fp").select("fp", "n", F.col("found.least").alias("component_id"))
    alone = fps.join(found.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", "n", F.col("rep").alias("component_id"))
    groups = written(low.unionByName(alone), "groups")
    return attach(base, groups, "fp", "n", base.count(), "row").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "found.component_id")


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, COPY_WORDS), dtype=np.uint64))


def sketches(texts: pd.Series) -> pd.DataFrame:
    """node, a hash of the text's whole shingle set (0 for an empty one), the keys of its MinHash bands, and its fingerprint."""
    nodes, bands, fps = [], [], []
    for text in texts:
        s = shingle_set(text)
        least = np.full(len(FLIPS), 2**64 - 1, dtype=np.uint64)
        for at in range(0, len(s), 4096):
            least = np.minimum(least, ((s[at : at + 4096, None] ^ FLIPS) * FACTORS).min(axis=0))
        parts = least.reshape(BANDS, BAND_ROWS)
        keys = [xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)] if len(s) else []
        fps.append(simhash(text))
        nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 42) if len(s) else 0)
        bands.append(np.array(keys, dtype=np.uint64).view(np.int64))
    return pd.DataFrame({"node": np.array(nodes, dtype=np.uint64).view(np.int64), "bands": bands, "fp": np.array(fps, dtype=np.int64)})


def alike_groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each of the shingle sets the index of its group's first one; pairs of similarity ALIKE or more are linked.

    Sets that a group has taken leave the index, so that a group of many copies costs about one look at each.
    """
    label, alive, sizes = np.arange(len(sets)), np.ones(len(sets), dtype=bool), np.array([len(s) for s in sets])
    left = indexed = 0

    def index() -> tuple[np.ndarray, np.ndarray]:
        ids = np.nonzero(alive)[0]
        flat, owner = np.concatenate([sets[i] for i in ids]), np.repeat(ids, sizes[ids])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]

    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        frontier = [seed]
        alive[seed] = False
        while frontier and (left := int(alive.sum())):
            if not indexed or 2 * left < indexed:
                (flat, owner), indexed = index(), left
            q = frontier.pop()
            a, b = np.searchsorted(flat, sets[q], "left"), np.searchsorted(flat, sets[q], "right")
            hits = np.arange((b - a).sum()) + np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a)
            ids, shared = np.unique(owner[hits], return_counts=True)
            near = ids[alive[ids] & (ALIKE[1] * shared >= ALIKE[0] * (sizes[q] + sizes[ids] - shared))]
            alive[near], label[near] = False, seed
            frontier += near.tolist()
    return label


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows (unit, node, text), sorted by unit, as the nodes and shingle sets of each unit."""
    unit, nodes, sets = None, [], []
    for batch in batches:
        for u, node, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if nodes and u != unit:
                yield nodes, sets
                nodes, sets = [], []
            unit = u
            nodes.append(node)
            sets.append(shingle_set(text))
    if nodes:
        yield nodes, sets


def alike_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars (u, v) of near copies in each unit."""
    for nodes, sets in by_unit(batches):
        label = alike_groups(sets)
        own = np.array(nodes, dtype=np.int64)
        linked = label != np.arange(len(label))
        yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[label[linked]])], names=["u", "v"])


def near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each text of a unit is a near copy of the unit's first."""
    for nodes, sets in by_unit(batches):
        first = sets[0]
        shared = np.array([len(np.intersect1d(first, x, assume_unique=True)) for x in sets[1:]], dtype=np.int64)
        sizes = np.array([len(x) for x in sets[1:]], dtype=np.int64)
        near = ALIKE[1] * shared >= ALIKE[0] * (len(first) + sizes - shared)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[1:], pa.int64()), pa.array(near)], names=["node", "near"])


def compared(rows: DataFrame, compare, schema: str) -> DataFrame:
    """What compare makes of rows (unit, at, node, text), of each unit in the order of at and node."""
    return rows.repartition("unit").sortWithinPartitions("unit", "at", "node").select("unit", "node", "text").mapInArrow(compare, schema)


def large_links(texts: DataFrame) -> DataFrame:
    """Links (u, v) of candidate groups of several parts, (root, node, parts, text); components join them to groups.

    A part's texts are compared with the group's first one, beside which each part gets a copy of. What isn't near it is
    then compared with all of the group, part by part, so that no link is lost and no task gets a group.
    """
    unit = lambda *parts: F.concat_ws("/", F.col("root").cast("string"), *[p.cast("string") for p in parts]).alias("unit")
    part = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    first = texts.where("node = root").withColumn("part", every(F.col("parts"))).select(unit(F.col("part")), F.lit(0).alias("at"), "node", "text")
    others = texts.where("node <> root").select(unit(part(F.col("parts"))), F.lit(1).alias("at"), "node", "text")
    judged = compared(first.unionByName(others), near_first, "node long, near boolean")
    judged = written(texts.where("node <> root").select("node", "root").join(judged, "node"), "near-the-first")
    links = judged.where("near").select(F.col("node").alias("u"), F.col("root").alias("v"))
    far = judged.where("not near")
    groups = written(far.groupBy("root").agg(F.ceil(F.count("*") / UNIT_TEXTS).alias("far_parts")), "far-groups")
    if groups.isEmpty():
        return links
    counts = texts.groupBy("root").agg(F.count("*").alias("n")).join(groups, "root")
    rows = attach(texts, counts, "root", "n", texts.count(), "node").where("found is not null").select("root", "node", "parts", "text", "found.far_parts")
    rows = written(rows.join(far.select("node", F.lit(True).alias("far")), "node", "left"), "far-texts")
    left = rows.where("far").withColumn("b", every(F.col("parts"))).select(unit(part(F.col("far_parts")), F.col("b")), F.lit(0).alias("at"), "node", "text")
    right = rows.withColumn("a", every(F.col("far_parts"))).select(unit(F.col("a"), part(F.col("parts"))), F.lit(1).alias("at"), "node", "text")
    return links.unionByName(compared(left.unionByName(right), alike_links, "u long, v long").where("u <> v"))


def tree_edges(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of nodes (node, fp) that the BK-trees link: fingerprints at RADIUS or fewer bits."""
    fps = written(nodes.groupBy("fp").agg(F.min("node").alias("m"), F.count("*").alias("n")), "copy-fingerprints")
    found = written(components(near_links(fps.select("fp"))), "fingerprint-groups")
    linked = written(fps.join(found.select(F.col("node").alias("fp"), "root"), "fp").select("fp", "m", "root"), "linked-fingerprints")
    roots = written(linked.groupBy("root").agg(F.min("m").alias("least"), F.count("*").alias("members")), "fingerprint-roots")
    between = attach(linked, roots, "root", "members", linked.count(), "fp").select(F.col("m").alias("u"), F.col("found.least").alias("v"))
    equal = attach(nodes, fps.where("n > 1"), "fp", "n", nodes.count(), "node").where("found is not null").select(F.col("node").alias("u"), F.col("found.m").alias("v"))
    return between.unionByName(equal).where("u <> v")


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node) for all rows of docs, and (node, copies): the node of the group, for all distinct shingle sets.

    key is the md5 of the text. Two texts are in one group if a chain of pairs, each of similarity ALIKE or more, joins
    them among their candidates. Texts of fewer than COPY_WORDS words are one shingle; null and empty texts are alike.
    """
    key = F.md5(F.coalesce("text", F.lit(""))).alias("key")
    copy = F.pandas_udf(sketches, "node long, bands array<long>, fp long")("text").alias("copy")
    base = written(docs.select("doc_id", key, F.octet_length("text").alias("n_bytes"), copy), "sketches")
    base = base.select("doc_id", "key", "n_bytes", F.col("copy.node").alias("node"), F.col("copy.bands").alias("bands"), F.col("copy.fp").alias("fp"))
    nodes = written(base.groupBy("node").agg(F.min(F.struct("key", "n_bytes", "fp")).alias("one")).select("node", "one.*"), "shingle-sets")
    bands = written(base.select("node", F.explode("bands").alias("band")).distinct(), "bands")
    least = written(bands.groupBy("band").agg(F.min("node").alias("m"), F.count("*").alias("n")).where("n > 1"), "least-in-bands")
    edges = attach(bands, least, "band", "n", bands.count(), "node").where("found is not null").select(F.col("node").alias("u"), F.col("found.m").alias("v"))
    edges = edges.unionByName(tree_edges(nodes.select("node", "fp")))
    found = written(components(edges).join(nodes.drop("fp"), "node"), "candidates")
    sizes = found.groupBy("root").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / UNIT_TEXTS), F.ceil(F.sum("n_bytes") / UNIT_BYTES)).alias("parts"))
    found = attach(found, written(sizes, "candidate-groups"), "root", "n", found.count(), "node").select("key", "root", "node", "found.parts")
    # one text of each key goes to where its candidate is; by merging at every size, as the texts are never small enough to broadcast to
    texts = docs.where("text is not null").select(key, "text").groupBy("key").agg(F.first("text").alias("text"))
    texts = written(texts.hint("merge").join(found, "key").select("root", "node", "parts", "text"), "candidate-texts")
    small = compared(texts.where("parts = 1").select(F.col("root").cast("string").alias("unit"), F.lit(0).alias("at"), "node", "text"), alike_links, "u long, v long")
    links = small.select(F.col("u").alias("node"), F.col("v").alias("copies"))
    large = texts.where("parts > 1")
    if not large.isEmpty():
        links = links.unionByName(components(large_links(large)).select("node", F.col("root").alias("copies")))
    links = written(links, "alike").withColumnRenamed("node", "linked")
    groups = nodes.select("node").join(links, F.col("node") == F.col("linked"), "left").select("node", F.coalesce("copies", "node").alias("copies"))
    return base.select("doc_id", "key", "node"), groups


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, with one row of each group of near copies: one with the least doc_id. Rows without a doc_id stay.

    Of rows equal in doc_id and text, which one stays is left open. Columns of any names are kept.
    """
    base, groups = near_copies(docs)
    rows = base.where("doc_id is not null").groupBy("node", "doc_id", "key").agg(F.count("*").alias("n"))
    least = F.min(F.struct("doc_id", "node", "key", "n")).alias("least")
    own = rows.groupBy("node").agg(least).select("node", "least")
    kept = written(own.join(groups, "node").groupBy("copies").agg(F.min("least").alias("least")).select("least.doc_id", "least.key", "least.n"), "kept-rows")
    packed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.struct(*docs.columns).alias("row"))
    named = packed.where("doc_id is not null").hint("merge")
    out = packed.where("doc_id is null").select("row").unionByName(named.join(kept.where("n = 1"), ["doc_id", "key"], "left_semi").select("row"))
    more = kept.where("n > 1")
    if not more.isEmpty():
        out = out.unionByName(named.join(more, ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
