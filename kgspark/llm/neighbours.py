"""Approximate nearest neighbours by cosine, with an adaptive dimension scan.

Unit vectors are dealt into lists around centroids that are fitted on a bounded sample, and rotated by one random
orthogonal matrix. A query probes the lists of its nearest centroids. Inside a list vectors are stored in column blocks:
after each block of dimensions the partial distances are scaled to all dimensions, and a candidate is abandoned when a
hypothesis test says that its distance surpasses the best so far (with the rotation, the first d of D dimensions hold d / D
of a difference's square up to a relative error of EPSILON / sqrt(d)). What survives is measured exactly, on the
original vectors and in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import written

#: A list has LIST_ROWS vectors up to MANY lists; from there on the lists' number and their rows both grow with the root
#: of the vectors' number, up to MAX_LISTS lists.
LIST_ROWS, MANY, MAX_LISTS = 400, 1024, 8192
#: Centroids are fitted on the distinct vectors with the least hash: FIT_ROWS, or FIT_EACH for each list if those are more.
FIT_ROWS, FIT_EACH = 20_000, 20
#: The lists that a query probes are so many that this share of neighbours is in them, in a trial of TRIAL sampled queries.
FOUND, TRIAL, LEAST_PROBES = 0.98, 400, 8
#: A list's vectors and a list's queries meet in blocks of so many.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096
COLUMNS, EPSILON, SCAN_QUERIES, SALTS = 16, 2.1, 64, 64


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no null and only finite components, not all zero."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def list_count(n: int) -> int:
    root = int(MANY * (n / (MANY * LIST_ROWS)) ** 0.5)
    return max(1, min(n // LIST_ROWS, max(MANY, root), MAX_LISTS))


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), size=min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 2048] @ centres.T).argmax(axis=1) for a in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many of the nearest lists hold FOUND of the k nearest neighbours in the sample x of unit rows.

    In all data neighbours are nearer than in a sample of them, so this errs on the side of more lists.
    """
    order = (-(x[:TRIAL] @ centres.T)).argsort(axis=1).argsort(axis=1)
    own = (x @ centres.T).argmax(axis=1)
    near = x[:TRIAL] @ x.T
    near[np.arange(len(near)), np.arange(len(near))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    ranks = np.take_along_axis(order, own[best], axis=1)
    return int(np.quantile(ranks, FOUND)) + 1


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(11).standard_normal((dim, dim)))[0]


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaled first, so that very large or small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scan(queries: np.ndarray, block: np.ndarray, keep: int, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each rotated unit query the rows of the rotated block that may be among its nearest `keep`."""
    n, dim = block.shape
    columns = [np.ascontiguousarray(block[:, a : a + COLUMNS]) for a in range(0, dim, COLUMNS)]
    squares = (columns[0] ** 2).sum(axis=1)
    out = []
    for at in range(0, len(queries), SCAN_QUERIES):
        part = queries[at : at + SCAN_QUERIES]
        # the first column block, which no candidate can skip, for several queries at once
        heads = squares + (part[:, :COLUMNS] ** 2).sum(axis=1)[:, None] - 2 * (part[:, :COLUMNS] @ columns[0].T)
        for q, sums in zip(part, heads, strict=True):
            live, bound = np.arange(n), np.inf
            if n > keep:  # the whole distances of the rows that begin nearest bound the best `keep`
                first = np.argpartition(sums, keep)[: 2 * keep]
                bound = np.partition(((block[first] - q) ** 2).sum(axis=1), keep - 1)[keep - 1]
            for i in range(len(columns)):
                if i:
                    sums = sums + ((columns[i][live] - q[i * COLUMNS : (i + 1) * COLUMNS]) ** 2).sum(axis=1)
                seen = min((i + 1) * COLUMNS, dim)
                slack = 1.0 if seen == dim else (1 + epsilon / np.sqrt(seen)) ** 2 * seen / dim
                if seen == dim and len(sums) > keep:
                    bound = np.partition(sums, keep - 1)[keep - 1]
                near = np.nonzero(sums <= bound * slack + 1e-9)[0]
                live, sums = live[near], sums[near]
            out.append(live)
    return out


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosine of each row with q, summed in order. Scaling by powers of two keeps every digit and avoids overflow."""
    a = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    q = np.ldexp(q, -np.frexp(np.abs(q).max())[1])
    total = lambda x: np.cumsum(x, axis=-1)[..., -1]
    return total(a * q) / np.sqrt(total(a * a) * total(q * q))


def probe_pairs(cells: pd.DataFrame, queries: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The best `keep` of one block of a list for each query of a block of queries."""
    found: dict[str, list[np.ndarray]] = {"query": [np.zeros(0, np.int64)], "vec": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
    if len(cells) and len(queries):
        original, wanted = np.stack(cells["v"].to_numpy()), np.stack(queries["v"].to_numpy())
        turn = rotation(original.shape[1])
        ids, qids = cells["id"].to_numpy(), queries["id"].to_numpy()
        for i, live in enumerate(scan(unit(wanted) @ turn, unit(original) @ turn, keep)):
            score = cosines(original[live], wanted[i])
            best = np.lexsort((ids[live], -score))[:keep]
            for name, x in (("query", np.repeat(qids[i], len(best))), ("vec", ids[live][best]), ("score", score[best])):
                found[name].append(x)
    return pd.DataFrame({k: np.concatenate(v) for k, v in found.items()})


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest other rows of each row whose vec_id is divisible by `every`.

    Rows with a null vec_id, or a vector without a direction or of another length than most (ties: the shorter), take no
    part; of rows with one vec_id and different vectors, the one with the least vector counts, so repeated rows count once.
    Equal vectors are one entry of the index, with its k + 1 least ids: no more of them can be among the nearest.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not length:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == length[0]["n"]).groupBy("id").agg(F.min("v").alias("v"))
    rows = written(rows.withColumn("same", F.sha2(F.array_join("v", ","), 256)), "vectors")

    # ids of equal vectors: the least in each salted part, then the least of those
    part = Window.partitionBy("same", "salt").orderBy("id")
    few = rows.select("same", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).withColumn("at", F.row_number().over(part)).where(F.col("at") <= k + 1)
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("at") <= k + 1)
    few = written(few.groupBy("same").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids")), "equal-vectors")
    distinct = written(rows.join(few.select("id", "ids"), "id").select("id", "v", "ids"), "distinct-vectors")

    n = distinct.count()
    lists = list_count(n)
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(max(FIT_ROWS, FIT_EACH * lists)).select("v").toArrow()
    fitted = unit(np.concatenate([c.flatten().to_numpy() for c in sample.column("v").chunks]).reshape(-1, length[0]["n"]))
    centres = fit_centroids(fitted, lists)
    probes = min(len(centres), max(LEAST_PROBES, probes_needed(fitted[:FIT_ROWS], centres, k)))
    shared = spark.sparkContext.broadcast(centres)

    def assign(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    x = unit(np.array(part.column("v").to_pylist(), dtype=np.float64)) @ shared.value.T
                    best = np.argpartition(-x, count - 1, axis=1)[:, :count].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.tolist(), pa.list_(pa.int32()))], names=[*part.schema.names, "lists"])

        return run

    cells = distinct.select("id", "v").mapInArrow(assign(1), "id long, v array<double>, lists array<int>").select("id", "v", F.col("lists")[0].alias("list"))
    cells = written(cells, "lists")
    sizes = cells.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # at most MAX_LISTS rows
    cells = cells.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    # a query stands for all queries with its vector
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("same", "id")
    per_vector = written(asked.select("same").distinct().join(few.select("same", "id", "ids"), "same"), "query-vectors")
    wanted = per_vector.select("id").join(distinct.select("id", "v"), "id").mapInArrow(assign(probes), "id long, v array<double>, lists array<int>")
    wanted = wanted.select("id", "v", F.explode("lists").alias("list")).join(F.broadcast(sizes), "list")
    groups = wanted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("groups"))  # at most MAX_LISTS rows
    wanted = wanted.join(F.broadcast(groups), "list").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = cells.join(F.broadcast(groups), "list").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    key = ["list", "block", "group"]
    found = spread.select(*key, "id", "v").groupBy(*key).cogroup(wanted.select(*key, "id", "v").groupBy(*key)).applyInPandas(lambda a, b: probe_pairs(a, b, k + 1), "query long, vec long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    found = written(found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at"), "found-vectors")
    # entries back to ids, then each query's own id out
    entries = found.join(few.select(F.col("id").alias("vec"), "ids"), "vec").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = entries.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("top"))
    # at most k + 1 neighbours for a vector, taken by all its queries; a vector asked for very often is dealt by salt
    salted = top.join(per_vector.select(F.col("id").alias("query"), "same"), "query").select("same", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    out = asked.join(salted, ["same", "salt"]).select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("id")), 1, k)).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
