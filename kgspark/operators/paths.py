"""Reachability over edges, safe on cycles."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task sorts or groups.
TASK_ROWS = 250_000

_own: list[str] = []
_made: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, so that loops neither grow their plans nor lose work with an executor.

    Unlike a checkpoint, a table has sizes, by which joins with small ones are broadcast. clear() deletes the tables.
    """
    path = f"{scratch(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, of which there are about n, dealt by keys into parts of about TASK_ROWS, so that a task's memory doesn't grow with them.

    Small tables are left to Spark. Both sides of a join take the same n, so that neither is dealt again.
    """
    if n <= TASK_ROWS:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)), *keys)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that settle() has written in this process; results that still read them must be written by then."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """The session's shared folder: spark.checkpoint.dir, or what setCheckpointDir has set. A temporary one under a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="kgspark-"))
    spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def numbered(rows: DataFrame, order: list[Column], name: str, part_rows: int = 100_000) -> DataFrame:
    """rows with their numbers from 1 in an order without ties. Ranges of about part_rows rows are numbered by themselves."""
    rows = settle(rows)
    parts = rows.count() // part_rows + 1
    if parts == 1:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    rows = settle(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    sums = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_at", own).join(sums, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def edges_of(quads: DataFrame, predicate: str) -> DataFrame:
    """src and dst of one predicate's links between nodes."""
    return quads.where((F.col("p") == predicate) & (F.col("o_kind") != "literal")).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def path_plus(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) with a path of one edge or more. starts: a column src to begin at; else every node.

    Each round joins the newest pairs with the edges and keeps those not seen; it ends when none is new, so cycles are no
    trouble. From all nodes, rounds double the length: pairs join pairs. Large cycles have very many pairs; reach() gives
    the same without making them.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    if starts is None:
        return _closure(edges)
    edges = settle(edges)
    seen = new = settle(edges.join(starts.select("src").distinct(), "src", "left_semi"))
    while True:
        found = new.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        new = settle(found.distinct().join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def reach(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of every node, and (src, dst) of components with a path of one edge or more from one to the other.

    A component is in pairs with itself if it has a cycle. So a cycle of n nodes is n rows and one pair, not n x n pairs.
    """
    edges = settle(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    members = settle(components(edges))
    of = lambda c: members.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    links = settle(edges.join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
    return members, _closure(links.where("src <> dst")).unionByName(links.where("src = dst"))


def _closure(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with a path between them; rounds double the length, as pairs join pairs."""
    seen = new = settle(edges)
    while True:
        found = new.join(seen.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        back = seen.select("src", F.col("dst").alias("mid")).join(new.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        new = settle(found.unionByName(back).distinct().join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def components(edges: DataFrame) -> DataFrame:
    """node and component: the smallest node among those that reach it and that it reaches, itself included.

    Chains of nodes with one edge in and one out are contracted first, by doubling, so that a long cycle or path takes as
    many rounds as its length has binary digits. What is left is divided by forward and backward colouring.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    nodes = settle(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    edges = settle(edges.where("src <> dst"))
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("outs"), F.lit(0).alias("ins")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("outs"), F.lit(1).alias("ins")))
    chain = settle(ends.groupBy("node").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins")).where("outs = 1 and ins = 1").select("node"))
    after = _chain_ends(chain, edges.select(F.col("src").alias("node"), F.col("dst").alias("next")))
    before = _chain_ends(chain, edges.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    links = after.where("not open").select("node", F.col("next").alias("dst")).join(before.where("not open").select("node", F.col("next").alias("src")), "node")
    links = settle(links)  # each chain's nodes with the node before it and the one after it
    core = nodes.join(chain, "node", "left_anti")
    inner = edges.join(chain.select(F.col("node").alias("src")), "src", "left_anti").join(chain.select(F.col("node").alias("dst")), "dst", "left_anti")
    inner = inner.unionByName(links.select("src", "dst")).where("src <> dst").distinct()
    found = settle(_coloured(settle(core), settle(inner)))
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    through = links.join(of("src"), "src").join(of("dst"), "dst").select("node", F.when(F.col("_src") == F.col("_dst"), F.col("_src")).otherwise(F.col("node")).alias("component"))
    every = settle(found.unionByName(through).unionByName(after.where("open").select("node", F.col("least").alias("component"))))
    names = every.groupBy("component").agg(F.min("node").alias("name"))
    return every.join(names, "component").select("node", F.col("name").alias("component"))


def _chain_ends(chain: DataFrame, next_: DataFrame) -> DataFrame:
    """node, next, least and open of chain nodes: the first node behind the chain, by doubling. Open ones are on a cycle of chain nodes, whose least it gives."""
    on = chain.select(F.col("node").alias("next"), F.lit(True).alias("more"))
    open_ = F.coalesce("more", F.lit(False)).alias("open")
    at = settle(chain.join(next_, "node").join(on, "next", "left").select("node", "next", F.col("node").alias("least"), open_, F.lit(True).alias("moved")))
    far, before = 1, None
    while True:
        total, waiting, moved = at.agg(F.count("*"), F.count_if("open"), F.count_if(F.col("open") & F.col("moved"))).first()
        # on a cycle, windows of nodes that give the same least as those twice as wide have been all the way round
        if not waiting or far > total or (waiting == before and not moved):
            return at.drop("moved")
        ahead = at.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("least").alias("lower"), F.col("open").alias("on"))
        walked = at.where("open").join(ahead, "next").select("node", F.col("then").alias("next"), F.least("least", "lower").alias("least"), F.col("on").alias("open"), (F.col("lower") < F.col("least")).alias("moved"))
        at, far, before = settle(at.where("not open").unionByName(walked)), 2 * far, waiting


def _coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component: each round colours nodes with the least node that reaches them; what of a colour reaches that node is one component.

    Edges between colours, and nodes without edges in or without edges out, are on no cycle and leave.
    """
    done, left = None, edges
    while True:
        left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = settle(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if left.isEmpty():
            break
        colour = settle(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")))
        moved = colour
        while not moved.isEmpty():  # only what changed is sent on
            sent = left.join(moved.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            both = settle(colour.join(sent, "node", "left").select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), F.coalesce(F.col("new") < F.col("colour"), F.lit(False)).alias("moved")))
            colour, moved = both.select("node", "colour"), both.where("moved").select("node", "colour")
        of = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"_{c}"))  # noqa: B023, E731
        same = settle(left.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst", F.col("_src").alias("colour")))
        seen = new = settle(colour.where("node = colour"))
        while not new.isEmpty():
            back = same.join(new.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            new = settle(back.join(seen, ["node"], "left_anti"))
            seen = seen.unionByName(new)
        found = settle(seen.select("node", F.col("colour").alias("component")))
        done = found if done is None else done.unionByName(found)
        gone = found.select(F.col("node").alias("src"))
        left = same.select("src", "dst").join(gone, "src", "left_anti").join(gone.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst")
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def path_star(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) with a path of any length: path_plus, and each node with itself (nodes: a column src; else the edges' ends)."""
    own = nodes.select("src") if nodes is not None else edges.select("src").unionByName(edges.select(F.col("dst").alias("src")))
    plus = path_plus(edges, nodes)
    return plus.unionByName(own.select("src", F.col("src").alias("dst"))).distinct()


def path_seq(first: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the sequence path first / edges*."""
    star = path_star(edges, first.select(F.col("dst").alias("src")).distinct())
    return first.select("src", F.col("dst").alias("mid")).join(star.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()


def lineage(versions: DataFrame) -> DataFrame:
    """ns, version, ancestor and depth of each revision by edited_from. A cycle ends where it closes; an unrecorded parent is no root.

    root is true where the last ancestor's origin is recorded and it has no parent, null where it was not recorded. Each
    round joins ancestors with ancestors: those at exactly 2^k steps with all within 2^k steps of them. So the rounds grow
    with the logarithm of the depth, and each pair is made once; only on cycles pairs come again, and the shortest way stays.
    """
    keys = ["ns", "version", "ancestor"]
    parent = versions.where("edited_from_recorded and edited_from is not null").select("ns", "version", F.col("edited_from").alias("ancestor")).distinct()
    seen = new = settle(parent.withColumn("depth", F.lit(1)))
    far = 1
    while not new.isEmpty():
        step = seen.select("ns", F.col("version").alias("via"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        ahead = new.where(F.col("depth") == far).select("ns", "version", F.col("ancestor").alias("via"))
        found = ahead.join(step, ["ns", "via"]).select("ns", "version", F.col("next").alias("ancestor"), (F.lit(far) + F.col("more")).alias("depth"))
        new = settle(found.groupBy(*keys).agg(F.min("depth").alias("depth")).join(seen, keys, "left_anti"))
        seen, far = seen.unionByName(new), 2 * far
    return seen.join(_roots(versions), ["ns", "ancestor"], "left").select("ns", "version", "ancestor", "depth", "root")


def origins(versions: DataFrame) -> DataFrame:
    """ns, version, origin, depth and root: each revision's farthest ancestor (itself, at depth 0, where it has none), by pointer doubling.

    One row a revision, so long histories cost no more than their length times the logarithm of it. Null origin and depth:
    the revision is on a cycle or below one. A revision must have one parent.
    """
    above = F.when(F.col("edited_from_recorded"), F.col("edited_from"))
    rows = versions.select("ns", "version", above.alias("up")).groupBy("ns", "version").agg(F.min("up").alias("up"))
    missing = rows.select("ns", F.col("up").alias("version")).where("version is not null").distinct().join(rows, ["ns", "version"], "left_anti")
    rows = rows.unionByName(missing.withColumn("up", F.lit(None).cast("string")))  # parents without a row of their own
    at = settle(rows.select("ns", "version", F.coalesce("up", "version").alias("origin"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), F.col("up").isNull().alias("done")))
    far = 1
    while True:
        total, done = at.agg(F.count("*"), F.count_if("done")).first()
        if done == total or far > 2 * total:
            break
        higher = at.select("ns", F.col("version").alias("origin"), F.col("origin").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ended"))
        walking = at.where("not done").join(higher, ["ns", "origin"]).select("ns", "version", F.col("next").alias("origin"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ended").alias("done"))
        at, far = settle(at.where("done").unionByName(walking)), 2 * far
    own = at.join(missing.select("ns", "version"), ["ns", "version"], "left_anti")
    own = own.select("ns", "version", F.when(F.col("done"), F.col("origin")).alias("origin"), F.when(F.col("done"), F.col("depth")).alias("depth"))
    return own.join(_roots(versions).withColumnRenamed("ancestor", "origin"), ["ns", "origin"], "left").select("ns", "version", "origin", "depth", "root")


def _roots(versions: DataFrame) -> DataFrame:
    return versions.select("ns", F.col("version").alias("ancestor"), F.when(F.col("edited_from_recorded"), F.col("edited_from").isNull()).alias("root"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
