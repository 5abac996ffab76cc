"""Graph closures by level-wise joins. Every level is a checkpoint, so lost executors cost one level."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Links that one partition of a graph holds at least.
LINKS = 50_000


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder the session names; only on one machine that names none, in a folder of that machine."""
    _checkpoint_dir(df)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Like :func:`durable`, as columns: for wide tables of which each later step reads a part. The planner knows their size."""
    folder = f"{_checkpoint_dir(df)}/plans-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _checkpoint_dir(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-scratch-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def reach(edges: DataFrame, starts: DataFrame, src: str, dst: str, within: int | None = None) -> DataFrame:
    """(node, marks, hops): all nodes reachable from the starts (0 hops), each with its fewest hops.

    The first column of ``starts`` is the node; others are marks that go along, so several closures are one: a
    node comes once for each mark that reaches it. It ends when a level brings nothing new; ``within`` is a
    limit that the question itself sets (nodes of at most so many hops).
    """
    marks = starts.columns[1:]
    levels = [durable(starts.withColumnRenamed(starts.columns[0], "node").distinct().withColumn("hops", F.lit(0)))]
    while within is None or len(levels) <= within:
        step = levels[-1].join(edges, F.col("node") == F.col(src)).select(F.col(dst).alias("node"), *marks).distinct()
        new = durable(step.join(_union(levels).select("node", *marks), ["node", *marks], "left_anti").withColumn("hops", F.lit(len(levels))))
        if new.isEmpty():
            break
        levels.append(new)
    return _union(levels)


def _star(edges: DataFrame, large: bool, ways: int, parts: int) -> DataFrame:
    """One contraction of links (a, b) with a above b: each node's neighbours are tied to the smallest of them and the node itself.

    The large star moves only the neighbours above the node, the small star those below and the node; both
    keep what is connected, and a link makes one link at most. A node's minimum comes back to its links by salts, so no
    task meets more than a salt's share of a hub's links.
    """
    if parts == 1:
        # Few links need no salts; a window asks for no shuffle inside one partition, as joins do.
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        if large:
            ends = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("other"))
            both = edges.select(F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("e")).select("e.*")
        tied = both.withColumn("low", F.least(F.min("other").over(Window.partitionBy("node")), F.col("node")))
        tied = tied.where(F.col("other") > F.col("node")) if large else tied
    else:
        # The large star's nodes are the lower ends; a node that is nobody's upper end is the smallest of its own star.
        node, other = ("b", "a") if large else ("a", "b")
        both = edges.select(F.col(node).alias("node"), F.col(other).alias("other"), F.pmod(F.xxhash64(other), F.lit(ways)).cast("int").alias("salt"))
        low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        tied = both.join(both.select("node", "salt").distinct().join(low, "node"), ["node", "salt"], "left" if large else "inner")
    # Of a node's lower neighbours the smallest stands for the node's own link.
    moved = F.col("other") if large else F.when(F.col("other") == F.col("low"), F.col("node")).otherwise(F.col("other"))
    return tied.select(moved.alias("a"), F.coalesce("low", "node").alias("b")).distinct()


def _mark(edges: DataFrame):
    """The number of links and a sum that changes with them."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame, ways: int = 16) -> DataFrame:
    """(node, component) of every node in ``links`` (columns a, b): component is the smallest node reachable.

    By alternating star contractions, a small one first: it alone shrinks links that tie nodes to several others each, as those
    of keys do, to about one a node. Loops and repeated links do no harm; links with a null end are left
    out; a node whose only link is to itself is not listed. Each round is a checkpoint in the shared folder; the rounds
    grow with the logarithm of the longest path, and end when a round changes nothing. Links are held in as few partitions as
    ``LINKS`` allows: a graph of no more than that is one, whose rounds shuffle nothing; else each round would leave thousands of tiny files behind.
    """
    some = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = durable(some.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = max(1, math.ceil(edges.count() / LINKS))
    edges = durable(_star(edges.coalesce(parts), False, ways, parts))
    mark = _mark(edges)
    while True:
        parts = max(1, math.ceil(mark[0] / LINKS))
        edges = durable(_star(_star(edges.coalesce(parts), True, ways, parts), False, ways, parts))
        row = _mark(edges)
        if row == mark:
            break
        mark = row
    edges = edges.coalesce(max(1, math.ceil(mark[0] / LINKS)))
    components = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return components.unionByName(components.select(F.col("component").alias("node"), "component").distinct())


def smallest_label(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): connected components by the smallest node; a node tied only to itself is its own label."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    found = connected_components(pairs).select("node", F.col("component").alias("label"))
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.withColumn("label", F.col("node")))


def scopes(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """runtime if a production root reaches the node, else dev if a development root does, else unknown.

    ``roots``: node, dev (boolean). ``edges``: src, dst.
    """
    found = reach(edges, roots.select("node", "dev"), "src", "dst").groupBy("node").agg(F.bool_and("dev").alias("dev"))
    scope = F.when(F.col("dev"), "dev").when(~F.col("dev"), "runtime").otherwise("unknown")
    return nodes.select("node").join(found, "node", "left").select("node", scope.alias("scope"))


def shortest_paths(edges: DataFrame, starts: DataFrame, src: str, dst: str, levels: int | None = None) -> DataFrame:
    """(node, path): one shortest path to each reachable node, the smallest of equals, as an array from the start.

    ``levels`` is a limit that the question itself sets (paths of so many steps at most); without one all are found.
    """
    found = [durable(starts.select(F.col(starts.columns[0]).alias("node")).distinct().withColumn("path", F.array("node")))]
    while levels is None or len(found) <= levels:
        step = found[-1].join(edges, F.col("node") == F.col(src)).select(F.col(dst).alias("to"), F.concat("path", F.array(dst)).alias("path"))
        step = step.groupBy("to").agg(F.min("path").alias("path")).withColumnRenamed("to", "node")
        new = durable(step.join(_union(found).select("node"), "node", "left_anti"))
        if new.isEmpty():
            break
        found.append(new)
    return _union(found)


def resolve_chain(aliases: DataFrame, name: str, target: str, depth: int = 6) -> DataFrame:
    """(name, final, hops, finished): each alias followed ``depth`` steps at most; not finished if ``final`` is an alias itself."""
    out = aliases.select(F.col(name).alias("name"), F.col(target).alias("final"), F.lit(1).alias("hops"))
    step = aliases.select(F.col(name).alias("final"), F.col(target).alias("next"))
    for _ in range(depth - 1):
        out = out.join(step, "final", "left").select(
            "name", F.coalesce("next", "final").alias("final"), (F.col("hops") + F.when(F.col("next").isNotNull(), 1).otherwise(0)).alias("hops")
        )
    return out.join(step.select("final", "next"), "final", "left").select("name", "final", "hops", F.col("next").isNull().alias("finished"))


def first_seen_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows numbered in input order within keys; the base of every first-wins rule."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
