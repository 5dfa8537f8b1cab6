"""Breadth-first reads of the graph: traversal, shortest path and causal chains.

A level is one set of joins. Order decides who reaches a node first, so a frontier row carries
the rank at which a queue would hold it, and the next level's order is (parent's rank, the
neighbour's place among the parent's edges). Each level is checkpointed; the driver sees counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import Graph, shared_folder
from .graph import edges_at, oriented, property_map, props_at
from .store import latest

DECAY = 0.25


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _start(spark: SparkSession, node: str, schema: str, rest: tuple = ()) -> DataFrame:
    return spark.createDataFrame([(node, 0, *rest)], f"node string, rank long{schema}")


def _ranked(cand: DataFrame) -> DataFrame:
    """Of several ways to a node the first by (parent's rank, place); then ranks over the level.

    The rank over all of a level is one sort of the new nodes' order columns only; its numbers are dense, so they are
    made from the sorted partitions' sizes without a single task that sees all rows.
    """
    rest = [c for c in cand.columns if c != "nbr"]
    new = cand.groupBy("nbr").agg(F.min_by(F.struct(*rest), F.struct("rank", "ord")).alias("_v")).select("nbr", "_v.*")  # a hub's ways combine before the shuffle
    new = cut(new.repartitionByRange("rank", "ord").sortWithinPartitions("rank", "ord").withColumn("_in", F.monotonically_increasing_id()))
    part = F.shiftright("_in", 33)
    sizes = new.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))
    placed = new.join(F.broadcast(sizes), part == F.col("_p"))  # a row for each partition
    return placed.withColumn("new_rank", F.col("_before") + F.col("_in") - F.shiftleft(F.col("_p"), 33)).drop("_in", "_p", "_before")


def bfs(g: Graph, start: str, at: int, direction: str = "out", relations: Sequence[str] | None = None, max_depth: int = 0, properties: bool = False, stop: str | None = None) -> DataFrame:
    """``node_id, depth, via_edge, via_relation, rank, path`` (and ``properties``) of all nodes reached but the start.

    ``max_depth`` 0 is no limit. ``stop`` ends the search at the level that finds it.
    """
    spark = g.edges.sparkSession
    hops = cut(oriented(g, at, direction, relations))
    frontier = _start(spark, start, ", path array<string>", ([start],))
    visited = frontier.select("node")
    found, depth = None, 0
    while not max_depth or depth < max_depth:
        depth += 1
        f = frontier.select(F.col("node").alias("_from"), "rank", "path")
        cand = f.join(hops, F.col("_from") == F.col("node")).drop("node")
        cand = cand.join(visited.withColumnRenamed("node", "nbr"), "nbr", "left_anti")
        new = cut(_ranked(cand).select("nbr", "edge_id", "relation", "new_rank", F.concat("path", F.array("nbr")).alias("path")))
        if new.isEmpty():
            break
        rows = new.select(F.col("nbr").alias("node_id"), F.lit(depth).alias("depth"), F.col("edge_id").alias("via_edge"), F.col("relation").alias("via_relation"), F.col("new_rank").alias("rank"), "path")
        found = rows if found is None else found.unionByName(rows)
        frontier = new.select(F.col("nbr").alias("node"), F.col("new_rank").alias("rank"), "path")
        visited = cut(visited.union(frontier.select("node")))
        if stop is not None and not new.filter(F.col("nbr") == stop).isEmpty():
            break
    if found is None:
        found = spark.createDataFrame([], "node_id string, depth int, via_edge string, via_relation string, rank long, path array<string>")
    if properties:
        held = property_map(g, "node", at).withColumnRenamed("owner_id", "_o")
        found = found.join(held, F.col("node_id") == F.col("_o"), "left").drop("_o")
    return found


def shortest_path(g: Graph, start: str, end: str, at: int, direction: str = "out", relations: Sequence[str] | None = None, max_depth: int = 0) -> DataFrame:
    """``path, length``: one row, or none if there is no path; from a node to itself the length is 0."""
    spark = g.edges.sparkSession
    if start == end:
        return spark.createDataFrame([([start], 0)], "path array<string>, length int")
    found = bfs(g, start, at, direction, relations, max_depth, stop=end)
    return found.filter(F.col("node_id") == end).select("path", F.col("depth").alias("length"))


def time_factor(delta_us: Column, window_us: int) -> Column:
    return F.when(delta_us <= 0, 1.0).otherwise(F.exp(F.lit(-DECAY) * delta_us / F.lit(float(window_us))))


def edge_weights(g: Graph, at: int) -> DataFrame:
    """``owner_id, w``: the weight as of ``at``, else the confidence; what isn't a number counts as missing."""
    both = props_at(g, "edge", at, ["weight", "confidence"])
    pick = lambda n: F.max(F.when(F.col("prop") == n, F.col("num")))
    return both.groupBy("owner_id").agg(F.coalesce(pick("weight"), pick("confidence")).alias("w"))


def changes(g: Graph) -> DataFrame:
    """``node, ts_us``: the times at which a node changed: versions of its properties, tombstones too, and of the key that its ``readingKey`` names."""
    own = g.props.filter(F.col("owner_kind") == "node").select(F.col("owner_id").alias("node"), "ts_us")
    if g.log is None:
        return own
    named = latest(g.props.filter((F.col("owner_kind") == "node") & (F.col("prop") == "readingKey")), None, ("owner_id",), ("ts_us",)).filter("not tombstone")
    named = named.select(F.col("owner_id").alias("node"), F.col("value").alias("_k"))
    return own.union(named.join(g.log.select("key", "ts_us"), F.col("_k") == F.col("key")).select("node", "ts_us"))


def causal(g: Graph, trigger: str, at: int, max_depth: int = 5, window_us: int = 30_000_000, direction: str = "forward", min_confidence: float = 0.0, relations: Sequence[str] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``node_id, depth, delta, confidence, path, via_edge, via_rel, rank``: nodes that changed within the window of their parent's change.

    Forward takes a neighbour's first change in ``[t, t + W]``, else its last in ``[t - W, t]``; backward the latter only, over
    incoming edges. Nodes without a change, or below ``min_confidence``, aren't marked as seen, so another parent may still reach them: both
    filters come before the choice of the first way. ``delta`` is relative to ``at``; edges count as of ``at`` throughout.
    """
    if not trigger or at == 0 or max_depth < 1 or window_us <= 0:
        raise ValueError("causal needs a trigger, a time, a depth of 1 or more and a window")
    spark = g.edges.sparkSession
    forward = direction == "forward"
    base = (edges_at(g, at) if edges is None else edges).join(edge_weights(g, at).withColumnRenamed("owner_id", "_o"), F.col("id") == F.col("_o"), "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    hops = oriented(g, at, "out" if forward else "in", relations, edges=base)
    hops = cut(hops.join(base.select(F.col("id").alias("_i"), "w"), F.col("edge_id") == F.col("_i")).drop("_i"))
    reach = (max_depth + 1) * window_us  # a change is within the window of its parent's, and the first within that of ``at``
    moves = cut(changes(g).filter(F.col("ts_us").between(at - reach, at + reach)).select(F.col("node").alias("_node"), "ts_us").distinct())
    first = moves.filter((F.col("_node") == trigger) & F.col("ts_us").between(at - window_us, at)).agg(F.max("ts_us")).first()[0]
    frontier = _start(spark, trigger, ", change long, confidence double, path array<string>", (first if first is not None else at, 1.0, [trigger]))
    visited, found = frontier.select("node"), None
    for depth in range(1, max_depth + 1):
        f = frontier.select(F.col("node").alias("_from"), "rank", F.col("change").alias("t"), F.col("confidence").alias("c"), "path")
        cand = f.join(hops, F.col("_from") == F.col("node")).drop("node")
        cand = cand.join(visited.withColumnRenamed("node", "nbr"), "nbr", "left_anti")
        near = cand.select("nbr", "t").distinct().join(moves, (F.col("nbr") == F.col("_node")) & F.col("ts_us").between(F.col("t") - window_us, F.col("t") + window_us))
        ahead, behind = F.min(F.when(F.col("ts_us") >= F.col("t"), F.col("ts_us"))), F.max(F.when(F.col("ts_us") <= F.col("t"), F.col("ts_us")))
        near = near.groupBy("nbr", "t").agg((F.coalesce(ahead, behind) if forward else behind).alias("change")).filter("change is not null")
        cand = cand.join(near, ["nbr", "t"])
        delta = F.col("change") - F.col("t") if forward else F.col("t") - F.col("change")
        cand = cand.withColumn("confidence", F.col("c") * time_factor(delta, window_us) * F.col("w")).filter(F.col("confidence") >= min_confidence)
        new = cut(_ranked(cand).select("nbr", "edge_id", "relation", "new_rank", "change", "confidence", F.concat("path", F.array("nbr")).alias("path")))
        if new.isEmpty():
            break
        rows = new.select(F.col("nbr").alias("node_id"), F.lit(depth).alias("depth"), (F.col("change") - F.lit(at)).alias("delta"), "confidence", "path", F.col("edge_id").alias("via_edge"), F.col("relation").alias("via_rel"), F.col("new_rank").alias("rank"))
        found = rows if found is None else found.unionByName(rows)
        frontier = new.select(F.col("nbr").alias("node"), F.col("new_rank").alias("rank"), "change", "confidence", "path")
        visited = cut(visited.union(frontier.select("node")))
    if found is None:
        found = spark.createDataFrame([], "node_id string, depth int, delta long, confidence double, path array<string>, via_edge string, via_rel string, rank long")
    return found


#: Properties that name a node, in order of preference.
NAMING = ("sensorId", "machineId", "zoneId", "name", "id")


def display_names(g: Graph) -> DataFrame:
    """``node, name``: the first non-empty naming property of each node that has one."""
    from .graph import pivoted

    names = pivoted(g, "node", NAMING)
    pick = F.coalesce(*[F.nullif(F.col(f"`{n}`"), F.lit("")) for n in NAMING])
    return names.select(F.col("owner_id").alias("node"), pick.alias("name")).filter("name is not null")
