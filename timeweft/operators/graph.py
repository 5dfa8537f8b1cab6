"""The property graph: snapshots, pattern joins, differences, catalogues and writes.

``g`` is a ``Graph`` of version relations (see ``sources.tables``). Reads are bitemporal: the
version is the last one written at ``at`` or before, and it counts if ``valid_from <= at < valid_to``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Graph
from .store import latest

WRITTEN = ("ts_us",)


def valid(at: int | None, prefix: str = "") -> Column:
    """``valid_from <= at < valid_to`` with an open end; without ``at``, no bound."""
    if at is None:
        return F.lit(True)
    a, b = F.col(f"{prefix}valid_from"), F.col(f"{prefix}valid_to")
    return (a <= F.lit(at)) & (b.isNull() | (b > F.lit(at)))


def overlaps(start: int, end: int) -> Column:
    """Valid at some instant of ``[start, end)``."""
    return (F.col("valid_from") < F.lit(end)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(start)))


def nodes_at(g: Graph, at: int | None = None, kind: str | None = None, check_valid: bool = True, live: bool = True) -> DataFrame:
    """``id, type, valid_from, valid_to, deleted, ts_us``: the last version of each node at ``at``."""
    rows = g.nodes if kind is None else g.nodes.filter(F.col("type") == kind)
    out = latest(rows, at, ("id",), WRITTEN, few=True)
    out = out.filter(~F.col("deleted")) if live else out
    return out.filter(valid(at)) if check_valid else out


def edges_at(g: Graph, at: int | None = None, relation: str | None = None, check_valid: bool = True, live: bool = True, most: int | None = None) -> DataFrame:
    rows = g.edges if relation is None else g.edges.filter(F.col("relation") == relation)
    out = latest(rows, at, ("id",), WRITTEN, few=True, most=most)
    out = out.filter(~F.col("deleted")) if live else out
    return out.filter(valid(at)) if check_valid else out


def props_at(g: Graph, kind: str, at: int | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """``owner_id, prop, value, num``: properties of nodes or edges as of ``at``; a tombstone hides one."""
    rows = g.props.filter(F.col("owner_kind") == kind)
    if names is not None:
        rows = rows.filter(F.col("prop").isin(list(names)))
    return latest(rows, at, ("owner_id", "prop"), WRITTEN).filter(~F.col("tombstone")).select("owner_id", "prop", "value", "num")


def pivoted(g: Graph, kind: str, names: Sequence[str], at: int | None = None) -> DataFrame:
    """``owner_id`` and a text column for each of ``names``, in one aggregate over the versions of just those properties."""
    rows = g.props.filter((F.col("owner_kind") == kind) & F.col("prop").isin(list(names)))
    rows = rows if at is None else rows.filter(F.col("ts_us") <= F.lit(at))
    picks = [F.max_by(F.struct("value", "tombstone"), F.when(F.col("prop") == n, F.col("ts_us"))).alias(f"_{i}") for i, n in enumerate(names)]
    out = rows.groupBy("owner_id").agg(*picks)
    return out.select("owner_id", *[F.when(~F.col(f"_{i}.tombstone"), F.col(f"_{i}.value")).alias(n) for i, n in enumerate(names)])


def property_map(g: Graph, kind: str, at: int | None = None) -> DataFrame:
    return props_at(g, kind, at).groupBy("owner_id").agg(F.map_from_entries(F.collect_list(F.struct("prop", "value"))).alias("properties"))


def property_names(g: Graph, kind: str) -> list[str]:
    """The schema of a graph without one: distinct names, which are few."""
    return sorted(r["prop"] for r in g.props.filter(F.col("owner_kind") == kind).select("prop").distinct().collect())


def with_props(rows: DataFrame, g: Graph, kind: str, names: Sequence[str], at: int | None, key: str, prefix: str = "") -> DataFrame:
    """Left-joins the named properties as columns ``prefix + name``."""
    if not names:
        return rows
    p = pivoted(g, kind, names, at)
    p = p.select(F.col("owner_id").alias("_owner"), *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])
    return rows.join(p, F.col(f"`{key}`") == F.col("_owner"), "left").drop("_owner")


def oriented(g: Graph, at: int | None, direction: str = "out", relation: str | Sequence[str] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``node, nbr, edge_id, relation, ord`` for each side of each edge at ``at``; in both directions a self-loop is there twice.

    ``ord`` is the order in which a node's edges are visited: outgoing ones first, each by creation. An edge's relation never
    changes, so it is filtered before the versions are compared, where the filter reaches the scan.
    """
    wanted = None if relation is None else F.col("relation").isin([relation] if isinstance(relation, str) else list(relation))
    if edges is None:
        edges = edges_at(g if wanted is None else replace(g, edges=g.edges.filter(wanted)), at)
    elif wanted is not None:
        edges = edges.filter(wanted)
    e = edges

    def side(a: str, b: str, first: int) -> DataFrame:
        return e.select(F.col(a).alias("node"), F.col(b).alias("nbr"), F.col("id").alias("edge_id"), "relation", F.struct(F.lit(first).alias("side"), F.col("adj_pos").alias("pos"), F.col("id").alias("e")).alias("ord"))

    out, inc = side("src", "dst", 0), side("dst", "src", 1)
    return {"out": out, "in": inc}.get(direction) if direction in ("out", "in") else out.unionByName(inc)


def expand(rows: DataFrame, g: Graph, at: int | None, start: str, edge: str, end: str, direction: str = "out", relation: str | None = None, end_type: str | None = None, props: dict[str, Sequence[str]] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """The pattern join: from column ``{start}.__id`` over one hop to ``{end}.__id``.

    Binds ``{edge}.id, {edge}.relation`` and ``{end}.id, {end}.__type``. The target must have been written by ``at``; its own deletion and
    validity don't matter, its type, if given, does. ``props`` names the properties to bind for ``edge`` and ``end``. Each snapshot is one
    aggregate and the joins are equi-joins, whose order and kind Catalyst picks.
    """
    props = props or {}
    hop = oriented(g, at, direction, relation, edges)
    hop = hop.select(F.col("node").alias("_node"), F.col("nbr").alias(f"{end}.__id"), F.col("edge_id").alias(f"{edge}.__id"), F.col("edge_id").alias(f"{edge}.id"), F.col("relation").alias(f"{edge}.relation"))
    out = rows.join(hop, F.col(f"`{start}.__id`") == F.col("_node")).drop("_node")
    target = nodes_at(g, at, end_type, check_valid=False, live=False).select(F.col("id").alias("_id"), F.col("id").alias(f"{end}.id"), F.col("type").alias(f"{end}.__type"))
    out = out.join(target, F.col(f"`{end}.__id`") == F.col("_id")).drop("_id")
    out = with_props(out, g, "edge", props.get(edge, ()), at, f"{edge}.__id", f"{edge}.")
    return with_props(out, g, "node", props.get(end, ()), at, f"{end}.__id", f"{end}.")


def adjacency(g: Graph, at: int | None = None) -> DataFrame:
    """``node, direction (out | in), edge_ids``: each node's edges at ``at`` in the order of their creation."""
    both = oriented(g, at, "out").select("node", F.lit("out").alias("direction"), "ord").unionByName(oriented(g, at, "in").select("node", F.lit("in").alias("direction"), "ord"))
    return both.groupBy("node", "direction").agg(F.transform(F.array_sort(F.collect_list("ord")), lambda o: o["e"]).alias("edge_ids"))


def scan(g: Graph, at: int | None, var: str, kind: str | None = None, props: Sequence[str] = (), nodes: DataFrame | None = None) -> DataFrame:
    """``var.id, var.__type`` and the named properties of nodes that live and are valid at ``at``."""
    rows = nodes_at(g, at, kind) if nodes is None else nodes
    rows = rows.select(F.col("id").alias(f"{var}.__id"), F.col("id").alias(f"{var}.id"), F.col("type").alias(f"{var}.__type"))
    return with_props(rows, g, "node", props, at, f"{var}.__id", f"{var}.")


def diff(g: Graph, t1: int, t2: int, relation: str | None = None, from_type: str | None = None) -> DataFrame:
    """Edges ``added``, ``removed`` or ``changed`` (another weight) between two transaction times: both snapshots come from one aggregate over each relation."""

    def snaps(rows: DataFrame, key: str, *rest: str) -> DataFrame:
        """The versions of ``key`` at either time, ``a`` and ``b``."""
        last = lambda t: F.max_by(F.struct(*rest), F.when(F.col("ts_us") <= F.lit(t), F.col("ts_us")))
        return rows.filter(F.col("ts_us") <= F.lit(max(t1, t2))).groupBy(key).agg(last(t1).alias("a"), last(t2).alias("b"))

    live = lambda v: v.isNotNull() & ~F.coalesce(v["deleted"], F.lit(False))
    rows = g.edges if relation is None else g.edges.filter(F.col("relation") == relation)
    e = snaps(rows, "id", "src", "dst", "relation", "deleted")
    e = e.withColumn("a", F.when(live(F.col("a")), F.col("a"))).withColumn("b", F.when(live(F.col("b")), F.col("b"))).filter("a is not null or b is not null")
    weight = snaps(g.props.filter((F.col("owner_kind") == "edge") & (F.col("prop") == "weight")), "owner_id", "num", "tombstone")
    held = lambda c: F.coalesce(F.when(~F.col(f"{c}.tombstone"), F.col(f"{c}.num")), F.lit(0.0))
    weight = weight.select(F.col("owner_id").alias("_o"), held("a").alias("_a"), held("b").alias("_b"))
    both = e.join(weight, F.col("id") == F.col("_o"), "left")
    tags = [F.col(f"{t}.{c}").alias(f"{c}_{t}") for t in "ab" for c in ("src", "dst", "relation")]
    both = both.select(F.col("id").alias("edge_id"), *tags, F.coalesce("_a", F.lit(0.0)).alias("w_a"), F.coalesce("_b", F.lit(0.0)).alias("w_b"))
    was, is_ = F.col("src_a").isNotNull(), F.col("src_b").isNotNull()
    change = F.when(~was, "added").when(~is_, "removed").when(F.col("w_a") != F.col("w_b"), "changed")
    both = both.withColumn("change", change).filter(F.col("change").isNotNull())
    out = both.select(
        "edge_id", F.coalesce("src_b", "src_a").alias("from"), F.coalesce("dst_b", "dst_a").alias("to"), F.coalesce("relation_b", "relation_a").alias("relation"), "change",
        F.when(F.col("change") == "changed", F.col("w_a")).alias("weight_before"), F.when(F.col("change") == "changed", F.col("w_b")).alias("weight_after"),
    )
    if from_type is not None:
        typed = [nodes_at(g, t, from_type, check_valid=False, live=False).select("id") for t in (t1, t2)]
        out = out.join(typed[0].union(typed[1]).distinct().withColumnRenamed("id", "from"), "from", "left_semi")
    return out.select("edge_id", "from", "to", "relation", "change", "weight_before", "weight_after")


def graph_stats(g: Graph) -> DataFrame:
    """``what (node | edge), type, total, active, deleted`` over the current versions."""

    def side(rows: DataFrame, what: str, kind: str) -> DataFrame:
        now = latest(rows, None, ("id",), WRITTEN).groupBy(F.col(kind).alias("type"))
        return now.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("deleted")).alias("active"), F.count_if("deleted").alias("deleted")).select(F.lit(what).alias("what"), "*")

    return side(g.nodes, "node", "type").unionByName(side(g.edges, "edge", "relation"))


def show_nodes(g: Graph) -> DataFrame:
    """Live nodes in order of their ids: ``id, type, properties``, the names of all properties ever set."""
    names = g.props.filter(F.col("owner_kind") == "node").groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("prop")), ", ").alias("properties"))
    rows = nodes_at(g, check_valid=False).join(names, F.col("id") == F.col("owner_id"), "left")
    return rows.select("id", "type", F.coalesce("properties", F.lit("")).alias("properties")).orderBy("id")


def show_edges(g: Graph) -> DataFrame:
    return edges_at(g, check_valid=False).select("id", F.col("src").alias("from"), F.col("dst").alias("to"), "relation").orderBy("id")


def graph_keys(g: Graph) -> DataFrame:
    """Every key that the graph occupies in a store: metadata, properties and adjacency of all nodes and edges, deleted ones too."""
    parts = [
        g.nodes.select(F.explode(F.array(F.concat(F.lit("node:"), "id", F.lit(":meta")), F.concat(F.lit("graph:adj:"), "id", F.lit(":out")), F.concat(F.lit("graph:adj:"), "id", F.lit(":in")))).alias("key")),
        g.edges.select(F.concat(F.lit("edge:"), "id", F.lit(":meta")).alias("key")),
        g.props.select(F.concat_ws(":", "owner_kind", "owner_id", F.lit("prop"), "prop").alias("key")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def show_keys(g: Graph) -> DataFrame:
    keys = graph_keys(g)
    return (keys if g.log is None else keys.union(g.log.select("key")).distinct()).orderBy("key")


def describe(g: Graph, kind: str, at: int | None = None, id_: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Metadata and properties of nodes or edges as of ``at``; valid time isn't checked. Metadata wins where a property has its name."""
    snap = nodes_at if kind == "node" else edges_at
    rows = snap(g, at, check_valid=False)
    rows = rows if id_ is None else rows.filter(F.col("id") == id_)
    meta = ["id", "type", "valid_from", "valid_to"] if kind == "node" else ["id", F.col("src").alias("from"), F.col("dst").alias("to"), "relation", "valid_from", "valid_to"]
    rows = rows.select(*meta)
    names = [n for n in (property_names(g, kind) if names is None else names) if n not in rows.columns]
    return with_props(rows, g, kind, names, at, "id").orderBy("id")


def resolve(g: Graph, identifier: str, props: Sequence[str] | None = None) -> DataFrame:
    """``id``: the node with that id (deleted or not), else the first live node, by id, with a current property equal to it."""
    direct = g.nodes.filter(F.col("id") == identifier).select("id", F.lit(0).alias("rank"))
    held = props_at(g, "node", None, props).filter(F.col("value") == identifier).select(F.col("owner_id").alias("id")).distinct()
    held = held.join(nodes_at(g, check_valid=False).select("id"), "id", "left_semi").select("id", F.lit(1).alias("rank"))
    return direct.union(held).orderBy("rank", "id").limit(1).select("id")


def fetch_latest(rows: DataFrame, log: DataFrame, key: Column, alias: str, at: int | None = None) -> DataFrame:
    """Adds the current value (or, with ``at``, that of then) of a computed key; null where there is none."""
    now = latest(log.select("key", "value", "tombstone", "ts_us", "hlc_node", "hlc_seq"), at).filter(~F.col("tombstone")).select(F.col("key").alias("_key"), F.col("value").alias(alias))
    return rows.withColumn("_want", key).join(now, F.col("_want") == F.col("_key"), "left").drop("_want", "_key")


def fetch_history(rows: DataFrame, log: DataFrame, key: Column, alias: str, start: int | None = None, end: int | None = None, last: int | None = None) -> DataFrame:
    """Adds a computed key's versions as ``ts:value;...`` with four decimals (0.0000 for what is no number); ``last`` n are newest first."""
    versions = log
    if start:
        versions = versions.filter(F.col("ts_us") >= F.lit(start))
    if end:
        versions = versions.filter(F.col("ts_us") <= F.lit(end))
    order = F.array_sort(F.collect_list(F.struct("ts_us", "hlc_node", "hlc_seq", F.coalesce("num", F.lit(0.0)).alias("num"))))
    order = F.slice(F.reverse(order), 1, last) if last else order
    lines = F.transform(order, lambda p: F.format_string("%d:%.4f", p["ts_us"], p["num"]))
    held = versions.groupBy(F.col("key").alias("_key")).agg(F.array_join(lines, ";").alias(alias))
    return rows.withColumn("_want", key).join(held, F.col("_want") == F.col("_key"), "left").drop("_want", "_key")


# Writes: each returns version rows to append.

SIDES = ("src", "dst")
MANY = 1000
#: Up to so many parts, Spark's default of spark.shuffle.sort.bypassMergeThreshold, a shuffle's rows go straight to files; for more they are sorted in memory first, and spilled. For edges that meet nothing by id afterwards.
STRAIGHT = 200


def _spans(g: Graph) -> DataFrame:
    """``relation, side, node, lo, hi, open``: the least start and the greatest end of all versions of a relation's edges at a node, and if one has no end."""
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("node")) for s in SIDES])).alias("e")
    rows = g.edges.select("relation", F.coalesce("valid_from", F.lit(0)).alias("start"), "valid_to", ends).select("relation", "e.side", "e.node", "start", "valid_to")
    return rows.groupBy("node", "relation", "side").agg(F.min("start").alias("lo"), F.max("valid_to").alias("hi"), F.bool_or(F.col("valid_to").isNull()).alias("open"))


def _relations(spans: DataFrame) -> dict[str, list[str | None]] | None:
    """The relations in ``spans`` by their side: labels, so few. None if they are more than ``MANY``, when all edges are looked at.

    An edge's relation never changes, so it may be filtered before versions are compared.
    """
    pairs = spans.select("relation", "side").distinct().limit(MANY + 1).collect()
    return None if len(pairs) > MANY else {s: [r["relation"] for r in pairs if r["side"] == s] for s in SIDES}


def _of_relations(g: Graph, names: Sequence[str | None]) -> Graph:
    known = [n for n in names if n is not None]
    wanted = F.col("relation").isin(known) if known else F.lit(False)
    return replace(g, edges=g.edges.filter(wanted | F.col("relation").isNull() if None in names else wanted))


def create_edges(g: Graph, new: DataFrame, ts_us: int) -> tuple[DataFrame, DataFrame]:
    """Splits ``new`` (``id, src, dst, relation, valid_from, valid_to``) into versions and rejects (with a ``reason``).

    Both ends must be live, and the edge's interval must lie within theirs. A missing start is now.
    """
    rows = _checked(g, new, ts_us)
    keep = ["id", "src", "dst", "relation", "valid_from", "valid_to"]
    good = rows.filter(F.col("reason").isNull()).select(*keep, F.lit(False).alias("deleted"), F.lit(ts_us).alias("adj_pos"), F.lit(ts_us).alias("ts_us"))
    return good, rows.filter(F.col("reason").isNotNull()).select(*keep, "reason")


def _ends(g: Graph) -> DataFrame:
    """The intervals of live nodes: ``id, valid_from, valid_to``."""
    return nodes_at(replace(g, nodes=g.nodes.select("id", "valid_from", "valid_to", "deleted", "ts_us")), None, check_valid=False).select("id", "valid_from", "valid_to")


def _checked(g: Graph, new: DataFrame, ts_us: int, sides: Sequence[str] = SIDES) -> DataFrame:
    """``new`` with the ``reason`` why an edge can't be, null if it can, by the nodes at ``sides``."""
    ends = _ends(g)
    rows = new.withColumn("valid_from", F.coalesce("valid_from", F.lit(ts_us)))
    for side in sides:
        e = ends.select(F.col("id").alias(f"_{side}"), F.col("valid_from").alias(f"_{side}_from"), F.col("valid_to").alias(f"_{side}_to"))
        rows = rows.join(e, F.col(side) == F.col(f"_{side}"), "left")

    def within(side: str) -> Column:
        top = F.col(f"_{side}_to")
        return (F.col("valid_from") >= F.col(f"_{side}_from")) & (top.isNull() | (F.col("valid_to").isNotNull() & (F.col("valid_to") <= top)))

    lost = reduce(Column.__or__, [F.col(f"_{side}").isNull() for side in sides])
    reason = F.when(lost, "node not found").when(~reduce(Column.__and__, [within(side) for side in sides]), "edge outside node validity")
    return rows.withColumn("reason", reason)


def edge_validity_violations(g: Graph) -> DataFrame:
    """Live edges whose interval isn't within both their nodes' intervals: ``id, src, dst, reason``.

    First each node is held against the span of all edges at it, an aggregate that combines before the shuffle. Only relations, and sides
    of them, for which some node fails there have edges to be looked at one by one.
    """
    start, end = F.col("valid_from"), F.col("valid_to")
    outside = F.col("id").isNull() | (F.col("lo") < start) | (end.isNotNull() & (F.col("open") | (F.col("hi") > end)))
    found = _relations(_spans(g).join(_ends(g), F.col("node") == F.col("id"), "left").filter(outside))
    sides = SIDES if found is None else [s for s in SIDES if found[s]]
    rows = g if found is None else _of_relations(g, sorted({r for s in SIDES for r in found[s]}, key=str))
    rows = replace(rows, edges=rows.edges.select("id", "src", "dst", "valid_from", "valid_to", "deleted", "ts_us"))
    now = edges_at(rows, check_valid=False, most=STRAIGHT).select("id", "src", "dst", "valid_from", "valid_to")
    if not sides:
        return now.select("id", "src", "dst", F.lit("").alias("reason")).filter(F.lit(False))
    return _checked(g, now, 0, sides).filter(F.col("reason").isNotNull()).select("id", "src", "dst", "reason")


def delete_nodes(g: Graph, ids: DataFrame, ts_us: int) -> tuple[DataFrame, DataFrame]:
    """Soft-deletion versions of the nodes in ``ids`` (``id``) and of all live edges at either end of them.

    Relations that have none of the nodes at a side aren't looked at there.
    """
    ids = ids.select("id").distinct()
    gone = {"deleted": F.lit(True), "valid_to": F.lit(ts_us).cast("bigint"), "ts_us": F.lit(ts_us).cast("bigint")}
    nodes = nodes_at(g, check_valid=False).join(ids, "id", "left_semi").withColumns(gone)
    ends = ids.withColumnRenamed("id", "_end")
    found = _relations(_spans(g).join(ends, F.col("node") == F.col("_end"), "left_semi"))

    def at(rows: Graph, *sides: str) -> DataFrame:
        edges = edges_at(rows, check_valid=False, most=STRAIGHT)
        return reduce(DataFrame.union, [edges.join(ends, F.col(s) == F.col("_end"), "left_semi") for s in sides])

    if found is None:
        return nodes, at(g, *SIDES).dropDuplicates(["id"]).withColumns(gone)
    both = {r for r in found["src"] if r in found["dst"]}
    parts = [at(_of_relations(g, own), s) for s in SIDES if (own := [r for r in found[s] if r not in both])]
    parts += [at(_of_relations(g, sorted(both, key=str)), *SIDES).dropDuplicates(["id"])] if both else []
    touched = reduce(DataFrame.union, parts) if parts else g.edges.filter(F.lit(False))
    return nodes, touched.withColumns(gone)


def delete_edges(g: Graph, ids: DataFrame, ts_us: int) -> DataFrame:
    gone = {"deleted": F.lit(True), "valid_to": F.lit(ts_us).cast("bigint"), "ts_us": F.lit(ts_us).cast("bigint")}
    return edges_at(g, check_valid=False).join(ids.select("id").distinct(), "id", "left_semi").withColumns(gone)


def create_nodes(new: DataFrame, ts_us: int) -> DataFrame:
    """Versions for ``new`` (``type`` and optionally ``id, valid_from, valid_to``); a missing id is a UUID, a missing start is now."""
    have = new.columns
    return new.select(
        (F.coalesce("id", F.uuid()) if "id" in have else F.uuid()).alias("id"), "type",
        (F.coalesce("valid_from", F.lit(ts_us)) if "valid_from" in have else F.lit(ts_us)).cast("bigint").alias("valid_from"),
        (F.col("valid_to") if "valid_to" in have else F.lit(None)).cast("bigint").alias("valid_to"), F.lit(False).alias("deleted"), F.lit(ts_us).cast("bigint").alias("ts_us"),
    )


def set_props(g: Graph, kind: str, new: DataFrame, ts_us: int) -> tuple[DataFrame, DataFrame]:
    """Property versions for ``new`` (``owner_id, prop, value``) of live owners, and the rows whose owner is deleted or unknown."""
    from ..functions.values import num

    live = (nodes_at if kind == "node" else edges_at)(g, check_valid=False).select(F.col("id").alias("owner_id"))
    good = new.join(live, "owner_id", "left_semi").select(F.lit(kind).alias("owner_kind"), "owner_id", "prop", "value", num(F.col("value")).alias("num"), F.lit(False).alias("tombstone"), F.lit(ts_us).cast("bigint").alias("ts_us"))
    return good, new.join(live, "owner_id", "left_anti")
