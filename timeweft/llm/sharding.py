"""Resharding by minimum-cost flow."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked


def min_cost_flow(supply: list[int], room: list[int], cost=lambda old, new: int(old != new)) -> list[tuple[int, int, int]]:
    """Flows ``(old, new, bytes)`` that place every byte of ``supply`` within ``room`` at the least cost.

    Successive shortest paths with potentials on the bipartite network source -> old shards ->
    new shards -> sink. Moving a byte costs 1 and keeping it where it is nothing, unless ``cost`` says
    otherwise. The network's size is the square of the number of shards, whatever the data.
    """
    if sum(supply) > sum(room):
        raise ValueError("the new shards are too small")
    n, m = len(supply), len(room)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # to, room left, cost, place of the reverse edge

    def edge(a: int, b: int, cap: int, price: int) -> None:
        graph[a].append([b, cap, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, r in enumerate(room):
        edge(n + j, sink, r, 0)
    potential, left = [0] * len(graph), sum(supply)
    while left:
        far, by = [None] * len(graph), [None] * len(graph)
        far[source], todo = 0, [(0, source)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > far[a]:
                continue
            for k, (b, cap, price, _) in enumerate(graph[a]):
                x = d + price + potential[a] - potential[b]
                if cap and (far[b] is None or x < far[b]):
                    far[b], by[b] = x, (a, k)
                    heapq.heappush(todo, (x, b))
        last = max(x for x in far if x is not None)
        potential = [p + (last if x is None else x) for p, x in zip(potential, far, strict=True)]
        path, at = [], sink
        while at != source:
            a, k = by[at]
            path.append(graph[a][k])
            at = a
        step = min(left, *(e[1] for e in path))
        for e in path:
            e[1] -= step
            graph[e[0]][e[3]][1] += step
        left -= step
    return [(i, e[0] - n, graph[e[0]][e[3]][1]) for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]]


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares of ``total``, the first ones a byte larger."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def reshard(blocks: DataFrame, shards: int, room: list[int] | None = None, homes: dict[int, int] | None = None) -> DataFrame:
    """Adds ``shard`` to blocks with a unique ``unit``, ``size`` and ``old_shard`` (0 or more), by the law of bytes.

    ``room`` holds the new shards' capacities; equal shares of all bytes unless given. The flow
    says how many bytes each old shard keeps and sends where; an old shard's blocks, the largest first,
    fill those spans in order, the kept span first, so small blocks move. A block belongs to
    the span in which it begins, so a shard differs from its capacity by less than the blocks at its
    spans' ends. Spans are at most the number of old plus new shards; places come from
    ``ranked``, which no hot shard can overload. ``homes`` says for each ``old_shard`` at which shard its bytes lie for nothing, if not at the one of that number.
    """
    olds = {r["old_shard"]: r["b"] for r in blocks.groupBy("old_shard").agg(F.sum("size").alias("b")).collect()}  # as many rows as shards
    supply = [int(olds.get(i) or 0) for i in range(max([*olds, -1]) + 1)]
    room = room or capacities(sum(supply), shards)
    home = lambda i: i if homes is None else homes[i]
    spans, at = [], dict.fromkeys(olds, 0)
    for old, new, size in sorted(min_cost_flow(supply, room, lambda i, j: int(j != home(i))), key=lambda f: (f[0], f[1] != home(f[0]), f[1])):
        spans.append((old, at[old], at[old] + size, new))
        at[old] += size
    spans = blocks.sparkSession.createDataFrame(spans, "o int, low long, high long, shard int")
    placed = ranked(blocks, [F.col("old_shard"), F.col("size").desc(), F.col("unit")], ["old_shard"], weight="size")
    within = (F.col("old_shard") == F.col("o")) & (F.col("before") >= F.col("low")) & (F.col("before") < F.col("high"))
    return placed.join(F.broadcast(spans), within).select(*blocks.columns, "shard")  # spans: at most old + new shards


def shard_documents(docs: DataFrame, shards: int = 40, old_shards: int = 32, whole: float = 1 / 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, text_hash, old_shard, shard, slot`` for each row of ``docs``.

    The old layout is that of a content hash over ``old_shards``, which puts equal texts
    together; the new one has ``shards`` of equal bytes. A block is a group of equal texts,
    which moves as one, unless it is larger than ``whole`` of a shard: then its rows are blocks
    of their own. (At most ``shards / whole`` groups are that large, so their list may be
    broadcast.) A first flow solves the transfers; a second one, from its spans and with the old layout's costs, evens out what
    the blocks at the spans' ends left, moving the smallest blocks. ``slot`` counts a shard's
    rows from 0 in the order of ids. A row's size is the UTF-8 bytes of its text plus 16.

    *Cases.* Null text: no bytes, CRC of nothing, a group with the empty text. Empty table: no rows. A
    row larger than a shard stays whole. Rows with the same id and text stay together and count twice.
    Other columns are ignored.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(full).cast("long") + 16).alias("size"),
        F.crc32(full).alias("text_crc32"),
        F.xxhash64(full).alias("_group"),
    )
    rows = cut(rows.withColumn("old_shard", F.pmod("_group", F.lit(old_shards)).cast("int")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = rows.groupBy("_group").agg(F.sum("size").alias("_s")).filter(F.col("_s") > total / shards * whole).select(F.col("_group").alias("_large"))
    rows = rows.join(F.broadcast(large), F.col("_group") == F.col("_large"), "left")
    rows = rows.withColumn("unit", F.when(F.col("_large").isNull(), F.col("_group")).otherwise(F.xxhash64(F.lit("row"), "doc_id", "_group")))
    blocks = cut(rows.groupBy("unit", "old_shard").agg(F.sum("size").alias("size")))
    first = reshard(blocks, shards)
    # The second flow starts from the spans of the first, each with the shard where its bytes have lain all along.
    lain = sorted((r["shard"], r["old_shard"]) for r in first.select("shard", "old_shard").distinct().collect())  # at most old + new shards
    number = F.element_at(F.create_map(*[F.lit(x) for i, (a, b) in enumerate(lain) for x in (a * old_shards + b, i)]), F.col("shard") * old_shards + F.col("old_shard")) if lain else F.lit(0)
    homes = {i: b for i, (_, b) in enumerate(lain)}
    second = reshard(first.select("unit", "size", number.cast("int").alias("old_shard")), shards, homes=homes)
    placed = rows.join(second.select(F.col("unit").alias("u"), "shard"), F.col("unit") == F.col("u"))
    placed = placed.select("doc_id", "size", "text_crc32", F.col("_group").alias("text_hash"), "old_shard", "shard", "unit")
    return ranked(placed, [F.col("shard"), F.col("doc_id"), F.col("unit")], ["shard"], rank="slot").drop("unit")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, column: str, only: list[int] | None = None, text: str = "text", key: str = "doc_id") -> None:
    """Writes ``docs`` as one folder ``{column}=N`` for each shard of ``placed``; with ``only``, those shards alone.

    *Cases.* Rows are found by id and text (a null text is the empty one), so repeated rows and rows of one id with other texts are written as often as
    they are there, each where it belongs. Null ids are ids. Empty table: no folders.
    """
    own = placed.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), column).distinct()
    own = own.filter(F.col(column).isin(only)) if only is not None else own
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_hash"))
    docs.join(own, same).drop("_id", "_hash").write.mode("append").partitionBy(column).parquet(path)


def affected(placed: DataFrame) -> list[int]:
    """The shards whose rows change: those that lose or gain one. Bounded by the number of shards."""
    moved = placed.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    return sorted(r["s"] for r in moved.collect())


def rewrite(spark: SparkSession, old_path: str, new_path: str, placed: DataFrame, shards: int) -> list[int]:
    """From files under ``old_shard=N`` makes files under ``shard=N``; reads and writes the affected shards only.

    Returns the shards that were not touched, whose old files go on serving. Cases: those of ``write_shards``.
    """
    touched = affected(placed)
    docs = spark.read.parquet(old_path).filter(F.col("old_shard").isin(touched)).drop("old_shard")
    write_shards(docs, placed, new_path, "shard", touched)
    return [i for i in range(shards) if i not in touched]
