"""Near copies by the share of their shingles, on top of SimHash links: an exact prefix join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .components import components
from .simhash import SHIFT, simhash_groups

#: Two texts are near copies when at least 4 of 5 of the shingles of both are shared.
NUMER, DENOM = 4, 5
#: Shingles of the prefixes that near copies share at least (fewer for tiny texts).
SHARED = 3
#: Rows of a key up to this many are paired; those of a larger one meet by way of a centre.
FEW = 16
#: Near copies' sizes differ by this factor at most.
BAND = math.log(DENOM / NUMER)
#: Shingles that are put last in the order because many texts have them; the choice changes the cost only.
HOT, SAMPLE = 1 << 16, 8
#: Bits of a sketch at least; shingles in a block.
SKETCH, CELLS = 1024, 1 << 18


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the text's runs of ``words`` words (of all its words, if fewer), in order; words as in ``fingerprint``."""
    from xxhash import xxh64_intdigest

    own = (text or "").encode().translate(SHIFT).split()
    if not own:
        return np.empty(0, np.uint64)
    w = np.fromiter((xxh64_intdigest(x, 42) for x in own), np.uint64, len(own))
    n = max(1, len(own) - words + 1)
    h = np.full(n, min(words, len(own)), np.uint64)
    for j in range(min(words, len(own))):
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ h >> np.uint64(32))


def least_shared(n: int) -> int:
    """Shingles that a set of n shares with any near copy, at least."""
    return -(-NUMER * n // DENOM)


def held(own: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``own`` are in the sorted array ``some``."""
    return some[np.minimum(np.searchsorted(some, own), len(some) - 1)] == own if len(some) else np.zeros(len(own), bool)


def prefix(own: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """The first of the shingles, by hash, the hot ones last (near copies share ``SHARED`` of these), and how many aren't hot."""
    late = held(own, hot)
    need = least_shared(len(own))
    return np.concatenate([own[~late], own[late]])[: len(own) - need + min(SHARED, need)], int((~late).sum())


def prefixes(rows: DataFrame, hot: np.ndarray, words: int) -> DataFrame:
    """``key, id, n, r``: each row's prefix, with the number of its shingles and of those that aren't hot. ``rows``: ``id, text``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for start in range(0, big.num_rows, 512):
                b = big.slice(start, 512)
                sets = [shingles(t, words) for t in b.column(1).to_pylist()]
                keys = [prefix(s, hot) for s in sets]
                of = np.repeat(np.arange(len(sets)), [len(k) for k, _ in keys])
                flat = np.concatenate([k for k, _ in keys]).view(np.int64) if keys else np.empty(0, np.int64)
                n, r = (np.array(x, np.int32)[of] if sets else np.empty(0, np.int32) for x in ([len(s) for s in sets], [r for _, r in keys]))
                yield pa.record_batch([pa.array(flat), b.column(0).take(pa.array(of)), pa.array(n), pa.array(r)], names=["key", "id", "n", "r"])

    return rows.mapInArrow(batches, f"key long, id {rows.schema['id'].dataType.simpleString()}, n int, r int")


def verified(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``src, dst``: the pairs (``a, b``) whose texts do share 4 of 5 shingles."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            good, last, own = [], None, None
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if own is None or s != last:
                    last, own = s, shingles(s, words)
                other = shingles(t, words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(both * DENOM >= NUMER * (len(own) + len(other) - both))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_())).rename_columns(["src", "dst"])

    one, two = (rows.select(F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("a", "s"), ("b", "t")))
    kind = rows.schema["id"].dataType.simpleString()
    return pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(batches, f"src {kind}, dst {kind}").distinct()


def parity(own: np.ndarray) -> bytes:
    """A bit for each residue of the shingles, by a power of two above twice their number: whether an odd number has it. Two sketches can't differ in more
    bits than the sets in shingles; xor of its halves is the sketch of half the size."""
    bits = max(SKETCH, 1 << int(2 * len(own)).bit_length())
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """The sketches at the size of the smallest."""
    least, out = min(len(x) for x in sketches), []
    for x in sketches:
        while len(x) > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.array(out)


def _candidates(table: pa.Table) -> pa.Table:
    """The rows of one pair of blocks that, by their sketches, can be near copies of a row of the other side with another root: ``centre, id``."""
    number = {x: i for i, x in enumerate(dict.fromkeys(table["root"].to_pylist()))}
    part, n = np.array([number[x] for x in table["root"].to_pylist()]), table["n"].to_numpy()
    sketch = folded([np.frombuffer(x, np.uint64) for x in table["own"].to_pylist()])
    other, found = np.flatnonzero(table["other"].to_numpy(zero_copy_only=False)), np.zeros(len(n), bool)
    for i in np.flatnonzero(table["first"].to_numpy(zero_copy_only=False)):
        least = np.bitwise_count(sketch[other] ^ sketch[i]).sum(1, dtype=np.int64)
        near = other[(least * (NUMER + DENOM) <= (n[other] + n[i]) * (DENOM - NUMER)) & (part[other] != part[i])]
        found[near] = True
        found[i] |= len(near) > 0
    return table.select(["centre", "id"]).filter(pa.array(found))


def _forest(table: pa.Table) -> pa.Table:
    """Links of one pair of blocks, a forest: rows of the one side against those of the other, where roots differ."""
    ids, roots = table["id"].to_pylist(), table["root"].to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table["own"].to_pylist()]
    n = np.array([len(x) for x in sets])
    number = {x: i for i, x in enumerate(dict.fromkeys(roots))}
    part = np.array([number[x] for x in roots])
    other = np.flatnonzero(table["other"].to_numpy(zero_copy_only=False))
    src, dst = [], []
    for i in np.flatnonzero(table["first"].to_numpy(zero_copy_only=False)):
        sizes = np.minimum(n[other], n[i]) * DENOM >= np.maximum(n[other], n[i]) * NUMER
        for j in other[sizes & (part[other] != part[i])]:
            if part[i] != part[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * DENOM >= NUMER * (n[i] + n[j] - both):
                    src.append(ids[i]), dst.append(ids[j])
                    part[part == part[j]] = part[i]
    kind = table.schema.field("id").type
    return pa.table({"src": pa.array(src, kind), "dst": pa.array(dst, kind)})


def packed(rows: DataFrame, words: int, pack) -> DataFrame:
    """``id, own``: of ``id, text``, what ``pack`` makes of the sorted shingles."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for start in range(0, big.num_rows, 512):
                b = big.slice(start, 512)
                yield pa.record_batch([b.column(0), pa.array([pack(shingles(t, words)) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "own"])

    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, own binary")


def met(groups: DataFrame, rows: DataFrame, words: int, pack) -> DataFrame:
    """``centre, x, y, id, n, root, first, other, own``: rows outside the centre's component, in blocks x, and all rows of a group, in blocks y of about ``CELLS`` shingles."""
    away = F.col("root") != F.col("home")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(CELLS))).cast("int")
    size = groups.groupBy("centre").agg(F.sum(F.when(away, F.col("n"))).alias("u"), F.sum("n").alias("v")).filter("u is not null")
    size = size.select("centre", blocks(F.col("u")).alias("u"), blocks(F.col("v")).alias("v"))
    dealt = groups.join(size, "centre")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    yes, no = F.lit(True), F.lit(False)
    one = dealt.filter(away).select("centre", "id", "n", "root", yes.alias("first"), no.alias("other"), deal("u").alias("x"), all_("v").alias("y"))
    two = dealt.select("centre", "id", "n", "root", no.alias("first"), yes.alias("other"), all_("u").alias("x"), deal("v").alias("y"))
    both = one.union(two).groupBy("centre", "x", "y", "id", "n", "root").agg(F.max("first").alias("first"), F.max("other").alias("other"))
    sets = packed(rows.join(groups.select(F.col("id").alias("_i")).distinct(), F.col("id") == F.col("_i"), "left_semi"), words, pack)
    return both.join(sets, "id").select("centre", "x", "y", "id", "n", "root", "first", "other", "own")


def crowded(groups: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``src, dst``: links inside the groups (``centre, id, n, root, home``: the centre's root) of several components.

    Rows outside the centre's component are compared with all of their group, in pairs of blocks; rows inside it aren't
    compared with each other, so where a centre has caught nearly all of its group, the cost is linear. Sketches come first; only rows that have a partner by
    them are compared by their shingles.
    """
    kind = rows.schema["id"].dataType.simpleString()
    some = met(groups, rows, words, parity).groupBy("centre", "x", "y").applyInArrow(_candidates, f"centre {kind}, id {kind}")
    groups = written(groups.join(some.distinct(), ["centre", "id"]))
    return met(groups, rows, words, lambda own: own.tobytes()).groupBy("centre", "x", "y").applyInArrow(_forest, f"src {kind}, dst {kind}").distinct()


def alike(n: str, m: str) -> Column:
    """Whether sets of these sizes can share enough."""
    return (F.least(n, m) * DENOM) >= (F.greatest(n, m) * NUMER)


def paired(rows: DataFrame) -> DataFrame:
    """``a, b, n, m`` for the rows of each key, which are few: each two whose sizes are alike."""
    both = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("rows"))
    both = both.select(F.explode("rows").alias("x"), "rows").select("x", F.explode("rows").alias("y")).filter("x.id < y.id")
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).filter(alike("n", "m"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after ``links`` (``src, dst``) as well."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(roots, F.col("id") == F.col("node"), "left_anti")
    roots = cut(roots.union(ends.select("id", "id")))
    edges = links
    for c in ("src", "dst"):
        edges = edges.join(roots.toDF("_n", "_r"), F.col(c) == F.col("_n")).drop(c, "_n").withColumnRenamed("_r", c)
    more = components(edges.filter("src <> dst").select("src", "dst")).toDF("_n", "_r")
    return cut(roots.join(more, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")))


def near_roots(docs: DataFrame, edges: DataFrame, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``node, root``: the components of ``edges`` (``src, dst``) and of all pairs with a Jaccard similarity of 0.8 or more.

    *Plan.* In any one order of all shingles, near copies share three of their first (a fifth of each text's, and three), so only those are
    keys. The order puts hot shingles, found in a sample of the texts, last; which they are changes the cost, not the result. Rows
    of a key with few rows are paired, and pairs that share three keys have their texts compared.

    Larger keys, cut by size into overlapping bands, are never paired. Each has a centre, the row with the fewest shingles that aren't hot, and all its rows are
    compared with that one. Where this leaves several components, rows outside the centre's are compared with all rows of
    the centre in bounded blocks, which give a forest each.
    """
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    some = prefixes(rows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), np.empty(0, np.uint64), words)
    some = some.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(f"c >= {FEW // 4}").orderBy(F.desc("c"), "key").limit(HOT)
    hot = np.sort(np.array([r.key for r in some.collect()], np.int64).view(np.uint64))
    keys = written(prefixes(rows, hot, words))
    counts = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    shared = written(keys.join(counts, "key"))

    few = paired(shared.filter(F.col("c") <= FEW))
    need = F.least(F.lit(SHARED), F.ceil(F.least("n", "m") * NUMER / DENOM))
    few = few.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(need).alias("need")).filter("c >= need").select("a", "b")
    kind = rows.schema["id"].dataType.simpleString()
    roots = joined(docs.sparkSession.createDataFrame([], f"node {kind}, root {kind}"), cut(edges.union(verified(few, rows, words))))

    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(BAND))
    bands = F.array(*[F.xxhash64("key", band + i) for i in (0, 1)])
    many = shared.filter(F.col("c") > FEW).select(F.explode(bands).alias("key"), "id", "n", "r")
    centres = many.groupBy("key").agg(F.min(F.struct("r", "id")).alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("_k"), F.col("m.id").alias("centre"))
    groups = written(many.join(centres, F.col("key") == F.col("_k")).select("centre", "id", "n").distinct())
    star = groups.filter(F.col("id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b"))
    roots = joined(roots, cut(verified(star, rows, words)))
    for of, name in (("id", "root"), ("centre", "home")):
        groups = groups.join(roots.toDF("_n", "_r"), F.col(of) == F.col("_n"), "left").withColumn(name, F.coalesce("_r", of)).drop("_n", "_r")
    return joined(roots, cut(crowded(written(groups), rows, words)))


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs``: the smallest id that links of SimHash (three words, two bits) or of five-word shingles lead to.

    *Cases.* Those of ``simhash_groups``. Texts without words share no shingles, but their fingerprint. Rows with the same id are one text's links: both go where either leads. Null ids: SimHash's component.
    """
    by = cut(simhash_groups(docs, text=text, key=key).select("doc_id", "component_id"))
    edges = by.filter("doc_id <> component_id").select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst"))
    roots = near_roots(docs, edges, text=text, key=key)
    return by.join(roots, F.col("component_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))
