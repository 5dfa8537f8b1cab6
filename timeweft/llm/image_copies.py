"""Media columns: local descriptors find cropped and edited copies of pictures."""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import components

SCALES = (1.0, 0.8, 0.64)
#: A corner is the strongest place within so many pixels along either axis, at each scale: their number grows with the area.
SPACING = 6
RADIUS = 9
TURNS = 24
#: Tables of keys; each has 64 of a descriptor's 192 bits, so descriptors that differ in fewer bits than there are tables meet.
TABLES = 3
#: Bits of the next table's 64 in which two descriptors that agree on a key may differ.
DISTANCE = 12
#: A corner as workers hand it on.
CORNER = np.dtype([("near", "<u4"), ("far", "u1"), ("bits", "<i8", (TABLES,))])
#: Pixels, and corners, that are worked on together.
PIXELS = 1 << 19
CORNERS = 1 << 12
#: Pictures looked at together.
TOGETHER = 128
_HEAD = re.compile(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s")


def _tests() -> np.ndarray:
    """For each turn, 192 pairs of points within the patch: turns x 192 x 2 points x (y, x)."""
    rng = np.random.default_rng(20_090_501)
    base = np.clip(rng.normal(0, RADIUS / 2.2, (64 * TABLES, 2, 2)), -RADIUS / 1.45, RADIUS / 1.45)
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(angle), np.sin(angle)], -1), np.stack([-np.sin(angle), np.cos(angle)], -1)], 1)
    return np.rint(np.einsum("tij,npj->tnpi", turn, base)).astype(np.int32)


TESTS = _tests()


def decode_picture(data: bytes | None) -> np.ndarray | None:
    """A grey picture from PGM, PPM or PNG (8 bits, not interlaced); None for what can't be read."""
    if not data:
        return None
    try:
        if m := _HEAD.match(data):
            depth, w, h = (1 if m[1] == b"5" else 3), int(m[2]), int(m[3])
            pixels = np.frombuffer(data, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            pixels = _png(data)
        else:
            return None
    except (ValueError, zlib.error, struct.error, KeyError):
        return None
    return pixels[..., 0].astype(np.float32) if pixels.shape[2] < 3 else (pixels[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)).astype(np.float32)


def _png(data: bytes) -> np.ndarray:
    at, body, shape = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, bits, colour, _, _, lace = struct.unpack(">IIBBBBB", part)
            if bits != 8 or lace:
                raise ValueError("only 8 bits without interlace")
            shape = (h, w, {0: 1, 2: 3, 4: 2, 6: 4}[colour])
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    h, w, d = shape
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * d)
    out = np.zeros((h + 1, w * d), np.int64)
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), out[y]
        if kind in (0, 2):
            out[y + 1] = line + (up if kind else 0)
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(w, d), 0).ravel()
        else:
            for x in range(w * d):
                a, b, c = (out[y + 1, x - d], up[x], up[x - d]) if x >= d else (0, up[x], 0)
                p = a + b - c
                near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                out[y + 1, x] = line[x] + ((a + b) // 2 if kind == 3 else near) & 255
        out[y + 1] &= 255
    return out[1:].astype(np.uint8).reshape(h, w, d)


def _resized(stack: np.ndarray, scale: float) -> np.ndarray:
    """Linear interpolation along both axes, as two matrix products."""

    def weights(n: int) -> np.ndarray:
        m = max(1, round(n * scale))
        at = np.clip((np.arange(m) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        out = np.zeros((m, n), np.float32)
        out[np.arange(m), low] += 1 - (at - low)
        out[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
        return out

    return stack if scale == 1 else weights(stack.shape[1]) @ stack @ weights(stack.shape[2]).T


def _smooth(stack: np.ndarray) -> np.ndarray:
    """Binomial weights of five along either axis; edges repeat."""
    for axis in (-2, -1):
        p = np.pad(stack, [(2, 2) if i == stack.ndim + axis else (0, 0) for i in range(stack.ndim)], mode="edge")
        n = stack.shape[axis]
        part = [p[..., i : i + n, :] if axis == -2 else p[..., i : i + n] for i in range(5)]
        stack = part[2] * 0.375
        stack += (part[1] + part[3]) * 0.25
        stack += (part[0] + part[4]) * 0.0625
    return stack


def _highest(stack: np.ndarray, reach: int) -> np.ndarray:
    """The largest value within ``reach`` places along either axis."""
    for axis in (1, 2):
        n = stack.shape[axis]
        held = np.pad(stack, [(0, 0)] + [(reach, reach) if i == axis else (0, 0) for i in (1, 2)], constant_values=-np.inf)
        width, wanted = 1, 2 * reach + 1
        while width < wanted:
            step = min(width, wanted - width)
            size = held.shape[axis] - step
            held = np.maximum(held.take(range(size), axis), held.take(range(step, step + size), axis))
            width += step
        stack = held.take(range(n), axis)
    return stack


def features(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each scale: which picture, ``(x, y, turn, scale)`` in the picture's own pixels, and 64 bits for each table.

    A corner is a place whose Harris response is the largest around it (``SPACING``). That asks nothing of the rest
    of the picture, so a crop keeps the corners of its part, and no number of corners is set. A corner's turn is the
    direction of its patch's centre of brightness; the tests that make the bits turn with it. The
    patch's slope is taken out first: it would decide most tests alike in all patches.
    """
    out = []
    span = np.arange(-RADIUS, RADIUS + 1)
    disc = (span[:, None] ** 2 + span**2 <= RADIUS**2).astype(np.float32)
    even = float((span**2 * disc).sum())
    for number, scale in enumerate(SCALES):
        img = _smooth(_resized(stack, scale))
        _, h, w = img.shape
        edge = RADIUS + 1
        if h <= 2 * edge + 1 or w <= 2 * edge + 1:
            continue
        dy, dx = np.zeros_like(img), np.zeros_like(img)
        dy[:, 1:-1], dx[:, :, 1:-1] = img[:, 2:] - img[:, :-2], img[:, :, 2:] - img[:, :, :-2]
        xx, yy, xy = _smooth(np.stack([dx * dx, dy * dy, dx * dy]))
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        core = strength[:, edge:-edge, edge:-edge]
        all_which, all_y, all_x = np.nonzero((core == _highest(core, SPACING)) & (core > 1.0))
        for start in range(0, len(all_which), CORNERS):
            which, y, x = (v[start : start + CORNERS] for v in (all_which, all_y + edge, all_x + edge))
            patch = img[which[:, None, None], y[:, None, None] + span[:, None], x[:, None, None] + span] * disc
            slope_y, slope_x = (patch * span[:, None]).sum((1, 2)), (patch * span).sum((1, 2))
            turn = np.rint(np.arctan2(slope_y, slope_x) / (2 * np.pi) * TURNS).astype(int) % TURNS
            at = TESTS[turn]
            value = img[which[:, None, None], y[:, None, None] + at[..., 0], x[:, None, None] + at[..., 1]]
            value = value - (slope_y / even)[:, None, None] * at[..., 0] - (slope_x / even)[:, None, None] * at[..., 1]
            bits = np.packbits(value[..., 0] < value[..., 1], axis=1).view(np.int64)
            where = np.stack([(x + 0.5) / scale - 0.5, (y + 0.5) / scale - 0.5, turn, np.full(len(x), number)], 1)
            out.append((which, where, bits))
    return out


def _parts(rows: list, size: int) -> list[list]:
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def descriptors(media: DataFrame, picture: str = "image", key: str = "image_id") -> DataFrame:
    """``image_id, digest, found`` for each row of ``media``, in one pass over the pictures.

    ``digest`` is 128 bits of the bytes' SHA-256 (null for none), ``found`` holds a ``CORNER`` for each corner: its place in 39 bits (x and y
    in 16 each, turn in 5, scale in 2) and the bits for each table.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for big in it:
            for start in range(0, big.num_rows, TOGETHER):
                b = big.slice(start, TOGETHER)
                pictures = b.column(1).to_pylist()
                shapes = defaultdict(list)
                for i, data in enumerate(pictures):
                    if (img := decode_picture(data)) is not None:
                        shapes[img.shape].append((i, img))
                own = [b"" for _ in pictures]
                for held in (part for (h, w), same in shapes.items() for part in _parts(same, max(1, PIXELS // (h * w)))):
                    for which, where, bits in features(np.stack([img for _, img in held])):
                        x, y = (np.clip(np.rint(where[:, i]), 0, 65535).astype(np.int64) for i in (0, 1))
                        geo = x << 23 | y << 7 | where[:, 2].astype(np.int64) << 2 | where[:, 3].astype(np.int64)
                        table = np.empty(len(geo), CORNER)
                        table["near"], table["far"], table["bits"] = geo & 0xFFFFFFFF, geo >> 32, bits
                        for n in np.unique(which):
                            own[held[n][0]] += table[which == n].tobytes()
                digest = pa.array([sha256(d).digest()[:16] if d else None for d in pictures], pa.binary())
                yield pa.record_batch([b.column(0), digest, pa.array(own, pa.binary())], names=["image_id", "digest", "found"])

    rows = media.select(F.col(key).cast("long").alias("image_id"), F.col(picture).alias("image"))
    return rows.mapInArrow(batches, "image_id long, digest binary, found binary")


def table_keys(found: DataFrame) -> DataFrame:
    """``image_id, key, rest, geo``: each corner once for each table, by 64 of its bits and the table's number; ``rest`` is the next table's bits.

    ``geo`` is last, so its empty bytes meet those at the head of the next row and the codec of the shuffle takes both as one.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in it:
            parts = [np.frombuffer(x or b"", CORNER) for x in b.column(1).to_pylist()]
            ids = np.repeat(np.array(b.column(0).to_pylist(), np.int64), [len(p) for p in parts])
            rows = np.concatenate(parts) if parts else np.empty(0, CORNER)
            bits = np.ascontiguousarray(rows["bits"])
            keys = (bits.view(np.uint64) ^ mark).reshape(-1).view(np.int64)
            rest = np.roll(bits, -1, axis=1).reshape(-1)
            geo = np.repeat(rows["near"].astype(np.int64) | rows["far"].astype(np.int64) << 32, TABLES)
            yield pa.record_batch([pa.array(np.repeat(ids, TABLES)), pa.array(keys), pa.array(rest), pa.array(geo)], names=["image_id", "key", "rest", "geo"])

    return found.select("image_id", "found").mapInArrow(batches, "image_id long, key long, rest long, geo long")


def _close(one: str, other: str) -> Column:
    return F.bit_count(F.col(one).bitwiseXOR(F.col(other))) <= DISTANCE


def meetings(rows: DataFrame, near: int) -> DataFrame:
    """``key, a, ga, b, gb, rest``: descriptors that agree on a key and are close. ``rows``: ``image_id, key, rest, geo``.

    In a key of up to ``near`` rows each meets all others. In a crowded one each meets the ``near`` before it, in the order of pictures,
    and the first; its rows come as well, with neither ``a`` nor ``ga``, for ``crowded_meetings``.
    """
    by = Window.partitionBy("key").orderBy("image_id", "geo")
    one = F.struct("image_id", "geo", "rest")
    met = rows.withColumn("near", F.collect_list(one).over(by.rowsBetween(-near, -1))).withColumn("first", F.first(one).over(by))
    met = met.withColumn("around", F.count(F.lit(1)).over(by.rowsBetween(-near, near))).filter("around > 1")
    itself = F.when(F.col("around") > near, F.array(F.lit(None).cast("struct<image_id:bigint,geo:bigint,rest:bigint>")))
    partners = F.array_distinct(F.concat("near", F.array("first"), F.coalesce(itself, F.array())))
    met = met.select("key", F.col("image_id").alias("b"), F.col("geo").alias("gb"), "rest", F.explode(partners).alias("o"))
    met = met.select("key", F.col("o.image_id").alias("a"), F.col("o.geo").alias("ga"), "b", "gb", "rest", F.col("o.rest").alias("rest_a"))
    return met.filter(F.col("a").isNull() | (F.col("a") < F.col("b")) & _close("rest", "rest_a")).drop("rest_a")


def crowded_meetings(rows: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """``a, ga, b, gb``: all close descriptors of crowded keys (``key, b, gb, rest``) whose pictures aren't in one class of ``roots`` yet.

    Keys with one class only have nothing to add. The others' rows are cut into blocks of about ``block`` by a hash, and every
    block meets every other of its key: an equi-join on key and both blocks, so no task sees a whole key. What it reads grows with the rows
    of a key times its blocks; what it gives is only what is close and not yet joined.
    """
    own = rows.join(roots, F.col("b") == F.col("node"), "left").select("key", "b", "gb", "rest", F.coalesce("root", "b").alias("class"))
    open_keys = own.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    open_keys = open_keys.select(F.col("key").alias("k"), F.ceil(F.col("n") / block).alias("blocks"))
    own = cut(own.join(open_keys, F.col("key") == F.col("k")).withColumn("at", F.pmod(F.xxhash64("b", "gb"), F.col("blocks"))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = own.select("key", F.col("at").alias("i"), every.alias("j"), F.col("b").alias("a"), F.col("gb").alias("ga"), F.col("rest").alias("rest_a"), F.col("class").alias("class_a"))
    right = own.select("key", every.alias("i"), F.col("at").alias("j"), "b", "gb", "rest", "class")
    met = left.join(right, ["key", "i", "j"]).filter((F.col("a") < F.col("b")) & (F.col("class") != F.col("class_a")) & _close("rest", "rest_a"))
    return met.select("a", "ga", "b", "gb")


def agreed(met: DataFrame, least: int, step: float = 6.0) -> DataFrame:
    """``src, dst``: pictures of which ``least`` corners or more agree on one turn, scale and shift. ``met``: ``a, ga, b, gb``.

    Each meeting votes for the shift that its turn and scale imply, in two grids half a step apart along either axis. Meetings are
    shuffled once, by the two pictures; votes are made and counted where they are.
    """

    def part(g: str, shift: int, bits: int) -> Column:
        return F.shiftright(g, shift).bitwiseAND(2**bits - 1)

    scales = F.array(*[F.lit(s) for s in SCALES])
    turn = F.pmod(part("gb", 2, 5) - part("ga", 2, 5), F.lit(TURNS))
    ratio = F.element_at(scales, (part("ga", 0, 2) + 1).cast("int")) / F.element_at(scales, (part("gb", 0, 2) + 1).cast("int"))
    angle = turn * F.lit(2 * np.pi / TURNS)
    ax, ay, bx, by_ = part("ga", 23, 16), part("ga", 7, 16), part("gb", 23, 16), part("gb", 7, 16)
    met = met.select("a", "ga", "b", "gb").repartition("a", "b")
    met = met.withColumn("sx", bx - ratio * (F.cos(angle) * ax - F.sin(angle) * ay)).withColumn("sy", by_ - ratio * (F.sin(angle) * ax + F.cos(angle) * ay))
    met = met.withColumn("turn", turn).withColumn("level", part("gb", 0, 2) - part("ga", 0, 2))
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), F.floor((F.col("sx") + i % 2 * step / 2) / step).alias("x"), F.floor((F.col("sy") + i // 2 * step / 2) / step).alias("y")) for i in range(4)])
    votes = met.select("a", "b", "ga", "turn", "level", F.explode(grids).alias("g")).select("a", "b", "turn", "level", "g.*", "ga").distinct()
    counted = votes.groupBy("a", "b", "turn", "level", "grid", "x", "y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counted.select(F.col("b").alias("src"), F.col("a").alias("dst")).distinct()


def links(rows: DataFrame, near: int = 10, least: int = 3, block: int = 256) -> DataFrame:
    """``src, dst``: links that join all pictures that any agreeing ones join. ``rows``: ``image_id, key, rest, geo``.

    Two pictures are joined here, perhaps over others, if and only if comparing all pairs of descriptors that agree on a key would join
    them: keys of up to ``near`` rows are compared in full, crowded ones with neighbours first, and then in full between the classes that are still apart.
    """
    met = cut(meetings(rows, near))
    pairs, crowded = met.filter(F.col("a").isNotNull()), met.filter(F.col("a").isNull()).select("key", "b", "gb", "rest")
    edges = cut(agreed(pairs, least))
    if crowded.isEmpty():
        return edges
    more = crowded_meetings(crowded, components(edges), block)
    return cut(edges.union(agreed(pairs.select("a", "ga", "b", "gb").union(more), least)).distinct())


def copy_classes(media: DataFrame, picture: str = "image", key: str = "image_id", least: int = 3) -> DataFrame:
    """``image_id, class_id, class_size`` for each row of ``media``: class_id is the smallest id that copies lead to, class_size the rows that have it.

    *Plan.* A first pass leaves ids and digests, which are kept. A second one describes the pictures; equal bytes are one class (a partial
    aggregate on the digest), and only its smallest id goes on, with the descriptors of one of them. The descriptors' keys are the one large
    shuffle; links and classes are small and go through star contraction.

    *Cases.* Null, empty or unreadable pictures: a class of their own each, or with those of equal bytes. Pictures too
    small or plain for corners: the same. Empty table: no rows. Rows with the same id: one result each. Ids must be integers; null ids
    have a null class of size 1. Other columns are ignored.
    """
    digest = F.when(F.octet_length(F.col(picture)) > 0, F.substring(F.unhex(F.sha2(F.col(picture), 256)), 1, 16))
    narrow = cut(media.select(F.col(key).cast("long").alias("image_id"), digest.alias("digest")))
    described = descriptors(media, picture, key).filter(F.col("digest").isNotNull())
    firsts = described.groupBy("digest").agg(F.min("image_id").alias("image_id"), F.first("found").alias("found"))
    keys = table_keys(firsts.filter(F.col("image_id").isNotNull()))
    roots = components(links(keys, least=least))
    heads = narrow.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("image_id").alias("head")).withColumnRenamed("digest", "d")
    out = narrow.join(heads, F.col("digest") == F.col("d"), "left").select("image_id", F.coalesce("head", "image_id").alias("head"))
    out = out.join(roots, F.col("head") == F.col("node"), "left").select("image_id", F.coalesce("root", "head").alias("class_id"))
    sizes = out.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).withColumnRenamed("class_id", "c")
    return out.join(sizes, F.col("class_id") == F.col("c"), "left").select("image_id", "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def _spread(n: int, side: int) -> np.ndarray:
    """Linear interpolation of n values over side pixels, as a matrix."""
    at = np.linspace(0, n - 1, side)
    low = np.minimum(at.astype(int), n - 2)
    out = np.zeros((side, n), np.float32)
    out[np.arange(side), low], out[np.arange(side), low + 1] = 1 - (at - low), at - low
    return out


SIDE = 64
_COARSE, _FINE = _spread(9, SIDE), _spread(24, SIDE)


def draw(number: int) -> np.ndarray:
    """A picture of its own for each number: grain of two sizes, as in photographs, and one box."""
    rng = np.random.default_rng([77, number])
    img = _COARSE @ rng.uniform(40, 200, (9, 9)).astype(np.float32) @ _COARSE.T + _FINE @ rng.uniform(-45, 45, (24, 24)).astype(np.float32) @ _FINE.T
    for y, x, h, w, grey in rng.integers([0, 0, 4, 4, 0], [58, 58, 16, 16, 256], (1, 5)).tolist():
        img[y : y + h, x : x + w] = grey
    return img


def page_picture(number: int, kind: int = -1) -> bytes:
    """The picture of a page as PGM. Of eight pages in a row the last shows an edited copy of the first: a crop, other brightness, a box over it, or noise."""
    img = draw(number - 7 if number % 8 == 7 else number)
    if number % 8 == 7:
        edit = kind if kind >= 0 else number // 8 % 4
        if edit == 0:
            img = img[10:58, 6:60]
        elif edit == 1:
            img = img * 0.7 + 30
        elif edit == 2:
            img = img.copy()
            img[40:, 36:] = 128
        else:
            img = img + np.random.default_rng([78, number]).normal(0, 2, img.shape)
    img = np.clip(np.rint(img), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (img.shape[1], img.shape[0]) + img.tobytes()


def page_pictures(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``image_id, image``: the tables hold no pictures, so one is drawn for each page.

    *Cases.* Null ids: a null picture. Rows with the same id: the same picture. Empty table: no rows. Other columns are ignored.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for start in range(0, big.num_rows, TOGETHER):
                ids = big.column(0).slice(start, TOGETHER)
                yield pa.record_batch([ids, pa.array([None if i is None else page_picture(i) for i in ids.to_pylist()], pa.binary())], names=["image_id", "image"])

    return pages.select(F.col(key).cast("long").alias("image_id")).mapInArrow(batches, "image_id long, image binary")
