"""SimHash near-dedup with an anchor-point covering of the fingerprint space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

SHIFT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are summed at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for no words."""
    from xxhash import xxh64_intdigest

    if not text or not (own := text.encode().translate(SHIFT).split()):  # bytes.split() knows exactly [\x20\x09-\x0D]
        return 0
    joined = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(own) - words + 1)
    spans = zip(start[:n].tolist(), (end[words - 1 :] if len(own) >= words else end[-1:]).tolist(), strict=True)
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    ones = sum(np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, n, CHUNK))
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fp`` (signed) for each row of ``docs``, in one pass."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.record_batch([b.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, f"doc_id {docs.schema[key].dataType.simpleString()}, fp long")


def anchors(fp: str) -> Column:
    """The anchors to which a fingerprint is dealt.

    The covering code is the perfect Hamming code of length 63 on bits 0 to 62, with bit 63
    free: every point is within 1 of just one code word. Two fingerprints at distance 2 or
    less have a point within 1 of both, and that point's code word is within 2 of both; so each goes
    to the code words of all points within 1 of it. That is the covering radius plus half the
    threshold on either side, 33 anchors (2 for a code word), where radius plus threshold on one side would
    need 683. An anchor gets at most 1 + 63 + 1953 + 64 different fingerprints, by geometry.

    ``s``, the syndrome, is the position (from 1) of the bit that leads to the nearest code
    word, 0 for a code word; flipping i and i ^ s leads to the others.
    """
    parity = " | ".join(f"shiftleft(bit_count({fp} & {mask}L) & 1, {j})" for j, mask in enumerate(_masks()))
    home = f"if(s = 0, {fp}, {fp} ^ shiftleft(1L, s - 1))"
    more = f"transform(filter(sequence(1, 63), i -> s > 0 and i < (i ^ s)), i -> {fp} ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))"
    whole = f"concat(array({home}, {home} ^ shiftleft(1L, 63)), {more})"
    return F.expr(f"flatten(transform(array({parity}), s -> {whole}))")


def _masks() -> list[int]:
    """For each of the 6 check bits, the positions from 1 to 63 whose number has it."""
    return [sum(1 << (i - 1) for i in range(1, 64) if i >> j & 1) for j in range(6)]


def bucket_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links from each fingerprint to the least of its component within the bucket; never all pairs."""
    fps = np.unique(fps)
    left, out = np.ones(len(fps), bool), []
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i], todo = False, [i]
        while todo:
            near = np.flatnonzero(left & (np.bitwise_count((fps ^ fps[todo.pop()]).view(np.uint64)) <= distance))
            left[near] = False
            todo += near.tolist()
            out += [(int(fps[j]), int(fps[i])) for j in near]
    return out


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """``src, dst``: links that join the same fingerprints as all pairs at ``distance`` or less would. ``fps``: distinct ``fp``."""
    if not 0 <= distance <= 2:
        raise ValueError("this covering serves distances 0 to 2")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            offsets, flat = b.column(0).offsets.to_numpy(), b.column(0).values.to_numpy()
            pairs = [p for i, j in zip(offsets[:-1], offsets[1:], strict=True) for p in bucket_links(flat[i:j], distance)]
            yield pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    dealt = fps.select("fp", F.explode(anchors("fp")).alias("anchor"))
    met = dealt.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return met.select("fps").mapInArrow(batches, "src long, dst long").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, distance: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``: the smallest id reachable over links of ``distance`` bits or less.

    *Plan.* One pass makes fingerprints, which are kept. Rows with the same fingerprint become one class by a
    partial aggregate; only distinct fingerprints are dealt to anchors (33 rows of two longs
    each) and compared per anchor, where a bucket's size is bounded by geometry. Each bucket
    gives a spanning forest, not its pairs. Components come from star contraction, distributed.

    *Cases.* Null or empty text or white space only: fingerprint 0, linked like any other. Texts shorter than
    ``words``: one shingle, the whole sequence. Empty table: no rows. Repeated rows: same fingerprint, so
    one class. Null ids count in classes but name none. Other columns are ignored.
    """
    fps = cut(fingerprints(docs, words, text, key))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), distance))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "root").select(F.col("fp").alias("f"), "component_id")
    return fps.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")
