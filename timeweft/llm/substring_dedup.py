"""Substring dedup by lines and their clauses: a passage that came before, in any document, goes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SHIFT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A unit: up to a line's end or one of ``.!?;,``, with the white space and marks that follow. Units make up the whole text.
UNIT = "[^.!?;,\n]*[.!?;,\n][.!?;, \t\n\x0b\x0c\r]*|[^.!?;,\n]+$"
#: Documents in one batch of Python objects.
BATCH = 256
#: The rank of a row without an id.
LAST_ID = 2**63 - 1
_UNIT = re.compile(UNIT)
def split_units(text: str | None) -> list[str]:
    return _UNIT.findall(text or "")


def normal(unit: str) -> bytes:
    """A-Z in lower case, white space runs as one blank, none at the ends."""
    return b" ".join(unit.encode().translate(SHIFT).split())


def marks(rows: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, h, code, a, b``: 96-bit digests. Code ``2 i + 1`` is of unit i with the one after it, ``2 i`` of unit i alone if it has ``min_words``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for b in (big.slice(i, BATCH) for big in it for i in range(0, big.num_rows, BATCH)):
            of, code, one, two = [], [], [], []
            for n, text in enumerate(b.column(2).to_pylist()):
                for k, unit in numbered([normal(u) for u in split_units(text)], min_words):
                    h = xxh3_128_intdigest(unit)
                    of.append(n), code.append(k), one.append((h >> 64) - 2**63), two.append((h & 2**32 - 1) - 2**31)
            at = pa.array(of, pa.int32())
            cols = [b.column(i).take(at) for i in range(2)] + [pa.array(code, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int32())]
            yield pa.record_batch(cols, names=["doc_id", "h", "code", "a", "b"])

    return rows.select("doc_id", "h", "text").mapInArrow(batches, "doc_id long, h long, code int, a long, b int")


def numbered(units: list[bytes], min_words: int) -> Iterator[tuple[int, bytes]]:
    """Units of ``min_words`` and neighbours, by code."""
    yield from ((2 * i, u) for i, u in enumerate(units) if u.count(b" ") + 1 >= min_words)
    yield from ((2 * i + 1, u + b"\n" + v) for i, (u, v) in enumerate(zip(units, units[1:], strict=False)))


def runs(units: list[bytes], again: dict[int, int | None], min_words: int) -> list[tuple[int, int, int | None]]:
    """``(from, to, kept_in)``: the runs of units that are repeated as they follow each other and have ``min_words`` together."""
    out, i = [], 0
    while i < len(units):
        j = i
        while 2 * j + 1 in again:
            j += 1
        if (j > i and sum(len(u.split()) for u in units[i : j + 1]) >= min_words) or (j == i and 2 * i in again):
            out.append((i, j + 1, again[2 * i + 1 if j > i else 2 * i]))
        i = j + 1
    return out


def _cleaned(min_words: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("kept_in", pa.int64())])
        for b in (big.slice(i, BATCH) for big in it for i in range(0, big.num_rows, BATCH)):
            removed, kept = [], []
            for own, text, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                text, spans, rest, done = text or "", [], [], 0
                units = split_units(text)
                norm, again, seen = [normal(u) for u in units], {m["code"]: m["kept_in"] for m in found or ()}, set()
                for code, unit in sorted(numbered(norm, min_words)):  # what came before in the text itself
                    if unit in seen:
                        again.setdefault(code, own)
                    seen.add(unit)
                if again:
                    ends = [0]
                    for u in units:
                        ends.append(ends[-1] + len(u))
                    for i, j, keeper in runs(norm, again, min_words):
                        spans.append({"start": ends[i], "stop": ends[j], "words": sum(len(u.split()) for u in norm[i:j]), "kept_in": keeper})
                        rest.append(text[done : ends[i]])
                        done = ends[j]
                removed.append(spans)
                kept.append("".join(rest) + text[done:])
            yield pa.record_batch([b.column(0), pa.array(removed, pa.list_(span)), pa.array(kept, pa.string())], names=["doc_id", "removed", "kept_text"])

    return batches


def drop_repeated_passages(docs: DataFrame, min_words: int = 30, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row of ``docs``: ``doc_id, removed, kept_text``.

    Units are lines, cut after ``.!?;,`` as well, so that a passage in the middle of a line is seen. A unit and the one after
    it count as repeated when the same two (A-Z in lower case, white space runs as one blank) followed each other before, in the order of ids and then of
    places. Runs of repeated neighbours that have ``min_words`` words together, and single units of that length that occurred before, are removed;
    all else stays. ``removed`` has for each run its span of code points in the original text, its words, and the id of the document
    that keeps its beginning.

    *Plan.* One pass leaves digests, no text. A hash aggregate counts each digest and finds its
    least id, before and after the shuffle, so a passage that fills a third of all documents is one row for each split. Digests of several
    documents are kept as a table of their own, so that the join which brings them back has a shuffle on either side and can be split
    at a hot digest. They go back to their row by its id and text's hash, where the text is cut and what it repeats of its own is found. Digests are
    made twice, which costs less than keeping them.

    *Cases.* Null or empty text: empty, nothing removed. Empty table: no rows. Ids must be integers. Rows with the same id have the same
    rank, so none of them removes what another one holds; they are told apart by their text, and equal rows get equal results. Null ids come after all others, and are
    one rank too. Very long lines are cut like others, or one unit. Other columns are ignored.
    """
    # The id and 32 bits of the text tell rows apart; without an id it takes 64.
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.when(F.col(key).isNull(), h).otherwise(F.shiftright(h, 32)).alias("h"), F.col(text).alias("text"))
    rank = F.coalesce("doc_id", F.lit(LAST_ID))
    found = marks(rows, min_words)
    first = found.groupBy("a", "b").agg(F.min(rank).alias("least"), F.max(rank).alias("most")).filter("least < most")
    first = cut(first.select("a", "b", "least"))
    again = found.join(first, ["a", "b"]).filter(rank > F.col("least"))
    again = again.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("code", F.col("least").alias("kept_in"))).alias("again"))
    out = rows.join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", "again")
    return out.mapInArrow(_cleaned(min_words), "doc_id long, removed array<struct<start:int,stop:int,words:int,kept_in:bigint>>, kept_text string")
