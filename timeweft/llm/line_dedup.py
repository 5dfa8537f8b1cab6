"""Line dedup: lines that many documents share go, except in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, cut, text_key


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def line_hash(key: Column) -> tuple[Column, Column]:
    """128 bits: two XXH64 of the key from different seeds."""
    return F.xxhash64(key), F.xxhash64(F.lit("line"), key)


def drop_common_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_points: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs``' ids with ``lines`` (all), ``dropped`` (their positions from 0) and ``kept_text``.

    A line's key is the line without white space at its ends and with A-Z in lower case. A key
    of ``min_points`` code points or more that ``min_docs`` documents hold loses all its lines
    except those of the largest id that holds it.

    *Plan.* Documents give each of their long keys once (distinct inside the row, before any
    shuffle, then by id and key, so repeated rows count once); a hash aggregate with fixed-width buffers counts
    documents and finds the largest id, so after that a key in a third of all documents is one row for each partition.
    Only keys over the limit, kept as a table of their own, meet the lines again, hashes and positions only, in a
    join that has a shuffle on either side and so can be split at a hot key; the dropped positions then come back to their document, where a hash-based ``array_except`` picks the
    lines that stay, in order.

    *Cases.* Null or empty text: one empty line, which stays. Empty table: no rows. Rows with
    the same id are one document when documents are counted, whatever their texts; each is reassembled by itself (id and 128 bits of its text tell rows
    apart). Very long texts are one row of positions. Rows without an id are documents of their own (equal texts are one) and rank below
    all others; a key that only such rows hold stays in all of them. Other columns of ``docs`` are ignored.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    ids = docs.select(F.col(key).alias("doc_id"), *text_key(F.col(text)), lines.alias("lines"))
    alone = F.when(F.col("doc_id").isNull(), F.col("h1")).alias("alone")

    def hashes(line: Column) -> Column:
        return F.struct(*(h.alias(n) for h, n in zip(line_hash(line), "ab", strict=True)))

    long = F.filter(F.transform("lines", line_key), lambda k: F.char_length(k) >= min_points)
    own = ids.select("doc_id", alone, F.explode(F.array_distinct(F.transform(long, hashes))).alias("h")).select("doc_id", "alone", "h.a", "h.b").distinct()
    common = own.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("stays")).filter(F.col("n") >= min_docs)
    common = cut(common.select("a", "b", "stays"))
    placed = ids.select("doc_id", "h1", "h2", F.posexplode("lines").alias("at", "line")).withColumn("k", line_key(F.col("line"))).filter(F.char_length("k") >= min_points)
    a, b = line_hash(F.col("k"))
    placed = placed.select("doc_id", "h1", "h2", "at", a.alias("a"), b.alias("b"))
    goes = placed.join(common, ["a", "b"]).filter(~F.col("doc_id").eqNullSafe(F.col("stays")))
    goes = goes.groupBy(F.col("doc_id").alias("d"), F.col("h1").alias("d1"), F.col("h2").alias("d2")).agg(F.array_sort(F.collect_set("at")).alias("at"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h1") == F.col("d1")) & (F.col("h2") == F.col("d2"))
    out = ids.join(goes, same, "left").withColumn("dropped", F.coalesce("at", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    text_kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return out.select("doc_id", "lines", "dropped", text_kept.alias("kept_text"))
