"""Exact dedup: a 128-bit content hash makes groups, bytes decide inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import squeezed


LAST_ID = 2**63 - 1


def content_hash(digest: Column) -> Column:
    """The first 128 bits of a SHA-256."""
    return F.substring(digest, 1, 16)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", hashed=content_hash) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same after deleting white space. Of equal texts the row
    with the most code points stays, then the one with the smallest id.

    *Plan.* Texts are grouped by ``(hash, bytes)``: Spark's hash aggregate sends equal texts to
    one place by hash and compares the bytes of those that meet, so a collision stays two
    groups. The partial aggregate leaves one row for each distinct text and input split, which
    takes the heat out of a group of any size. Members find their group in a join that adaptive execution can split.

    *Cases.* Null text: equal to the empty text. Empty table: no rows. Rows with the same id
    and text: each gets its row and counts in ``group_size``; all of them are ``kept`` if the
    id is. Null ids rank last. Other columns of ``docs`` are ignored, whatever their names.
    """
    step = F.lit(str(2**64)).cast("decimal(20,0)")
    norm = squeezed(F.col(text))
    rows = docs.select(F.col(key).alias("doc_id"), norm.alias("_norm"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_points"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2("_norm", 256))).withColumn("_hash", hashed(F.col("_sha")))
    # One fixed-width maximum finds the longest text and, among those, the least id: points * 2**64 - id.
    least = F.coalesce("doc_id", F.lit(LAST_ID)).cast("decimal(20,0)")
    rows = rows.withColumn("_best", (F.col("_points").cast("decimal(10,0)") * step - least))
    groups = rows.groupBy("_hash", "_norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("_points").alias("points"), F.max("_best").alias("best"))
    keep = (F.col("points").cast("decimal(10,0)") * step - F.col("best")).cast("long")
    groups = groups.select(F.unhex(F.sha2("_norm", 256)).alias("g_sha"), "group_size", F.nullif(keep, F.lit(LAST_ID)).alias("keep_id"))
    joined = rows.select("doc_id", "_sha").join(groups, F.col("_sha") == F.col("g_sha"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
