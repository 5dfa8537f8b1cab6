"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table
from .exact_dedup import exact_dedup
from .image_copies import copy_classes, page_pictures
from .language_id import document_evidence, fit, identify, known, page_evidence
from .line_dedup import drop_common_lines
from .mixing import mix
from .sentencepiece_lattice import encode, load
from .sharding import shard_documents
from .simhash import simhash_groups
from .substring_dedup import drop_repeated_passages
from .token_count import count_tokens


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(documents(spark, sf_dir), load("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "restored")


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_classes(page_pictures(table(spark, sf_dir, "pages"))).withColumnRenamed("image_id", "page_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, c.stays IS NOT NULL AND c.stays <> k.doc_id AS goes
  FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (goes) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by text, declared language and source, and all pages, by visible text, markup and address; the other's id is null."""
    docs = documents(spark, sf_dir)
    model, none = fit(docs), F.lit(None).cast("long")
    rows, options = page_evidence(table(spark, sf_dir, "pages"))
    pages = identify(rows, model, **options).select(none.alias("doc_id"), F.col("id").alias("page_id"), "*").drop("id")
    texts = identify(document_evidence(docs), model).select(F.col("id").alias("doc_id"), none.alias("page_id"), "*").drop("id")
    return texts.unionByName(pages).withColumn("kept", known(F.col("language"), F.col("confidence")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was removed: its words, its spans of code points with the id that keeps each, and the text that is left."""
    out = drop_repeated_passages(documents(spark, sf_dir))
    spans = F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["stop"], r["kept_in"]))
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["words"])
    return out.select("doc_id", words.alias("removed_words"), F.array_join(spans, ";").alias("removed_spans"), "kept_text")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?;,\n]*[.!?;,\n][.!?;, \t\n\x0b\x0c\r]*|[^.!?;,\n]+$') AS units
  FROM documents),
u AS (SELECT doc_id, unnest(units) AS unit, unnest(range(len(units))) AS pos FROM d),
k AS (
  SELECT *, translate(trim(regexp_replace(unit, '[ \t\n\x0b\x0c\r]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
         CAST(sum(length(unit)) OVER w AS BIGINT) - length(unit) AS start
  FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p AS (
  SELECT *, CASE WHEN key = '' THEN 0 ELSE len(string_split(key, ' ')) END AS words, lead(key) OVER (PARTITION BY doc_id ORDER BY pos) AS next
  FROM k),
r AS (
  SELECT *, next IS NOT NULL AND row_number() OVER two > 1 AS linked, first_value(doc_id) OVER two AS two_in,
         words >= 30 AND row_number() OVER one > 1 AS single, first_value(doc_id) OVER one AS one_in
  FROM p WINDOW two AS (PARTITION BY key, next ORDER BY doc_id, pos), one AS (PARTITION BY key ORDER BY doc_id, pos)),
g AS (SELECT *, coalesce(lag(linked) OVER w, false) AS behind FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT *, sum(CASE WHEN behind THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
s AS (
  SELECT doc_id, run, min(start) AS start, max(start + length(unit)) AS stop, sum(words) AS words, string_agg(unit, '' ORDER BY pos) AS part,
         CASE WHEN count(*) > 1 THEN arg_min(two_in, pos) ELSE arg_min(one_in, pos) END AS kept_in,
         (count(*) > 1 AND sum(words) >= 30) OR (count(*) = 1 AND bool_or(single)) AS goes
  FROM h GROUP BY doc_id, run),
x AS (
  SELECT doc_id, CAST(coalesce(sum(words) FILTER (goes), 0) AS BIGINT) AS removed_words,
         coalesce(string_agg(start || '-' || stop || '-' || kept_in, ';' ORDER BY start) FILTER (goes), '') AS removed_spans,
         coalesce(string_agg(part, '' ORDER BY start) FILTER (NOT goes), '') AS kept_text
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(removed_words, 0) AS removed_words, coalesce(removed_spans, '') AS removed_spans, coalesce(kept_text, '') AS kept_text
FROM documents d LEFT JOIN x USING (doc_id)
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_image_copies": op3_image_copies,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_count": op10_token_count,
}

SQL = {
    "op4_exact_dedup": OP4_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
}
