"""A corpus pipeline: five stages over ``documents``, each an operator of ``timeweft.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but the last return the
columns of ``documents``. ``run`` writes what a stage returns as Parquet in the shared folder and reads
it again for the next one, so a lost executor costs no more than the stage at hand; what is no longer needed is removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweft.llm.common import documents, only, remove, shared_folder
from timeweft.llm.exact_dedup import exact_dedup
from timeweft.llm.language_id import fit, keep_known
from timeweft.llm.mixing import mixed_documents
from timeweft.llm.near_copies import near_groups
from timeweft.llm.sentencepiece_lattice import encode, load


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letters and no evidence beside them, or text that no language explains better than chance.

    *Cases.* Null or empty text: the declared language and the source decide. Null language or source: no evidence from them. Rows with one id (null is one too) stay or
    go together, and go only if all of them are rejected. Empty table: no rows. Extra columns stay.
    """
    return keep_known(docs, fit(docs))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose texts are equal but for white space the one with the longest text stays, then the one with the smallest id.

    *Cases.* Null text: equal to the empty one. Rows with the id that stays all stay, repeated rows too; null ids rank last and stay together if one does. Empty
    table: no rows. Extra columns stay.
    """
    return only(docs, exact_dedup(docs).filter("kept").select("doc_id"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash links and of pairs that share 0.8 of their five-word shingles the smallest id stays.

    *Cases.* Null or empty texts are one component, by their fingerprint. Rows with the id that stays all stay; null ids stay only in components without any
    other. Empty table: no rows. Extra columns stay.
    """
    return only(docs, near_groups(docs).filter("doc_id <=> component_id").select("doc_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    *Cases.* Those of ``mixed_documents``: null texts have no words and take copies by their own coin, a null source is one of its own, equal rows take the same
    copies. Empty table: no rows. Extra columns stay.
    """
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens`` of each row.

    *Cases.* Null or empty text: no ids. Repeated rows: one result each. Empty table: no rows. Other columns go.
    """
    out = encode(docs, load("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").alias("n_tokens"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_exact_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("SentencePiece encoding", encoded),
]

#: Fingerprint components, dependent rounding and segmentation aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
