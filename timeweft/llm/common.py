"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: What a worker keeps from task to task, of one owner at a time.
_HELD: dict = {}


def worker_cache(owner: str) -> dict:
    """The owner's own cache in this worker; what others left there goes, so reused workers don't add up what operators keep."""
    for other in [k for k in _HELD if k != owner]:
        del _HELD[other]
    return _HELD.setdefault(owner, {})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where that is unset in local mode (tests) one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="timeweft-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` serves where every character is ASCII."""
    lower = UPPER.lower()
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, lower))


def squeezed(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def text_key(text: Column, names: tuple[str, str] = ("h1", "h2")) -> tuple[Column, Column]:
    """128 bits of a text as two longs (null like empty). With the id they tell rows apart, and equal rows agree."""
    full = F.coalesce(text, F.lit(""))
    return F.xxhash64(full).alias(names[0]), F.xxhash64(F.lit("row"), full).alias(names[1])


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut and its size is known, so a join broadcasts it only if it is small."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (one column). The ids are hashed, so wide rows needn't be sorted.

    Rows without an id stay or go together.
    """
    kept = ids.toDF("_kept").hint("shuffle_hash")
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept"]), "left_semi")


def ranked(df: DataFrame, by: list[Column], within: list[str], weight: str | None = None, rank: str = "rank", before: str = "before") -> DataFrame:
    """Adds ``rank``, each row's place (from 0) among the rows that agree on ``within``, in the order of ``by``.

    With ``weight``, ``before`` is the sum of the weights in front of the row. One range
    shuffle puts rows in order; places inside a partition come from a window over the
    partition, and a small table of one row for each partition and key says what earlier
    partitions hold. So no task sees more than its range, however large one key is.
    ``by`` must begin with the ``within`` columns and end with a unique one for stable places.
    """
    from pyspark.sql import Window

    spread = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *within).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    size = F.col(weight) if weight else F.lit(0).cast("long")
    held = spread.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_w"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_part", *within, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"))
    rows = spread.withColumn("_n", F.count(F.lit(1)).over(local)).withColumn("_w", F.sum(size).over(local) - size)
    same = F.lit(True)
    a, b = rows.alias("a"), held.alias("b")
    for name in ("_part", *within):
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    out = a.join(b, same).withColumn(rank, F.col("a._n") - 1 + F.col("b._n0"))
    keep = [F.col(f"a.{c}").alias(c) for c in df.columns]
    return out.select(*keep, rank, *([(F.col("a._w") + F.col("b._w0")).alias(before)] if weight else []))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
