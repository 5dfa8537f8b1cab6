"""Statistics of each key, as an aggregate over its versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import glob_regex

ALPHA = 0.05


def fold_rate(times: Column, last: Column, rate: Column) -> Column:
    """``last, rate`` after ascending times in µs, from those before: exponentially weighted writes a second. A gap of 0 or less counts as 1 µs."""

    def step(s: Column, t: Column) -> Column:
        now = F.lit(1e6) / F.greatest(t - s["last"], F.lit(1)).cast("double")
        rate = F.when(s["last"].isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(s["rate"] + (now - s["rate"]) * ALPHA, now))
        return F.struct(t.alias("last"), rate.alias("rate"))

    return F.aggregate(times, F.struct(last.cast("bigint").alias("last"), rate.cast("double").alias("rate")), step)


def write_rate(times: Column) -> Column:
    """The rate of all a key's times; 0 for one write."""
    return F.coalesce(fold_rate(times, F.lit(None), F.lit(None))["rate"], F.lit(0.0))


def key_meta(log: DataFrame, pattern: str | None = None, exact: bool = False) -> DataFrame:
    """One row for each key (matching the glob ``pattern``).

    Deletions count as writes but have no value. Everything but the rate combines before the
    shuffle; the rate needs a key's times in order, 8 bytes a version. ``exact`` counts
    distinct values instead of sketching them.
    """
    rows = log
    if pattern is not None:
        regex = glob_regex(pattern)
        rows = log.filter(F.lit(False)) if regex is None else log.filter(F.col("key").rlike(regex))
    inf = F.lit(float("inf"))
    distinct = F.count_distinct("value") if exact else F.approx_count_distinct("value", 0.016)
    out = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("total_writes"),
        F.sort_array(F.collect_list("ts_us")).alias("_times"),
        F.coalesce(F.min("num"), inf).alias("min_value"),
        F.coalesce(F.max("num"), -inf).alias("max_value"),
        F.coalesce(F.avg("num"), F.lit(0.0)).alias("avg_value"),
        F.coalesce(F.stddev_pop("num"), F.lit(0.0)).alias("stddev_value"),
        distinct.alias("cardinality"),
        F.sum("size_bytes").alias("size_bytes"),
        F.min("ts_us").alias("first_seen"),
        F.max("ts_us").alias("last_seen"),
    )
    return out.withColumn("write_rate", write_rate(F.col("_times"))).drop("_times")


META_COLUMNS = ("key", "total_writes", "write_rate", "min_value", "max_value", "avg_value", "stddev_value", "cardinality", "size_bytes")


def meta_scan(log: DataFrame, pattern: str) -> DataFrame:
    return key_meta(log, pattern).select(*META_COLUMNS)


def service_stats(g, log: DataFrame) -> DataFrame:
    """One row: the store's and the graph's counts, and the log's bytes, as the statistics service reports them."""
    from .graph import graph_stats
    from .store import store_stats

    graph = graph_stats(g).groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col(c))), F.lit(0)).alias(f"{w}s_{c}") for w in ("node", "edge") for c in ("total", "active", "deleted")])
    size = log.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return store_stats(log).crossJoin(graph).crossJoin(size)  # one row each
