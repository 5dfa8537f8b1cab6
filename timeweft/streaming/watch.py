"""Streams over the version log: watched keys, running statistics, expiry.

Any streaming source of log rows will do (files, Kafka after parsing); replays read the events
table as a file stream and run it to its end with ``availableNow``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stats import fold_rate
from ..sources.tables import shared_folder, us


def log_of(events: DataFrame) -> DataFrame:
    """Log rows from a (streaming) frame of events: ``key, value, num, ts_us, ts, deleted``."""
    gone = F.col("event_id") % 97 == 0
    key = F.concat(F.lit("node:user_"), F.col("user_id").cast("string"), F.lit(":prop:"), "event_type")
    return events.select(key.alias("key"), F.when(~gone, F.col("value").cast("string")).alias("value"), F.when(~gone, F.col("value")).alias("num"), us("ts").alias("ts_us"), F.col("ts").cast("timestamp").alias("ts"), gone.alias("deleted"))


def watch(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every version of the given keys as it arrives, deletions too; nothing is dropped."""
    return log.filter(F.col("key").isin(list(keys))).select("key", "value", "ts_us", "deleted")


def windowed_stats(log: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Writes, mean and extremes for each key and event-time window; versions later than the watermark are left out."""
    return log.withWatermark("ts", late).groupBy("key", F.window("ts", window)).agg(F.count(F.lit(1)).alias("writes"), F.avg("num").alias("avg_value"), F.min("num").alias("min_value"), F.max("num").alias("max_value"))


STATE = "total_writes long, size_bytes long, last_seen long, write_rate double, min_value double, max_value double, n_values long, avg_value double, m2 double, batch long"


def _arrived(rows: DataFrame) -> DataFrame:
    """What one batch adds to each key. Rows are dealt by key first; values stay behind, and only their sizes go on."""
    num = F.when(~F.isnan("num"), F.col("num")).alias("num")
    dealt = rows.select("key", "ts_us", F.coalesce(F.octet_length("value"), F.lit(0)).alias("size"), num).repartition("key")
    return dealt.groupBy("key").agg(
        F.count(F.lit(1)).alias("writes"), F.sum("size").alias("size"), F.sort_array(F.collect_list("ts_us")).alias("times"), F.min("num").alias("lo"), F.max("num").alias("hi"),
        F.count("num").alias("m"), F.avg("num").alias("mean"), (F.var_pop("num") * F.count("num")).alias("part_m2"),
    )


def _merged(old: DataFrame | None, new: DataFrame, batch: int) -> DataFrame:
    """The state of all keys after a batch, from that before it."""
    if old is None:
        both = new.withColumns({f"_{c}": F.lit(None).cast(t) for c, t in (x.split() for x in STATE.split(", "))})
    else:
        old = old.select(F.col("key").alias("_key"), *[F.col(c.split()[0]).alias(f"_{c.split()[0]}") for c in STATE.split(", ")])
        both = new.join(old, F.col("key") == F.col("_key"), "full").withColumn("key", F.coalesce("key", "_key"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    m0, m1, inf = zero("_n_values"), zero("m"), F.lit(float("inf"))
    step = zero("mean") - zero("_avg_value")
    rate = fold_rate(F.coalesce("times", F.array().cast("array<bigint>")), F.col("_last_seen"), F.col("_write_rate"))
    both = both.withColumns({"_rate": rate, "_m": m0 + m1})
    share = F.when(F.col("_m") > 0, m1 / F.col("_m")).otherwise(F.lit(0.0))
    return both.select(
        "key", (zero("_total_writes") + zero("writes")).alias("total_writes"), (zero("_size_bytes") + zero("size")).alias("size_bytes"), F.col("_rate.last").alias("last_seen"), F.col("_rate.rate").alias("write_rate"),
        F.coalesce(F.least("_min_value", "lo"), inf).alias("min_value"), F.coalesce(F.greatest("_max_value", "hi"), -inf).alias("max_value"), F.col("_m").alias("n_values"),
        (zero("_avg_value") + step * share).alias("avg_value"), (zero("_m2") + zero("part_m2") + step * step * m0 * share).alias("m2"), F.when(F.col("writes") > 0, F.lit(batch)).otherwise(F.col("_batch")).cast("bigint").alias("batch"),
    )


def _states(spark: SparkSession, folder: str) -> tuple:
    """Hadoop's file system and path of ``folder``, and the batches whose state is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return fs, path, sorted(int(n) for n in names if n.isdigit())


def online_key_meta(log: DataFrame, folder: str, emit: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """Running statistics of each key, to be started: every batch is one aggregate that is merged into the state in ``folder``, a shared one.

    ``emit`` gets the new rows of the keys that a batch has versions of; ``key_meta_of`` reads those of all keys. State is eleven
    columns a key, and each batch writes it anew, so batches should hold more rows than a small part of the keys; a batch's
    state takes its name when it is whole, and the one before it stays, so a batch that is run again comes to the same.
    """

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        fs, path, done = _states(spark, folder)
        before = [b for b in done if b < batch]
        old = spark.read.parquet(f"{folder}/{before[-1]}") if before else None
        _merged(old, _arrived(rows), batch).write.mode("overwrite").parquet(f"{folder}/next-{batch}")
        to = lambda name: spark._jvm.org.apache.hadoop.fs.Path(path, str(name))
        fs.delete(to(batch), True)
        if not fs.rename(to(f"next-{batch}"), to(batch)):
            raise OSError(f"{folder}/next-{batch} can't be renamed")
        for b in before[:-1]:
            fs.delete(to(b), True)
        if emit is not None:
            emit(_rows_of(spark.read.parquet(f"{folder}/{batch}").filter(F.col("batch") == batch)))

    return log.writeStream.foreachBatch(step)


def _rows_of(state: DataFrame) -> DataFrame:
    stddev = F.when(F.col("n_values") > 0, F.sqrt(F.col("m2") / F.col("n_values"))).otherwise(F.lit(0.0))
    return state.select("key", "total_writes", "size_bytes", "last_seen", F.coalesce("write_rate", F.lit(0.0)).alias("write_rate"), "min_value", "max_value", "n_values", "avg_value", stddev.alias("stddev_value"))


def key_meta_of(spark: SparkSession, folder: str) -> DataFrame:
    """The last statistics of each key: ``key, total_writes, size_bytes, last_seen, write_rate, min_value, max_value, n_values, avg_value, stddev_value``."""
    done = _states(spark, folder)[2]
    return _rows_of(spark.read.parquet(f"{folder}/{done[-1]}") if done else spark.createDataFrame([], f"key string, {STATE}"))


def _expiry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (last,) = state.get
        state.remove()
        yield pd.DataFrame([(key[0], last)], columns=["key", "last_us"])
        return
    rows = pd.concat(list(batches)).sort_values("ts_us")
    newest = rows.iloc[-1]
    last = max(int(newest["ts_us"]), state.get[0] if state.exists else 0)
    if bool(newest["deleted"]) and last == int(newest["ts_us"]):
        if state.exists:
            state.remove()
        return
    state.update((last,))
    state.setTimeoutTimestamp(last // 1000 + int(newest["ttl_us"]) // 1000)


def expiring(log: DataFrame, ttl_us: int, late: str = "1 hour") -> DataFrame:
    """``key, last_us`` for each key that got no version for ``ttl_us`` of event time; a write re-schedules it and a deletion cancels it."""
    rows = log.withColumn("ttl_us", F.lit(ttl_us)).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(_expiry, "key string, last_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote, from an in-memory sink: for replays and tests. Jobs write to a table."""
    name = f"stream_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def replay_watch(spark: SparkSession, sf_dir: str, keys: Sequence[str]) -> DataFrame:
    return run_to_end(watch(log_of(event_stream(spark, sf_dir)), keys))


def replay_key_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last statistics of each key."""
    folder = f"{shared_folder(spark)}/key-meta-{uuid.uuid4().hex}"
    q = online_key_meta(log_of(event_stream(spark, sf_dir)), f"{folder}/state").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return key_meta_of(spark, f"{folder}/state")
