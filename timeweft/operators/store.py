"""Reads and writes of the append-only version log.

Every function takes and returns DataFrames; ``at``, ``start`` and ``end`` are microseconds since
the Unix epoch. Versions are ordered by ``(ts_us, hlc_node, hlc_seq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOCK = ("ts_us", "hlc_node", "hlc_seq")


def clock() -> Column:
    return F.struct(*CLOCK)


def latest(log: DataFrame, at: int | None = None, keys: tuple[str, ...] = ("key",), clock_columns: tuple[str, ...] = CLOCK, few: bool = False, most: int | None = None) -> DataFrame:
    """The last version of each key, at ``at`` inclusive or of all time, tombstones included: one aggregate with map-side combination.

    ``few`` is for keys with a version or two, where combining before the shuffle costs a sort of all rows and saves
    little: the rows are dealt by key first, into the session's number of parts, ``most`` at the most.
    """
    own = tuple(c for c in clock_columns if c in log.columns)
    seen = log if at is None else log.filter(F.col("ts_us") <= F.lit(at))
    if few:
        above = most is not None and int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")) > most
        seen = seen.repartition(*([most] if above else []), *keys)
    rest = [c for c in log.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*own)).alias("_v")
    return seen.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def get(log: DataFrame, at: int | None = None, key: str | None = None) -> DataFrame:
    """Point read of one key or of all: the last version, if it isn't a tombstone."""
    rows = log if key is None else log.filter(F.col("key") == key)
    return latest(rows, at).filter(~F.col("tombstone"))


def history(log: DataFrame, key: str, start: int | None = None, end: int | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Versions of a key with both bounds included, tombstones too; range, then direction, then limit."""
    rows = log.filter(F.col("key") == key)
    if start:
        rows = rows.filter(F.col("ts_us") >= F.lit(start))
    if end:
        rows = rows.filter(F.col("ts_us") <= F.lit(end))
    rows = rows.orderBy(*[F.desc(c) if reverse else F.asc(c) for c in CLOCK])
    return rows.limit(limit) if limit else rows


def scan_prefix(log: DataFrame, prefix: str) -> DataFrame:
    """Distinct keys that begin with ``prefix``, in order, deleted ones too. ``startswith`` reaches the scan."""
    return log.filter(F.col("key").startswith(prefix)).select("key").distinct().orderBy("key")


def store_stats(log: DataFrame) -> DataFrame:
    """One row: number of keys, of versions, and of keys whose last version is a tombstone."""
    per_key = log.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("tombstone", clock()).alias("gone"))
    return per_key.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.count_if("gone").alias("tombstoned_keys"))


def compact(log: DataFrame) -> DataFrame:
    """Drops dead history: of a key that ends in a tombstone all versions, of another those up to its last tombstone.

    The per-key facts are an aggregate that is joined back, so a hot key's versions can be
    split over tasks, which a window over the key couldn't.
    """
    ends = log.groupBy("key").agg(F.max(F.when(F.col("tombstone"), clock())).alias("_grave"), F.max(clock()).alias("_last")).withColumnRenamed("key", "_key")
    rows = log.join(ends, F.col("key") == F.col("_key"))
    alive = F.col("_grave").isNull() | ((F.col("_grave") < F.col("_last")) & (clock() > F.col("_grave")))
    return rows.filter(alive).select(*log.columns)


def asof(probes: DataFrame, log: DataFrame, by: str = "key", at: str = "at", value: str = "value") -> DataFrame:
    """For each probe ``(by, at, ...)`` the ``value`` of the key's last version at ``at`` inclusive, null if none or a tombstone.

    Probes and versions are unioned and swept once per key in time order; ``last`` carries the
    version forward. The shuffle is on the key, both sides together.
    """
    held = F.struct(F.col(value).alias("v"), "tombstone")
    a = log.select(F.col("key").alias(by), F.col("ts_us").alias(at), F.lit(0).alias("_side"), held.alias("_held"), F.lit(None).cast(_kind(probes, by, at)).alias("_row"))
    rest = [c for c in probes.columns if c not in (by, at)]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    b = probes.select(by, at, F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_held"].dataType).alias("_held"), row.alias("_row"))
    order = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    swept = a.unionByName(b).withColumn("_seen", F.last("_held", ignorenulls=True).over(order)).filter("_side = 1")
    return swept.select(by, at, *[F.col(f"_row.{c}").alias(c) for c in rest], F.when(~F.col("_seen.tombstone"), F.col("_seen.v")).alias(value))


def _kind(probes: DataFrame, by: str, at: str) -> str:
    rest = [f"`{n}`: {t}" for n, t in probes.dtypes if n not in (by, at)]
    return f"struct<{', '.join(rest) if rest else '_: int'}>"


def batch_set(rows: DataFrame, ts_us: int, node: int = 0) -> DataFrame:
    """Stamps ``(key, value)`` rows as one batch: keys in order get consecutive sequence numbers.

    A batch is one write call, so its rows are few; 4096 fit in one microsecond and the rest moves on to the next ones.
    """
    n = F.row_number().over(Window.orderBy("key")) - 1
    return rows.withColumn("_n", n).select(
        "key", "value", (F.lit(ts_us) + F.floor(F.col("_n") / 4096)).cast("bigint").alias("ts_us"),
        F.lit(node).cast("tinyint").alias("hlc_node"), (F.col("_n") % 4096).cast("smallint").alias("hlc_seq"), F.lit(False).alias("tombstone"),
    )


def stamp(rows: DataFrame, node: int = 0, order: tuple[str, ...] = ("key",)) -> DataFrame:
    """Clock columns for rows with ``ts_us``: rows of one microsecond get consecutive sequence numbers in ``order``, so no two stamps are equal."""
    n = F.row_number().over(Window.partitionBy("ts_us").orderBy(*order)) - 1
    return rows.withColumn("hlc_node", F.lit(node).cast("tinyint")).withColumn("hlc_seq", n.cast("smallint"))


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows, allowMissingColumns=True)


def delete(log: DataFrame, keys: DataFrame, ts_us: int) -> DataFrame:
    """Tombstone versions for ``keys``, to append."""
    return keys.select("key").distinct().select(
        "key", F.lit(None).cast("string").alias("value"), F.lit(ts_us).cast("bigint").alias("ts_us"),
        F.lit(0).cast("tinyint").alias("hlc_node"), F.lit(0).cast("smallint").alias("hlc_seq"), F.lit(True).alias("tombstone"),
    )


def blob_references(rows: DataFrame, value: str = "text", key: str = "doc_id", larger_than: int = 0) -> tuple[DataFrame, DataFrame]:
    """Content addressing of values larger than ``larger_than`` bytes: ``(key, hash)`` references, and one row for each
    hash with its size and number of references. Values themselves are never shuffled."""
    size = F.octet_length(F.col(value))
    refs = rows.filter(size > larger_than).select(F.col(key).alias("key"), F.sha2(F.col(value), 256).alias("hash"), size.cast("bigint").alias("size"))
    return refs.select("key", "hash"), refs.groupBy("hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("refs"))


def unreferenced(blobs: DataFrame, refs: DataFrame, older_than: int | None = None) -> DataFrame:
    """Blobs that no reference holds (and, with ``older_than``, stored before it): what collection may remove."""
    rows = blobs if older_than is None else blobs.filter(F.col("stored_us") < F.lit(older_than))
    return rows.join(refs.select("hash").distinct(), "hash", "left_anti")


def expired(log: DataFrame, now: int, policies: DataFrame) -> DataFrame:
    """Keys whose last version is older than their policy's ttl: ``key, last_us, ttl_us``.

    ``policies`` (``prefix, ttl_us``) apply to keys with that prefix; of several the longest
    prefix holds. A key meets them by equality, once for each length that a prefix has.
    """
    last = latest(log).filter(~F.col("tombstone")).select("key", F.col("ts_us").alias("last_us"))
    lengths = policies.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = last.crossJoin(lengths).select("key", "last_us", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("key"))
    match = cut.withColumn("prefix", F.col("key").substr(F.lit(1), F.col("n"))).join(policies, "prefix")
    best = match.groupBy("key", "last_us").agg(F.max_by("ttl_us", F.length("prefix")).alias("ttl_us"))
    return best.filter(F.col("last_us") + F.col("ttl_us") <= F.lit(now))


def expire(log: DataFrame, now: int, policies: DataFrame) -> DataFrame:
    """The tombstones that retention appends at ``now``."""
    return delete(log, expired(log, now, policies), now)


def for_tenant(log: DataFrame, tenant: str) -> DataFrame:
    """What one tenant sees: every scan of it filters on the tenant column, which may be a partition column."""
    return log.filter(F.col("tenant") == tenant)


def prefixed(log: DataFrame) -> DataFrame:
    """Keys as a shared store would hold them, ``tenant:key``."""
    return log.withColumn("key", F.concat_ws(":", "tenant", "key"))


def over_quota(counts: DataFrame, quotas: DataFrame) -> DataFrame:
    """Tenants with more nodes or edges than their quota (``tenant, max_nodes, max_edges``; 0: no limit)."""
    rows = counts.join(quotas, "tenant")
    above = lambda n, m: (F.col(m) > 0) & (F.col(n) > F.col(m))
    return rows.filter(above("nodes", "max_nodes") | above("edges", "max_edges"))
