"""Downsampling of ordered series, many keys at once.

Input rows are ``key, ts_us, value``. Equal-count strategies give each key at most n points (2n for
minmax); time buckets are for retention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(series: DataFrame) -> DataFrame:
    """Each point's place ``i`` in its key and the key's length ``n``."""
    order = Window.partitionBy("key").orderBy("ts_us")
    return series.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))


def _bucket(n: int) -> Column:
    """The equal-count bucket of place ``i``: the last whose start ``floor(b * size)`` is at or before it.

    The start is exact in doubles as written; an inverse by division isn't, so the quotient is
    only a guess that is corrected by one either way.
    """
    size = F.col("n") / F.lit(float(n))
    guess = F.floor(F.col("i") / size)
    up, down = F.floor((guess + 1) * size) <= F.col("i"), F.floor(guess * size) > F.col("i")
    return F.least(F.when(up, guess + 1).when(down, guess - 1).otherwise(guess), F.lit(n - 1))


def average(series: DataFrame, n: int) -> DataFrame:
    """Mean time (whole µs) and value of n equal-count buckets; a key with n points or fewer is copied."""
    if n <= 0:
        return series.select("key", "ts_us", "value").filter(F.lit(False))
    rows = _placed(series).withColumn("b", F.when(F.col("n") <= n, F.col("i")).otherwise(_bucket(n)))
    out = rows.groupBy("key", "b").agg(F.expr("sum(ts_us) div count(1)").alias("ts_us"), F.avg("value").alias("value"))
    return out.select("key", "ts_us", "value")


def min_max(series: DataFrame, buckets: int) -> DataFrame:
    """The least and the greatest point of each equal-count bucket in time order, the same point twice if they are one.

    The first of equal values counts. A key with ``2 * buckets`` points or fewer is copied.
    """
    if buckets <= 0:
        return series.select("key", "ts_us", "value").filter(F.lit(False))
    rows = _placed(series)
    short = rows.filter(F.col("n") <= 2 * buckets).select("key", "ts_us", "value")
    long = rows.filter(F.col("n") > 2 * buckets).withColumn("b", _bucket(buckets))
    point = F.struct("i", "ts_us", "value")
    ends = long.groupBy("key", "b").agg(F.min_by(point, F.struct("value", "i")).alias("lo"), F.max_by(point, F.struct(F.col("value"), -F.col("i"))).alias("hi"))
    both = ends.select("key", F.explode(F.array_sort(F.array("lo", "hi"))).alias("p")).select("key", "p.ts_us", "p.value")
    return short.unionByName(both)


def _lttb(points: str, n: int | str, half_open: bool = False) -> str:
    """SQL for the points kept of an ordered array of ``(ts, value)``: a fold over buckets whose state is the last pick.

    ``n`` is a number or a column that holds 3 or more. With ``e(k) = floor(k s) + 1`` and ``s = (len-2)/(n-2)``, bucket k
    holds places ``e(k-1) .. min(e(k), len-1)``, both ends included, so buckets share a point; ``half_open`` leaves the end
    out. The pick is the first point with the largest triangle against the last pick and the next bucket's mean.
    """
    ends = f"concat(slice({points}, 1, 1), slice({points}, -1, 1))"
    if isinstance(n, int) and n < 3:
        return f"if(size({points}) <= {n}, {points}, {ends})"
    last = f"size({points}) - 1"
    e = lambda k: f"(int(floor(({k}) * ((size({points}) - 2) / double({n} - 2)))) + 1)"
    stop = f"least({e('k')}, {last})"
    after = f"least({e('k + 1')}, {last if not half_open else last + ' + 1'})"
    extra = 0 if half_open else 1
    own = f"slice({points}, {e('k - 1')} + 1, {stop} - {e('k - 1')} + {extra})"
    begin = stop if half_open else e("k")
    nxt = f"slice({points}, {begin} + 1, greatest({after} - {begin} + {extra}, 0))"
    mean = lambda f: f"aggregate({nxt}, 0D, (a, p) -> a + p.{f}) / greatest(size({nxt}), 1)"
    area = "abs((s.last.ts - s.x) * (p.value - s.last.value) - (s.last.ts - p.ts) * (s.y - s.last.value)) * 0.5D"
    state = f"named_struct('area', -1D, 'p', {points}[{e('k - 1')}], 'last', element_at(acc, -1), 'x', {mean('ts')}, 'y', {mean('value')})"
    step = f"(s, p) -> if({area} > s.area, named_struct('area', {area}, 'p', p, 'last', s.last, 'x', s.x, 'y', s.y), s)"
    pick = f"aggregate({own}, {state}, {step}, s -> s.p)"
    fold = f"aggregate(sequence(1, {n} - 2), slice({points}, 1, 1), (acc, k) -> concat(acc, array({pick})))"
    return f"if(size({points}) <= {n}, {points}, concat({fold}, slice({points}, -1, 1)))"


def _whole(series: DataFrame) -> DataFrame:
    """``key, points``: each key's points as one array in time order.

    Points are dealt by key before they are gathered, so no map task sorts its rows by key first, and the parts are as many
    as the session's shuffles have: without a number, small parts would be joined until a task holds much of the input.
    """
    point = F.struct(F.col("ts_us").cast("double").alias("ts"), F.col("value").cast("double").alias("value"), "ts_us")
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.select("key", "ts_us", "value").repartition(parts, "key").groupBy("key").agg(F.array_sort(F.collect_list(point)).alias("points"))


def lttb(series: DataFrame, n: int, half_open: bool = False) -> DataFrame:
    """Largest triangle, three buckets: n points of each key that keep the series' shape.

    Every pick depends on the one before, so a key is one array in time order and a fold; keys are independent. For one
    series that doesn't fit in a task, downsample stretches of it (``lttb_stretches``).
    """
    if n <= 0:
        return series.select("key", "ts_us", "value").filter(F.lit(False))
    return _whole(series).select("key", F.explode(F.expr(_lttb("points", n, half_open))).alias("p")).select("key", "p.ts_us", "p.value")


def lttb_stretches(series: DataFrame, n: int, stretch_us: int) -> DataFrame:
    """``lttb`` of each stretch of time of its own, for series of any length; n points for each stretch."""
    cut = series.withColumn("_key", F.col("key")).withColumn("key", F.concat_ws("\x1f", "key", F.floor(F.col("ts_us") / stretch_us)))
    return lttb(cut.drop("_key"), n).withColumn("key", F.substring_index("key", "\x1f", 1))


def time_average(series: DataFrame, interval_us: int) -> DataFrame:
    """Mean value of time buckets that start at each key's first point; the time is the bucket's middle. ``interval_us`` of 0 or less: the input."""
    if interval_us <= 0:
        return series.select("key", "ts_us", "value")
    rows = _time_bucket(series, interval_us)
    return rows.groupBy("key", "start").agg(F.avg("value").alias("value")).select("key", (F.col("start") + interval_us // 2).alias("ts_us"), "value")


def time_min_max(series: DataFrame, interval_us: int) -> DataFrame:
    """The least value at each time bucket's middle and the greatest 1 µs later."""
    if interval_us <= 0:
        return series.select("key", "ts_us", "value")
    ends = _time_bucket(series, interval_us).groupBy("key", "start").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    mid = F.col("start") + interval_us // 2
    return ends.select("key", F.explode(F.array(F.struct(mid.alias("ts_us"), F.col("lo").alias("value")), F.struct((mid + 1).alias("ts_us"), F.col("hi").alias("value")))).alias("p")).select("key", "p.*")


def time_lttb(series: DataFrame, interval_us: int) -> DataFrame:
    """Shape-preserving retention: each key gets about one point for each interval of its span, 3 at least.

    The number of points differs by key and is read off the key's own array, so all keys go through one fold.
    """
    if interval_us <= 0:
        return series.select("key", "ts_us", "value")
    span = F.array_max("points.ts_us") - F.array_min("points.ts_us")
    rows = _whole(series).withColumn("_n", F.greatest(F.lit(3), F.floor(span / interval_us) + 1))
    return rows.select("key", F.explode(F.expr(_lttb("points", "_n", half_open=True))).alias("p")).select("key", "p.ts_us", "p.value")


def _time_bucket(series: DataFrame, interval_us: int) -> DataFrame:
    first = series.groupBy("key").agg(F.min("ts_us").alias("_first")).withColumnRenamed("key", "_key")
    rows = series.join(first, F.col("key") == F.col("_key"))
    return rows.withColumn("start", F.col("_first") + F.floor((F.col("ts_us") - F.col("_first")) / interval_us) * interval_us)


def downsample(series: DataFrame, strategy: str, n: int) -> DataFrame:
    """By name, any case; an unknown name is LTTB."""
    return {"avg": average, "minmax": min_max}.get(strategy.lower(), lttb)(series, n)


def retain(series: DataFrame, strategy: str, interval_us: int) -> DataFrame:
    """Retention by name; an unknown name is the average."""
    return {"minmax": time_min_max, "lttb": time_lttb}.get(strategy.lower(), time_average)(series, interval_us)
