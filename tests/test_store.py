from pyspark.sql import functions as F
from timeweft.operators import series as S
from timeweft.operators import stats, store

SCHEMA = "key string, ts_us long, hlc_node tinyint, hlc_seq smallint, value string, num double, tombstone boolean, size_bytes long"


def log(spark, rows):
    """rows: (key, ts, value) with None for a tombstone."""
    out = []
    for k, t, v in rows:
        try:
            n = float(v)
        except (TypeError, ValueError):
            n = None
        out.append((k, t, 0, 0, v, n, v is None, len(v or "")))
    return spark.createDataFrame(out, SCHEMA)


def test_get_at(spark):
    df = log(spark, [("k", 1000, "v1"), ("k", 2000, "v2"), ("k", 3000, "v3"), ("d", 1000, "x"), ("d", 2000, None)])
    assert [r.value for r in store.get(df, 1500, "k").collect()] == ["v1"]
    assert store.get(df, 500, "k").count() == 0
    assert [r.value for r in store.get(df, 2000, "k").collect()] == ["v2"]
    assert store.get(df, 2500, "d").count() == 0
    assert store.latest(df, 2500).filter("key = 'd'").first().tombstone
    assert tuple(store.store_stats(df).first()) == (2, 5, 1)


def test_equal_times_are_ordered_by_sequence(spark):
    df = spark.createDataFrame([("k", 1, 0, 1, "b", None, False, 1), ("k", 1, 0, 0, "a", None, False, 1)], SCHEMA)
    assert store.get(df).first().value == "b"


def test_history(spark):
    df = log(spark, [("k", t, str(t)) for t in range(1000, 100_001, 1000)])
    assert [r.ts_us for r in store.history(df, "k", 2000, 4000).collect()] == [2000, 3000, 4000]
    assert [r.ts_us for r in store.history(df, "k", limit=10, reverse=True).collect()] == list(range(100_000, 90_000, -1000))


def test_scan_prefix(spark):
    df = log(spark, [("a:2", 1, "x"), ("a:1", 1, None), ("b", 1, "x"), ("a:1", 2, "y")])
    assert [r.key for r in store.scan_prefix(df, "a:").collect()] == ["a:1", "a:2"]


def test_compaction(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, None), ("d", 1, "1"), ("d", 2, "2"), ("d", 3, "3"), ("e", 1, "x"), ("m", 1, "v1"), ("m", 2, None), ("m", 3, "v3")]
    got = sorted((r.key, r.ts_us) for r in store.compact(log(spark, rows)).collect())
    assert got == [("b", 1), ("b", 2), ("d", 1), ("d", 2), ("d", 3), ("e", 1), ("m", 3)]


def test_asof(spark):
    df = log(spark, [("k", 10, "a"), ("k", 20, None), ("k", 30, "c")])
    probes = spark.createDataFrame([("k", 5, 1), ("k", 10, 2), ("k", 25, 3), ("k", 99, 4), ("z", 99, 5)], "key string, at long, id int")
    assert {r.id: r.value for r in store.asof(probes, df).collect()} == {1: None, 2: "a", 3: None, 4: "c", 5: None}
    assert store.asof(probes.drop("id"), df).count() == 5


def test_batch_and_retention(spark):
    rows = store.batch_set(spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string"), 7)
    assert [(r.key, r.hlc_seq) for r in rows.orderBy("key").collect()] == [("a", 0), ("b", 1)]
    df = log(spark, [("x:1", 100, "a"), ("x:2", 900, "a"), ("y:1", 100, "a"), ("x:9", 50, None)])
    policies = spark.createDataFrame([("x:", 500), ("", 2000)], "prefix string, ttl_us long")
    assert [r.key for r in store.expire(df, 1000, policies).collect()] == ["x:1"]


def test_blobs(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "doc_id long, text string")
    refs, blobs = store.blob_references(df)
    assert sorted((r.size, r.refs) for r in blobs.collect()) == [(1, 1), (2, 2)]
    assert store.unreferenced(blobs, refs.filter("key = 3")).count() == 1


def test_key_meta(spark):
    df = log(spark, [("k", 10_000 * i, v) for i, v in enumerate(["20", "22", "21", "25", "19"])] + [("k", 50_000, None)])
    r = stats.key_meta(df).first()
    assert (r.total_writes, r.min_value, r.max_value) == (6, 19.0, 25.0)
    assert abs(r.avg_value - 21.4) < 1e-9 and r.stddev_value > 0 and r.cardinality == 5 and abs(r.write_rate - 100) < 1e-6


def test_write_rate(spark):
    df = log(spark, [("k", t, "1") for t in (0, 1000, 3000, 7000)])
    assert abs(stats.key_meta(df).first().write_rate - (1000 + (500 - 1000) * 0.05 + (250 - 975) * 0.05)) < 1e-9
    assert stats.key_meta(log(spark, [("k", 1, "x")])).first().write_rate == 0.0
    assert stats.key_meta(log(spark, [("k", 1, "x")])).first().min_value == float("inf")


def points(spark, n, f, step=1000):
    return spark.createDataFrame([("k", i * step, float(f(i))) for i in range(n)], "key string, ts_us long, value double")


def lttb(data, n):
    """A plain sampler over inclusive buckets, by the definition."""
    if n <= 0 or not data:
        return []
    if n >= len(data):
        return data
    if n < 3:
        return [data[0], data[-1]]
    size, out, last = (len(data) - 2) / (n - 2), [data[0]], data[0]
    end = lambda k: int(k * size) + 1
    for k in range(1, n - 1):
        nxt = data[end(k) : min(end(k + 1), len(data) - 1) + 1]
        x, y = sum(p[0] for p in nxt) / len(nxt), sum(p[1] for p in nxt) / len(nxt)
        own = data[end(k - 1) : min(end(k), len(data) - 1) + 1]
        last = max(own, key=lambda p: abs((last[0] - x) * (p[1] - last[1]) - (last[0] - p[0]) * (y - last[1])))
        out.append(last)
    return [*out, data[-1]]


def test_lttb(spark):
    for length, n in ((1000, 50), (237, 30), (10, 10), (10, 2), (5, 3), (1, 3)):
        df = points(spark, length, lambda i: i * i % 97)
        got = [(r.ts_us, r.value) for r in S.lttb(df, n).orderBy("ts_us").collect()]
        assert got == lttb([(i * 1000, float(i * i % 97)) for i in range(length)], n), (length, n)
    assert S.lttb(df, 0).count() == 0


def test_equal_count_buckets(spark):
    df = points(spark, 100, lambda i: i)
    assert 10 <= S.min_max(df, 10).count() <= 20 and S.average(df, 10).count() == 10
    assert S.average(points(spark, 5, lambda i: i), 10).count() == 5
    for length, n in ((101, 7), (399, 37), (10, 3)):
        got = sorted((r.ts_us, r.value) for r in S.average(points(spark, length, lambda i: i), n).collect())
        size, want = length / n, []
        for b in range(n):
            own = range(int(b * size), int((b + 1) * size))
            want.append((sum(i * 1000 for i in own) // len(own), sum(own) / len(own)))
        assert got == want


def test_time_buckets(spark):
    df = points(spark, 10, lambda i: i, 1_000_000)
    assert [r.value for r in S.time_average(df, 5_000_000).orderBy("ts_us").collect()] == [2.0, 7.0]
    assert [r.value for r in S.time_min_max(df, 5_000_000).orderBy("ts_us").collect()] == [0.0, 4.0, 5.0, 9.0]
    assert S.retain(df, "avg", 0).count() == 10
    assert S.retain(points(spark, 100, lambda i: i % 7, 1_000_000), "lttb", 10_000_000).count() == 10
    assert S.downsample(df, "whatever", 4).count() == 4
    assert S.lttb_stretches(df, 3, 5_000_000).select(F.count("*")).first()[0] == 6


def test_retention_deals_keys_over_all_parts_and_keeps_each_keys_own_number(spark):
    """Small parts aren't joined into a task that holds them all; keys of different spans go through one fold, the key null too."""
    rows = [(f"k{k}", i * 1_000_000, float(i * i % 97)) for k in range(40) for i in range(30)] + [(None, i * 1_000_000, float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, ts_us long, value double")
    got = S.time_lttb(df, 10_000_000).withColumn("part", F.spark_partition_id())
    assert got.select("part").distinct().count() > 1
    per_key = {r.key: r["n"] for r in got.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert per_key == {f"k{k}": 3 for k in range(40)} | {None: 10}
    for key, n in (("k7", 3), (None, 10)):
        one = S.lttb(df.filter(F.col("key").eqNullSafe(key)), n, half_open=True)
        assert sorted(map(tuple, one.select("ts_us", "value").collect())) == sorted((r.ts_us, r.value) for r in got.filter(F.col("key").eqNullSafe(key)).collect())


def test_longest_prefix_of_a_policy_holds(spark):
    keys = ["", "a", "ab", "abc", "b:1", "b:12", "z"]
    df = spark.createDataFrame([(k, 100, "v", False) for k in keys], "key string, ts_us long, value string, tombstone boolean")
    held = {"": 900, "a": 10, "abc": 2000, "b:1": 20}
    policies = spark.createDataFrame(list(held.items()), "prefix string, ttl_us long")
    got = {r.key: r.ttl_us for r in store.expired(df, 1000, policies).collect()}
    ttl = {k: held[max((p for p in held if k.startswith(p)), key=len)] for k in keys}
    assert got == {k: t for k, t in ttl.items() if 100 + t <= 1000}
    assert store.expired(df, 1000, policies.filter("false")).count() == 0
