from timeweft.streaming import watch as W


def test_watch(spark, data):
    keys = ["node:user_1:prop:click"]
    got = W.replay_watch(spark, data, keys)
    events = spark.read.parquet(f"{data}/events.parquet")
    assert got.count() == events.filter("user_id = 1 and event_type = 'click'").count() > 0


def test_running_statistics_agree_with_the_aggregate(spark, data):
    from timeweft.operators.stats import key_meta
    from timeweft.sources.tables import event_log

    a = {r.key: r for r in W.replay_key_meta(spark, data).collect()}
    b = {r.key: r for r in key_meta(event_log(spark, data)).collect()}
    assert a.keys() == b.keys()
    for k, x in a.items():
        y = b[k]
        assert (x.total_writes, x.size_bytes, x.min_value, x.max_value) == (y.total_writes, y.size_bytes, y.min_value, y.max_value)
        assert abs(x.avg_value - y.avg_value) < 1e-6 and abs(x.stddev_value - y.stddev_value) < 1e-6 and abs(x.write_rate - y.write_rate) < 1e-9


def test_running_statistics_merge_batches_without_python_workers(spark, tmp_path):
    """Three batches, with a late row, a key without values and one that is silent: the rows emitted, and the last ones, are those of a plain fold."""
    schema = "key string, value string, num double, ts_us long, ts timestamp, deleted boolean"
    batches = [[("a", 5, 1.0), ("a", 2, 4.0), ("b", 1, None)], [("a", 9, 2.5), ("c", 3, 7.0)], [("a", 4, -3.0), ("b", 8, None), ("b", 8, None)]]
    want, emitted, plans = {}, [], []
    for n, rows in enumerate(batches):
        spark.createDataFrame([(k, v and str(v), v, t * 1_000_000, None, v is None) for k, t, v in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        for k, t, v in sorted(rows, key=lambda r: r[1]):
            s = want.setdefault(k, {"n": 0, "last": None, "rate": None, "values": []})
            if s["last"] is not None:
                now = 1e6 / max(t * 1_000_000 - s["last"], 1)
                s["rate"] = now if s["rate"] is None else s["rate"] + (now - s["rate"]) * 0.05
            s |= {"n": s["n"] + 1, "last": t * 1_000_000, "values": s["values"] + [v] * (v is not None)}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def emit(rows):
        plans.append(rows._jdf.queryExecution().toString())
        emitted.append({r.key: r.total_writes for r in rows.collect()})

    folder = str(tmp_path / "state")
    W.online_key_meta(stream, folder, emit).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert emitted == [{"a": 2, "b": 1}, {"a": 3, "c": 1}, {"a": 4, "b": 3}] and not any("Pandas" in p for p in plans)
    got = {r.key: r for r in W.key_meta_of(spark, folder).collect()}
    assert got.keys() == want.keys()
    for k, s in want.items():
        r, v = got[k], s["values"]
        mean = sum(v) / len(v) if v else 0.0
        deviation = (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5 if v else 0.0
        assert (r.total_writes, r.last_seen, r.n_values, r.size_bytes) == (s["n"], s["last"], len(v), sum(len(str(x)) for x in v))
        assert (r.min_value, r.max_value) == (min(v, default=float("inf")), max(v, default=float("-inf")))
        assert abs(r.write_rate - (s["rate"] or 0.0)) < 1e-6 and abs(r.avg_value - mean) < 1e-9 and abs(r.stddev_value - deviation) < 1e-9
    assert W.key_meta_of(spark, str(tmp_path / "none")).count() == 0
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.isdigit()]) == 2


def test_windowed_statistics(spark, data):
    out = W.run_to_end(W.windowed_stats(W.log_of(W.event_stream(spark, data)), "6 hours"), "complete")
    assert out.agg({"writes": "sum"}).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_expiry_of_idle_keys(spark, tmp_path):
    """Keys are silent for longer than the ttl once the watermark has moved on; a deletion cancels."""
    from datetime import datetime

    schema = "key string, value string, num double, ts_us long, ts timestamp, deleted boolean"
    row = lambda k, s, gone=False: (k, "1", 1.0, s * 1_000_000, datetime.fromtimestamp(s), gone)
    for n, rows in enumerate([[row("a", 100), row("b", 100), row("c", 100), row("c", 101, True)], [row("b", 400), row("z", 9000)], [row("z", 20000)], [row("z", 40000)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = W.run_to_end(W.expiring(stream, 1000 * 1_000_000, "10 seconds"))
    assert {r.key for r in got.collect()} >= {"a", "b"} and "c" not in {r.key for r in got.collect()}
