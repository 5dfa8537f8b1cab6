import pytest
from pyspark.sql import functions as F
from timeweft.functions.values import EPOCH_US
from timeweft.operators import store
from timeweft.sources import log_files as L

from .test_store import SCHEMA


def rows():
    out = [(f"k{i % 7}", EPOCH_US + i, 1, i % 3, "v" * (i * 40), None, False, i * 40) for i in range(40)]
    return [*out, ("k1", EPOCH_US + 100, 0, 0, None, None, True, 0), ("n", EPOCH_US + 5, 0, 0, "1.5", 1.5, False, 3)]


def test_record_round_trip():
    data = b"".join(L.encode_record(i, b"key", b"x" * n) for i, n in enumerate((0, 1, 255, 256, 5000))) + L.encode_record(9, b"k", None)
    got = list(L.decode_records(data))
    assert [len(v) for *_, v in got] == [0, 1, 255, 256, 5000, 0] and got[-1][1] == L.TOMBSTONE and got[4][1] == L.COMPRESSED
    assert len(list(L.decode_records(data[:-3]))) == 5  # the last is cut off
    with pytest.raises(L.CorruptRecord):
        list(L.decode_records(data[:30] + b"?" + data[31:]))
    with pytest.raises(ValueError):
        L.encode_record(1, b"k" * 513, b"")


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert L.write_records(df, str(tmp_path / "wal"), 3) == 42
    back = L.read_records(spark, str(tmp_path / "wal"))
    pick = lambda d: sorted((r.key, r.ts_us, r.hlc_node, r.hlc_seq, r.value, r.num, r.tombstone) for r in d.collect())
    plain = lambda d: [x[:5] + x[6:] for x in pick(d)]
    assert plain(back) == sorted(plain(df), key=lambda x: x[:4])
    assert back.filter("key = 'n'").first().num == 1.5
    meta = L.segment_metadata(back)
    assert meta.agg(F.sum("record_count")).first()[0] == 42
    assert L.expired_segments(meta, EPOCH_US + 10**9, 10).count() == meta.count()
    assert store.get(back, None, "k1").count() == 0


def test_parquet_log(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    L.write_log(df, str(tmp_path / "log"))
    got = L.read_log(spark, str(tmp_path / "log"), EPOCH_US + 3, EPOCH_US + 6)
    assert got.count() == df.filter(F.col("ts_us").between(EPOCH_US + 3, EPOCH_US + 6)).count() and set(got.columns) == set(df.columns)
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters" in plan
