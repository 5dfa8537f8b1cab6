import math

import pytest
from pyspark.sql import functions as F
from timeweft.functions import values as V


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_num(spark):
    texts = ["1", " 1", "1d", "1e3", "1e400", "inf", "-Infinity", "nan", ".5", "5.", "0x10", "1_000", "", "abc", None]
    got = [r.n for r in column(spark, texts, "string").select("i", V.num(F.col("v")).alias("n")).orderBy("i").collect()]
    want = [1.0, None, None, 1000.0, None, math.inf, -math.inf, math.nan, 0.5, 5.0, None, None, None, None, None]
    assert [repr(x) for x in got] == [repr(x) for x in want]


def test_fmt(spark):
    numbers = [42.0, 0.5, 123456.0, 1234567.0, 1e6, 1e7, 12345678.9, 1e21, 0.0001, 0.00001, 0.000123, -1234567.0, -2.5, 0.0, math.nan, math.inf, -math.inf, None]
    want = ["42", "0.5", "123456", "1.234567e+06", "1e+06", "1e+07", "1.23456789e+07", "1e+21", "0.0001", "1e-05", "0.000123", "-1.234567e+06", "-2.5", "0", "NaN", "+Inf", "-Inf", "<nil>"]
    got = [r.s for r in column(spark, numbers, "double").select("i", V.fmt(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == want


@pytest.mark.parametrize(
    "a, op, b, want",
    [
        ("10", ">", "9", True), (None, ">", "0.5", True), (None, "<", "0.5", False), (None, "=", None, True), ("abc", "<", "abd", True),
        ("nan", "=", "3", True), ("nan", "<", "3", False), ("", "=", "", True), ("2", "!=", "2.0", False), (None, ">", "abc", False),
    ],
)
def test_compare(spark, a, op, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(V.compare(op, V.Value.of_text(F.col("a")), V.Value.of_text(F.col("b"))).alias("x")).first().x is want


def test_truthy(spark):
    got = column(spark, ["0", "1", "", "x", None, "nan"], "string").select("i", V.truthy(V.Value.of_text(F.col("v"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [False, True, False, True, False, True]


@pytest.mark.parametrize("glob, text, want", [("a*", "abc", True), ("a*", "a/b", False), ("?b", "ab", True), ("[a-c]x", "bx", True), ("[^a]x", "ax", False), ("a\\*", "a*", True), ("a.c", "abc", False)])
def test_glob(spark, glob, text, want):
    assert spark.range(1).select(F.lit(text).rlike(V.glob_regex(glob)).alias("m")).first().m is want


def test_bad_glob():
    assert V.glob_regex("[a") is None and V.glob_regex("a\\") is None


def test_times():
    assert V.micros("1970-01-02") == 86_400_000_000
    assert V.micros("2025-01-01T00:00:00Z") == V.EPOCH_US
    assert V.micros("2025-01-01T01:00:00.123456789+01:00") == V.EPOCH_US + 123456
    with pytest.raises(ValueError):
        V.micros("yesterday")


@pytest.mark.parametrize("text, want", [("30s", 30_000_000), ("5m", 300_000_000), ("1h", 3_600_000_000), ("500ms", 500_000), ("1h30m", 5_400_000_000), ("7", 7_000_000)])
def test_duration(text, want):
    assert V.duration(text) == want


def test_clock_round_trip(spark):
    df = spark.createDataFrame([(V.EPOCH_US + 5, 3, 17), (V.EPOCH_US - 1, 0, 0)], "t long, n int, s int")
    rows = df.select("t", V.pack_hlc(F.col("t"), F.col("n"), F.col("s")).alias("p")).collect()
    assert int(rows[0].p) == (5 << 16) + (3 << 12) + 17 and rows[1].p is None
    back = df.select(*[c.alias(a) for c, a in zip(V.unpack_hlc(V.pack_hlc(F.col("t"), F.col("n"), F.col("s"))), "tns", strict=True)]).first()
    assert tuple(back) == (V.EPOCH_US + 5, 3, 17)
