"""Version logs in files: Parquet for our own, and the binary record format of write-ahead logs and segments.

A binary record is CRC32 (4 bytes), packed clock (8), flags (1), key length (2), value length (4), key, value, little
endian; the checksum covers what follows it. Flags: 1 tombstone, 2 value compressed with Snappy, 4 value is a blob reference.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import num, pack_hlc, unpack_hlc

HEAD = struct.Struct("<IQBHI")
TOMBSTONE, COMPRESSED, BLOB = 1, 2, 4
MAX_KEY = 512
#: Values of this size or more are compressed if that makes them smaller.
COMPRESS_FROM = 256


class CorruptRecord(ValueError):
    pass


def encode_record(clock: int, key: bytes, value: bytes | None, compress: bool = True, flags: int = 0) -> bytes:
    if not 0 < len(key) <= MAX_KEY:
        raise ValueError("keys have 1 to 512 bytes")
    flags |= TOMBSTONE if value is None else 0
    body = value or b""
    if compress and len(body) >= COMPRESS_FROM:
        small = pa.Codec("snappy").compress(body, asbytes=True)
        if len(small) < len(body):
            body, flags = small, flags | COMPRESSED
    rest = HEAD.pack(0, clock, flags, len(key), len(body))[4:] + key + body
    return struct.pack("<I", zlib.crc32(rest)) + rest


def snappy_size(data: bytes) -> int:
    """The length that a Snappy block begins with, as a varint."""
    size = shift = 0
    for b in data:
        size |= (b & 127) << shift
        if b < 128:
            return size
        shift += 7
    raise CorruptRecord("no length")


def decode_records(data: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """``(clock, flags, key, value)`` of each record. A record that the end cuts off is left out; a wrong checksum raises."""
    at = 0
    while at + HEAD.size <= len(data):
        crc, clock, flags, k, v = HEAD.unpack_from(data, at)
        end = at + HEAD.size + k + v
        if end > len(data):
            return
        if zlib.crc32(data[at + 4 : end]) != crc:
            raise CorruptRecord(f"wrong checksum at byte {at}")
        key, value = data[at + HEAD.size : at + HEAD.size + k], data[at + HEAD.size + k : end]
        if flags & COMPRESSED:
            value = pa.Codec("snappy").decompress(value, snappy_size(value), asbytes=True)
        yield clock, flags, key, value
        at = end


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The version log of binary files under ``path``, of any file system; a file is read by one task (segments are 64 MiB).

    ``file`` and ``seq`` are the file and the record's place in it.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(decode_records(content))
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    gone = [bool(f & TOMBSTONE) for _, f, _, _ in part]
                    yield pa.record_batch(
                        [
                            pa.array([name] * len(part), pa.string()),
                            pa.array(range(i, i + len(part)), pa.int64()),
                            pa.array([str(c) for c, _, _, _ in part], pa.string()),
                            pa.array([k.decode("utf-8", "replace") for _, _, k, _ in part], pa.string()),
                            pa.array([None if g else v.decode("utf-8", "replace") for g, (_, _, _, v) in zip(gone, part, strict=True)], pa.string()),
                            pa.array([len(v) for _, _, _, v in part], pa.int64()),
                            pa.array(gone, pa.bool_()),
                            pa.array([bool(f & BLOB) for _, f, _, _ in part], pa.bool_()),
                        ],
                        names=["file", "seq", "clock", "key", "value", "size_bytes", "tombstone", "blob"],
                    )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.mapInArrow(batches, "file string, seq long, clock string, key string, value string, size_bytes long, tombstone boolean, blob boolean")
    ts, node, seq = unpack_hlc(F.col("clock").cast("decimal(20,0)"))
    return rows.select("key", ts.alias("ts_us"), node.alias("hlc_node"), seq.alias("hlc_seq"), "value", num(F.col("value")).alias("num"), "tombstone", "size_bytes", "blob", "file", "seq")


def write_records(log: DataFrame, folder: str, files: int = 1) -> int:
    """Writes ``log`` as binary files in ``folder``, which every executor must see, sorted by key and clock. Returns the number of records.

    Versions before 2025 have no packed clock and can't be written.
    """
    os.makedirs(folder, exist_ok=True)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(folder, f"part-{context.partitionId():05d}.log")
        count = 0
        with open(f"{name}.{context.attemptNumber()}", "wb") as f:
            for b in it:
                for clock, key, value in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    f.write(encode_record(int(clock), key.encode(), None if value is None else value.encode()))
                    count += 1
        os.replace(f.name, name)  # a second attempt replaces the first
        yield pa.record_batch([pa.array([count], pa.int64())], names=["n"])

    order = ["key", "ts_us", "hlc_node", "hlc_seq"]
    value = F.when(~F.col("tombstone"), F.coalesce("value", F.lit("")))
    rows = log.repartitionByRange(files, *order).sortWithinPartitions(*order)
    rows = rows.select(pack_hlc(F.col("ts_us"), F.col("hlc_node"), F.col("hlc_seq")).cast("string").alias("clock"), "key", value.alias("value"))
    return rows.mapInArrow(batches, "n long").agg(F.sum("n")).first()[0] or 0


def segment_metadata(records: DataFrame) -> DataFrame:
    """``file, min_us, max_us, record_count, size_bytes`` for each file of ``read_records``."""
    return records.groupBy("file").agg(F.min("ts_us").alias("min_us"), F.max("ts_us").alias("max_us"), F.count(F.lit(1)).alias("record_count"), F.sum("size_bytes").alias("size_bytes"))


def expired_segments(metadata: DataFrame, now: int, ttl_us: int) -> DataFrame:
    """Segments whose last version is older than the ttl: whole files that retention may drop."""
    return metadata.filter(F.col("max_us") + F.lit(ttl_us) <= F.lit(now))


def write_log(log: DataFrame, path: str, by_day: bool = True, mode: str = "append") -> None:
    """Our own format: Parquet by day, sorted by key and clock, with statistics and a Bloom filter on the key, so point and time reads skip row groups."""
    rows = log.withColumn("day", F.to_date(F.timestamp_micros("ts_us"))) if by_day else log
    order = [*(["day"] if by_day else []), "key", "ts_us", "hlc_node", "hlc_seq"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = rows.write.mode(mode).option("parquet.bloom.filter.enabled#key", "true")
    (writer.partitionBy("day") if by_day else writer).parquet(path)


def read_log(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Versions in ``[start, end]``; with ``write_log``'s layout both bounds prune days."""
    rows = spark.read.parquet(path)
    for bound, op in ((start, "ge"), (end, "le")):
        if bound is not None:
            day = F.to_date(F.timestamp_micros(F.lit(bound)))
            if "day" in rows.columns:
                rows = rows.filter(F.col("day") >= day if op == "ge" else F.col("day") <= day)
            rows = rows.filter(F.col("ts_us") >= bound if op == "ge" else F.col("ts_us") <= bound)
    return rows.drop("day")


def save_bucketed(log: DataFrame, table: str, buckets: int) -> None:
    """A table bucketed and sorted by key, so that reads by key and joins on it need no shuffle."""
    log.write.mode("overwrite").bucketBy(buckets, "key").sortBy("key", "ts_us").saveAsTable(table)
