"""Binary checkpoint log: decoding with column expressions, no Python in the row path.

Records are big-endian. Value: u16 version (0), u64 upstream offset, u64 local offset, u16 length and
metadata text. Key: u16 length and group, u16 length and topic, u32 partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _uint(record: Column, start, length: int) -> Column:
    """Unsigned integer at 1-based ``start``; offsets above the signed range come back as decimal text first."""
    return F.conv(F.hex(record.substr(F.lit(start) if isinstance(start, int) else start, F.lit(length))), 16, 10).cast("decimal(20,0)")


def _u16(record: Column, start) -> Column:
    return _uint(record, start, 2).cast("int")


def _text(record: Column, start: Column, length: Column) -> Column:
    return F.decode(record.substr(start, length), "UTF-8")


def decode_checkpoints(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded checkpoints, rejected records) of (key, value, log_offset) rows.

    Rejected: another header version, an empty group or topic, and a null or truncated key or value. Every record is in one of the two.
    """
    k, v = F.col("key"), F.col("value")
    d = (
        log.withColumn("version", _u16(v, 1))
        .withColumn("glen", _u16(k, 1))
        .withColumn("tpos", F.col("glen") + 3)
        .withColumn("tlen", _u16(k, F.col("tpos")))
    )
    bad = (F.col("version") != 0) | (F.col("glen") == 0) | (F.col("tlen") == 0)
    short = (F.octet_length(k) < F.col("tpos") + F.col("tlen") + 5) | (F.octet_length(v) < _u16(v, 19) + 20) | (F.octet_length(v) < 20)
    bad = F.coalesce(bad | short, F.lit(True))
    good = d.filter(~bad).select(
        "log_offset",
        _text(k, F.lit(3), F.col("glen")).alias("group_id"),
        _text(k, F.col("tpos") + 2, F.col("tlen")).alias("topic"),
        _uint(k, F.col("tpos") + 2 + F.col("tlen"), 4).cast("bigint").alias("partition_id"),
        _uint(v, 3, 8).alias("upstream_offset"), _uint(v, 11, 8).alias("local_offset"),
        _text(v, F.lit(21), _u16(v, 19)).alias("metadata"))
    return good, d.filter(bad).select("log_offset", "key", "value")


def _be(value: Column, width: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")


def _be_text(value: Column) -> Column:
    return F.concat(_be(F.octet_length(value), 2), F.hex(F.encode(value, "UTF-8")))


def encode_checkpoints(checkpoints: DataFrame, metadata: str = "") -> DataFrame:
    """Checkpoint rows to (log_offset, key, value) records."""
    key = F.concat(_be_text(F.col("group_id")), _be_text(F.col("topic")), _be(F.col("partition_id"), 4))
    value = F.concat(F.lit("0000"), _be(F.col("upstream_offset"), 8), _be(F.col("local_offset"), 8), _be_text(F.lit(metadata)))
    return checkpoints.select("log_offset", F.unhex(key).alias("key"), F.unhex(value).alias("value"))
