"""Reproducible shuffle and sharding by a Feistel permutation of row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicalens.llm.common import numbered
from replicalens.session import materialize

ROUNDS = 4
# Multipliers and shifts of the splitmix64 finalizer: fixed values.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHIFTS = (30, 27, 31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(SHIFTS[0]))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(SHIFTS[1]))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(SHIFTS[2]))


def _keys(seed: int) -> np.ndarray:
    return _mix((np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(MIX[0])) + np.uint64(seed & (2**64 - 1)))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ (_mix(right + key) & mask)
    return (right << bits) | left  # halves change places, so that the reversed keys undo it


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 applied to ``rows``; ``inverse`` gives the row of a place.

    The network permutes the next power of four at or above n; values outside 0..n-1 are sent through it again
    (cycle walking), about four passes in all at worst on average.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    keys = _keys(seed)[:: -1 if inverse else 1]
    out = _network(rows.astype(np.uint64), half, keys)
    while (out_of := np.flatnonzero(out >= np.uint64(n))).size:
        out[out_of] = _network(out[out_of], half, keys)
    return out.astype(np.int64)


def place_of(row: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed), dtype="int64")

    return run(row)


def shard_rows(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", seed: int = 7, buckets: int = 4096) -> DataFrame:
    """(doc_id, size, text_crc32, row, place, shard, slot) for every row, shuffled and dealt evenly into shards.

    Rows are numbered 0..n-1 in the order of a hash of (doc_id, size, checksum): each of ``buckets`` hash buckets is numbered by itself and
    shifted by the rows of earlier buckets. The number goes through the permutation; shard is place mod ``shards`` and slot the quotient, so
    shard counts differ by one at most, slots are gapless, and both are computable from (row, n, seed) alone, as is the
    row of a (shard, slot) by ``permute(.., inverse=True)``. Text is not shuffled. The result depends on the rows, not on
    their order or partitioning; rows equal in all three keys are interchangeable. Null text has size 16 and checksum 0; a
    null doc_id is a value like others; an empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 16).cast("bigint").alias("size"), F.crc32(t).alias("text_crc32"))
    rows = materialize(rows.withColumn("__h", F.xxhash64("doc_id", "size", "text_crc32")).withColumn(
        "__b", F.pmod("__h", F.lit(buckets)).cast("int")).withColumn("__one", F.lit(1).cast("bigint")), "shard-rows")
    n = rows.count()
    out = numbered(rows, [], "__b", [F.col("__h"), F.col("doc_id"), F.col("size"), F.col("text_crc32")], {"row": "__one"})
    out = out.select("doc_id", "size", "text_crc32", "row", place_of(F.col("row"), n, seed).alias("place"))
    return out.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.floor(F.col("place") / shards).cast("bigint")})
