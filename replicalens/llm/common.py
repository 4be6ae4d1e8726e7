"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replicalens.session import materialize

#: A word of a text, for Java's and RE2's engines alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Null ids sort and compare as the largest id inside the operators.
LAST_ID = (1 << 63) - 1


def raw(texts: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty. ``bytes.split()`` cuts exactly at 0x20 and 0x09-0x0D."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


class WordHashes(dict):
    """XXH64 of words, remembered up to ``limit`` of them."""

    limit = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def few(texts: pa.Array, rows: int = 200) -> Iterator[pa.Array]:
    """A batch in parts, so that few of its texts are Python objects at a time."""
    return (texts.slice(i, rows) for i in range(0, len(texts), rows))


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += (n or 0) + 1
        if batch.num_rows > start:
            yield batch.slice(start)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(df: DataFrame, group: list[str], bucket: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums within ``group``, over buckets in turn and in ``order`` within a bucket.

    ``sums`` maps a new column to the column it adds up over all rows before this one. No task holds a group:
    windows run per (group, bucket), and one row per bucket carries the offsets. ``bucket`` must have a fixed
    number of values. ``df`` is read twice, so give a written table.
    """
    totals = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, bucket, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{n}") for n, c in sums.items()])
    joined = rows.join(totals, [*group, bucket])
    return joined.select(*df.columns, *[(F.col(f"__b_{n}") + F.col(f"__i_{n}")).cast("bigint").alias(n) for n in sums])


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in group.column("vector"))
    return pa.table({"shard": group.column("shard")[:1], "node": group.column("node")[:1], "vector": pa.array([total.tobytes()], pa.binary())})


def summed_vectors(vectors: DataFrame, fan_in: int) -> DataFrame:
    """One vector a shard: rows (shard int, node long, vector binary of 64-bit numbers) summed in a tree, ``fan_in`` nodes at a time.

    ``vectors`` is read twice, so give a written table. A node's rows lie together; nodes are numbered from 0, such as by task.
    """
    nodes = (vectors.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        vectors = vectors.withColumn("node", F.expr(f"node div {fan_in}")).groupBy("shard", "node").applyInArrow(_summed, "shard int, node long, vector binary")
        nodes = -(-nodes // fan_in)
        if nodes == 1:
            return vectors
        vectors = materialize(vectors, "summed-vectors")
