"""Sets of hashed word shingles, and a rough count of every shingle that gives all sets one order, rare shingles first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from replicalens.llm.array_files import load, save
from replicalens.llm.common import WordHashes, few, raw, slices, summed_vectors
from replicalens.llm.perfect_hash import mixed
from replicalens.session import materialize, scratch_path

_HASHES = WordHashes()
#: Unrelated odd multipliers, one per place in a shingle.
_ODD = mixed(np.arange(64), 1) | np.uint64(1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased (A-Z) words' ``width``-word shingles; fewer words are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        return mixed(np.array([sum(int(x) * int(m) for x, m in zip(h, _ODD)) % 2**64], np.uint64), len(h))
    n = len(h) - width + 1
    total = h[:n] * _ODD[0]
    for i in range(1, width):
        total += h[i:i + n] * _ODD[i]
    return np.unique(mixed(total, width))


def _buckets(shingles: np.ndarray, buckets: int) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) % buckets


def _counted(width: int, buckets: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, total = TaskContext.get().partitionId(), np.zeros(buckets, np.int64)
        for batch in slices(batches, 0):
            for part in few(batch.column(0)):
                sets = [shingle_set(t, width) for t in raw(part)]
                total += np.bincount(_buckets(np.concatenate(sets), buckets), minlength=buckets) if sets else 0
        for s, own in enumerate(np.split(total, parts)):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([node], pa.int64()), pa.array([own.tobytes()], pa.binary())],
                                             ["shard", "node", "vector"])

    return run


class Counts:
    """Rough counts of shingles: all texts' sets, by bucket of the shingle's hash; a rare shingle may share a bucket, a common one always shows."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts, self._table = folder, parts, None

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.concatenate([load(self.folder, f"counts-{i}") for i in range(self.parts)])
        return self._table[_buckets(shingles, len(self._table))]

    def ordered(self, shingles: np.ndarray) -> np.ndarray:
        """The shingles, rare ones first; equal counts by hash. One order for all sets."""
        return shingles[np.lexsort((shingles, self.of(shingles)))]

    def __getstate__(self):
        return {"folder": self.folder, "parts": self.parts, "_table": None}


def count_shingles(texts: DataFrame, width: int, buckets: int = 1 << 20, parts: int = 8, fan_in: int = 16) -> Counts:
    """Counts over the one column of ``texts``: a dense vector per task, summed ``fan_in`` at a time."""
    counts = Counts(scratch_path(texts.sparkSession, "shingle-counts"), parts)
    vectors = materialize(texts.mapInArrow(_counted(width, buckets, parts), "shard int, node long, vector binary"), "task-counts")

    def kept(group: pa.Table) -> pa.Table:
        save(counts.folder, f"counts-{group.column('shard')[0].as_py()}", np.frombuffer(group.column("vector")[0].as_buffer(), np.int64))
        return group.select(["shard"])

    summed_vectors(vectors, fan_in).groupBy("shard").applyInArrow(kept, "shard int").write.format("noop").mode("overwrite").save()
    if texts.isEmpty():
        for i in range(parts):
            save(counts.folder, f"counts-{i}", np.zeros(buckets // parts, np.int64))
    return counts
