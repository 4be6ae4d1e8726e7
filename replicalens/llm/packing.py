"""Packing token sequences by harmonic classes."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replicalens.llm.common import numbered, slices
from replicalens.session import materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, klass int"


class WordIds(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes, by a tokenizer that never looks across white space.

    Spaces and line ends are cut off before encoding: the vocabulary drops white space, and its normalizer and splitter
    work on each run of other characters alone. Ids of up to ``limit`` runs are remembered.
    """

    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit

    def __missing__(self, run: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(run, add_special_tokens=False).ids)
        if len(self) >= self.limit:
            self.clear()
        self[run] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str, limit: int = 1_000_000) -> WordIds:
    return WordIds(path, limit)


def cuts(n: int, capacity: int, classes: int, fill: float) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``n`` tokens.

    Full sequences first. A rest of class k (k of its kind fit into a sequence) stays whole if k such fill at least ``fill`` of it; else a
    piece of exactly 1/(k+1) of the capacity is cut off and the rest is looked at again. Class ``classes`` takes all shorter pieces.
    """
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k >= classes or rest * k >= fill * capacity:
            out.append((rest, min(k, classes)))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, classes: int, fill: float, remember: int, doc_id: str, text: str) -> DataFrame:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer, remember)
        for batch in slices(batches, 1):
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(ids_of.of(t or "") + end)
                n, start = len(ids) // 4, 0
                for length, klass in cuts(n, capacity, classes, fill):
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), n, klass))
                    start += length
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def _first_fit(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        used, bins, offsets = [], [], []
        for length in group["length"]:
            b = next((i for i, u in enumerate(used) if u + length <= capacity), len(used))
            if b == len(used):
                used.append(0)
            bins.append(b)
            offsets.append(used[b])
            used[b] += length
        return group.assign(bin=bins, offset=offsets).drop(columns="one")

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, classes: int = 32, fill: float = 0.95,
         remember: int = 1_000_000, doc_id: str = "doc_id", text: str = "text", buckets: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, klass, sequence_id, offset.

    A document is its token ids, then ``end_id``, cut by ``cuts``. Class k holds lengths in (capacity/(k+1), capacity/k]; its pieces are numbered
    over hash buckets without a task holding a class, and piece i goes to sequence i // k, so every full sequence has exactly k
    pieces. The last class holds pieces of at most capacity/classes tokens, whose running token sum is cut every
    ``capacity - longest + 1`` tokens: a sequence gets the pieces that start in its stretch, which always fit. What does not fill a sequence of
    its class, less than classes²/2 pieces and one sequence of the last class at any input size, is packed first-fit
    decreasing in one small group.

    A worker remembers the ids of ``remember`` words at about 150 bytes each. Sequence ids run from 0 without gaps. Null text is an empty document of one token. Repeated rows are documents of
    their own. An empty table gives no rows.
    """
    found = pieces(docs, tokenizer, end_id, capacity, classes, fill, remember, doc_id, text)
    found = materialize(found.withColumns({"__h": F.xxhash64("doc_id", "start", "ids_crc32", "length"), "__one": F.lit(1).cast("bigint")}).withColumn(
        "__b", F.pmod("__h", F.lit(buckets)).cast("int")), "pieces")
    stretch = capacity - capacity // classes + 1
    last = F.col("klass") == classes
    totals = found.groupBy("klass").agg(F.sum("__one").alias("n"), F.sum("length").alias("tokens"))
    full = F.when(last, F.floor(F.col("tokens") / stretch)).otherwise(F.floor(F.col("n") / F.col("klass"))).cast("bigint")
    before = Window.partitionBy(F.lit(0)).orderBy("klass").rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    bases = materialize(totals.withColumn("full", full).select("klass", "full", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("base")), "class-bases")
    whole = bases.agg(F.sum("full")).first()[0] or 0
    placed = numbered(found, ["klass"], "__b", [F.col("__h"), F.col("doc_id"), F.col("start")], {"__n": "__one", "__tokens": "length"})
    placed = placed.withColumn("__bin", F.when(last, F.floor(F.col("__tokens") / stretch)).otherwise(F.floor(F.col("__n") / F.col("klass"))))
    placed = materialize(placed.join(bases, "klass"), "placed")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass"]
    inside = Window.partitionBy("klass", "__bin").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    filled = placed.filter("__bin < full").select(*columns, (F.col("base") + F.col("__bin")).alias("sequence_id"),
                                                  F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
    left = placed.filter("__bin >= full").select(*columns, F.lit(1).alias("one"))
    rest = left.groupBy("one").applyInPandas(_first_fit(capacity), f"{PIECES}, bin long, offset long")
    return filled.unionByName(rest.select(*columns, (F.col("bin") + F.lit(whole)).alias("sequence_id"), "offset"))
