"""Language-model scoring: an interpolated modified Kneser-Ney bigram model in sorted hash arrays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicalens.llm.array_files import load, packed, save, unpacked
from replicalens.llm.common import WordHashes, raw, slices
from replicalens.session import materialize, scratch_path

#: Marks of a text's two ends. No word has a space, so they are no words.
START, END = xxhash.xxh64_intdigest(b" start"), xxhash.xxh64_intdigest(b" end")
#: Word hashes are dealt into this many ranges.
RANGES = 64
TOKENS = 1_000_000


_HASHES = WordHashes()


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start, words and end of all texts in turn, and each text's number of them."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    out = np.empty(int(sizes.sum()), dtype=np.uint64)
    at = 0
    for w, n in zip(words, sizes):
        out[at] = START
        out[at + 1:at + n - 1] = np.fromiter(map(_HASHES.__getitem__, w), dtype=np.uint64, count=len(w))
        out[at + n - 1] = END
        at += n
    return out, sizes


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training: CRC-32 of its id as text, divisible by 10. A null id is held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def _groups(batches: Iterator[pa.RecordBatch], training: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents in groups of about TOKENS tokens: ids, token hashes, sizes."""
    ids, texts, size = [], [], 0
    for batch in slices(batches, 1):
        for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            if training and held_out(doc):
                continue
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size > 6 * TOKENS:
                yield ids, *_tokens(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield ids, *_tokens(texts)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _flushed(parts: Iterator[tuple[np.ndarray, np.ndarray]], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counted keys, merged as far as ``limit`` of them fit in memory."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(k) for k, _ in held) > limit:
            held = [_merge(held)]
            if len(held[0][0]) > limit // 2:
                yield held.pop()
    if held:
        yield _merge(held)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(values, return_counts=True)
    return keys, counts.astype(np.int64)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more from the numbers of n-grams seen 1 to 4 times; without those, 1/2, 1 and 3/2."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return counts - np.array([0.0, *d])[np.minimum(counts, 3)]


@dataclass
class Model:
    """Files of a model in ``folder`` and its totals.

    ``words-i``: sorted hashes of range i, ``counts-i`` their counts; a word's number is its place over all ranges in turn. ``once-j``: sorted
    pairs (number << 32 | number) of shard j seen once; ``more-j`` and ``times-j``: the others and their counts. ``kinds-i``: per word of
    range i, how many words follow it once, twice, more often, and how many precede it.
    """

    folder: str
    sizes: list[int]
    shards: int
    tokens: int
    vocabulary: int
    pairs: list[int]  # pairs seen 1, 2, 3, 4 times
    before: list[int] = field(default_factory=list)  # words with 1, 2, 3, 4 preceding words
    kinds: list[int] = field(default_factory=list)  # words with 1, 2, more preceding words, and all their preceding words

    def opened(self) -> "Model":
        if not hasattr(self, "_open"):
            self._starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
            self._open = {}
        return self

    def part(self, name: str, i: int) -> np.ndarray:
        if (name, i) not in self._open:
            self._open[name, i] = load(self.folder, f"{name}-{i}")
        return self._open[name, i]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct word hashes, -1 if unknown."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        cut = np.searchsorted(hashes, np.arange(1, RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1))
        for i, (a, b) in enumerate(zip(np.r_[0, cut], np.r_[cut, len(hashes)])):
            if a < b and self.sizes[i]:
                known = self.part("words", i)
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], at + self._starts[i], -1)
        return out

    def gathered(self, name: str, numbers: np.ndarray, width: int = 0) -> np.ndarray:
        """Rows of a word file for sorted numbers; -1 gives 0."""
        out = np.zeros((len(numbers), width) if width else len(numbers), dtype=np.int64)
        at = np.searchsorted(numbers, self._starts)
        for i in range(RANGES):
            if at[i] < at[i + 1]:
                out[at[i]:at[i + 1]] = self.part(name, i)[numbers[at[i]:at[i + 1]] - self._starts[i]]
        return out

    def times(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs."""
        out = np.zeros(len(pairs), dtype=np.int64)
        shard = _shard(pairs, self.shards)
        order = np.lexsort((pairs, shard))
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for j in range(self.shards):
            here = order[cut[j]:cut[j + 1]]
            for name in ("once", "more") if len(here) else ():
                known = self.part(name, j)
                if len(known):
                    at = np.minimum(np.searchsorted(known, pairs[here]), len(known) - 1)
                    hit = known[at] == pairs[here]
                    out[here[hit]] = 1 if name == "once" else self.part("times", j)[at[hit]]
        return out


def _reduced(rows: DataFrame, key: str, fn, schema: str, name: str) -> DataFrame:
    """The small result table of writing one set of files per ``key``; read again, it doesn't write them anew."""
    return materialize(rows.groupBy(key).applyInArrow(fn, schema), name)


def _word_counts(docs: DataFrame, folder: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1)
        for keys, counts in _flushed((_counted(tokens) for _, tokens, _ in _groups(batches, True)), 2_000_000):
            cut = np.searchsorted(keys, bounds)
            parts = [(i, keys[a:b].tobytes(), packed(counts[a:b])) for i, (a, b) in enumerate(zip(np.r_[0, cut], np.r_[cut, len(keys)])) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "keys", "n"])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py()
        keys, counts = _merge([(np.frombuffer(k, np.uint64), unpacked(n).astype(np.int64)) for k, n in zip(table["keys"].to_pylist(), table["n"].to_pylist())])
        save(folder, f"words-{i}", keys)
        save(folder, f"counts-{i}", counts)
        word = keys != np.uint64(START)
        return pa.table({"part": pa.array([i], pa.int32()), "words": [len(keys)], "vocabulary": [int(word.sum())], "tokens": [int(counts[word].sum())]})

    rows = docs.mapInArrow(count, "part int, keys binary, n binary")
    return _reduced(rows, "part", write, "part int, words long, vocabulary long, tokens long", "word-counts")


def _pair_counts(docs: DataFrame, model: Model) -> DataFrame:
    folder, shards = model.folder, model.shards

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.opened()

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for _, tokens, sizes in _groups(batches, True):
                known, inverse = np.unique(tokens, return_inverse=True)
                number = words.numbers(known).astype(np.uint64)[inverse]
                inside = np.ones(len(number) - 1, dtype=bool)
                inside[np.cumsum(sizes)[:-1] - 1] = False
                yield _counted(((number[:-1] << np.uint64(32)) | number[1:])[inside])

        for keys, counts in _flushed(pairs(), 4_000_000):
            shard = _shard(keys, shards)
            order = np.argsort(shard, kind="stable")
            keys, counts, cut = keys[order], counts[order], np.searchsorted(shard[order], np.arange(shards + 1))
            for j in range(shards):
                k = keys[cut[j]:cut[j + 1]]
                if len(k):
                    high = np.diff(k >> np.uint64(32), prepend=np.uint64(0))
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), *(pa.array([packed(v)], pa.binary()) for v in (
                        high, k & np.uint64(0xFFFFFFFF), counts[cut[j]:cut[j + 1]]))], names=["part", "high", "low", "n"])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        j = key[0].as_py()
        parts = [((np.cumsum(unpacked(h).astype(np.uint64)) << np.uint64(32)) | unpacked(low), unpacked(n).astype(np.int64))
                 for h, low, n in zip(*(table[c].to_pylist() for c in ("high", "low", "n")))]
        keys, counts = _merge(parts)
        save(folder, f"once-{j}", keys[counts == 1])
        save(folder, f"more-{j}", keys[counts > 1])
        save(folder, f"times-{j}", counts[counts > 1].astype(np.uint32))
        return pa.table({"part": pa.array([j], pa.int32()), **{f"n{c}": [int((counts == c).sum())] for c in (1, 2, 3, 4)}})

    rows = docs.mapInArrow(count, "part int, high binary, low binary, n binary")
    return _reduced(rows, "part", write, "part int, n1 long, n2 long, n3 long, n4 long", "pair-counts")


def _word_kinds(spark: SparkSession, parts: list[int], model: Model) -> DataFrame:
    folder, sizes = model.folder, model.sizes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.opened()
        low = np.uint64(0xFFFFFFFF)
        for j in (j for batch in batches for j in batch.column(0).to_pylist()):
            once, more, times = m.part("once", j), m.part("more", j), m.part("times", j)
            groups = [once >> np.uint64(32), more[times == 2] >> np.uint64(32), more[times > 2] >> np.uint64(32), np.concatenate([once & low, more & low])]
            numbers, at = np.unique(np.concatenate(groups), return_inverse=True)
            ends = np.cumsum([0, *map(len, groups)])
            columns = [np.bincount(at[a:b], minlength=len(numbers)) for a, b in zip(ends, ends[1:])]
            cut = np.searchsorted(numbers, m._starts.astype(np.uint64))
            for i in range(RANGES):
                part = slice(cut[i], cut[i + 1])
                if cut[i] < cut[i + 1]:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([packed(v)], pa.binary()) for v in (
                        np.diff(numbers[part] - np.uint64(m._starts[i]), prepend=np.uint64(0)), *(c[part] for c in columns)))],
                        names=["part", "at", "n1", "n2", "n3", "p"])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py()
        kinds = np.zeros((sizes[i], 4), dtype=np.uint32)
        for row in zip(*(table[c].to_pylist() for c in ("at", "n1", "n2", "n3", "p"))):
            at = np.cumsum(unpacked(row[0]), dtype=np.int64)
            for c in range(4):
                kinds[at, c] += unpacked(row[c + 1])
        save(folder, f"kinds-{i}", kinds)
        p = kinds[:, 3]
        return pa.table({"part": pa.array([i], pa.int32()), **{f"n{c}": [int((p == c).sum())] for c in (1, 2, 3, 4)}, "rest": [int((p > 2).sum())], "all": [int(p.sum(dtype=np.int64))]})

    rows = spark.createDataFrame([(j,) for j in parts], "part int").repartition(max(1, len(parts)), "part").mapInArrow(
        count, "part int, at binary, n1 binary, n2 binary, n3 binary, p binary")
    return _reduced(rows, "part", write, "part int, n1 long, n2 long, n3 long, n4 long, rest long, all long", "word-kinds")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pairs_per_shard: int = 2_000_000) -> Model:
    """Count words, then pairs, then each word's kinds of neighbours, over all documents that aren't held out.

    Tasks send sorted arrays of what they counted, one row per range or shard; each range and shard is merged by one task and written to the
    shared folder. Pairs are dealt by a hash of both words, so a frequent word's pairs are spread over all shards, and the number of shards
    follows the corpus. The driver gets a few sums per range and shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    folder = scratch_path(spark, "kneser-ney")
    found = {r["part"]: r for r in _word_counts(rows, folder).collect()}
    sizes = [found[i]["words"] if i in found else 0 for i in range(RANGES)]
    if sum(sizes) >= 1 << 32:
        raise ValueError("word numbers have 32 bits")
    tokens, vocabulary = (sum(r[c] for r in found.values()) for c in ("tokens", "vocabulary"))
    model = Model(folder, sizes, max(1, ceil(tokens / pairs_per_shard)), tokens, vocabulary, [0] * 4, [0] * 4, [0] * 4)
    if not found:
        model.shards = 0
        return model
    pairs = _pair_counts(rows, model).collect()
    model.pairs = [sum(r[f"n{c}"] for r in pairs) for c in (1, 2, 3, 4)]
    missing = set(range(model.shards)) - {r["part"] for r in pairs}
    for j in missing:  # of a tiny corpus: shards that no pair fell into
        save(folder, f"once-{j}", np.zeros(0, np.uint64))
        save(folder, f"more-{j}", np.zeros(0, np.uint64))
        save(folder, f"times-{j}", np.zeros(0, np.uint32))
    kinds = _word_kinds(spark, list(range(model.shards)), model).collect()
    model.before = [sum(r[f"n{c}"] for r in kinds) for c in (1, 2, 3, 4)]
    model.kinds = [model.before[0], model.before[1], sum(r["rest"] for r in kinds), sum(r["all"] for r in kinds)]
    return model


def _scores(model: Model, tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Per document: known tokens, base score and model score."""
    known, inverse = np.unique(tokens, return_inverse=True)
    number = model.numbers(known)
    order = np.argsort(number, kind="stable")  # unknown first
    counts, kinds = np.zeros(len(known), np.int64), np.zeros((len(known), 4), np.int64)
    seen = order[np.searchsorted(number[order], 0):]
    if len(seen):
        counts[seen] = model.gathered("counts", number[seen])
        kinds[seen] = model.gathered("kinds", number[seen], 4)
    base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
    # Lower order: by how many different words a word follows, the rest spread evenly over the vocabulary and one unknown word.
    d, total = discounts(model.before), model.kinds[3]
    even = sum(x * n for x, n in zip(d, model.kinds)) / total if total else 1.0
    lower = _less(kinds[:, 3], d) / max(total, 1) + even / (model.vocabulary + 1)

    doc = np.repeat(np.arange(len(sizes)), sizes)
    second = np.ones(len(tokens), dtype=bool)
    second[np.cumsum(sizes) - sizes] = False  # all but the starts
    at = np.flatnonzero(second)
    a, b = inverse[at - 1], inverse[at]
    p = lower[b].copy()
    use = np.flatnonzero((number[a] >= 0) & (counts[a] > 0))
    if len(use):
        a, b = a[use], b[use]
        d = discounts(model.pairs)
        back = (kinds[:, :3] @ np.array(d)) / np.maximum(counts, 1)
        both = np.flatnonzero(number[b] >= 0)
        pair = (number[a[both]].astype(np.uint64) << np.uint64(32)) | number[b[both]].astype(np.uint64)
        distinct, back_at = np.unique(pair, return_inverse=True)
        times = np.zeros(len(use), dtype=np.int64)
        times[both] = model.times(distinct)[back_at]
        p[use] = _less(times, d) / counts[a] + back[a] * lower[b]
    sums = [np.bincount(doc[at], weights=w, minlength=len(sizes)) for w in (counts[inverse[at]] > 0, base[inverse[at]], np.log10(p))]
    return [sums[0].astype(np.int64), *sums[1:]]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row, in one pass without a shuffle.

    Workers map the model's files and search the sorted arrays; a text's words and pairs are looked up once per group of documents.
    Null text is empty and has one token, its end; an unknown word gets the share of unseen words; a null doc_id is held out.
    Repeated rows come back as often; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.opened()
        for ids, tokens, sizes in _groups(batches, False):
            known, base, score = _scores(m, tokens, sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(sizes - 1, pa.int64()), pa.array(known, pa.int64()),
                pa.array(np.full(len(ids), m.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
