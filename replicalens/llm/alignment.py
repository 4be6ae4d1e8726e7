"""Alignment of two tokenizers' tokens, with corpus-wide counts of token pairs in dense vectors behind a minimal perfect hash."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.llm.array_files import load, save
from replicalens.llm.common import slices, summed_vectors
from replicalens.llm.perfect_hash import PerfectHash, mixed
from replicalens.session import materialize, scratch_path

#: Both tokenizers cut before a single space between two characters that are no white space, whatever stands around it.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 in turn."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Bytes:
    """The bytes of a vocabulary's tokens, in one row."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _ranked_encoder(model: dict, vocabulary: dict[int, bytes]):
    """Encoder of byte-level BPE whose ids are in the order of the merges, by ranks, which is several times as fast; None for other vocabularies."""
    import tiktoken

    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if ids != list(range(256, 256 + len(ids))):
        return None
    ranks = {vocabulary[i]: i for i in range(256 + len(ids))}
    encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: list(map(encoding.encode_ordinary, texts))


def _listed_encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@dataclass
class Tokenizers:
    """Tokenizers A (byte-level BPE) and B (pieces with byte fallback) and the bytes of their tokens."""

    path_a: str
    path_b: str

    def __post_init__(self) -> None:
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=self.path_b)
        with open(self.path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbol = _byte_of_symbol()
        vocabulary = {i: bytes(symbol.get(c, 63) for c in t) for t, i in model["vocab"].items()}
        self.bytes_a = _Bytes([vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)])
        self.encode_a = _ranked_encoder(model, vocabulary) or _listed_encoder(self.path_a)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = _Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces])
        #: Pieces that run over the end of a word would forbid cutting there.
        self.cuts = not any(re.search("[^▁]▁", p) for _, p in pieces)
        #: Every token of either side with each mark that can follow it, in turn.
        self.marked = [f"{i}{mark}" for mark in _MARKS for i in range(max(len(vocabulary), len(pieces)))]

    def segments(self, text: str) -> list[str]:
        """Space and text in parts that are tokenized alike alone and together."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return self.encode_a(segments), self.b.encode([s[1:] for s in segments], num_threads=1)


#: What follows a token in the spelling of groups: another of its side, the other side, another group, another segment.
_MARKS = (",", "|", ";", "\n")
#: One space, then no white space: such segments may also be tokenized side by side.
_CLEAN = re.compile(r" \S+")
TOGETHER = 256


@cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


@dataclass
class Segments:
    """Aligned segments, numbered from 0. Links of all segments in turn: ``keys`` (A id << 32 | B id), ``owner`` the segment's number."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    keys: np.ndarray
    owner: np.ndarray


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64)


def _tokens(tok: Tokenizers, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A and B, segment by segment, each segment's number of them, whether its tokens' bytes are its own (of others, no tokens), and the
    order of segments; ``good`` alone is by segment number.

    Clean segments are tokenized many at a time: both tokenizers cut between them. Bytes are compared over the lot, one by one only if they differ.
    """
    clean = np.array([_CLEAN.fullmatch(s) is not None for s in segments]) if tok.cuts else np.zeros(len(segments), bool)
    alike, others = np.flatnonzero(clean), np.flatnonzero(~clean)
    batches = [alike[i:i + TOGETHER] for i in range(0, len(alike), TOGETHER)] + [others[i:i + 1] for i in range(len(others))]
    order = np.concatenate(batches) if batches else np.zeros(0, np.int64)
    texts = ["".join([segments[i] for i in b]) for b in batches]
    sides = [_flat(x) for x in tok.encode(texts)]
    whole = "".join(texts).encode()
    ends = np.cumsum([len(segments[i].encode()) for i in order], dtype=np.int64)
    if all(t.joined(ids) == whole for t, ids in zip((tok.bytes_a, tok.bytes_b), sides)):
        good = np.ones(len(segments), bool)
        counts = [np.diff(np.searchsorted(np.cumsum(t.sizes[ids]), ends, "right"), prepend=0) for t, ids in zip((tok.bytes_a, tok.bytes_b), sides)]
        return *sides, *counts, good, order
    a, b = tok.encode(segments)
    good = np.array([tok.bytes_a.joined(np.array(x, np.int64)) == tok.bytes_b.joined(np.array(y, np.int64)) == s.encode() for s, x, y in zip(segments, a, b)], dtype=bool)
    a, b = ([x if g else [] for x, g in zip(ids, good)] for ids in (a, b))
    return _flat(a), _flat(b), *(np.array([len(x) for x in ids], np.int64) for ids in (a, b)), good, np.arange(len(segments))


def _spelled(tok: Tokenizers, ids: np.ndarray, group: np.ndarray, side: np.ndarray, segment: np.ndarray, segments: int) -> list[str]:
    """Groups of each segment, written out; tokens come by group and side."""
    last = np.zeros(len(ids), np.int64)
    last[:-1] = np.where(segment[1:] != segment[:-1], 3, np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1]))
    last[-1:] = 3
    words = len(tok.marked) // len(_MARKS)
    text = "".join(map(tok.marked.__getitem__, (last * words + ids).tolist()))
    out = [""] * segments
    for s, spelled in zip(segment[last == 3].tolist(), text.split("\n")):
        out[s] = spelled
    return out


def align(tok: Tokenizers, segments: list[str], spell: bool) -> Segments:
    """Groups and links of segments. All good segments are laid on one line of bytes, whose token ends are compared at once."""
    ids_a, ids_b, counts_a, counts_b, good, order = _tokens(tok, segments)
    end_a, end_b = np.cumsum(tok.bytes_a.sizes[ids_a]), np.cumsum(tok.bytes_b.sizes[ids_b])
    start_a, start_b = end_a - tok.bytes_a.sizes[ids_a], end_b - tok.bytes_b.sizes[ids_b]
    first, stop = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    closes = end_b[stop - 1] == end_a if len(ids_a) else np.zeros(0, bool)  # a B token ends where this A token does
    group_a = np.cumsum(closes) - closes
    group_b = np.searchsorted(end_a[closes], end_b)
    segment_a, segment_b = (np.repeat(order, c) for c in (counts_a, counts_b))
    overlaps = stop - first
    link_a = np.repeat(np.arange(len(ids_a)), overlaps)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(overlaps) - overlaps, overlaps) + np.repeat(first, overlaps)
    keys = (ids_a[link_a].astype(np.uint64) << np.uint64(32)) | ids_b[link_b].astype(np.uint64)
    groups = []
    if spell:
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        group = np.concatenate([group_a, group_b])
        turn = np.argsort(2 * group + side, kind="stable")
        groups = _spelled(tok, np.concatenate([ids_a, ids_b])[turn], group[turn], side[turn], np.concatenate([segment_a, segment_b])[turn], len(segments))
    n_a, n_b = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
    n_a[order], n_b[order] = counts_a, counts_b
    return Segments(good, n_a, n_b, np.bincount(segment_a[closes], minlength=len(segments)), groups, keys, segment_a[link_a])


class _Memory:
    """Segments of a task: each is aligned once and kept by number, until ``full`` says that they are too many."""

    def __init__(self, tok: Tokenizers, learn, limit: int):
        self.tok, self.learn, self.limit, self.at, self.size = tok, learn, limit, {}, 0

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Segment numbers of all texts in turn, each text's number of them, and the segments."""
        parts = [self.tok.segments(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.at))
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.size += sum(map(len, new))
            self.learn(new)
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.fromiter(map(self.at.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        return flat, sizes, parts

    def full(self) -> bool:
        return len(self.at) > self.limit or self.size > 50 * self.limit

    def clear(self) -> None:
        self.at.clear()
        self.size = 0


def _good_texts(good: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: it has segments, and all of them came back as the bytes they were."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return (sizes > 0) & (np.bincount(owner, ~good[flat], len(sizes)) == 0)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """All pairs of one B id lie in one shard."""
    return (mixed(keys & np.uint64(0xFFFFFFFF), 77) % np.uint64(shards)).astype(np.int64)


def _count_links(path_a: str, path_b: str, shards: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of this task's texts, counted by segment first: rows of one shard's keys and counts."""
        held: list[Segments] = []
        memory = _Memory(tokenizers(path_a, path_b), lambda new: held.append(align(memory.tok, new, False)), segments)
        node, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        total = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def poured() -> tuple[np.ndarray, np.ndarray]:
            parts, at = [total], 0
            for s in held:
                times = seen[at:at + len(s.good)][s.owner]
                parts.append((s.keys[times > 0], times[times > 0]))
                at += len(s.good)
            return _merge(*(np.concatenate(x) for x in zip(*parts)))

        def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            shard = _shard(keys, shards)
            for s in np.unique(shard).tolist():
                k, c = keys[shard == s].view(np.int64), counts[shard == s]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([node], pa.int64()), pa.array([k], pa.list_(pa.int64())),
                                                  pa.array([c], pa.list_(pa.int64()))], ["shard", "node", "keys", "counts"])

        for batch in slices(batches, 0, 1 << 21):
            flat, sizes, _ = memory.numbers(batch.column(0).to_pylist())
            good = np.concatenate([s.good for s in held]) if held else np.zeros(0, bool)
            used = flat[np.repeat(_good_texts(good, flat, sizes), sizes)]
            seen = np.pad(seen, (0, len(good) - len(seen))) + np.bincount(used, minlength=len(good))
            if memory.full():
                total = poured()
                held.clear()
                memory.clear()
                seen = np.zeros(0, np.int64)
                if len(total[0]) > 4_000_000:
                    yield from rows(*total)
                    total = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield from rows(*poured())

    return run


@dataclass
class PairCounts:
    """Counts of linked token pairs: per shard files of the hash, the keys in its order, their counts, and whether each count is its B id's highest."""

    folder: str
    path_a: str
    path_b: str
    shards: int

    def shard(self, s: int) -> tuple[PerfectHash, np.ndarray]:
        return PerfectHash.from_flat(load(self.folder, f"hash-{s}")), load(self.folder, f"keys-{s}").view(np.uint64)

    def places(self, s: int, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys`` in the vectors of shard ``s``; an unknown key is an error, for every key was built in."""
        hashed, own = self.shard(s)
        at = hashed.numbers(keys)
        if (at < 0).any() or (own[at] != keys).any():
            raise ValueError("a token pair is missing from the hash")
        return at


def _build_hash(counts: PairCounts):
    def run(group: pa.Table) -> pa.Table:
        s, keys = group.column("shard")[0].as_py(), group.column("key").to_numpy().view(np.uint64)
        hashed = PerfectHash.of(keys)
        own = np.empty_like(keys)
        own[hashed.numbers(keys)] = keys
        save(counts.folder, f"hash-{s}", hashed.flat())
        save(counts.folder, f"keys-{s}", own.view(np.int64))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    return run


def _dense(counts: PairCounts):
    def run(group: pa.Table) -> pa.Table:
        """Sparse counts of a few tasks as one dense vector, indexed by the hash."""
        s, node = group.column("shard")[0].as_py(), group.column("node")[0].as_py()
        total = np.zeros(len(load(counts.folder, f"keys-{s}")), np.int64)
        for keys, times in zip(group.column("keys"), group.column("counts")):
            total[counts.places(s, keys.values.to_numpy().view(np.uint64))] += times.values.to_numpy()
        return pa.table({"shard": pa.array([s], pa.int32()), "node": pa.array([node], pa.int64()), "vector": pa.array([total.tobytes()], pa.binary())})

    return run


def _finish(counts: PairCounts):
    def run(group: pa.Table) -> pa.Table:
        s, total = group.column("shard")[0].as_py(), np.frombuffer(group.column("vector")[0].as_buffer(), np.int64)
        _, inverse = np.unique(load(counts.folder, f"keys-{s}").view(np.uint64) & np.uint64(0xFFFFFFFF), return_inverse=True)
        highest = np.zeros(inverse.max() + 1, np.int64)
        np.maximum.at(highest, inverse, total)
        save(counts.folder, f"counts-{s}", total)
        save(counts.folder, f"best-{s}", highest[inverse] == total)
        return pa.table({"shard": pa.array([s], pa.int32())})

    return run


def count_pairs(docs: DataFrame, path_a: str, path_b: str, text: str = "text", shards: int = 64, fan_in: int = 16, segments: int = 250_000) -> PairCounts:
    """Corpus-wide counts of the token pairs that links hold, over whole texts.

    Each task counts its links and writes them per shard. Distinct pairs of a shard get a minimal perfect hash; then the tasks' counts become
    dense vectors indexed by it, ``fan_in`` tasks at a time, and are summed level by level until one vector a shard is left. A shard has at
    most (ids of A) x (ids of B) / ``shards`` pairs, however large the corpus; no other group is gathered. A task remembers up to ``segments`` segments
    (words, mostly) between batches.
    """
    spark = docs.sparkSession
    counts = PairCounts(scratch_path(spark, "pair-counts"), path_a, path_b, shards)
    parts = materialize(docs.select(F.col(text).alias("text")).mapInArrow(
        _count_links(path_a, path_b, shards, segments), "shard int, node long, keys array<long>, counts array<long>"), "task-pairs")
    distinct = parts.select("shard", F.explode("keys").alias("key")).distinct()
    distinct.groupBy("shard").applyInArrow(_build_hash(counts), "shard int, n long").write.format("noop").mode("overwrite").save()
    vectors = parts.withColumn("node", F.expr(f"node div {fan_in}")).groupBy("shard", "node").applyInArrow(_dense(counts), "shard int, node long, vector binary")
    vectors = summed_vectors(materialize(vectors, "pair-vectors"), fan_in)
    vectors.groupBy("shard").applyInArrow(_finish(counts), "shard int").write.format("noop").mode("overwrite").save()
    return counts


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _align_texts(counts: PairCounts, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, spelled, good = [np.zeros((0, 6), np.int64)], [], [np.zeros(0, bool)]
        places: dict[int, tuple] = {}

        def looked_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            shard = _shard(keys, counts.shards)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if not len(own):
                    continue
                s = int(shard[own[0]])
                if s not in places:
                    places[s] = (*counts.shard(s), load(counts.folder, f"counts-{s}"), load(counts.folder, f"best-{s}"))
                hashed, keys_of, counts_of, best_of = places[s]
                at = hashed.numbers(keys[own])
                known = (at >= 0) & (keys_of[at] == keys[own])
                count[own[known]], best[own[known]] = counts_of[at[known]], best_of[at[known]]
            return count, best

        def learn(new: list[str]) -> None:
            s = align(memory.tok, new, True)
            count, best = looked_up(s.keys)
            per = lambda x: np.bincount(s.owner, x, len(new)).astype(np.int64)
            # Sums in whole numbers: weights of bincount are doubles.
            sums = np.zeros(len(new), np.int64)
            np.add.at(sums, s.owner, count)
            numbers.append(np.stack([s.n_a, s.n_b, s.n_groups, per(np.ones(len(s.owner))), per(best), sums], axis=1))
            spelled.extend(s.groups)
            good.append(s.good)

        memory = _Memory(tokenizers(counts.path_a, counts.path_b), learn, segments)
        for batch in slices(batches, 1, 1 << 21):
            flat, sizes, _ = memory.numbers(batch.column(1).to_pylist())
            numbers[:], good[:] = [np.concatenate(numbers)], [np.concatenate(good)]
            fine = _good_texts(good[0], flat, sizes)
            ends = np.cumsum(sizes)
            sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(numbers[0][flat], axis=0)])
            out = np.where(fine[:, None], sums[ends] - sums[ends - sizes], 0)
            texts = [";".join([spelled[i] for i in flat[e - n:e].tolist()]) if f else "" for f, e, n in zip(fine, ends, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in out.T), pa.array(texts, pa.string())],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
            if memory.full():
                memory.clear()
                numbers[:], good[:] = [np.zeros((0, 6), np.int64)], [np.zeros(0, bool)]
                spelled.clear()

    return run


def aligned(docs: DataFrame, counts: PairCounts, doc_id: str = "doc_id", text: str = "text", segments: int = 250_000) -> DataFrame:
    """For every row: doc_id, numbers of A and B tokens, groups and links, links that are their B id's best, the links' counts summed, and the groups
    written out (``a1,a2|b1;a3|b2,b3``).

    Space and text are tokenized by A, the text by B, which adds the space itself; strings of special tokens are plain text. Byte offsets at which
    tokens of both end cut the tokens into groups; a link is an A and a B token whose bytes overlap. A null or empty text, or one whose tokens'
    bytes are not space and text, has no tokens: zeros and an empty string; it counts nowhere. A link's count is its pair's in ``counts``, 0 for a pair
    not counted there; ties for the best are all best. Repeated rows count and come back as often as they come in. Null ids are kept. An
    empty table gives no rows. Other columns are not read.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_align_texts(counts, segments), ALIGNED)
