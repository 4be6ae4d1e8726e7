"""Removal of word passages that repeat across documents, by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.llm.common import LAST_ID, WordHashes, raw, slices
from replicalens.session import materialize

#: Words of the prefix by which suffixes are first dealt into groups.
PREFIX = 16
# Odd multipliers of the prefix hash, one per doubling: fixed values.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

_HASHES = WordHashes()
_HASHES.limit = 400_000


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hash of the PREFIX words from each position on, as far as there are so many."""
    g, step = words, 1
    for odd in ODD:
        g = g[:-step] * np.uint64(odd) + g[step:]
        step *= 2
    g = (g ^ (g >> np.uint64(29))) * np.uint64(ODD[0])
    return g ^ (g >> np.uint64(32))


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """For each run of ``n`` neighbours of ``g``, the place of its first smallest value."""
    at, step = np.arange(len(g)), 1
    while step < n:
        shift = min(step, n - step)
        left, right = at[:-shift], at[shift:]
        at = np.where(g[left] <= g[right], left, right)
        step += shift
    return at


def runs(documents: list[list[bytes]], window: int) -> list[tuple[np.ndarray, ...]]:
    """Per document: first window, windows, prefix hash and place of each run of windows that share their prefix.

    A window's prefix is, of the PREFIX-word prefixes of the suffixes that start in it and lie within it, the one of smallest hash: equal windows have
    equal ones, and some twenty neighbouring windows share one. So suffixes are dealt by it in runs, not one by one.
    """
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    out = [nothing] * len(documents)
    long = [i for i, d in enumerate(documents) if len(d) >= window]
    if not long:
        return out
    sizes = np.array([len(documents[i]) for i in long], dtype=np.int64)
    n = int(sizes.sum())
    words = np.fromiter((_HASHES[w] for i in long for w in documents[i]), dtype=np.uint64, count=n)
    g = _prefixes(words)
    at = _least(g, window - PREFIX + 1)[:n - window + 1]
    doc = np.repeat(np.arange(len(long)), sizes)
    whole = doc[:len(at)] == doc[window - 1:]
    new = np.r_[True, (at[1:] != at[:-1]) | ~whole[:-1]] & whole
    first = np.flatnonzero(new)
    ends = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True])
    begin = np.cumsum(sizes) - sizes
    cut = np.searchsorted(doc[first], np.arange(len(long) + 1))
    for k, i in enumerate(long):
        part = slice(cut[k], cut[k + 1])
        f = first[part]
        out[i] = (f - begin[k], ends[part] - f + 1, g[at[f]], at[f] - begin[k])
    return out


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 2 << 20):
            found = [np.unique(f[2], return_counts=True) for f in runs([t.split() for t in raw(batch.column(2))], window)]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate([f[0] for f in found]).view(np.int64)),
                                                  pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))], names=["id", "th", "prefix", "n"])

    return run


def _suffixes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("id", pa.int64()), ("th", pa.int64()), ("prefix", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary()),
                 ("name", pa.binary()), ("starts", pa.list_(pa.int32()))]
        for batch in slices(batches, 2, 2 << 20):
            documents = [t.split() for t in raw(batch.column(2))]
            rows = []
            columns = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for (id_, th, usual, hot), words, (first, n, prefix, _) in zip(zip(*columns), documents, runs(documents, window)):
                prefix = prefix.view(np.int64)
                for k in np.flatnonzero(np.isin(prefix, usual)):
                    start, count = int(first[k]), int(n[k])
                    rows.append((id_, th, int(prefix[k]), start, count, b" ".join(words[start:start + count + window - 1]), None, None))
                leaves: dict[bytes, list[int]] = {}  # the prefix grows to the whole window
                for k in np.flatnonzero(np.isin(prefix, hot)):
                    for s in range(int(first[k]), int(first[k] + n[k])):
                        leaves.setdefault(hashlib.sha256(b" ".join(words[s:s + window])).digest(), []).append(s)
                rows += [(id_, th, None, None, None, None, name, starts) for name, starts in leaves.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

    return run


def repeated_windows(words: np.ndarray, ends: np.ndarray, starts: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """For each of ``starts``, the smallest owner of a start whose ``window`` words are the same; its own if it is alone.

    Suffixes get the numbers of their nodes at word depths 1, 2, 4, ... and last ``window`` of the suffix tree: a node at twice
    the depth is a pair of nodes. A suffix alone in its node is a leaf and leaves the work.
    """
    node, depth = words.astype(np.int64), 1
    while depth < window:
        step = min(depth, window - depth)
        places = np.arange(len(node))
        inside = np.flatnonzero((node >= 0) & (places + step + depth <= ends))
        inside = inside[node[inside + step] >= 0]
        after = np.full(len(node), -1, dtype=np.int64)
        if len(inside):
            pairs = node[inside] * (int(node.max()) + 1) + node[inside + step]
            _, number, size = np.unique(pairs, return_inverse=True, return_counts=True)
            after[inside] = np.where(size[number] > 1, number, -1)
        node, depth = after, depth + step
    out = owners.copy()
    alive = np.flatnonzero(node[starts] >= 0)
    if len(alive):
        at = node[starts[alive]]
        least = np.full(int(at.max()) + 1, LAST_ID, dtype=np.int64)
        np.minimum.at(least, at, owners[alive])
        out[alive] = least[at]
    return out


def _tree(window: int):
    def run(table: pa.Table) -> pa.Table:
        """Spans of one group's windows that also start in a document of smaller id."""
        parts = [w.split(b" ") for w in table["words"].to_pylist()]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        known: dict[bytes, int] = {}
        words = np.fromiter((known.setdefault(w, len(known)) for p in parts for w in p), dtype=np.int64, count=int(sizes.sum()))
        last = np.cumsum(sizes)
        id_, th, start, n = (np.asarray(table[c].to_numpy()) for c in ("id", "th", "start", "n"))
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        first = repeated_windows(words, np.repeat(last, sizes), (last - sizes)[row] + offset, id_[row], window)
        hit = np.flatnonzero(first < id_[row])
        row, at = row[hit], offset[hit]
        new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)] if len(hit) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(hit)] - 1 if len(hit) else begin
        return pa.table({"id": id_[row[begin]], "th": th[row[begin]], "begin": (start[row[begin]] + at[begin]).astype(np.int32), "end": (start[row[end]] + at[end] + window).astype(np.int32)})

    return run


def repeat_spans(docs: DataFrame, window: int = 50, group: int = 8_000, hot: int = 4_000) -> DataFrame:
    """(id, th, spans, leaves) of documents with words to remove: begin and end of stretches of windows that also start in a document of
    smaller id, and lists of single such windows' starts.

    ``docs`` has ``id``, ``th`` (a hash of the text) and ``text``. In turn: suffixes are dealt by the prefix of their window, in runs; prefixes that occur in
    one document only are leaves and leave the work; runs of the others, with their words, are gathered into groups of about ``group`` runs and each
    group's suffix tree gives the repeats down to ``window`` words. A prefix with more than ``hot`` runs would make a group too large: it is
    lengthened to the whole window, whose SHA-256 names a leaf of the tree that all its windows reach, and the smallest id of
    each such leaf is an aggregate that combines before the shuffle. So no group grows with a passage's number of copies.
    """
    anchors = materialize(docs.mapInArrow(_anchors(window), "id long, th long, prefix long, n long"), "anchors")
    shared = anchors.groupBy("prefix").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("n").alias("n")).filter("first < last")
    flagged = anchors.drop("n").join(shared.select("prefix", (F.col("n") > hot).alias("crowded")), "prefix")
    those = lambda crowded: F.collect_set(F.when(F.col("crowded") == crowded, F.col("prefix")))
    flagged = flagged.groupBy("id", "th").agg(those(False).alias("usual"), those(True).alias("hot"))  # as many as a document has runs
    found = docs.join(flagged, ["id", "th"]).select("id", "th", "text", "usual", "hot")
    found = found.mapInArrow(_suffixes(window), "id long, th long, prefix long, start int, n int, words binary, name binary, starts array<int>")
    found = materialize(found, "suffixes")
    usual = found.filter("name is null").drop("name", "starts")
    groups = max(1, ceil(usual.count() / group))
    spans = usual.withColumn("group", F.pmod(F.xxhash64("prefix"), F.lit(groups))).groupBy("group").applyInArrow(_tree(window), "id long, th long, begin int, end int")
    named = found.filter("name is not null").select("name", "id", "th", "starts")
    least = named.groupBy("name").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    leaves = named.join(least.drop("last"), "name").filter("first < id").select("id", "th", "starts")
    both = spans.select("id", "th", F.struct("begin", "end").alias("span")).unionByName(leaves, allowMissingColumns=True)
    return both.groupBy("id", "th").agg(F.collect_set("span").alias("spans"), F.collect_set("starts").alias("leaves"))


def _without(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 2 << 20):
            rows = []
            for doc, text, spans, leaves in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                gone = [(s["begin"], s["end"]) for s in spans or ()] + [(s, s + window) for starts in leaves or () for s in starts]
                kept, at = [], 0
                for begin, end in sorted(gone):
                    kept += words[at:begin]
                    at = max(at, end)
                kept += words[at:]
                rows.append((doc, len(words), len(words) - len(kept), b" ".join(kept)))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()).cast(pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row: each word that a repeated window covers is gone.

    A window is ``window`` words of one document (cut at 0x20 and 0x09-0x0D), and repeated if its words also start in a document of smaller
    doc_id; windows are judged on the whole input. Kept words are joined by one space. Null text has no words. A null doc_id counts as the
    largest. Rows of one doc_id never remove from each other; repeated rows come back as often. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST_ID)).alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    spans = repeat_spans(rows.select("id", "th", "text"), window, **sizes)
    joined = rows.join(spans, ["id", "th"], "left").select("doc_id", "text", "spans", "leaves")
    return joined.mapInArrow(_without(window), "doc_id long, n_words long, n_removed long, kept_text string")
