"""Quality rules: repetition inside a document by suffix array and LCP intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.llm.common import slices

# Characters that count as symbols: fixed values.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "covered_words", "longest_repeat"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def suffix_array(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes of several documents and the ranks of each doubling step.

    ``words``: (document, word) ids; ``ends``: for each position the position after its document's last. A suffix ends with its
    document, whose end sorts first. Step j ranks by the first 2**j words: equal words have equal ranks, a class's rank is its
    first place in the order. Suffixes alone in their class are in place and leave the work.
    """
    order = np.argsort(words, kind="stable")
    rank = _classes(words[order], order, len(words))
    steps, span = [rank], 1
    active = _crowded(rank)
    while active.size:
        follow = active + span
        inside = follow < ends[active]
        second = np.where(inside, rank[np.where(inside, follow, 0)] + 1, 0)
        key = rank[active].astype(np.int64) * (len(words) + 1) + second
        order = np.argsort(key, kind="stable")
        rank = rank.copy()
        rank[active[order]] = _refined(key[order], len(words) + 1)
        steps.append(rank)
        active = active[order][_shared(rank[active[order]])]
        span *= 2
    return rank, steps


def _classes(keys: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, dtype=np.int64)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    return rank


def _refined(keys: np.ndarray, base: int) -> np.ndarray:
    """New ranks of sorted (rank, second) keys: the old rank plus the place of the key's first row in its class."""
    n, old = len(keys), keys // base
    new_class, new_old = np.r_[True, keys[1:] != keys[:-1]], np.r_[True, old[1:] != old[:-1]]
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(new_class, place, 0))
    return old + start - np.maximum.accumulate(np.where(new_old, place, 0))


def _shared(sorted_ranks: np.ndarray) -> np.ndarray:
    same = sorted_ranks[1:] == sorted_ranks[:-1]
    return np.r_[False, same] | np.r_[same, False] if len(sorted_ranks) else np.zeros(0, dtype=bool)


def _crowded(rank: np.ndarray) -> np.ndarray:
    order = np.argsort(rank, kind="stable")
    return order[_shared(rank[order])]


def longest_common_prefixes(rank: np.ndarray, steps: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and, for each of its places, the common prefix with the suffix before it, in words."""
    n = len(rank)
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    lcp = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(steps[0][suffixes[1:]] == steps[0][suffixes[:-1]]) + 1
    a, b = suffixes[at], suffixes[at - 1]
    length = np.zeros(len(at), dtype=np.int64)
    for j in range(len(steps) - 1, -1, -1):
        x, y = a + length, b + length
        ok = np.flatnonzero((x < ends[a]) & (y < ends[b]))
        same = ok[steps[j][x[ok]] == steps[j][y[ok]]]
        length[same] += 1 << j
    lcp[at] = length
    return suffixes, lcp


def maximal_repeats(suffixes: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[int]:
    """One position of each maximal repeat of ``least`` words or more: an LCP interval whose suffixes don't all follow the same word.

    ``before`` is what stands before each position, a text's first position having its own value. Intervals are closed from a stack, which holds
    for each the one value before its suffixes, or None once they differ.
    """
    found = []
    deep = np.flatnonzero(lcp >= least)
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        if not len(run):
            continue
        stack: list[list] = []
        heights = [*lcp[run].tolist(), 0]
        at = suffixes[np.r_[run - 1, run[-1:]]].tolist()
        lefts = before[at].tolist()
        for height, position, carry in zip(heights, at, lefts):
            while stack and stack[-1][0] > height:
                _, left = stack.pop()
                carry = carry if left == carry else None
                if carry is None:
                    found.append(position)
            if stack and stack[-1][0] == height:
                stack[-1][1] = carry if stack[-1][1] == carry else None
            elif height:
                stack.append([height, carry])
    return found


def repetition(documents: list[list[bytes]], least: int) -> np.ndarray:
    """Per document: words in repeated 3-word windows, maximal repeats of at least ``least`` words, words they cover, longest repeat."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    out = np.zeros((len(documents), 4), dtype=np.int64)
    n = int(sizes.sum())
    if not n:
        return out
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for d in documents for w in d), dtype=np.int64, count=n)
    doc = np.repeat(np.arange(len(documents)), sizes)
    last = np.cumsum(sizes)
    ends = last[doc]
    rank, steps = suffix_array(doc * len(known) + ids, ends)
    suffixes, lcp = longest_common_prefixes(rank, steps, ends)
    longest = np.zeros(n, dtype=np.int64)  # longest repeat that starts at each position
    longest[suffixes] = np.maximum(lcp, np.r_[lcp[1:], 0])

    def covered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + lengths, -1)
        return np.bincount(doc, weights=np.cumsum(edge)[:n] > 0, minlength=len(documents)).astype(np.int64)

    three, deep = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= least)
    out[:, 0] = covered(three, np.full(len(three), 3))
    before = np.r_[-1, ids[:-1]]
    before[(last - sizes)[sizes > 0]] = -1 - np.flatnonzero(sizes > 0)
    out[:, 1] = np.bincount(doc[np.array(maximal_repeats(suffixes, lcp, before, least), np.int64)], minlength=len(documents))
    out[:, 2] = covered(deep, longest[deep])
    np.maximum.at(out[:, 3], doc, longest)
    return out


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def repetition_counts(docs: DataFrame, least: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_repeats, covered_words, longest_repeat) per row.

    Each document's words get a suffix array by prefix doubling; intervals of its LCP array at ``least`` words or more are its maximal
    repeats, and the union of their occurrences is ``covered_words``. Many documents are sorted together, up to 4 MB of text; a longer one by
    itself, in memory of some 100 bytes a word. Rows stay where they are: there is no shuffle. Null text has no words;
    an empty text or table gives zeros or no rows; repeated rows come back as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            data = [t.encode() for t in texts]
            words = [t.split() for t in data]
            found = repetition(words, least)
            columns = [
                [len(w) for w in words], [len(t) - sum(map(t.count, SPACE)) for t in texts], [sum(map(t.count, SYMBOLS)) for t in texts],
                [_duplicate_lines(t) for t in data], *(found[:, i] for i in range(4)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def repetition_rules(docs: DataFrame, least: int = 8, max_fraction: float = 0.4, max_repeat: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``repetition_counts`` with ``base_failed``, ``covered_fraction`` and ``kept``.

    Base: fewer than 50 words, or over half of the words in repeated 3-word windows. Of the rest a document is kept if at most ``max_fraction`` of its words
    lie in repeats of ``least`` words or more and no repeat is longer than ``max_repeat`` words.
    """
    counts = repetition_counts(docs, least, doc_id, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fraction = F.when(F.col("n_words") > 0, F.col("covered_words") / F.col("n_words")).otherwise(0.0)
    out = counts.withColumns({"base_failed": failed, "covered_fraction": fraction})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("covered_fraction") <= max_fraction) & (F.col("longest_repeat") <= max_repeat))
