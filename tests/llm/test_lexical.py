"""Lexical search against a plain scan of all documents, and ball trees against all scores."""

from __future__ import annotations

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from tests.llm.test_operators import ODD, SF, frame, got

from replicalens.llm import lexical
from replicalens.llm.ball_tree import BallTree, Sparse

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k=10):
    docs = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"terms_per_block": 100, "leaf": 2, "entries": 300}])
def test_search(spark, options):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert got(lexical.search(docs, bench, **options)) == plain(rows, items)
    odd_items = [(1, ODD[5][1]), (2, None), (3, ""), (4, "A the W"), (4, "idiot"), (None, "one"), (5, "nowhere#to|be found, É")]
    asked = spark.createDataFrame([(i, t, 7) for i, t in odd_items], "item_id long, text string, doc_id int")
    odd = [*ODD, (None, "one two"), (None, "one"), (8, "one")]
    assert got(lexical.search(frame(spark, odd).repartition(3), asked, **options)) == plain(odd, odd_items)


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(frame(spark, [(1, None), (2, "-")]), items).count() == 0
    assert got(lexical.search(docs, items)) == plain([(1, "a b")], [(1, "a")])


@pytest.mark.parametrize("seed", range(6))
def test_ball_tree_finds_every_row_at_the_threshold(seed):
    rng = np.random.default_rng(seed)
    n, width = 700, 50
    sizes = rng.integers(1, 12, n)
    columns = np.concatenate([rng.choice(width, s, replace=False) for s in sizes])
    values = rng.integers(1, 20_000_000_000 if seed % 2 else 5, len(columns))
    rows = Sparse(np.concatenate([[0], np.cumsum(sizes)]), columns, values)
    tree = BallTree(rows, width, leaf=1 + 8 * (seed % 3))
    for _ in range(20):
        query = rng.choice(width, rng.integers(1, 15), replace=False)
        scores = np.array([values[a:b][np.isin(columns[a:b], query)].sum() for a, b in zip(rows.starts, rows.starts[1:])])
        least = np.sort(scores)[-10]
        found = {int(r): int(s) for part, s in zip(*zip(*tree.search(query, lambda: least))) for r, s in zip(part, s)} if least else {}
        assert not least or found == {int(i): int(scores[i]) for i in np.flatnonzero(scores >= least)}


def test_pruning_skips_leaves():
    """Far clusters: a search for one cluster's terms scores that cluster's rows and few others."""
    n = 4096
    columns = (np.arange(n) % 16)[:, None] * 4 + np.arange(4)
    rows = Sparse(np.arange(0, 4 * n + 1, 4), columns.ravel(), np.full(4 * n, 1000) + np.arange(4 * n) % 7)
    tree, seen = BallTree(rows, 64), 0
    for part, _ in tree.search(np.arange(4), lambda: 3900):
        seen += len(part)
    assert seen == n // 16
