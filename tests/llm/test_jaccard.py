"""The Jaccard join against all pairs, on tables and on built families of sets that take several turns."""

from __future__ import annotations

import random

import pytest
from tests.llm.test_operators import ODD, SF, frame, got

from replicalens.llm import jaccard


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def plain(rows, width=4, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(x), least.get(find(i))) for i, ((d, _), x) in enumerate(zip(rows, sets))), key=str)


def edited(rng, words, edits, fresh):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"{fresh}{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"{fresh}{rng.randrange(10**6)}")
        elif len(out) > 5:
            del out[at]
    return out


def families(seed, base=60, members=10, depth=2):
    """Texts near a common base, near one another's variants, excerpts and joined texts, so that cells hold many sets that are not linked."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for f in range(3):
        root = [rng.choice(words) for _ in range(base)]
        level = [root]
        for d in range(depth):
            level = [edited(rng, rng.choice(level), rng.randint(0, 4), f"f{f}d{d}") for _ in range(members)]
            texts += level
        texts += [root[rng.randrange(20):base - rng.randrange(20)] for _ in range(members // 4)]
        texts += [root + [rng.choice(words) for _ in range(rng.randrange(base))] for _ in range(members // 4)]
    return [(i * 17 % 10_007, " ".join(t)) for i, t in enumerate(texts)]


def test_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(jaccard.similar_documents(docs)) == plain(rows)


def test_odd_rows(spark):
    rows = [*ODD, (None, "a b c d e f"), (None, None), (None, ""), (900, "a b c d e f"), (901, "A  b"), (902, "a B"), (None, "lone words stay here alone"), (5, "x y"), (5, "x y z")]
    assert got(jaccard.similar_documents(frame(spark, rows).repartition(3))) == plain(rows)
    assert jaccard.similar_documents(frame(spark, rows).limit(0)).count() == 0
    assert got(jaccard.similar_documents(frame(spark, [(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("seed,percent,width,leaf", [(1, 85, 4, 512), (2, 85, 4, 3), (3, 70, 4, 12), (4, 50, 3, 3), (5, 95, 1, 12)])
def test_families(spark, seed, percent, width, leaf, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 5)
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rows = families(seed)
    found = got(jaccard.similar_documents(frame(spark, rows).repartition(4), width=width, percent=percent))
    expected = plain(rows, width, percent)
    assert found == expected
    assert len({r[2] for r in expected}) > 1
