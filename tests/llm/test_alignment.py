"""Cross-tokenizer alignment against a plain version that tokenizes whole texts, and the perfect hash against its definition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_operators import ODD, frame, got

from replicalens.llm import alignment, queries
from replicalens.llm.perfect_hash import PerfectHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def plain(rows):
    """Rows of the contract, spelled groups in place of their hash."""
    tok, whole = alignment.tokenizers(A, B), Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    docs, counts = [], Counter()
    for d, t in rows:
        a = whole.encode(" " + (t or ""), add_special_tokens=False).ids
        b = tok.b.encode(t or "")
        bytes_a, bytes_b = [tok.bytes_a.tokens[i] for i in a], [tok.bytes_b.tokens[i] for i in b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            docs.append((d, [], [], [], []))
            continue
        spans = []
        for tokens, parts in ((a, bytes_a), (b, bytes_b)):
            at, side = 0, []
            for i, p in zip(tokens, parts):
                side.append((i, at, at + len(p)))
                at += len(p)
            spans.append(side)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, links, low, ia, ib = [], [], 0, 0, 0
        for end in ends:
            ga, gb = [], []
            while ia < len(a) and spans[0][ia][2] <= end:
                ga.append(spans[0][ia])
                ia += 1
            while ib < len(b) and spans[1][ib][2] <= end:
                gb.append(spans[1][ib])
                ib += 1
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            groups.append(f"{','.join(str(x[0]) for x in ga)}|{','.join(str(y[0]) for y in gb)}")
        counts.update(links)
        docs.append((d, a, b, groups, links))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    return sorted(((d, len(a), len(b), len(g), len(k), sum(counts[x] == highest[x[1]] for x in k), sum(counts[x] for x in k), ";".join(g))
                   for d, a, b, g, k in docs), key=str)


def odd_texts():
    rng = random.Random(5)
    marks = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "  ", "\t", "\n\n", " ", "　", "\x1c", "\x85", "\x00", "é", "é", "가", "日本語", "🙂", "'s", "'ll",
             "1234567", "a", "The", " ", " ", " ", "x" * 300, "ﬁ", "Å", "‍"]
    return [(i, "".join(rng.choice(marks) for _ in range(rng.randint(1, 30)))) for i in range(300)] + [(900, " "), (901, "  lead"), (902, "trail  "), (903, "a▁b")]


def test_alignment(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for df, plain_rows in ((docs, rows), (frame(spark, ODD).repartition(3), ODD), (frame(spark, odd_texts()).repartition(5), odd_texts())):
        counts = alignment.count_pairs(df, A, B, shards=5, fan_in=2)
        assert got(alignment.aligned(df, counts)) == plain(plain_rows)


def test_forgetful_tasks_give_the_same_rows(spark):
    """A memory of one segment is poured out and cleared after every batch."""
    df = frame(spark, ODD).repartition(2)
    counts = alignment.count_pairs(df, A, B, shards=3, segments=1)
    assert got(alignment.aligned(df, counts, segments=1)) == plain(ODD)


def test_null_and_repeated_ids(spark):
    rows = [(None, "some words here"), (None, None), (7, "some words here"), (7, "some words here")]
    df = frame(spark, rows)
    assert got(alignment.aligned(df, alignment.count_pairs(df, A, B))) == plain(rows)


def test_empty(spark):
    df = frame(spark, [(1, "x")]).limit(0)
    assert alignment.aligned(df, alignment.count_pairs(df, A, B)).count() == 0
    nothing = frame(spark, [(1, None), (2, "")])
    assert got(alignment.aligned(nothing, alignment.count_pairs(nothing, A, B))) == plain([(1, None), (2, "")])


def test_registered_query(spark):
    found = queries.QUERIES["op13_token_alignment"](spark, SF)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain(rows)]
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(found) == sorted(expected, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 100, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    hashed = PerfectHash.from_flat(PerfectHash.of(keys).flat())
    assert sorted(hashed.numbers(keys)) == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 63, 100, dtype=np.uint64), keys)
    own = np.empty_like(keys)
    own[hashed.numbers(keys)] = keys
    at = hashed.numbers(other)
    assert not ((at >= 0) & (own[at] == other)).any() if len(keys) else (at == -1).all()


def test_ranks_and_merges_give_the_same_tokens():
    listed, tok = alignment._listed_encoder(A), alignment.tokenizers(A, B)
    texts = [" " + t for _, t in odd_texts()] + [" " + (t or "") for _, t in ODD]
    assert tok.encode_a(texts) == listed(texts)
    assert tok.encode_a.__qualname__.startswith("_ranked")
