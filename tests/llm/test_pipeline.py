"""The corpus pipeline stage by stage, and the oracles of this subpackage."""

from __future__ import annotations

import pytest
from tests.compare import compare, duck
from tests.llm import brute

import corpus_pipeline
from replicalens.llm import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    ok, message = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    sizes = [before]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).persist()
        assert out.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
        if name == "exact dedup":
            assert len({t for _, t in rows}) == len(rows) == docs.select("text").distinct().count()
        if name == "near dedup":
            plain = brute.simhash([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert sorted(d for d, _ in rows) == sorted({c for _, _, c in plain})
        sizes.append(len(rows))
        docs = out
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[1] > 0.6 * before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))
