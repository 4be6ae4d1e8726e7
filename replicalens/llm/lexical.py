"""Ranked lexical search: the best documents of every query, found in ball trees of impact vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replicalens.llm.ball_tree import BallTree, Sparse
from replicalens.llm.common import few, raw, slices
from replicalens.session import materialize

#: A to Z lower-cased, other bytes that belong to no term made spaces; all bytes from 0x80 belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return text.translate(_FOLD).split()


@dataclass
class Queries:
    """One block of queries: ids, each one's distinct terms as numbers, and the numbers of all terms."""

    ids: list
    terms: list[np.ndarray]
    numbers: dict[bytes, int]


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        terms = [sorted(set(terms_of(t))) for t in raw(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["query", "terms"])


def _blocks(asked: DataFrame, terms_per_block: int) -> Iterator[Queries]:
    """Queries in blocks of about ``terms_per_block`` terms, at least one query each, however many queries there are."""
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = -(-total // terms_per_block)
    for b in range(n):
        rows = asked.filter(F.pmod(F.xxhash64("query", "terms"), F.lit(n)) == b).filter(F.size("terms") > 0).collect()
        numbers: dict[bytes, int] = {}
        terms = [np.array([numbers.setdefault(bytes(t), len(numbers)) for t in r["terms"]], np.int64) for r in rows]
        if rows:
            yield Queries([r["query"] for r in rows], terms, numbers)


def _vectors(numbers: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Length and counts of the queries' terms, for every document with a term."""
        for batch in slices(batches, 1):
            at = 0
            for part in few(batch.column(1)):
                ids, sizes, columns, counts = [], [], [], []
                for i, text in enumerate(raw(part)):
                    terms = terms_of(text)
                    if terms:
                        found = Counter(map(numbers.get, terms))
                        found.pop(None, None)
                        ids.append(at + i)
                        sizes.append(len(terms))
                        columns.append(list(found))
                        counts.append(list(found.values()))
                at += len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), pa.array(columns, pa.list_(pa.int32())),
                                                  pa.array(counts, pa.list_(pa.int64()))], ["doc", "n", "terms", "counts"])

    return run


def impacts(counts: np.ndarray, weights: np.ndarray, n: int, documents: int, tokens: int) -> np.ndarray:
    """What each term of a document of ``n`` terms adds to a score."""
    m = 100 - 90 + 90 * n * documents // tokens
    return weights * (1_000_000_000 * counts // (1000 * counts + 8 * m))


def _best(k: int):
    """A list of the ``k`` best (score, doc), equal scores by ascending doc, null last, and the score that a new one must reach."""
    rows: list[tuple] = []

    def add(found: Iterator[tuple]) -> None:
        rows.extend(found)
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        del rows[k:]

    return rows, add, lambda: rows[-1][0] if len(rows) == k else 1


def _search(asked: Queries, weights: np.ndarray, documents: int, tokens: int, k: int, leaf: int, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of this task's documents for each query. Trees of bounded size are built one after another; the scores reached so far prune the next."""
        width = len(asked.numbers)
        best = [_best(k) for _ in asked.ids]
        most = leaf * max(1, entries // width)  # a tree's centroids are no more than a few times ``entries`` numbers
        docs, columns, values, size = [], [], [], 0

        def searched() -> None:
            rows = Sparse(np.concatenate([[0], np.cumsum([len(c) for c in columns])]), np.concatenate(columns), np.concatenate(values))
            tree = BallTree(rows, width, leaf)
            for terms, (_, add, least) in zip(asked.terms, best):
                for found, scores in tree.search(terms, least):
                    add((s, docs[i]) for i, s in zip(found.tolist(), scores.tolist()))

        for batch in batches:
            for doc, n, t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                t, c = t.values.to_numpy(), c.values.to_numpy()
                if not len(t):
                    continue
                docs.append(doc)
                columns.append(t)
                values.append(impacts(c, weights[t], n, documents, tokens))
                size += len(t)
                if size >= entries or len(docs) >= most:
                    searched()
                    docs, columns, values, size = [], [], [], 0
        if docs:
            searched()
        for q, (rows, _, _) in enumerate(best):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(rows), pa.int32()), pa.array([d for _, d in rows], pa.int64()),
                                                  pa.array([s for s, _ in rows], pa.int64())], ["q", "doc_id", "score"])

    return run


def _top(df: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text",
           k: int = 10, terms_per_block: int = 20_000, leaf: int = 64, entries: int = 4_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` documents of highest score above 0, fewer if there are not so many.

    A score is the sum of the impacts of the query's distinct terms: whole numbers from term count, document length and a term weight. Queries are
    taken in blocks of about ``terms_per_block`` terms. For each block all documents become sparse vectors over its terms; each task builds ball
    trees of up to ``entries`` numbers, and searches them best bound first; the scores it has reached prune later trees. Only ``k`` rows per query leave a task, and the best
    are taken in two steps. A result is exact: bounds are rounded outward, scores are 64-bit sums.

    Null texts have no terms: such documents are in no count or result, such queries have no rows. Equal scores rank by ascending doc_id, a null one
    last; repeated rows rank each by itself. Queries with the same id are answered each by itself. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = materialize(queries.select(F.col(query_id).cast("long").alias("query"), F.col(query_text).alias("text")).mapInArrow(
        _query_terms, "query long, terms array<binary>"), "queries")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    out = None
    for block in _blocks(asked, terms_per_block):
        vectors = materialize(texts.mapInArrow(_vectors(block.numbers), "doc long, n long, terms array<int>, counts array<long>"), "term-vectors")
        documents, tokens = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            break
        weights = np.zeros(len(block.numbers), np.int64)
        for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a block's terms at most
            weights[term] = floor(1000 * log((2 * documents + 2) / (2 * df + 1)))
        found = vectors.mapInArrow(_search(block, weights, documents, tokens, k, leaf, entries), "q int, doc_id long, score long")
        first = _top(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))), ["q", "salt"], k).drop("rank", "salt")
        ids = spark.createDataFrame([(q, i) for q, i in enumerate(block.ids)], "q int, item_id long")
        ranked = _top(first, ["q"], k).join(ids, "q").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionAll(ranked)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
