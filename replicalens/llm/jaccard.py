"""Exact Jaccard join of documents in metric space: regions around pivots, windows by the triangle inequality, recursion.

Sets link at a similarity of ``percent`` or more, that is at a distance of ``eps`` = 1 - percent/100 or less; the distance 1 - |x & y| / |x | y| is a
metric. A region is what lies in the cells of one pivot, and a pivot is always measured exactly against every member of its cells:

* First cells. Most sets share nothing, so a set is at distance 1 from almost every document, and documents are poor first pivots. The
  first pivots are single shingles: a set lies at 1 - 1/n from each of its own n shingles and at 1 from all others. Ties are ordered, rare shingles
  first; linked sets share one of their first t + 1 shingles, t being the most that one can have beside the other. So each set is copied into those cells,
  and into two neighbouring size classes, as linked sets differ in size by at most 1/percent.
* Pivots. The pivot of a cell is its most typical member (its shingles are the commonest); a crowded deeper cell has several, and each
  member goes to the nearest one's region (Voronoi) and, as a boundary set, to every other at most 2 eps farther.
* Windows. Within the region of a pivot p, linked sets have |d(x, p) - d(y, p)| <= eps: a set is copied into its ring of width eps and the next.
* Recursion. Sets of one ring meet again by what tells them from the pivot: by x - p if both have more than t beyond p; or else by the
  symmetric difference with p, near p. Near sets that share none of it are linked only if both are linked to p.

* Bounds. Merging shingles only brings sets closer, so the distance of their histograms over BINS hash classes, a byte each, is a lower bound. It
  rules most pairs out before texts are fetched.

Cells whose members are in one component already are done. Each turn measures one pivot per cell, never all pairs, and its cells hold only
members ranked below their pivot, so the turns end. After a turn, what is left of a region in unfinished cells is joined in one task if it is small (LEAF
sets and LEAF_SHINGLES shingles). Larger ones take another turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replicalens.llm.common import few, raw, slices
from replicalens.llm.components import components
from replicalens.llm.shingle_sets import Counts, count_shingles, shingle_set
from replicalens.session import materialize

#: Cells of more members than this have several pivots, in the first few turns.
CROWD, PIVOTS, SPLIT_TURNS = 64, 4, 3
#: The largest region, in sets and in shingles, that one task joins.
LEAF, LEAF_SHINGLES = 8192, 4_000_000
#: Cells of the histogram that bounds distances from below.
BINS = 64
LONGS = pa.list_(pa.int64())
MEASURED = "x long, p long, n_x long, n_p long, shared long, far array<long>, near array<long>"


def beyond(n: int, percent: int) -> int:
    """The most shingles that a set of n can have beside a linked set."""
    return n - -(-percent * n // 100)


def histogram(shingles: np.ndarray) -> np.ndarray:
    """How many of a set's shingles fall into each class, 255 at most: differences of these never exceed those of the sets."""
    return np.minimum(np.bincount((shingles >> np.uint64(7)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8)


def _sets(counts: Counts, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text: digest and size of its set, how common its shingles are, and its first shingles."""
        for batch in slices(batches, 2):
            digests, sizes, scores, firsts, bins = [], [], [], [], []
            for part in few(batch.column(2)):
                for text in raw(part):
                    s = shingle_set(text, width)
                    digests.append(hashlib.md5(s.tobytes()).digest())
                    sizes.append(len(s))
                    scores.append(float(np.log2(counts.of(s)).mean()) if len(s) else 0.0)
                    firsts.append(counts.ordered(s)[:beyond(len(s), percent) + 1].view(np.int64))
                    bins.append(histogram(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(scores),
                                              pa.array(firsts, LONGS), pa.array(bins, pa.binary())], ["doc_id", "text_key", "digest", "n", "score", "firsts", "bins"])

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of shingles that sets with these histograms differ in."""
    return np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=-1, dtype=np.int64)


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(x, p) of ``pairs`` that their histograms don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (3, 4)]
            fine = (100 + percent) * _apart(*bins) <= (100 - percent) * batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(fine))

    own = classes.select("x", F.col("n").alias("n_x"), F.col("bins").alias("bins_x"))
    other = classes.select(F.col("x").alias("p"), F.col("n").alias("n_p"), F.col("bins").alias("bins_p"))
    return pairs.join(own, "x").join(other, "p").select("x", "p", (F.col("n_x") + F.col("n_p")).alias("n"), "bins_x", "bins_p").mapInArrow(run, "x long, p long")


def _measured(counts: Counts, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact overlap of a set and a pivot, and the first shingles of what tells the set from the pivot, far and near."""
        for batch in slices(batches, 2, 1 << 22):
            out: list[tuple] = []
            for tx, tp in zip(raw(batch.column(2)), raw(batch.column(3))):
                x, p = shingle_set(tx, width), shingle_set(tp, width)
                both = np.intersect1d(x, p, assume_unique=True)
                n, rest = len(x), np.setdiff1d(x, both, assume_unique=True)
                t = beyond(n, percent)
                far = counts.ordered(rest)[:t + 1] if len(rest) > t else rest[:0]
                near = rest[:0]
                if 100 * percent * len(rest) <= n * (100 - percent) * (100 + percent):
                    differ = np.concatenate([rest, np.setdiff1d(p, both, assume_unique=True)])
                    near = counts.ordered(differ)[:(100 - percent) * n // percent + 1]
                out.append((len(x), len(p), len(both), far.view(np.int64), near.view(np.int64)))
            n_x, n_p, shared, far, near = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n_x, n_p, shared)), pa.array(far, LONGS),
                                              pa.array(near, LONGS)], ["x", "p", "n_x", "n_p", "shared", "far", "near"])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame, share: int = 1000) -> DataFrame:
    """(x, p, tx, tp). A pivot with many pairs is met in parts of about ``share``, each with its own copy of the pivot's text."""
    parts = pairs.groupBy("p").agg((F.floor(F.count(F.lit(1)) / share) + 1).cast("int").alias("parts"))
    pivots = texts.join(parts, F.col("x") == F.col("p")).select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("tp"))
    asked = pairs.join(parts, "p").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    return asked.join(texts.withColumnRenamed("text", "tx"), "x").join(pivots, ["p", "part"]).select("x", "p", "tx", "tp")


def _pivots(members: DataFrame, several: bool) -> DataFrame:
    """(cell, pivots) of cells with more than one component: the most typical member; of a crowded one, the most typical of each of PIVOTS parts."""
    part = F.pmod(F.xxhash64("x"), F.lit(PIVOTS)) if several else F.lit(0)
    top = members.groupBy("cell", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("score", "x")).alias("top"))
    return top.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("best"),
                                   F.collect_list("top.x").alias("tops")).filter("lo < hi").select(
        "cell", "n", F.when(F.col("n") > CROWD, F.col("tops")).otherwise(F.array("best.x")).alias("pivots"))


def _deeper(regions: DataFrame, measured: DataFrame, eps: float) -> DataFrame:
    """Cells of the next turn: (cell, x, score). ``regions``: (cell, x, score, p, pivots) of cells that are not done."""
    slack = 1e-9
    distance = F.coalesce(1 - F.col("shared") / (F.col("n_x") + F.col("n_p") - F.col("shared")), F.lit(0.0))  # a pivot is at 0 from itself
    at = regions.join(measured.select("x", "p", "n_x", "n_p", "shared"), ["x", "p"], "left").withColumn("d", distance)
    nearest = F.min("d").over(Window.partitionBy("cell", "x"))
    kept = at.withColumn("home", nearest).filter((F.col("d") <= F.col("home") + 2 * eps + slack) & ~F.array_contains("pivots", F.col("x")))
    ring = F.floor(F.col("d") / (eps + slack))
    told = measured.select("x", "p", F.concat(F.transform("far", lambda e: F.struct(F.lit(0).alias("side"), e.alias("e"))),
                                              F.transform("near", lambda e: F.struct(F.lit(1).alias("side"), e.alias("e")))).alias("told"))
    sets = kept.select("x", "p", "score", F.explode(F.array(ring, ring + 1)).alias("ring")).distinct().join(told, ["x", "p"])
    return sets.select("x", "p", "score", "ring", F.inline("told")).select(F.xxhash64("p", "ring", "side", "e").alias("cell"), "x", "score")


def _leaf(width: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links that join the components of a small region: each one unites two, so there are fewer than sets."""
        sets = [shingle_set(t, width) for t in raw(group.column("text"))]
        xs, root = group.column("x").to_pylist(), {}
        own = group.column("label").to_pylist()

        def find(a: int) -> int:
            while root.get(a, a) != a:
                root[a] = a = root.get(root[a], root[a])
            return a

        links = []
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        sizes, bins = np.array([len(sets[i]) for i in order]), np.stack([histogram(sets[i]) for i in order])
        for j, b in enumerate(order):
            low = np.searchsorted(sizes, -(-percent * sizes[j] // 100))  # smaller sets that are not too small
            near = low + np.flatnonzero((100 + percent) * _apart(bins[low:j], bins[j]) <= (100 - percent) * (sizes[low:j] + sizes[j]))
            for i in near.tolist():
                a = order[i]
                if find(own[a]) != find(own[b]):
                    shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                        root[find(own[a])] = find(own[b])
                        links.append((xs[a], xs[b]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _leaves(live: DataFrame, classes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, p, label) of small regions, and (p) of the others. A pivot is measured against its whole region already and is left out of it."""
    members = live.filter("x <> p").select("x", "p").distinct().join(classes.select("x", "n"), "x")
    size = members.groupBy("p").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    size = materialize(size.withColumn("small", (F.col("sets") <= LEAF) & (F.col("shingles") <= LEAF_SHINGLES)), "region-sizes")
    small = members.join(size.filter("small and sets > 1").select("p"), "p").join(labels, "x").select("x", "p", "label")
    return small, size.filter("not small").select("p")


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(x, label): the smallest set of every set's component."""
    named = components(links).select(F.col("node").alias("x"), F.col("label").alias("new"))
    return materialize(classes.select("x").join(named, "x", "left").select("x", F.coalesce("new", "x").alias("label")), "labels")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: size of the document's set of distinct ``width``-word shingles, and the smallest doc_id reachable
    by links, itself included. Documents link when 100 * intersection >= ``percent`` * union of their sets (1 to 99).

    Words are cut at ASCII white space, A-Z lower-cased; shingles are compared by 64-bit hashes, sets by MD5 of them. Fewer words than ``width`` are
    one shingle. Null texts and texts without words have no set and link with nothing, each row its own component. Equal sets are one class
    and are joined once. Repeated rows come back as often as they come in. A null doc_id is never the smallest unless all of its component are
    null. An empty table gives no rows. Other columns are not read, so their names don't matter.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    counts = count_shingles(source.select("text"), width)
    rows = materialize(source.mapInArrow(_sets(counts, width, percent), "doc_id long, text_key string, digest binary, n long, score double, firsts array<long>, bins binary"), "sets")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first(F.struct("text_key", "n", "score", "firsts", "bins")).alias("s")).select(
        F.monotonically_increasing_id().alias("x"), "digest", "first", "s.*")
    classes = materialize(classes, "classes")

    # Shingles that one set alone has among its first make no cell; copies for size classes come after they are gone.
    each = classes.select("x", "n", "score", F.explode("firsts").alias("e"))
    shared = each.groupBy("e").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("e")
    size = F.floor(F.log(F.col("n").cast("double")) / (log(100 / percent) + 1e-9))
    cells = each.join(shared, "e").withColumn("size", F.explode(F.array(size, size + 1))).select(F.xxhash64("size", "e").alias("cell"), "x", "score")
    labels, links, texts, turn = classes.select("x", F.col("x").alias("label")), None, None, 0
    while True:
        cells = materialize(cells, "cells")
        members = cells.join(labels, "x")
        regions = materialize(members.join(_pivots(members, 0 < turn <= SPLIT_TURNS), "cell").select("cell", "x", "score", F.explode("pivots").alias("p"), "pivots"), "regions")
        pairs = materialize(regions.filter("x <> p").select("x", "p").distinct(), "pairs")
        if pairs.isEmpty():
            break
        if texts is None:  # deeper cells have no other members
            needed = regions.select("x").distinct().join(classes.select("x", "text_key"), "x")
            # Copies of a text meet in the map tasks, so one text of many rows is no hot key.
            one = source.groupBy("text_key").agg(F.first("text").alias("text"))
            texts = materialize(one.join(needed, "text_key").select("x", "text"), "texts")
        measure = lambda some: materialize(_with_texts(some, texts).mapInArrow(_measured(counts, width, percent), MEASURED), "measured")
        possible = materialize(_possible(pairs, classes, percent), "possible-pairs")
        measured = measure(possible)
        near = measured.filter(100 * F.col("shared") >= percent * (F.col("n_x") + F.col("n_p") - F.col("shared"))).select(F.col("x").alias("a"), F.col("p").alias("b"))
        links = near if links is None else links.unionAll(near)
        labels = _labels(classes, links)
        still = regions.join(labels, "x").groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("cell")
        live = materialize(regions.join(still, "cell"), "live")
        small, large = _leaves(live, classes, labels)
        links = links.unionAll(materialize(small.join(texts, "x").groupBy("p").applyInArrow(_leaf(width, percent), "a long, b long"), "leaf-links"))
        labels = _labels(classes, links)
        if large.isEmpty():
            break
        live = live.join(large, "p", "left_semi")
        # Distances to all pivots order what is left, also those that are no links.
        others = live.filter("x <> p").select("x", "p").distinct().join(possible, ["x", "p"], "left_anti")
        cells = _deeper(live, measured.unionByName(measure(others)), 1 - percent / 100)
        turn += 1
    named = classes.join(labels, "x")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    members = materialize(named.join(least, "label").select("digest", "component_id"), "components")
    found = rows.filter("n > 0").select("doc_id", "n", "digest").join(members, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionAll(alone)
