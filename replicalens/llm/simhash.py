"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicalens.llm.common import few, raw
from replicalens.llm.components import components
from replicalens.session import materialize

#: The hash seed of shingles.
SEED = 42


def _fingerprint(text: bytes, width: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(width)))), len(words) - width + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 1 << 16):  # a very long text is summed in pieces
        part = hashes[start:start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles, repeats included, as a long.

    A bit is 1 if it is set in over half of the shingles' XXH64. Fewer words than ``width`` are one shingle; a text
    without words, or a null one, has fingerprint 0.
    """

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_fingerprint(t, width) for part in few(texts) for t in raw(part)], pa.int64())

    return run(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(fps: DataFrame, segments: int) -> DataFrame:
    bits = 64 // segments
    mask = F.lit((1 << bits) - 1).cast("bigint")
    value = [F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", s * bits).bitwiseAND(mask).alias("val")) for s in range(segments)]
    return fps.select("fp", F.inline(F.array(*value)))


def _ball(table: DataFrame, bits: int) -> DataFrame:
    """Probes within one bit of each segment value. Of two values one bit apart only the one with the 0 probes."""
    one = F.lit(1).cast("bigint")
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(
        F.col("val").bitwiseAND(F.call_function("shiftleft", one, i)) == 0, F.col("val").bitwiseOR(F.call_function("shiftleft", one, i))))
    return table.select("seg", F.explode(F.concat(F.array("val"), F.filter(flips, lambda v: v.isNotNull()))).alias("probe"), "val", "fp").select(
        "seg", F.col("probe").alias("val"), (F.col("probe") == F.col("val")).alias("same"), "fp")


def _block_links(radius: int):
    def run(table: pa.Table, probes: pa.Table) -> pa.Table:
        """Stars of the links between two blocks: as many rows as fingerprints at most, never pairs."""
        t, p = (np.asarray(x.column("fp").to_numpy()).view(np.uint64) for x in (table, probes))
        near = np.bitwise_count(p[:, None] ^ t[None, :]) <= radius
        nodes, inverse = np.unique(np.concatenate([p, t]), return_inverse=True)
        at_p, at_t = inverse[:len(p)], inverse[len(p):]
        rows, cols = np.nonzero(near)
        label = np.arange(len(nodes))
        while len(rows):
            low = np.minimum(label[at_p[rows]], label[at_t[cols]])
            new = label.copy()
            np.minimum.at(new, at_p[rows], low)
            np.minimum.at(new, at_t[cols], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"a": nodes[moved].view(np.int64), "b": nodes[label[moved]].view(np.int64)})

    return run


def links(fps: DataFrame, radius: int = 2, segments: int = 2, hot: int = 64, block: int = 1024) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprint pairs at ``radius`` or fewer differing bits.

    ``fps`` has distinct longs in ``fp`` and is read several times, so give a written table. Of ``segments`` segments
    one differs in at most ``radius // segments`` bits; that must be 0 or 1, and each segment's one-bit ball is looked up in the
    table of segment values. Matches are verified over all 64 bits. A value with more than ``hot`` fingerprints is not
    paired: its table and probe rows are dealt into blocks of about ``block``, every block pair is compared in one
    small matrix, and only stars of the links found are returned, so nothing is lost and no group's pairs are emitted.

    Spark sizes a table after ``explode`` as before it, so probes are merged: broadcast by that size, some 17 times as many
    rows would go through the driver. What probes and segments are looked up in otherwise is a written table, whose size is known.
    """
    if radius >= 2 * segments or 64 % segments:
        raise ValueError("radius must be below twice the number of segments, which must divide 64")
    bits = 64 // segments
    table = _segments(fps, segments)
    probes = _ball(table, bits)
    crowded = materialize(table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "crowded")
    cold = table.join(crowded, ["seg", "val"], "left_anti").select("seg", "val", F.col("fp").alias("other"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius) & (~F.col("same") | (F.col("fp") < F.col("other")))
    p = probes.select(F.col("seg").alias("s"), F.col("val").alias("v"), "same", "fp")
    pairs = p.hint("merge").join(cold, (F.col("s") == F.col("seg")) & (F.col("v") == F.col("val")) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))

    asked = materialize(probes.join(crowded.select("seg", "val"), ["seg", "val"]).select("seg", "val", "fp"), "crowded-probes")
    sizes = materialize(asked.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("m")).join(crowded, ["seg", "val"]).select(
        "seg", "val", F.ceil(F.col("n") / block).cast("int").alias("tn"), F.ceil(F.col("m") / block).cast("int").alias("pn")), "crowded-sizes")
    deal = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["seg", "val", "tb", "pb"]
    left = table.join(sizes, ["seg", "val"]).select("seg", "val", deal("tn").alias("tb"), every("pn").alias("pb"), "fp")
    right = asked.join(sizes, ["seg", "val"]).select("seg", "val", deal("pn").alias("pb"), every("tn").alias("tb"), "fp").select(*key, "fp")
    stars = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block_links(radius), "a long, b long")
    return pairs.unionAll(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, segments: int = 2,
                    hot: int = 64) -> DataFrame:
    """(doc_id, fp, component_id, label) for every row: fingerprint and smallest doc_id of all documents reachable by links,
    and the component's smallest fingerprint, which unlike ids is never null and names one component only.

    Null and empty texts share fingerprint 0 and so one component. Repeated rows come back as often as they come in. A
    null doc_id is never the smallest unless all of its component are null. An empty table gives no rows. Other
    columns are not read, so their names don't matter.
    """
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")), "fingerprints")
    first = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    label = components(links(first.select("fp"), radius, segments, hot=hot)).select(F.col("node").alias("fp"), "label")
    named = first.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = materialize(named.join(least, "label").select("fp", "component_id", "label"), "fingerprint-classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", "label")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, segments: int = 2,
                  hot: int = 64) -> DataFrame:
    """The rows of ``docs``, all columns, of which one per component stays: the smallest doc_id's, one row of its repeats.

    Null and empty texts are one component, as in ``near_duplicates``; null ids stay only in components without others. The row travels in one struct, so its
    columns may have any names.
    """
    classes = near_duplicates(docs, doc_id, text, width, radius, segments, hot)
    keep = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"), F.col("fp").alias("keep"), F.col("label").alias("group")).distinct()
    marked = docs.select(fingerprint(F.col(text), width).alias("fp"), F.col(doc_id).alias("own"), F.struct(*docs.columns).alias("row"))
    kept = marked.join(keep, F.col("own").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("keep")))
    return kept.dropDuplicates(["group"]).select("row.*")
