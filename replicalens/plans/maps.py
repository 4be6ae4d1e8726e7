"""Exact map transforms: applying moves, chunking, phasing, evacuation, offload choice, validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.functions.arrays import to_partition_map
from replicalens.operators.aggregates import storage_stats
from replicalens.operators.filters import around_mean
from replicalens.operators.windows import brokers_by_id
from replicalens.schemas import BROKER_KEY, PARTITION_KEY


def offload_targets(state: DataFrame, *, threshold_gib: float = 0.0, threshold: float = 0.0) -> DataFrame:
    """Brokers to move partitions off: a fixed free-storage limit first, else a fraction below the
    harmonic mean, else every broker that is not new."""
    if threshold_gib > 0:
        return state.filter(~F.col("is_new") & (F.col("storage_free") < threshold_gib * (1 << 30)))
    if threshold > 0:
        return around_mean(state, threshold, above=False, mean="hmean")
    return state.filter(~F.col("is_new"))


def apply_moves(replicas: DataFrame, moves: DataFrame) -> DataFrame:
    """Replace the source of every move by its destination, in place."""
    m = moves.select(*PARTITION_KEY, F.col("src").alias("broker_id"), "dst")
    return replicas.join(m, [*PARTITION_KEY, "broker_id"], "left").select(
        *PARTITION_KEY, "idx", F.coalesce("dst", "broker_id").alias("broker_id"))


def resized_partitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Partitions of ``before`` whose number of replicas differs in ``after``, or that it does not have; both as replica rows."""
    n = lambda df, name: df.groupBy(*PARTITION_KEY).agg(F.count(F.lit(1)).alias(name))
    return n(before, "n").join(n(after, "m"), PARTITION_KEY, "left").filter(~F.col("n").eqNullSafe(F.col("m"))).select(*PARTITION_KEY)


def chunk_errors(before: DataFrame, after: DataFrame, brokers: DataFrame) -> DataFrame:
    """(.., idx, broker_id, error): partitions that chunking cannot change because their list length does, and changed slots on brokers that
    are not listed, which no chunk switches."""
    none = F.lit(None)
    resized = resized_partitions(before, after).select(
        *PARTITION_KEY, none.cast("int").alias("idx"), none.cast("bigint").alias("broker_id"), F.lit("replication factor changes").alias("error"))
    slots = _slots_with_chunk(before, after, brokers, 1).filter("broker_id <> final and chunk is null")
    return resized.unionByName(slots.select(*PARTITION_KEY, "idx", "broker_id", F.lit("broker not listed").alias("error")))


def _slots_with_chunk(before: DataFrame, after: DataFrame, brokers: DataFrame, step: int) -> DataFrame:
    """Every slot with its final broker and the chunk of its original one, null for a broker that is not listed. A resized partition keeps its brokers."""
    if step < 1:
        raise ValueError("chunk step must be positive")
    chunk = brokers_by_id(brokers.select(*BROKER_KEY).distinct(), descending=True).select(
        *BROKER_KEY, F.expr(f"(rank - 1) div {step}").alias("chunk"))
    final = after.join(resized_partitions(before, after), PARTITION_KEY, "left_anti").select(*PARTITION_KEY, "idx", F.col("broker_id").alias("final"))
    slots = before.select(*PARTITION_KEY, "idx", "broker_id").join(final, [*PARTITION_KEY, "idx"], "left")
    return slots.withColumn("final", F.coalesce("final", "broker_id")).join(chunk, BROKER_KEY, "left")


def chunk_changes(before: DataFrame, after: DataFrame, brokers: DataFrame, step: int) -> DataFrame:
    """Replica rows of every chunk, for the partitions that change in it.

    Brokers are taken ``step`` at a time from the highest id down; a chunk switches the slots whose
    original broker is in it or in an earlier chunk. Chunks without a change do not appear. A partition
    appears once per chunk that touches it, so the output grows with the change, not with map x chunks.
    What no chunk can change is in ``chunk_errors``.
    """
    slots = _slots_with_chunk(before, after, brokers, step)
    touched = slots.filter("broker_id <> final").select(*PARTITION_KEY, F.col("chunk").alias("at")).filter("at is not null").distinct()
    return slots.join(touched, PARTITION_KEY).select(
        *PARTITION_KEY, F.col("at").alias("chunk"), "idx",
        F.when(F.col("chunk") <= F.col("at"), F.col("final")).otherwise(F.col("broker_id")).alias("broker_id"))


def chunk_spans(before: DataFrame, after: DataFrame, brokers: DataFrame, step: int) -> DataFrame:
    """The whole map after every chunk, as versions: one row per slot and span of chunks (.., idx, from_chunk, to_chunk, broker_id).

    A row holds after chunks ``from_chunk`` <= c < ``to_chunk``; the map as it was is version -1, and a null end is open. A slot has
    one row, or two if a chunk switches it, so the table grows with the map and its changes, not with map x chunks.
    ``map_at`` looks a version up.
    """
    slots = _slots_with_chunk(before, after, brokers, step)
    switches = F.col("chunk").isNotNull() & (F.col("broker_id") != F.col("final"))
    row = lambda a, b, who: F.struct(a.cast("int").alias("from_chunk"), b.cast("int").alias("to_chunk"), F.col(who).alias("broker_id"))
    first, open_ = F.lit(-1), F.lit(None)
    spans = F.when(switches, F.array(row(first, F.col("chunk"), "broker_id"), row(F.col("chunk"), open_, "final"))).otherwise(
        F.array(row(first, open_, "broker_id")))
    return slots.select(*PARTITION_KEY, "idx", F.inline(spans))


def chunked_maps(before: DataFrame, after: DataFrame, brokers: DataFrame, step: int) -> DataFrame:
    """The whole map after every chunk that changes something, as replica rows keyed by chunk: map x chunks rows, for writing a few maps out.
    ``chunk_spans`` holds the same versions in one table that does not grow with the number of chunks."""
    slots = _slots_with_chunk(before, after, brokers, step)
    kept = slots.filter("broker_id <> final").select("cluster_id", F.col("chunk").alias("at")).filter("at is not null").distinct()
    return slots.join(kept, "cluster_id").select(
        *PARTITION_KEY, F.col("at").alias("chunk"), "idx",
        F.when(F.col("chunk") <= F.col("at"), F.col("final")).otherwise(F.col("broker_id")).alias("broker_id"))


def map_at(spans: DataFrame, chunk: int) -> DataFrame:
    """Replica rows of the map after ``chunk``; -1 is the map before all chunks."""
    return spans.filter((F.col("from_chunk") <= chunk) & (F.col("to_chunk").isNull() | (F.col("to_chunk") > chunk))).drop("from_chunk", "to_chunk")


def phased_map(before: DataFrame, after: DataFrame) -> DataFrame:
    """First phase of a two-phase change: the old leader goes in front unless the new list holds it."""
    b = before.select(*PARTITION_KEY, F.col("replicas")[0].alias("leader"))
    r = F.col("replicas")
    return after.join(b, PARTITION_KEY, "left").select(
        *PARTITION_KEY, F.when(F.col("leader").isNull() | F.array_contains(r, F.col("leader")), r)
        .otherwise(F.concat(F.array("leader"), r)).alias("replicas"))


def evacuate_leadership(partition_map: DataFrame, brokers: Iterable[int], topics: Iterable[str]
                        ) -> tuple[DataFrame, DataFrame]:
    """(map with evacuated leaders, partitions that only have evacuated brokers). The leader changes places
    with the first replica outside the list."""
    evac = F.array(*[F.lit(int(b)).cast("bigint") for b in brokers])
    r = F.col("replicas")
    stays = F.get(F.filter(r, lambda b: ~F.array_contains(evac, b)), F.lit(0))
    due = F.col("topic").isin(list(topics)) & F.array_contains(evac, r[0])
    marked = partition_map.withColumns({"__due": due, "__new": stays})
    swapped = F.transform(r, lambda b, i: F.when(i == 0, F.col("__new")).when(b == F.col("__new"), r[0]).otherwise(b))
    moved = F.when(F.col("__due") & F.col("__new").isNotNull(), swapped).otherwise(r)
    return (marked.select(*PARTITION_KEY, moved.alias("replicas")),
            marked.filter(F.col("__due") & F.col("__new").isNull()).select(*PARTITION_KEY))


def validate_plan(partition_map: DataFrame, brokers: DataFrame, free_before: DataFrame | None = None,
                  free_after: DataFrame | None = None, min_racks: int = 0) -> DataFrame:
    """Violations (cluster_id, kind, topic, partition_id, broker_id, detail) of a planned map.

    Kinds: zero_replicas, duplicate_broker, rack_violation (shared rack, or fewer than ``min_racks``
    racks when given), missing_rack, storage_overflow, range_increase.
    """
    def out(df, kind, broker=None, detail=None):
        return df.select(
            "cluster_id", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("topic"),
            F.lit(None).cast("bigint").alias("partition_id"),
            (F.col(broker) if broker else F.lit(None).cast("bigint")).alias("broker_id"),
            (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))

    def found_if(condition, kind, detail=None):
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")))

    # One pass over the map: every partition's racks are gathered once and all its violations come from that row.
    r = F.col("replicas")
    held = partition_map.select(
        *PARTITION_KEY, F.size(r).alias("size"), F.size(F.array_distinct(r)).alias("members"),
        F.explode_outer(F.array_distinct(r)).alias("broker_id")).join(brokers.select(*BROKER_KEY, "rack"), BROKER_KEY, "left")
    per = held.groupBy(*PARTITION_KEY).agg(
        F.max("size").alias("size"), F.max("members").alias("members"), F.count(F.when(F.col("rack") != "", 1)).alias("n"),
        F.size(F.collect_set(F.when(F.col("rack") != "", F.col("rack")))).alias("racks"))
    enough = F.least(F.col("n"), F.lit(min_racks)) if min_racks > 0 else F.col("n")
    kinds = F.filter(F.array(found_if(F.col("size") <= 0, "zero_replicas"), found_if(F.col("members") < F.col("size"), "duplicate_broker"),
                             found_if(F.col("racks") < enough, "rack_violation", F.col("racks"))), lambda x: x.isNotNull())
    partitions = per.select(*PARTITION_KEY, F.explode(kinds).alias("v")).select(
        "cluster_id", "v.kind", "topic", "partition_id", F.lit(None).cast("bigint").alias("broker_id"), "v.detail")
    unracked = held.filter("rack = ''").select(*BROKER_KEY).distinct()
    found = [partitions, out(unracked, "missing_rack", broker="broker_id")]
    if free_after is not None:
        found.append(out(free_after.filter("storage_free < 0"), "storage_overflow", broker="broker_id", detail=F.col("storage_free")))
        if free_before is not None:
            a = storage_stats(free_after).select("cluster_id", F.col("storage_range").alias("a"))
            b = storage_stats(free_before).select("cluster_id", F.col("storage_range").alias("b"))
            found.append(out(a.join(b, "cluster_id").filter("a > b"), "range_increase", detail=F.col("a") - F.col("b")))
    result = found[0]
    for f in found[1:]:
        result = result.unionByName(f)
    return result


def accepted_map(partition_map: DataFrame, violations: DataFrame, force: bool = False) -> DataFrame:
    """The map of clusters without violations, or every map when forced."""
    if force:
        return partition_map
    return partition_map.join(violations.select("cluster_id").distinct(), "cluster_id", "left_anti")


def rotate_replicas(replicas: DataFrame, ordinal: str, size: str) -> DataFrame:
    """Shift every list by its ordinal, so leaders spread evenly over the positions."""
    return to_partition_map(replicas.withColumn("idx", F.pmod(F.col("idx") + F.col(ordinal), F.col(size)).cast("int")))
