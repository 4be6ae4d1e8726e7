"""The planners composed: rebuild a map, rebalance or scale a cluster, decide one throttle tick."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.functions.arrays import set_replication, strip, to_partition_map, to_replicas, what_changed
from replicalens.operators import aggregates as A
from replicalens.operators import joins as J
from replicalens.operators import throttle as T
from replicalens.operators.filters import all_brokers, changed_partitions, replaced
from replicalens.plans import affinity, leadership, maps, placement, relocation
from replicalens.plans.repair import repair
from replicalens.schemas import BROKER_KEY, PARTITION_KEY
from replicalens.session import materialize


class Rebuilt(NamedTuple):
    """``maps`` holds the planned map, and with phasing both maps, numbered by ``phase``."""

    maps: DataFrame
    changes: DataFrame
    status: DataFrame
    actions: DataFrame
    errors: DataFrame
    violations: DataFrame


class Rebalanced(NamedTuple):
    """``new_map`` holds changed partitions only."""

    new_map: DataFrame
    changes: DataFrame
    moves: DataFrame
    scores: DataFrame
    errors: DataFrame


def storage_after(state: DataFrame, before: DataFrame, after: DataFrame, sizes: DataFrame) -> DataFrame:
    """State with free storage moved by the partitions each broker loses and gains."""
    each = before.select(*PARTITION_KEY, "broker_id", F.lit(1).alias("s")).unionByName(
        after.filter("broker_id is not null").select(*PARTITION_KEY, "broker_id", F.lit(-1).alias("s")))
    delta = each.join(sizes, PARTITION_KEY).groupBy(*BROKER_KEY).agg(F.sum(F.col("s") * F.col("size_bytes")).alias("d"))
    return state.join(delta, BROKER_KEY, "left").withColumn("storage_free", F.col("storage_free") + F.coalesce("d", F.lit(0))).drop("d")


def change_labels(before: DataFrame, after: DataFrame) -> DataFrame:
    a = after.select(*PARTITION_KEY, F.col("replicas").alias("after"))
    return before.join(a, PARTITION_KEY).select(
        *PARTITION_KEY, F.col("replicas").alias("before"), "after", what_changed(F.col("replicas"), F.col("after")).alias("change"))


def _place_all(partition_map: DataFrame, state: DataFrame, sizes: DataFrame | None, **options) -> tuple[DataFrame, DataFrame]:
    """Full placement of lists of any length: one placement per distinct length, each proportional to the capacity that is left.
    Lengths are replication factors, so there are few. Partitions of unknown size are errors under ``storage`` only."""
    by_size = options["strategy"] == "storage"
    parts = partition_map.select(*PARTITION_KEY, F.size("replicas").alias("rf"))
    parts = materialize(parts.join(sizes, PARTITION_KEY, "left") if by_size else parts, "rebuild-parts")
    live = state.filter("not is_replace and not is_missing")
    placed = parts.select(*PARTITION_KEY, F.lit(0).alias("idx"), F.lit(None).cast("bigint").alias("broker_id")).limit(0)
    errors = parts.select(*PARTITION_KEY, F.lit("").alias("error")).limit(0)
    for (rf,) in parts.select("rf").distinct().filter("rf > 0").orderBy("rf").collect():
        p, e = placement.place(parts.filter(F.col("rf") == rf), live, rf, **options)
        p = materialize(p, "rebuild-placed")
        placed, errors = placed.unionByName(p), errors.unionByName(e)
        if by_size:
            z = F.greatest(F.ceil(F.col("size_bytes") * F.lit(options["size_factor"])), F.lit(1)).cast("bigint")
            spent = p.join(parts, PARTITION_KEY).groupBy(*BROKER_KEY).agg(F.sum(z).alias("spent"))
            live = materialize(live.join(spent, BROKER_KEY, "left").withColumn(
                "storage_free", F.col("storage_free") - F.coalesce("spent", F.lit(0))).drop("spent"), "rebuild-live")
    return placed, errors


def rebuild(partition_map: DataFrame, meta: DataFrame, provided: DataFrame, sizes: DataFrame | None = None, *,
            strategy: str = "count", optimization: str = "distribution", replication: int = 0, force: bool = False,
            substitute: bool = False, balance_leadership: bool = False, phased: bool = False, min_racks: int = 0,
            size_factor: float = 1.0, evacuate_brokers: Iterable[int] = (), evacuate_topics: Iterable[str] = ()) -> Rebuilt:
    """Rebuild ``partition_map`` for the provided brokers (and the discovered ones of ``meta``)."""
    if strategy == "storage" and sizes is None:
        raise ValueError("storage placement needs partition sizes")
    current = materialize(partition_map.select(*PARTITION_KEY, "replicas"), "rebuild-input")
    before = to_replicas(current)
    merged = materialize(J.merge_brokers(J.broker_map(before, meta, force), provided, meta), "rebuild-brokers")
    state = original = J.broker_state(merged)
    status = A.broker_status(merged)
    goal = current.withColumn("replicas", set_replication(F.col("replicas"), replication))
    errors = None
    if strategy == "storage":
        state, _unknown = J.add_back_storage(state, before, sizes, all_brokers if force else replaced)
        state = materialize(state, "rebuild-state")
    if force:
        placed, errors = _place_all(goal.withColumn("replicas", strip(F.col("replicas"))), state,
                                    sizes, strategy=strategy, optimization=optimization, min_racks=min_racks, size_factor=size_factor)
    else:
        if substitute and strategy == "count":
            pairs, failed = affinity.substitution_affinities(state, before)
            goal = to_partition_map(affinity.apply_substitutions(to_replicas(goal), pairs))
            errors = failed.select("cluster_id", F.lit(None).cast("string").alias("topic"), F.lit(None).cast("bigint").alias("partition_id"),
                                   F.col("reason").alias("error"))
        placed, open_slots = repair(goal, state, strategy=strategy, sizes=sizes, size_factor=size_factor, min_racks=min_racks)
        open_slots = open_slots.select(*PARTITION_KEY, "error")
        errors = open_slots if errors is None else errors.unionByName(open_slots)
    planned = materialize(to_partition_map(placed), "rebuild-output")
    if balance_leadership:
        planned = leadership.balance_leaders(planned)
    first = maps.phased_map(current, planned) if phased else None
    evacuate_topics = list(evacuate_topics)
    if evacuate_topics:
        planned, stuck = maps.evacuate_leadership(planned, evacuate_brokers, evacuate_topics)
        errors = errors.unionByName(stuck.withColumn("error", F.lit("trying to evict all replicas at once")))
    free = {} if sizes is None else {
        "free_before": original.filter("not is_missing"),
        "free_after": storage_after(original.filter("not is_missing and not is_replace"), before, to_replicas(planned), sizes)}
    violations = maps.validate_plan(planned, original, min_racks=min_racks, **free)
    out = planned.withColumn("phase", F.lit(1))
    if phased:
        out = first.withColumn("phase", F.lit(1)).unionByName(planned.withColumn("phase", F.lit(2)))
    actions = A.change_actions(status, force=force, replication=replication, leadership=balance_leadership)
    return Rebuilt(out, change_labels(current, planned), status, actions, errors, violations)


def rebalance(partition_map: DataFrame, meta: DataFrame, provided: DataFrame, sizes: DataFrame, *, tolerance: float | None = None,
              threshold: float = 0.2, threshold_gib: float = 0.0, partition_limit: int = 30, min_bytes: int = 512 << 20,
              locality_scoped: bool = False, balance_leadership: bool = False, require_new: bool = False) -> Rebalanced:
    """Move partitions off full brokers; without ``tolerance`` the whole grid is tried and the best plan kept.

    Clusters whose broker list does more than add brokers only get an error row. ``threshold=0`` with
    ``require_new`` is the scale-out form: every old broker gives, new ones take.
    """
    current = materialize(partition_map.select(*PARTITION_KEY, "replicas"), "rebalance-input")
    merged = materialize(J.merge_brokers(J.broker_map(to_replicas(current), meta), provided, meta), "rebalance-brokers")
    errors = materialize(relocation.scale_errors(A.broker_status(merged), require_new), "rebalance-errors")
    allowed = merged.select("cluster_id").distinct().join(errors, "cluster_id", "left_anti")
    state = materialize(J.broker_state(merged).join(allowed, "cluster_id", "left_semi"), "rebalance-state")
    replicas = to_replicas(current).join(allowed, "cluster_id", "left_semi")
    moves, scores = relocation.plan_relocations(
        replicas, sizes, state, maps.offload_targets(state, threshold_gib=threshold_gib, threshold=threshold),
        tolerances=None if tolerance is None else [tolerance], partition_limit=partition_limit, min_bytes=min_bytes,
        locality_scoped=locality_scoped)
    best = materialize(relocation.best_plan(moves, scores), "rebalance-moves")
    after = materialize(to_partition_map(maps.apply_moves(replicas, best)), "rebalance-output")
    if balance_leadership:
        after = leadership.balance_leaders(after)
    return Rebalanced(changed_partitions(current, after), change_labels(current, after), best, scores, errors)


def throttle_tick(topic_state: DataFrame, targets: DataFrame, network: DataFrame, capacity: DataFrame, previous: DataFrame,
                  overrides: DataFrame, global_overrides: DataFrame, limits: T.Limits, threshold: float
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rates with an ``apply`` flag, throttled entries per topic and role, rejected brokers) of one tick.

    A broker override sets both roles of a participant. Rates closer than ``threshold`` percent to the
    applied ones are not applied.
    """
    throttled = materialize(J.reassigning_replicas(topic_state, targets), "throttled")
    participants = J.reassigning_brokers(throttled)
    rates, rejected = T.replication_rates(participants, network, capacity, previous, limits)
    both = participants.join(overrides.filter("rate <> 0").select(*BROKER_KEY), BROKER_KEY, "left_semi").select(
        *BROKER_KEY, F.explode(F.array(F.lit("leader"), F.lit("follower"))).alias("role"))
    rates = rates.join(both, [*BROKER_KEY, "role"], "full_outer")
    rates = J.apply_overrides(rates, overrides, global_overrides)
    prev = previous.select(*BROKER_KEY, "role", F.col("rate").alias("prev"))
    p = F.coalesce("prev", F.lit(0.0))
    apply = (p == 0) | (F.abs((p - F.col("rate")) / F.nullif(p, F.lit(0.0)) * 100) >= threshold)
    rates = rates.join(prev, [*BROKER_KEY, "role"], "left").select(*BROKER_KEY, "role", "rate", apply.alias("apply"))
    return rates, throttled, rejected
