"""Replication-rate decisions in batch: headroom, applied rates, failure mode, overrides, clearing."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replicalens.operators.filters import active_overrides
from replicalens.plans.lines import since_reset
from replicalens.schemas import BROKER_KEY


# The fold below travels to executors by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Limits:
    """Minimum rate in MB/s and the shares of free capacity, in percent, usable by sources and destinations."""

    minimum: float
    source_max: float
    destination_max: float

    def __post_init__(self):
        if self.minimum <= 0:
            raise ValueError("minimum must be > 0")
        for name in ("source_max", "destination_max"):
            if not 0 < getattr(self, name) < 100:
                raise ValueError(f"{name} must be > 0 and < 100")

    def share(self, role: Column) -> Column:
        return F.when(role == "leader", self.source_max).when(role == "follower", self.destination_max)


def headroom(util: Column, previous: Column, capacity: Column, share: Column, minimum: float) -> Column:
    """Rate a broker can spend on replication: capacity, less traffic that is not replication, less what
    already exceeds capacity; a share of that, but at least the minimum."""
    other = F.greatest(util - previous, F.lit(0.0))
    over = F.greatest(util - capacity, F.lit(0.0))
    return F.greatest((capacity - other - over) * (share / 100), F.lit(float(minimum)))


def replication_rates(participants: DataFrame, network: DataFrame, capacity: DataFrame, previous: DataFrame,
                      limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(rates: cluster_id, broker_id, role, rate; rejected brokers with a reason).

    ``participants``: is_src, is_dst per broker. A role a broker does not have gives no row. A broker
    without metrics or of unknown type stops the whole cluster's update.
    """
    j = participants.join(network, BROKER_KEY, "left").join(capacity, "instance_type", "left")
    reason = F.when(F.col("net_tx").isNull(), "no metrics").when(F.col("capacity_mb").isNull(), "unknown instance type")
    j = j.withColumn("reason", reason)
    rejected = j.filter("reason is not null").select(*BROKER_KEY, "reason")
    roles = F.filter(F.array(F.when(F.col("is_src"), F.struct(F.lit("leader").alias("role"), F.col("net_tx").alias("util"))),
                             F.when(F.col("is_dst"), F.struct(F.lit("follower").alias("role"), F.col("net_rx").alias("util")))),
                     lambda x: x.isNotNull())
    ok = j.join(rejected.select("cluster_id").distinct(), "cluster_id", "left_anti")
    rows = ok.select(*BROKER_KEY, "capacity_mb", F.explode(roles).alias("e")).select(*BROKER_KEY, "capacity_mb", "e.role", "e.util")
    prev = previous.select(*BROKER_KEY, "role", F.col("rate").alias("prev"))
    rate = headroom(F.col("util"), F.coalesce("prev", F.lit(0.0)), F.col("capacity_mb"), limits.share(F.col("role")), limits.minimum)
    return rows.join(prev, [*BROKER_KEY, "role"], "left").select(*BROKER_KEY, "role", rate.alias("rate")), rejected


def next_rate(previous: float, util: float, capacity: float, share: float, minimum: float, threshold: float
              ) -> tuple[float, bool]:
    """(proposed rate, whether it differs enough from the applied one). The only per-row Python: a rate depends
    on the rate applied before it."""
    other, over = max(util - previous, 0.0), max(util - capacity, 0.0)
    rate = max((capacity - other - over) * (share / 100), minimum)
    return float(rate), previous == 0 or abs((previous - rate) / previous * 100) >= threshold


APPLIED_SCHEMA = "cluster_id string, broker_id bigint, role string, tick timestamp, rate double, applied boolean, current double"


def applied_rates(ticks: DataFrame, limits: Limits, threshold: float) -> DataFrame:
    """Applied-rate history of (cluster_id, broker_id, role, tick, util, capacity_mb, reset) ticks.

    A new rate is applied only if it differs from the applied one by at least ``threshold`` percent; a
    reset forgets the applied rate first. Keys are hash-partitioned and sorted by tick, and the scan
    carries one number per key across Arrow batches, so no series is held in memory.
    """
    shares = {"leader": limits.source_max, "follower": limits.destination_max}
    minimum = limits.minimum

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, current = None, 0.0
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k = (r.cluster_id, r.broker_id, r.role)
                if k != key:
                    key, current = k, 0.0
                if r.reset:
                    current = 0.0
                rate, apply = next_rate(current, r.util, r.capacity_mb, shares[r.role], minimum, threshold)
                if apply:
                    current = rate
                out.append((*k, r.tick, rate, apply, current))
            yield pd.DataFrame(out, columns=["cluster_id", "broker_id", "role", "tick", "rate", "applied", "current"])

    key = ["cluster_id", "broker_id", "role"]
    cols = ticks.select(*key, "tick", "util", "capacity_mb", "reset")
    return cols.repartition(*key).sortWithinPartitions(*key, "tick").mapInPandas(scan, APPLIED_SCHEMA)


def failure_modes(ticks: DataFrame, threshold: int) -> DataFrame:
    """Mode of every (cluster_id, tick, complete): ``computed``; ``retain`` while consecutive incomplete ticks
    are at most ``threshold``; then ``minimum``. Complete metrics reset the count."""
    counted = since_reset(ticks, ["cluster_id"], "tick", F.col("complete"), ~F.col("complete"))
    return counted.select(
        "cluster_id", "tick", F.col("n").alias("failures"),
        F.when(F.col("complete"), "computed").when(F.col("n") > threshold, "minimum").otherwise("retain").alias("mode"))


def topics_done(snapshots: DataFrame, key: list[str] | None = None, ticks: DataFrame | None = None) -> DataFrame:
    """Topics of a snapshot that the next snapshot of the cluster no longer holds: (.., snapshot_ts, topic).

    A snapshot without topics has no row, so ``ticks`` (key, snapshot_ts) names all of them; without it the topics of a cluster's last
    busy snapshot are never done.
    """
    key = key or []
    times = snapshots.select(*key, "snapshot_ts")
    times = (times if ticks is None else times.union(ticks.select(*key, "snapshot_ts"))).distinct()
    nxt = times.withColumn("next_ts", F.lead("snapshot_ts").over(Window.partitionBy(*key).orderBy("snapshot_ts") if key
                                                                else Window.partitionBy(F.lit(0)).orderBy("snapshot_ts")))
    gone = snapshots.join(nxt.filter("next_ts is not null"), [*key, "snapshot_ts"]).select(
        *key, F.col("next_ts").alias("snapshot_ts"), "topic")
    return gone.join(snapshots, [*key, "snapshot_ts", "topic"], "left_anti")


def topic_updates(snapshots: DataFrame, key: list[str]) -> DataFrame:
    """Per snapshot: does it hold topics the previous one did not? Then topic lists are updated and applied
    rates are forgotten."""
    times = snapshots.select(*key, "snapshot_ts").distinct().withColumn(
        "prev_ts", F.lag("snapshot_ts").over(Window.partitionBy(*key).orderBy("snapshot_ts")))
    prev = snapshots.select(*key, F.col("snapshot_ts").alias("prev_ts"), "topic", F.lit(True).alias("was"))
    j = snapshots.join(times, [*key, "snapshot_ts"]).join(prev, [*key, "prev_ts", "topic"], "left")
    return j.groupBy(*key, "snapshot_ts").agg(F.max(F.col("was").isNull()).alias("update_topics"))


def override_actions(overrides: DataFrame, participants: DataFrame) -> DataFrame:
    """Actions (cluster_id, broker_id, action, role, rate): assign active overrides of brokers outside
    reassignments to both roles, remove throttles of zero ones, purge every zero override."""
    outside = overrides.join(participants.select(*BROKER_KEY).distinct(), BROKER_KEY, "left_anti")
    assign = active_overrides(outside).select(
        *BROKER_KEY, F.lit("assign").alias("action"), F.explode(F.array(F.lit("leader"), F.lit("follower"))).alias("role"), "rate")
    none = F.lit(None).cast("string").alias("role"), F.lit(None).cast("bigint").alias("rate")
    remove = outside.filter("rate = 0").select(*BROKER_KEY, F.lit("remove").alias("action"), *none)
    purge = overrides.filter("rate = 0").select(*BROKER_KEY, F.lit("purge").alias("action"), *none)
    return assign.unionByName(remove).unionByName(purge)


def override_topic_updates(active_now: DataFrame, active_before: DataFrame) -> DataFrame:
    """Per cluster: did the set of brokers with active overrides change?"""
    both = active_now.select(*BROKER_KEY, F.lit(1).alias("now"), F.lit(0).alias("before")).unionByName(
        active_before.select(*BROKER_KEY, F.lit(0).alias("now"), F.lit(1).alias("before")))
    one = both.groupBy(*BROKER_KEY).agg(F.max("now").alias("now"), F.max("before").alias("before"))
    return one.groupBy("cluster_id").agg(F.max(F.col("now") != F.col("before")).alias("update_topics"))


def clear_decisions(ticks: DataFrame, cleanup_after: int) -> DataFrame:
    """When to clear throttles, over (cluster_id, tick, reassigning, overrides_set) ticks.

    A tick without reassignments and overrides clears if throttles are known, which is so right after an
    active tick, or every ``cleanup_after`` ticks since the last clear (or since the start).
    """
    busy = F.col("reassigning") | F.col("overrides_set")
    counted = since_reset(ticks, ["cluster_id"], "tick", busy, ~busy)
    pos = F.col("n") - 1
    clear = ~busy & (pos % cleanup_after == 0) & (F.col("seen") | (pos > 0))
    return counted.select("cluster_id", "tick", clear.alias("clear"))


def brokers_to_clear(live: DataFrame, overrides: DataFrame) -> DataFrame:
    """Live brokers, less those whose override is not removed automatically."""
    held = overrides.filter("not autoremove").select(*BROKER_KEY)
    return live.select(*BROKER_KEY).join(held, BROKER_KEY, "left_anti")
