"""Joins between inventory, metric, tag and override tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicalens.functions.text import merge_tags, tag_value, throttled_entry
from replicalens.operators.filters import BrokerPredicate, active_overrides, not_offline
from replicalens.schemas import BROKER_KEY, OFFLINE_BROKER_ID, OFFSETS_TOPIC, PARTITION_KEY


def with_sizes(partitions: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(partitions with size_bytes, partitions whose size is unknown)."""
    j = partitions.join(sizes.select(*PARTITION_KEY, "size_bytes"), PARTITION_KEY, "left")
    return j.filter("size_bytes is not null"), j.filter("size_bytes is null").drop("size_bytes")


def broker_map(replicas: DataFrame, meta: DataFrame, force: bool = False) -> DataFrame:
    """One row per mapped broker: used = replicas held (0 when forced), rack and free storage if known."""
    used = F.lit(0).cast("bigint") if force else F.count(F.lit(1))
    held = not_offline(replicas).groupBy(*BROKER_KEY).agg(used.alias("used"))
    m = meta.select(*BROKER_KEY, "rack", "storage_free")
    return held.join(m, BROKER_KEY, "left").select(
        *BROKER_KEY, F.coalesce("rack", F.lit("")).alias("rack"), "used",
        F.coalesce("storage_free", F.lit(0)).cast("bigint").alias("storage_free"))


def merge_brokers(mapped: DataFrame, provided: DataFrame, discovered: DataFrame, *, all_mapped: bool = False,
                  all_discovered: bool = False, use_meta: bool = True) -> DataFrame:
    """Merge the provided broker list with mapped and discovered brokers.

    Three key sets meet in one aggregation instead of two outer joins. Rows carry the flags of the
    planning state (``in_state``: the broker is part of it) and the five status counters' flags. A
    missing broker that was not provided counts as old-missing and as replaced.
    """
    def side(df: DataFrame, flag: str, payload: bool) -> DataFrame:
        cols = [F.col("rack"), F.col("storage_free").cast("bigint").alias("storage_free")] if payload else [
            F.lit(None).cast("string").alias("rack"), F.lit(None).cast("bigint").alias("storage_free")]
        used = F.col("used") if flag == "m" else F.lit(None).cast("bigint")
        return df.select(*BROKER_KEY, *cols, used.alias("used"), F.lit(flag).alias("side"))

    every = (side(mapped, "m", True).unionByName(side(provided, "p", False))
             .unionByName(side(discovered, "d", True)))
    is_side = {s: F.max(F.col("side") == s) for s in "mpd"}
    own = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    g = every.groupBy(*BROKER_KEY).agg(
        is_side["m"].alias("m"), is_side["p"].alias("p0"), is_side["d"].alias("d"),
        F.max("used").alias("used"), own("m", "rack").alias("m_rack"), own("d", "rack").alias("d_rack"),
        own("m", "storage_free").alias("m_free"), own("d", "storage_free").alias("d_free"))
    p = F.col("p0")
    if all_mapped:
        p = p | F.col("m")
    if all_discovered:
        p = p | F.col("d")
    g = g.withColumn("p", p)
    missing = (F.col("m") & ~F.col("d")) if use_meta else F.lit(False)
    is_new = ~F.col("m") & F.col("p") & (F.col("d") if use_meta else F.lit(True))
    lost = (~F.col("m") & F.col("p") & ~F.col("d")) if use_meta else F.lit(False)
    rack = F.coalesce(F.when(F.col("m"), F.col("m_rack")).otherwise(F.col("d_rack") if use_meta else F.lit("")), F.lit(""))
    free = F.when(F.col("m"), F.col("m_free")).otherwise(F.col("d_free") if use_meta else F.lit(0))
    in_state = F.col("m") | is_new
    return g.select(
        *BROKER_KEY, rack.alias("rack"), F.coalesce("used", F.lit(0)).cast("bigint").alias("used"),
        F.coalesce(free, F.lit(0)).cast("bigint").alias("storage_free"),
        (missing | (F.col("m") & ~F.col("p"))).alias("is_replace"), missing.alias("is_missing"), is_new.alias("is_new"),
        in_state.alias("in_state"),
        ((missing & F.col("p")) | lost).alias("counts_missing"),
        (missing & ~F.col("p")).alias("counts_old_missing"),
        (F.col("m") & ~F.col("p")).alias("counts_replace"),
        (in_state & ~missing & (rack == "") if use_meta else F.lit(False)).alias("counts_rack_missing"),
    ).filter(F.col("in_state") | F.col("counts_missing"))


def broker_state(merged: DataFrame) -> DataFrame:
    return merged.filter("in_state").select(
        *BROKER_KEY, "rack", "used", "storage_free", "is_replace", "is_missing", "is_new")


def add_back_storage(state: DataFrame, replicas: DataFrame, sizes: DataFrame, predicate: BrokerPredicate
                     ) -> tuple[DataFrame, DataFrame]:
    """(state with held partition sizes added to free storage where ``predicate`` holds, unknown brokers)."""
    held = (replicas.join(sizes, PARTITION_KEY).groupBy(*BROKER_KEY).agg(F.sum("size_bytes").alias("held")))
    freed = F.when(predicate(state), F.coalesce("held", F.lit(0))).otherwise(0)
    out = state.join(held, BROKER_KEY, "left").withColumn("storage_free", F.col("storage_free") + freed).drop("held")
    return out, held.join(state, BROKER_KEY, "left_anti").select(*BROKER_KEY)


def unsized_replicas(replicas: DataFrame, sizes: DataFrame) -> DataFrame:
    """Replicas whose partition has no known size. ``add_back_storage`` counts them as 0; a caller that must know all sizes rejects
    the clusters listed here."""
    known = sizes.filter("size_bytes is not null").select(*PARTITION_KEY)
    return replicas.join(known, PARTITION_KEY, "left_anti").select(*PARTITION_KEY, "broker_id")


def storage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Absolute and percent change of free storage for brokers in both states; percent is null from 0."""
    a = after.select(*BROKER_KEY, F.col("storage_free").alias("after_free"))
    diff = F.col("after_free") - F.col("storage_free")
    return before.join(a, BROKER_KEY).select(
        *BROKER_KEY, diff.alias("diff"), (diff / F.nullif(F.col("storage_free"), F.lit(0)) * 100).alias("diff_pct"))


def topic_brokers(replicas: DataFrame) -> DataFrame:
    return replicas.select("cluster_id", "topic", "broker_id").distinct()


def broker_partitions(replicas: DataFrame) -> DataFrame:
    return replicas.select("cluster_id", "broker_id", "topic", "partition_id").distinct()


def unknown_keys(requested: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    return requested.join(known.select(*key).distinct(), key, "left_anti")


def unmapped_brokers(live: DataFrame, replicas: DataFrame, excluded_topics: DataFrame) -> DataFrame:
    """Live brokers without a replica of any topic that is not excluded. A cluster without topics has no answer."""
    named = excluded_topics.select("topic").distinct()
    mapped = replicas.join(named, "topic", "left_anti").select(*BROKER_KEY).distinct()
    with_topics = replicas.select("cluster_id").distinct()
    return (live.select(*BROKER_KEY).join(mapped, BROKER_KEY, "left_anti")
            .join(with_topics, "cluster_id", "left_semi"))


def overlay_reassignments(partition_map: DataFrame, targets: DataFrame) -> DataFrame:
    """Partition map with pending targets in place of stored replicas."""
    t = targets.select(*PARTITION_KEY, F.col("replicas").alias("target"))
    return partition_map.join(t, PARTITION_KEY, "left").select(
        *PARTITION_KEY, F.coalesce("target", "replicas").alias("replicas"))


def reassigning_replicas(topic_state: DataFrame, targets: DataFrame) -> DataFrame:
    """Throttled replica rows of ongoing reassignments (.., role, broker_id): the leader is the source,
    targets outside the in-sync list are destinations; offline ids are skipped."""
    t = targets.select(*PARTITION_KEY, F.col("replicas").alias("target"))
    j = topic_state.select(*PARTITION_KEY, "leader", "isr").join(t, PARTITION_KEY)
    incoming = F.filter("target", lambda b: (b != OFFLINE_BROKER_ID) & ~F.array_contains(F.col("isr"), b))
    leader = F.when(F.col("leader") != OFFLINE_BROKER_ID, F.array(F.struct(
        F.lit("leaders").alias("role"), F.col("leader").alias("broker_id"))))
    follower = F.transform(incoming, lambda b: F.struct(F.lit("followers").alias("role"), b.alias("broker_id")))
    none = F.array().cast("array<struct<role:string,broker_id:bigint>>")
    return (j.select(*PARTITION_KEY, F.explode(F.concat(F.coalesce(leader, none), follower)).alias("e"))
            .select(*PARTITION_KEY, "e.role", "e.broker_id"))


def reassigning_brokers(throttled: DataFrame) -> DataFrame:
    """(cluster_id, broker_id, is_src, is_dst) of all brokers taking part in reassignments."""
    return throttled.groupBy(*BROKER_KEY).agg(
        F.max(F.col("role") == "leaders").alias("is_src"), F.max(F.col("role") == "followers").alias("is_dst"))


def topics_with_overridden_brokers(replicas: DataFrame, overrides: DataFrame, participants: DataFrame) -> DataFrame:
    """Follower entries of topics holding replicas on brokers with an active override outside reassignments."""
    active = active_overrides(overrides, participants).select(*BROKER_KEY).distinct()
    return (replicas.filter(F.col("topic") != OFFSETS_TOPIC).join(active, BROKER_KEY, "left_semi")
            .select("cluster_id", "topic", F.lit("followers").alias("role"), "partition_id",
                    throttled_entry(F.col("partition_id"), F.col("broker_id")).alias("entry")))


def merge_network_metrics(tx: DataFrame, rx: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Merge transmit and receive rows by host: only zero fields are filled, hosts of one side are kept,
    and a group whose sides count different hosts has no result."""
    whole = not group
    if whole:  # the whole table is one group
        group = ["__all"]
        tx, rx = tx.withColumn("__all", F.lit(0)), rx.withColumn("__all", F.lit(0))
    key = [*group, "host"]
    zero = F.lit(0.0)
    a = tx.select(*key, F.col("net_tx").alias("t1"), F.col("net_rx").alias("r1"), F.lit(1).alias("in_tx"))
    b = rx.select(*key, F.col("net_tx").alias("t2"), F.col("net_rx").alias("r2"), F.lit(1).alias("in_rx"))

    def fill(x: str, y: str) -> Column:
        return F.when(F.coalesce(x, zero) == 0, F.coalesce(y, zero)).otherwise(F.col(x))

    j = a.join(b, key, "full_outer")
    even = j.groupBy(*group).agg((F.count("in_tx") == F.count("in_rx")).alias("even")).filter("even")
    j = j.join(even.select(*group), group, "left_semi")
    return j.select(*key[whole:], fill("t1", "t2").alias("net_tx"), fill("r1", "r2").alias("net_rx"))


def with_host_tags(hosts: DataFrame, host_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosts with broker_id and instance_type, hosts missing either)."""
    t = host_tags.select("host", F.col("scope").alias("tag_list"))
    tagged = hosts.join(t, "host", "left").select(
        *hosts.columns, tag_value(F.col("tag_list"), "broker_id").try_cast("bigint").alias("broker_id"),
        F.nullif(tag_value(F.col("tag_list"), "instance-type"), F.lit("")).alias("instance_type"))
    bad = F.col("broker_id").isNull() | F.col("instance_type").isNull()
    return tagged.filter(~bad), tagged.filter(bad).select(*hosts.columns)


def with_default_tags(objects: DataFrame, attributes: dict[str, Column], stored: DataFrame, key: list[str]) -> DataFrame:
    """Attributes as tags, merged with stored tags; stored values win."""
    pairs: list[Column] = []
    for k, v in attributes.items():
        pairs += [F.lit(k), F.coalesce(v.cast("string"), F.lit(""))]
    none = F.create_map().cast("map<string,string>")
    return objects.join(stored.select(*key, F.col("tags").alias("stored")), key, "left").select(
        *objects.columns, merge_tags(F.create_map(*pairs), F.coalesce("stored", none)).alias("tags"))


def with_capacity(brokers: DataFrame, capacity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(brokers with capacity_mb, brokers of unknown instance type)."""
    j = brokers.join(capacity.select("instance_type", "capacity_mb"), "instance_type", "left")
    return j.filter("capacity_mb is not null"), j.filter("capacity_mb is null").drop("capacity_mb")


def apply_overrides(rates: DataFrame, broker_overrides: DataFrame, global_overrides: DataFrame) -> DataFrame:
    """Rate by precedence: broker override, global override, computed. A zero override is no override."""
    b = broker_overrides.select(*BROKER_KEY, F.nullif(F.col("rate"), F.lit(0)).cast("double").alias("b_rate"))
    g = global_overrides.select("cluster_id", F.nullif(F.col("rate"), F.lit(0)).cast("double").alias("g_rate"))
    return rates.join(b, BROKER_KEY, "left").join(g, "cluster_id", "left").select(
        *rates.drop("rate").columns, F.coalesce("b_rate", "g_rate", "rate").alias("rate"))


def racks_available(replicas: DataFrame, state: DataFrame, brokers: DataFrame) -> DataFrame:
    """Racks free for each of ``brokers`` (whose own rack is unknown): racks seen in some replica set, minus
    racks sharing a replica set with the broker.

    A rack that never shares a set with the broker is by definition seen in a set without it, so one
    pass over racks and one over shared sets is enough; no self-join of replica rows is made.
    """
    racked = replicas.join(state.select(*BROKER_KEY, "rack"), BROKER_KEY).filter("rack <> ''")
    asked = replicas.join(brokers.select(*BROKER_KEY).distinct(), BROKER_KEY, "left_semi")
    with_asked = asked.select(*PARTITION_KEY, F.col("broker_id").alias("asked_id"))
    shared = (with_asked.join(racked, PARTITION_KEY).filter("asked_id <> broker_id")
              .select("cluster_id", F.col("asked_id").alias("broker_id"), "rack").distinct())
    seen = racked.select("cluster_id", "rack").distinct()
    held = asked.select(*BROKER_KEY).distinct()
    return held.join(seen, "cluster_id").join(shared, ["cluster_id", "broker_id", "rack"], "left_anti")


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Last checkpoint of every (group, topic, partition) by log position."""
    last = F.max_by(F.struct("upstream_offset", "local_offset"), F.col("log_offset"))
    return checkpoints.groupBy("group_id", "topic", "partition_id").agg(last.alias("c")).select(
        "group_id", "topic", "partition_id", "c.upstream_offset", "c.local_offset")
