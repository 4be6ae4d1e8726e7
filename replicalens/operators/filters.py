"""Filters over inventory tables. Every operator takes and returns DataFrames and stays in Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicalens.functions.text import name_matches, tags_match
from replicalens.schemas import BROKER_KEY, OFFLINE_BROKER_ID, STUB_BROKER_ID

BrokerPredicate = Callable[[DataFrame], Column]


def include_topics(df: DataFrame, patterns: Iterable[str]) -> DataFrame:
    return df.filter(name_matches(F.col("topic"), patterns))


def exclude_topics(df: DataFrame, patterns: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(rows kept, distinct names removed)."""
    hit = name_matches(F.col("topic"), list(patterns))
    names = [c for c in ("cluster_id", "topic") if c in df.columns]
    return df.filter(~hit), df.filter(hit).select(*names).distinct()


def topic_named(df: DataFrame, name: str) -> DataFrame:
    """Rows of one topic; an empty name means all."""
    return df.filter(F.col("topic") == name) if name else df


def all_brokers(_: DataFrame) -> Column:
    return F.lit(True)


def not_replaced(_: DataFrame) -> Column:
    return ~F.col("is_replace")


def replaced(_: DataFrame) -> Column:
    return F.col("is_replace")


def new_brokers(_: DataFrame) -> Column:
    return F.col("is_new")


def filter_brokers(state: DataFrame, predicate: BrokerPredicate) -> DataFrame:
    """Brokers passing ``predicate``; the stub broker never passes."""
    return state.filter((F.col("broker_id") != STUB_BROKER_ID) & predicate(state))


def brokers_in(state: DataFrame, replicas: DataFrame) -> DataFrame:
    """Brokers holding at least one replica."""
    return state.join(replicas.select(*BROKER_KEY).distinct(), BROKER_KEY, "left_semi")


def not_offline(df: DataFrame, column: str = "broker_id") -> DataFrame:
    return df.filter(F.col(column) != OFFLINE_BROKER_ID)


def storage_means(state: DataFrame) -> DataFrame:
    """Harmonic and arithmetic mean of free storage per cluster, over brokers with free > 0; null if none."""
    free = F.col("storage_free").cast("double")
    return state.groupBy("cluster_id").agg(
        (F.count(F.when(free > 0, 1)) / F.sum(F.when(free > 0, 1 / F.nullif(free, F.lit(0.0))))).alias("hmean"),
        F.avg(F.when(free > 0, free)).alias("mean"))


def around_mean(state: DataFrame, distance: float, above: bool, mean: str = "hmean") -> DataFrame:
    """Brokers whose free storage is more than ``distance`` (a fraction) above or below the cluster mean."""
    if mean not in ("hmean", "mean"):
        raise ValueError(f"unknown mean {mean}")
    if distance <= 0:
        return state.filter(F.lit(False))
    m, free = F.col(mean), F.col("storage_free")
    gap = (free - m) / m if above else (m - free) / m
    # One row per cluster: small beside the broker table, joined by measured size.
    return state.join(storage_means(state).select("cluster_id", mean), "cluster_id").filter(gap > distance).drop(mean)


def changed_partitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` whose ordered replica list differs from ``before``."""
    key = ["cluster_id", "topic", "partition_id"]
    b = before.select(*key, F.col("replicas").alias("before"))
    return after.join(b, key).filter(F.col("replicas") != F.col("before")).drop("before")


def active_overrides(overrides: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """Overrides with a rate; with ``participants``, only those of brokers outside the reassignment."""
    active = overrides.filter(F.col("rate") != 0)
    if participants is None:
        return active
    return active.join(participants.select(*BROKER_KEY).distinct(), BROKER_KEY, "left_anti")


def dynamic_configs(config_rows: DataFrame, sources: Iterable[str] = ("dynamic",)) -> DataFrame:
    return config_rows.filter(F.col("source").isin(list(sources)))


def spanning_topics(replicas: DataFrame, live: DataFrame) -> DataFrame:
    """Topics whose distinct brokers, dead ones included, are at least as many as the live brokers."""
    spread = (replicas.select("cluster_id", "topic", "broker_id").distinct()
              .groupBy("cluster_id", "topic").agg(F.count(F.lit(1)).alias("brokers")))
    alive = live.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("live_brokers"))
    return spread.join(alive, "cluster_id").filter("brokers >= live_brokers")


def under_replicated_topics(topic_state: DataFrame) -> DataFrame:
    """Topics with a partition whose in-sync list is shorter than its replica list."""
    return topic_state.filter(F.size("isr") < F.size("replicas")).select("cluster_id", "topic").distinct()


def isr_mismatch(replica_lists: DataFrame, isr_lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics whose configured and in-sync lengths differ, partitions without an in-sync row)."""
    key = ["cluster_id", "topic", "partition_id"]
    j = replica_lists.join(isr_lists.select(*key, "isr"), key, "left")
    differing = j.filter(F.size("isr") != F.size("replicas")).select("cluster_id", "topic").distinct()
    return differing, j.filter(F.col("isr").isNull()).select(*key)


def filter_by_tags(objects: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return objects.filter(tags_match(F.col("tags"), wanted))


def integer_broker_series(points: DataFrame) -> DataFrame:
    """Series with an integer broker id tag and a value."""
    from replicalens.functions.text import tag_value

    return (points.withColumn("broker_id", tag_value(F.col("scope"), "broker_id").try_cast("bigint"))
            .filter(F.col("broker_id").isNotNull() & F.col("value").isNotNull()))


def stale_datasets(ages: DataFrame, now: Column, tolerance_seconds: int) -> DataFrame:
    """(oldest_ts, age_seconds, is_stale) of a set of datasets (dataset, modified_ts): the oldest decides."""
    return ages.agg(F.min("modified_ts").alias("oldest_ts")).select(
        "oldest_ts", (F.unix_timestamp(now) - F.unix_timestamp("oldest_ts")).alias("age_seconds")
    ).withColumn("is_stale", F.col("age_seconds") > tolerance_seconds)


def file_dataset_ages(readers: dict[str, DataFrame]) -> DataFrame:
    """(dataset, modified_ts) from the file metadata of file-backed tables."""
    out = None
    for name, df in readers.items():
        one = df.select(F.lit(name).alias("dataset"), F.col("_metadata.file_modification_time").alias("m"))
        one = one.groupBy("dataset").agg(F.min("m").alias("modified_ts"))
        out = one if out is None else out.unionByName(one)
    return out


def without_metrics(state: DataFrame, metrics: DataFrame) -> DataFrame:
    """Brokers that are not missing yet have no metrics: error rows of the completeness guard."""
    have = metrics.select(*BROKER_KEY).distinct()
    return state.filter(~F.col("is_missing")).join(have, BROKER_KEY, "left_anti")


def not_pending_deletion(topics: DataFrame, pending: DataFrame) -> DataFrame:
    return topics.join(pending.select("cluster_id", "topic").distinct(), ["cluster_id", "topic"], "left_anti")


def check_requested_brokers(requested: DataFrame, live: DataFrame, replication: int) -> DataFrame:
    """Reject rows (cluster_id, broker_id, reason): unknown ids, and clusters with too few valid ids."""
    ids = requested.select(*BROKER_KEY).distinct()
    known = live.select(*BROKER_KEY).distinct().withColumn("known", F.lit(True))
    j = ids.join(known, BROKER_KEY, "left")
    unknown = j.filter("known is null").select(*BROKER_KEY, F.lit("invalid broker id").alias("reason"))
    few = (j.groupBy("cluster_id").agg(F.count("known").alias("n")).filter(F.col("n") < replication)
           .select("cluster_id", F.lit(None).cast("bigint").alias("broker_id"),
                   F.lit("too few brokers").alias("reason")))
    return unknown.unionByName(few)
