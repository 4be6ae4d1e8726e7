"""Rollups over replica maps, broker states, relocations and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicalens.functions.arrays import replica_set_key
from replicalens.functions.text import bytes_to_gib
from replicalens.operators.joins import storage_diff
from replicalens.schemas import BROKER_KEY


def use_stats(replicas: DataFrame) -> DataFrame:
    """Leader and follower counts per broker."""
    return replicas.groupBy(*BROKER_KEY).agg(
        F.count(F.when(F.col("idx") == 0, 1)).alias("leader"),
        F.count(F.when(F.col("idx") > 0, 1)).alias("follower"))


def edges(partition_map: DataFrame) -> DataFrame:
    """Distinct (a, b) with a <= b of brokers sharing a replica set, each broker paired with itself too.

    Replica sets are deduplicated before they fan out, so the many partitions sharing a set cost one
    row. The fan-out of a set is half the square of the replication factor.
    """
    sets = partition_map.select("cluster_id", replica_set_key(F.col("replicas")).alias("s")).distinct()
    return (sets.select("cluster_id", "s", F.posexplode("s").alias("i", "a"))
            .select("cluster_id", "a", F.explode(F.expr("slice(s, i + 1, size(s))")).alias("b")).distinct())


def degrees(partition_map: DataFrame) -> DataFrame:
    """Distinct co-located brokers of every broker; 0 for a broker that is always alone."""
    # Every pair is made once, lower id first, and counts for both its ends; (a, a) stands for the broker alone and counts 0.
    pairs = edges(partition_map).withColumn("n", F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(1))
    return pairs.select("cluster_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("broker_id"), "n").groupBy(
        "cluster_id", "broker_id").agg(F.sum("n").alias("degree"))


def degree_stats(degree: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return degree.groupBy("cluster_id").agg(
        F.coalesce(F.min("degree"), zero).alias("min_degree"), F.coalesce(F.max("degree"), zero).alias("max_degree"),
        F.coalesce(F.avg("degree"), F.lit(0.0)).alias("avg_degree"))


def storage_stats(state: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Free storage per group: min, max (from 0 up), range, spread in percent of min (null from 0), population stddev."""
    group = group or ["cluster_id"]
    g = state.groupBy(*group).agg(
        F.min("storage_free").alias("min_free"), F.greatest(F.max("storage_free"), F.lit(0)).alias("max_free"),
        F.stddev_pop("storage_free").alias("storage_stddev"))
    rng = F.col("max_free") - F.col("min_free")
    return g.withColumns({
        "storage_range": rng,
        "range_spread": rng / F.nullif(F.col("min_free"), F.lit(0)) * 100})


def topic_rollup(partition_map: DataFrame) -> DataFrame:
    return partition_map.groupBy("cluster_id", "topic").agg(
        F.count(F.lit(1)).alias("partitions"), F.max(F.size("replicas")).alias("replication"))


def broker_status(merged: DataFrame) -> DataFrame:
    """Status counters of merged brokers."""
    n = lambda c: F.count(F.when(F.col(c), 1))
    return merged.groupBy("cluster_id").agg(
        n("is_new").alias("new"), n("counts_missing").alias("missing"), n("counts_old_missing").alias("old_missing"),
        n("counts_replace").alias("replace"), n("counts_rack_missing").alias("rack_missing"))


def has_changes() -> Column:
    return (F.col("new") + F.col("missing") + F.col("old_missing") + F.col("replace")) != 0


def change_actions(status: DataFrame, *, force: bool = False, replication: int = 0, leadership: bool = False) -> DataFrame:
    """Action labels of a rebuild, derived from the status counters and the run's options."""
    delta = F.col("new") - F.col("replace")
    labels = F.filter(F.array(
        F.when((delta >= 0) & (F.col("replace") > 0), "replace"),
        F.when((delta > 0) & (F.col("replace") == 0), "expand"),
        F.when(delta < 0, "shrink"),
        F.lit("force") if force else F.lit(None), F.lit("replication") if replication > 0 else F.lit(None),
        F.lit("leadership") if leadership else F.lit(None)), lambda x: x.isNotNull())
    return status.select("cluster_id", delta.alias("change"),
                         F.when(F.size(labels) == 0, F.array(F.lit("no-op"))).otherwise(labels).alias("actions"))


def throttled_lists(throttled: DataFrame, span: int = 1000) -> DataFrame:
    """Comma-joined, sorted, deduplicated ``partition:broker`` entries per topic and role.

    A topic's list can be as long as the topic, so it is built in ranges of ``span`` partition ids; the
    ranges in order are the whole list. Entries are ordered as text inside a range.
    """
    rows = throttled.select("cluster_id", "topic", "role", F.expr(f"partition_id div {span}").alias("range_id"), "entry")
    return rows.groupBy("cluster_id", "topic", "role", "range_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("entry"))).alias("entries"))


def relocation_volume(moves: DataFrame) -> DataFrame:
    """Moves and GiB per source broker, with a total row (broker null) per cluster."""
    g = moves.groupingSets([["cluster_id", "src"], ["cluster_id"]], "cluster_id", "src").agg(
        F.count(F.lit(1)).alias("moves"), F.sum("size_bytes").alias("bytes"), F.grouping("src").alias("is_total"))
    return g.select("cluster_id", "src", (F.col("is_total") == 1).alias("is_total"), "moves",
                    bytes_to_gib(F.col("bytes")).alias("gib"))


def assignment_report(before_map: DataFrame, after_map: DataFrame, before_state: DataFrame, after_state: DataFrame,
                      before_replicas: DataFrame, after_replicas: DataFrame) -> DataFrame:
    """Before/after comparison as rows (cluster_id, phase, metric, broker_id, value)."""
    def rows(df, phase, metrics, broker=None):
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                    for m in metrics])).alias("e")
        who = F.col(broker) if broker else F.lit(None).cast("bigint")
        return df.select("cluster_id", F.lit(phase).alias("phase"), who.alias("broker_id"), pairs).select(
            "cluster_id", "phase", "e.metric", "broker_id", "e.value")

    out = None
    ranges = []
    for phase, pm, st, rep in (("before", before_map, before_state, before_replicas),
                               ("after", after_map, after_state, after_replicas)):
        storage = storage_stats(st)
        parts = [rows(degree_stats(degrees(pm)), phase, ["min_degree", "max_degree", "avg_degree"]),
                 rows(use_stats(rep), phase, ["leader", "follower"], "broker_id"),
                 rows(storage, phase, ["min_free", "max_free", "storage_range", "range_spread", "storage_stddev"])]
        ranges.append(storage.select("cluster_id", F.col("storage_range").alias(f"{phase}_range")))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    diff = rows(storage_diff(before_state, after_state), "diff", ["diff", "diff_pct"], "broker_id")
    grew = ranges[0].join(ranges[1], "cluster_id").withColumn(
        "range_increased", F.col("after_range") > F.col("before_range"))
    return out.unionByName(diff).unionByName(rows(grew, "warning", ["range_increased"]))


def names(df: DataFrame, column: str) -> DataFrame:
    return df.select("cluster_id", column).distinct()


def partition_sizes_from_points(points: DataFrame, partition: list[str], window: str) -> DataFrame:
    """Size of a partition: the largest replica at each instant, averaged over a window."""
    widest = points.groupBy(*partition, "ts").agg(F.max("value").alias("value"))
    return widest.groupBy(*partition, F.window("ts", window)["start"].alias("window_start")).agg(
        F.avg("value").alias("size"))


def replica_assignment(partition_map: DataFrame, span: int = 1000) -> DataFrame:
    """Replica lists by partition, in ranges of ``span`` partition ids: position i of a range is partition ``range_id * span + i``, null if there is no such one."""
    position = F.pmod(F.col("partition_id"), F.lit(span)).cast("int")
    ranges = partition_map.groupBy("cluster_id", "topic", F.expr(f"partition_id div {span}").alias("range_id")).agg(
        F.map_from_entries(F.collect_list(F.struct(position.alias("k"), F.col("replicas").alias("v")))).alias("held"), F.max(position).alias("top"))
    return ranges.select("cluster_id", "topic", "range_id", F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.try_element_at("held", i)).alias("assignment"))


def topic_key(table: DataFrame, name: str = "topic") -> list[str]:
    """Key of a table of objects: with its cluster, unless the table is one cluster's and has none."""
    return ["cluster_id", name] if "cluster_id" in table.columns else [name]


def topic_records(partition_map: DataFrame, configs: DataFrame, tags: DataFrame, span: int = 1000) -> DataFrame:
    """Full topic records: counts, config map, custom tags, and the replica map in ranges of partition ids."""
    part = partition_map.groupBy("cluster_id", "topic", F.expr(f"partition_id div {span}").alias("range_id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("partition_id", "replicas")))).alias("replicas"))
    none = F.create_map().cast("map<string,string>")
    return (part.join(topic_rollup(partition_map), ["cluster_id", "topic"])
            .join(configs.select(*topic_key(configs), "configs"), topic_key(configs), "left")
            .join(tags.select(*topic_key(tags), "tags"), topic_key(tags), "left")
            .select("cluster_id", "topic", "partitions", "replication", "range_id", "replicas",
                    F.coalesce("configs", none).alias("configs"), F.coalesce("tags", none).alias("tags")))


def broker_records(meta: DataFrame, tags: DataFrame) -> DataFrame:
    """Full broker records: attributes and custom tags."""
    none = F.create_map().cast("map<string,string>")
    return meta.join(tags, topic_key(tags, "broker_id"), "left").withColumn("tags", F.coalesce("tags", none))
