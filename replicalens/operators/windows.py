"""Top-k, latest-value and ordering operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replicalens.plans.lines import prefix_sums
from replicalens.schemas import BROKER_KEY, PARTITION_KEY
from replicalens.session import materialize


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    ``row_number() <= k`` lets Spark keep only k rows per group in every map task before the shuffle,
    so a group holding a third of the table does not reach one task whole. Beyond the session's limit
    for that rule, the same cut is made explicitly over salted groups first.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        salted = Window.partitionBy(*group, "__salt").orderBy(*order)
        df = (df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
              .withColumn("__r", F.row_number().over(salted)).filter(F.col("__r") <= k).drop("__r", "__salt"))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def largest_partitions(replicas: DataFrame, sizes: DataFrame, k: int, min_bytes: int = 0) -> DataFrame:
    """Top-k partitions by size of every broker, ties by partition and topic, from ``min_bytes`` up. An unknown size ranks last, as 0."""
    held = replicas.select(*PARTITION_KEY, "broker_id").join(sizes, PARTITION_KEY, "left").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))
    order = [F.col("size_bytes").desc(), F.col("partition_id"), F.col("topic")]
    return top_k(held, BROKER_KEY, order, k).filter(F.col("size_bytes") >= min_bytes)


def latest_values(points: DataFrame, series: Sequence[str]) -> DataFrame:
    """Latest non-null value of every series."""
    last = F.max_by(F.struct("ts", "value"), F.struct("ts", "value"))
    return points.filter("value is not null").groupBy(*series).agg(last.alias("p")).select(
        *series, F.col("p.ts").alias("ts"), F.col("p.value").alias("value"))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Number the rows of every group from 1 in ``order`` without sorting a group in one task.

    Rows are range-partitioned on (group, order) and written with their partition number; ranks are
    then per-partition row numbers plus the row counts of earlier partitions.
    """
    spread = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id())
    fixed = materialize(spread, "ranked")
    out = prefix_sums(fixed, group, ["__part"], order, {"__before": F.lit(1)})
    return out.withColumn(rank, (F.col("__before") + 1).cast("bigint")).drop("__part", "__before")


def brokers_by_used(state: DataFrame) -> DataFrame:
    return ranked(state, ["cluster_id"], [F.col("used"), F.col("broker_id")])


def brokers_by_storage(state: DataFrame) -> DataFrame:
    return ranked(state, ["cluster_id"], [F.col("storage_free").desc(), F.col("broker_id")])


def brokers_by_id(state: DataFrame, descending: bool = False) -> DataFrame:
    c = F.col("broker_id")
    return ranked(state, ["cluster_id"], [c.desc() if descending else c])


def brokers_shuffled(state: DataFrame, seed: int) -> DataFrame:
    """By used; equal counts in an order fixed by the seed."""
    mix = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("broker_id").cast("string")))
    return ranked(state.withColumn("mix", mix), ["cluster_id"],
                  [F.col("used"), F.col("mix"), F.col("broker_id")]).drop("mix")


def offload_order(sources: DataFrame) -> DataFrame:
    """Offload sources, fullest first."""
    return ranked(sources, ["cluster_id"], [F.col("storage_free"), F.col("broker_id")])


def rank_plans(scores: DataFrame) -> DataFrame:
    """Plans of a cluster by storage range, deviation, tolerance. A cluster has one row per tolerance."""
    w = Window.partitionBy("cluster_id").orderBy("storage_range", "storage_stddev", "tolerance")
    return scores.withColumn("rank", F.row_number().over(w))
