"""Set operations over id and name sets, maps and configs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.schemas import PARTITION_KEY


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def union_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def compare_sets(a: DataFrame, b: DataFrame, key: list[str], members: list[str]) -> DataFrame:
    """Per ``key``: size of the union, members only in a or only in b, subset and equality flags."""
    both = (a.select(*key, *members, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
            .unionByName(b.select(*key, *members, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))))
    one = both.groupBy(*key, *members).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return one.groupBy(*key).agg(
        F.count(F.lit(1)).alias("in_union"),
        F.count(F.when(F.col("in_b") == 0, 1)).alias("only_a"),
        F.count(F.when(F.col("in_a") == 0, 1)).alias("only_b"),
    ).withColumns({"a_subset_of_b": F.col("only_a") == 0, "equal": (F.col("only_a") == 0) & (F.col("only_b") == 0)})


def merge_maps(*maps: DataFrame) -> DataFrame:
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out


def maps_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per topic: partitions whose ordered replicas differ or that one map lacks; equal when none."""
    other = b.select(*PARTITION_KEY, F.col("replicas").alias("other"))
    diff = ~F.col("replicas").eqNullSafe(F.col("other"))
    return a.join(other, PARTITION_KEY, "full_outer").groupBy("cluster_id", "topic").agg(
        F.count(F.when(diff, 1)).alias("differing")).withColumn("equal", F.col("differing") == 0)


def config_diff(current: DataFrame, desired: DataFrame, key: list[str]) -> DataFrame:
    """Apply desired key rows to current ones: an empty value deletes the key, keys not named are kept.
    ``changed`` says whether a key's value moves."""
    d = desired.select(*key, "k", F.col("v").alias("want"))
    return current.join(d, [*key, "k"], "full_outer").select(
        *key, "k", (F.coalesce("v", F.lit("")) != F.coalesce("want", "v", F.lit(""))).alias("changed"),
        F.when(F.col("want").isNull(), F.col("v")).otherwise(F.nullif(F.col("want"), F.lit(""))).alias("new_value"))
