"""Tag lifecycle: mark tag sets of lost resources, unmark returned ones, delete stale ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicalens.functions.text import without_keys
from replicalens.schemas import MARK_TAG


def mark_for_deletion(tags: DataFrame, brokers: DataFrame, topics: DataFrame, now: Column) -> DataFrame:
    """Tag table after marking. ``now`` is in epoch seconds. Broker objects whose id is no integer stay as they are."""
    alive = brokers.select(F.lit("broker").alias("object_type"), F.col("broker_id").cast("string").alias("key")).unionByName(
        topics.select(F.lit("topic").alias("object_type"), F.col("topic").alias("key"))).distinct().withColumn("alive", F.lit(True))
    number = F.col("object_id").try_cast("bigint")
    key = F.when(F.col("object_type") == "broker", number.cast("string")).otherwise(F.col("object_id"))
    skip = (F.col("object_type") == "broker") & number.isNull()
    j = tags.withColumns({"key": key, "skip": skip}).join(alive, ["object_type", "key"], "left")
    exists, marked = F.coalesce("alive", F.lit(False)), F.map_contains_key("tags", MARK_TAG)
    mark = F.map_concat("tags", F.create_map(F.lit(MARK_TAG), now.cast("string")))
    return j.select("object_type", "object_id", F.when(F.col("skip"), F.col("tags")).when(~exists & ~marked, mark)
                    .when(exists & marked, without_keys(F.col("tags"), [MARK_TAG])).otherwise(F.col("tags")).alias("tags"))


def delete_stale(tags: DataFrame, now: Column, staleness_seconds: int) -> DataFrame:
    """Tag table after the sweep: sets marked longer ago than ``staleness_seconds`` lose all keys. A mark that is
    no number counts as 0."""
    mark = F.coalesce(F.element_at("tags", MARK_TAG).try_cast("bigint"), F.lit(0))
    stale = F.map_contains_key("tags", MARK_TAG) & (now - mark > staleness_seconds)
    return tags.withColumn("tags", F.when(stale, F.create_map().cast("map<string,string>")).otherwise(F.col("tags")))
