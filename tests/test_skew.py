"""Tables in which one order, one supplier and one user hold a third of the rows each, against the oracles."""

from __future__ import annotations

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from replicalens.operators import throttle
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "agg01_use_stats", "agg02_degree", "agg09_throttled_lists", "agg14_topic_records", "flt11_spanning_topics", "flt12_under_replicated",
    "jn03_merge_brokers", "jn04_add_back_storage", "jn09_reassigning_replicas", "jn17_latest_checkpoints", "scl11_what_changed",
    "scl18_replica_assignment", "src01_map_documents", "win01_largest_partitions", "win03_latest_values", "win07_map_order",
    "pln01_place_by_storage", "pln02_repair_invariants", "pln05_leadership_invariants", "pln12_chunk_changes", "pln15_validate_plan",
    "str01_network_averages", "str01_windows_of_many_batches", "str04_applied_rates", "str05_failure_modes", "str09_clear_decisions", "str10_offset_translation",
    "pln01_place_largest_first", "pln12_chunked_maps",
]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    for f in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(f)
        if name not in ("lineitem.parquet", "events.parquet"):
            shutil.copyfile(f, out / name)
    i = F.xxhash64(*["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]) % 3
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    line.withColumns({"l_orderkey": F.when(i == 0, F.lit(1).cast("bigint")).otherwise(F.col("l_orderkey")),
                      "l_suppkey": F.when(i == 1, F.lit(3).cast("bigint")).otherwise(F.col("l_suppkey"))}).toPandas().to_parquet(out / "lineitem.parquet", coerce_timestamps="us")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id"))).toPandas().to_parquet(
        out / "events.parquet", coerce_timestamps="us")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_skewed(spark, skewed, name):
    ok, message = compare(spark, duck(skewed), name, entry_module.queries()[name], entry_module.oracle_sql()[name], skewed)
    assert ok, message


def test_one_cluster_of_many_ticks_is_scanned_in_many_tasks(spark):
    n = 300_000
    hash_ = F.xxhash64("tick")
    ticks = spark.range(n).select(F.lit("c").alias("cluster_id"), F.col("id").alias("tick")).withColumn("complete", (hash_ % 1000 == 0) | (hash_ % 50 == 7) & (F.col("tick") > 200_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the ticks were many enough for several tasks
    try:
        found = throttle.failure_modes(ticks, 5).orderBy("tick").select("tick", "failures", "mode").toPandas()
        assert ticks.repartitionByRange("cluster_id", "tick").select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    complete = ticks.orderBy("tick").toPandas().complete
    failures = complete.groupby(complete.cumsum()).cumcount() + (complete.cumsum() == 0)
    failures[complete] = 0
    assert (found.failures == failures).all()
    assert (found["mode"] == ["computed" if c else "minimum" if f > 5 else "retain" for c, f in zip(complete, failures)]).all()
