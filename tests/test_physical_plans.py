"""Physical plans: what must be pushed down, pruned, pre-limited and kept out of Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicalens.operators import aggregates as G
from replicalens.operators import filters as O
from replicalens.operators import windows as W
from replicalens.sources.adapters import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_name_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    Tables(spark, SF).partition_map.write.parquet(path)
    text = plan(O.include_topics(spark.read.parquet(path), ["t1", "t2"]).select("partition_id"))
    assert "In(topic" in text and "replicas" not in text.split("ReadSchema")[1]


def test_relational_core_has_no_python_and_no_products(spark):
    t = Tables(spark, SF)
    for df in (G.use_stats(t.replicas), G.degrees(t.partition_map), O.spanning_topics(t.replicas, t.broker_meta),
               O.around_mean(t.broker_meta, 0.1, True)):
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    t = Tables(spark, SF)
    assert plan(W.largest_partitions(t.replicas, t.partition_size, 30)).count("WindowGroupLimit") == 2


def test_adapter_shuffles(spark):
    """Line items are pre-aggregated, and the replica order reuses the join's partitioning."""
    text = plan(Tables(spark, SF).replicas.groupBy("cluster_id", "broker_id").agg(F.count(F.lit(1))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(Tables(spark, SF).replicas)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 3
