"""Tasks of the replica tables follow their rows, and the chunked maps are whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from replicalens.operators import aggregates as G
from replicalens.plans import relocation
from replicalens.sources import adapters

N = 3000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    ids = spark.range(N)
    ids.select((F.col("id") % 100).alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(0).cast("bigint").alias("s_nationkey"), F.lit(5.0).alias("s_acctbal")).distinct(
        ).write.parquet(f"{out}/supplier.parquet")
    spark.range(1).select(F.col("id").alias("n_nationkey"), F.col("id").alias("n_regionkey")).write.parquet(f"{out}/nation.parquet")
    ids.select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.concat((F.col("id") % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority")).write.parquet(
        f"{out}/orders.parquet")
    ids.select(F.col("id").alias("l_orderkey"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("l_linenumber")).select(
        "l_orderkey", ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 31) % 100).alias("l_suppkey"), "l_linenumber", F.lit("N").alias("l_returnflag"),
        F.lit(9.0).alias("l_extendedprice")).write.parquet(f"{out}/lineitem.parquet")
    return out


@pytest.mark.parametrize("table", ["replicas", "replicas_after", "partition_map", "reassignment", "topic_state"])
def test_tasks_follow_the_rows(spark, folder, monkeypatch, table):
    monkeypatch.setattr(adapters, "ROWS_PER_TASK", 3 * N // 40)
    made = getattr(adapters.Tables(spark, folder), table).select(F.spark_partition_id().alias("p")).distinct().count()
    assert made > 30


@pytest.mark.parametrize("name", ["jn08_overlay_reassignments", "src06_reassignment_documents"])
def test_joins_and_documents_keep_their_tasks(spark, folder, monkeypatch, name):
    monkeypatch.setattr(adapters, "ROWS_PER_TASK", 3 * N // 40)
    rows = entry_module.queries()[name](spark, folder).select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert rows.count() >= 9  # 15 documents for src06, dealt to 40 tasks


def test_merged_maps_read_the_line_items_once(spark, folder):
    df = entry_module.queries()["set02_merge_maps"](spark, folder)
    assert "lineitem" not in "".join(df.inputFiles())
    assert df.count() == 3 * N


def test_chunked_maps_hold_the_whole_map_of_every_chunk(spark, folder):
    rows = entry_module.queries()["pln12_chunked_maps"](spark, folder)
    per = rows.groupBy("cluster_id", "chunk").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(per) > 1 and {r.n for r in per} == {3 * N}


def test_pairs_of_a_replica_set_are_made_once(spark):
    m = spark.createDataFrame([("c", "t", 0, [1, 2, 3, 4]), ("c", "t", 1, [4, 3, 2, 1]), ("c", "t", 2, [2, 5]), ("c", "t", 3, [9]), ("c", "t", 4, [None, 1])],
                              "cluster_id string, topic string, partition_id bigint, replicas array<bigint>")
    assert G.edges(m.filter("partition_id < 3")).count() == 10 + 2
    assert {r.broker_id: r.degree for r in G.degrees(m.filter("partition_id < 4")).collect()} == {1: 3, 2: 4, 3: 3, 4: 3, 5: 1, 9: 0}
    assert {r.broker_id: r.degree for r in G.degrees(m).collect()} == {1: 4, 2: 4, 3: 3, 4: 3, 5: 1, 9: 0, None: 1}  # an open slot counts as one broker


def test_offers_carry_one_spare_and_not_every_open_broker(spark):
    cands = spark.createDataFrame([("c", "t", 0, 1, 100, 1, [(1, "a")])], "cluster_id string, topic string, partition_id bigint, src bigint, size_bytes bigint, rank bigint, "
                                  "rs array<struct<broker_id: bigint, rack: string>>")
    rows = [("c", 0.5, 1, "a", 100, True, False, 0, None, 8, 1000.0)] + [("c", 0.5, b, f"r{b}", 2000 + b, False, False, 0, b - 2, 8, 1000.0) for b in range(2, 10)]
    brokers = spark.createDataFrame(rows, "cluster_id string, tolerance double, broker_id bigint, rack string, free bigint, is_source boolean, is_closed boolean, "
                                    "moved bigint, number bigint, numbers bigint, mean double")
    offers = relocation._offers(cands, brokers, relocation._rooms(brokers, False), None, 30, False, 3)
    assert not [c for c, kind in offers.dtypes if kind.startswith("array<struct")]
    assert offers.first().spare.dst in (7, 8, 9)  # the freest three of racks that the list does not use
