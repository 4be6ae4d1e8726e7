"""The composed workflows on small clusters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from replicalens.functions.arrays import to_replicas
from replicalens.operators.throttle import Limits
from replicalens.plans import workflows as W
from tests.test_plans import check_sets, cluster


def inputs(spark, seed, **kw):
    m, z, st = cluster(spark, seed, out=0, **kw)
    meta = st.select("cluster_id", "broker_id", "rack", "storage_free")
    return m, z, st, meta, meta.select("cluster_id", "broker_id")


def test_rebuild_replaces_brokers(spark):
    m, z, st, meta, ids = inputs(spark, 11)
    provided = ids.filter("broker_id not in (101, 105)")
    out = W.rebuild(m, meta, provided, phased=True, balance_leadership=True, evacuate_brokers=[100, 102], evacuate_topics=["t"])
    final = out.maps.filter("phase = 2").collect()
    assert len(final) == 300
    assert not {101, 105} & {b for r in final for b in r.replicas}
    check_sets(final, st)
    stuck = {r.partition_id for r in out.errors.collect()}
    assert all(r.replicas[0] not in (100, 102) or r.partition_id in stuck for r in final)
    old = {r.partition_id: r.replicas for r in m.collect()}
    for r in out.maps.filter("phase = 1").collect():
        assert old[r.partition_id][0] in r.replicas
    s = out.status.first()
    assert (s["replace"], s.new, s.missing) == (2, 0, 0)
    assert "shrink" in out.actions.first().actions
    labels = {r.change for r in out.changes.select("change").distinct().collect()}
    assert labels <= {"no-op", "preferred leader", "replaced broker"}
    assert not {r.kind for r in out.violations.collect()} - {"missing_rack"}


@pytest.mark.parametrize("strategy", ["count", "storage"])
def test_forced_rebuild_and_wider_replication(spark, strategy):
    m, z, st, meta, ids = inputs(spark, 12)
    out = W.rebuild(m, meta, ids, z, strategy=strategy, force=True, replication=2)
    rows = out.maps.collect()
    assert len(rows) == 300 and out.errors.isEmpty()
    check_sets(rows, st, 2)
    wider = W.rebuild(m.withColumn("replicas", F.slice("replicas", 1, 2)), meta, ids, z, strategy=strategy, replication=3)
    rows = wider.maps.collect()
    check_sets(rows, st)
    assert sum(3 - len(r.replicas) for r in rows) == wider.errors.count()
    assert {"increased replication"} >= {r.change for r in wider.changes.filter("size(after) = 3").select("change").distinct().collect()}


def test_substitution(spark):
    m, z, st, meta, ids = inputs(spark, 13, unracked=0)
    gone = st.filter("broker_id = 103").first()
    fresh = spark.createDataFrame([("c", 900, gone.rack, 5000)], meta.schema)
    out = W.rebuild(m, meta.unionByName(fresh), ids.filter("broker_id <> 103").unionByName(fresh.select("cluster_id", "broker_id")), substitute=True)
    new = {r.partition_id: r.replicas for r in out.maps.collect()}
    for r in m.collect():
        assert new[r.partition_id] == [900 if b == 103 else b for b in r.replicas]


def test_rebalance_and_scale(spark):
    m, z, st, meta, ids = inputs(spark, 14)
    out = W.rebalance(m, meta, ids, z, tolerance=0.3, threshold=0.1, min_bytes=20)
    assert out.errors.isEmpty() and not out.moves.isEmpty()
    assert out.new_map.count() == out.moves.select("partition_id").distinct().count()
    fewer = W.rebalance(m, meta, ids.filter("broker_id <> 100"), z, tolerance=0.3, threshold=0.1, min_bytes=20)
    assert fewer.errors.first().reason == "reassignment only allows broker additions" and fewer.moves.isEmpty()
    same = W.rebalance(m, meta, ids, z, tolerance=0.3, threshold=0.0, min_bytes=20, require_new=True)
    assert same.errors.first().reason == "reassignment requires additional brokers"
    more = spark.createDataFrame([("c", 900 + i, f"n{i}", 60000) for i in range(3)], meta.schema)
    out = W.rebalance(m, meta.unionByName(more), ids.unionByName(more.select("cluster_id", "broker_id")), z, tolerance=0.9, threshold=0.0,
                      min_bytes=20, require_new=True)
    assert out.errors.isEmpty() and {r.dst for r in out.moves.collect()} <= {900, 901, 902} and not out.moves.isEmpty()


def test_throttle_tick(spark):
    st = spark.createDataFrame([("c", "t", 0, 1, [1, 2])], "cluster_id string, topic string, partition_id bigint, leader bigint, isr array<bigint>")
    tg = spark.createDataFrame([("c", "t", 0, [1, 3, 4])], "cluster_id string, topic string, partition_id bigint, replicas array<bigint>")
    net = spark.createDataFrame([("c", i, "m", 50.0, 50.0) for i in (1, 3, 4)],
                                "cluster_id string, broker_id bigint, instance_type string, net_tx double, net_rx double")
    cap = spark.createDataFrame([("m", 100.0)], "instance_type string, capacity_mb double")
    prev = spark.createDataFrame([("c", 1, "leader", 79.0), ("c", 3, "follower", 30.0)], "cluster_id string, broker_id bigint, role string, rate double")
    ov = spark.createDataFrame([("c", 4, 77)], "cluster_id string, broker_id bigint, rate bigint")
    none = spark.createDataFrame([], "cluster_id string, rate bigint")
    rates, entries, bad = W.throttle_tick(st, tg, net, cap, prev, ov, none, Limits(10, 80, 60), 10)
    got = {(r.broker_id, r.role): (round(r.rate, 3), r.apply) for r in rates.collect()}
    assert got == {(1, "leader"): (80.0, False), (3, "follower"): (48.0, True), (4, "leader"): (77.0, True), (4, "follower"): (77.0, True)}
    assert entries.count() == 3 and bad.isEmpty()


def test_storage_after(spark):
    m, z, st, meta, ids = inputs(spark, 15)
    same = W.storage_after(st, to_replicas(m), to_replicas(m), z)
    assert same.join(st.withColumnRenamed("storage_free", "f"), ["cluster_id", "broker_id"]).filter("storage_free <> f").isEmpty()
