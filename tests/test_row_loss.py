"""Rows that earlier versions lost or mixed up."""

from __future__ import annotations

from replicalens.operators import aggregates, joins, throttle, windows
from replicalens.plans import maps
from replicalens.sources import checkpoint_log, sinks


def test_uneven_hosts_give_nothing_without_a_group(spark):
    tx = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 0.0)], "host string, net_tx double, net_rx double")
    rx = spark.createDataFrame([("a", 0.0, 3.0)], "host string, net_tx double, net_rx double")
    assert joins.merge_network_metrics(tx, rx).count() == 0
    assert joins.merge_network_metrics(tx.filter("host = 'a'"), rx).collect() == [("a", 1.0, 3.0)]


def test_every_checkpoint_record_is_decoded_or_rejected(spark):
    good = spark.createDataFrame([(1, "g", "t", 3, 10, 11)], "log_offset long, group_id string, topic string, partition_id long, upstream_offset long, local_offset long")
    log = checkpoint_log.encode_checkpoints(good)
    odd = spark.createDataFrame([(2, None, bytearray(b"\0\0")), (3, bytearray(b"\0"), None), (4, bytearray(b"\0\1g\0\1t"), bytearray(18))], "log_offset long, key binary, value binary")
    decoded, rejected = checkpoint_log.decode_checkpoints(log.unionByName(odd))
    assert [r["log_offset"] for r in decoded.collect()] == [1]
    assert sorted(r["log_offset"] for r in rejected.collect()) == [2, 3, 4]


def test_topics_of_the_last_busy_snapshot_are_done(spark):
    snapshots = spark.createDataFrame([("c", 1, "a"), ("c", 1, "b"), ("c", 2, "b")], "cluster_id string, snapshot_ts long, topic string")
    ticks = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "cluster_id string, snapshot_ts long")
    found = throttle.topics_done(snapshots, ["cluster_id"], ticks).collect()
    assert sorted((r["snapshot_ts"], r["topic"]) for r in found) == [(2, "a"), (3, "b")]


def test_unknown_sizes_rank_last_and_are_listed(spark):
    replicas = spark.createDataFrame([("c", "t", p, 1) for p in range(3)], "cluster_id string, topic string, partition_id long, broker_id long")
    sizes = spark.createDataFrame([("c", "t", 0, 5), ("c", "t", 2, 9)], "cluster_id string, topic string, partition_id long, size_bytes long")
    top = windows.largest_partitions(replicas, sizes, 3).orderBy("rank").collect()
    assert [(r["partition_id"], r["size_bytes"]) for r in top] == [(2, 9), (0, 5), (1, 0)]
    assert [r["partition_id"] for r in joins.unsized_replicas(replicas, sizes).collect()] == [1]


def test_topic_records_keep_clusters_apart(spark):
    parts = spark.createDataFrame([(c, "t", 0, [1, 2]) for c in ("c1", "c2")], "cluster_id string, topic string, partition_id long, replicas array<long>")
    values = spark.createDataFrame([("c1", "t", {"a": "1"}), ("c2", "t", {"a": "2"})], "cluster_id string, topic string, v map<string,string>")
    found = aggregates.topic_records(parts, values.withColumnRenamed("v", "configs"), values.withColumnRenamed("v", "tags")).collect()
    assert sorted((r["cluster_id"], r["configs"]["a"], r["tags"]["a"]) for r in found) == [("c1", "1", "1"), ("c2", "2", "2")]


REPLICA = "cluster_id string, topic string, partition_id bigint, idx int, broker_id bigint"


def test_chunks_drop_no_slot(spark):
    before = spark.createDataFrame([("c", "t", 0, 0, 1), ("c", "t", 0, 1, 9), ("c", "t", 1, 0, 2), ("c", "t", 2, 0, 1), ("c", "t", 3, 0, 2)], REPLICA)
    after = spark.createDataFrame([("c", "t", 0, 0, 3), ("c", "t", 0, 1, 4), ("c", "t", 1, 0, 3), ("c", "t", 1, 1, 2), ("c", "t", 2, 0, 1)], REPLICA)
    brokers = spark.createDataFrame([("c", b) for b in (1, 2, 3, 4)], "cluster_id string, broker_id bigint")
    spans = maps.chunk_spans(before, after, brokers, 1)
    for chunk, first in ((-1, 1), (2, 1), (3, 3), (9, 3)):  # broker 1 is the fourth from above
        got = {(r.partition_id, r.idx): r.broker_id for r in maps.map_at(spans, chunk).collect()}
        assert got == {(0, 0): first, (0, 1): 9, (1, 0): 2, (2, 0): 1, (3, 0): 2}
    errors = {(r.partition_id, r.idx, r.error) for r in maps.chunk_errors(before, after, brokers).collect()}
    assert errors == {(0, 1, "broker not listed"), (1, None, "replication factor changes"), (3, None, "replication factor changes")}
    assert [(r.partition_id, r.idx, r.chunk, r.broker_id) for r in maps.chunk_changes(before, after, brokers, 1).orderBy("idx").collect()] == [(0, 0, 3, 3), (0, 1, 3, 9)]


TAGS = "object_type string, object_id string, tags map<string,string>"


def test_many_requests_of_one_object_are_one_row(spark):
    current = spark.createDataFrame([("topic", "x", {"a": "1", "b": "2", "c": "3"})], TAGS)
    changes = spark.createDataFrame([("topic", "x", {"a": "new"}, 2), ("topic", "x", {"a": "old", "d": "4"}, 1), ("topic", "y", {"e": "5"}, 1)], TAGS + ", seq int")
    table, bad = sinks.upsert_tags(current, changes, "seq")
    assert {r.object_id: r.tags for r in table.collect()} == {"x": {"a": "new", "b": "2", "c": "3", "d": "4"}, "y": {"e": "5"}} and bad.isEmpty()
    requests = spark.createDataFrame([("topic", "x", ["a:1"]), ("topic", "x", ["b", "b"]), ("topic", "z", ["a"])], "object_type string, object_id string, keys array<string>")
    table, bad = sinks.delete_tags(current, requests)
    assert [(r.object_id, r.tags) for r in table.collect()] == [("x", {"c": "3"})] and [r.object_id for r in bad.collect()] == ["z"]


def test_tag_log_takes_the_last_word(spark):
    current = spark.createDataFrame([("topic", "x", {"a": "1", "b": "2"})], TAGS)
    rows = [("topic", "x", 5, None, ["a"]), ("topic", "x", 3, {"a": "three"}, None), ("topic", "x", 7, {"c": "seven"}, None), ("topic", "n", 1, {"k": "v"}, None),
            ("topic", "n", 2, None, ["k"]), ("topic", "n", 0, None, ["k"]), ("topic", "u", 1, None, ["k"]), ("topic", "x", 9, {"name": "reserved"}, None), ("topic", "x", 8, {}, None)]
    log = spark.createDataFrame(rows, "object_type string, object_id string, seq int, tags map<string,string>, keys array<string>")
    table, bad = sinks.apply_tag_log(current, log)
    assert {r.object_id: r.tags for r in table.collect()} == {"x": {"b": "2", "c": "seven"}, "n": {}}
    assert sorted((r.object_id, r.seq) for r in bad.collect()) == [("n", 0), ("u", 1), ("x", 8), ("x", 9)]
