"""File round trips, rejects and stream behaviour."""

from __future__ import annotations

import datetime
import gzip
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from replicalens.operators import filters as O
from replicalens.operators import throttle as T
from replicalens.sources import checkpoint_log as C
from replicalens.sources import documents as D
from replicalens.sources import sinks as K
from replicalens.streaming import jobs as S
from replicalens.streaming import windows as W


def docs(spark, *texts, **cols):
    return spark.createDataFrame([(t,) for t in texts], "doc string")


def test_map_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "partitions": [{"topic": "t", "partition": 3, "replicas": [1, 2]}]}, indent=1))
    assert [(r.topic, r.partition_id, r.replicas) for r in D.read_maps(spark, str(tmp_path)).collect()] == [("t", 3, [1, 2])]
    (tmp_path / "b.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        D.read_maps(spark, str(tmp_path)).collect()


def test_empty_documents_are_errors_and_bad_reassignments_are_empty(spark):
    for parse in (D.parse_partition_sizes, D.parse_broker_storage):
        with pytest.raises(Exception, match="empty document"):
            parse(docs(spark, "")).collect()
    assert D.parse_reassignments(docs(spark, "", "{bad")).isEmpty()
    o = D.parse_overrides(docs(spark, "", '{"rate":5,"autoremove":true}')).collect()
    assert sorted((r.rate, r.autoremove) for r in o) == [(0, False), (5, True)]


def test_gzip_and_plain_size_documents(spark, tmp_path):
    text = json.dumps({"t1": {"0": {"Size": 10}, "1": {"Size": 12.0}}, "t2": {"0": {"Size": 1280803388090.7295}}})
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text(text)
    with gzip.open(tmp_path / "p" / "b.txt.gz", "wt") as f:
        f.write(text)
    rows = D.parse_partition_sizes(D.read_text_documents(spark, str(tmp_path / "p"))).collect()
    assert len(rows) == 6 and ("t2", 0, 1280803388090) in {(r.topic, r.partition_id, r.size_bytes) for r in rows}


def test_stub_ids_and_no_change(spark, tmp_path):
    m = spark.createDataFrame([("c", "t", 0, [None, 5])], "cluster_id string, topic string, partition_id bigint, replicas array<bigint>")
    assert json.loads(K.map_documents(m).first().doc)["partitions"][0]["replicas"] == [9223372036854775807, 5]
    K.write_map_documents(m.filter("false"), str(tmp_path / "none"))
    assert not [p for p in (tmp_path / "none" / "by_topic").rglob("*.txt")]


def test_checkpoint_golden(spark):
    row = spark.createDataFrame([(1, "test-consumer", "test", 7, 507, 101)],
                                "log_offset bigint, group_id string, topic string, partition_id bigint, upstream_offset bigint, local_offset bigint")
    rec = C.encode_checkpoints(row)
    key = b"\x00\x0dtest-consumer\x00\x04test\x00\x00\x00\x07"
    value = b"\x00\x00" + (507).to_bytes(8, "big") + (101).to_bytes(8, "big") + b"\x00\x00"
    assert (bytes(rec.first().key), bytes(rec.first().value)) == (key, value)
    big = b"\x00\x00" + b"\xff" * 8 + (101).to_bytes(8, "big") + b"\x00\x00"
    log = spark.createDataFrame([(1, key, value), (2, key, big), (3, key, b"\x00\x01" + value[2:]), (4, b"\x00\x00" + key[15:], value)],
                                "log_offset bigint, key binary, value binary")
    good, bad = C.decode_checkpoints(log)
    got = {r.log_offset: r for r in good.collect()}
    assert (got[1].group_id, got[1].topic, got[1].partition_id, int(got[1].upstream_offset), int(got[1].local_offset), got[1].metadata) == (
        "test-consumer", "test", 7, 507, 101, "")
    assert int(got[2].upstream_offset) == 2**64 - 1
    assert sorted(r.log_offset for r in bad.collect()) == [3, 4]


def test_file_ages(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    ages = O.file_dataset_ages({"x": spark.read.parquet(str(tmp_path / "x"))})
    fresh = O.stale_datasets(ages, F.current_timestamp(), 3600).first()
    stale = O.stale_datasets(ages, F.current_timestamp() + F.expr("interval 2 hours"), 3600).first()
    assert not fresh.is_stale and stale.is_stale


LIMITS = T.Limits(10, 80, 60)


def ticks(spark, n=12):
    rows = [("c", b, role, f"2024-01-01 {i:02d}:00:00", float((i * 37 + b * 11) % 140), 100.0, i == 8)
            for i in range(n) for b in (1, 2, 3) for role in ("leader", "follower")]
    return spark.createDataFrame(rows, "cluster_id string, broker_id bigint, role string, tick string, util double, capacity_mb double, reset boolean").withColumn(
        "tick", F.col("tick").cast("timestamp"))


def write_in_order(df, path, col, values):
    """One file per value with rising modification times, so a stream reads them one by one in order."""
    for v in values:
        df.filter(F.col(col) == F.lit(v)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


def test_applied_rates_over_many_batches(spark, tmp_path):
    df = ticks(spark)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write_in_order(df, src, "tick", [r.tick for r in df.select("tick").distinct().orderBy("tick").collect()])
    S.run_available(S.applied_rates_stream(S.file_stream(spark, src, 1), LIMITS, 10.0), out, "append")
    rows = S.emitted(spark, out, T.APPLIED_SCHEMA)
    assert rows.select("batch_id").distinct().count() > 5
    want = sorted(map(tuple, T.applied_rates(df, LIMITS, 10.0).collect()))
    assert sorted(map(tuple, rows.drop("batch_id").collect())) == want
    # The fold against a plain loop.
    state: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.tick):
        k = (r.broker_id, r.role)
        prev = 0.0 if r.reset else state.get(k, 0.0)
        rate = max((100 - max(r.util - prev, 0) - max(r.util - 100, 0)) * ((80 if r.role == "leader" else 60) / 100), 10)
        if prev == 0 or abs((prev - rate) / prev * 100) >= 10:
            prev = rate
        state[k] = prev
    last = {(r[1], r[2]): r[6] for r in sorted(want, key=lambda r: r[3])}
    assert last == state


def test_topics_done_over_many_batches(spark, tmp_path):
    sets = {1: "ab", 2: "bc", 3: "c", 4: "cd", 5: "a"}
    df = spark.createDataFrame([("c", i, t) for i, s in sets.items() for t in s], "cluster_id string, snapshot_ts int, topic string")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write_in_order(df, src, "snapshot_ts", list(sets))
    S.topics_done_stream(S.file_stream(spark, src, 1), out)
    got = sorted((r.snapshot_ts, r.topic) for r in S.emitted(spark, out, df.schema).collect())
    assert got == [(2, "a"), (3, "b"), (5, "c"), (5, "d")]
    assert got == sorted((r.snapshot_ts, r.topic) for r in T.topics_done(df, ["cluster_id"]).collect())


def test_clear_decisions_against_a_loop(spark):
    import random

    rnd = random.Random(4)
    rows = [("c", i, rnd.random() < 0.15, rnd.random() < 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "cluster_id string, tick int, reassigning boolean, overrides_set boolean")
    got = {r.tick: r.clear for r in T.clear_decisions(df, 5).collect()}
    known, interval = False, 0
    for _c, i, re, ov in rows:
        known = known or re or ov
        clear = not re and not ov and (known or interval == 5)
        assert got[i] == clear, i
        if clear:
            known, interval = False, 0
        interval += 1


def test_failure_modes(spark):
    df = spark.createDataFrame([("c", i, c) for i, c in enumerate([True, False, False, False, True, False])], "cluster_id string, tick int, complete boolean")
    assert [r["mode"] for r in T.failure_modes(df, 2).orderBy("tick").collect()] == [
        "computed", "retain", "retain", "minimum", "computed", "retain"]


def _points(n, seed=1):
    rnd = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    return [(start + datetime.timedelta(seconds=rnd.randrange(7200)), f"h{rnd.randrange(3)}", rnd.choice(["tx", "rx"]), rnd.choice([None, rnd.randrange(10**9)])) for _ in range(n)]


@pytest.mark.parametrize("per_trigger,fold", [(1, 2), (1, 32), (None, 32)])
def test_windows_do_not_depend_on_batches(spark, tmp_path, per_trigger, fold):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = _points(600)
    df = spark.createDataFrame([*rows, (None, "h0", "tx", 5)], "ts timestamp, host string, direction string, value long")
    df.repartition(5).write.parquet(src)
    stream = S.file_stream(spark, src, per_trigger)
    W.window_sums_stream(stream, out, "120 seconds", ["host"], W.network_sums(), fold_every=fold)
    expected = {}
    for ts, host, direction, value in rows:
        cell = expected.setdefault((ts.replace(minute=ts.minute // 2 * 2, second=0), host), {"tx": [], "rx": []})
        if value is not None:
            cell[direction].append(value)
    found = {(r.window_start, r.host): (r.tx_sum, r.tx_n, r.rx_sum, r.rx_n) for r in W.window_sums(stream, out, "120 seconds", ["host"], W.network_sums()).collect()}
    assert found == {k: (sum(c["tx"]) if c["tx"] else None, len(c["tx"]), sum(c["rx"]) if c["rx"] else None, len(c["rx"])) for k, c in expected.items()}
    assert W.late_rows(stream, out).isEmpty()


def test_late_rows_are_the_difference(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame([(b, *r) for b in range(4) for r in _points(100, b)], "b int, ts timestamp, host string, direction string, value long")
    write_in_order(df, src, "b", range(4))
    stream = S.file_stream(spark, src, 1)
    W.window_sums_stream(stream, out, "120 seconds", ["host"], W.network_sums(), lateness="30 minutes")
    newest, late, counted = None, [], 0
    for b in range(4):
        rows = _points(100, b)
        behind = [r for r in rows if newest and r[0] < newest - datetime.timedelta(minutes=30)]
        late += behind
        counted += sum(r[3] is not None for r in rows if r not in behind)
        newest = max([newest] * bool(newest) + [r[0] for r in rows])
    assert sorted((r.ts, r.host) for r in W.late_rows(stream, out).collect()) == sorted(r[:2] for r in late) and late
    sums = W.window_sums(stream, out, "120 seconds", ["host"], W.network_sums())
    assert sums.agg(F.sum(F.col("tx_n") + F.col("rx_n"))).first()[0] == counted


def test_an_empty_snapshot_ends_all_topics(spark, tmp_path):
    rows = [("c", 1, "a"), ("c", 1, "b"), ("d", 1, "x"), ("c", 2, None), ("c", 3, "a"), ("d", 3, "x"), ("c", 4, None), ("d", 4, "x")]
    df = spark.createDataFrame(rows, "cluster_id string, snapshot_ts int, topic string")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write_in_order(df, src, "snapshot_ts", [1, 2, 3, 4])
    S.topics_done_stream(S.file_stream(spark, src, 1), out)
    got = sorted((r.cluster_id, r.snapshot_ts, r.topic) for r in S.emitted(spark, out, df.schema).collect())
    assert got == [("c", 2, "a"), ("c", 2, "b"), ("c", 4, "a")]
    # The state is the newest sets alone, however many batches there were.
    assert spark.read.parquet(f"{out}-last/batch_id=3").count() == 2
