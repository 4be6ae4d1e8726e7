"""Invariants and brute-force checks of the planners on small, lopsided clusters."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from replicalens.catalog import plans as plan_queries
from replicalens.functions.arrays import to_partition_map, to_replicas
from replicalens.operators.aggregates import storage_stats
from replicalens.plans import leadership, lines, maps, placement, relocation, repair
from replicalens.sources.adapters import Tables

STATE = ("cluster_id string, broker_id bigint, rack string, used bigint, storage_free bigint, is_replace boolean, "
         "is_missing boolean, is_new boolean")


def cluster(spark, seed, n_brokers=24, n_racks=4, n_parts=300, rf=3, unracked=2, out=3):
    """Partition map, sizes and broker state of one random cluster; racks differ in size."""
    rnd = random.Random(seed)
    racks = [f"r{min(int(rnd.expovariate(1.0)), n_racks - 1)}" for _ in range(n_brokers)]
    racks[:n_racks] = [f"r{i}" for i in range(n_racks)]
    for i in range(unracked):
        racks[-1 - i] = ""
    ids = [100 + i for i in range(n_brokers)]
    rack = dict(zip(ids, racks))
    parts, sizes, used = [], [], dict.fromkeys(ids, 0)
    for p in range(n_parts):
        s = []
        for b in rnd.sample(ids, n_brokers):
            if len(s) < rf and (rack[b] == "" or rack[b] not in [rack[x] for x in s]):
                s.append(b)
        for b in s:
            used[b] += 1
        parts.append(("c", "t", p, s))
        sizes.append(("c", "t", p, rnd.randint(1, 400)))
    gone = set(rnd.sample(ids, out))
    st = [("c", b, rack[b], used[b], rnd.randint(2000, 40000), b in gone, False, False) for b in ids]
    m = spark.createDataFrame(parts, "cluster_id string, topic string, partition_id bigint, replicas array<bigint>")
    z = spark.createDataFrame(sizes, "cluster_id string, topic string, partition_id bigint, size_bytes bigint")
    return m, z, spark.createDataFrame(st, STATE)


def check_sets(rows, state, rf=None):
    rack = {r.broker_id: r.rack for r in state.collect()}
    for r in rows:
        assert len(set(r.replicas)) == len(r.replicas)
        named = [rack[b] for b in r.replicas if rack[b]]
        assert len(set(named)) == len(named)
        if rf:
            assert len(r.replicas) == rf


def test_prefix_sums_and_locate(spark):
    rnd = random.Random(3)
    rows = [(g, f"{rnd.randrange(16):x}", i, rnd.randint(1, 9)) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "g string, b string, i int, v bigint")
    got = {(r.g, r.i): r.off for r in lines.prefix_sums(df, ["g"], ["b"], ["i"], {"off": F.col("v")}).collect()}
    for g in "ab":
        run = 0
        for _, _b, i, v in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            assert got[g, i] == run
            run += v
    segs, at = [], 0
    for k in range(60):
        n = rnd.choice([0, 1, 1, 2, 500])
        segs.append(("a", k, at, at + n, 7))
        at += n
    pts = [("a", i, rnd.randrange(at), 7) for i in range(500)]
    s = spark.createDataFrame(segs, "g string, k int, s bigint, e bigint, w bigint")
    p = spark.createDataFrame(pts, "g string, i int, pos bigint, w bigint")
    hit = {r.i: r.k for r in lines.locate(p, s, ["g"], "pos", "s", "e", "w", ["k"]).collect()}
    for _, i, pos, _w in pts:
        assert next(k for _, k, a, b, _ in segs if a <= pos < b) == hit[i]


@pytest.mark.parametrize("seed,strategy,rf", [(1, "count", 3), (2, "storage", 3), (3, "storage", 2), (4, "count", 4)])
def test_placement(spark, seed, strategy, rf):
    m, z, st = cluster(spark, seed)
    placed, errors = placement.place(z, st, rf, strategy=strategy, optimization="storage")
    rows = to_partition_map(placed).collect()
    assert len(rows) == 300 and errors.isEmpty()
    check_sets(rows, st, rf)
    lead = {}
    for r in rows:
        lead[r.replicas[0]] = lead.get(r.replicas[0], 0) + 1
    assert max(lead.values()) < 300


def test_placement_errors_and_rack_reuse(spark):
    m, z, st = cluster(spark, 5, n_brokers=8, n_racks=2, unracked=0)
    placed, errors = placement.place(z, st, 3)
    assert placed.isEmpty() and errors.count() == 300
    placed, errors = placement.place(z, st, 3, min_racks=2)
    assert errors.isEmpty()
    assert all(len(set(r.replicas)) == 3 for r in to_partition_map(placed).collect())
    for bad in ({"strategy": "x"}, {"optimization": "x"}):
        with pytest.raises(ValueError):
            placement.place(z, st, 3, **bad)


@pytest.mark.parametrize("seed,strategy,min_racks", [(1, "count", 0), (2, "count", 0), (3, "storage", 0), (4, "count", 2)])
def test_repair(spark, seed, strategy, min_racks):
    m, z, st = cluster(spark, seed, unracked=3)
    m = m.withColumn("replicas", F.when(F.col("partition_id") % 10 == 0, F.array(F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.col("replicas")[2])).otherwise(F.col("replicas")))
    rows, errors = repair.repair(m, st, strategy=strategy, sizes=z, min_racks=min_racks)
    info = {r.broker_id: r for r in st.collect()}
    live = [b for b in info.values() if not b.is_replace]
    n_racks, n_free = len({b.rack for b in live if b.rack}), sum(1 for b in live if not b.rack)
    got, failed, load = {}, {}, {}
    for r in rows.collect():
        assert (r.partition_id, r.idx) not in got
        got[r.partition_id, r.idx] = r.broker_id
    for r in errors.collect():
        failed[r.partition_id] = failed.get(r.partition_id, 0) + 1
    size = {r.partition_id: r.size_bytes for r in z.collect()}
    for p in m.collect():
        good = [b for b in p.replicas if b is not None and not info[b].is_replace]
        open_ = [i for i, b in enumerate(p.replicas) if b is None or info[b].is_replace]
        for i, b in enumerate(p.replicas):
            if i not in open_:
                assert got[p.partition_id, i] == b
        new = [got[p.partition_id, i] for i in open_ if (p.partition_id, i) in got]
        assert len(new) + failed.get(p.partition_id, 0) == len(open_)
        assert len(set(new + good)) == len(new) + len(good)
        for b in new:
            assert not info[b].is_replace
            load[b] = load.get(b, 0) + size[p.partition_id]
        used = {info[b].rack for b in good if info[b].rack}
        if min_racks == 0:
            named = [info[b].rack for b in new if info[b].rack]
            assert len(set(named)) == len(named) and not used & set(named)
            if strategy == "count":
                room = n_racks - len(used) + n_free - sum(1 for b in good if not info[b].rack)
                assert failed.get(p.partition_id, 0) == max(0, len(open_) - room)
        else:
            assert failed.get(p.partition_id, 0) == 0
            # A rack may repeat only beside enough distinct racks; brokers without rack are always free to join.
            named = [info[b].rack for b in new + good if info[b].rack]
            assert len(set(named)) == len(named) or len(set(named)) >= min_racks
    if strategy == "storage":
        assert all(v <= info[b].storage_free for b, v in load.items())


def test_leadership(spark):
    m, _z, _st = cluster(spark, 7)
    m = m.withColumn("replicas", F.array_sort("replicas"))
    out = leadership.balance_leaders(m)
    a = {r.partition_id: sorted(r.replicas) for r in m.collect()}
    b = {r.partition_id: sorted(r.replicas) for r in out.collect()}
    assert a == b
    before, after = leadership.leader_spread(m).first().spread, leadership.leader_spread(out).first().spread
    assert after < before * 0.6


@pytest.mark.parametrize("seed,scoped", [(1, False), (2, False), (3, True)])
def test_relocation(spark, seed, scoped):
    m, z, st = cluster(spark, seed, out=0)
    rep = to_replicas(m)
    src = maps.offload_targets(st, threshold=0.1)
    tolerances = [0.1, 0.3, 0.6]
    moves, scores = relocation.plan_relocations(rep, z, st, src, tolerances=tolerances, partition_limit=10, min_bytes=20, locality_scoped=scoped)
    info = {r.broker_id: r for r in st.collect()}
    sources = {r.broker_id for r in src.collect()}
    sets = {r.partition_id: list(r.replicas) for r in m.collect()}
    start = storage_stats(st).first().storage_range
    rows = moves.collect()
    assert rows
    mean0 = sum(b.storage_free for b in info.values()) / len(info)
    for t in tolerances:
        free = {b: info[b].storage_free for b in info}
        cur = {p: list(s) for p, s in sets.items()}
        for r in sorted((r for r in rows if r.tolerance == t), key=lambda r: r["round"]):
            assert r.src in sources and r.dst not in sources and r.size_bytes >= 20
            assert r.src in sets[r.partition_id] and r.dst not in cur[r.partition_id]
            cur[r.partition_id][cur[r.partition_id].index(r.src)] = r.dst
            free[r.src] += r.size_bytes
            free[r.dst] -= r.size_bytes
            if scoped:
                assert info[r.src].rack == info[r.dst].rack
        for p, s in cur.items():
            named = [info[b].rack for b in s if info[b].rack]
            assert len(set(s)) == len(s) and len(set(named)) == len(named)
        touched = {r.src for r in rows if r.tolerance == t}
        assert all(free[b] <= mean0 * (1 + t) + 1 for b in touched)
        assert all(free[b] >= mean0 * (1 - t) - 1 for b in {r.dst for r in rows if r.tolerance == t})
        sc = scores.filter(F.col("tolerance") == t).first()
        assert sc.storage_range == max(free.values()) - min(free.values()) <= start
    best = relocation.best_plan(moves, scores)
    assert best.select("tolerance").distinct().count() <= 1
    if not scoped:
        assert scores.filter("rank = 1").first().storage_range < start


def test_no_feasible_move_gives_an_empty_plan(spark):
    m, z, st = cluster(spark, 9, out=0)
    moves, scores = relocation.plan_relocations(to_replicas(m), z, st, maps.offload_targets(st, threshold=0.1), tolerances=[0.2], min_bytes=10**9)
    assert moves.isEmpty() and scores.first()["round"] == 0


def _relocate(spark, maps_, sizes, brokers, **options):
    m = spark.createDataFrame(maps_, "cluster_id string, topic string, partition_id bigint, replicas array<bigint>")
    z = spark.createDataFrame(sizes, "cluster_id string, topic string, partition_id bigint, size_bytes bigint")
    st = spark.createDataFrame(brokers, STATE)
    src = st.filter("broker_id = 1").select("cluster_id", "broker_id")
    moves, _scores = relocation.plan_relocations(to_replicas(m), z, st, src, min_bytes=0, **options)
    return moves.collect()


def test_the_only_feasible_move_is_found(spark):
    # Nine roomy brokers share a rack with the other replica, one does not; the larger partition fits nowhere.
    clusters = [f"c{i}" for i in range(10)]
    maps_ = [(c, "t", p, [1, 2]) for c in clusters for p in (0, 1)]
    sizes = [(c, "t", p, size) for c in clusters for p, size in ((0, 80), (1, 50))]
    racks = {1: "a", 11: "c"}
    brokers = [(c, b, racks.get(b, "b"), 2, 10 if b == 1 else 100, False, False, False) for c in clusters for b in range(1, 12)]
    rows = _relocate(spark, maps_, sizes, brokers, tolerances=[0.5])
    assert sorted((r.cluster_id, r.partition_id, r.src, r.dst) for r in rows) == sorted((c, 1, 1, 11) for c in clusters)


def test_rounds_go_on_until_nothing_moves(spark):
    maps_ = [("c", "t", p, [1]) for p in range(6)]
    sizes = [("c", "t", p, 10) for p in range(6)]
    brokers = [("c", b, "", 6, 0 if b == 1 else 1000, False, False, False) for b in range(1, 8)]
    rows = _relocate(spark, maps_, sizes, brokers, tolerances=[0.3], partition_limit=1)
    assert sorted(r.partition_id for r in rows) == list(range(6)) and len({r["round"] for r in rows}) == 6


def test_the_window_of_a_source_moves_on_with_its_moves(spark):
    # The three largest partitions fit nowhere: of a window of four, only the fourth place ever moves, one partition after the other.
    sizes = [("c", "t", p, 900 if p < 3 else 100 - p) for p in range(9)]
    brokers = [("c", 1, "", 9, 0, False, False, False)] + [("c", b, "", 0, 1000, False, False, False) for b in range(2, 8)]
    rows = _relocate(spark, [("c", "t", p, [1]) for p in range(9)], sizes, brokers, tolerances=[0.8], partition_limit=4)
    assert sorted(r.partition_id for r in rows) == list(range(3, 9))
    assert _relocate(spark, [("c", "t", p, [1]) for p in range(9)], sizes, brokers, tolerances=[0.8], partition_limit=3) == []


def test_repair_goes_round_again_when_storage_runs_short(spark):
    # One rack-less small broker and two large ones: slots turned away by the small one must land elsewhere.
    parts = [("c", "t", p, [None, 1]) for p in range(40)]
    m = spark.createDataFrame(parts, "cluster_id string, topic string, partition_id bigint, replicas array<bigint>")
    z = spark.createDataFrame([("c", "t", p, 10) for p in range(40)], "cluster_id string, topic string, partition_id bigint, size_bytes bigint")
    st = spark.createDataFrame([("c", 1, "a", 40, 0, False, False, False), ("c", 2, "", 0, 25, False, False, False),
                                ("c", 3, "", 0, 200, False, False, False), ("c", 4, "", 0, 205, False, False, False)], STATE)
    rows, errors = repair.repair(m, st, strategy="storage", sizes=z)
    assert errors.isEmpty()
    load = {r.broker_id: r.n for r in rows.groupBy("broker_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert load[1] == 40 and load.get(2, 0) <= 2 and load.get(3, 0) <= 20 and load.get(4, 0) <= 20


def test_unknown_sizes_and_racks_are_reported_or_neutral(spark):
    m, z, st = cluster(spark, 21)
    st = st.withColumn("rack", F.when(F.col("rack") != "", F.col("rack")))
    known = z.withColumn("size_bytes", F.when(F.col("partition_id") >= 5, F.col("size_bytes")))
    placed, errors = placement.place(known, st, 2, strategy="storage")
    assert placed.select("partition_id").distinct().count() == 295 and errors.count() == 5
    rows, errors = repair.repair(m, st, strategy="storage", sizes=z.filter("partition_id >= 5"))
    bad = errors.filter("partition_id < 5").collect()
    gone = {r.broker_id for r in st.filter("is_replace").collect()}
    assert len(bad) == sum(b in gone for r in m.filter("partition_id < 5").collect() for b in r.replicas)
    assert {r.error for r in bad} <= {"partition size not found"}
    assert rows.count() + errors.count() == 900


def test_full_placement_keeps_to_free_storage(spark):
    z = spark.range(20).selectExpr("'c' as cluster_id", "'t' as topic", "id as partition_id", "1000L as size_bytes")
    st = spark.range(4).selectExpr("'c' as cluster_id", "id as broker_id", "concat('r', id) as rack", "5L as storage_free")
    placed, errors = placement.place(z, st, 1, strategy="storage")
    assert placed.isEmpty() and errors.count() == 20
    # One broker holds all that fits: the others turn their shares away, and its room is used to the end.
    placed, errors = placement.place(z, st.withColumn("storage_free", F.expr("if(broker_id = 2, 7500L, 900L)")), 1, strategy="storage")
    assert {(r.broker_id, r.n) for r in placed.groupBy("broker_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {(2, 7)}
    assert errors.count() == 13


def test_repair_reaches_the_only_broker_that_holds_a_slot(spark):
    m = spark.range(12).selectExpr("concat('c', id) as cluster_id", "'t' as topic", "0L as partition_id", "array(cast(null as bigint)) as replicas")
    z = m.selectExpr("cluster_id", "topic", "partition_id", "100L as size_bytes")
    st = m.select("cluster_id").crossJoin(spark.range(4)).selectExpr(
        "cluster_id", "id as broker_id", "'r' as rack", "0L as used", "if(id = 1, 100L, 90L) as storage_free", "false as is_replace", "false as is_missing")
    rows, errors = repair.repair(m, st, strategy="storage", sizes=z)
    assert errors.isEmpty() and {(r.cluster_id, r.broker_id) for r in rows.collect()} == {(f"c{i}", 1) for i in range(12)}


def test_rounds_of_filling_do_not_grow_with_brokers_without_rack(spark, monkeypatch):
    rounds, write = [], repair.materialize
    monkeypatch.setattr(repair, "materialize", lambda df, name: (rounds.append(name), write(df, name))[1])
    left = spark.range(80).selectExpr("'c' as cluster_id", "'t' as topic", "id div 2 as partition_id", "cast(id % 2 as int) as idx", "100 + id div 2 as z",
                                      "md5(string(id)) as h", "substring(md5(string(id)), 1, 3) as hb")
    room = spark.range(30).selectExpr("'c' as cluster_id", "id as broker_id", "if(id < 3, 'r', cast(null as string)) as rack", "145L + id as free")
    held = left.selectExpr("cluster_id", "topic", "partition_id", "0L as broker_id").distinct()
    new, still = repair.fill(held, left, room)
    rows = new.collect()
    # Broker 0 holds a replica of every partition, so its rack is closed; each other broker holds one slot.
    assert len({r.broker_id for r in rows}) == len(rows) == 27 and min(r.broker_id for r in rows) == 3 and still.count() == 53
    assert len({(r.partition_id, r.broker_id) for r in rows}) == 27
    assert rounds.count("fill-chosen") <= 15


def test_room_is_dealt_in_order_only_where_it_is_short(spark):
    placed = spark.range(90).selectExpr("if(id = 89, cast(null as string), 'c') as cluster_id", "'t' as topic", "id as partition_id", "0 as idx", "id % 3 as broker_id", "10L as z",
                                        "md5(string(id)) as h", "substring(md5(string(id)), 1, 3) as hb")
    room = spark.createDataFrame([("c", 0, 300), ("c", 1, 55)], "cluster_id string, broker_id bigint, free bigint")
    fits, away = repair.within_room(placed, room)
    count = lambda df: {(r.broker_id, r.n) for r in df.groupBy("broker_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count(fits) == {(0, 30), (1, 5)} and count(away) == {(1, 25), (2, 29)}
    assert max(r.h for r in fits.filter("broker_id = 1").collect()) < min(r.h for r in away.filter("broker_id = 1").collect())
    ample, none = repair.within_room(placed, room.withColumn("free", F.lit(1000)).unionByName(room.limit(1).selectExpr("cluster_id", "2L as broker_id", "1000L as free")))
    assert ample.count() == 89 and none.isEmpty()


def test_repair_checks_read_the_map_and_state_once_and_count_breaches(spark, tmp_path):
    d = str(tmp_path)
    spark.range(1, 9).selectExpr("id as o_orderkey", "'F' as o_orderstatus", "'1-URGENT' as o_orderpriority").write.parquet(f"{d}/orders.parquet")
    spark.range(24).selectExpr("1 + id div 3 as l_orderkey", "id % 5 as l_suppkey", "cast(id % 3 as int) as l_linenumber", "'N' as l_returnflag",
                               "10.0D as l_extendedprice").write.parquet(f"{d}/lineitem.parquet")
    spark.range(12).selectExpr("id as s_suppkey", "string(id) as s_name", "int(id) as s_nationkey", "double(id) as s_acctbal").write.parquet(f"{d}/supplier.parquet")
    spark.range(12).selectExpr("int(id) as n_nationkey", "int(id % 6) as n_regionkey").write.parquet(f"{d}/nation.parquet")
    held, st = plan_queries.repair_input(Tables(spark, d))
    assert not [f for df in (held, st) for f in df.inputFiles() if "lineitem" in f or "orders" in f]
    assert {r.broker_id: r.used for r in st.filter("cluster_id = 'f' and used > 0").collect()} == {0: 5, 1: 5, 2: 5, 3: 5, 4: 4}
    rows, errors = repair.repair(held, st)
    good = plan_queries.repair_summary(held, st, rows, errors, 0).collect()
    assert [(r.partitions, r.slots, r.open_slots, r.errors, r.repeated_brokers, r.rack_clashes, r.moved_good) for r in good] == [(8, 24, 4, 0, 0, 0, 0)]
    # Every slot on broker 0: two repeats a partition, all good slots but broker 0's moved, and no row for the first position of partition 1.
    bad = to_replicas(held).withColumn("broker_id", F.lit(0).cast("bigint")).filter("partition_id > 1 or idx > 0")
    r = plan_queries.repair_summary(held, st, bad, errors, 0).first()
    kept = to_replicas(held).filter("broker_id <> 4")
    assert (r.slots, r.repeated_brokers) == (24, 15)
    assert r.moved_good == kept.filter("broker_id <> 0").count() + kept.filter("broker_id = 0 and partition_id = 1 and idx = 0").count()
    # Broker 0 is also what the good slots hold now, so every filled open slot repeats a rack.
    assert r.rack_clashes == to_replicas(held).filter("broker_id = 4 and (partition_id > 1 or idx > 0)").count() == 4


def test_leadership_goes_on_until_no_hand_over_is_left(spark):
    m = spark.range(300).selectExpr("'c' as cluster_id", "'t' as topic", "id as partition_id", "array(0L, 1 + id % 9, 1 + (id + 4) % 9) as replicas")
    out = leadership.balance_leaders(m).cache()
    assert leadership.hand_overs(out, leadership.leader_targets(out)).isEmpty()
    same = out.withColumnRenamed("replicas", "new").join(m, ["cluster_id", "topic", "partition_id"]).filter("array_sort(new) = array_sort(replicas)")
    assert same.count() == 300
