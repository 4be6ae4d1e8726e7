"""Golden values on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from replicalens.functions import arrays as A
from replicalens.functions import text as X
from replicalens.operators import aggregates as G
from replicalens.operators import filters as O
from replicalens.operators import joins as J
from replicalens.operators import sets as S
from replicalens.operators import tags as TG
from replicalens.operators import throttle as T
from replicalens.operators import windows as W
from replicalens.plans import affinity, maps
from replicalens.sources import sinks as K

M1 = {0: [1001, 1002], 1: [1002, 1001], 2: [1003, 1004, 1001], 3: [1004, 1003, 1002]}
M4 = {0: [1004, 1003], 1: [1003, 1004], 2: [1001, 1002], 3: [1003, 1002], 4: [1001, 1003], 5: [1002, 1001]}
SIZES = {0: 1000, 1: 1500, 2: 2000, 3: 2500, 4: 2200, 5: 4000}
B1 = {1001: ("a", 3, 100), 1002: ("b", 3, 200), 1003: ("", 2, 300), 1004: ("a", 2, 400)}
B2 = {1001: ("a", 2, 100), 1002: ("b", 2, 200), 1003: ("c", 3, 300), 1004: ("a", 2, 400), 1005: ("b", 2, 400),
      1006: ("c", 3, 400), 1007: ("a", 3, 400)}
META = {1001: ("a", 2000), 1002: ("b", 4000), 1003: ("", 6000), 1004: ("a", 8000), 1005: ("b", 10000), 1007: ("", 12000)}


def pmap(spark, *maps_, topic="test_topic"):
    rows = [("c", topic, p, r) for m in maps_ for p, r in m.items()]
    return spark.createDataFrame(rows, "cluster_id string, topic string, partition_id bigint, replicas array<bigint>")


def brokers(spark, b, **flags):
    rows = [("c", i, r, u, f, i in flags.get("replace", ()), i in flags.get("missing", ()), i in flags.get("new", ()))
            for i, (r, u, f) in b.items()]
    return spark.createDataFrame(rows, "cluster_id string, broker_id bigint, rack string, used bigint, storage_free bigint, "
                                       "is_replace boolean, is_missing boolean, is_new boolean")


def meta(spark, ids):
    return spark.createDataFrame([("c", i, *META.get(i, ("", 0))) for i in ids],
                                 "cluster_id string, broker_id bigint, rack string, storage_free bigint")


def sizes(spark, s, topic="test_topic"):
    return spark.createDataFrame([("c", topic, p, z) for p, z in s.items()],
                                 "cluster_id string, topic string, partition_id bigint, size_bytes bigint")


def ids(df, col="broker_id"):
    return sorted(r[col] for r in df.collect())


def test_use_stats(spark):
    got = {r.broker_id: (r.leader, r.follower) for r in G.use_stats(A.to_replicas(pmap(spark, M1))).collect()}
    assert got == {1001: (1, 2), 1002: (1, 2), 1003: (1, 1), 1004: (1, 1)}


def test_degree(spark):
    d = G.degrees(pmap(spark, M1, {3: [1004, 1005]}))
    assert {r.broker_id: r.degree for r in d.collect()} == {1001: 3, 1002: 3, 1003: 3, 1004: 4, 1005: 1}
    s = G.degree_stats(d).first()
    assert (s.min_degree, s.max_degree, s.avg_degree) == (1, 4, 2.8)


def test_lonely_broker_has_degree_zero(spark):
    assert G.degrees(pmap(spark, {0: [7]})).first().degree == 0


def test_storage(spark):
    s = G.storage_stats(brokers(spark, B1)).first()
    assert (s.storage_range, s.range_spread, round(s.storage_stddev, 3)) == (300, 300.0, 111.803)
    m = O.storage_means(brokers(spark, B2)).first()
    assert (round(m.hmean, 4), round(m.mean, 4)) == (247.0588, 314.2857)
    after = brokers(spark, {**B1, 1001: ("a", 3, 200), 1002: ("b", 3, 100)})
    d = {r.broker_id: (r["diff"], r.diff_pct) for r in J.storage_diff(brokers(spark, B1), after).collect()}
    assert d[1001] == (100, 100.0) and d[1002] == (-100, -50.0)


def test_spread_from_zero_is_null(spark):
    assert G.storage_stats(brokers(spark, {1: ("a", 0, 0), 2: ("a", 0, 5)})).first().range_spread is None


@pytest.mark.parametrize("above,mean,d,want", [
    (True, "hmean", 0.20, [1003, 1004, 1005, 1006, 1007]), (True, "hmean", 0.60, [1004, 1005, 1006, 1007]), (True, "hmean", 0.80, []),
    (True, "mean", 0.20, [1004, 1005, 1006, 1007]), (True, "mean", 0.60, []), (False, "hmean", 0.10, [1001, 1002]),
    (False, "hmean", 0.20, [1001]), (False, "mean", 0.10, [1001, 1002]), (False, "mean", 0.20, [1001, 1002]),
    (False, "mean", 0.60, [1001]), (True, "mean", 0.0, [])])
def test_around_mean(spark, above, mean, d, want):
    assert ids(O.around_mean(brokers(spark, B2), d, above, mean)) == want


def test_broker_orders(spark):
    by = lambda df: [r.broker_id for r in df.orderBy("rank").collect()]
    b = brokers(spark, B1)
    assert by(W.brokers_by_storage(b)) == [1004, 1003, 1002, 1001]
    assert by(W.brokers_by_used(b)) == [1003, 1004, 1001, 1002]


def test_merge_brokers(spark):
    provided = spark.createDataFrame([("c", i) for i in (1002, 1003, 1005, 1006, 1007)], "cluster_id string, broker_id bigint")
    merged = J.merge_brokers(brokers(spark, B1), provided, meta(spark, [1003, 1004, 1005, 1007]))
    s = G.broker_status(merged).first()
    assert (s.new, s.missing, s.old_missing, s["replace"], s.rack_missing) == (2, 2, 1, 2, 2)
    none = J.merge_brokers(brokers(spark, B1), provided, meta(spark, []), use_meta=False)
    s = G.broker_status(none).first()
    assert (s.new, s.missing, s.old_missing, s["replace"], s.rack_missing) == (3, 0, 0, 2, 0)
    every = J.merge_brokers(brokers(spark, B1), provided, meta(spark, META), all_mapped=True, all_discovered=True)
    s = G.broker_status(every).first()
    assert (s["replace"], s.new) == (0, 2)


def test_add_back_storage(spark):
    z = sizes(spark, {0: 30, 1: 35, 2: 60, 3: 45})
    r = A.to_replicas(pmap(spark, M1))
    got = lambda df: {x.broker_id: x.storage_free for x in df.collect()}
    out, unknown = J.add_back_storage(brokers(spark, B1), r, z, O.all_brokers)
    assert got(out) == {1001: 225, 1002: 310, 1003: 405, 1004: 505} and unknown.isEmpty()
    out, _ = J.add_back_storage(brokers(spark, B1, replace=(1003,)), r, z, O.replaced)
    assert got(out) == {1001: 100, 1002: 200, 1003: 405, 1004: 400}


def test_largest_partitions(spark):
    top = W.largest_partitions(A.to_replicas(pmap(spark, M4)), sizes(spark, SIZES), 3)
    assert [r.partition_id for r in top.filter("broker_id = 1003").orderBy("rank").collect()] == [3, 4, 1]


def test_top_k_beyond_the_group_limit_rule(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = W.top_k(df, ["g"], [F.col("v").desc()], 1500)
    assert got.count() == 3000 and got.agg(F.min("v")).first()[0] == 2000


def test_ranked_matches_row_number(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("string").alias("g"), F.hash("id").alias("v"), "id")
    got = {r.id: r["rank"] for r in W.ranked(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    rows = sorted((r.g, r.v, r.id) for r in df.collect())
    seen: dict[str, int] = {}
    for g, _v, i in rows:
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]


def test_what_changed(spark):
    cases = [([1, 2], [1, 2], "no-op"), ([1, 2], [2, 1], "preferred leader"), ([1, 2], [1, 3], "replaced broker"),
             ([1, 2, 3], [1, 2], "decreased replication"), ([1, 2], [1, 2, 3], "increased replication"),
             ([1, 2, 3], [2, 1], "decreased replication, preferred leader"), ([1, 2], [1, 3, 4], "increased replication, replaced broker")]
    df = spark.createDataFrame([(a, b, w) for a, b, w in cases], "a array<bigint>, b array<bigint>, w string")
    for r in df.select("w", A.what_changed(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.w


def test_reassignment_target(spark):
    df = spark.createDataFrame([
        ([0, 1, 2, 5], [0], [5], [0, 1, 2]), ([2, 3, 4, 5], None, [4], [2, 3, 5]), ([1, 2], [2], None, [1, 2]), ([1, 2], None, None, None)],
        "cur array<bigint>, ad array<bigint>, rm array<bigint>, want array<bigint>")
    for r in df.select("want", A.reassignment_target(F.col("cur"), F.col("ad"), F.col("rm")).alias("got")).collect():
        assert r.got == r.want


def test_set_replication_and_populate(spark):
    df = pmap(spark, {0: [1, 2, 3]})
    r = F.col("replicas")
    row = df.select(A.set_replication(r, 2).alias("a"), A.set_replication(r, 4).alias("b"), A.set_replication(r, 0).alias("c"), A.strip(r).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ([1, 2], [1, 2, 3, None], [1, 2, 3], [None] * 3)
    p = A.populate(spark.createDataFrame([("c", "t")], "cluster_id string, topic string"), F.lit(3), F.lit(2))
    assert [(x.partition_id, x.replicas) for x in p.orderBy("partition_id").collect()] == [(i, [None, None]) for i in range(3)]


def test_names_and_tags(spark):
    df = spark.createDataFrame([("topic",), ("xtopicx",), ("a.b",), ("xa.by",), ("a1",)], "topic string")
    hit = lambda p: sorted(r.topic for r in O.include_topics(df, p).collect())
    assert hit(["topic"]) == ["topic"]
    assert hit(["a.b"]) == ["a.b", "xa.by"]
    assert hit([r"a\d"]) == ["a1"]
    assert hit([]) == []
    t = spark.createDataFrame([("host:a,broker_id:5:9,zone:z",)], "s string")
    r = t.select(X.tag_value(F.col("s"), "broker_id").alias("b"), X.tag_value(F.col("s"), "none").alias("n")).first()
    assert (r.b, r.n) == ("5", "")
    g = spark.createDataFrame([(["k:v", "k:w"],), (["bad"],), (["a:b:c"],)], "e array<string>")
    assert [x.m for x in g.select(X.parse_tags(F.col("e")).alias("m")).collect()] == [{"k": "w"}, None, None]


def test_under_replicated(spark):
    df = spark.createDataFrame([("c", "test1", 0, [1001, 1002], [1001, 1002]), ("c", "test2", 1, [1002, 1003], [1003])],
                               "cluster_id string, topic string, partition_id bigint, replicas array<bigint>, isr array<bigint>")
    assert ids(O.under_replicated_topics(df), "topic") == ["test2"]


def test_unmapped_brokers(spark):
    live = spark.createDataFrame([("c", i) for i in (1001, 1002, 1003, 1004, 1005, 1007)], "cluster_id string, broker_id bigint")
    rep = A.to_replicas(pmap(spark, {0: [1001, 1002], 1: [1002]}, topic="test1").unionByName(
        pmap(spark, {0: [1003, 1002], 1: [1002, 1003]}, topic="test2")))
    ex = lambda *n: spark.createDataFrame([(x,) for x in n], "topic string")
    assert ids(J.unmapped_brokers(live, rep, ex())) == [1004, 1005, 1007]
    assert ids(J.unmapped_brokers(live, rep, ex("test1"))) == [1001, 1004, 1005, 1007]
    assert ids(J.unmapped_brokers(live, rep, ex("test1", "test2"))) == [1001, 1002, 1003, 1004, 1005, 1007]
    assert J.unmapped_brokers(live, rep.filter("false"), ex()).isEmpty()


def test_reassigning_brokers(spark):
    st = spark.createDataFrame([("c", "mock", 0, 1000, [1000, 1002]), ("c", "mock", 1, 1002, [1002, 1003]), ("c", "mock", 2, -1, [5])],
                               "cluster_id string, topic string, partition_id bigint, leader bigint, isr array<bigint>")
    tg = pmap(spark, {0: [1003, 1000, 1002], 1: [1005, 1010], 2: [-1, 5]}, topic="mock")
    r = J.reassigning_replicas(st, tg)
    got = sorted((x.role, x.partition_id, x.broker_id) for x in r.collect())
    assert got == [("followers", 0, 1003), ("followers", 1, 1005), ("followers", 1, 1010), ("leaders", 0, 1000), ("leaders", 1, 1002)]
    b = {x.broker_id: (x.is_src, x.is_dst) for x in J.reassigning_brokers(r).collect()}
    assert b == {1000: (True, False), 1002: (True, False), 1003: (False, True), 1005: (False, True), 1010: (False, True)}


def test_merge_network_metrics(spark):
    s = "host string, net_tx double, net_rx double"
    tx = spark.createDataFrame([("abc0", 40.5, 0.0), ("abc1", 1.0, 2.0)], s)
    rx = spark.createDataFrame([("abc0", 0.0, 30.0), ("abc2", 0.0, 7.0)], s)
    got = {r.host: (r.net_tx, r.net_rx) for r in J.merge_network_metrics(tx, rx).collect()}
    assert got == {"abc0": (40.5, 30.0), "abc1": (1.0, 2.0), "abc2": (0.0, 7.0)}
    g = lambda df: df.withColumn("g", F.lit(1))
    assert J.merge_network_metrics(g(tx), g(rx.limit(1)), ["g"]).isEmpty()


@pytest.mark.parametrize("role,share,want", [("leader", 80, [24, 72, 40, 10]), ("follower", 60, [18, 54, 30, 10])])
def test_headroom(spark, role, share, want):
    df = spark.createDataFrame([(0, 70.0, 0.0), (1, 80.0, 70.0), (2, 110.0, 70.0), (3, 200.0, 70.0)], "i int, util double, prev double")
    rate = T.headroom(F.col("util"), F.col("prev"), F.lit(100.0), F.lit(share), 10)
    assert [round(r.rate, 6) for r in df.select("i", rate.alias("rate")).orderBy("i").collect()] == want


def test_limits_are_checked():
    for bad in ((0, 50, 50), (1, 0, 50), (1, 100, 50), (1, 50, 0), (1, 50, 100)):
        with pytest.raises(ValueError):
            T.Limits(*bad)


def test_replication_rates(spark):
    part = spark.createDataFrame([("c", 1000, True, False), ("c", 1002, True, False), ("c", 1003, False, True), ("c", 1005, False, True),
                                  ("c", 1010, False, True)], "cluster_id string, broker_id bigint, is_src boolean, is_dst boolean")
    net = spark.createDataFrame([("c", 1000, "m", 80.0, 80.0), ("c", 1002, "m", 80.0, 80.0), ("c", 1003, "m", 80.0, 80.0),
                                 ("c", 1005, "m", 180.0, 180.0), ("c", 1010, "m", 120.0, 120.0)],
                                "cluster_id string, broker_id bigint, instance_type string, net_tx double, net_rx double")
    cap = spark.createDataFrame([("m", 200.0)], "instance_type string, capacity_mb double")
    prev = spark.createDataFrame([("c", 1000, "leader", 20.0)], "cluster_id string, broker_id bigint, role string, rate double")
    rates, bad = T.replication_rates(part, net, cap, prev, T.Limits(20, 90, 80))
    assert {(r.broker_id, r.role): round(r.rate, 6) for r in rates.collect()} == {
        (1000, "leader"): 126, (1002, "leader"): 108, (1003, "follower"): 96, (1005, "follower"): 20, (1010, "follower"): 64}
    assert bad.isEmpty()


def test_override_topics(spark):
    ov = spark.createDataFrame([("c", 1001, 50), ("c", 1002, 50), ("c", 1003, 0)], "cluster_id string, broker_id bigint, rate int")
    part = spark.createDataFrame([("c", 1002)], "cluster_id string, broker_id bigint")
    rep = A.to_replicas(pmap(spark, {0: [1001, 1002], 1: [1002]}, topic="test1").unionByName(pmap(spark, {0: [1003, 1002]}, topic="test2")))
    rows = J.topics_with_overridden_brokers(rep, ov, part).collect()
    assert [(r.topic, r.role, r.entry) for r in rows] == [("test1", "followers", "0:1001")]


def test_chunks(spark):
    nine = {p: [p + 1, (p + 1) % 9 + 1, (p + 2) % 9 + 1] for p in range(9)}
    three = {p: [p % 3 + 1, (p + 1) % 3 + 1, (p + 2) % 3 + 1] for p in range(9)}
    a, b = A.to_replicas(pmap(spark, nine)), A.to_replicas(pmap(spark, three))
    br = brokers(spark, {i: ("", 0, 0) for i in range(1, 10)})

    def sequential(step):
        cur, out = {p: list(r) for p, r in nine.items()}, []
        order = list(range(9, 0, -1))
        for i in range(0, 9, step):
            hit = set(order[i:i + step])
            new = {p: [three[p][j] if x in hit else x for j, x in enumerate(r)] for p, r in cur.items()}
            if new != cur:
                out.append(new)
            cur = new
        return out

    for step in (1, 3, 4):
        rows = maps.chunked_maps(a, b, br, step)
        full = {}
        for r in A.to_partition_map(rows, ["cluster_id", "topic", "partition_id", "chunk"]).collect():
            full.setdefault(r.chunk, {})[r.partition_id] = r.replicas
        want = sequential(step)
        assert [full[c] for c in sorted(full)] == want
        delta = A.to_partition_map(maps.chunk_changes(a, b, br, step), ["cluster_id", "topic", "partition_id", "chunk"]).collect()
        for i, c in enumerate(sorted(full)):
            before = want[i - 1] if i else nine
            changed = {p: r for p, r in want[i].items() if r != before[p]}
            assert changed.items() <= {r.partition_id: r.replicas for r in delta if r.chunk == c}.items()
    assert maps.chunked_maps(a, a, br, 3).isEmpty()


def test_phased_and_evacuated(spark):
    old = pmap(spark, {0: [1001, 1002], 1: [1003, 1004]})
    new = pmap(spark, {0: [1005, 1006], 1: [1004, 1003]})
    got = {r.partition_id: r.replicas for r in maps.phased_map(old, new).collect()}
    assert got == {0: [1001, 1005, 1006], 1: [1004, 1003]}
    m = pmap(spark, {0: [10001, 10002, 10003], 1: [10002, 10001, 10003], 2: [10003, 10002, 10001]})
    for evac in ([10001], [10001, 10002]):
        out, bad = maps.evacuate_leadership(m, evac, ["test_topic"])
        rows = {r.partition_id: r.replicas for r in out.collect()}
        assert all(r[0] not in evac for r in rows.values()) and bad.isEmpty()
        assert all(sorted(r) == [10001, 10002, 10003] for r in rows.values())
    out, bad = maps.evacuate_leadership(m, [10001, 10002, 10003], ["test_topic"])
    assert bad.count() == 3
    out, bad = maps.evacuate_leadership(m, [10001], ["other"])
    assert {r.partition_id: r.replicas for r in out.collect()}[0] == [10001, 10002, 10003]


def test_affinity(spark):
    st = brokers(spark, {1001: ("a", 3, 100), 1002: ("b", 3, 200), 1003: ("c", 2, 300), 1004: ("a", 2, 400)}, replace=(1001,), new=(1004,))
    pairs, err = affinity.substitution_affinities(st, A.to_replicas(pmap(spark, {0: [1001, 1002]})))
    assert [(r.broker_id, r.substitute_id) for r in pairs.collect()] == [(1001, 1004)] and err.isEmpty()
    # A missing broker shares sets with racks b and c only, so rack a is free for it.
    st = brokers(spark, {1001: ("", 3, 100), 1002: ("b", 3, 200), 1003: ("c", 2, 300), 1004: ("a", 2, 400), 1005: ("b", 0, 1),
                         1006: ("c", 0, 1), 1007: ("a", 0, 1)}, replace=(1001,), missing=(1001,), new=(1005, 1006, 1007))
    rep = A.to_replicas(pmap(spark, {0: [1001, 1002], 1: [1002, 1001], 2: [1003, 1001], 3: [1004, 1003]}))
    pairs, err = affinity.substitution_affinities(st, rep)
    assert [(r.broker_id, r.substitute_id) for r in pairs.collect()] == [(1001, 1007)] and err.isEmpty()
    # The second missing broker finds its first free rack used up and takes the next one.
    st = brokers(spark, {1: ("", 1, 1), 2: ("", 1, 1), 3: ("z", 1, 1), 4: ("a", 1, 1), 5: ("b", 1, 1), 11: ("a", 0, 1), 12: ("b", 0, 1)},
                 replace=(1, 2), missing=(1, 2), new=(11, 12))
    rep = A.to_replicas(pmap(spark, {0: [1, 3], 1: [2, 3], 2: [4, 5]}))
    pairs, err = affinity.substitution_affinities(st, rep)
    assert {r.broker_id: r.substitute_id for r in pairs.collect()} == {1: 11, 2: 12} and err.isEmpty()
    short, err = affinity.substitution_affinities(st.filter("broker_id <> 12"), rep)
    assert short.isEmpty() and err.first().reason == "too few new brokers"


def test_tag_lifecycle(spark):
    rows = [("broker", "1", {"a": "b"}), ("broker", "2", {"a": "b"}), ("broker", "x", {"a": "b"}), ("topic", "gone", {"a": "b"}),
            ("topic", "kept", {"a": "b", "tagMarkedForDeletionTime": "5"})]
    tags = spark.createDataFrame(rows, "object_type string, object_id string, tags map<string,string>")
    live = spark.createDataFrame([(1,)], "broker_id bigint")
    topics = spark.createDataFrame([("kept",)], "topic string")
    marked = TG.mark_for_deletion(tags, live, topics, F.lit(1000))
    got = {r.object_id: r.tags.get("tagMarkedForDeletionTime") for r in marked.collect()}
    assert got == {"1": None, "2": "1000", "x": None, "gone": "1000", "kept": None}
    again = TG.mark_for_deletion(marked, live, topics, F.lit(2000))
    assert {r.object_id: r.tags.get("tagMarkedForDeletionTime") for r in again.collect()}["gone"] == "1000"
    for now, n in ((1900, 5), (1901, 3)):
        left = TG.delete_stale(again, F.lit(now), 900)
        assert sum(1 for r in left.collect() if r.tags) == n


def test_throttle_configs(spark):
    df = spark.createDataFrame([("t1", {"x": "y"}), ("t2", {X.LEADERS_KEY: "*", "x": "y"}), ("t3", {X.FOLLOWERS_KEY: "*"})], "n string, c map<string,string>")
    on = {r.n: r.c for r in df.select("n", X.with_topic_throttle(F.col("c")).alias("c")).collect()}
    assert on["t1"] == {"x": "y", X.LEADERS_KEY: "*", X.FOLLOWERS_KEY: "*"}
    keys = [X.LEADERS_KEY, X.FOLLOWERS_KEY]
    off = {r.n: r.c for r in df.filter(X.has_any_key(F.col("c"), keys)).select("n", X.without_keys(F.col("c"), keys).alias("c")).collect()}
    assert off == {"t2": {"x": "y"}, "t3": {}}
    b = df.limit(1).select(X.with_broker_throttle(F.col("c"), F.lit(5), F.lit(0)).alias("c")).first().c
    assert b == {"x": "y", X.LEADER_RATE_KEY: "5"}


def test_compare_sets(spark):
    s = lambda *v: spark.createDataFrame([("c", x) for x in v], "k string, v string")
    r = S.compare_sets(s("a", "b"), s("a", "b", "c"), ["k"], ["v"]).first()
    assert (r.in_union, r.only_a, r.only_b, r.a_subset_of_b, r.equal) == (3, 0, 1, True, False)


def test_tag_updates_reject(spark):
    sch = "object_type string, object_id string, tags map<string,string>"
    cur = spark.createDataFrame([("broker", "1", {"a": "1", "b": "2"})], sch)
    ch = spark.createDataFrame([("broker", "1", {"a": "9"}), ("broker", "2", {"rack": "x"}), ("broker", "3", {}), (None, "4", {"a": "1"}), ("topic", "5", {"rack": "ok"})], sch)
    table, bad = K.upsert_tags(cur, ch)
    assert {(r.object_type, r.object_id): r.tags for r in table.collect()} == {("broker", "1"): {"a": "9", "b": "2"}, ("topic", "5"): {"rack": "ok"}}
    assert sorted(str(r.object_id) for r in bad.collect()) == ["2", "3", "4"]


def test_validation(spark):
    m = pmap(spark, {0: [], 1: [1001, 1001], 2: [1001, 1004], 3: [1001, 1003]})
    b = brokers(spark, B1)
    v = sorted((r.kind, r.partition_id, r.broker_id) for r in maps.validate_plan(m, b).collect() if r.partition_id is not None or r.broker_id)
    assert v == [("duplicate_broker", 1, None), ("missing_rack", None, 1003), ("rack_violation", 2, None), ("zero_replicas", 0, None)]
    assert maps.accepted_map(m, maps.validate_plan(m, b)).isEmpty()
    assert maps.accepted_map(m, maps.validate_plan(m, b), force=True).count() == 4
