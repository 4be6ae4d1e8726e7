"""Registered queries of the throttle decisions, the tag lifecycle and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicalens.catalog.adapter_sql import add_adapters
from replicalens.catalog.base import query
from replicalens.catalog.joins import REASSIGNING_SQL, targets
from replicalens.operators import joins as J
from replicalens.operators import tags as G
from replicalens.operators import throttle as T
from replicalens.operators.windows import latest_values
from replicalens.session import materialize, scratch_path
from replicalens.streaming import jobs as S
from replicalens.streaming import windows as W

LIMITS = T.Limits(minimum=10, source_max=80, destination_max=60)

add_adapters({
    # One tick per six hours: exact mean use in cents per broker and role; every tenth day forgets applied rates.
    "fx_ticks": """
select 'c1' as cluster_id, user_id % 20 as broker_id, case when event_type in ('click', 'view') then 'leader' else 'follower' end as role,
       time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as tick,
       cast(sum(cast(round(value * 100) as bigint)) as bigint)::double / (count(*) * 10.0::double) as util, 300.0::double as capacity_mb,
       extract(day from time_bucket(interval 6 hours, ts, timestamp '1970-01-01')) % 10 = 0 and extract(hour from time_bucket(interval 6 hours, ts, timestamp '1970-01-01')) = 0 as reset
from events group by all""",
    "fx_health": """
select event_type as cluster_id, date_trunc('hour', ts) as tick, sum(event_id) % 3 = 0 as complete from events group by all""",
    "fx_snapshots": """
select distinct concat('c', cast(user_id % 3 as varchar)) as cluster_id, date_trunc('day', ts) as snapshot_ts, concat('t', cast(user_id % 40 as varchar)) as topic
from events where event_type = 'purchase'""",
    "fx_snapshot_ticks": """
select cluster_id, snapshot_ts from (select unnest(['c0', 'c1', 'c2']) as cluster_id) c, (
  select distinct date_trunc('day', ts) as snapshot_ts from events union select max(date_trunc('day', ts)) + interval 1 day from events) d""",
})


def ticks_from(events):
    t = F.window(F.col("ts").cast("timestamp_ntz"), "6 hours")["start"]
    role = F.when(F.col("event_type").isin("click", "view"), "leader").otherwise("follower")
    return events.groupBy((F.col("user_id") % 20).alias("broker_id"), role.alias("role"), t.alias("tick")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / (F.count(F.lit(1)) * 10.0)).alias("util")
    ).withColumn("tick", F.col("tick").cast("timestamp")).select(
        F.lit("c1").alias("cluster_id"), "broker_id", "role", "tick", "util", F.lit(300.0).alias("capacity_mb"),
             ((F.dayofmonth("tick") % 10 == 0) & (F.hour("tick") == 0)).alias("reset"))


def health(t):
    e = t.table("events").withColumn("tick", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return e.groupBy(F.col("event_type").alias("cluster_id"), "tick").agg((F.sum("event_id") % 3 == 0).alias("complete"))


def snapshots(t):
    u = F.col("user_id")
    return t.table("events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("c"), (u % 3).cast("string")).alias("cluster_id"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("snapshot_ts"), F.concat(F.lit("t"), (u % 40).cast("string")).alias("topic")).distinct()


def ntz(df, *cols):
    """Compare instants as UTC wall time, the form the tables store."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def as_stream(t, df, name, order):
    """Write ``df`` as files ranged by ``order`` and read them back as a stream."""
    path = scratch_path(t.spark, name)
    df.repartitionByRange(order).write.parquet(path)
    return S.file_stream(t.spark, path)


def as_batches(t, df, name, order, batches=3):
    """Write ``df`` as files of rising ``order``, one after the other, and read them back as a stream of one file a batch."""
    path = scratch_path(t.spark, name)
    ranged = materialize(df.repartitionByRange(batches, order).withColumn("part", F.spark_partition_id()), f"{name}-ranged")
    for i in range(batches):
        ranged.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return S.file_stream(t.spark, path, 1)


WINDOW_SQL = """
select time_bucket(interval 120 seconds, ts, timestamp '1970-01-01') as window_start, concat('h', user_id % 20) as host,
  cast(sum(case when event_type in ('click', 'view') then bytes end) as bigint)::double / count(case when event_type in ('click', 'view') then 1 end) / 1048576 as net_tx,
  cast(sum(case when event_type not in ('click', 'view') then bytes end) as bigint)::double / count(case when event_type not in ('click', 'view') then 1 end) / 1048576 as net_rx
from (select *, cast(round(value * 100000000) as bigint) as bytes from events) e group by 1, 2"""


def network_points(events):
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"),
        F.when(F.col("event_type").isin("click", "view"), "tx").otherwise("rx").alias("direction"),
        F.round(F.col("value") * 100000000).cast("bigint").alias("value"))


def network_windows(t, stream, lateness=None, fold_every=32):
    """(windows, late rows) of a stream of network points."""
    path = scratch_path(t.spark, "network-windows")
    W.window_sums_stream(stream, path, "120 seconds", ["host"], W.network_sums(), lateness, fold_every)
    return W.window_sums(stream, path, "120 seconds", ["host"], W.network_sums()), W.late_rows(stream, path)


def mixed_files(t, df, name, files=6):
    """Write ``df`` as files that each hold rows of all times, and read them back as a stream of one file a batch."""
    path = scratch_path(t.spark, name)
    df.repartition(files, F.xxhash64(*df.columns)).write.parquet(path)
    return S.file_stream(t.spark, path, 1)


@query("str01_network_averages", WINDOW_SQL)
def _(t):
    windows, _late = network_windows(t, network_points(S.file_stream(t.spark, f"{t.sf_dir}/events*.parquet")))
    return ntz(W.network_averages(windows), "window_start")


@query("str01_windows_of_many_batches", WINDOW_SQL)
def _(t):
    # One file a batch, every file with rows of all times, folded every other batch: the same windows.
    windows, _late = network_windows(t, mixed_files(t, network_points(t.table("events")), "network-points"), fold_every=2)
    return ntz(W.network_averages(windows), "window_start")


@query("str01_late_rows", WINDOW_SQL)
def _(t):
    # Rows over an hour behind earlier batches come out as late; counted with the others they give the same windows.
    windows, late = network_windows(t, mixed_files(t, network_points(t.table("events")), "network-points", 3), lateness="1 hour")
    path = scratch_path(t.spark, "late-windows")
    late_path = scratch_path(t.spark, "late-points")
    late.write.parquet(late_path)
    again = S.file_stream(t.spark, late_path)
    W.window_sums_stream(again, path, "120 seconds", ["host"], W.network_sums())
    both = windows.unionByName(W.window_sums(again, path, "120 seconds", ["host"], W.network_sums()))
    whole = both.groupBy("window_start", "host").agg(*[F.sum(f"{d}_{x}").alias(f"{d}_{x}") for d in ("tx", "rx") for x in ("sum", "n")])
    return ntz(W.network_averages(whole), "window_start")


ROLLED_SQL = """
with r as (select metric, scope, date_trunc('hour', ts) as ts, avg(value) as value from fx_metric_points group by all)
select metric, scope, max(ts) as ts, round(arg_max(value, ts), 6) as value from r where value is not null group by metric, scope"""


def rolled_latest(t, stream):
    path, value = scratch_path(t.spark, "rolled-points"), {"value": F.col("value")}
    W.window_sums_stream(stream, path, "3600 seconds", ["metric", "scope"], value)
    rolled = W.rolled_values(W.window_sums(stream, path, "3600 seconds", ["metric", "scope"], value), ["metric", "scope"])
    return ntz(latest_values(rolled, ["metric", "scope"]).withColumn("value", F.round("value", 6)), "ts")


@query("str02_latest_rolled_values", ROLLED_SQL)
def _(t):
    return rolled_latest(t, t.metric_points_from(S.file_stream(t.spark, f"{t.sf_dir}/events*.parquet")))


@query("str02_rolled_values_of_many_batches", ROLLED_SQL)
def _(t):
    return rolled_latest(t, mixed_files(t, t.metric_points, "metric-points", 4))


@query("str03_replication_rates", REASSIGNING_SQL + """,
b as (select cluster_id, broker_id, bool_or(role = 'leaders') as is_src, bool_or(role = 'followers') as is_dst from e group by cluster_id, broker_id),
n as (select cluster_id, broker_id, instance_type, storage_free % 250 as tx, storage_free % 170 as rx from fx_broker_meta where cluster_id <> 'p' or broker_id % 2 = 0),
bad as (select b.cluster_id, b.broker_id from b left join n using (cluster_id, broker_id) where n.tx is null),
good as (select b.*, n.tx, n.rx, case instance_type when 'it0' then 100 when 'it1' then 150 else 200 end as cap, case when broker_id % 4 = 0 then 40 else 0 end as prev
  from b join n using (cluster_id, broker_id) where cluster_id not in (select cluster_id from bad))
select cluster_id, broker_id, 'leader' as role, greatest((cap - greatest(tx - prev, 0) - greatest(tx - cap, 0)) * (80 / 100.0::double), 10)::double as rate, null as reason from good where is_src
union all
select cluster_id, broker_id, 'follower', greatest((cap - greatest(rx - prev, 0) - greatest(rx - cap, 0)) * (60 / 100.0::double), 10)::double, null from good where is_dst
union all select cluster_id, broker_id, null, null, 'no metrics' from bad""")
def _(t):
    part = J.reassigning_brokers(J.reassigning_replicas(t.topic_state, targets(t)))
    free = F.col("storage_free")
    net = t.broker_meta.filter("cluster_id <> 'p' or broker_id % 2 = 0").select(
        "cluster_id", "broker_id", "instance_type", (free % 250).cast("double").alias("net_tx"), (free % 170).cast("double").alias("net_rx"))
    cap = t.broker_meta.select("instance_type").distinct().withColumn(
        "capacity_mb", F.when(F.col("instance_type") == "it0", 100.0).when(F.col("instance_type") == "it1", 150.0).otherwise(200.0))
    prev = t.broker_meta.filter("broker_id % 4 = 0").select(
        "cluster_id", "broker_id", F.explode(F.array(F.lit("leader"), F.lit("follower"))).alias("role"), F.lit(40.0).alias("rate"))
    rates, bad = T.replication_rates(part, net, cap, prev, LIMITS)
    return rates.unionByName(bad, allowMissingColumns=True)


APPLIED_SQL = """
with recursive n as (select *, row_number() over (partition by cluster_id, broker_id, role order by tick) as i from fx_ticks),
f as (
  select cluster_id, broker_id, role, tick, i, rate, true as applied, rate as current
  from (select *, greatest((capacity_mb - greatest(util, 0) - greatest(util - capacity_mb, 0)) * ((case when role = 'leader' then 80 else 60 end) / 100.0::double), 10::double) as rate
        from n where i = 1) a
  union all
  select cluster_id, broker_id, role, tick, i, rate, prev = 0 or abs((prev - rate) / nullif(prev, 0) * 100) >= 10,
         case when prev = 0 or abs((prev - rate) / nullif(prev, 0) * 100) >= 10 then rate else prev end
  from (select x.*, greatest((capacity_mb - greatest(util - prev, 0) - greatest(util - capacity_mb, 0)) * ((case when role = 'leader' then 80 else 60 end) / 100.0::double), 10::double) as rate
        from (select n.*, case when n.reset then 0::double else f.current end as prev from n join f on n.cluster_id = f.cluster_id and n.broker_id = f.broker_id and n.role = f.role and n.i = f.i + 1) x) y)
"""


@query("str04_applied_rates", APPLIED_SQL + "select cluster_id, broker_id, role, tick, rate, applied, current from f")
def _(t):
    return ntz(T.applied_rates(ticks_from(t.table("events")), LIMITS, 10.0), "tick")


@query("str04_applied_rates_stream", APPLIED_SQL + "select cluster_id, broker_id, role, tick, rate, applied, current from f")
def _(t):
    stream = as_stream(t, ticks_from(t.table("events")), "ticks", "tick")
    path = scratch_path(t.spark, "applied-rates")
    S.run_available(S.applied_rates_stream(stream, LIMITS, 10.0), path, "append")
    return ntz(S.emitted(t.spark, path, T.APPLIED_SCHEMA).drop("batch_id"), "tick")


@query("snk03_throttle_events", APPLIED_SQL + "select cluster_id, broker_id, role, tick, rate from f where applied")
def _(t):
    stream = as_stream(t, ticks_from(t.table("events")), "ticks", "tick")
    path = scratch_path(t.spark, "throttle-events")
    S.append_events(S.applied_rates_stream(stream, LIMITS, 10.0), path)
    return ntz(S.emitted(t.spark, path, T.APPLIED_SCHEMA).drop("batch_id"), "tick")


MODES_SQL = """
with r as (select *, sum(case when complete then 1 else 0 end) over (partition by cluster_id order by tick) as run from fx_health),
c as (select cluster_id, tick, complete, cast(case when complete then 0 else count(case when not complete then 1 end) over (partition by cluster_id, run order by tick) end as bigint) as failures from r)
select cluster_id, tick, failures, case when complete then 'computed' when failures > 1 then 'minimum' else 'retain' end as mode from c"""


@query("str05_failure_modes", MODES_SQL)
def _(t):
    return ntz(T.failure_modes(health(t), 1), "tick").withColumn("failures", F.col("failures").cast("bigint"))


@query("str05_failure_modes_stream", MODES_SQL)
def _(t):
    path = scratch_path(t.spark, "failure-modes")
    S.run_available(S.failure_modes_stream(as_stream(t, health(t), "health", "tick"), 1), path, "append")
    return ntz(S.emitted(t.spark, path, S.MODE_SCHEMA).drop("batch_id"), "tick")


@query("str06_tag_lifecycle", """
with tags as (select * from fx_tags union all select 'topic', concat('t', n_nationkey), 'pool', n_name from nation
  union all select 'topic', concat('t', n_nationkey), 'tagMarkedForDeletionTime', cast(1704060000 + 4000 * n_nationkey as varchar) from nation where n_nationkey % 2 = 0),
alive as (select distinct 'broker' as object_type, cast(broker_id as varchar) as object_id from fx_replicas union select 'topic', topic from fx_replicas),
o as (select object_type, object_id, max(case when k = 'tagMarkedForDeletionTime' then v end) as mark, (object_type, object_id) in (select object_type, object_id from alive) as live
  from tags group by all),
s as (select object_type, object_id, case when live then null else coalesce(mark, '1704100000') end as mark from o)
select object_type, t.object_id, k, v from tags t join s using (object_type, object_id)
where k <> 'tagMarkedForDeletionTime' and not (mark is not null and 1704120000 - cast(mark as bigint) > 36000)
union all select object_type, object_id, 'tagMarkedForDeletionTime', mark from s where mark is not null and not 1704120000 - cast(mark as bigint) > 36000""")
def _(t):
    live = t.replicas.select("broker_id").distinct()
    topics = t.replicas.select("topic").distinct()
    n, mark = F.col("n_nationkey"), F.lit("tagMarkedForDeletionTime")
    named = t.table("nation").select(F.lit("topic").alias("object_type"), F.concat(F.lit("t"), n.cast("string")).alias("object_id"), F.when(
        n % 2 == 0, F.create_map(F.lit("pool"), F.col("n_name"), mark, (1704060000 + 4000 * n).cast("string"))).otherwise(F.create_map(F.lit("pool"), F.col("n_name"))).alias("tags"))
    marked = G.mark_for_deletion(t.tags.unionByName(named), live, topics, F.lit(1704100000))
    return G.delete_stale(marked, F.lit(1704120000), 36000).select("object_type", "object_id", F.explode("tags").alias("k", "v"))


DONE_SQL = """
with d as (select cluster_id, snapshot_ts, lead(snapshot_ts) over (partition by cluster_id order by snapshot_ts) as nxt from fx_snapshot_ticks)
select s.cluster_id, d.nxt as snapshot_ts, s.topic from fx_snapshots s join d using (cluster_id, snapshot_ts)
where d.nxt is not null and (s.cluster_id, d.nxt, s.topic) not in (select cluster_id, snapshot_ts, topic from fx_snapshots)"""


def snapshot_ticks(t):
    """Every day with an event is a snapshot of every cluster, and so is the day after the last one: many are empty."""
    days = t.table("events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("snapshot_ts")).distinct()
    days = days.unionByName(days.agg((F.max("snapshot_ts") + F.expr("interval 1 day")).alias("snapshot_ts")))
    return days.select(F.explode(F.array(*[F.lit(f"c{i}") for i in range(3)])).alias("cluster_id"), "snapshot_ts")


@query("str07_topics_done", DONE_SQL)
def _(t):
    return ntz(T.topics_done(snapshots(t), ["cluster_id"], snapshot_ticks(t)), "snapshot_ts")


@query("str07_topics_done_stream", DONE_SQL)
def _(t):
    path = scratch_path(t.spark, "topics-done")
    rows = snapshots(t).unionByName(snapshot_ticks(t).withColumn("topic", F.lit(None).cast("string")))
    S.topics_done_stream(as_batches(t, rows, "snapshots", "snapshot_ts"), path)
    out = S.emitted(t.spark, path, "cluster_id string, snapshot_ts timestamp, topic string").drop("batch_id")
    return ntz(out, "snapshot_ts")


@query("str07_topic_updates", """
with d as (select cluster_id, snapshot_ts, lag(snapshot_ts) over (partition by cluster_id order by snapshot_ts) as prv from (select distinct cluster_id, snapshot_ts from fx_snapshots) x)
select s.cluster_id, s.snapshot_ts, bool_or(p.topic is null) as update_topics from fx_snapshots s join d using (cluster_id, snapshot_ts)
left join fx_snapshots p on p.cluster_id = s.cluster_id and p.snapshot_ts = d.prv and p.topic = s.topic group by s.cluster_id, s.snapshot_ts""")
def _(t):
    return ntz(T.topic_updates(snapshots(t), ["cluster_id"]), "snapshot_ts")


@query("str08_override_actions", """
with v as (select cluster_id, broker_id, rate from fx_override union all
  select cluster_id, broker_id, case when broker_id % 2 = 0 then 0 else 50 + broker_id % 3 end from fx_provided_brokers
  where (cluster_id, broker_id) not in (select cluster_id, broker_id from fx_broker_meta)),
o as (select * from v where (cluster_id, broker_id) not in (select cluster_id, target_broker from fx_reassignment))
select cluster_id, broker_id, 'assign' as action, r.role, rate from o, (select unnest(['leader', 'follower']) as role) r where rate <> 0
union all select cluster_id, broker_id, 'remove', null, null from o where rate = 0
union all select cluster_id, broker_id, 'purge', null, null from v where rate = 0""")
def _(t):
    # Brokers that are provided but not yet part of a cluster take no part in its reassignments.
    b = F.col("broker_id")
    spare = t.provided_brokers.join(t.broker_meta, ["cluster_id", "broker_id"], "left_anti").select(
        "cluster_id", "broker_id", F.when(b % 2 == 0, F.lit(0).cast("bigint")).otherwise(50 + b % 3).alias("rate"), (b % 5 == 0).alias("autoremove"))
    part = t.reassignment.select("cluster_id", F.col("target_broker").alias("broker_id"))
    return T.override_actions(t.override.unionByName(spare), part)


@query("str08_override_topic_updates", """
with v as (select cluster_id, broker_id, (cluster_id, broker_id) in (select cluster_id, broker_id from fx_replicas) as still from fx_override where rate <> 0)
select cluster_id, bool_or(not still) as update_topics from v group by cluster_id""")
def _(t):
    before = t.override.filter("rate <> 0")
    return T.override_topic_updates(before.join(t.replicas, ["cluster_id", "broker_id"], "left_semi"), before)


@query("str09_clear_decisions", """
with x as (select cluster_id, tick, complete as busy from fx_health),
r as (select *, sum(case when busy then 1 else 0 end) over (partition by cluster_id order by tick) as run from x),
p as (select *, row_number() over (partition by cluster_id, run, busy order by tick) - 1 as pos from r)
select cluster_id, tick, not busy and pos % 4 = 0 and (run > 0 or pos > 0) as clear from p""")
def _(t):
    h = health(t).select("cluster_id", "tick", (F.col("complete") & (F.hour("tick") < 12)).alias("reassigning"),
                         (F.col("complete") & (F.hour("tick") >= 12)).alias("overrides_set"))
    return ntz(T.clear_decisions(h, 4), "tick")


@query("str09_brokers_to_clear", """
select cluster_id, broker_id from fx_broker_meta where is_live = 1 and (cluster_id, broker_id) not in (select cluster_id, broker_id from fx_override where not autoremove)""")
def _(t):
    return T.brokers_to_clear(t.broker_meta.filter("is_live = 1"), t.override)


@query("str10_offset_translation", """
select group_id, topic, partition_id, arg_max(upstream_offset, log_offset) as upstream_offset, arg_max(local_offset, log_offset) as local_offset
from fx_checkpoints group by group_id, topic, partition_id""")
def _(t):
    stream = t.checkpoints_from(S.file_stream(t.spark, f"{t.sf_dir}/events*.parquet"))
    return S.run_update(S.latest_checkpoints_stream(stream), ["group_id", "topic", "partition_id"], "checkpoints")
