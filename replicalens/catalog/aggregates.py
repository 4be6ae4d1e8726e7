"""Registered queries of aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicalens.catalog.adapter_sql import add_adapters
from replicalens.catalog.base import query
from replicalens.catalog.filters import live_meta, merged, state
from replicalens.functions.arrays import render, to_replicas
from replicalens.operators import aggregates as A
from replicalens.operators import joins as J
from replicalens.operators import sets as S
from replicalens.operators import windows as W
from replicalens.schemas import PARTITION_KEY
from replicalens.session import materialize

add_adapters({
    "fx_degree": """
select cluster_id, a as broker_id, count(distinct b) - 1 as degree from (
  select x.cluster_id, x.broker_id as a, y.broker_id as b from fx_replicas x join fx_replicas y using (cluster_id, topic, partition_id))
group by cluster_id, a""",
    "fx_degree_after": """
select cluster_id, a as broker_id, count(distinct b) - 1 as degree from (
  select x.cluster_id, x.broker_id as a, y.broker_id as b from fx_replicas_after x join fx_replicas_after y using (cluster_id, topic, partition_id))
group by cluster_id, a""",
    "fx_moves": """
select b.cluster_id, b.topic, b.partition_id, b.broker_id as src, a.broker_id as dst, s.size_bytes
from fx_replicas b join fx_replicas_after a using (cluster_id, topic, partition_id, idx)
join fx_partition_size s using (cluster_id, topic, partition_id) where a.broker_id <> b.broker_id""",
    "fx_meta_after": """
select m.cluster_id, m.broker_id, m.rack,
  cast(m.storage_free + coalesce((select sum(size_bytes) from fx_moves v where v.cluster_id = m.cluster_id and v.src = m.broker_id), 0)
  - coalesce((select sum(size_bytes) from fx_moves v where v.cluster_id = m.cluster_id and v.dst = m.broker_id), 0) as bigint) as storage_free
from fx_broker_meta m""",
    "fx_status": """
select cluster_id, count(case when is_new then 1 end) as new,
  count(case when (is_missing and is_provided) or not in_state then 1 end) as missing,
  count(case when is_missing and not is_provided then 1 end) as old_missing,
  count(case when in_state and not is_new and not is_provided then 1 end) as replace,
  count(case when in_state and not is_missing and rack = '' then 1 end) as rack_missing
from fx_merged group by cluster_id""",
})


def moves(t):
    """Relocations between the two fixture maps."""
    after = t.replicas_after.withColumnRenamed("broker_id", "dst")
    return (t.replicas.join(after, [*PARTITION_KEY, "idx"]).filter("broker_id <> dst")
            .join(t.partition_size, PARTITION_KEY)
            .select(*PARTITION_KEY, F.col("broker_id").alias("src"), "dst", "size_bytes"))


def meta_after(t):
    m = moves(t)
    delta = (m.select("cluster_id", F.col("src").alias("broker_id"), F.col("size_bytes").alias("d"))
             .unionByName(m.select("cluster_id", F.col("dst").alias("broker_id"), (-F.col("size_bytes")).alias("d")))
             .groupBy("cluster_id", "broker_id").agg(F.sum("d").alias("d")))
    return t.broker_meta.join(delta, ["cluster_id", "broker_id"], "left").select(
        "cluster_id", "broker_id", "rack", (F.col("storage_free") + F.coalesce("d", F.lit(0))).alias("storage_free"))


@query("agg01_use_stats", """
select cluster_id, broker_id, count(case when idx = 0 then 1 end) as leader, count(case when idx > 0 then 1 end) as follower
from fx_replicas group by cluster_id, broker_id""")
def _(t):
    return A.use_stats(t.replicas)


@query("agg02_degree", "select cluster_id, broker_id, degree from fx_degree")
def _(t):
    return A.degrees(t.partition_map)


@query("agg03_degree_stats", """
select cluster_id, min(degree) as min_degree, max(degree) as max_degree, avg(degree) as avg_degree from fx_degree group by cluster_id""")
def _(t):
    return A.degree_stats(A.degrees(t.partition_map))


STORAGE_STATS_SQL = """
select cluster_id, min(storage_free) as min_free, greatest(max(storage_free), 0) as max_free, stddev_pop(storage_free) as storage_stddev,
       greatest(max(storage_free), 0) - min(storage_free) as storage_range,
       (greatest(max(storage_free), 0) - min(storage_free)) / nullif(min(storage_free), 0)::double * 100 as range_spread
from fx_broker_meta group by cluster_id"""


@query("agg04_storage_range", f"select cluster_id, min_free, max_free, storage_range, range_spread from ({STORAGE_STATS_SQL}) x")
def _(t):
    return A.storage_stats(t.broker_meta).select("cluster_id", "min_free", "max_free", "storage_range", "range_spread")


@query("agg05_storage_stddev", f"select cluster_id, round(storage_stddev, 3) as storage_stddev from ({STORAGE_STATS_SQL}) x")
def _(t):
    return A.storage_stats(t.broker_meta).select("cluster_id", F.round("storage_stddev", 3).alias("storage_stddev"))


@query("agg06_storage_means", """
select cluster_id, round(count(case when storage_free > 0 then 1 end) / sum(case when storage_free > 0 then 1 / storage_free::double end), 3) as hmean,
       round(avg(case when storage_free > 0 then storage_free end), 3) as mean
from fx_broker_meta group by cluster_id""")
def _(t):
    from replicalens.operators.filters import storage_means

    return storage_means(t.broker_meta).select("cluster_id", F.round("hmean", 3).alias("hmean"), F.round("mean", 3).alias("mean"))


@query("agg07_topic_rollup", """
select cluster_id, topic, count(*) as partitions, cast(max(len(replicas)) as int) as replication from fx_map group by cluster_id, topic""")
def _(t):
    return A.topic_rollup(t.partition_map)


@query("agg08_change_actions", """
select s.*, new - replace as change, new + missing + old_missing + replace <> 0 as changed,
  array_to_string(list_filter([case when new >= replace and replace > 0 then 'replace' end,
    case when new > replace and replace = 0 then 'expand' end, case when new < replace then 'shrink' end, 'replication'], lambda x: x is not null), ',') as actions
from fx_status s""")
def _(t):
    s = A.broker_status(merged(t)).withColumn("changed", A.has_changes())
    act = A.change_actions(s, replication=3).withColumn("actions", F.array_join("actions", ","))
    return s.join(act, "cluster_id")


@query("agg09_throttled_lists", """
with e as (
 select distinct r.cluster_id, r.topic, r.partition_id, 'leaders' as role, concat(r.partition_id, ':', r.broker_id) as entry
 from fx_replicas r join fx_reassignment x using (cluster_id, topic, partition_id) where r.idx = 0
 union
 select distinct x.cluster_id, x.topic, x.partition_id, 'followers', concat(x.partition_id, ':', x.target_broker)
 from fx_reassignment x left join (select * from fx_replicas where in_isr = 1) i
   on i.cluster_id = x.cluster_id and i.topic = x.topic and i.partition_id = x.partition_id and i.broker_id = x.target_broker
 where i.broker_id is null)
select cluster_id, topic, role, partition_id // 1000 as range_id, string_agg(entry, ',' order by entry) as entries
from e group by cluster_id, topic, role, partition_id // 1000""")
def _(t):
    from replicalens.catalog.joins import throttled

    return A.throttled_lists(throttled(t))


@query("agg10_relocation_volume", """
select cluster_id, src, src is null as is_total, count(*) as moves, cast(sum(size_bytes) as bigint) / 1073741824.0::double as gib
from fx_moves group by grouping sets ((cluster_id, src), (cluster_id))""")
def _(t):
    return A.relocation_volume(moves(t))


@query("agg11_assignment_report", """
with st as (
 select 'before' as phase, * from (""" + STORAGE_STATS_SQL + """) b
 union all select 'after', * from (""" + STORAGE_STATS_SQL.replace("fx_broker_meta", "fx_meta_after") + """) a),
d as (select 'before' as phase, * from fx_degree union all select 'after', * from fx_degree_after),
u as (select 'before' as phase, cluster_id, broker_id, idx from fx_replicas union all select 'after', cluster_id, broker_id, idx from fx_replicas_after),
x as (
 select cluster_id, phase, 'min_degree' as metric, null::bigint as broker_id, min(degree)::double as value from d group by all
 union all select cluster_id, phase, 'max_degree', null, max(degree) from d group by all
 union all select cluster_id, phase, 'avg_degree', null, avg(degree) from d group by all
 union all select cluster_id, phase, 'leader', broker_id, count(case when idx = 0 then 1 end) from u group by all
 union all select cluster_id, phase, 'follower', broker_id, count(case when idx > 0 then 1 end) from u group by all
 union all select cluster_id, phase, 'min_free', null, min_free from st
 union all select cluster_id, phase, 'max_free', null, max_free from st
 union all select cluster_id, phase, 'storage_range', null, storage_range from st
 union all select cluster_id, phase, 'range_spread', null, range_spread from st
 union all select cluster_id, phase, 'storage_stddev', null, storage_stddev from st
 union all select b.cluster_id, 'diff', 'diff', b.broker_id, a.storage_free - b.storage_free from fx_broker_meta b join fx_meta_after a using (cluster_id, broker_id)
 union all select b.cluster_id, 'diff', 'diff_pct', b.broker_id, (a.storage_free - b.storage_free) / nullif(b.storage_free, 0)::double * 100 from fx_broker_meta b join fx_meta_after a using (cluster_id, broker_id)
 union all select b.cluster_id, 'warning', 'range_increased', null, case when a.storage_range > b.storage_range then 1 else 0 end from st b join st a using (cluster_id) where b.phase = 'before' and a.phase = 'after')
select cluster_id, phase, metric, broker_id, round(value, 3) as value from x""")
def _(t):
    r = A.assignment_report(t.partition_map, t.partition_map_after, t.broker_meta, meta_after(t), t.replicas, t.replicas_after)
    return r.withColumn("value", F.round("value", 3))


@query("agg12_names", """
select distinct 'topic' as kind, cluster_id, topic as name from fx_replicas
union all select distinct 'broker', cluster_id, cast(broker_id as varchar) from fx_replicas""")
def _(t):
    topics = A.names(t.replicas, "topic").select(F.lit("topic").alias("kind"), "cluster_id", F.col("topic").alias("name"))
    return topics.unionByName(A.names(t.replicas, "broker_id").select(
        F.lit("broker").alias("kind"), "cluster_id", F.col("broker_id").cast("string").alias("name")))


@query("agg13_partition_sizes", """
select metric, cast(date_trunc('day', ts) as timestamp) as window_start, round(avg(value), 6) as size
from (select metric, date_trunc('hour', ts) as ts, max(value) as value from fx_metric_points group by all) x group by all""")
def _(t):
    p = t.metric_points.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return A.partition_sizes_from_points(p, ["metric"], "1 day").select(
        "metric", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.round("size", 6).alias("size"))


@query("agg14_topic_records", """
with r as (select cluster_id, topic, count(*) as partitions, cast(max(len(replicas)) as int) as replication from fx_map group by cluster_id, topic)
select cluster_id, topic, partitions, replication, partition_id // 1000 as range_id,
  string_agg(concat(partition_id, '=', array_to_string(replicas, ',')), ';' order by partition_id) as replica_map,
  case when topic = 't1' then 'retention.ms' else '' end as config_keys
from fx_map join r using (cluster_id, topic) group by cluster_id, topic, partitions, replication, partition_id // 1000""")
def _(t):
    topics = t.replicas.select("topic").distinct()
    cfg = topics.filter("topic = 't1'").withColumn("configs", F.create_map(F.lit("retention.ms"), F.lit("172800000")))
    tags = topics.withColumn("tags", F.create_map(F.lit("name"), F.col("topic")))
    rec = A.topic_records(t.partition_map, cfg, tags)
    return rec.select(
        "cluster_id", "topic", "partitions", "replication", "range_id",
        F.array_join(F.transform(F.map_entries("replicas"), lambda e: F.concat_ws("=", e["key"].cast("string"), render(e["value"]))), ";").alias("replica_map"),
        F.array_join(F.map_keys("configs"), ",").alias("config_keys"))


@query("agg14_broker_records", """
with g as (select cast(object_id as bigint) as broker_id, string_agg(concat(k, ':', v), ',' order by concat(k, ':', v)) as tags from fx_tags group by object_id)
select cluster_id, broker_id, host, port, rack, coalesce(tags, '') as tags from fx_broker_meta left join g using (broker_id)""")
def _(t):
    from replicalens.functions.text import format_tags

    tags = t.tags.select(F.col("object_id").cast("bigint").alias("broker_id"), "tags")
    return A.broker_records(t.broker_meta, tags).select(
        "cluster_id", "broker_id", "host", "port", "rack", F.array_join(format_tags(F.col("tags")), ",").alias("tags"))


@query("win01_largest_partitions", """
select * from (select r.cluster_id, r.broker_id, r.topic, r.partition_id, s.size_bytes,
  cast(row_number() over (partition by r.cluster_id, r.broker_id order by s.size_bytes desc, r.partition_id, r.topic) as int) as rank
  from fx_replicas r join fx_partition_size s using (cluster_id, topic, partition_id)) x where rank <= 30""")
def _(t):
    return W.largest_partitions(t.replicas, t.partition_size, 30)


@query("win02_large_enough", """
select * from (select r.cluster_id, r.broker_id, r.topic, r.partition_id, s.size_bytes,
  cast(row_number() over (partition by r.cluster_id, r.broker_id order by s.size_bytes desc, r.partition_id, r.topic) as int) as rank
  from fx_replicas r join fx_partition_size s using (cluster_id, topic, partition_id)) x where rank <= 30 and size_bytes >= 9 * 1048576""")
def _(t):
    return W.largest_partitions(t.replicas, t.partition_size, 30, min_bytes=9 << 20)


@query("win03_latest_values", """
select metric, scope, max(ts) as ts, arg_max(value, {'t': ts, 'v': value}) as value from fx_metric_points where value is not null group by metric, scope""")
def _(t):
    return W.latest_values(t.metric_points, ["metric", "scope"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("win04_broker_orders", """
select cluster_id, broker_id, row_number() over (partition by cluster_id order by used, broker_id) as by_used,
  row_number() over (partition by cluster_id order by storage_free desc, broker_id) as by_storage,
  row_number() over (partition by cluster_id order by broker_id) as by_id,
  row_number() over (partition by cluster_id order by broker_id desc) as by_id_desc
from fx_mapped""")
def _(t):
    s = J.broker_map(t.replicas, live_meta(t))
    out = W.brokers_by_used(s).select("cluster_id", "broker_id", F.col("rank").alias("by_used"))
    for name, df in (("by_storage", W.brokers_by_storage(s)), ("by_id", W.brokers_by_id(s)), ("by_id_desc", W.brokers_by_id(s, True))):
        out = out.join(df.select("cluster_id", "broker_id", F.col("rank").alias(name)), ["cluster_id", "broker_id"])
    return out


@query("win05_seeded_shuffle", """
select cluster_id, broker_id, row_number() over (partition by cluster_id order by used, md5(concat('7:', broker_id)), broker_id) as rank
from (select cluster_id, broker_id, used // 10 as used from fx_mapped) x""")
def _(t):
    s = J.broker_map(t.replicas, live_meta(t)).withColumn("used", F.expr("used div 10"))
    return W.brokers_shuffled(s, 7).select("cluster_id", "broker_id", "rank")


@query("win06_offload_order", """
with m as (select cluster_id, count(*) / sum(1 / storage_free::double) as h from fx_broker_meta where storage_free > 0 group by cluster_id)
select b.cluster_id, broker_id, row_number() over (partition by b.cluster_id order by storage_free, broker_id) as rank
from fx_broker_meta b join m using (cluster_id) where (h - storage_free) / h > 0.05""")
def _(t):
    from replicalens.operators.filters import around_mean

    return W.offload_order(around_mean(t.broker_meta, 0.05, above=False)).select("cluster_id", "broker_id", "rank")


@query("win07_map_order", """
select cluster_id, topic, partition_id, row_number() over (partition by cluster_id order by topic, partition_id) as position from fx_map""")
def _(t):
    return W.ranked(t.partition_map, ["cluster_id"], [F.col("topic"), F.col("partition_id")], "position").drop("replicas")


@query("win08_rank_plans", """
with s as (select cluster_id, storage_free % 97 / 100.0::double as tolerance, storage_free as f from fx_broker_meta),
g as (select cluster_id, tolerance, max(f) - min(f) as storage_range, stddev_pop(f) as storage_stddev from s group by all)
select cluster_id, tolerance, cast(row_number() over (partition by cluster_id order by storage_range, storage_stddev, tolerance) as int) as rank from g""")
def _(t):
    s = t.broker_meta.withColumn("tolerance", F.col("storage_free") % 97 / 100)
    return W.rank_plans(A.storage_stats(s, ["cluster_id", "tolerance"])).select("cluster_id", "tolerance", "rank")


@query("set01_set_operations", """
with a as (select distinct cluster_id, broker_id from fx_mapped), b as (select cluster_id, broker_id from fx_provided_brokers),
u as (select cluster_id, broker_id, a.broker_id is not null as ia, b.broker_id is not null as ib from a full outer join b using (cluster_id, broker_id))
select u.cluster_id, count(*) as in_union, count(case when not ib then 1 end) as only_a, count(case when not ia then 1 end) as only_b,
  count(case when not ib then 1 end) = 0 as a_subset_of_b, count(case when ia <> ib then 1 end) = 0 as equal
from (select cluster_id, x.broker_id, (cluster_id, broker_id) in (select cluster_id, broker_id from a) as ia, (cluster_id, broker_id) in (select cluster_id, broker_id from b) as ib
  from (select * from a union select * from b) x) u group by u.cluster_id""")
def _(t):
    mapped = t.replicas.select("cluster_id", "broker_id").distinct()
    return S.compare_sets(mapped, t.provided_brokers, ["cluster_id"], ["broker_id"])


@query("set01_difference_union", """
select 'difference' as op, cluster_id, broker_id from (select cluster_id, broker_id from fx_mapped except select cluster_id, broker_id from fx_provided_brokers)
union all
select 'union', cluster_id, broker_id from (select cluster_id, broker_id from fx_mapped union select cluster_id, broker_id from fx_provided_brokers)""")
def _(t):
    a, b = t.replicas.select("cluster_id", "broker_id").distinct(), t.provided_brokers
    return S.difference(a, b).select(F.lit("difference").alias("op"), "*").unionByName(
        S.union_of(a, b).select(F.lit("union").alias("op"), "*"))


@query("set02_merge_maps", "select cluster_id, topic, partition_id, broker_id, idx from fx_replicas")
def _(t):
    # The map is built once, not once per topic.
    whole = materialize(t.partition_map, "map-by-topic")
    one = lambda n: whole.filter(F.col("topic") == n)
    return to_replicas(S.merge_maps(*[one(f"t{i}") for i in range(1, 6)]))


@query("set03_all_tags", """
select object_type, object_id, k, v from fx_tags
union all select distinct 'topic', topic, 'name', topic from fx_replicas""")
def _(t):
    topics = t.replicas.select("topic").distinct().select(
        F.lit("topic").alias("object_type"), F.col("topic").alias("object_id"),
        F.create_map(F.lit("name"), F.col("topic")).alias("tags"))
    return S.merge_maps(t.tags, topics).select("object_type", "object_id", F.explode("tags").alias("k", "v"))
