"""Registered queries of the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicalens.catalog.base import query
from replicalens.catalog.adapter_sql import add_adapters
from replicalens.operators import filters as O
from replicalens.operators import joins as J
from replicalens.schemas import RESERVED_BROKER_KEYS

# Planning state of the provided and discovered broker lists, shared by several oracles.
add_adapters({
    "fx_mapped": """
select r.cluster_id, r.broker_id, coalesce(m.rack, '') as rack, r.used, coalesce(m.storage_free, 0) as storage_free
from (select cluster_id, broker_id, count(*) as used from fx_replicas group by cluster_id, broker_id) r
left join (select * from fx_broker_meta where is_live = 1) m using (cluster_id, broker_id)""",
    "fx_merged": """
with m as (select cluster_id, broker_id, rack as m_rack, used, storage_free as m_free from fx_mapped),
p as (select cluster_id, broker_id, 1 as prov from fx_provided_brokers),
d as (select cluster_id, broker_id, rack as d_rack, storage_free as d_free from fx_discovered_brokers)
select cluster_id, broker_id,
  coalesce(case when m_rack is not null then m_rack else d_rack end, '') as rack, coalesce(used, 0) as used,
  coalesce(case when m_rack is not null then m_free else d_free end, 0) as storage_free,
  m_rack is not null and (d_rack is null or prov is null) as is_replace,
  m_rack is not null and d_rack is null as is_missing,
  m_rack is null and prov is not null and d_rack is not null as is_new,
  prov is not null as is_provided, m_rack is not null or d_rack is not null as in_state
from m full outer join p using (cluster_id, broker_id) full outer join d using (cluster_id, broker_id)
where m_rack is not null or prov is not null""",
    "fx_state": """
select cluster_id, broker_id, rack, used, storage_free, is_replace, is_missing, is_new from fx_merged where in_state""",
})


def live_meta(t):
    return t.broker_meta.filter("is_live = 1")


def merged(t):
    return J.merge_brokers(J.broker_map(t.replicas, live_meta(t)), t.provided_brokers, t.discovered_brokers)


def state(t):
    return J.broker_state(merged(t))


def count_by_topic(df):
    return df.groupBy("cluster_id", "topic").agg(F.count(F.lit(1)).alias("replicas"))


@query("flt01_include_topics", """
select cluster_id, topic, count(*) as replicas from fx_replicas
where topic = 't1' or regexp_matches(topic, '[34]$') group by cluster_id, topic""")
def _(t):
    return count_by_topic(O.include_topics(t.replicas, ["t1", "[34]$"]))


@query("flt02_exclude_topics", """
select cluster_id, topic, count(*) as replicas, false as removed from fx_replicas
where not (topic = 't2' or regexp_matches(topic, '^t.*5')) group by cluster_id, topic
union all
select distinct cluster_id, topic, null, true from fx_replicas where topic = 't2' or regexp_matches(topic, '^t.*5')""")
def _(t):
    kept, removed = O.exclude_topics(t.replicas, ["t2", "^t.*5"])
    return count_by_topic(kept).withColumn("removed", F.lit(False)).unionByName(
        removed.select("*", F.lit(None).cast("bigint").alias("replicas"), F.lit(True).alias("removed")))


@query("flt03_topic_named", """
select 'one' as asked, cluster_id, topic, count(*) as replicas from fx_replicas where topic = 't3' group by cluster_id, topic
union all
select 'all', cluster_id, topic, count(*) from fx_replicas group by cluster_id, topic""")
def _(t):
    one = count_by_topic(O.topic_named(t.replicas, "t3")).withColumn("asked", F.lit("one"))
    return one.unionByName(count_by_topic(O.topic_named(t.replicas, "")).withColumn("asked", F.lit("all")))


@query("flt04_broker_predicates", """
select cluster_id, broker_id, true as is_any, not is_replace as kept, is_replace as replaced, is_new as added from fx_state""")
def _(t):
    s = state(t)
    s = O.filter_brokers(s, O.all_brokers)
    return s.select("cluster_id", "broker_id", O.all_brokers(s).alias("is_any"), O.not_replaced(s).alias("kept"),
                    O.replaced(s).alias("replaced"), O.new_brokers(s).alias("added"))


@query("flt05_brokers_in_map", """
select cluster_id, broker_id from fx_state where (cluster_id, broker_id) in (select cluster_id, broker_id from fx_replicas)""")
def _(t):
    return O.brokers_in(state(t), t.replicas).select("cluster_id", "broker_id")


@query("flt06_around_mean", """
with m as (select cluster_id, count(case when storage_free > 0 then 1 end) / sum(case when storage_free > 0 then 1 / storage_free::double end) as h,
                  avg(case when storage_free > 0 then storage_free end) as a from fx_broker_meta group by cluster_id)
select 'above_hmean' as side, b.cluster_id, broker_id from fx_broker_meta b join m using (cluster_id) where (storage_free - h) / h > 0.2
union all select 'below_hmean', b.cluster_id, broker_id from fx_broker_meta b join m using (cluster_id) where (h - storage_free) / h > 0.1
union all select 'above_mean', b.cluster_id, broker_id from fx_broker_meta b join m using (cluster_id) where (storage_free - a) / a > 0.2
union all select 'below_mean', b.cluster_id, broker_id from fx_broker_meta b join m using (cluster_id) where (a - storage_free) / a > 0.6""")
def _(t):
    m = t.broker_meta
    parts = [("above_hmean", 0.2, True, "hmean"), ("below_hmean", 0.1, False, "hmean"),
             ("above_mean", 0.2, True, "mean"), ("below_mean", 0.6, False, "mean")]
    out = None
    for side, d, above, mean in parts:
        one = O.around_mean(m, d, above, mean).select(F.lit(side).alias("side"), "cluster_id", "broker_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("flt07_skip_offline", """
select cluster_id, topic, count(case when in_isr = 1 then 1 end) as online from fx_replicas group by cluster_id, topic
having count(case when in_isr = 1 then 1 end) > 0""")
def _(t):
    marked = t.replicas.withColumn("broker_id", F.when(F.col("in_isr") == 1, F.col("broker_id")).otherwise(-1))
    return O.not_offline(marked).groupBy("cluster_id", "topic").agg(F.count(F.lit(1)).alias("online"))


@query("flt08_changed_partitions", """
select a.cluster_id, a.topic, a.partition_id, array_to_string(a.replicas, ',') as replicas
from fx_map_after a join fx_map b using (cluster_id, topic, partition_id) where a.replicas <> b.replicas""")
def _(t):
    from replicalens.functions.arrays import render

    return O.changed_partitions(t.partition_map, t.partition_map_after).select(
        "cluster_id", "topic", "partition_id", render(F.col("replicas")).alias("replicas"))


@query("flt09_active_overrides", """
select 'active' as kind, cluster_id, broker_id, rate from fx_override where rate <> 0
union all
select 'outside', cluster_id, broker_id, rate from fx_override o where rate <> 0
  and not exists (select 1 from fx_reassignment r where r.cluster_id = o.cluster_id and r.target_broker = o.broker_id)""")
def _(t):
    part = t.reassignment.select("cluster_id", F.col("target_broker").alias("broker_id"))
    active = O.active_overrides(t.override).withColumn("kind", F.lit("active"))
    outside = O.active_overrides(t.override, part).withColumn("kind", F.lit("outside"))
    return active.unionByName(outside).select("kind", "cluster_id", "broker_id", "rate")


@query("flt10_dynamic_configs", "select resource_name, k, v from fx_resource_config where source = 'dynamic'")
def _(t):
    return O.dynamic_configs(t.resource_config).select("resource_name", "k", "v")


@query("flt11_spanning_topics", """
with live as (select cluster_id, count(*) as live_brokers from fx_broker_meta where is_live = 1 group by cluster_id)
select cluster_id, topic, count(distinct broker_id) as brokers, live_brokers
from fx_replicas join live using (cluster_id) group by cluster_id, topic, live_brokers
having count(distinct broker_id) >= live_brokers""")
def _(t):
    return O.spanning_topics(t.replicas, live_meta(t))


@query("flt12_under_replicated", """
select distinct cluster_id, topic from fx_replicas where in_isr = 0""")
def _(t):
    return O.under_replicated_topics(t.topic_state)


@query("flt13_isr_mismatch", """
with s as (select cluster_id, topic, partition_id, count(*) as n, sum(in_isr) as isr from fx_replicas group by cluster_id, topic, partition_id)
select 'differs' as kind, cluster_id, topic, null as partition_id from s where partition_id % 50 <> 0 and isr <> n group by cluster_id, topic
union all
select 'no_state', cluster_id, topic, partition_id from s where partition_id % 50 = 0""")
def _(t):
    s = t.topic_state
    differs, absent = O.isr_mismatch(s.drop("isr"), s.filter("partition_id % 50 <> 0"))
    return differs.select(F.lit("differs").alias("kind"), "cluster_id", "topic",
                          F.lit(None).cast("bigint").alias("partition_id")).unionByName(
        absent.select(F.lit("no_state").alias("kind"), "cluster_id", "topic", "partition_id"))


@query("flt14_filter_by_tags", """
select object_id from fx_tags group by object_id
having max(case when k = 'pool' then v end) = 'building' and coalesce(max(case when k = 'absent' then v end), '') = ''
   and max(case when k = 'zone' then v end) = 'z2'""")
def _(t):
    return O.filter_by_tags(t.tags, {"pool": "building", "zone": "z2", "absent": ""}).select("object_id")


@query("flt15_reserved_keys", """
with all_tags as (select object_id, k, v from fx_tags
  union all select cast(c_custkey as varchar), 'rack', 'r1' from customer where c_custkey % 2 = 0)
select object_id, string_agg(case when k <> 'rack' then k end, ',' order by k) as custom,
       coalesce(string_agg(case when k = 'rack' then k end, ','), '') as reserved
from all_tags group by object_id""")
def _(t):
    from replicalens.functions.text import merge_tags, only_keys, without_keys

    rack = F.when(F.col("object_id").cast("bigint") % 2 == 0, F.create_map(F.lit("rack"), F.lit("r1"))).otherwise(
        F.create_map().cast("map<string,string>"))
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    tags = t.tags.withColumn("tags", merge_tags(F.col("tags"), rack))
    return tags.select("object_id", keys(without_keys(F.col("tags"), RESERVED_BROKER_KEYS)).alias("custom"),
                       keys(only_keys(F.col("tags"), RESERVED_BROKER_KEYS)).alias("reserved"))


@query("flt16_integer_series", """
select event_id, user_id % 20 as broker_id, value from events where event_id % 11 <> 0 and user_id % 9 <> 4""")
def _(t):
    # Points of every ninth user carry a broker tag that is no number.
    bad = t.table("events").select("event_id", (F.col("user_id") % 9 == 4).alias("bad"))
    pts = t.metric_points.join(bad, "event_id").withColumn(
        "scope", F.when(F.col("bad"), F.regexp_replace("scope", "broker_id:", "broker_id:x")).otherwise(F.col("scope")))
    return O.integer_broker_series(pts).select("event_id", "broker_id", "value")


@query("flt17_freshness", """
with ages as (select 'sizes' as dataset, max(o_orderdate) as modified_ts from orders
              union all select 'metrics', max(ts) from events)
select min(modified_ts) as oldest_ts, cast(date_diff('second', date_trunc('second', min(modified_ts)), timestamp '2024-02-01 00:00:00') as bigint) as age_seconds,
       date_diff('second', date_trunc('second', min(modified_ts)), timestamp '2024-02-01 00:00:00') > 3600 as is_stale
from ages""")
def _(t):
    ages = t.table("orders").agg(F.max("o_orderdate").alias("modified_ts")).select(
        F.lit("sizes").alias("dataset"), F.col("modified_ts").cast("timestamp_ntz").alias("modified_ts")).unionByName(
        t.table("events").agg(F.max("ts").alias("modified_ts")).select(
            F.lit("metrics").alias("dataset"), F.col("modified_ts").cast("timestamp_ntz").alias("modified_ts")))
    return O.stale_datasets(ages, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 3600)


@query("flt18_without_metrics", """
select cluster_id, broker_id from fx_state where not is_missing and broker_id not in (select user_id % 20 from events)""")
def _(t):
    m = O.integer_broker_series(t.metric_points).select("broker_id").distinct().select(
        F.explode(F.array(F.lit("f"), F.lit("o"), F.lit("p"))).alias("cluster_id"), "broker_id")
    return O.without_metrics(state(t), m).select("cluster_id", "broker_id")


@query("flt19_pending_deletion", """
select distinct cluster_id, topic from fx_replicas
where topic not in (select concat('t', 2 * cast(substr(topic, 2) as int)) from fx_topic_snapshots)""")
def _(t):
    pending = t.topic_snapshots.select(
        F.explode(F.array(F.lit("f"), F.lit("o"), F.lit("p"))).alias("cluster_id"),
        F.concat(F.lit("t"), (2 * F.substring("topic", 2, 9).cast("int")).cast("string")).alias("topic"))
    return O.not_pending_deletion(t.replicas.select("cluster_id", "topic").distinct(), pending)


@query("flt20_requested_brokers", """
with known as (select distinct p.cluster_id, p.broker_id, d.broker_id is not null as ok
  from fx_provided_brokers p left join fx_discovered_brokers d on d.cluster_id = p.cluster_id and d.broker_id = p.broker_id)
select cluster_id, broker_id, 'invalid broker id' as reason from known where not ok
union all
select cluster_id, null, 'too few brokers' from known group by cluster_id having count(case when ok then 1 end) < 60""")
def _(t):
    return O.check_requested_brokers(t.provided_brokers, t.discovered_brokers, 60)
