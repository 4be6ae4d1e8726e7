"""Registered queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicalens.catalog.base import query
from replicalens.catalog.filters import live_meta, merged, state
from replicalens.functions.arrays import render, to_partition_map
from replicalens.operators import filters as O
from replicalens.operators import joins as J
from replicalens.schemas import PARTITION_KEY


def targets(t):
    return to_partition_map(t.reassignment, broker="target_broker")


def throttled(t):
    from replicalens.functions.text import throttled_entry

    r = J.reassigning_replicas(t.dealt(t.topic_state), t.dealt(targets(t)))
    return r.withColumn("entry", throttled_entry(F.col("partition_id"), F.col("broker_id")))


@query("jn01_sizes", """
select cluster_id, topic, partition_id, case when partition_id % 40 = 7 then null else size_bytes end as size_bytes
from (select distinct cluster_id, topic, partition_id from fx_replicas) r left join fx_partition_size using (cluster_id, topic, partition_id)""")
def _(t):
    parts = t.replicas.filter("idx = 0").select(*PARTITION_KEY)
    ok, unknown = J.with_sizes(parts, t.partition_size.filter("partition_id % 40 <> 7"))
    return ok.unionByName(unknown.withColumn("size_bytes", F.lit(None).cast("bigint")))


@query("jn02_broker_map", """
select 'kept' as mode, cluster_id, broker_id, rack, used, storage_free from fx_mapped
union all select 'forced', cluster_id, broker_id, rack, 0, storage_free from fx_mapped""")
def _(t):
    kept = J.broker_map(t.replicas, live_meta(t)).withColumn("mode", F.lit("kept"))
    return kept.unionByName(J.broker_map(t.replicas, live_meta(t), force=True).withColumn("mode", F.lit("forced")))


@query("jn03_merge_brokers", "select * from fx_state")
def _(t):
    return state(t)


@query("jn03_broker_status", "select * from fx_status")
def _(t):
    from replicalens.operators.aggregates import broker_status

    return broker_status(merged(t))


@query("jn04_add_back_storage", """
with h as (select cluster_id, broker_id, sum(size_bytes) as held from fx_replicas join fx_partition_size using (cluster_id, topic, partition_id) group by cluster_id, broker_id)
select 'all' as mode, cluster_id, broker_id, cast(storage_free + coalesce(held, 0) as bigint) as storage_free from fx_state left join h using (cluster_id, broker_id)
union all
select 'replaced', cluster_id, broker_id, cast(storage_free + case when is_replace then coalesce(held, 0) else 0 end as bigint) from fx_state left join h using (cluster_id, broker_id)""")
def _(t):
    s = state(t)
    every, _u = J.add_back_storage(s, t.replicas, t.partition_size, O.all_brokers)
    some, _u = J.add_back_storage(s, t.replicas, t.partition_size, O.replaced)
    cols = ["mode", "cluster_id", "broker_id", "storage_free"]
    return every.withColumn("mode", F.lit("all")).select(*cols).unionByName(
        some.withColumn("mode", F.lit("replaced")).select(*cols))


@query("jn05_storage_diff", """
select cluster_id, broker_id, a.storage_free - b.storage_free as diff,
       round((a.storage_free - b.storage_free) / nullif(b.storage_free, 0)::double * 100, 6) as diff_pct
from fx_broker_meta b join fx_meta_after a using (cluster_id, broker_id)""")
def _(t):
    from replicalens.catalog.aggregates import meta_after

    return J.storage_diff(t.broker_meta, meta_after(t)).withColumn("diff_pct", F.round("diff_pct", 6))


@query("jn06_topic_brokers", """
select distinct 'found' as kind, cluster_id, topic, broker_id from fx_replicas
union all select 'unknown', cluster_id, topic, null from (select cluster_id, unnest(['t1', 'nope']) as topic from fx_clusters)
  where topic not in (select topic from fx_replicas)""")
def _(t):
    found = J.topic_brokers(t.replicas).withColumn("kind", F.lit("found"))
    asked = t.replicas.select("cluster_id").distinct().select("cluster_id", F.explode(F.array(F.lit("t1"), F.lit("nope"))).alias("topic"))
    bad = J.unknown_keys(asked, t.replicas, ["cluster_id", "topic"]).select(
        F.lit("unknown").alias("kind"), "*", F.lit(None).cast("bigint").alias("broker_id"))
    return found.unionByName(bad)


@query("jn06_broker_partitions", "select distinct cluster_id, broker_id, topic, partition_id from fx_replicas")
def _(t):
    return J.broker_partitions(t.replicas)


@query("jn07_unmapped_brokers", """
select cluster_id, broker_id from fx_discovered_brokers
where (cluster_id, broker_id) not in (select cluster_id, broker_id from fx_replicas where topic not in ('t1', 't2', 't3', 't4'))""")
def _(t):
    excluded = t.replicas.select("topic").distinct().filter("topic in ('t1', 't2', 't3', 't4')")
    return J.unmapped_brokers(t.discovered_brokers, t.replicas, excluded)


@query("jn08_overlay_reassignments", """
with x as (select cluster_id, topic, partition_id, list(target_broker order by idx) as g from fx_reassignment group by cluster_id, topic, partition_id)
select cluster_id, topic, partition_id, array_to_string(coalesce(g, replicas), ',') as replicas from fx_map left join x using (cluster_id, topic, partition_id)""")
def _(t):
    return J.overlay_reassignments(t.dealt(t.partition_map), t.dealt(targets(t))).withColumn("replicas", render(F.col("replicas")))


REASSIGNING_SQL = """
with i as (select * from fx_replicas where in_isr = 1),
e as (
 select r.cluster_id, r.topic, r.partition_id, 'leaders' as role, r.broker_id
 from fx_replicas r where r.idx = 0 and (r.cluster_id, r.topic, r.partition_id) in (select cluster_id, topic, partition_id from fx_reassignment)
 union all
 select x.cluster_id, x.topic, x.partition_id, 'followers', x.target_broker
 from fx_reassignment x left join i on i.cluster_id = x.cluster_id and i.topic = x.topic and i.partition_id = x.partition_id and i.broker_id = x.target_broker
 where i.broker_id is null)"""


@query("jn09_reassigning_replicas", REASSIGNING_SQL + "select cluster_id, topic, partition_id, role, broker_id from e")
def _(t):
    return J.reassigning_replicas(t.dealt(t.topic_state), t.dealt(targets(t)))


@query("jn09_reassigning_brokers", REASSIGNING_SQL + """
select cluster_id, broker_id, bool_or(role = 'leaders') as is_src, bool_or(role = 'followers') as is_dst from e group by cluster_id, broker_id""")
def _(t):
    return J.reassigning_brokers(J.reassigning_replicas(t.dealt(t.topic_state), t.dealt(targets(t))))


@query("jn10_overridden_topics", """
select cluster_id, topic, 'followers' as role, partition_id, concat(partition_id, ':', broker_id) as entry from fx_replicas
where topic <> '__consumer_offsets' and (cluster_id, broker_id) in (select cluster_id, broker_id from fx_override where rate <> 0 and broker_id % 7 <> 0)""")
def _(t):
    part = t.broker_meta.filter("broker_id % 7 = 0")
    return J.topics_with_overridden_brokers(t.replicas, t.override, part)


@query("jn11_merge_network_metrics", """
with s as (select event_type, concat('h', user_id % 20) as host,
   cast(sum(case when event_id % 2 = 0 then cents end) as bigint)::double / count(case when event_id % 2 = 0 then 1 end) as tx,
   cast(sum(case when event_id % 2 = 1 then cents end) as bigint)::double / count(case when event_id % 2 = 1 then 1 end) as rx
   from (select *, cast(round(value * 100) as bigint) as cents from events where event_type <> 'error' or event_id % 2 = 0 or user_id % 20 <> 7) e group by all),
ok as (select event_type from s group by event_type having count(tx) = count(rx))
select event_type, host, coalesce(tx, 0.0::double) as net_tx, coalesce(rx, 0.0::double) as net_rx from s where event_type in (select event_type from ok)""")
def _(t):
    # The receive side of one group lacks a host, so that group has no result.
    e = t.table("events").filter("event_type <> 'error' or event_id % 2 = 0 or user_id % 20 <> 7").withColumn(
        "host", F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")))
    mean = F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / F.count(F.lit(1))
    tx = e.filter("event_id % 2 = 0").groupBy("event_type", "host").agg(mean.alias("net_tx")).withColumn("net_rx", F.lit(0.0))
    rx = e.filter("event_id % 2 = 1").groupBy("event_type", "host").agg(mean.alias("net_rx")).withColumn("net_tx", F.lit(0.0))
    return J.merge_network_metrics(tx, rx, ["event_type"])


@query("jn12_host_tags", """
with h as (select distinct user_id % 40 as u from events)
select concat('h', u) as host, case when u < 20 and u % 6 <> 5 then u end as broker_id,
       case when u < 20 and u % 6 <> 5 then concat('it', u % 3) end as instance_type from h""")
def _(t):
    u = F.col("u")
    base = t.table("events").select((F.col("user_id") % 40).alias("u")).distinct()
    host = F.concat(F.lit("h"), u.cast("string")).alias("host")
    tags = base.filter("u < 20").select(host, F.concat(
        F.lit("broker_id:"), u.cast("string"),
        F.when(u % 6 == 5, ",zone:z").otherwise(F.concat(F.lit(",instance-type:it"), (u % 3).cast("string")))).alias("scope"))
    ok, bad = J.with_host_tags(base.select(host), tags)
    return ok.unionByName(bad, allowMissingColumns=True)


@query("jn13_default_tags", """
with s as (select object_id, max(case when k = 'zone' then v end) as zone, max(case when k = 'pool' then v end) as pool from fx_tags group by object_id)
select cluster_id, broker_id, host, rack, coalesce(zone, 'none') as zone, pool
from fx_broker_meta left join s on object_id = cast(broker_id as varchar)""")
def _(t):
    stored = t.tags.select(F.col("object_id").cast("bigint").alias("broker_id"), "tags")
    out = J.with_default_tags(t.broker_meta, {"host": F.col("host"), "rack": F.col("rack"), "zone": F.lit("none")}, stored, ["broker_id"])
    g = F.col("tags")
    return out.select("cluster_id", "broker_id", g["host"].alias("host"), g["rack"].alias("rack"), g["zone"].alias("zone"), g["pool"].alias("pool"))


def capacity(t):
    """Capacity of the instance types seen, one type left unknown."""
    return t.broker_meta.select("instance_type").distinct().filter("instance_type <> 'it2'").withColumn(
        "capacity_mb", 100.0 + 50 * F.substring("instance_type", 3, 1).cast("double"))


@query("jn14_capacity", """
select cluster_id, broker_id, case instance_type when 'it0' then 100.0::double when 'it1' then 150.0::double end as capacity_mb from fx_broker_meta""")
def _(t):
    ok, bad = J.with_capacity(t.broker_meta.select("cluster_id", "broker_id", "instance_type"), capacity(t))
    return ok.unionByName(bad, allowMissingColumns=True).drop("instance_type")


@query("jn15_override_precedence", """
select m.cluster_id, m.broker_id, cast(coalesce(nullif(o.rate, 0), case when m.cluster_id = 'f' then 75 end, storage_free / 10000.0) as double) as rate
from fx_broker_meta m left join fx_override o using (cluster_id, broker_id)""")
def _(t):
    rates = t.broker_meta.select("cluster_id", "broker_id", (F.col("storage_free") / 10000.0).alias("rate"))
    glob = t.broker_meta.select("cluster_id").distinct().withColumn("rate", F.when(F.col("cluster_id") == "f", 75).otherwise(0))
    return J.apply_overrides(rates, t.override, glob)


@query("jn16_racks_available", """
with x as (select concat(cluster_id, '-', partition_id // 40) as cluster_id, topic, partition_id, broker_id from fx_replicas),
b as (select distinct x.cluster_id, x.broker_id, case when m.is_live = 1 then m.rack else '' end as rack, m.is_live = 0 as is_missing
  from x join (select distinct broker_id, rack, is_live from fx_broker_meta) m using (broker_id)),
miss as (select cluster_id, broker_id from b where is_missing),
r as (select x.cluster_id, x.topic, x.partition_id, x.broker_id, b.rack from x join b using (cluster_id, broker_id)),
shared as (select distinct a.cluster_id, a.broker_id, o.rack from x a join miss using (cluster_id, broker_id)
  join r o on o.cluster_id = a.cluster_id and o.topic = a.topic and o.partition_id = a.partition_id and o.broker_id <> a.broker_id)
select m.cluster_id, m.broker_id, s.rack from miss m join (select distinct cluster_id, rack from r where rack <> '') s using (cluster_id)
where (m.cluster_id, m.broker_id, s.rack) not in (select cluster_id, broker_id, rack from shared)""")
def _(t):
    # A fleet of many small clusters: each holds forty neighbouring partition ids.
    fleet = t.replicas.withColumn("cluster_id", F.concat_ws("-", "cluster_id", F.expr("partition_id div 40").cast("string")))
    meta = t.broker_meta.select("broker_id", "rack", "is_live").distinct()
    s = fleet.select("cluster_id", "broker_id").distinct().join(meta, "broker_id").select(
        "cluster_id", "broker_id", F.when(F.col("is_live") == 1, F.col("rack")).otherwise("").alias("rack"),
        (F.col("is_live") == 0).alias("is_missing"))
    return J.racks_available(fleet, s, s.filter("is_missing"))


@query("jn17_latest_checkpoints", """
select group_id, topic, partition_id, arg_max(upstream_offset, log_offset) as upstream_offset, arg_max(local_offset, log_offset) as local_offset
from fx_checkpoints group by group_id, topic, partition_id""")
def _(t):
    return J.latest_checkpoints(t.checkpoints)
