"""Registered queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicalens.catalog.base import query
from replicalens.functions import arrays as A
from replicalens.functions import text as X
from replicalens.operators.sets import maps_differ
from replicalens.schemas import PARTITION_KEY


@query("scl01_tag_value", """
select event_id, split_part(split_part(scope, ',', 1), ':', 2) as host,
       split_part(split_part(scope, ',', 3), ':', 2) as instance_type, '' as absent
from fx_metric_points""")
def _(t):
    s = F.col("scope")
    return t.metric_points.select("event_id", X.tag_value(s, "host").alias("host"),
                                  X.tag_value(s, "instance-type").alias("instance_type"),
                                  X.tag_value(s, "zone").alias("absent"))


@query("scl02_parse_tags", """
select c_custkey, lower(c_mktsegment) as pool, case when c_custkey % 7 = 0 then 'late' else 'z1' end as zone, false as rejected
from customer where c_custkey % 11 <> 0
union all
select c_custkey, null, null, true from customer where c_custkey % 11 = 0""")
def _(t):
    zone = F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("zone:z1"), F.lit("zone:late"))).otherwise(
        F.array(F.lit("zone:z1")))
    entries = F.concat(F.array(F.concat(F.lit("pool:"), F.lower("c_mktsegment"))), zone,
                       F.when(F.col("c_custkey") % 11 == 0, F.array(F.lit("a:b:c")))
                       .otherwise(F.array().cast("array<string>")))
    m = t.table("customer").select("c_custkey", X.parse_tags(entries).alias("m"))
    return m.select("c_custkey", F.col("m")["pool"].alias("pool"), F.col("m")["zone"].alias("zone"),
                    F.col("m").isNull().alias("rejected"))


@query("scl03_format_tags", """
select object_id, string_agg(concat(k, ':', v), ',' order by concat(k, ':', v)) as tag_list, string_agg(k, ',' order by k) as tag_keys,
       max(case when k = 'tagMarkedForDeletionTime' then 1 else 0 end) = 0 as unmarked
from fx_tags group by object_id""")
def _(t):
    tags = F.col("tags")
    return t.tags.select(
        "object_id", F.array_join(X.format_tags(tags), ",").alias("tag_list"),
        F.array_join(F.array_sort(F.map_keys(tags)), ",").alias("tag_keys"),
        X.tags_equal(tags, X.without_keys(tags, ["tagMarkedForDeletionTime"])).alias("unmarked"))


@query("scl04_throttled_entry", """
select cluster_id, topic, partition_id, broker_id, concat(partition_id, ':', broker_id) as entry from fx_replicas""")
def _(t):
    return t.replicas.select(*PARTITION_KEY, "broker_id",
                             X.throttled_entry(F.col("partition_id"), F.col("broker_id")).alias("entry"))


@query("scl05_offsets_topic", """
select event_id, case when event_type = 'view' then '__consumer_offsets' else event_type end as topic from events""")
def _(t):
    raw = F.when(F.col("event_type") == "view", "_consumer_offsets").otherwise(F.col("event_type"))
    return t.table("events").select("event_id", X.offsets_topic(raw).alias("topic"))


@query("scl06_units", """
select cluster_id, broker_id, storage_free / 1048576.0::double as mib, storage_free / 1073741824.0::double as gib,
       broker_id * 1048576 as limit_bytes, cast(round(storage_free / 1000.0::double * 1000000) as bigint) as rate_bytes
from fx_broker_meta""")
def _(t):
    free = F.col("storage_free")
    return t.broker_meta.select("cluster_id", "broker_id", X.bytes_to_mib(free).alias("mib"),
                                X.bytes_to_gib(free).alias("gib"),
                                X.mib_to_bytes(F.col("broker_id")).alias("limit_bytes"),
                                X.mb_rate_to_bytes(free / 1000).alias("rate_bytes"))


@query("scl07_roles", """
select cluster_id, topic, partition_id, broker_id, idx = 0 as leads, case when idx = 0 then 'leader' else 'follower' end as role
from fx_replicas""")
def _(t):
    return t.replicas.select(*PARTITION_KEY, "broker_id", A.is_leader(F.col("idx")).alias("leads"),
                             A.role_of(F.col("idx")).alias("role"))


@query("scl08_set_replication", """
select cluster_id, topic, partition_id,
       array_to_string(list_transform(range(1, 4), lambda i: coalesce(cast(replicas[i] as varchar), '-')), ',') as rf3,
       array_to_string(replicas, ',') as rf0
from fx_map""")
def _(t):
    r = F.col("replicas")
    return t.partition_map.select(*PARTITION_KEY, A.render(A.set_replication(r, 3)).alias("rf3"),
                                  A.render(A.set_replication(r, 0)).alias("rf0"))


@query("scl09_strip", """
select cluster_id, topic, partition_id, array_to_string(list_transform(replicas, lambda x: '-'), ',') as slots from fx_map""")
def _(t):
    return t.partition_map.select(*PARTITION_KEY, A.render(A.strip(F.col("replicas"))).alias("slots"))


@query("scl10_populate", """
select p_partkey, concat('new-', p_partkey) as topic, cast(r.i as bigint) as partition_id, '-,-,-' as slots
from part, lateral (select unnest(range(0, p_size)) as i) r""")
def _(t):
    topics = t.table("part").select("p_partkey", F.concat(F.lit("new-"), F.col("p_partkey").cast("string")).alias("topic"), "p_size")
    return A.populate(topics, F.col("p_size"), F.lit(3)).select(
        "p_partkey", "topic", "partition_id", A.render(F.col("replicas")).alias("slots"))


@query("scl11_what_changed", """
select b.cluster_id, b.topic, b.partition_id,
  case when b.replicas = a.replicas then 'no-op' else
  array_to_string(list_filter([
    case when len(b.replicas) > len(a.replicas) then 'decreased replication'
         when len(b.replicas) < len(a.replicas) then 'increased replication' end,
    case when b.replicas[1:n] = a.replicas[1:n] then null
         when list_sort(b.replicas[1:n]) = list_sort(a.replicas[1:n]) then 'preferred leader'
         else 'replaced broker' end], lambda x: x is not null), ', ') end as change
from (select *, case when partition_id % 5 = 0 then replicas[1:1] when partition_id % 5 = 1 then list_reverse(replicas) else replicas end as r2
      from fx_map_after) a0
join (select * from fx_map) b using (cluster_id, topic, partition_id),
lateral (select a0.r2 as replicas, least(len(a0.r2), len(b.replicas)) as n) a""")
def _(t):
    r = F.col("replicas")
    after = t.partition_map_after.select(
        *PARTITION_KEY, F.when(F.col("partition_id") % 5 == 0, F.slice(r, 1, 1))
        .when(F.col("partition_id") % 5 == 1, F.reverse(r)).otherwise(r).alias("after"))
    return t.partition_map.join(after, PARTITION_KEY).select(
        *PARTITION_KEY, A.what_changed(F.col("replicas"), F.col("after")).alias("change"))


@query("scl12_membership", """
select cluster_id, topic, partition_id, list_contains(replicas, partition_id % 10) as held from fx_map""")
def _(t):
    return t.partition_map.select(*PARTITION_KEY, A.holds(F.col("replicas"), F.col("partition_id") % 10).alias("held"))


@query("scl13_reassignment_target", """
select cluster_id, topic, partition_id,
       array_to_string(case when partition_id % 3 = 1 then replicas else list_filter(replicas, lambda x: x <> replicas[1]) end, ',') as target
from fx_map where partition_id % 3 <> 2""")
def _(t):
    r, p = F.col("replicas"), F.col("partition_id")
    removing = F.when(p % 3 == 0, F.slice(r, 1, 1))
    adding = F.when(p % 3 == 1, F.array(F.lit(1).cast("bigint")))
    return (t.partition_map.select(*PARTITION_KEY, A.reassignment_target(r, adding, removing).alias("g"))
            .filter("g is not null").select(*PARTITION_KEY, A.render(F.col("g")).alias("target")))


@query("scl14_throttle_configs", """
with res as (select resource_name, list(k order by k) as ks from fx_resource_config where source = 'dynamic' group by resource_name)
select resource_name, 'populate' as edit,
       array_to_string(list_sort(ks || ['leader.replication.throttled.replicas', 'follower.replication.throttled.replicas']), ',') as config_keys from res
union all
select resource_name, 'clear', array_to_string(ks, ',') from res""")
def _(t):
    cfg = t.resource_config.filter("source = 'dynamic'").groupBy("resource_name").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("config"))
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",").alias("config_keys")
    on = cfg.withColumn("config", X.with_topic_throttle(F.col("config")))
    throttle = [X.LEADERS_KEY, X.FOLLOWERS_KEY]
    off = (on.filter(X.has_any_key(F.col("config"), throttle))
           .withColumn("config", X.without_keys(F.col("config"), throttle)))
    return on.select("resource_name", F.lit("populate").alias("edit"), keys("config")).unionByName(
        off.select("resource_name", F.lit("clear").alias("edit"), keys("config")))


@query("scl14_broker_throttle_configs", """
select cluster_id, broker_id,
       case when broker_id % 4 = 0 then null else cast(broker_id * 1000000 as varchar) end as leader_rate,
       case when broker_id % 3 = 0 then null else cast(broker_id * 2000000 as varchar) end as follower_rate,
       rack as kept
from fx_broker_meta""")
def _(t):
    b = F.col("broker_id")
    base = F.create_map(F.lit("broker.rack"), F.col("rack"))
    cfg = X.with_broker_throttle(base, F.when(b % 4 == 0, 0).otherwise(b * 1000000),
                                 F.when(b % 3 == 0, 0).otherwise(b * 2000000))
    m = t.broker_meta.select("cluster_id", "broker_id", cfg.alias("c"))
    return m.select("cluster_id", "broker_id", F.col("c")[X.LEADER_RATE_KEY].alias("leader_rate"),
                    F.col("c")[X.FOLLOWER_RATE_KEY].alias("follower_rate"), F.col("c")["broker.rack"].alias("kept"))


@query("scl15_config_diff", """
with want as (select resource_name, k, case when source = 'default' then '' else v end as v from fx_resource_config where v <> '7'),
cur as (select resource_name, k, case when source = 'dynamic' then v else concat(v, '0') end as v from fx_resource_config where v <> '9')
select resource_name, k, coalesce(cur.v, '') <> coalesce(want.v, cur.v) as changed,
       case when want.v is null then cur.v when want.v = '' then null else want.v end as new_value
from want full outer join cur using (resource_name, k)""")
def _(t):
    rc = t.resource_config
    want = rc.filter("v <> '7'").select(
        "resource_name", "k", F.when(F.col("source") == "default", "").otherwise(F.col("v")).alias("v"))
    cur = rc.filter("v <> '9'").select(
        "resource_name", "k",
        F.when(F.col("source") == "dynamic", F.col("v")).otherwise(F.concat("v", F.lit("0"))).alias("v"))
    from replicalens.operators.sets import config_diff

    return config_diff(cur, want, ["resource_name"])


@query("scl16_parse_broker_ids", """
select p_partkey, case when p_partkey % 10 = 3 then null else concat(p_partkey, ',', p_size + 100000) end as ids from part""")
def _(t):
    a, b = F.col("p_partkey").cast("string"), (F.col("p_size") + 100000).cast("string")
    listed = F.concat(a, F.lit(", "), b, F.lit(" ,"), a, F.when(F.col("p_partkey") % 10 == 3, ",x").otherwise(""))
    return t.table("part").select("p_partkey", A.render(A.parse_broker_ids(listed)).alias("ids"))


@query("scl17_maps_equal", """
select b.cluster_id, b.topic, count(case when a.replicas <> b.replicas then 1 end) as differing,
       count(case when a.replicas <> b.replicas then 1 end) = 0 as equal
from fx_map b join fx_map_after a using (cluster_id, topic, partition_id) group by b.cluster_id, b.topic""")
def _(t):
    return maps_differ(t.partition_map, t.partition_map_after)


@query("scl18_replica_assignment", """
with r as (select cluster_id, topic, partition_id // 1000 as range_id, count(*) as partitions, max(partition_id % 1000) as top from fx_map group by all),
s as (select *, unnest(range(0, top + 1)) as i from r)
select s.cluster_id, s.topic, s.range_id, s.partitions, string_agg(coalesce(array_to_string(m.replicas, ','), ''), ';' order by i) as assignment
from s left join fx_map m on m.cluster_id = s.cluster_id and m.topic = s.topic and m.partition_id = s.range_id * 1000 + s.i
group by s.cluster_id, s.topic, s.range_id, s.partitions""")
def _(t):
    from replicalens.operators.aggregates import replica_assignment

    return replica_assignment(t.partition_map, 1000).select(
        "cluster_id", "topic", "range_id", F.size(F.filter("assignment", lambda r: r.isNotNull())).cast("bigint").alias("partitions"),
        F.array_join(F.transform("assignment", lambda r: F.coalesce(A.render(r), F.lit(""))), ";").alias("assignment"))
