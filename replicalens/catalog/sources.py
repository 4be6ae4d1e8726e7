"""Registered queries of sources and sinks: documents are built from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicalens.catalog.base import query
from replicalens.catalog.joins import targets
from replicalens.functions.arrays import reassignment_target, render
from replicalens.schemas import PARTITION_KEY
from replicalens.session import scratch_path
from replicalens.sources import checkpoint_log as C
from replicalens.sources import documents as D
from replicalens.sources import sinks as K

MAP_SQL = "select cluster_id, topic, partition_id, array_to_string(replicas, ',') as replicas from fx_map"


def rendered(df):
    return df.select(*PARTITION_KEY, render(F.col("replicas")).alias("replicas"))


@query("src01_map_documents", MAP_SQL)
def _(t):
    return rendered(D.parse_maps(K.map_documents(t.partition_map, tasks=t.tasks)))


@query("src02_topic_states", """
select cluster_id, topic, partition_id, replicas[1] as leader, array_to_string(replicas, ',') as replicas from fx_map""")
def _(t):
    snap = t.topic_state.groupBy("cluster_id", "topic", F.expr("partition_id div 1000").alias("range_id")).agg(
        F.collect_list(F.struct("partition_id", "leader", "replicas", "isr")).alias("partitions"))
    return D.flatten_topic_states(snap).select(*PARTITION_KEY, "leader", render(F.col("replicas")).alias("replicas"))


@query("src03_broker_snapshot", """
select cluster_id, broker_id, host, port, rack, case when broker_id % 2 = 0 then '2.8' else '' end as log_message_format, '' as inter_broker_protocol_version
from fx_broker_meta where broker_id % 9 <> 4 and broker_id % 9 <> 5""")
def _(t):
    b = F.col("broker_id")
    docs = t.broker_meta.select(
        "cluster_id", F.when(b % 9 == 4, F.concat(F.lit("x"), b.cast("string"))).otherwise(b.cast("string")).alias("id"),
        F.when(b % 9 == 5, "{bad").otherwise(F.to_json(F.struct("host", "port", "rack"))).alias("doc"))
    pairs = F.map_filter(F.create_map(
        F.lit("broker.rack"), F.col("rack"),
        F.lit("log.message.format.version"), F.when(b % 2 == 0, "2.8").otherwise("")), lambda _k, v: v != "")
    cfg = t.broker_meta.select("cluster_id", "broker_id", pairs.alias("config"))
    return D.describe_brokers(D.parse_broker_documents(docs), cfg)


@query("src04_size_documents", "select * from fx_partition_size")
def _(t):
    return D.parse_partition_sizes(K.size_documents(t.partition_size)).select(*PARTITION_KEY, "size_bytes")


@query("src05_storage_documents", "select cluster_id, broker_id, storage_free from fx_broker_meta")
def _(t):
    return D.parse_broker_storage(K.storage_documents(t.broker_meta))


@query("src06_reassignment_documents", """
select cluster_id, topic, partition_id, string_agg(target_broker, ',' order by idx) as replicas
from fx_reassignment where not (topic = 't2' and partition_id // 1000 = 0) group by cluster_id, topic, partition_id""")
def _(t):
    docs = K.map_documents(targets(t), tasks=t.tasks)
    torn = (F.col("map_name") == "t2") & (F.col("range_id") == 0)
    return rendered(D.parse_reassignments(docs.withColumn("doc", F.when(~torn, F.col("doc")))))


@query("src07_topic_metadata", """
select cluster_id, topic, partition_id, array_to_string(list_filter(replicas, lambda x: x <> replicas[1]), ',') as target from fx_map where partition_id % 3 = 0""")
def _(t):
    pid, r = F.col("partition_id").cast("string"), F.col("replicas")
    rows = F.collect_list(F.struct(pid.alias("k"), r.alias("v")))
    gone = F.collect_list(F.when(F.col("partition_id") % 3 == 0, F.struct(pid.alias("k"), F.slice(r, 1, 1).alias("v"))))
    docs = t.partition_map.groupBy("cluster_id", "topic", F.expr("partition_id div 1000").alias("range_id")).agg(
        F.map_from_entries(rows).alias("partitions"), F.map_from_entries(gone).alias("removing_replicas"))
    docs = docs.select("cluster_id", "topic", F.to_json(F.struct(
        F.lit(3).alias("version"), "partitions", F.create_map().cast("map<string,array<bigint>>").alias("adding_replicas"),
        "removing_replicas")).alias("doc"))
    m = D.parse_topic_metadata(docs).withColumn("g", reassignment_target(F.col("current"), F.col("adding"), F.col("removing")))
    return m.filter("g is not null").select(*PARTITION_KEY, render(F.col("g")).alias("target"))


@query("src08_partition_states", """
select cluster_id, topic, partition_id, max(case when idx = 0 then broker_id end) as leader,
       coalesce(string_agg(case when in_isr = 1 then broker_id end, ',' order by idx), '') as isr
from fx_replicas group by cluster_id, topic, partition_id""")
def _(t):
    docs = t.topic_state.select(*PARTITION_KEY, F.to_json(F.struct(
        F.lit(1).alias("version"), F.lit(5).alias("controller_epoch"), "leader", F.lit(2).alias("leader_epoch"), "isr")).alias("doc"))
    return D.parse_partition_states(docs).select(*PARTITION_KEY, "leader", render(F.col("isr")).alias("isr"))


@query("src09_resource_configs", """
select resource_type, resource_name, string_agg(concat(k, '=', v), ',' order by k) as config from fx_resource_config group by resource_type, resource_name""")
def _(t):
    c = D.resource_configs(t.resource_config)
    return c.select("resource_type", "resource_name",
                    F.array_join(F.transform(F.map_entries("config"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("config"))


@query("src10_metric_points", """
select event_id, metric, value from fx_metric_points where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-20 00:00:00'""")
def _(t):
    lo, hi = (F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz") for d in ("05", "20"))
    return t.metric_points_from(D.metric_points(t.table("events"), lo, hi)).select("event_id", "metric", "value")


@query("src11_checkpoint_log", """
select log_offset, group_id, topic, partition_id, upstream_offset, local_offset, 'meta' as metadata, false as rejected from fx_checkpoints where log_offset % 50 <> 0
union all
select log_offset, null, null, null, null, null, null, true from fx_checkpoints where log_offset % 50 = 0""")
def _(t):
    log = C.encode_checkpoints(t.checkpoints, "meta")
    version = F.when(F.col("log_offset") % 50 == 0, F.unhex(F.lit("0001"))).otherwise(F.unhex(F.lit("0000")))
    log = log.withColumn("value", F.concat(version, F.col("value").substr(F.lit(3), F.lit(1000))))
    good, bad = C.decode_checkpoints(log)
    good = good.withColumns({c: F.col(c).cast("bigint") for c in ("upstream_offset", "local_offset")})
    return good.withColumn("rejected", F.lit(False)).unionByName(
        bad.select("log_offset", F.lit(True).alias("rejected")), allowMissingColumns=True)


@query("src12_tag_table", """
select 'broker' as asked, object_type, object_id, k, v from fx_tags
union all select 'all', object_type, object_id, k, v from fx_tags""")
def _(t):
    tags = D.parse_tags(t.tags.select("object_type", "object_id", F.to_json("tags").alias("doc")))
    rows = lambda df, asked: df.select(F.lit(asked).alias("asked"), "object_type", "object_id", F.explode("tags").alias("k", "v"))
    return rows(D.tags_of_type(tags, "broker"), "broker").unionByName(rows(D.tags_of_type(tags), "all"))


@query("src13_override_documents", """
select cluster_id, broker_id, case when broker_id % 4 = 3 then 0 else rate end as rate, autoremove and broker_id % 4 <> 3 as autoremove from fx_override""")
def _(t):
    docs = t.override.select("cluster_id", "broker_id", F.when(F.col("broker_id") % 4 == 3, "").otherwise(
        F.to_json(F.struct("rate", "autoremove"))).alias("doc"))
    return D.parse_overrides(docs)


@query("snk01_write_maps", """
select 'by_topic' as kind, cluster_id, map_name, topic, partition_id, array_to_string(replicas, ',') as replicas from (
  select cluster_id, concat(topic, '-phase1') as map_name, topic, partition_id, replicas from fx_map
  union all select cluster_id, concat(topic, '-phase2'), topic, partition_id, replicas from fx_map_after) x
union all
select 'combined', cluster_id, null, topic, partition_id, array_to_string(replicas, ',') from (select * from fx_map union all select * from fx_map_after) y""")
def _(t):
    spark, path = t.spark, scratch_path(t.spark, "map-documents")
    maps = t.partition_map.withColumn("phase", F.lit(1)).unionByName(t.partition_map_after.withColumn("phase", F.lit(2)))
    K.write_map_documents(maps, path, combined=True, tasks=2 * t.tasks)
    one = D.parse_maps(D.read_text_documents(spark, f"{path}/by_topic")).withColumn("kind", F.lit("by_topic"))
    both = D.parse_maps(D.read_text_documents(spark, f"{path}/combined")).withColumn("kind", F.lit("combined"))
    cols = ["kind", "cluster_id", "map_name", "topic", "partition_id"]
    return one.unionByName(both, allowMissingColumns=True).select(*cols, render(F.col("replicas")).alias("replicas"))


@query("snk02_metric_documents", """
select cluster_id, topic, partition_id, null as broker_id, size_bytes as value from fx_partition_size
union all select cluster_id, null, null, broker_id, storage_free from fx_broker_meta""")
def _(t):
    spark, path = t.spark, scratch_path(t.spark, "metric-documents")
    K.write_documents(K.size_documents(t.partition_size), f"{path}/sizes")
    K.write_documents(K.storage_documents(t.broker_meta), f"{path}/storage")
    sizes = D.parse_partition_sizes(D.read_text_documents(spark, f"{path}/sizes"))
    free = D.parse_broker_storage(D.read_text_documents(spark, f"{path}/storage"))
    return sizes.withColumnRenamed("size_bytes", "value").unionByName(
        free.withColumnRenamed("storage_free", "value"), allowMissingColumns=True).select(
        "cluster_id", "topic", "partition_id", "broker_id", "value")


def tag_changes(t):
    c, n = t.table("customer"), F.col("c_custkey")
    return c.filter("c_custkey % 2 = 0").select(
        F.lit("broker").alias("object_type"), F.when(n % 10 == 0, "").otherwise((n + 5).cast("string")).alias("object_id"),
        F.when(n % 6 == 0, F.create_map(F.lit("rack"), F.lit("r1")))
        .when(n % 14 == 0, F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("pool"), F.lit("new"), F.lit("tier"), F.lit("hot"))).alias("tags"))


@query("snk04_upsert_tags", """
with ch as (select cast(c_custkey + 5 as varchar) as object_id from customer where c_custkey % 2 = 0 and c_custkey % 10 <> 0 and c_custkey % 6 <> 0 and c_custkey % 14 <> 0)
select object_type, object_id, k, v from fx_tags where not (k = 'pool' and object_id in (select object_id from ch))
union all select 'broker', object_id, 'pool', 'new' from ch union all select 'broker', object_id, 'tier', 'hot' from ch
union all select 'rejected', null, null, cast(count(*) as varchar) from customer where c_custkey % 2 = 0 and (c_custkey % 10 = 0 or c_custkey % 6 = 0 or c_custkey % 14 = 0)""")
def _(t):
    table, bad = K.upsert_tags(t.tags, tag_changes(t))
    return table.select("object_type", "object_id", F.explode("tags").alias("k", "v")).unionByName(
        bad.agg(F.count(F.lit(1)).cast("string").alias("v")).select(
            F.lit("rejected").alias("object_type"), F.lit(None).cast("string").alias("object_id"), F.lit(None).cast("string").alias("k"), "v"))


@query("snk05_delete_tags", """
select 'kept' as kind, object_id, k, v from fx_tags where not (cast(object_id as bigint) % 3 = 0 and k in ('pool', 'tagMarkedForDeletionTime'))
union all select 'rejected', cast(c_custkey + 100000000 as varchar), null, null from customer where c_custkey % 5 = 0""")
def _(t):
    n = F.col("c_custkey")
    keys = F.array(F.lit("pool:any"), F.lit("tagMarkedForDeletionTime")).alias("keys")
    c = t.table("customer")
    req = c.filter("c_custkey % 3 = 0").select(F.lit("broker").alias("object_type"), n.cast("string").alias("object_id"), keys).unionByName(
        c.filter("c_custkey % 5 = 0").select(F.lit("broker").alias("object_type"), (n + 100000000).cast("string").alias("object_id"), keys))
    table, bad = K.delete_tags(t.tags, req)
    return table.select(F.lit("kept").alias("kind"), "object_id", F.explode("tags").alias("k", "v")).unionByName(
        bad.select(F.lit("rejected").alias("kind"), "object_id"), allowMissingColumns=True)


TAG_LOG_SQL = """
with log as (
  select c_custkey as c, 1 as seq, 'pool' as k, 'first' as v, true as kept from customer where c_custkey % 2 = 0
  union all select c_custkey, 2, 'pool', null, false from customer where c_custkey % 3 = 0
  union all select c_custkey, 3, 'tier', 'hot', true from customer where c_custkey % 2 = 0
  union all select c_custkey, 4, 'pool', 'last', true from customer where c_custkey % 5 = 0
  union all select c_custkey, 5, 'zone', null, false from customer where c_custkey % 7 = 0),
w as (select cast(c as varchar) as object_id, k, arg_max(kept, seq) as kept, arg_max(coalesce(v, ''), seq) as v from log group by all)
select 'table' as kind, object_id, k, v from fx_tags where (object_id, k) not in (select object_id, k from w)
union all select 'table', object_id, k, v from w where kept
union all select 'rejected', cast(c_custkey + 100000000 as varchar), null, null from customer where c_custkey % 11 = 0"""


@query("snk05_tag_log", TAG_LOG_SQL)
def _(t):
    c, n = t.table("customer"), F.col("c_custkey")

    def rows(mod, seq, key, value=None, shift=0):
        tags = F.create_map(F.lit(key), F.lit(value)) if value else F.lit(None).cast("map<string,string>")
        keys = F.lit(None).cast("array<string>") if value else F.array(F.lit(f"{key}:any"))
        return c.filter(n % mod == 0).select(F.lit("broker").alias("object_type"), (n + shift).cast("string").alias("object_id"), F.lit(seq).alias("seq"),
                                             tags.alias("tags"), keys.alias("keys"))

    log = rows(5, 4, "pool", "last")
    for more in (rows(2, 1, "pool", "first"), rows(7, 5, "zone"), rows(3, 2, "pool"), rows(2, 3, "tier", "hot"), rows(11, 6, "pool", shift=100000000)):
        log = log.unionByName(more)
    table, bad = K.apply_tag_log(t.tags, log)
    return table.select(F.lit("table").alias("kind"), "object_id", F.explode("tags").alias("k", "v")).unionByName(
        bad.select(F.lit("rejected").alias("kind"), "object_id"), allowMissingColumns=True)
