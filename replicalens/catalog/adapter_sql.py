"""SQL form of the adapters, for the oracle side."""

from __future__ import annotations

import re

ADAPTER_SQL = {
    "fx_clusters": "select unnest(['f', 'o', 'p']) as cluster_id",
    "fx_replicas": """
select cluster_id, topic, partition_id, broker_id, in_isr,
       cast(row_number() over (partition by cluster_id, topic, partition_id order by ln, broker_id) - 1 as int) as idx
from (select lower(o_orderstatus) as cluster_id, concat('t', substr(o_orderpriority, 1, 1)) as topic,
             o_orderkey as partition_id, l_suppkey as broker_id, min(l_linenumber) as ln,
             max(case when l_returnflag <> 'R' then 1 else 0 end) as in_isr
      from lineitem join orders on l_orderkey = o_orderkey
      group by lower(o_orderstatus), concat('t', substr(o_orderpriority, 1, 1)), o_orderkey, l_suppkey) x""",
    "fx_map": """
select cluster_id, topic, partition_id, list(broker_id order by idx) as replicas
from fx_replicas group by cluster_id, topic, partition_id""",
    "fx_partition_size": """
select lower(o_orderstatus) as cluster_id, concat('t', substr(o_orderpriority, 1, 1)) as topic,
       o_orderkey as partition_id, cast(max(round(l_extendedprice * 100)) as bigint) as size_bytes
from lineitem join orders on l_orderkey = o_orderkey
group by lower(o_orderstatus), concat('t', substr(o_orderpriority, 1, 1)), o_orderkey""",
    "fx_broker_meta": """
select c.cluster_id, s_suppkey as broker_id, s_name as host, 9092 as port,
       case when s_suppkey % 17 = 5 then '' else concat('r', cast(n_regionkey as varchar)) end as rack,
       cast(round((s_acctbal + 2000) * 100) as bigint) as storage_free,
       concat('it', cast(n_nationkey % 3 as varchar)) as instance_type,
       case when s_suppkey % 10 = 9 then 0 else 1 end as is_live
from supplier join nation on s_nationkey = n_nationkey cross join fx_clusters c""",
    "fx_provided_brokers": """
select cluster_id, s_suppkey as broker_id from supplier, fx_clusters where s_suppkey % 7 <> 3
union all
select cluster_id, s_suppkey + 1000000 as broker_id from supplier, fx_clusters where s_suppkey % 5 = 0""",
    "fx_discovered_brokers": """
select cluster_id, broker_id, rack, storage_free from fx_broker_meta where is_live = 1
union all
select cluster_id, broker_id + 1000000, rack, storage_free from fx_broker_meta where broker_id % 10 = 0""",
    "fx_replicas_after": """
select r.cluster_id, r.topic, r.partition_id, r.idx,
       case when r.broker_id % 9 = 0 and x.broker_id is null
            then (r.broker_id + 1) % (select count(*) from supplier) else r.broker_id end as broker_id
from fx_replicas r
left join fx_replicas x on x.cluster_id = r.cluster_id and x.topic = r.topic and x.partition_id = r.partition_id
      and x.broker_id = (r.broker_id + 1) % (select count(*) from supplier)""",
    "fx_map_after": """
select cluster_id, topic, partition_id, list(broker_id order by idx) as replicas
from fx_replicas_after group by cluster_id, topic, partition_id""",
    "fx_reassignment": """
select * from (
select r.cluster_id, r.topic, r.partition_id, r.idx,
       case when r.idx = 0 then r.broker_id else (r.broker_id * 7 + 3) % (select count(*) from supplier) end as target_broker,
       l.broker_id as leader
from fx_replicas r
join fx_replicas l on l.cluster_id = r.cluster_id and l.topic = r.topic and l.partition_id = r.partition_id and l.idx = 0) x where idx = 0 or target_broker <> leader""",
    "fx_override": """
select cluster_id, s_suppkey as broker_id, case when s_suppkey % 2 = 0 then 0 else 50 + s_suppkey % 3 end as rate,
       s_suppkey % 5 = 0 as autoremove
from supplier, fx_clusters where s_suppkey % 3 = 0""",
    "fx_metric_points": """
select event_id, ts, event_type as metric,
       concat('host:h', cast(user_id % 20 as varchar), ',broker_id:', cast(user_id % 20 as varchar),
              ',instance-type:it', cast(user_id % 3 as varchar)) as scope,
       case when event_id % 11 = 0 then null else value end as value
from events""",
    "fx_tags": """
select 'broker' as object_type, cast(c_custkey as varchar) as object_id, 'pool' as k, lower(c_mktsegment) as v from customer
union all
select 'broker', cast(c_custkey as varchar), 'zone', concat('z', cast(c_nationkey % 4 as varchar)) from customer
union all
select 'broker', cast(c_custkey as varchar), 'tagMarkedForDeletionTime', cast(1704067200 + c_custkey * 60 as varchar)
from customer where c_custkey % 13 = 0""",
    "fx_checkpoints": """
select event_id as log_offset, concat('g', cast(user_id % 5 as varchar)) as group_id, event_type as topic,
       user_id % 8 as partition_id, event_id * 3 as upstream_offset, event_id as local_offset
from events""",
    "fx_resource_config": """
select 'topic' as resource_type, p_brand as resource_name, lower(p_type) as k,
       cast(max(p_size) as varchar) as v, case when max(p_partkey) % 3 = 0 then 'dynamic' else 'default' end as source
from part group by p_brand, lower(p_type)""",
    "fx_topic_snapshots": """
select distinct date_trunc('day', ts) as snapshot_ts, concat('t', cast(user_id % 12 as varchar)) as topic
from events where event_type = 'purchase'""",
}


def add_adapters(more: dict[str, str]) -> None:
    ADAPTER_SQL.update(more)


def _needed(sql: str, seen: list[str]) -> None:
    for name in re.findall(r"\bfx_\w+", sql):
        if name not in seen:
            _needed(ADAPTER_SQL[name], seen)
            if name not in seen:
                seen.append(name)


def with_adapters(sql: str) -> str:
    """Prefix ``sql`` with the common table expressions of the adapters it names."""
    sql = sql.strip()
    seen: list[str] = []
    _needed(sql, seen)
    ctes = ",\n".join(f"{n} as ({ADAPTER_SQL[n].strip()})" for n in seen)
    head = re.match(r"with\s+(recursive\s+)?", sql, re.I)
    word = "with recursive" if head and head.group(1) else "with"
    if head:
        rest = sql[head.end():]
        return f"{word} {ctes},\n{rest}" if ctes else sql
    return f"{word} {ctes}\n{sql}" if ctes else sql
