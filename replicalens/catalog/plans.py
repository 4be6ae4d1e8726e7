"""Registered queries of the planners: exact twins where SQL can state the plan, else its invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicalens.catalog.adapter_sql import add_adapters
from replicalens.catalog.aggregates import meta_after, moves
from replicalens.catalog.base import query
from replicalens.catalog.filters import merged, state
from replicalens.functions.arrays import render, set_replication, to_partition_map, to_replicas
from replicalens.operators import aggregates as A
from replicalens.operators.windows import top_k
from replicalens.plans import affinity, constraints, leadership, maps, placement, relocation, repair
from replicalens.schemas import PARTITION_KEY
from replicalens.session import materialize

add_adapters({
    # Planning state: brokers that are not live are missing, every eleventh is being replaced.
    "fx_plan_state": """
select cluster_id, broker_id, rack, coalesce(u.used, 0) as used, storage_free * 100000 as storage_free,
       is_live = 0 or broker_id % 11 = 4 as is_replace, is_live = 0 as is_missing, broker_id % 8 = 6 as is_new
from fx_broker_meta left join (select cluster_id, broker_id, count(*) as used from fx_replicas group by all) u using (cluster_id, broker_id)""",
})


def plan_state(t, replicas=None):
    used = (t.replicas if replicas is None else replicas).groupBy("cluster_id", "broker_id").agg(F.count(F.lit(1)).alias("used"))
    b = F.col("broker_id")
    return t.broker_meta.join(used, ["cluster_id", "broker_id"], "left").select(
        "cluster_id", "broker_id", "rack", F.coalesce("used", F.lit(0)).alias("used"),
        (F.col("storage_free") * 100000).alias("storage_free"), ((F.col("is_live") == 0) | (b % 11 == 4)).alias("is_replace"),
        (F.col("is_live") == 0).alias("is_missing"), (b % 8 == 6).alias("is_new"))


def placement_sql(rf: int, z: str, cap: str, layered: bool = False) -> str:
    before = "rows between unbounded preceding and 1 preceding"
    klass = "length(bin(z))" if layered else "0"
    return f"""
with p as (select cluster_id, topic, partition_id, {z} as z, md5(concat(topic, ':', partition_id)) as h from fx_partition_size),
l as (select *, coalesce(sum(z) over (partition by cluster_id, {klass} order by h, topic, partition_id {before}), 0) as off,
        row_number() over (partition by cluster_id order by {klass} desc, h, topic, partition_id) - 1 as ordinal,
        sum(z) over (partition by cluster_id) as zt, sum(z) over (partition by cluster_id, {klass}) as zq from p),
b as (select cluster_id, broker_id, greatest({cap}, 1) as c, md5(cast(broker_id as varchar)) as bh,
        case when rack = '' then concat('#', broker_id) else rack end as grp, rack as lane from fx_broker_meta),
pg as (select cluster_id, grp, sum(c) as cg from b group by all),
ct as (select cluster_id, sum(cg) as ct from pg group by all),
big as (select *, row_number() over (partition by cluster_id order by cg desc, grp) as rn,
        coalesce(sum(cg) over (partition by cluster_id order by cg desc, grp {before}), 0) as bef from pg),
cut as (select cluster_id, grp, rn, cg from (
        select big.*, min(case when cg * ({rf} + 1 - rn) > ct - bef then 1 else 0 end) over (partition by cluster_id order by rn) as f
        from big join ct using (cluster_id) where rn <= {rf}) x where f = 1),
base as (select ct.cluster_id, count(cut.grp) as m, any_value(ct.ct) - coalesce(sum(cut.cg), 0) as fc from ct left join cut using (cluster_id) group by ct.cluster_id),
zt as (select distinct cluster_id, zt from l),
seg as (
  select cluster_id, broker_id, 2 * zt * (rn - 1) + (2 * zt * cum) // cg as s, 2 * zt * (rn - 1) + (2 * zt * (cum + c)) // cg as e
  from (select b.*, cut.rn, cut.cg, coalesce(sum(c) over (partition by cluster_id, grp order by bh, broker_id {before}), 0) as cum
        from b join cut using (cluster_id, grp)) q join zt using (cluster_id)
  union all
  select cluster_id, broker_id, 2 * zt * m + (2 * zt * ({rf} - m) * cum) // fc, 2 * zt * m + (2 * zt * ({rf} - m) * (cum + c)) // fc
  from (select b.*, coalesce(sum(c) over (partition by cluster_id order by lane, bh, broker_id {before}), 0) as cum
        from b anti join cut using (cluster_id, grp)) q join base using (cluster_id) join zt using (cluster_id)),
slots as (select cluster_id, topic, partition_id, ordinal, k, ((2 * off + z) * zt) // zq + 2 * k * zt as pos from l, (select unnest(range(0, {rf})) as k) ks)
select cluster_id, topic, partition_id, cast((k + ordinal) % {rf} as int) as idx, broker_id
from slots join seg using (cluster_id) where pos >= s and pos < e"""


@query("pln01_place_by_count", placement_sql(3, "1", "1"))
def _(t):
    placed, _errors = placement.place(t.partition_size, t.broker_meta, 3, strategy="count")
    return placed


@query("pln01_place_by_storage", placement_sql(4, "size_bytes", "storage_free * 1000000"))
def _(t):
    # With four replicas the largest racks exceed their share, so the capped case is exercised. Storage is ample here:
    # placement by share alone is what the twin states. Scarce storage is the next query.
    ample = t.broker_meta.withColumn("storage_free", F.col("storage_free") * 1000000)
    placed, _errors = placement.place(t.partition_size, ample, 4, strategy="storage")
    return placed


LARGEST_FIRST_SQL = placement_sql(3, "size_bytes", "storage_free * 1000000", layered=True)


@query("pln01_place_largest_first", LARGEST_FIRST_SQL)
def _(t):
    ample = t.broker_meta.withColumn("storage_free", F.col("storage_free") * 1000000)
    placed, _errors = placement.place(t.partition_size, ample, 3, strategy="storage", optimization="storage")
    return placed


@query("pln01_optimization_spread", f"""
with placed as (select 'storage' as optimization, * from ({LARGEST_FIRST_SQL}) a
  union all select 'distribution', * from ({placement_sql(3, "size_bytes", "storage_free * 1000000")}) b),
sized as (select p.*, size_bytes, length(bin(size_bytes)) = max(length(bin(size_bytes))) over (partition by cluster_id) as large
  from placed p join fx_partition_size using (cluster_id, topic, partition_id)),
held as (select optimization, cluster_id, broker_id, sum(case when large then size_bytes end) as large_bytes, sum(size_bytes) as bytes from sized group by all)
select optimization, cluster_id, cast(max(coalesce(large_bytes, 0) * 1000 // storage_free) - min(coalesce(large_bytes, 0) * 1000 // storage_free) as bigint) as large_spread,
  cast(max(coalesce(bytes, 0) * 1000 // storage_free) - min(coalesce(bytes, 0) * 1000 // storage_free) as bigint) as spread
from held join fx_broker_meta using (cluster_id, broker_id) group by optimization, cluster_id""")
def _(t):
    # How unevenly brokers are filled, in thousandths of their free storage: by partitions of the largest size class, and by all.
    ample = t.broker_meta.withColumn("storage_free", F.col("storage_free") * 1000000)
    size = materialize(t.partition_size, "spread-sizes")
    parts = size
    size = size.withColumn("class", F.length(F.bin("size_bytes")))
    size = size.join(size.groupBy("cluster_id").agg(F.max("class").alias("top")), "cluster_id")
    both = None
    for optimization in ("storage", "distribution"):
        placed, _errors = placement.place(parts, ample, 3, strategy="storage", optimization=optimization)
        placed = placed.withColumn("optimization", F.lit(optimization))
        both = placed if both is None else both.unionByName(placed)
    per = ["optimization", "cluster_id"]
    held = both.join(size, PARTITION_KEY).groupBy(*per, "broker_id").agg(
        F.sum(F.when(F.col("class") == F.col("top"), F.col("size_bytes"))).alias("large"), F.sum("size_bytes").alias("bytes")).join(
        t.broker_meta.select("cluster_id", "broker_id", "storage_free"), ["cluster_id", "broker_id"])
    share = lambda c: F.expr(f"coalesce({c}, 0) * 1000 div storage_free")
    return held.groupBy(*per).agg((F.max(share("large")) - F.min(share("large"))).alias("large_spread"), (F.max(share("bytes")) - F.min(share("bytes"))).alias("spread"))


def room_summary(t, st, placed, errors, rf):
    """What storage placement promises, counted per cluster; ``missed`` are errors that an allowed broker could have held."""
    z = t.partition_size.select(*PARTITION_KEY, F.greatest("size_bytes", F.lit(1)).alias("z"))
    own = F.concat(F.lit("#"), F.col("broker_id").cast("string"))
    st = st.select("cluster_id", "broker_id", F.when(F.col("rack") == "", own).otherwise(F.col("rack")).alias("grp"), "storage_free")
    rows = materialize(placed.join(z, PARTITION_KEY).join(st, ["cluster_id", "broker_id"]), "placed-rows")
    load = rows.groupBy("cluster_id", "broker_id").agg(F.sum("z").alias("load"))
    left = st.join(load, ["cluster_id", "broker_id"], "left").withColumn("left", F.col("storage_free") - F.coalesce("load", F.lit(0)))
    left = materialize(left, "placed-left")
    over = left.groupBy("cluster_id").agg(F.count(F.when(F.col("load") > F.col("storage_free"), 1)).alias("overfull"))
    sets = rows.groupBy(*PARTITION_KEY).agg(F.collect_set("grp").alias("grps"), F.count(F.lit(1)).alias("n"))
    clash = sets.groupBy("cluster_id").agg(F.sum(F.col("n") - F.size("grps")).cast("bigint").alias("rack_clashes"))
    # A list uses rf - 1 groups at most when a slot is open, so the rf freest groups hold the freest allowed one.
    top = top_k(left.groupBy("cluster_id", "grp").agg(F.max("left").alias("most")), ["cluster_id"], [F.col("most").desc(), "grp"], rf)
    best = top.groupBy("cluster_id").agg(F.collect_list(F.struct("grp", "most")).alias("best"))
    none = F.array().cast("array<string>")
    open_ = errors.select(*PARTITION_KEY).join(z, PARTITION_KEY).join(sets, PARTITION_KEY, "left").join(best, "cluster_id").withColumn(
        "grps", F.coalesce("grps", none))
    missed = open_.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("open"), F.count(F.when(
        F.expr("exists(best, x -> x.most >= z and not array_contains(grps, x.grp))"), 1)).alias("missed"))
    count = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("rows"))
    zero = F.lit(0).cast("bigint")
    out = over.join(clash, "cluster_id", "left").join(missed, "cluster_id", "left").join(count, "cluster_id", "left")
    return out.select("cluster_id", (F.coalesce("rows", zero) + F.coalesce("open", zero)).alias("slots"), (F.coalesce("open", zero) > 0).alias("scarce"),
                      "overfull", F.coalesce("rack_clashes", zero).alias("rack_clashes"), F.coalesce("missed", zero).alias("missed"))


@query("pln01_place_within_room", """
with c as (select cluster_id, 3 * count(*) as slots, 3 * sum(size_bytes) as need from fx_partition_size group by cluster_id)
select cluster_id, slots, true as scarce, 0::bigint as overfull, 0::bigint as rack_clashes, 0::bigint as missed from c""")
def _(t):
    # About nine tenths of what the three replicas of each cluster need, dealt by the brokers' shares, so some slots find no room.
    need = t.partition_size.groupBy("cluster_id").agg(F.sum("size_bytes").alias("need"))
    have = t.broker_meta.groupBy("cluster_id").agg(F.sum("storage_free").alias("have"))
    st = t.broker_meta.join(need, "cluster_id").join(have, "cluster_id").withColumn(
        "storage_free", F.expr("cast(cast(storage_free as decimal(38,0)) * need * 27 div (have * 10) as bigint)"))
    st = materialize(st.select("cluster_id", "broker_id", "rack", "storage_free"), "scarce-state")
    placed, errors = placement.place(t.partition_size, st, 3, strategy="storage")
    return room_summary(t, st, placed, materialize(errors, "scarce-errors"), 3)


@query("pln01_placement_errors", """
select cluster_id, count(*) as errors from fx_partition_size
where (select count(distinct case when rack = '' then concat('#', broker_id) else rack end) from fx_broker_meta) < 40 group by cluster_id""")
def _(t):
    _placed, errors = placement.place(t.partition_size, t.broker_meta, 40, strategy="count")
    return errors.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("errors"))


REPAIR_SQL = """
with s as (select r.cluster_id, r.topic, r.partition_id, r.idx, r.broker_id, st.rack, st.is_replace as open
  from fx_replicas r join fx_plan_state st using (cluster_id, broker_id)),
c as (select cluster_id, count(distinct case when rack <> '' then rack end) as racks, count(case when rack = '' then 1 end) as unracked, count(*) as brokers
  from fx_plan_state where not is_replace group by cluster_id),
p as (select cluster_id, topic, partition_id, count(*) as n, count(case when open then 1 end) as n_open,
  count(distinct case when not open and rack <> '' then rack end) as used_racks, count(case when not open and rack = '' then 1 end) as used_unracked
  from s group by cluster_id, topic, partition_id)
select p.cluster_id, count(*) as partitions, cast(sum(n) as bigint) as slots, cast(sum(n_open) as bigint) as open_slots,
  cast(sum({errors}) as bigint) as errors, 0::bigint as repeated_brokers, {clashes} as rack_clashes, 0::bigint as moved_good
from p join c using (cluster_id) group by p.cluster_id"""


def repair_input(t):
    """The map and the planning state, each computed once."""
    held = materialize(t.partition_map, "repair-map")
    return held, materialize(plan_state(t, to_replicas(held)), "repair-input-state")


def repair_summary(held, st, rows, errors, min_racks):
    """What repair promises, counted over the whole map ``held`` and its planning state.

    Old and repaired slots of a partition meet in one shuffle, and are matched by position inside their lists, which replication bounds.
    """
    brokers = st.select("cluster_id", "broker_id", "rack", "is_replace")
    old = to_replicas(held).join(brokers, ["cluster_id", "broker_id"]).select(
        *PARTITION_KEY, F.struct("idx", F.col("broker_id").alias("old"), F.col("is_replace").alias("open")).alias("was"))
    now = rows.join(brokers.drop("is_replace"), ["cluster_id", "broker_id"], "left").select(*PARTITION_KEY, F.struct("idx", "broker_id", "rack").alias("now"))
    sets = old.unionByName(now, allowMissingColumns=True).groupBy(*PARTITION_KEY).agg(F.collect_list("was").alias("was"), F.collect_list("now").alias("now"))
    # A slot without repaired rows stays as one without broker. Null keys meet no repaired row.
    whole = " and ".join(f"{c} is not null" for c in PARTITION_KEY)
    met = f"transform(was, o -> struct(o, if({whole}, filter(now, n -> n.idx = o.idx), slice(now, 1, 0)) as m))"
    none = "array(cast(null as struct<idx:int,broker_id:bigint,rack:string>))"
    j = sets.filter("size(was) > 0").select("cluster_id", F.expr(met).alias("met")).select("cluster_id", F.expr(f"""flatten(transform(met, x -> transform(
        if(size(x.m) = 0, {none}, x.m), n -> struct(x.o.old, x.o.open, n.broker_id, n.rack))))""").alias("j"))
    new_rack = "transform(filter(j, x -> x.open and x.rack <> ''), x -> x.rack)"
    kept_rack = "transform(filter(j, x -> not x.open and x.rack <> ''), x -> x.rack)"
    per = j.select(
        "cluster_id", F.expr("cast(size(j) as bigint) as n"), F.expr("cast(size(filter(j, x -> x.open)) as bigint) as n_open"),
        F.expr("size(filter(j, x -> x.broker_id is not null)) - size(array_distinct(filter(transform(j, x -> x.broker_id), x -> x is not null))) as rep"),
        F.expr("size(filter(j, x -> not x.open and not (x.old <=> x.broker_id))) as moved"),
        F.expr(f"size({new_rack}) - size(array_except({new_rack}, {kept_rack})) as clash"),
        F.expr("size(array_distinct(transform(filter(j, x -> x.rack <> ''), x -> x.rack))) as racks"))
    clash = F.sum("clash") if min_racks == 0 else F.count(F.when((F.col("clash") > 0) & (F.col("racks") < min_racks), 1))
    out = per.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("slots"), F.sum("n_open").alias("open_slots"),
        F.sum("rep").cast("bigint").alias("repeated_brokers"), clash.cast("bigint").alias("rack_clashes"), F.sum("moved").cast("bigint").alias("moved_good"))
    failed = errors.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("errors"))
    return out.join(failed, "cluster_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


@query("pln02_repair_invariants", REPAIR_SQL.format(
    errors="greatest(0, n_open - (racks - used_racks) - (unracked - used_unracked))", clashes="0::bigint"))
def _(t):
    held, st = repair_input(t)
    rows, errors = repair.repair(held, st)
    return repair_summary(held, st, rows, errors, 0)


@query("pln02_repair_min_racks_invariants", REPAIR_SQL.format(errors="greatest(0, n - brokers)", clashes="0::bigint"))
def _(t):
    held, st = repair_input(t)
    rows, errors = repair.repair(held, st, min_racks=2)
    return repair_summary(held, st, rows, errors, 2)


@query("pln02_repair_placement")
def _(t):
    held, st = repair_input(t)
    rows, _errors = repair.repair(held, st, strategy="storage", sizes=t.partition_size)
    return rows


@query("pln03_constraint", """
with r as (select f.*, m.rack from fx_replicas f join fx_broker_meta m using (cluster_id, broker_id)),
s as (select cluster_id, topic, partition_id, list(broker_id) as ids, list(distinct rack) filter (rack <> '') as racks from r group by all),
c as (select s.*, m.broker_id as cand, m.rack, m.storage_free from s join fx_broker_meta m on m.cluster_id = s.cluster_id
  and m.broker_id = s.partition_id % (select count(*) from supplier))
select cluster_id, topic, partition_id, cand,
  not list_contains(ids, cand) and (rack = '' or not list_contains(coalesce(racks, []), rack)) and storage_free >= 500000 as strict,
  not list_contains(ids, cand) and (rack = '' or not list_contains(coalesce(racks, []), rack) or len(racks) >= 2) and storage_free >= 500000 as min_two
from c""")
def _(t):
    m = t.broker_meta.select("cluster_id", "broker_id", "rack", "storage_free")
    sets = t.replicas.join(m, ["cluster_id", "broker_id"]).groupBy(*PARTITION_KEY).agg(
        F.collect_list("broker_id").alias("ids"), F.collect_list("rack").alias("racks"))
    c = sets.withColumn("cand", F.col("partition_id") % t.supplier_count).join(
        m.withColumnRenamed("broker_id", "cand"), ["cluster_id", "cand"])
    ok = lambda n: constraints.passes(F.col("cand"), F.col("rack"), F.col("storage_free"), F.col("ids"), F.col("racks"),
                                      request=F.lit(500000), min_racks=n)
    return c.select(*PARTITION_KEY, "cand", ok(0).alias("strict"), ok(2).alias("min_two"))


@query("pln04_substitution", """
with o as (select cluster_id, broker_id, rack, row_number() over (partition by cluster_id, rack order by broker_id) as n from fx_broker_meta where broker_id % 10 = 3),
f as (select cluster_id, broker_id + 1000000 as sub, rack, row_number() over (partition by cluster_id, rack order by broker_id) as n
  from fx_broker_meta where broker_id % 10 in (4, 6))
select cluster_id, broker_id, sub as substitute_id, case when sub is null then 'no free broker in the rack' end as reason
from o left join f using (cluster_id, rack, n)""")
def _(t):
    m = t.broker_meta.select("cluster_id", "broker_id", "rack")
    fresh = m.filter("broker_id % 10 in (4, 6)").withColumn("broker_id", F.col("broker_id") + 1000000).withColumn("is_new", F.lit(True))
    s = m.withColumn("is_new", F.lit(False)).unionByName(fresh).withColumns(
        {"is_replace": F.col("broker_id") % 10 == 3, "is_missing": F.lit(False)})
    s = s.withColumn("is_replace", F.col("is_replace") & ~F.col("is_new"))
    pairs, errors = affinity.substitution_affinities(s, t.replicas)
    return pairs.select("cluster_id", "broker_id", "substitute_id", F.lit(None).cast("string").alias("reason")).unionByName(
        errors.select("cluster_id", "broker_id", F.lit(None).cast("bigint").alias("substitute_id"), "reason"))


@query("pln05_leadership_invariants", """
with held as (select cluster_id, broker_id, count(*) as held, count(case when idx = 0 then 1 end) as leaders from fx_replicas group by all),
s as (select *, sum(leaders) over (partition by cluster_id) * held / sum(held) over (partition by cluster_id) as share from held),
l as (select cluster_id, topic, partition_id from fx_replicas r join s using (cluster_id, broker_id) where idx = 0 and leaders - ceil(share) > 0),
f as (select distinct cluster_id from fx_replicas r join s using (cluster_id, broker_id) join l using (cluster_id, topic, partition_id)
  where idx > 0 and floor(share) - leaders > 0)
select cluster_id, count(*) as partitions, 0::bigint as changed_sets, true as no_wider, f.cluster_id is not null as narrower, 0::bigint as hand_overs_left
from fx_map m left join f using (cluster_id) group by cluster_id, f.cluster_id""")
def _(t):
    before = materialize(t.partition_map, "leadership-input")
    after = leadership.balance_leaders(before)
    after = materialize(after, "leadership-output")
    sets = before.join(after.withColumnRenamed("replicas", "new"), PARTITION_KEY, "left").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.count(F.when(~F.array_sort("replicas").eqNullSafe(F.array_sort("new")), 1)).alias("changed_sets"))
    a = leadership.leader_spread(after).withColumnRenamed("spread", "a")
    b = leadership.leader_spread(before).withColumnRenamed("spread", "b")
    open_ = leadership.hand_overs(after, leadership.leader_targets(after)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("open"))
    return sets.join(a.join(b, "cluster_id"), "cluster_id").join(open_, "cluster_id", "left").select(
        "cluster_id", "partitions", "changed_sets", (F.col("a") <= F.col("b")).alias("no_wider"), (F.col("a") < F.col("b")).alias("narrower"),
        F.coalesce("open", F.lit(0).cast("bigint")).alias("hand_overs_left"))


@query("pln06_rotated_lists", """
select cluster_id, topic, partition_id, string_agg(broker_id, ',' order by (idx + partition_id) % n) as replicas
from (select *, count(*) over (partition by cluster_id, topic, partition_id) as n from fx_replicas) x group by cluster_id, topic, partition_id""")
def _(t):
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*PARTITION_KEY))
    r = t.replicas.withColumns({"n": n, "ordinal": F.col("partition_id")})
    return maps.rotate_replicas(r, "ordinal", "n").withColumn("replicas", render(F.col("replicas")))


def move_summary(t, st, plan):
    """What a relocation plan promises, counted per cluster over all tolerances, rounds taken to their end."""
    plan.moves = mv = materialize(plan.moves, "planned-moves")
    _kept, sc = relocation.best_rounds(plan)
    s = st.select("cluster_id", "broker_id", "rack")
    hosts = t.replicas.join(s, ["cluster_id", "broker_id"]).groupBy(*PARTITION_KEY).agg(
        F.collect_list("broker_id").alias("ids"), F.collect_list(F.struct("broker_id", "rack")).alias("rs"))
    d = mv.join(s.withColumnsRenamed({"broker_id": "dst", "rack": "new_rack"}), ["cluster_id", "dst"]).join(hosts, PARTITION_KEY)
    other = F.exists("rs", lambda x: (x["broker_id"] != F.col("src")) & (x["rack"] != "") & (x["rack"] == F.col("new_rack")))
    bad = d.groupBy("cluster_id").agg(
        F.count(F.when(F.array_contains("ids", F.col("dst")), 1)).alias("repeated_brokers"), F.count(F.when(other, 1)).alias("rack_clashes"),
        F.count(F.when(~F.array_contains("ids", F.col("src")), 1)).alias("foreign_sources"), F.count_distinct("tolerance").alias("moving_plans"))
    twice = mv.groupBy("cluster_id", "tolerance", "topic", "partition_id", "src").count().filter("count > 1").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("moved_twice"))
    change = mv.select("cluster_id", "tolerance", F.col("src").alias("broker_id"), F.col("size_bytes").alias("up"), F.lit(0).alias("down")).unionByName(
        mv.select("cluster_id", "tolerance", F.col("dst").alias("broker_id"), F.lit(0).alias("up"), F.col("size_bytes").alias("down")))
    change = change.groupBy("cluster_id", "tolerance", "broker_id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    # Means move only when a broker comes out of debt, so limits are held against the mean before and after.
    free = plan.brokers.join(change, ["cluster_id", "tolerance", "broker_id"], "left").withColumn("end", F.expr("free + coalesce(up, 0) - coalesce(down, 0)"))
    mean = free.groupBy("cluster_id", "tolerance").agg(
        F.avg(F.when(F.col("free") > 0, F.col("free"))).alias("m0"), F.avg(F.when(F.col("end") > 0, F.col("end"))).alias("m1"))
    held = free.join(mean, ["cluster_id", "tolerance"]).groupBy("cluster_id").agg(
        F.count(F.when((F.col("up") > 0) & (F.col("down") > 0), 1)).alias("both_roles"),
        F.count(F.when((F.col("up") > 0) & (F.col("end") > F.greatest("m0", "m1") * (1 + F.col("tolerance"))), 1)).alias("overfull_sources"),
        F.count(F.when((F.col("down") > 0) & (F.col("end") < F.least("m0", "m1") * (1 - F.col("tolerance"))), 1)).alias("drained_destinations"))
    left = plan.open_offers.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("open_moves"))
    start = A.storage_stats(st).select("cluster_id", F.col("storage_range").alias("start"))
    out = sc.join(start, "cluster_id").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("plans"), (F.max(F.col("storage_range") - F.col("start")) <= 0).alias("never_wider"))
    for part in (bad, twice, held, left):
        out = out.join(part, "cluster_id", "left")
    return out.select("cluster_id", "plans", "never_wider", *[F.coalesce(c, F.lit(0)).alias(c) for c in (
        "moving_plans", "repeated_brokers", "rack_clashes", "foreign_sources", "both_roles", "moved_twice", "overfull_sources", "drained_destinations", "open_moves")])


def moves_sql(tolerances, sources):
    """Promises, and ``moving_plans`` from the tables: tolerances at which some source may give one of its 30 largest partitions to some broker."""
    grid = ", ".join(str(x) for x in tolerances)
    return f"""
with st as (select cluster_id, broker_id, coalesce(rack, '') as rack, storage_free // 100000 * 1000 as free, is_missing or is_replace as closed, is_new from fx_plan_state),
means as (select cluster_id, count(*) / sum(1 / free::double) as h, avg(free) as m from st where free > 0 group by cluster_id),
src as ({sources}),
top as (select *, row_number() over (partition by cluster_id, broker_id order by size_bytes desc, partition_id, topic) as n
  from fx_replicas join fx_partition_size using (cluster_id, topic, partition_id) join src using (cluster_id, broker_id) where size_bytes >= 4194304),
sets as (select cluster_id, topic, partition_id, list(broker_id) as ids, list(rack) as racks, list(struct_pack(b := broker_id, r := rack)) as rs
  from fx_replicas join st using (cluster_id, broker_id) group by all),
give as (select t.cluster_id, t.broker_id as src, t.size_bytes, s.ids, list_transform(list_filter(s.rs, lambda x: x.b <> t.broker_id and x.r <> ''), lambda x: x.r) as racks,
    g.free from top t join sets s using (cluster_id, topic, partition_id) join st g using (cluster_id, broker_id) where n <= 30),
take as (select st.* from st where not closed and not exists (select 1 from src where src.cluster_id = st.cluster_id and src.broker_id = st.broker_id)),
-- The least tolerance at which a pair may move is where both limits hold.
pairs as (select g.cluster_id, g.size_bytes, g.free as s, d.free as f from give g join take d using (cluster_id)
  where not list_contains(g.ids, d.broker_id) and (d.rack = '' or not list_contains(g.racks, d.rack))),
moving as (select cluster_id, count(*) as n from (select distinct cluster_id, tol from pairs join means using (cluster_id), (select unnest([{grid}])::double as tol) t
  where size_bytes <= floor(m * (1 + tol) - s) and size_bytes <= floor(f - m * (1 - tol))) group by cluster_id)
select cluster_id, {len(tolerances)}::bigint as plans, true as never_wider, coalesce(n, 0)::bigint as moving_plans, 0::bigint as repeated_brokers,
       0::bigint as rack_clashes, 0::bigint as foreign_sources, 0::bigint as both_roles, 0::bigint as moved_twice, 0::bigint as overfull_sources,
       0::bigint as drained_destinations, 0::bigint as open_moves from fx_clusters left join moving using (cluster_id)"""


BELOW_MEAN = "select cluster_id, broker_id from st join means using (cluster_id) where (h - free) / h > 0.1"


def storage_state(t, factor=1000):
    return plan_state(t).withColumn("storage_free", F.expr(f"storage_free div 100000 * {factor}"))


@query("pln07_relocation_invariants", moves_sql([0.3], BELOW_MEAN))
def _(t):
    st = materialize(storage_state(t), "relocation-state")
    src = maps.offload_targets(st, threshold=0.1)
    return move_summary(t, st, relocation.relocate(t.replicas, t.partition_size, st, src, tolerances=[0.3], min_bytes=4 << 20))


@query("pln07_relocation_plan")
def _(t):
    st = materialize(storage_state(t), "relocation-state")
    src = maps.offload_targets(st, threshold=0.1)
    mv, _sc = relocation.plan_relocations(t.replicas, t.partition_size, st, src, tolerances=[0.3], min_bytes=4 << 20)
    return mv


@query("pln08_tolerance_sweep_invariants", moves_sql(relocation.TOLERANCES, BELOW_MEAN))
def _(t):
    st = materialize(storage_state(t), "relocation-state")
    src = maps.offload_targets(st, threshold=0.1)
    return move_summary(t, st, relocation.relocate(t.replicas, t.partition_size, st, src, min_bytes=4 << 20))


@query("pln09_offload_targets", """
with h as (select cluster_id, count(*) / sum(1 / storage_free::double) as h from fx_plan_state where storage_free > 0 group by cluster_id)
select 'fixed' as mode, cluster_id, broker_id from fx_plan_state where not is_new and storage_free < 50 * 1073741824::bigint
union all select 'below_hmean', s.cluster_id, broker_id from fx_plan_state s join h using (cluster_id) where (h - storage_free) / h > 0.2
union all select 'all', cluster_id, broker_id from fx_plan_state where not is_new""")
def _(t):
    s = plan_state(t)
    pick = lambda df, mode: df.select(F.lit(mode).alias("mode"), "cluster_id", "broker_id")
    return (pick(maps.offload_targets(s, threshold_gib=50.0), "fixed")
            .unionByName(pick(maps.offload_targets(s, threshold=0.2), "below_hmean"))
            .unionByName(pick(maps.offload_targets(s), "all")))


@query("pln10_scale_out_invariants", moves_sql([0.5], "select cluster_id, broker_id from st where not is_new"))
def _(t):
    st = materialize(storage_state(t), "relocation-state")
    return move_summary(t, st, relocation.relocate(t.replicas, t.partition_size, st, maps.offload_targets(st), tolerances=[0.5], min_bytes=4 << 20))


@query("pln10_scale_validation", """
select cluster_id, case when missing + old_missing + replace > 0 then 'reassignment only allows broker additions'
  when new = 0 then 'reassignment requires additional brokers' end as reason from fx_status where missing + old_missing + replace > 0 or new = 0""")
def _(t):
    return relocation.scale_errors(A.broker_status(merged(t)))


@query("pln11_apply_moves", "select cluster_id, topic, partition_id, idx, broker_id from fx_replicas_after")
def _(t):
    return maps.apply_moves(t.replicas, moves(t))


CHUNK_SQL = """
with k as (select cluster_id, broker_id, (row_number() over (partition by cluster_id order by broker_id desc) - 1) // 7 as chunk from fx_broker_meta),
s as (select b.cluster_id, b.topic, b.partition_id, b.idx, b.broker_id, a.broker_id as final, k.chunk
  from fx_replicas b join fx_replicas_after a using (cluster_id, topic, partition_id, idx) join k on k.cluster_id = b.cluster_id and k.broker_id = b.broker_id)"""


@query("pln12_chunk_changes", CHUNK_SQL + """
select s.cluster_id, s.topic, s.partition_id, x.at as chunk, idx, case when s.chunk <= x.at then final else broker_id end as broker_id
from s join (select distinct cluster_id, topic, partition_id, chunk as at from s where broker_id <> final) x using (cluster_id, topic, partition_id)""")
def _(t):
    return maps.chunk_changes(t.replicas, t.replicas_after, t.broker_meta, 7)


@query("pln12_chunked_maps", CHUNK_SQL.replace("// 7", "// (select greatest(1, count(*) // 3) from supplier)") + """
select s.cluster_id, s.topic, s.partition_id, x.at as chunk, idx, case when s.chunk <= x.at then final else broker_id end as broker_id
from s join (select distinct cluster_id, chunk as at from s where broker_id <> final) x using (cluster_id)""")
def _(t):
    return maps.chunked_maps(t.replicas, t.replicas_after, t.broker_meta, max(1, t.table("supplier").count() // 3))


@query("pln12_chunk_spans", CHUNK_SQL + """
select cluster_id, topic, partition_id, idx, -1 as from_chunk, case when broker_id <> final then chunk::int end as to_chunk, broker_id from s
union all select cluster_id, topic, partition_id, idx, chunk::int, null, final from s where broker_id <> final""")
def _(t):
    return maps.chunk_spans(t.replicas, t.replicas_after, t.broker_meta, 7)


@query("pln12_map_after_chunk", CHUNK_SQL + """
select cluster_id, topic, partition_id, idx, case when chunk <= 4 then final else broker_id end as broker_id from s""")
def _(t):
    return maps.map_at(maps.chunk_spans(t.replicas, t.replicas_after, t.broker_meta, 7), 4)


SPOILED_SQL = """
with after as (select * from fx_replicas_after where not (idx = 2 and broker_id % 5 = 0)),
k as (select cluster_id, broker_id, (row_number() over (partition by cluster_id order by broker_id desc) - 1) // 7 as chunk from fx_broker_meta where is_live = 1),
n as (select cluster_id, topic, partition_id, count(*) as n from fx_replicas group by all),
m as (select cluster_id, topic, partition_id, count(*) as m from after group by all),
resized as (select cluster_id, topic, partition_id from n left join m using (cluster_id, topic, partition_id) where n.n is distinct from m.m),
s as (select b.*, k.chunk, case when r.topic is null then a.broker_id else b.broker_id end as final
  from fx_replicas b left join after a using (cluster_id, topic, partition_id, idx) left join k on k.cluster_id = b.cluster_id and k.broker_id = b.broker_id
  left join resized r on r.cluster_id = b.cluster_id and r.topic = b.topic and r.partition_id = b.partition_id)
"""


def spoiled(t):
    """Final lists without some third replicas, and brokers that are not live left out of the list."""
    return t.replicas_after.filter("not (idx = 2 and broker_id % 5 = 0)"), t.broker_meta.filter("is_live = 1")


@query("pln12_chunk_errors", SPOILED_SQL + """
select cluster_id, topic, partition_id, null::int as idx, null::bigint as broker_id, 'replication factor changes' as error from resized
union all select cluster_id, topic, partition_id, idx, broker_id, 'broker not listed' from s where chunk is null and final <> broker_id""")
def _(t):
    after, listed = spoiled(t)
    return maps.chunk_errors(t.replicas, after, listed)


@query("pln12_spans_keep_every_slot", SPOILED_SQL + """
select cluster_id, topic, partition_id, idx, -1 as from_chunk, case when final <> broker_id then chunk::int end as to_chunk, broker_id from s
union all select cluster_id, topic, partition_id, idx, chunk::int, null, final from s where final <> broker_id and chunk is not null""")
def _(t):
    after, listed = spoiled(t)
    return maps.chunk_spans(t.replicas, after, listed, 7)


@query("pln13_phased_map", """
select cluster_id, topic, partition_id, array_to_string(case when list_contains(a.replicas, b.replicas[1]) then a.replicas else [b.replicas[1]] || a.replicas end, ',') as replicas
from fx_map_after a join fx_map b using (cluster_id, topic, partition_id)""")
def _(t):
    return maps.phased_map(t.partition_map, t.partition_map_after).withColumn("replicas", render(F.col("replicas")))


@query("pln14_evacuate_leadership", """
with m as (select *, list_filter(replicas, lambda b: b > 4)[1] as n, topic in ('t1', 't3') and replicas[1] <= 4 as due from fx_map)
select 'map' as kind, cluster_id, topic, partition_id, array_to_string(case when due and n is not null
   then list_transform(replicas, lambda b, i: case when i = 1 then n when b = n then replicas[1] else b end) else replicas end, ',') as replicas from m
union all select 'error', cluster_id, topic, partition_id, null from m where due and n is null""")
def _(t):
    out, bad = maps.evacuate_leadership(t.partition_map, [0, 1, 2, 3, 4], ["t1", "t3"])
    return out.select(F.lit("map").alias("kind"), *PARTITION_KEY, render(F.col("replicas")).alias("replicas")).unionByName(
        bad.withColumn("kind", F.lit("error")), allowMissingColumns=True)


@query("pln15_validate_plan", """
with h as (select r.cluster_id, r.topic, r.partition_id, r.broker_id, m.rack from fx_replicas_after r join fx_broker_meta m using (cluster_id, broker_id)),
g as (select cluster_id, topic, partition_id, count(case when rack <> '' then 1 end) as n, count(distinct case when rack <> '' then rack end) as racks from h group by all)
select cluster_id, 'zero_replicas' as kind, topic, partition_id, null::bigint as broker_id, null as detail from fx_map_after where partition_id % 100 = 1
union all select cluster_id, 'duplicate_broker', topic, partition_id, null, null from fx_map_after where partition_id % 100 = 2
union all select cluster_id, 'rack_violation', topic, partition_id, null, cast(racks as varchar) from g where partition_id % 100 <> 1 and racks < n
union all select distinct cluster_id, 'missing_rack', null, null::bigint, broker_id, null from h where rack = '' and partition_id % 100 <> 1
union all select cluster_id, 'storage_overflow', null, null, broker_id, cast(storage_free as varchar) from fx_meta_after where storage_free < 0
union all select cluster_id, 'range_increase', null, null, null, cast(a - b as varchar) from
  (select cluster_id, greatest(max(storage_free), 0) - min(storage_free) as a from fx_meta_after group by cluster_id) x join
  (select cluster_id, greatest(max(storage_free), 0) - min(storage_free) as b from fx_broker_meta group by cluster_id) y using (cluster_id) where a > b""")
def _(t):
    r, p = F.col("replicas"), F.col("partition_id") % 100
    spoiled = t.partition_map_after.withColumn(
        "replicas", F.when(p == 1, F.slice(r, 1, 0)).when(p == 2, F.concat(r, F.slice(r, 1, 1))).otherwise(r))
    return maps.validate_plan(spoiled, t.broker_meta, t.broker_meta, meta_after(t))


@query("udf01_predicates", """
with h as (select cluster_id, avg(case when storage_free > 0 then storage_free end) as m from fx_state group by cluster_id)
select s.cluster_id, s.broker_id from fx_state s join h using (cluster_id) where not is_replace and (storage_free - m) / m > 0.1""")
def _(t):
    from replicalens.operators.filters import filter_brokers, storage_means

    # A predicate is any callable from the state to a Column; this one closes over the cluster mean.
    s = state(t)
    s = s.join(storage_means(s).select("cluster_id", "mean"), "cluster_id")
    above = lambda df: ~F.col("is_replace") & ((F.col("storage_free") - F.col("mean")) / F.col("mean") > 0.1)
    return filter_brokers(s, above).select("cluster_id", "broker_id")


@query("udf02_options", """
select cluster_id, topic, partition_id, array_to_string(list_transform(range(1, 6), lambda i: coalesce(cast(replicas[i] as varchar), '-')), ',') as replicas from fx_map""")
def _(t):
    # Construction options are keyword parameters: here a replication factor applied while building a map.
    wide = to_partition_map(t.replicas)
    return wide.select(*PARTITION_KEY, render(set_replication(F.col("replicas"), 5)).alias("replicas"))
