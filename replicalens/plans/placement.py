"""Full placement of a map on a line.

Per cluster, partitions ordered by md5 occupy consecutive stretches of their size; slot k of a partition
sits at the same place k lengths further on. Brokers, grouped by rack, own segments proportional to their
capacity. Slots of one partition are exactly one length apart, so a rack owning at most one length never
holds two of them. Racks above that share are cut to it and the rest is shared out among the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replicalens.operators.windows import top_k
from replicalens.plans.lines import hash_bucket, locate, prefix_sums
from replicalens.plans.repair import _NO_BROKER, fill, within_room
from replicalens.schemas import PARTITION_KEY
from replicalens.session import materialize

# Slots per cell of the line, and the most cells per cluster.
SLOTS_PER_CELL = 2000
MAX_CELLS = 1 << 20


def _big(c):
    return F.col(c).cast("decimal(38,0)")


def broker_groups(brokers: DataFrame, rf: int, min_racks: int) -> DataFrame:
    """Brokers with capacity, separation group and feasibility.

    The group is the rack; a broker without rack is its own group. With fewer groups than ``rf`` racks
    cannot be kept apart: if ``min_racks`` allows reuse every broker is its own group, else the cluster
    cannot be placed.
    """
    own = F.concat(F.lit("#"), F.col("broker_id").cast("string"))
    brokers = brokers.withColumn("rack", F.coalesce("rack", F.lit("")))
    b = brokers.select("cluster_id", "broker_id", "rack", F.greatest(F.col("capacity"), F.lit(1)).cast("bigint").alias("c"),
                       F.when(F.col("rack") == "", own).otherwise(F.col("rack")).alias("grp"))
    n = b.select("cluster_id", "grp").distinct().groupBy("cluster_id").agg(F.count(F.lit(1)).alias("groups"))
    m = b.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("brokers"))
    racks = b.filter("rack <> ''").select("cluster_id", "rack").distinct().groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("racks"))
    f = n.join(m, "cluster_id").join(racks, "cluster_id", "left")
    apart = F.col("groups") >= rf
    reuse = (F.lit(min_racks) > 0) & (F.col("brokers") >= rf) & (F.coalesce("racks", F.lit(0)) >= min_racks)
    f = f.select("cluster_id", apart.alias("apart"), (apart | reuse).alias("feasible"))
    # Single brokers share one lane: only racks must be contiguous on the line, so lanes are as few as racks.
    single = ~F.col("apart") | (F.col("rack") == "")
    return b.join(f, "cluster_id").withColumns({
        "grp": F.when(F.col("apart"), F.col("grp")).otherwise(own),
        "lane": F.when(single, F.lit("")).otherwise(F.col("rack"))}).drop("apart")


def broker_segments(groups: DataFrame, line: DataFrame, rf: int) -> DataFrame:
    """Segments [seg_start, seg_end) of the brokers on a line of 2·rf·Z units (``line``: cluster_id, z_total, width).

    At most rf-1 groups can exceed a share of 1/rf, so the rf largest groups decide which ones are cut.
    Boundaries are floors of exact fractions, so a group's segment never exceeds 2·Z.
    """
    feasible = groups.filter("feasible")
    per_group = feasible.groupBy("cluster_id", "grp").agg(F.sum("c").alias("cg"))
    total = per_group.groupBy("cluster_id").agg(F.sum("cg").alias("ct"))
    big = top_k(per_group, ["cluster_id"], [F.col("cg").desc(), F.col("grp")], rf, "rn")
    w = Window.partitionBy("cluster_id").orderBy("rn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.col("ct") - F.coalesce(F.sum("cg").over(before), F.lit(0))
    cut = (big.join(total, "cluster_id")
           .withColumn("over", (_big("cg") * (F.lit(rf + 1) - F.col("rn")) > rest).cast("int"))
           .withColumn("cut", F.min("over").over(upto)).filter("cut = 1")
           .select("cluster_id", "grp", F.col("rn").alias("cut_rank"), "cg"))
    cut_sum = cut.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m"), F.sum("cg").alias("cs"))
    base = total.join(cut_sum, "cluster_id", "left").select(
        "cluster_id", F.coalesce("m", F.lit(0)).alias("m"), (F.col("ct") - F.coalesce("cs", F.lit(0))).alias("free_c"))
    h = F.md5(F.col("broker_id").cast("string"))
    placed = (feasible.join(cut, ["cluster_id", "grp"], "left").join(base, "cluster_id").join(line, "cluster_id")
              .withColumn("h", h).withColumn("hb", hash_bucket(h, 2)))
    placed = materialize(placed, "segments")
    one = prefix_sums(placed.filter("cut_rank is not null"), ["cluster_id", "grp"], ["hb"], ["h", "broker_id"], {"cum": F.col("c")})
    many = prefix_sums(placed.filter("cut_rank is null"), ["cluster_id"], ["lane", "hb"], ["h", "broker_id"], {"cum": F.col("c")})
    z2 = "cast(2 as decimal(38,0)) * z_total"
    one = one.select("cluster_id", "broker_id", "rack", "width",
                     F.expr(f"2 * z_total * (cut_rank - 1) + ({z2} * cum) div cg").alias("seg_start"),
                     F.expr(f"2 * z_total * (cut_rank - 1) + ({z2} * (cum + c)) div cg").alias("seg_end"))
    many = many.select("cluster_id", "broker_id", "rack", "width",
                       F.expr(f"2 * z_total * m + ({z2} * ({rf} - m) * cum) div free_c").alias("seg_start"),
                       F.expr(f"2 * z_total * m + ({z2} * ({rf} - m) * (cum + c)) div free_c").alias("seg_end"))
    return one.unionByName(many)


def place(partitions: DataFrame, brokers: DataFrame, rf: int, *, strategy: str = "count",
          optimization: str = "distribution", size_factor: float = 1.0, min_racks: int = 0
          ) -> tuple[DataFrame, DataFrame]:
    """Place every replica of ``partitions`` (.., size_bytes for storage) on ``brokers`` (cluster_id, broker_id,
    rack, storage_free). Returns (replica rows, error rows).

    ``count`` gives every broker an equal share, ``storage`` a share by free storage. Under ``storage``, ``optimization`` says what is evened
    out: ``distribution`` lays all partitions on one line, so a broker's bytes fit its share, of whatever sizes; ``storage`` lays each
    size class (a doubling of size) over all brokers by itself, so each broker gets its share of the largest partitions too, and the
    largest are the first to get room. Replica order is rotated by the partition's ordinal, which spreads leaders evenly under both. Under ``storage`` a
    broker never holds more than its free storage: what it turns away goes to brokers with room, and a slot that no
    allowed broker can hold is one error row.
    """
    if strategy not in ("count", "storage"):
        raise ValueError(f"unknown placement strategy: {strategy}")
    if optimization not in ("distribution", "storage"):
        raise ValueError(f"unknown optimization of placement: {optimization}")
    if rf < 1:
        raise ValueError("replication factor must be positive")
    z = F.lit(1).cast("bigint") if strategy == "count" else F.greatest(
        F.ceil(F.col("size_bytes") * F.lit(size_factor)), F.lit(1)).cast("bigint")
    cap = F.lit(1).cast("bigint") if strategy == "count" else F.col("storage_free")
    h = F.md5(F.concat_ws(":", "topic", F.col("partition_id").cast("string")))
    unsized = partitions.filter(F.col("size_bytes").isNull() if strategy == "storage" else F.lit(False)).select(
        *PARTITION_KEY, F.lit("partition size not found").alias("error"))
    if strategy == "storage":
        partitions = partitions.filter("size_bytes is not null")
    layered = strategy == "storage" and optimization == "storage"
    klass = F.length(F.bin(z)) if layered else F.lit(0)
    bucket = lambda c: F.concat(F.lpad((64 - c).cast("string"), 2, "0"), hash_bucket(h)) if layered else hash_bucket(h)
    # As bytes, half as long as its digits and in the same order.
    parts = materialize(partitions.select(*PARTITION_KEY, z.alias("z"), F.unhex(h).alias("h"), klass.alias("class"), bucket(klass).alias("hb")), "placement-parts")
    groups = materialize(broker_groups(brokers.withColumn("capacity", cap), rf, min_racks), "placement-groups")
    line = parts.groupBy("cluster_id").agg(F.sum("z").alias("z_total"), F.count(F.lit(1)).alias("n"))
    cells = f"greatest(1, least({MAX_CELLS}, n * {rf} div {SLOTS_PER_CELL}))"
    line = line.select("cluster_id", "z_total", F.expr(f"greatest(1, (2 * {rf} * z_total) div {cells})").alias("width"))
    laid = prefix_sums(parts, ["cluster_id"], ["hb"], ["h", "topic", "partition_id"], {"at": F.col("z"), "ordinal": F.lit(1)})
    ok = groups.filter("feasible").select("cluster_id").distinct()
    # A class of its own length is stretched over the whole line; without classes this is the line itself.
    larger = Window.partitionBy("cluster_id").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = parts.groupBy("cluster_id", "class").agg(F.sum("z").alias("z_class")).withColumn("z_larger", F.coalesce(F.sum("z_class").over(larger), F.lit(0)))
    laid = laid.join(classes, ["cluster_id", "class"])
    slots = (laid.join(ok, "cluster_id", "left_semi").join(line, "cluster_id")
             .select(*PARTITION_KEY, "ordinal", "z", "at", "z_total", "z_class", "z_larger", "width",
                     F.explode(F.sequence(F.lit(0), F.lit(rf - 1))).alias("k"))
             .withColumn("pos", F.expr("cast((cast(2 * (at - z_larger) + z as decimal(38,0)) * z_total) div z_class as bigint) + 2 * k * z_total"))
             .select(*PARTITION_KEY, "ordinal", "z", "k", "pos", "width"))
    hit = locate(slots, broker_segments(groups, line, rf), ["cluster_id"], "pos", "seg_start", "seg_end", "width", ["broker_id"])
    placed = hit.select(*PARTITION_KEY, F.pmod(F.col("k") + F.col("ordinal"), F.lit(rf)).cast("int").alias("idx"), "broker_id", "z")
    errors = parts.join(ok, "cluster_id", "left_anti").select(*PARTITION_KEY, F.lit(_NO_BROKER).alias("error")).unionByName(unsized)
    if strategy == "count":
        return placed.drop("z"), errors
    # Sizes go along the line with their slots; only where a key comes twice do its slots meet the sizes of all its rows. The md5 order
    # follows from key and size, so it is not written.
    slot = [*PARTITION_KEY, "idx", "broker_id"]
    if parts.groupBy(*PARTITION_KEY).count().filter("count > 1").isEmpty():
        sized = placed.filter(" and ".join(f"{c} is not null" for c in PARTITION_KEY))
    else:
        sized = placed.drop("z").join(parts.select(*PARTITION_KEY, "z"), PARTITION_KEY)
    klass = F.length(F.bin("z")) if layered else F.lit(0)
    sized = materialize(sized.select(*slot, "z"), "placement-laid").withColumns({"h": h, "hb": bucket(klass)})
    room = brokers.select("cluster_id", "broker_id", "rack", F.col("storage_free").cast("bigint").alias("free"))
    fits, away = within_room(sized, room)
    spent = fits.groupBy("cluster_id", "broker_id").agg(F.sum("z").alias("spent"))
    room = room.join(spent, ["cluster_id", "broker_id"], "left").withColumn("free", F.col("free") - F.coalesce("spent", F.lit(0)))
    placed = fits.select(*slot)
    more, left = fill(placed, away.select(*PARTITION_KEY, "idx", "z", "h", "hb"), room.drop("spent"), min_racks)
    return placed.unionByName(more), errors.unionByName(left.select(*PARTITION_KEY, F.lit(_NO_BROKER).alias("error")))
