"""Leadership balance without moving data: replica lists are reordered, never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.plans.lines import hash_bucket, prefix_sums
from replicalens.schemas import BROKER_KEY, PARTITION_KEY
from replicalens.session import materialize


def _targets(counts: DataFrame) -> DataFrame:
    """``counts`` (cluster_id, broker_id, leaders, held) with whole leaders above (surplus) and below (deficit) the common ratio."""
    c = counts.groupBy("cluster_id").agg(F.sum("leaders").alias("all_leaders"), F.sum("held").alias("all_held"))
    part = F.expr("(cast(all_leaders as decimal(38,0)) * held) div all_held")
    exact = F.expr("(cast(all_leaders as decimal(38,0)) * held) % all_held = 0")
    return counts.join(c, "cluster_id").select(
        *BROKER_KEY, "leaders", "held",
        F.greatest(F.lit(0).cast("bigint"), F.col("leaders") - part - F.when(exact, 0).otherwise(1)).alias("surplus"),
        F.greatest(F.lit(0).cast("bigint"), part - F.col("leaders")).alias("deficit"))


def leader_targets(partition_map: DataFrame) -> DataFrame:
    """Per broker: leaders now, and the leaders it would have at the cluster's common leader/replica ratio.
    ``surplus``/``deficit`` are whole leaders above/below, so handing over within both never widens a gap."""
    r = partition_map.select("cluster_id", F.posexplode("replicas").alias("idx", "broker_id"))
    return _targets(r.groupBy(*BROKER_KEY).agg(F.count(F.when(F.col("idx") == 0, 1)).alias("leaders"), F.count(F.lit(1)).alias("held")))


def hand_overs(partition_map: DataFrame, targets: DataFrame) -> DataFrame:
    """Followers with a deficit in partitions led by a broker with a surplus: (.., from, to, surplus, deficit)."""
    give = targets.filter("surplus > 0").select("cluster_id", F.col("broker_id").alias("from"), "surplus")
    take = targets.filter("deficit > 0").select("cluster_id", F.col("broker_id").alias("to"), "deficit")
    led = partition_map.select(*PARTITION_KEY, F.col("replicas")[0].alias("from"), "replicas").join(give, ["cluster_id", "from"])
    return led.select(*PARTITION_KEY, "from", "surplus", F.explode(F.slice("replicas", 2, F.size("replicas"))).alias("to")).join(
        take, ["cluster_id", "to"])


def balance_leaders(partition_map: DataFrame) -> DataFrame:
    """Hand leadership from brokers above their share to followers below theirs.

    A round proposes, for every partition led by a broker with surplus, one follower with a deficit,
    drawn with a weight of its deficit. Proposals are accepted up to the surplus of the giver and the
    deficit of the taker, by two-level ranks. Each round with a proposal accepts one at least and lowers the
    total surplus, and rounds go on until there is none.

    A giver never has a deficit again and a taker never a surplus, so a partition changes hands once at most: rounds
    carry the accepted hand-overs and the options still open, and the map is read at the start and at the end only.
    """
    current = materialize(partition_map, "leaders")
    t = materialize(leader_targets(current), "leader-targets")
    options = materialize(hand_overs(current, t).drop("surplus", "deficit"), "leader-options")
    accepted = None
    while True:
        give = t.filter("surplus > 0").select("cluster_id", F.col("broker_id").alias("from"), "surplus")
        take = t.filter("deficit > 0").select("cluster_id", F.col("broker_id").alias("to"), "deficit")
        u = (F.pmod(F.xxhash64(*PARTITION_KEY, "to"), F.lit(1000000)) + 1) / 1000001
        best = options.join(give, ["cluster_id", "from"]).join(take, ["cluster_id", "to"]).groupBy(*PARTITION_KEY).agg(
            F.min_by(F.struct("from", "to", "surplus", "deficit"), F.struct(-F.log(u) / F.col("deficit"), F.col("to"))).alias("p"))
        h = F.md5(F.concat_ws(":", "topic", F.col("partition_id").cast("string")))
        best = materialize(best.select(*PARTITION_KEY, "p.*", h.alias("h")).withColumn("hb", hash_bucket(F.col("h"))), "leader-asks")
        order = ["h", "topic", "partition_id"]
        given = materialize(prefix_sums(best, ["cluster_id", "from"], ["hb"], order, {"gr": F.lit(1)}).filter("gr < surplus"), "leader-gives")
        moves = prefix_sums(given, ["cluster_id", "to"], ["hb"], order, {"tr": F.lit(1)}).filter("tr < deficit")
        moves = materialize(moves.select(*PARTITION_KEY, "from", "to"), "leader-moves")
        if moves.isEmpty():
            break
        accepted = moves if accepted is None else accepted.unionByName(moves)
        shift = moves.select("cluster_id", F.explode(F.array(
            F.struct(F.col("from").alias("broker_id"), F.lit(-1).alias("s")), F.struct(F.col("to").alias("broker_id"), F.lit(1).alias("s")))).alias("x"))
        shift = shift.groupBy("cluster_id", F.col("x.broker_id").alias("broker_id")).agg(F.sum("x.s").alias("s"))
        counts = t.join(shift, BROKER_KEY, "left").select(
            *BROKER_KEY, (F.col("leaders") + F.coalesce("s", F.lit(0))).alias("leaders"), "held")
        t = materialize(_targets(counts), "leader-targets")
        options = materialize(options.join(moves.select(*PARTITION_KEY), PARTITION_KEY, "left_anti"), "leader-options")
    if accepted is None:
        return current
    r = F.col("replicas")
    swapped = F.transform(r, lambda b, i: F.when(i == 0, F.col("to")).when(b == F.col("to"), r[0]).otherwise(b))
    return current.join(accepted.select(*PARTITION_KEY, "to"), PARTITION_KEY, "left").select(
        *PARTITION_KEY, F.when(F.col("to").isNull(), r).otherwise(swapped).alias("replicas"))


def leader_spread(partition_map: DataFrame) -> DataFrame:
    """Total distance of the brokers' leader counts from their share, per cluster."""
    return leader_targets(partition_map).groupBy("cluster_id").agg(
        F.sum(F.col("surplus") + F.col("deficit")).alias("spread"))
