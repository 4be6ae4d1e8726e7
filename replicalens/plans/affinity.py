"""Substitution affinity: each outgoing broker gets exactly one new broker of its rack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.operators.joins import racks_available
from replicalens.operators.windows import ranked
from replicalens.schemas import BROKER_KEY, PARTITION_KEY
from replicalens.session import materialize


def _pair(leaving: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pair the n-th leaving broker of a rack with the n-th fresh one: (cluster_id, broker_id, substitute_id, rack)."""
    key = ["cluster_id", "rack"]
    a = ranked(leaving.select(*key, "broker_id"), key, [F.col("broker_id")])
    b = ranked(fresh.select(*key, F.col("broker_id").alias("substitute_id")), key, [F.col("substitute_id")])
    return materialize(a.join(b, [*key, "rank"]).select("cluster_id", "broker_id", "substitute_id", "rack"), "affinity")


def substitution_affinities(state: DataFrame, replicas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(affinities: cluster_id, broker_id, substitute_id, rack; errors: cluster_id, broker_id, reason).

    A missing broker's rack is unknown, so it may take any rack free in its replica sets: in rounds, each
    unpaired one asks its next free rack that still has fresh brokers. Then replaced brokers take what is
    left of their own rack. Clusters with fewer new than outgoing brokers only get an error row.
    """
    out_flag = F.col("is_replace") | F.col("is_missing")
    counts = state.groupBy("cluster_id").agg(
        F.count(F.when(out_flag, 1)).alias("leaving"), F.count(F.when(F.col("is_new") & ~out_flag, 1)).alias("fresh"))
    short = counts.filter("fresh < leaving").select("cluster_id")
    s = materialize(state.join(short, "cluster_id", "left_anti"), "affinity-state")
    missing, replaced = s.filter("is_missing"), s.filter("is_replace and not is_missing")
    fresh = s.filter(F.col("is_new") & ~out_flag)
    pairs = None
    choices = materialize(racks_available(replicas, s, missing), "affinity-choices")
    while True:
        left = choices if pairs is None else choices.join(pairs, BROKER_KEY, "left_anti")
        stock = fresh if pairs is None else fresh.join(
            pairs.select("cluster_id", F.col("substitute_id").alias("broker_id")), BROKER_KEY, "left_anti")
        ask = left.join(stock.select("cluster_id", "rack").distinct(), ["cluster_id", "rack"], "left_semi")
        ask = ask.groupBy(*BROKER_KEY).agg(F.min("rack").alias("rack"))
        if ask.isEmpty():
            break
        # Every round pairs at least one broker of every rack asked for, so the loop ends.
        new = _pair(ask, stock)
        pairs = new if pairs is None else pairs.unionByName(new)
    stock = fresh if pairs is None else fresh.join(
        pairs.select("cluster_id", F.col("substitute_id").alias("broker_id")), BROKER_KEY, "left_anti")
    own = _pair(replaced, stock)
    pairs = own if pairs is None else pairs.unionByName(own)
    unpaired = s.filter(out_flag).join(pairs, BROKER_KEY, "left_anti").select(
        *BROKER_KEY, F.when(F.col("is_missing"), "no replacement could be inferred")
        .otherwise("no free broker in the rack").alias("reason"))
    errors = unpaired.unionByName(short.select(
        "cluster_id", F.lit(None).cast("bigint").alias("broker_id"), F.lit("too few new brokers").alias("reason")))
    return pairs, errors


def apply_substitutions(replicas: DataFrame, affinities: DataFrame) -> DataFrame:
    a = affinities.select(*BROKER_KEY, "substitute_id")
    return replicas.join(a, BROKER_KEY, "left").select(
        *PARTITION_KEY, "idx", F.coalesce("substitute_id", "broker_id").alias("broker_id"))
