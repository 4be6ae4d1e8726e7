"""Column functions over ordered replica lists, and the two forms of a partition map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicalens.schemas import PARTITION_KEY


def to_partition_map(replicas: DataFrame, key: list[str] = PARTITION_KEY, broker: str = "broker_id",
                     out: str = "replicas") -> DataFrame:
    """Exploded rows (.., idx, broker) to one row per partition with the ordered id list.

    A list holds each broker of a partition once, so its length is the replication factor.
    """
    return replicas.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(broker).alias("b")))),
                    lambda x: x["b"]).alias(out))


def to_replicas(partition_map: DataFrame, column: str = "replicas") -> DataFrame:
    """One row per partition to exploded rows (.., idx, broker_id)."""
    rest = [c for c in partition_map.columns if c != column]
    return partition_map.select(*rest, F.posexplode(column).alias("idx", "broker_id"))


def is_leader(idx: Column) -> Column:
    return idx == 0


def role_of(idx: Column) -> Column:
    """Position 0 leads, every other position follows."""
    return F.when(is_leader(idx), "leader").otherwise("follower")


def set_replication(replicas: Column, factor: int) -> Column:
    """Cut to ``factor`` positions, or pad with open slots (null); 0 leaves the list as it is."""
    if factor < 0:
        raise ValueError("replication factor must not be negative")
    if factor == 0:
        return replicas
    gap = F.greatest(F.lit(factor) - F.size(replicas), F.lit(0))
    return F.slice(F.concat(replicas, F.array_repeat(F.lit(None).cast("bigint"), gap)), 1, factor)


def strip(replicas: Column) -> Column:
    """Open every slot, keeping the list length."""
    return F.transform(replicas, lambda _: F.lit(None).cast("bigint"))


def populate(topics: DataFrame, partitions: Column, replication: Column) -> DataFrame:
    """Empty partition rows for (.., topic): ids 0..n-1, each with ``replication`` open slots."""
    return topics.select(
        *topics.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), partitions.cast("bigint") - 1)).alias("partition_id"),
        F.array_repeat(F.lit(None).cast("bigint"), replication.cast("int")).alias("replicas"))


def what_changed(before: Column, after: Column) -> Column:
    """Label of a before/after pair of replica lists.

    A length change is named first; the shared prefix is then compared in order, and once more sorted:
    same brokers in another order is a leadership change, other brokers are a replacement.
    """
    shared = F.least(F.size(before), F.size(after))
    a, b = F.slice(before, 1, shared), F.slice(after, 1, shared)
    length = (F.when(F.size(before) > F.size(after), "decreased replication")
              .when(F.size(before) < F.size(after), "increased replication"))
    content = F.when(a != b, F.when(F.array_sort(a) == F.array_sort(b), "preferred leader")
                     .otherwise("replaced broker"))
    label = F.concat_ws(", ", length, content)
    return F.when(label == "", "no-op").otherwise(label)


def reassignment_target(current: Column, adding: Column, removing: Column) -> Column:
    """Replicas a partition will have once its pending change is done; null if none is pending."""
    none = F.array().cast("array<bigint>")
    adding, removing = F.coalesce(adding, none), F.coalesce(removing, none)
    kept = F.filter(current, lambda x: ~F.array_contains(removing, x))
    return F.when((F.size(adding) > 0) | (F.size(removing) > 0), kept)


def holds(replicas: Column, broker: Column) -> Column:
    return F.array_contains(replicas, broker)


def parse_broker_ids(text: Column) -> Column:
    """Comma list of ids: trimmed, deduplicated in first-seen order; null if any entry is no integer."""
    ids = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("bigint"))
    return F.when(~F.exists(ids, lambda x: x.isNull()), F.array_distinct(ids))


def render(values: Column, sep: str = ",") -> Column:
    """Text form of a list, open slots as ``-``."""
    return F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), sep)


def replica_set_key(replicas: Column) -> Column:
    return F.array_sort(F.array_distinct(replicas))
