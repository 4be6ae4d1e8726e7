"""Scale primitives of the planners: prefix sums and point location without one task per cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replicalens.session import materialize

BUCKET_DIGITS = 3


def hash_bucket(hash_col: Column, digits: int = BUCKET_DIGITS) -> Column:
    """Leading hex digits of an md5: buckets that are even whatever the key skew, and ordered like the hash."""
    return F.substring(hash_col, 1, digits)


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Exclusive running totals inside ``group``, ordered by (``bucket``, ``order``).

    A plain window over ``group`` would sort a whole cluster in one task. Here each (group, bucket)
    is its own window, and only bucket totals (one row per bucket) are accumulated per group.
    ``df`` is read twice, so pass a materialized table when it is expensive.
    """
    group, bucket = list(group), list(bucket)
    vals = df
    for name, value in sums.items():
        vals = vals.withColumn(f"__v_{name}", value)
    totals = vals.groupBy(*group, *bucket).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, *bucket,
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = vals.select(
        *df.columns,
        *[F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)).alias(f"__l_{n}") for n in sums],
    )
    return local.join(offsets, group + bucket).select(
        *df.columns, *[(F.col(f"__o_{n}") + F.col(f"__l_{n}")).alias(n) for n in sums]
    )


def locate(
    points: DataFrame,
    segments: DataFrame,
    group: Sequence[str],
    pos: str,
    start: str,
    end: str,
    width: str,
    keep: Sequence[str],
) -> DataFrame:
    """Attach to every point the segment [start, end) that holds its position, both per ``group``.

    The line is cut into cells of ``width`` (a column of both sides). A segment is repeated in every
    cell it reaches; inside a cell, points and segment starts are sorted together and the last start
    is carried forward. No pairs are formed, so dense cells cost a sort, not a product.
    """
    group, keep = list(group), list(keep)
    payload = [c for c in points.columns if c not in group]
    seg = (
        segments.filter(F.col(end) > F.col(start))
        .withColumn("__cell", F.explode(F.sequence(
            F.expr(f"{start} div {width}"), F.expr(f"({end} - 1) div {width}"))))
        .select(*group, "__cell", F.col(start).cast("bigint").alias("__pos"), F.lit(0).alias("__kind"),
                F.struct(*keep).alias("__seg"))
    )
    pts = points.select(
        *group, F.expr(f"{pos} div {width}").alias("__cell"), F.col(pos).cast("bigint").alias("__pos"),
        F.lit(1).alias("__kind"), F.struct(*payload).alias("__pt"))
    both = pts.unionByName(seg, allowMissingColumns=True)
    run = (Window.partitionBy(*group, "__cell").orderBy("__pos", "__kind")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        both.withColumn("__hit", F.last("__seg", ignorenulls=True).over(run))
        .filter(F.col("__kind") == 1)
        .select(*group, *[F.col(f"__pt.{c}").alias(c) for c in payload],
                *[F.col(f"__hit.{c}").alias(c) for c in keep])
    )


def since_reset(df: DataFrame, group: Sequence[str], order: str, reset: Column, counted: Column) -> DataFrame:
    """``df`` with ``n``, the ``counted`` rows after the last ``reset`` row up to this one, and ``seen``, whether there has been a reset, per ``group`` in ``order``.

    Rows are range-partitioned on (group, order) and counted within their partition; what a partition's last run leaves open is carried
    to the next partitions until one has a reset. So a group of any length is counted in many tasks, and one row per partition is carried.
    """
    group = list(group)
    marked = df.withColumns({"__reset": F.coalesce(reset, F.lit(False)).cast("int"), "__counted": F.coalesce(counted, F.lit(False)).cast("bigint")})
    rows = materialize(marked.repartitionByRange(*group, order).withColumn("__part", F.spark_partition_id()), "scan")
    inside = Window.partitionBy(*group, "__part").orderBy(order)
    rows = rows.withColumn("__run", F.sum("__reset").over(inside))
    rows = rows.withColumn("__n", F.sum("__counted").over(Window.partitionBy(*group, "__part", "__run").orderBy(order)))
    parts = rows.groupBy(*group, "__part").agg(F.max("__run").alias("resets"), F.max_by("__n", F.struct("__run", order)).alias("open"))
    by_part = Window.partitionBy(*group).orderBy("__part")
    parts = parts.withColumn("stretch", F.sum(F.sign("resets")).over(by_part))
    parts = parts.withColumn("carried", F.sum("open").over(Window.partitionBy(*group, "stretch").orderBy("__part")))
    parts = parts.select(*group, "__part", F.lag("carried", 1, 0).over(by_part).alias("__carry"), (F.lag("stretch", 1, 0.0).over(by_part) > 0).alias("__before"))
    return rows.join(parts, [*group, "__part"]).select(
        *df.columns, (F.col("__n") + F.when(F.col("__run") == 0, F.col("__carry")).otherwise(0)).alias("n"), ((F.col("__run") > 0) | F.col("__before")).alias("seen"))
