"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.session import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``, label being the smallest node of its component.

    Alternating large-star and small-star rounds: links move to ever smaller neighbours until each component is a
    star around its smallest node, in a number of rounds that grows with the logarithm of its size. Minima combine
    before the shuffle, so a hub is one row per task; joins on a hub are left to adaptive skew splitting. Each
    round ends in a written table. Self-links and nulls are ignored; an empty table gives no rows.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.select("u", F.col("m").alias("v")).unionAll(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(edges.distinct(), "stars")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionAll(stars.select(F.col("label").alias("node"), "label").distinct())
