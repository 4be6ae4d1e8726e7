"""Tumbling windows over streams, kept as partial sums that merge: the windows don't depend on how rows are batched.

Every micro-batch writes its sums per window and key. A window is the sum of its parts, so a row counts whenever it comes; with a
``lateness``, rows older than that behind the newest row of earlier batches are not counted but written out as late. Every ``fold_every``
batches the parts so far are folded into one, so neither reading nor what must be kept grows with the number of batches. A batch that is run again
writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replicalens.streaming.jobs import emitted, run_available


def _parts(rows: DataFrame, span: str, key: list[str], sums: dict[str, Column]) -> DataFrame:
    return rows.groupBy(F.window("ts", span).getField("start").alias("window_start"), *key).agg(
        *[F.sum(c).alias(f"{n}_sum") for n, c in sums.items()], *[F.count(c).alias(f"{n}_n") for n, c in sums.items()], F.max("ts").alias("newest"))


def _merged(parts: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    return parts.groupBy("window_start", *key).agg(
        *[F.sum(f"{n}_{x}").alias(f"{n}_{x}") for x in ("sum", "n") for n in names], F.max("newest").alias("newest"))


def _current(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """Parts since the last fold, of batches before ``before``."""
    rows = emitted(spark, path, schema)
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    fold = rows.filter("folded").agg(F.max("batch_id")).first()[0]
    return rows if fold is None else rows.filter(F.col("batch_id") >= fold)


def window_sums_stream(points: DataFrame, path: str, span: str, key: list[str], sums: dict[str, Column], lateness: str | None = None, fold_every: int = 32) -> None:
    """Write the sums and counts of ``sums`` per ``span`` of ``ts`` and ``key`` to ``path``, and late rows to ``path``-late. Rows without ``ts`` are no rows."""
    spark = points.sparkSession
    schema = _parts(spark.createDataFrame([], points.schema), span, key, sums).withColumn("folded", F.lit(False)).schema

    def step(df: DataFrame, batch_id: int) -> None:
        rows, past = df.filter("ts is not null"), _current(spark, path, schema, batch_id)
        if lateness is not None:
            newest = F.timestamp_micros(F.lit(past.agg(F.max(F.unix_micros("newest"))).first()[0]).cast("long"))
            is_late = F.coalesce(F.col("ts") < newest - F.expr(f"interval {lateness}"), F.lit(False))
            rows.filter(is_late).write.mode("overwrite").parquet(f"{path}-late/batch_id={batch_id}")
            rows = rows.filter(~is_late)
        parts, fold = _parts(rows, span, key, sums), batch_id > 0 and batch_id % fold_every == 0
        if fold:
            parts = _merged(past.select(*parts.columns).unionByName(parts), key, list(sums))
        parts.withColumn("folded", F.lit(fold)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_available(points, path, "append", step)


def window_sums(points: DataFrame, path: str, span: str, key: list[str], sums: dict[str, Column]) -> DataFrame:
    """What ``window_sums_stream`` has counted so far: window_start, key, and ``_sum`` and ``_n`` of every name. ``points`` gives types only."""
    spark = points.sparkSession
    schema = _parts(spark.createDataFrame([], points.schema), span, key, sums).withColumn("folded", F.lit(False)).schema
    return _merged(_current(spark, path, schema), key, list(sums)).drop("newest")


def late_rows(points: DataFrame, path: str) -> DataFrame:
    """Rows that came too late to be counted."""
    return emitted(points.sparkSession, f"{path}-late", points.schema).select(*points.columns)


def network_sums() -> dict[str, Column]:
    """Bytes sent and received, of points (ts, host, direction, value)."""
    return {d: F.when(F.col("direction") == d, F.col("value")) for d in ("tx", "rx")}


def network_averages(sums: DataFrame) -> DataFrame:
    """Mean of transmitted and received bytes per window and host, in MiB/s, from ``window_sums`` of ``network_sums``. Exact for integer byte counts."""
    mean = lambda d: (F.col(f"{d}_sum").cast("double") / F.nullif(F.col(f"{d}_n"), F.lit(0)) / (1 << 20)).alias(f"net_{d}")
    return sums.select("window_start", "host", mean("tx"), mean("rx"))


def rolled_values(sums: DataFrame, series: list[str]) -> DataFrame:
    """Mean value of every series per window, from ``window_sums`` of ``value``."""
    return sums.select(*series, F.col("window_start").alias("ts"), (F.col("value_sum") / F.nullif(F.col("value_n"), F.lit(0))).alias("value"))
