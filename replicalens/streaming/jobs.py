"""Structured Streaming jobs. Every job takes a streaming DataFrame, so any source works; results go to a
table in the shared folder, one directory per micro-batch, which makes retried batches idempotent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from replicalens.operators.throttle import APPLIED_SCHEMA, Limits, next_rate, topics_done
from replicalens.session import scratch_path


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over parquet files matching ``path``, typed like the files there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, path: str, mode: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there now and stop. Each micro-batch becomes ``path/batch_id=N``."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state")
         .trigger(availableNow=True).foreachBatch(on_batch or write).start())
    try:
        q.awaitTermination()
    finally:
        q.stop()


def emitted(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows a job has written, with their batch_id; empty if it has written none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0))


def latest_per_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """State after the last update of every key of an update-mode job."""
    rest = [c for c in rows.columns if c not in key and c != "batch_id"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("s")).select(*key, *[f"s.{c}" for c in rest])


def run_update(stream: DataFrame, key: list[str], name: str) -> DataFrame:
    """Run an update-mode aggregation over what is there and return its final rows."""
    path = scratch_path(stream.sparkSession, name)
    run_available(stream, path, "update")
    return latest_per_key(emitted(stream.sparkSession, path, stream.schema), key)


def latest_checkpoints_stream(checkpoints: DataFrame) -> DataFrame:
    """Running last checkpoint per (group, topic, partition), for update mode."""
    last = F.max_by(F.struct("upstream_offset", "local_offset"), F.col("log_offset"))
    return checkpoints.groupBy("group_id", "topic", "partition_id").agg(last.alias("c")).select(
        "group_id", "topic", "partition_id", "c.upstream_offset", "c.local_offset")


def applied_rates_stream(ticks: DataFrame, limits: Limits, threshold: float) -> DataFrame:
    """Streaming form of ``applied_rates``: the applied rate of a key lives in the state store. Rows of a
    micro-batch are folded in tick order; a key has one row per tick, whatever the volume of points."""
    shares = {"leader": limits.source_max, "follower": limits.destination_max}
    minimum = limits.minimum

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("tick")
        out = []
        for r in rows.itertuples(index=False):
            if r.reset:
                current = 0.0
            rate, apply = next_rate(current, r.util, r.capacity_mb, shares[key[2]], minimum, threshold)
            if apply:
                current = rate
            out.append((*key, r.tick, rate, apply, current))
        state.update((current,))
        yield pd.DataFrame(out, columns=["cluster_id", "broker_id", "role", "tick", "rate", "applied", "current"])

    return ticks.groupBy("cluster_id", "broker_id", "role").applyInPandasWithState(
        fold, APPLIED_SCHEMA, "current double", "append", GroupStateTimeout.NoTimeout)


MODE_SCHEMA = "cluster_id string, tick timestamp, failures bigint, mode string"


def failure_modes_stream(ticks: DataFrame, threshold: int) -> DataFrame:
    """Streaming form of ``failure_modes``: the failure count of a cluster lives in the state store."""
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        out = []
        for r in pd.concat(list(batches)).sort_values("tick").itertuples(index=False):
            failures = 0 if r.complete else failures + 1
            mode = "computed" if r.complete else "minimum" if failures > threshold else "retain"
            out.append((key[0], r.tick, failures, mode))
        state.update((failures,))
        yield pd.DataFrame(out, columns=["cluster_id", "tick", "failures", "mode"])

    return ticks.groupBy("cluster_id").applyInPandasWithState(
        fold, MODE_SCHEMA, "failures bigint", "append", GroupStateTimeout.NoTimeout)


def append_events(rates: DataFrame, path: str) -> None:
    """Append a throttle-change event for every applied rate of a stream of rate decisions."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.filter("applied").select("cluster_id", "broker_id", "role", "tick", "rate").write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}")

    run_available(rates, path, "append", write)


def topics_done_stream(snapshots: DataFrame, path: str) -> None:
    """Write the topics that leave the reassigning set, as (cluster_id, snapshot_ts, topic).

    ``snapshots``: one row per topic of a snapshot, and a row with a null topic for a snapshot, or tick, that may be empty. Each micro-batch is
    compared with the newest snapshot of every cluster before it by the batch operator, so sets of any size stay distributed. That state is one table
    of the newest sets, written anew by each batch: a batch reads its predecessor's alone. Snapshots must arrive whole and in time order.
    """
    spark, seen = snapshots.sparkSession, f"{path}-last"

    def step(df: DataFrame, batch_id: int) -> None:
        last = spark.read.schema(df.schema).parquet(f"{seen}/batch_id={batch_id - 1}") if batch_id else spark.createDataFrame([], df.schema)
        both = last.select(*df.columns).unionByName(df).distinct()
        ticks = both.select("cluster_id", "snapshot_ts").distinct()
        topics_done(both.filter("topic is not null"), ["cluster_id"], ticks).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        newest = both.join(ticks.groupBy("cluster_id").agg(F.max("snapshot_ts").alias("snapshot_ts")), ["cluster_id", "snapshot_ts"])
        newest.select(*df.columns).write.mode("overwrite").parquet(f"{seen}/batch_id={batch_id}")

    run_available(snapshots, path, "append", step)
