"""Readers of the inventory documents: partition maps, metrics, metadata, states, configs, tags, overrides.

Each reader has a column form (``parse_*``: rows holding document text) and, where documents live in
files, a file form (``read_*``). Gzip files are read through the codec of their suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replicalens.schemas import (
    BROKER_DOCUMENT,
    MAP_DOCUMENT,
    OVERRIDE_DOCUMENT,
    SIZE_DOCUMENT,
    STATE_DOCUMENT,
    STORAGE_DOCUMENT,
    STRING_MAP,
    TOPIC_METADATA_DOCUMENT,
)

STRICT = {"mode": "FAILFAST"}


def _not_empty(doc: Column) -> Column:
    """The document, or an error for an empty one."""
    return F.when(F.trim(doc).isin("", "{}"), F.raise_error(F.lit("empty document"))).otherwise(doc)


def read_text_documents(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One document per line, or per file; partition folders become columns."""
    return spark.read.option("wholetext", whole_files).text(path).withColumnRenamed("value", "doc")


def parse_maps(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Partition maps: (.., topic, partition_id, replicas). A malformed document is an error."""
    rest = [c for c in docs.columns if c not in (doc, "topic")]
    return docs.select(*rest, F.explode(F.from_json(F.col(doc), MAP_DOCUMENT, STRICT)["partitions"]).alias("p")).select(
        *rest, "p.topic", F.col("p.partition").alias("partition_id"), "p.replicas")


def read_maps(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Partition maps from JSON files, one document per file or per line."""
    docs = spark.read.schema(MAP_DOCUMENT).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    return docs.select(F.explode("partitions").alias("p")).select(
        "p.topic", F.col("p.partition").alias("partition_id"), "p.replicas")


def flatten_topic_states(states: DataFrame) -> DataFrame:
    """Topic-state snapshots (.., topic, partitions: array of struct) to partition rows."""
    rest = [c for c in states.columns if c != "partitions"]
    return states.select(*rest, F.explode("partitions").alias("p")).select(*rest, "p.*")


def parse_broker_documents(docs: DataFrame) -> DataFrame:
    """(.., id text, doc) to broker rows; ids that are no integers and bad documents are skipped."""
    rest = [c for c in docs.columns if c not in ("id", "doc")]
    d = F.from_json("doc", BROKER_DOCUMENT)
    return (docs.select(*rest, F.col("id").try_cast("bigint").alias("broker_id"), d.alias("d"))
            .filter("broker_id is not null and d is not null and d.host is not null")
            .select(*rest, "broker_id", "d.host", "d.port", F.coalesce("d.rack", F.lit("")).alias("rack")))


def describe_brokers(live: DataFrame, configs: DataFrame, full: bool = False) -> DataFrame:
    """Live brokers with the promoted config values; missing ones are ''. ``full`` keeps the config map."""
    def value(key: str) -> Column:
        return F.coalesce(F.element_at("config", key), F.lit(""))

    j = live.join(configs.select("cluster_id", "broker_id", "config"), ["cluster_id", "broker_id"], "left")
    return j.select(
        "cluster_id", "broker_id", "host", "port", value("broker.rack").alias("rack"),
        value("log.message.format.version").alias("log_message_format"),
        value("inter.broker.protocol.version").alias("inter_broker_protocol_version"),
        *(["config"] if full else []))


def parse_partition_sizes(docs: DataFrame) -> DataFrame:
    """Size documents ``{topic: {partition: {Size}}}``; an empty document is an error."""
    rest = [c for c in docs.columns if c not in ("doc", "topic")]
    per_topic = docs.select(*rest, F.explode(F.from_json(_not_empty(F.col("doc")), SIZE_DOCUMENT, STRICT)).alias("topic", "parts"))
    return per_topic.select(*rest, "topic", F.explode("parts").alias("p", "s")).select(
        *rest, "topic", F.col("p").cast("bigint").alias("partition_id"), F.col("s.Size").cast("bigint").alias("size_bytes"))


def parse_broker_storage(docs: DataFrame) -> DataFrame:
    """Storage documents ``{id: {StorageFree}}``; an empty document is an error."""
    rest = [c for c in docs.columns if c != "doc"]
    return docs.select(*rest, F.explode(F.from_json(_not_empty(F.col("doc")), STORAGE_DOCUMENT, STRICT)).alias("id", "s")).select(
        *rest, F.col("id").cast("bigint").alias("broker_id"), F.col("s.StorageFree").cast("bigint").alias("storage_free"))


def parse_reassignments(docs: DataFrame) -> DataFrame:
    """Pending reassignments; a missing or bad document yields no rows."""
    rest = [c for c in docs.columns if c not in ("doc", "topic")]
    return docs.select(*rest, F.explode(F.from_json("doc", MAP_DOCUMENT)["partitions"]).alias("p")).select(
        *rest, "p.topic", F.col("p.partition").alias("partition_id"), "p.replicas")


def parse_topic_metadata(docs: DataFrame) -> DataFrame:
    """(.., topic, partition_id, current, adding, removing) from topic metadata documents."""
    rest = [c for c in docs.columns if c != "doc"]
    d = docs.select(*rest, F.from_json("doc", TOPIC_METADATA_DOCUMENT, STRICT).alias("d"))
    return d.select(*rest, "d", F.explode("d.partitions").alias("p", "current")).select(
        *rest, F.col("p").cast("bigint").alias("partition_id"), "current",
        F.element_at("d.adding_replicas", F.col("p")).alias("adding"),
        F.element_at("d.removing_replicas", F.col("p")).alias("removing"))


def parse_partition_states(docs: DataFrame) -> DataFrame:
    """Leader and in-sync list of a partition from its state document."""
    rest = [c for c in docs.columns if c != "doc"]
    return docs.select(*rest, F.from_json("doc", STATE_DOCUMENT, STRICT).alias("d")).select(
        *rest, "d.leader", "d.isr", "d.leader_epoch", "d.controller_epoch")


def resource_configs(rows: DataFrame) -> DataFrame:
    """Config rows (resource_type, resource_name, k, v) to one map per resource; empty names and values are dropped.
    A resource has one value per key, so its map is bounded by the number of config keys."""
    kept = rows.filter("k <> '' and v <> '' and resource_name <> ''")
    return kept.groupBy("resource_type", "resource_name").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("config"))


def metric_points(points: DataFrame, start: Column, end: Column) -> DataFrame:
    """Points of [start, end); the bounds reach the scan."""
    return points.filter((F.col("ts") >= start) & (F.col("ts") < end))


def parse_tags(docs: DataFrame) -> DataFrame:
    rest = [c for c in docs.columns if c != "doc"]
    return docs.select(*rest, F.from_json("doc", STRING_MAP, STRICT).alias("tags"))


def tags_of_type(tags: DataFrame, object_type: str | None = None) -> DataFrame:
    """All objects, or those of one type (prunes a table partitioned by object_type)."""
    return tags if object_type is None else tags.filter(F.col("object_type") == object_type)


def parse_overrides(docs: DataFrame) -> DataFrame:
    """Override documents; an empty document is rate 0 without autoremove."""
    rest = [c for c in docs.columns if c != "doc"]
    d = F.from_json(F.when(F.trim("doc") == "", "{}").otherwise(F.col("doc")), OVERRIDE_DOCUMENT, STRICT)
    return docs.select(*rest, d.alias("d")).select(
        *rest, F.coalesce("d.rate", F.lit(0)).cast("bigint").alias("rate"),
        F.coalesce("d.autoremove", F.lit(False)).alias("autoremove"))
