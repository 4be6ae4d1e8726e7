"""Document writers and tag table updates.

Documents are cut by id ranges: a document of at most ``span`` partitions (or brokers) is itself valid,
and the ranges of a topic together are its whole map. No task ever builds one document of a whole topic.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicalens.functions.text import has_any_key, merge_tags, without_keys
from replicalens.schemas import RESERVED_BROKER_KEYS, RESERVED_TOPIC_KEYS, STUB_BROKER_ID


def map_documents(maps: DataFrame, span: int = 1000, tasks: int | None = None) -> DataFrame:
    """Partition-map documents per (cluster, map name, id range).

    ``maps`` may carry ``phase`` (from 1); with it, documents are named ``<topic>-phase<N>``. Open slots
    are written as the reserved id. ``tasks`` is how many tasks build the documents; without it Spark sizes them by compressed bytes,
    of which lists in memory take many times as much.
    """
    name = (F.concat_ws("-phase", "topic", F.col("phase").cast("string")) if "phase" in maps.columns else F.col("topic"))
    ids = F.transform("replicas", lambda b: F.coalesce(b, F.lit(STUB_BROKER_ID)))
    part = F.struct(F.col("topic"), F.col("partition_id").alias("partition"), ids.alias("replicas"))
    key = ["cluster_id", "map_name", "range_id"]
    rows = maps.select("cluster_id", name.alias("map_name"), F.expr(f"partition_id div {span}").alias("range_id"), part.alias("part"))
    if tasks is not None:
        rows = rows.repartition(tasks, *key)
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list("part")).alias("partitions"))
    return g.select("cluster_id", "map_name", "range_id",
                    F.to_json(F.struct(F.lit(1).alias("version"), "partitions")).alias("doc"))


def write_map_documents(maps: DataFrame, path: str, span: int = 1000, combined: bool = False, tasks: int | None = None) -> None:
    """One folder of documents per cluster and map name; ``combined`` adds a folder holding all of them.
    Maps without rows write nothing."""
    docs = map_documents(maps, span, tasks).select("cluster_id", "map_name", "doc")
    docs.write.partitionBy("cluster_id", "map_name").text(f"{path}/by_topic")
    if combined:
        docs.drop("map_name").write.partitionBy("cluster_id").text(f"{path}/combined")


def size_documents(sizes: DataFrame, span: int = 1000) -> DataFrame:
    entry = F.struct(F.col("partition_id").cast("string").alias("k"), F.struct(F.col("size_bytes").alias("Size")).alias("v"))
    g = sizes.groupBy("cluster_id", "topic", F.expr(f"partition_id div {span}").alias("range_id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return g.select("cluster_id", F.to_json(F.create_map("topic", "m")).alias("doc"))


def storage_documents(brokers: DataFrame, span: int = 1000) -> DataFrame:
    entry = F.struct(F.col("broker_id").cast("string").alias("k"), F.struct(F.col("storage_free").alias("StorageFree")).alias("v"))
    g = brokers.groupBy("cluster_id", F.expr(f"broker_id div {span}").alias("range_id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return g.select("cluster_id", F.to_json("m").alias("doc"))


def write_documents(docs: DataFrame, path: str, compression: str = "gzip") -> None:
    docs.write.partitionBy("cluster_id").option("compression", compression).text(path)


def reserved_keys(object_type: str) -> list[str]:
    return {"topic": RESERVED_TOPIC_KEYS, "broker": RESERVED_BROKER_KEYS}[object_type]


def _reserved(keys_of) -> Column:
    out = F.lit(False)
    for kind in ("topic", "broker"):
        out = out | ((F.col("object_type") == kind) & keys_of(reserved_keys(kind)))
    return out


OBJECT = ["object_type", "object_id"]
_NO_TAGS = "map<string,string>"


def _rejected(tags: Column) -> Column:
    """Changes that are refused: an incomplete object, an empty tag set, a reserved key."""
    bad = (F.coalesce("object_type", F.lit("")) == "") | (F.coalesce("object_id", F.lit("")) == "") | (
        F.coalesce(F.size(tags), F.lit(0)) == 0) | _reserved(lambda ks: has_any_key(tags, ks))
    return F.coalesce(bad, F.lit(True))


def _key_names(keys: Column) -> Column:
    """Only the part of a key before ``:`` counts."""
    return F.transform(keys, lambda k: F.split(k, ":")[0])


def fold_tag_log(log: DataFrame) -> DataFrame:
    """The last word on every key: (object_type, object_id, sets map, drops array), one row per object.

    ``log``: object_type, object_id, seq, tags, keys. A row sets the keys of ``tags``, or deletes ``keys`` (a tombstone). Of one key's rows the
    largest ``seq`` counts; of equal ones a value before a tombstone, and the greatest value. Keys combine before the shuffle, so an object of many
    requests is no hot group, and a row per object holds its distinct keys only.
    """
    entries = log.select(*OBJECT, "seq", F.explode(F.concat(
        F.transform(F.map_entries(F.coalesce("tags", F.create_map().cast(_NO_TAGS))), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), F.lit(True).alias("kept"))),
        F.transform(F.coalesce(_key_names(F.col("keys")), F.array().cast("array<string>")),
                    lambda k: F.struct(k.alias("k"), F.lit(None).cast("string").alias("v"), F.lit(False).alias("kept"))))).alias("e")).select(*OBJECT, "seq", "e.*")
    last = entries.groupBy(*OBJECT, "k").agg(F.max(F.struct("seq", "kept", "v")).alias("w")).select(*OBJECT, "k", "w.kept", "w.v")
    return last.groupBy(*OBJECT).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("k", "v"))))).alias("sets"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("k")))).alias("drops"))


def _applied(current: DataFrame, folded: DataFrame, how: str) -> DataFrame:
    none = F.create_map().cast(_NO_TAGS)
    kept = F.map_filter(F.coalesce("tags", none), lambda k, _v: ~F.array_contains(F.coalesce("drops", F.array().cast("array<string>")), k))
    return current.join(folded, OBJECT, how).select(*OBJECT, merge_tags(kept, F.coalesce("sets", none)).alias("tags"))


def apply_tag_log(current: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new tag table, rejected rows) of a log of sets and deletes in any order of arrival; ``log`` as in ``fold_tag_log``.

    The table has one row per object however many requests name it. Rejected: a set as in ``upsert_tags``, and a delete for an object that neither the table
    nor an earlier set of the log has.
    """
    is_set = F.col("tags").isNotNull()
    bad = log.filter(is_set & _rejected(F.col("tags")))
    sets = log.filter(is_set & ~_rejected(F.col("tags")))
    born = current.select(*OBJECT, F.lit(None).cast("bigint").alias("born")).unionByName(
        sets.groupBy(*OBJECT).agg(F.min("seq").cast("bigint").alias("born"))).groupBy(*OBJECT).agg(
        F.max(F.col("born").isNull()).alias("known"), F.min("born").alias("born"))
    drops = log.filter(~is_set).join(born, OBJECT, "left").withColumn("fine", F.coalesce(F.col("known") | (F.col("born") < F.col("seq")), F.lit(False)))
    unknown = drops.filter("not fine").select(*log.columns)
    good = sets.unionByName(drops.filter("fine").select(*log.columns))
    return _applied(current, fold_tag_log(good), "full_outer"), bad.unionByName(unknown)


def _as_log(df: DataFrame, order: str | None, tags: str | None, keys: str | None) -> DataFrame:
    none = F.lit(None)
    return df.select(*OBJECT, (F.col(order) if order else F.lit(0)).cast("bigint").alias("seq"), (F.col(tags) if tags else none.cast(_NO_TAGS)).alias("tags"),
                     (F.col(keys) if keys else none.cast("array<string>")).alias("keys"))


def upsert_tags(current: DataFrame, changes: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new tag table, rejected changes). New keys overwrite, other keys stay. Rejected: an incomplete
    object, an empty tag set, a reserved key. Several changes of one object are folded, the last in ``order`` winning each key."""
    bad = _rejected(F.col("tags"))
    folded = fold_tag_log(_as_log(changes.filter(~bad), order, "tags", None))
    return _applied(current, folded, "full_outer"), changes.filter(bad)


def delete_tags(current: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new tag table, requests for unknown objects). Requests carry ``keys``; only the part of a key before
    ``:`` counts. All requests of an object count together."""
    folded = fold_tag_log(_as_log(requests, None, None, "keys"))
    return _applied(current, folded, "left"), requests.join(current.select(*OBJECT), OBJECT, "left_anti")


def drop_tag_keys(current: DataFrame, keys: Iterable[str]) -> DataFrame:
    return current.withColumn("tags", without_keys(F.col("tags"), keys))
