"""Inventory tables derived from the star-schema test tables, for tests, checks and the benchmark.

Each method mirrors one adapter of FIXTURES.md; `catalog.adapter_sql` holds the SQL form of the same
tables for the oracle side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLUSTERS = ["f", "o", "p"]

# Line items per task of the replica tables. Adaptive execution sizes tasks by compressed bytes, and replica rows take many times that in
# sorts and windows, several of which share a stage; so the number of tasks follows the rows.
ROWS_PER_TASK = 200_000


def _topic():
    return F.concat(F.lit("t"), F.substring("o_orderpriority", 1, 1))


class Tables:
    """Lazy access to the tables of one scale-factor folder and to the inventory tables built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def supplier_count(self):
        return self.table("supplier").agg(F.count(F.lit(1))).scalar()

    @cached_property
    def tasks(self) -> int:
        """Tasks that the replica tables are dealt to: in proportion to the line items, one per core at least."""
        rows = self.table("lineitem").count()
        return max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` dealt by partition key to these tasks, for joins of tables that have one row per partition."""
        return df.repartition(self.tasks, "cluster_id", "topic", "partition_id")

    @cached_property
    def replicas(self) -> DataFrame:
        """(cluster_id, topic, partition_id, idx, broker_id, in_isr).

        Line items are dealt by (order, supplier) and reduced to one row each before the join, so a hot order
        shrinks in many tasks; the window, and whatever groups by partition after it, reuses the join's partitioning by order key.
        """
        dealt = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag").repartition(
            self.tasks, "l_orderkey", "l_suppkey")
        held = dealt.groupBy("l_orderkey", "l_suppkey").agg(
            F.min("l_linenumber").alias("ln"),
            F.max(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("in_isr"),
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("partition_id"),
            F.lower("o_orderstatus").alias("cluster_id"), _topic().alias("topic")).repartition(self.tasks, "partition_id")
        w = Window.partitionBy("cluster_id", "topic", "partition_id").orderBy("ln", "broker_id")
        return (
            held.withColumnsRenamed({"l_orderkey": "partition_id", "l_suppkey": "broker_id"})
            .repartition(self.tasks, "partition_id").join(orders, "partition_id")
            .select("cluster_id", "topic", "partition_id",
                    (F.row_number().over(w) - 1).alias("idx"), "broker_id", "in_isr")
        )

    @cached_property
    def partition_map(self) -> DataFrame:
        """Array form of `replicas`: one row per partition, ordered replica ids. The list is bounded by
        the replication factor, never by the table size."""
        from replicalens.functions.arrays import to_partition_map

        return to_partition_map(self.replicas)

    @cached_property
    def topic_state(self) -> DataFrame:
        """One row per partition: leader, ordered replicas, in-sync replicas."""
        ordered = F.array_sort(F.collect_list(F.struct("idx", "broker_id", "in_isr")))
        return (
            self.replicas.groupBy("cluster_id", "topic", "partition_id").agg(ordered.alias("r"))
            .select("cluster_id", "topic", "partition_id",
                    F.col("r")[0]["broker_id"].alias("leader"),
                    F.transform("r", lambda x: x["broker_id"]).alias("replicas"),
                    F.transform(F.filter("r", lambda x: x["in_isr"] == 1), lambda x: x["broker_id"]).alias("isr"))
        )

    @cached_property
    def partition_size(self) -> DataFrame:
        sizes = self.table("lineitem").groupBy("l_orderkey").agg(
            F.max(F.round(F.col("l_extendedprice") * 100)).cast("bigint").alias("size_bytes"))
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.lower("o_orderstatus").alias("cluster_id"), _topic().alias("topic"))
        return sizes.join(orders, "l_orderkey").select(
            "cluster_id", "topic", F.col("l_orderkey").alias("partition_id"), "size_bytes")

    @cached_property
    def broker_meta(self) -> DataFrame:
        sup, nat = self.table("supplier"), self.table("nation")
        return sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(
            F.explode(F.array(*[F.lit(c) for c in CLUSTERS])).alias("cluster_id"),
            F.col("s_suppkey").alias("broker_id"), F.col("s_name").alias("host"), F.lit(9092).alias("port"),
            F.when(F.col("s_suppkey") % 17 == 5, "")
            .otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("rack"),
            F.round((F.col("s_acctbal") + 2000) * 100).cast("bigint").alias("storage_free"),
            F.concat(F.lit("it"), (F.col("n_nationkey") % 3).cast("string")).alias("instance_type"),
            F.when(F.col("s_suppkey") % 10 == 9, 0).otherwise(1).alias("is_live"),
        )

    @cached_property
    def provided_brokers(self) -> DataFrame:
        sup = self.table("supplier")
        clusters = F.explode(F.array(*[F.lit(c) for c in CLUSTERS])).alias("cluster_id")
        return (
            sup.filter("s_suppkey % 7 <> 3").select(clusters, F.col("s_suppkey").alias("broker_id"))
            .unionByName(sup.filter("s_suppkey % 5 = 0")
                         .select(clusters, (F.col("s_suppkey") + 1000000).alias("broker_id")))
        )

    @cached_property
    def discovered_brokers(self) -> DataFrame:
        m = self.broker_meta.select("cluster_id", "broker_id", "rack", "storage_free", "is_live")
        return m.filter("is_live = 1").drop("is_live").unionByName(
            m.filter("broker_id % 10 = 0").drop("is_live").withColumn("broker_id", F.col("broker_id") + 1000000))

    @cached_property
    def replicas_after(self) -> DataFrame:
        """Replica rows after every ninth broker handed its replicas to its successor."""
        w = Window.partitionBy("cluster_id", "topic", "partition_id")
        nxt = (F.col("broker_id") + 1) % self.supplier_count
        return (
            self.replicas.withColumn("held", F.collect_set("broker_id").over(w))
            .withColumn("nxt", nxt)
            .select("cluster_id", "topic", "partition_id", "idx",
                    F.when((F.col("broker_id") % 9 == 0) & ~F.array_contains("held", F.col("nxt")), F.col("nxt"))
                    .otherwise(F.col("broker_id")).alias("broker_id"))
        )

    @cached_property
    def partition_map_after(self) -> DataFrame:
        from replicalens.functions.arrays import to_partition_map

        return to_partition_map(self.replicas_after)

    @cached_property
    def reassignment(self) -> DataFrame:
        """Pending targets of every partition: leader kept, followers moved to other brokers."""
        w = Window.partitionBy("cluster_id", "topic", "partition_id").orderBy("idx")
        target = F.when(F.col("idx") == 0, F.col("broker_id")).otherwise(
            (F.col("broker_id") * 7 + 3) % self.supplier_count)
        return (
            self.replicas.withColumn("leader", F.first("broker_id").over(w)).withColumn("target_broker", target)
            .filter("idx = 0 or target_broker <> leader")
            .select("cluster_id", "topic", "partition_id", "idx", "target_broker")
        )

    @cached_property
    def override(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").filter("s_suppkey % 3 = 0").select(
            F.explode(F.array(*[F.lit(c) for c in CLUSTERS])).alias("cluster_id"), s.alias("broker_id"),
            F.when(s % 2 == 0, F.lit(0).cast("bigint")).otherwise(50 + s % 3).alias("rate"),
            (s % 5 == 0).alias("autoremove"))

    @staticmethod
    def metric_points_from(events: DataFrame) -> DataFrame:
        u = F.col("user_id")
        return events.select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"),
            F.concat(F.lit("host:h"), (u % 20).cast("string"), F.lit(",broker_id:"), (u % 20).cast("string"),
                     F.lit(",instance-type:it"), (u % 3).cast("string")).alias("scope"),
            F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))

    @cached_property
    def metric_points(self) -> DataFrame:
        return self.metric_points_from(self.table("events"))

    @cached_property
    def tag_rows(self) -> DataFrame:
        c = self.table("customer")
        key = F.col("c_custkey").cast("string")
        base = dict(object_type=F.lit("broker"), object_id=key)

        def rows(df, k, v):
            return df.select(*[e.alias(n) for n, e in base.items()], F.lit(k).alias("k"), v.alias("v"))

        return (
            rows(c, "pool", F.lower("c_mktsegment"))
            .unionByName(rows(c, "zone", F.concat(F.lit("z"), (F.col("c_nationkey") % 4).cast("string"))))
            .unionByName(rows(c.filter("c_custkey % 13 = 0"), "tagMarkedForDeletionTime",
                              (1704067200 + F.col("c_custkey") * 60).cast("string")))
        )

    @cached_property
    def tags(self) -> DataFrame:
        """Map form of `tag_rows`; an object has one value per key."""
        return self.tag_rows.groupBy("object_type", "object_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))

    @staticmethod
    def checkpoints_from(events: DataFrame) -> DataFrame:
        return events.select(
            F.col("event_id").alias("log_offset"),
            F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("group_id"),
            F.col("event_type").alias("topic"), (F.col("user_id") % 8).alias("partition_id"),
            (F.col("event_id") * 3).alias("upstream_offset"), F.col("event_id").alias("local_offset"))

    @cached_property
    def checkpoints(self) -> DataFrame:
        return self.checkpoints_from(self.table("events"))

    @cached_property
    def resource_config(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_brand").alias("resource_name"), F.lower("p_type").alias("k")).agg(
            F.max("p_size").cast("string").alias("v"),
            F.when(F.max("p_partkey") % 3 == 0, "dynamic").otherwise("default").alias("source"),
        ).select(F.lit("topic").alias("resource_type"), "resource_name", "k", "v", "source")

    @cached_property
    def topic_snapshots(self) -> DataFrame:
        return self.table("events").filter("event_type = 'purchase'").select(
            F.date_trunc("day", F.col("ts").cast("timestamp")).alias("snapshot_ts"),
            F.concat(F.lit("t"), (F.col("user_id") % 12).cast("string")).alias("topic")).distinct()
