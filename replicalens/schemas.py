"""Column contracts of the working tables and schemas of the document formats."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the document formats.
STUB_BROKER_ID = 9223372036854775807
OFFLINE_BROKER_ID = -1
ALL_MAPPED = -1
ALL_DISCOVERED = -2
MARK_TAG = "tagMarkedForDeletionTime"
OFFSETS_TOPIC = "__consumer_offsets"
RESERVED_TOPIC_KEYS = ["tags", "name", "partitions", "replication", "configs", "replicas"]
RESERVED_BROKER_KEYS = [
    "tags", "id", "host", "port", "rack", "interbrokerprotocolversion", "logmessageformat",
]

PARTITION_KEY = ["cluster_id", "topic", "partition_id"]
BROKER_KEY = ["cluster_id", "broker_id"]

MAP_DOCUMENT = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("partitions", T.ArrayType(T.StructType([
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.LongType()),
        T.StructField("replicas", T.ArrayType(T.LongType())),
    ]))),
])

SIZE_DOCUMENT = T.MapType(
    T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("Size", T.DoubleType())]))
)
STORAGE_DOCUMENT = T.MapType(T.StringType(), T.StructType([T.StructField("StorageFree", T.DoubleType())]))
REPLICA_MAP = T.MapType(T.StringType(), T.ArrayType(T.LongType()))
TOPIC_METADATA_DOCUMENT = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("partitions", REPLICA_MAP),
    T.StructField("adding_replicas", REPLICA_MAP),
    T.StructField("removing_replicas", REPLICA_MAP),
])
STATE_DOCUMENT = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("controller_epoch", T.IntegerType()),
    T.StructField("leader", T.LongType()),
    T.StructField("leader_epoch", T.IntegerType()),
    T.StructField("isr", T.ArrayType(T.LongType())),
])
BROKER_DOCUMENT = T.StructType([
    T.StructField("rack", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
])
OVERRIDE_DOCUMENT = T.StructType([
    T.StructField("rate", T.IntegerType()),
    T.StructField("autoremove", T.BooleanType()),
])
STRING_MAP = T.MapType(T.StringType(), T.StringType())
