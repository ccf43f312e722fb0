"""Sources and sinks: change logs, upserts, history tables, node sets and entity documents."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantstate.operators.cdc import cdc_flatten
from plantstate.operators.history import attribute_history, entity_history
from plantstate.operators.state import latest_by_key
from plantstate.sources import buckets
from plantstate.sources.buckets import read as read_upserted
from plantstate.sources.buckets import upsert

__all__ = ["cdc_table", "entity_documents", "json_log", "kafka_stream", "merge_history", "nodeset_references", "nodeset_rows", "read_history", "read_upserted", "upsert", "upsert_log", "write_history"]


def json_log(lines: DataFrame, schema: str, value: str = "value", ts: str = "timestamp") -> DataFrame:
    """Records of a JSON log (batch or stream, e.g. Kafka's value and timestamp). Records that don't parse
    go; fields that don't fit are null. Event time is the record's."""
    parsed = lines.select(F.from_json(F.col(value).cast("string"), schema).alias("r"), F.col(ts).alias("ts"))
    return parsed.where(F.col("r").isNotNull() & ~F.forall(F.array(*[F.col(f"r.{f}").isNull() for f in _fields(schema)]), lambda x: x)).select("r.*", "ts")


def _fields(schema: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return [f.name for f in _parse_datatype_string(schema)]


def upsert_log(lines: DataFrame, schema: str, keys: Sequence[str], key: str = "key", value: str = "value", ts: str = "timestamp") -> DataFrame:
    """A keyed log: key and value are JSON; a null value is a tombstone, kept as deleted = true."""
    key_schema = ", ".join(f"{k} string" for k in keys)
    d = lines.select(F.from_json(F.col(key).cast("string"), key_schema).alias("k"), F.from_json(F.col(value).cast("string"), schema).alias("v"), F.col(value).isNull().alias("deleted"), F.col(ts).alias("ts"))
    return d.select(*[F.col(f"k.{k}").alias(k) for k in keys], *[F.col(f"v.{f}").alias(f) for f in _fields(schema) if f not in keys], "deleted", "ts")


def cdc_table(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """A static table as its snapshot and the changes since, deletions applied."""
    now = latest_by_key(snapshot.unionByName(changes), keys, ts)
    return now.where(~F.coalesce("deleted", F.lit(False)))


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A Kafka topic as a stream of key, value, timestamp. Needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def write_history(changes: DataFrame, path: str, entity: bool = False) -> None:
    """Merge history points into Parquet by day: of points with one key that of the later batch stays.

    Only the days that the batch has are read and written. Their merge is written to a staged folder
    first, beside the log (path-merge), so that the swap of these days does not read what it replaces."""
    spark = changes.sparkSession
    keys = ["id", "observedAt"] if entity else ["id", "observedAt", "datasetId"]
    points = (entity_history(changes) if entity else attribute_history(changes)).withColumn("day", F.to_date("observedAt"))
    jvm = spark.sparkContext._jvm
    root, merged = jvm.org.apache.hadoop.fs.Path(path), f"{path.rstrip('/')}-merge/{uuid.uuid4().hex}"
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(root):
        # Written, as the batch is read for its days and its points.
        points.write.parquet(f"{merged}/new")
        points = spark.read.schema(points.schema).parquet(f"{merged}/new")
        days = [r.day for r in points.select("day").distinct().collect()]
        known = F.col("day").isin([x for x in days if x is not None])
        old = spark.read.schema(points.schema).parquet(path).where(known | F.col("day").isNull() if None in days else known)
        both = points.withColumn("_b", F.lit(1)).unionByName(old.withColumn("_b", F.lit(0)))
        rest = [c for c in points.columns if c not in keys]
        top = both.groupBy(*keys).agg(F.max(F.struct("_b", *rest)).alias("l"))
        top.select(*keys, *[F.col(f"l.{c}").alias(c) for c in rest]).write.parquet(f"{merged}/all")
        points = spark.read.schema(points.schema).parquet(f"{merged}/all")
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(merged), True)


def merge_history(changes: DataFrame, path: str, entity: bool = False, batch: int | None = None) -> bool:
    """Merge history points into a versioned table: of points with one key that of the later batch stays.

    A batch adds a file to the buckets of its days; no day is read or rewritten by it, but for
    buckets of many deltas. Readers see the points before the batch or with all of it, wherever
    a writer stops. batch: numbered batches are applied once (the result says whether it was)."""
    old = buckets.version(changes.sparkSession, path)
    keys = ["id", "observedAt"] if entity else ["id", "observedAt", "datasetId"]
    points = (entity_history(changes) if entity else attribute_history(changes)).withColumn("day", F.to_date("observedAt"))
    number = F.lit(old.number + 1 if old else 1).cast("long")
    return upsert(points.withColumn("_written", number), path, keys, "_written", by=["day"], batch=batch)


def read_history(spark: SparkSession, path: str, days: DataFrame | None = None) -> DataFrame:
    """The points of merge_history(); with days (one column of dates), of these only, read from their buckets."""
    return (read_upserted(spark, path) if days is None else buckets.read_keys(days, path)).drop("_written")


def nodeset_rows(spark: SparkSession, path: str, tag: str, schema: StructType | None = None) -> DataFrame:
    """Rows of one tag of node set XML, by Spark's XML source: _NodeId, _BrowseName, References, ...

    schema: if not named, the files are read once more for it. One task reads a file."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader if schema is None else reader.schema(schema)).load(path)


def nodeset_references(rows: DataFrame) -> DataFrame:
    """node, type, forward, target of the references of nodeset rows."""
    r = F.explode("References.Reference")
    return rows.select(F.col("_NodeId").alias("node"), r.alias("r")).select("node", F.col("r._ReferenceType").alias("type"), F.coalesce(F.col("r._IsForward"), F.lit(True)).alias("forward"), F.trim("r._VALUE").alias("target"))


def entity_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, attributes) of entity documents in expanded form (column doc)."""
    d = docs.select(F.coalesce(F.get_json_object("doc", "$['@id']"), F.get_json_object("doc", "$.id")).alias("id"), F.coalesce(F.get_json_object("doc", "$['@type'][0]"), F.get_json_object("doc", "$.type")).alias("type"), F.col("doc").alias("entity"))
    return d.select("id", "type"), cdc_flatten(d.select("id", "entity"))
