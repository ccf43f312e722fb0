"""Device telemetry: validation, sequence checks and mapping to attribute rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.functions.terms import hash_id
from plantstate.operators.segments import before

#: The first part of a metric's name and what it stands for.
KINDS = {"Relationship": (m.RELATIONSHIP, "@id"), "Property": (m.PROPERTY, "@value"), "LiteralProperty": (m.PROPERTY, "@value"), "IriProperty": (m.PROPERTY, "@id"), "JsonProperty": (m.JSON_PROPERTY, "@json"), "ListProperty": (m.LIST_PROPERTY, "@list")}
MOST_METRICS = 1024


def telemetry_validate(messages: DataFrame) -> DataFrame:
    """messages (topic, payload JSON) parsed as column p, with ok: required fields and 1 to 1024 metrics."""
    p = F.from_json("payload", m.TELEMETRY)
    d = messages.withColumn("p", p)
    n = F.size("p.metrics")
    named = F.forall("p.metrics", lambda x: x["name"].isNotNull() & x["timestamp"].isNotNull() & x["value"].isNotNull())
    return d.withColumn("ok", F.coalesce(F.col("p.timestamp").isNotNull() & F.col("p.seq").isNotNull() & n.between(1, MOST_METRICS) & named, F.lit(False)))


def topic_parts(topic: Column) -> dict[str, Column]:
    parts = F.split(topic, "/")
    return {n: F.get(parts, F.lit(i)) for i, n in ((1, "account"), (2, "kind"), (3, "node"), (4, "device"))}


def seq_valid(seq: Column, before: Column, birth: Column) -> Column:
    """A birth must be 0; else the number grows, or goes from 255 to 0."""
    return F.when(birth, seq == 0).otherwise(before.isNotNull() & ((seq > before) | ((before == 255) & (seq == 0))))


def seq_check(messages: DataFrame, key: str, seq: str, order: str | Sequence[str], birth: Column) -> DataFrame:
    """messages with valid. Advisory: no row is dropped. order: a column or several, which tell all rows of a key apart."""
    names = [order] if isinstance(order, str) else list(order)
    d = before(messages.withColumn("_birth", birth), [key], names, {"_before": seq})
    return d.withColumn("valid", F.coalesce(seq_valid(F.col(seq), F.col("_before"), F.col("_birth")), F.lit(False))).drop("_before", "_first", "_birth")


def telemetry_to_attributes(valid: DataFrame) -> DataFrame:
    """Attribute rows of DDATA messages that telemetry_validate() found good. Metrics of unknown kinds go."""
    d = valid.where("ok")
    for n, c in topic_parts(F.col("topic")).items():
        d = d.withColumn(f"t_{n}", c)
    d = d.where("t_kind = 'DDATA'").select("t_device", F.explode("p.metrics").alias("x"))
    kind, name = F.regexp_extract("x.name", "^([^/]+)/", 1), F.regexp_extract("x.name", "^[^/]+/(.*)$", 1)
    props = F.map_from_arrays(F.coalesce("x.properties.keys", F.array().cast("array<string>")), F.coalesce("x.properties.values", F.array().cast("array<string>")))
    d = d.select("t_device", "x", kind.alias("kind"), name.alias("name"), F.coalesce(F.try_element_at(props, F.lit("datasetId")), F.lit("@none")).alias("datasetId"), F.try_element_at(props, F.lit("lang")).alias("lang"))
    types, nodes = (F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[i])]) for i in (0, 1))
    d = d.where(F.col("kind").isin(*KINDS))
    return d.select(
        F.concat_ws("\\", "t_device", hash_id(F.col("name"), F.col("datasetId"))).alias("id"), F.lit(None).cast("string").alias("parentId"), F.col("t_device").alias("entityId"), "name", nodes[F.col("kind")].alias("nodeType"), F.lit(None).cast("string").alias("valueType"),
        types[F.col("kind")].alias("type"), F.col("x.value").alias("attributeValue"), "datasetId", F.lit(None).cast("string").alias("unitCode"), "lang", F.lit(False).alias("deleted"), F.lit(False).alias("synced"), F.timestamp_millis("x.timestamp").alias("ts"),
    )
