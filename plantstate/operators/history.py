"""History points of attribute and entity changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantstate import model as m

KNOWN = (m.PROPERTY, m.RELATIONSHIP, m.JSON_PROPERTY, m.LIST_PROPERTY, m.GEO_PROPERTY)


def attribute_history(changes: DataFrame, offset: str = "offset") -> DataFrame:
    """One point per (id, observedAt, datasetId), of the last offset. Integers written as 1.0 lose the
    fraction, datasetId is @none and deleted false where missing, unknown types go."""
    value = F.when(F.col("attributeValue").rlike(r"^[+-]?\d+\.0+$"), F.regexp_extract("attributeValue", r"^([+-]?\d+)", 1)).otherwise(F.col("attributeValue"))
    rows = changes.where(F.col("type").isin(*KNOWN)).select("id", F.col("ts").alias("observedAt"), F.coalesce("datasetId", F.lit("@none")).alias("datasetId"), "parentId", F.col("ts").alias("modifiedAt"), "entityId", F.col("name").alias("attributeId"), F.col("type").alias("attributeType"), "nodeType", value.alias("value"), "valueType", "unitCode", "lang", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.col(offset).alias("_o"))
    keys = ["id", "observedAt", "datasetId"]
    rest = [c for c in rows.columns if c not in (*keys, "_o")]
    top = rows.groupBy(*keys).agg(F.max(F.struct("_o", *rest)).alias("l"))
    return top.select(*keys, *[F.col(f"l.{c}").alias(c) for c in rest])


def entity_history(changes: DataFrame) -> DataFrame:
    """One point per (id, observedAt)."""
    return changes.groupBy("id", F.col("ts").alias("observedAt")).agg(F.max("type").alias("type"), F.max(F.coalesce("deleted", F.lit(False))).alias("deleted")).select("id", "observedAt", F.col("observedAt").alias("modifiedAt"), "type", "deleted")
