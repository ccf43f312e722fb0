"""Update messages: attribute rows per window become entity patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.functions.terms import iso_millis


def fragment() -> Column:
    """The JSON of one attribute instance."""
    v, q = F.col("attributeValue"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = (
        F.when(F.col("type") == m.RELATIONSHIP, F.concat(F.lit('"object":'), q(v)))
        .when(F.col("type") == m.JSON_PROPERTY, F.concat(F.lit('"json":'), v))
        .when(F.col("type") == m.LIST_PROPERTY, F.concat(F.lit('"valueList":'), F.when(F.col("deleted"), "[]").otherwise(v)))
        .when(F.col("nodeType") == "@id", F.concat(F.lit('"value":{"@id":'), q(v), F.lit("}")))
        .when(F.col("nodeType").isin("@json", "@value"), F.concat(F.lit('"value":'), v))
        .otherwise(F.concat(F.lit('"value":'), q(v)))
    )
    return F.concat(F.lit('{"observedAt":"'), iso_millis(F.col("ts")), F.lit('","type":"'), F.col("type"), F.lit('","datasetId":"'), F.coalesce("datasetId", F.lit("@none")), F.lit('",'), value, F.lit("}"))


def tumble_updates(attributes: DataFrame, window: str = "1 millisecond", tie: str | None = None) -> DataFrame:
    """Per window and entity one update message with the last value of each unsynced top-level attribute."""
    order = [c for c in ("ts", tie) if c]
    rows = attributes.where(F.col("entityId").isNotNull() & F.col("parentId").isNull() & ~F.coalesce("synced", F.lit(False)))
    last = rows.groupBy(F.window("ts", window).alias("w"), "entityId", "name", "datasetId").agg(F.max(F.struct(*order, "type", "nodeType", "attributeValue", "deleted")).alias("l"))
    parts = last.select(F.col("w.start").alias("window_start"), "entityId", "name", "datasetId", "l.*").withColumn("json", fragment())
    by_name = parts.groupBy("window_start", "entityId", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("datasetId", "json"))), lambda x: x["json"]), ",").alias("json"))
    whole = by_name.groupBy("window_start", "entityId").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "json"))), lambda x: F.concat(F.lit('"'), x["name"], F.lit('":['), x["json"], F.lit("]"))), ",").alias("json"))
    return whole.select("window_start", F.lit("update").alias("op"), F.lit(True).alias("overwriteOrReplace"), F.lit(True).alias("noForward"), F.concat(F.lit('[{"id":"'), "entityId", F.lit('",'), "json", F.lit("}]")).alias("entities"))


def update_normalize(updates: DataFrame, marker: str = "urn:sync") -> DataFrame:
    """Updates with required fields: entities parsed, datasetId @none dropped, a sync marker added for noForward."""
    good = updates.where(F.col("op").isNotNull() & F.col("entities").isNotNull() & F.from_json("entities", "array<map<string,string>>").isNotNull())
    text = F.regexp_replace(F.regexp_replace("entities", r'"datasetId":"@none",', ""), r',"datasetId":"@none"', "")
    return good.withColumn("entities", F.when(F.col("noForward"), F.regexp_replace(text, r"\}\]$", f',"{marker}":true}}]')).otherwise(text))


def tumble_writeback(derived: DataFrame, window: str = "1 millisecond", tie: str | None = None) -> DataFrame:
    """The last value of each derived attribute per window, back in the columns of the attribute log."""
    from plantstate.operators.aggregates import last_value_agg

    return last_value_agg(derived, ["id", "datasetId"], window, "ts", tie).drop("window_start", "window_end")
