"""Constraints and rules whose pattern the caller composes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantstate import model as m


def message_template(template: str, columns: Sequence[str]) -> Column:
    """{?v} and {$v} become the value of v, or NULL."""
    parts = re.split(r"\{[?$](\w*)\}", template)
    value = lambda v: F.coalesce(F.col(v).cast("string"), F.lit("NULL")) if v in columns else F.lit("NULL")
    return F.concat(*[value(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def shape_result_outer(targets: DataFrame, violations: DataFrame, shape: str, severity: str, message: Column) -> DataFrame:
    """One alert for each target and violation of it; targets without one get ok."""
    found = violations.select(F.col("this").alias("resource"), message.alias("_text"), F.lit(severity).alias("_severity"))
    rows = targets.select(F.col("this").alias("resource")).join(found, "resource", "left")
    return rows.select("resource", F.lit(f"SPARQLConstraintComponent({shape})").alias("event"), F.coalesce("_severity", F.lit("ok")).alias("severity"), F.coalesce("_text", F.lit("All ok")).alias("text"))


def sparql_constraint(pattern: DataFrame, targets: DataFrame, shape: str, severity: str, template: str) -> DataFrame:
    return shape_result_outer(targets, pattern, shape, severity, message_template(template, pattern.columns))


def construct_rule(pattern: DataFrame, heads: Sequence[tuple[str, Column, str, str | None]], s: str = "this") -> DataFrame:
    """Attribute rows of a rule's heads: (name, value, node type, value type), each once per entity and value."""
    null = F.lit(None).cast("string")
    made = [
        pattern.select(F.concat_ws("\\", F.col(s), F.lit(name)).alias("id"), null.alias("parentId"), F.col(s).alias("entityId"), F.lit(name).alias("name"), F.lit(node).alias("nodeType"), F.lit(vt).cast("string").alias("valueType"), F.lit(m.PROPERTY).alias("type"), value.cast("string").alias("attributeValue"), F.lit("@none").alias("datasetId"), F.lit(False).alias("deleted")).where(F.col("attributeValue").isNotNull())
        for name, value, node, vt in heads
    ]
    return reduce(DataFrame.unionByName, made).distinct()
