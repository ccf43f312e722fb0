"""Constraint rows from shape triples and from schema documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.operators import graph
from plantstate.operators.segments import running

#: Shape predicates and the constraint columns that they fill.
SH = "http://www.w3.org/ns/shacl#"
FIELDS = {f"<{SH}{p}>": c for p, c in {"class": "propertyClass", "nodeKind": "propertyNodetype", "minCount": "minCount", "maxCount": "maxCount", "severity": "severity", "minExclusive": "minExclusive", "maxExclusive": "maxExclusive", "minInclusive": "minInclusive", "maxInclusive": "maxInclusive", "minLength": "minLength", "maxLength": "maxLength", "pattern": "pattern", "in": "ins", "datatype": "datatypes", "hasValue": "hasValue"}.items()}


def _bare(c: str):
    return F.regexp_replace(F.regexp_replace(c, "^<(.*)>$", "$1"), '^"(.*)"$', "$1")


def shape_normalize_or(triples: DataFrame) -> DataFrame:
    """Facts of a property shape are pushed into each of its OR branches; a shape without one becomes its only branch."""
    branch = triples.where(F.col("predicate") == f"<{SH}or>").select(F.col("subject").alias("shape"), F.col("object").alias("branch"))
    facts = triples.where(F.col("predicate").isin(*FIELDS)).select(F.col("subject").alias("shape"), "predicate", "object")
    pushed = facts.join(branch, "shape").select(F.col("branch").alias("subject"), "predicate", "object")
    props = triples.where(F.col("predicate") == f"<{SH}path>").select(F.col("subject").alias("shape"))
    alone = props.join(branch, "shape", "left_anti").select(F.col("shape").alias("subject"), F.lit(f"<{SH}or>").alias("predicate"), F.col("shape").alias("object"))
    rest = triples.join(branch.select(F.col("shape").alias("subject")).distinct(), "subject", "left_anti").select("subject", "predicate", "object")
    kept = triples.where(~F.col("predicate").isin(*FIELDS)).join(branch.select(F.col("shape").alias("subject")).distinct(), "subject", "left_semi").select("subject", "predicate", "object")
    return rest.unionByName(kept).unionByName(pushed).unionByName(alone).distinct()


def constraint_catalog(normalized: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(constraints, combinations) from normalised shapes: a node shape's targetClass and property shapes, whose branches hold the facts.

    One branch is published; several make an OR, whose target is published. Ids run by shape and
    branch. compat: zero bounds of maxCount, maxExclusive and maxInclusive are dropped."""
    of = lambda p: triples_of(normalized, f"<{SH}{p}>")
    shapes = of("targetClass").toDF("node", "targetClass").join(of("property").toDF("node", "shape"), "node").join(of("path").toDF("shape", "path"), "shape").join(of("or").toDF("shape", "branch"), "shape")
    facts = normalized.where(F.col("predicate").isin(*FIELDS)).groupBy(F.col("subject").alias("branch")).pivot("predicate", list(FIELDS)).agg(F.min("object"))
    facts = facts.select("branch", *[_bare(f"`{p}`").alias(c) for p, c in FIELDS.items()])
    rows = shapes.join(facts, "branch", "left")
    n = Window.partitionBy("shape")
    # Numbered in ranges: only the sums of the ranges meet in one task.
    rows = running(rows, [], ["targetClass", "shape", "branch"], None, "before")
    rows = rows.withColumns({"id": F.col("before") + 1, "branches": F.count("*").over(n)}).drop("before")
    target = F.when(F.col("branches") > 1, F.min("id").over(n) + 1_000_000).otherwise(F.col("id"))
    rows = rows.withColumn("target", target).withColumn("severity", F.coalesce("severity", F.lit("warning")))
    if compat:
        for c in ("maxCount", "maxExclusive", "maxInclusive"):
            rows = rows.withColumn(c, F.when(F.col(c) != "0", F.col(c)))
    full = rows.select(F.col("id").cast("int").alias("id"), _bare("targetClass").alias("targetClass"), _bare("path").alias("propertyPath"), F.lit(None).cast("string").alias("subpropertyPath"), "propertyClass", "propertyNodetype", F.when(F.col("propertyNodetype").isNull() & F.col("propertyClass").isNotNull(), m.RELATIONSHIP).otherwise(m.PROPERTY).alias("attributeType"), *[c for c in m.CONSTRAINT_COLUMNS if c not in ("targetClass", "propertyPath", "subpropertyPath", "propertyClass", "propertyNodetype", "attributeType")])
    members = rows.where("branches > 1").select(F.col("id").cast("int").alias("member_constraint_id"), F.lit("OR").alias("operation"), F.col("target").cast("int").alias("target_constraint_id"))
    published = rows.select(F.col("target").cast("int").alias("member_constraint_id"), F.lit("PUBLISH").alias("operation"), F.col("target").cast("int").alias("target_constraint_id")).distinct()
    joint = rows.where("branches > 1").groupBy("target").agg(F.min_by("severity", "id").alias("severity"), F.min("targetClass").alias("targetClass"))
    synthetic = joint.select(F.col("target").cast("int").alias("id"), _bare("targetClass").alias("targetClass"), *[F.lit(None).cast("string").alias(c) for c in m.CONSTRAINT_COLUMNS[1:] if c != "severity"], "severity").select(*full.columns)
    return full.unionByName(synthetic), members.unionByName(published)


def triples_of(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("predicate") == predicate).select("subject", "object")


_MEMBERS = "properties:map<string,struct<relationship:string,relationship_type:string,type:string,enum:array<string>,minimum:string,maximum:string,exclusiveMinimum:string,exclusiveMaximum:string,minLength:string,maxLength:string>>,required:array<string>"
SCHEMA_DOC = "array<struct<`$id`:string," + _MEMBERS + ",allOf:array<struct<`$ref`:string," + _MEMBERS + ">>>>"


def schema_properties(docs: DataFrame) -> DataFrame:
    """id, name, p, needed: the properties of schema documents (column doc: JSON array text), own, of the
    members of allOf, and of all that allOf references lead to."""
    d = docs.select(F.explode(F.from_json("doc", SCHEMA_DOC)).alias("d")).select(F.col("d.`$id`").alias("id"), "d.properties", "d.required", "d.allOf")
    inline = d.select("id", F.explode("allOf").alias("x"))
    groups = d.select("id", "properties", "required").unionByName(inline.select("id", "x.properties", "x.required"))
    # A required name may be defined in another part.
    needed = groups.select("id", F.explode("required").alias("name")).distinct().withColumn("_needed", F.lit(True))
    own = groups.select("id", F.explode("properties").alias("name", "p"))
    refs = graph.closure_pairs(inline.where(F.col("x.`$ref`").isNotNull()).select(F.col("id").alias("a"), F.col("x.`$ref`").alias("b"))).where("a <> b")
    up = refs.select(F.col("a").alias("top"), F.col("b").alias("id"))
    reached = lambda df, *rest: df.select("id", *rest).unionByName(df.join(up, "id").select(F.col("top").alias("id"), *rest))
    must = reached(needed, "name", "_needed").distinct()
    return reached(own, "name", "p").join(must, ["id", "name"], "left").select("id", "name", "p", F.coalesce("_needed", F.lit(False)).alias("needed"))


def schema_catalog(docs: DataFrame) -> DataFrame:
    """targetClass, propertyPath and the constraint columns that a schema's keywords fill."""
    p = schema_properties(docs).groupBy("id", "name").agg(F.max("needed").alias("needed"), F.first("p").alias("p"))
    rel = F.col("p.relationship").isNotNull()
    return p.select(
        F.col("id").alias("targetClass"), F.col("name").alias("propertyPath"), F.coalesce("p.relationship").alias("propertyClass"), F.when(rel, "@id").otherwise("@value").alias("propertyNodetype"), F.when(rel, m.RELATIONSHIP).otherwise(m.PROPERTY).alias("attributeType"),
        F.when(F.col("needed"), "1").otherwise("0").alias("minCount"), F.lit("1").alias("maxCount"), F.col("p.exclusiveMinimum").alias("minExclusive"), F.col("p.exclusiveMaximum").alias("maxExclusive"), F.col("p.minimum").alias("minInclusive"), F.col("p.maximum").alias("maxInclusive"),
        "p.minLength", "p.maxLength", F.when(F.size("p.enum") > 0, F.array_join(F.transform("p.enum", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")).alias("ins"),
    )


def domain_range_catalog(docs: DataFrame) -> DataFrame:
    """subject, predicate, object: domain and range kind of each attribute."""
    p = schema_properties(docs).select("id", "name", F.col("p.relationship").isNotNull().alias("rel")).distinct()
    s = F.concat(F.lit("<"), "name", F.lit(">"))
    domain = p.select(s.alias("subject"), F.lit(m.DOMAIN).alias("predicate"), F.concat(F.lit("<"), "id", F.lit(">")).alias("object"))
    kind = p.select(s.alias("subject"), F.lit(m.RANGE).alias("predicate"), F.when(F.col("rel"), f"<{m.RELATIONSHIP}>").otherwise(f"<{m.PROPERTY}>").alias("object"))
    return domain.unionByName(kind).distinct()
