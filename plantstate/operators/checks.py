"""Constraint checks: constraints are rows, joined to entities and attributes; violations are rows.

All property checks share one base and are made in one pass: each base row gives an
array of its violations, which is exploded. Only counts group. compat=True brings back
known oddities of the rules' original form: counts of 0 or 1 only, and range checks
that also fire on deleted attributes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.functions.terms import json_array_test, json_object_test
from plantstate.sources import buckets

PROPERTY_KINDS = (m.PROPERTY, m.LIST_PROPERTY, m.JSON_PROPERTY)


def inherited(constraints: DataFrame, closure: DataFrame) -> DataFrame:
    """Constraints of a class also for its subclasses. closure: closed subClassOf triples."""
    pairs = closure.where((F.col("predicate") == m.SUBCLASS) & (F.col("subject") != F.col("object")))
    bare = lambda c: F.regexp_replace(c, "^<(.*)>$", "$1")
    subs = pairs.select(bare("object").alias("targetClass"), bare("subject").alias("sub"))
    down = constraints.join(subs, "targetClass").drop("targetClass").withColumnRenamed("sub", "targetClass")
    return constraints.unionByName(down.select(*constraints.columns)).distinct()


def _index(dataset: str) -> Column:
    return F.when(F.col(dataset) == "@none", "0").otherwise(F.col(dataset))


def _base(entities: DataFrame, attributes: DataFrame, constraints: DataFrame, live_only: bool) -> DataFrame:
    a = attributes.where(~F.coalesce("deleted", F.lit(False))) if live_only else attributes
    e = entities.select(F.col("id").alias("this"), F.col("type").alias("typ"), F.coalesce("deleted", F.lit(False)).alias("edeleted"))
    c = constraints.withColumnRenamed("id", "constraint_id").withColumnRenamed("targetClass", "typ")
    fields = ("nodeType", "valueType", "type", "attributeValue", "datasetId", "deleted")
    top = a.where(F.col("parentId").isNull()).select(F.col("entityId").alias("b_entity"), F.col("name").alias("b_name"), F.col("id").alias("b_id"), *[F.col(x).alias(f"b_{x}") for x in fields])
    sub = a.where(F.col("parentId").isNotNull()).select(F.col("entityId").alias("e_entity"), F.col("name").alias("e_name"), F.col("parentId").alias("e_parent"), F.col("id").alias("e_id"), *[F.col(x).alias(f"e_{x}") for x in fields])
    # Both sides of a join are dealt by its keys into parts by size, so that a task's rows do not grow with the tables.
    # Not fewer than shuffles have, as those of a join would be dealt once more.
    n = max(buckets.tasks(attributes), int(attributes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    top, sub = top.repartition(n, "b_entity", "b_name"), sub.repartition(n, "e_entity", "e_name", "e_parent")
    rows = e.join(c, "typ").repartition(n, "this", "propertyPath").join(top, (F.col("b_entity") == F.col("this")) & (F.col("b_name") == F.col("propertyPath")), "left")
    rows = rows.repartition(n, "this", "subpropertyPath", "b_id").join(sub, (F.col("e_entity") == F.col("this")) & (F.col("e_name") == F.col("subpropertyPath")) & (F.col("e_parent") == F.col("b_id")), "left")
    rows = rows.where(F.col("subpropertyPath").isNull() | F.col("e_id").isNotNull())
    path = F.coalesce("subpropertyPath", "propertyPath")
    rows = rows.withColumn("parentPath", F.when(F.col("subpropertyPath").isNull(), "").otherwise(F.concat("propertyPath", F.lit("["), _index("b_datasetId"), F.lit("] ==> "))))
    rows = rows.withColumns({x: F.coalesce(f"e_{x}", f"b_{x}") for x in fields})
    rows = rows.withColumns({"path": path, "printPath": F.concat(path, F.lit("["), _index("datasetId"), F.lit("]"))})
    return rows.drop("b_entity", "b_name", "b_id", "e_entity", "e_name", "e_parent", "e_id", *[f"{p}_{x}" for p in "be" for x in fields])


def check_base_rel(entities: DataFrame, attributes: DataFrame, constraints: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Each entity and relationship constraint of its type, with the live attribute and the live entity that it points to (found).

    targets: the entities that may be pointed to, if others than those that are checked."""
    rows = _base(entities, attributes, constraints.where(F.col("attributeType") == m.RELATIONSHIP), live_only=True)
    there = (entities if targets is None else targets).where(~F.coalesce("deleted", F.lit(False))).select(F.col("id").alias("attributeValue"), F.col("type").alias("found"))
    return rows.join(there, "attributeValue", "left")


def check_base_prop(entities: DataFrame, attributes: DataFrame, constraints: DataFrame, rdf: DataFrame) -> DataFrame:
    """The same for properties; found: the class of an IRI value, if triples say that it is of the class required."""
    rows = _base(entities, attributes, constraints.where(F.col("attributeType").isin(*PROPERTY_KINDS)), live_only=False)
    types = rdf.where(F.col("predicate") == m.RDF_TYPE).select(F.regexp_replace("subject", "^<(.*)>$", "$1").alias("attributeValue"), F.regexp_replace("object", "^<(.*)>$", "$1").alias("propertyClass"), F.col("object").alias("found")).distinct()
    return rows.join(types, ["attributeValue", "propertyClass"], "left")


#: Parts of entities for each of buckets.tasks(): constraints make several rows of an attribute. So many are few.
PARTS, FEW = 4, 64
#: Columns of constraints that only checks of properties look at.
VALUES = ("propertyNodetype", "minExclusive", "maxExclusive", "minInclusive", "maxInclusive", "minLength", "maxLength", "pattern", "ins", "datatypes", "hasValue")
FIELDS = ("nodeType", "valueType", "type", "attributeValue", "datasetId", "deleted")


def _parts(attributes: DataFrame) -> int:
    """Parts that entities are dealt into: not fewer than shuffles have, as those of a join would be dealt once more; and none of the
    numbers for which every task opens a file for each part, unless there are few parts."""
    spark = attributes.sparkSession
    n = max(PARTS * buckets.tasks(attributes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return n if n <= FEW else max(n, int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200")) + 1)


def _about(attributes: DataFrame, c: DataFrame, n: int) -> DataFrame:
    """The attributes that constraints are about, one row each: b_entity, b_name, b_sub (the name of a nested one, b_name being
    that of the one above it), b_index (the dataset of the one above) and the fields. Others are left out before anything is dealt."""
    names = lambda nested, column, name: c.where(F.col("subpropertyPath").isNotNull() == nested).select(F.col(column).alias(name)).distinct()
    none = F.lit(None).cast("string")
    top = attributes.where("parentId is null").select(F.col("entityId").alias("b_entity"), F.col("name").alias("b_name"), F.col("id").alias("b_id"), *FIELDS)
    sub = attributes.where("parentId is not null").select(F.col("entityId").alias("e_entity"), F.col("name").alias("b_sub"), F.col("parentId").alias("e_parent"), *[F.col(x).alias(f"e_{x}") for x in FIELDS])
    plain = top.join(names(False, "propertyPath", "b_name"), "b_name", "left_semi").select("b_entity", "b_name", none.alias("b_sub"), none.alias("b_index"), *FIELDS)
    above = top.join(names(True, "propertyPath", "b_name"), "b_name", "left_semi").repartition(n, "b_entity", "b_id")
    below = sub.join(names(True, "subpropertyPath", "b_sub"), "b_sub", "left_semi").repartition(n, "e_entity", "e_parent")
    nested = above.join(below, (F.col("b_entity") == F.col("e_entity")) & (F.col("b_id") == F.col("e_parent")))
    return plain.unionByName(nested.select("b_entity", "b_name", "b_sub", F.col("datasetId").alias("b_index"), *[F.coalesce(f"e_{x}", x).alias(x) for x in FIELDS]))


def _by_entity(entities: DataFrame, attributes: DataFrame, constraints: DataFrame, rdf: DataFrame, targets: DataFrame | None) -> DataFrame:
    """The rows of check_base_rel() and check_base_prop() in one, for checks: each entity and constraint with its attributes, and a
    row without one for each that has counts, which adds nothing to a count and lets no other check fire.

    Entities and attributes are dealt by the entity once, into parts by size, and constraints are joined to what lies there: of a
    base row no more than its attribute is dealt out, and what is grouped by entity later is not dealt again."""
    n = _parts(attributes)
    c = constraints.where(F.col("attributeType").isin(m.RELATIONSHIP, *PROPERTY_KINDS)).withColumnRenamed("id", "constraint_id").withColumnRenamed("targetClass", "typ")
    rel, live = F.col("attributeType") == m.RELATIONSHIP, ~F.coalesce("deleted", F.lit(False))
    there = (entities if targets is None else targets).where(live).select(F.col("id").alias("attributeValue"), F.col("type").alias("b_found"))
    # Rows and constraints meet by a key: the kind and path, or none for counts.
    key = lambda kind, name: F.concat(F.lit(kind), name)
    bare = lambda column: F.regexp_replace(column, "^<(.*)>$", "$1")
    types = rdf.where(F.col("predicate") == m.RDF_TYPE).select(bare("subject").alias("attributeValue"), bare("object").alias("propertyClass"))
    types = types.join(c.where(~rel).select("propertyClass").distinct(), "propertyClass", "left_semi").groupBy("attributeValue").agg(F.collect_set("propertyClass").alias("b_classes"))
    properties = _about(attributes, c.where(~rel), n).join(types, "attributeValue", "left").withColumn("b_key", key("p:", "b_name"))
    links = _about(attributes.where(live), c.where(rel), n).join(there, "attributeValue", "left").withColumn("b_key", key("r:", "b_name"))
    e = entities.select(F.col("id").alias("this"), F.col("type").alias("typ"), F.coalesce("deleted", F.lit(False)).alias("edeleted")).join(c.select("typ").distinct(), "typ", "left_semi")
    counted = F.col("subpropertyPath").isNull() & (F.col("minCount").isNotNull() | F.col("maxCount").isNotNull())
    none = e.join(c.where(counted).select("typ").distinct(), "typ", "left_semi").select(F.col("this").alias("b_entity"))
    own = properties.unionByName(links, allowMissingColumns=True).drop("b_name").unionByName(none, allowMissingColumns=True).repartition(n, "b_entity")
    rows = e.repartition(n, "this").join(own, F.col("b_entity") == F.col("this"), "left").drop("b_entity").withColumn("b_key", F.coalesce("b_key", F.lit("")))
    # Relationships have no values to check.
    asked = c.withColumns({x: F.when(~rel, F.col(x)) for x in VALUES}).withColumn("b_key", F.when(rel, key("r:", "propertyPath")).otherwise(key("p:", "propertyPath"))).unionByName(c.where(counted).withColumn("b_key", F.lit("")))
    rows = rows.join(asked.withColumnRenamed("typ", "c_typ").withColumnRenamed("b_key", "c_key"), (F.col("typ") == F.col("c_typ")) & (F.col("b_key") == F.col("c_key")) & F.col("b_sub").eqNullSafe(F.col("subpropertyPath")))
    rows = rows.withColumn("found", F.coalesce("b_found", F.when(F.array_contains("b_classes", F.col("propertyClass")), F.col("propertyClass"))))
    return rows


def _paths() -> dict[str, Column]:
    """The paths of a row of _by_entity(), which rows that fired are said by."""
    path = F.coalesce("subpropertyPath", "propertyPath")
    above = F.when(F.col("subpropertyPath").isNull(), "").otherwise(F.concat("propertyPath", F.lit("["), _index("b_index"), F.lit("] ==> ")))
    return {"path": path, "parentPath": above, "printPath": F.concat(path, F.lit("["), _index("datasetId"), F.lit("]"))}


#: Conditions are SQL text where they can be: column objects by the hundred take seconds to build.
_LIVE = "NOT edeleted AND NOT coalesce(deleted, false) AND type IS NOT NULL AND datasetId IS NOT NULL"


def _live() -> Column:
    return F.expr(_LIVE)


def _part(p: str) -> str:
    """SQL of a part of a text: those that begin with a quote are plain text, others SQL, NULL where it is null."""
    return "'" + p[1:].replace("\\", "\\\\").replace("'", "\\'") + "'" if p.startswith("'") else f"coalesce({p}, 'NULL')"


def _text(*parts: str) -> Column:
    """Parts in a row."""
    return F.expr("concat(" + ", ".join(map(_part, parts)) + ")")


def _of_check(values: Sequence[str]) -> str:
    """SQL of one value for each check: that of check number _n; null for other numbers."""
    if all(v.startswith("'") for v in values):
        return f"get(array({', '.join(values)}), _n)"
    numbers = {v: ", ".join(str(i) for i, w in enumerate(values) if w == v) for v in values}
    return "CASE " + " ".join(f"WHEN _n IN ({n}) THEN {v}" for v, n in numbers.items()) + " END"


def _said(asked: Sequence[tuple]) -> tuple[Column, Column]:
    """Event and text of check number _n, of which each part is looked up: with a text of its own for each check, the code
    that is made of the plan is longer than what the JVM compiles."""
    components, paths = zip(*[event for _, event, _ in asked])
    event = ", ".join([_of_check([f"'{c}('" for c in components]), "parentPath", _of_check(paths), "')'"])
    text = ", ".join(_of_check([_part(p) for p in slot]) for slot in zip_longest(*[t for _, _, t in asked], fillvalue="'"))
    return F.expr(f"concat({event})"), F.expr(f"concat({text})")


def _event(component: str, path: str = "printPath") -> tuple[str, str]:
    return component, path


RANGES = ("minExclusive", "maxExclusive", "minInclusive", "maxInclusive")


def _range(column: str, op: str, compat: bool) -> Column:
    # Asked for in all conditions, a text is read as a number once and before them, also where none needs it: with an exception if it is none.
    number = f"CASE WHEN coalesce({', '.join(RANGES)}) IS NOT NULL THEN try_cast(attributeValue AS double) END"
    fits = f"{number} {op} try_cast({column} AS double)"
    seen = _LIVE if not compat else "type IS NOT NULL AND datasetId IS NOT NULL"
    return F.expr(f"{column} IS NOT NULL AND {seen} AND NOT coalesce({fits}, false)")


def _datatype() -> Column:
    of = lambda t: f"contains(datatypes, '{m.XSD}{t}') AND coalesce(valueType, '{m.XSD}{t}') = '{m.XSD}{t}'"
    fits = " OR ".join([
        f"({of('double')} AND attributeValue RLIKE r'^(?:0|[+-]?(?:\\d+\\.\\d*|\\.\\d+|\\d+[eE][+-]?\\d+))$')",
        f"({of('integer')} AND attributeValue RLIKE r'^[+-]?\\d+$')",
        f"({of('boolean')} AND lower(attributeValue) IN ('true', 'false'))",
        f"({of('string')})",
    ])
    return F.expr(f"datatypes IS NOT NULL AND propertyNodetype = '@value' AND (attributeValue IS NULL OR (datatypes RLIKE '#(double|boolean|integer|string)' AND NOT coalesce({fits}, false)))")


def _has_value() -> Column:
    cast = lambda t: f"try_cast(attributeValue AS {t}) <> try_cast(hasValue AS {t})"
    differs = f"CASE valueType WHEN '{m.XSD}double' THEN {cast('double')} WHEN '{m.XSD}integer' THEN {cast('bigint')} WHEN '{m.XSD}boolean' THEN lower(attributeValue) <> lower(hasValue) ELSE attributeValue <> hasValue END"
    return F.expr(f"hasValue IS NOT NULL AND coalesce({differs}, false)")


def property_checks(compat: bool = False) -> dict[str, tuple[Column, tuple[str, str], tuple[str, ...]]]:
    """Row checks over check_base_prop(): name -> (condition, component and path of the event, parts of the text)."""
    start = ("'Model validation for property ", "path", "' failed for ", "this", "'. ")
    said = lambda *rest: (*start, *rest)
    found = F.coalesce(F.array_contains(F.split(F.regexp_replace("ins", '^"|"$', ""), '"\\s*,\\s*"'), F.col("attributeValue")), F.lit(False))
    checks = {
        "chk_prop_class": ((F.col("propertyNodetype") == "@id") & F.col("propertyClass").isNotNull() & _live() & F.col("found").isNull(), _event("DatatypeConstraintComponent"), said("'Value ", "attributeValue", "' is not of type ", "propertyClass", "'.")),
        "chk_prop_nodekind": (F.col("propertyNodetype").isNotNull() & _live() & ((F.col("nodeType") != F.col("propertyNodetype")) | (F.col("type") != F.col("attributeType"))), _event("NodeKindConstraintComponent"), said("'Node type ", "nodeType", "' or attribute type ", "type", "' is not the required one.")),
        "chk_min_length": (F.col("minLength").isNotNull() & _live() & (F.char_length("attributeValue") < F.col("minLength").cast("int")), _event("MinLengthConstraintComponent"), said("'Length of ", "attributeValue", "' is < ", "minLength", "'.")),
        "chk_max_length": (F.col("maxLength").isNotNull() & _live() & (F.char_length("attributeValue") > F.col("maxLength").cast("int")), _event("MaxLengthConstraintComponent"), said("'Length of ", "attributeValue", "' is > ", "maxLength", "'.")),
        "chk_pattern": (F.col("pattern").isNotNull() & _live() & ~F.expr("attributeValue rlike pattern"), _event("PatternConstraintComponent"), said("'Value ", "attributeValue", "' does not match ", "pattern", "'.")),
        "chk_in": (F.col("ins").isNotNull() & _live() & ~found, _event("InConstraintComponent"), said("'Value ", "attributeValue", "' is not allowed.")),
        "chk_datatype_literal": (_live() & _datatype(), _event("DatatypeConstraintComponent"), said("'Value ", "attributeValue", "' is not of ", "datatypes", "'.")),
        "chk_datatype_json": ((F.col("propertyNodetype") == "@json") & _live() & ~F.coalesce(F.when(F.col("propertyNodetype") == "@json", json_object_test(F.col("attributeValue"))), F.lit(False)), _event("DatatypeConstraintComponent"), said("'Value ", "attributeValue", "' is not a JSON object.")),
        "chk_datatype_list": ((F.col("propertyNodetype") == "@list") & _live() & ~F.coalesce(F.when(F.col("propertyNodetype") == "@list", json_array_test(F.col("attributeValue"))), F.lit(False)), _event("DatatypeConstraintComponent"), said("'Value ", "attributeValue", "' is not a JSON array.")),
        "chk_has_value": (_live() & _has_value(), _event("HasValueConstraintComponent", "path"), said("'Value ", "attributeValue", "' is not ", "hasValue", "'.")),
    }
    for name, component, column, op in (("chk_min_exclusive", "MinExclusive", "minExclusive", ">"), ("chk_max_exclusive", "MaxExclusive", "maxExclusive", "<"), ("chk_min_inclusive", "MinInclusive", "minInclusive", ">="), ("chk_max_inclusive", "MaxInclusive", "maxInclusive", "<=")):
        checks[name] = (_range(column, op, compat), _event(f"{component}ConstraintComponent"), said("'Value ", "attributeValue", f"' is not {op} ", column, "'."))
    return checks


def relationship_checks() -> dict[str, tuple[Column, tuple[str, str], tuple[str, ...]]]:
    """Row checks over check_base_rel()."""
    start = ("'Model validation for relationship ", "path", "' failed for ", "this", "'. ")
    return {
        "chk_rel_class": (F.col("propertyClass").isNotNull() & _live() & F.col("found").isNull(), _event("ClassConstraintComponent"), (*start, "'No entity of type ", "propertyClass", "' is linked.")),
        "chk_rel_nodekind": (_live() & ((F.col("nodeType") != "@id") | (F.col("type") != F.col("attributeType"))), _event("NodeKindConstraintComponent"), (*start, "'Node type ", "nodeType", "' is not an IRI or type is not a relationship.")),
    }


def _fired(base: DataFrame, conditions: dict[int, Column]) -> DataFrame:
    """A row of base, with number _n, for each condition that it fulfils.

    They are looked at once and kept as bits: an array would be made by interpreted expressions, and its size asked for before."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(cond, 1 << k).otherwise(0) for k, cond in enumerate(conditions.values())])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(1 << k).alias("bit")) for k, n in enumerate(conditions)]))
    return base.withColumn("_bits", bits).withColumn("_c", each).where(F.col("_bits").bitwiseAND(F.col("_c.bit")) != 0).withColumn("_n", F.col("_c.n"))


def row_checks(base: DataFrame, checks: dict[str, tuple[Column, tuple[str, str], tuple[str, ...]]], names: Sequence[str] | None = None) -> DataFrame:
    """resource, event, constraint_id, triggered, severity, text for the violations of some checks, in one pass over base."""
    asked = [checks[n] for n in (names or checks)]
    # Events and texts are made of the rows that are left.
    rows = _fired(base, {i: cond for i, (cond, _, _) in enumerate(asked)})
    event, text = _said(asked)
    return rows.select(F.col("this").alias("resource"), event.alias("event"), "constraint_id", F.lit(True).alias("triggered"), "severity", text.alias("text"))


def _count_said(kind: str) -> tuple[Column, Column]:
    """Event and text of a number of values out of its bounds."""
    text = _text(f"'Model validation for {kind} ", "path", "' failed for ", "this", "'. Found ", "cast(found AS string)", "' instead of [", "coalesce(minCount, '0')", "', ", "coalesce(maxCount, '*')", "'].")
    return F.expr("concat('CountConstraintComponent(', parentPath, path, ')')"), text


def count_check(base: DataFrame, kind: str, compat: bool = False) -> DataFrame:
    """Violations of minCount (0 if missing) and maxCount per entity and path."""
    counted = base.where((F.col("minCount").isNotNull() | F.col("maxCount").isNotNull()) & ~F.col("edeleted"))
    one = F.when(~F.coalesce("deleted", F.lit(False)) & F.col("type").isNotNull(), 1).otherwise(0)
    found = (F.sum_distinct(one) if compat else F.sum(one)).alias("found")
    groups = counted.groupBy("this", "path", "minCount", "maxCount", "severity", "constraint_id", "parentPath").agg(found)
    bad = groups.where((F.col("found") > F.col("maxCount").cast("int")) | (F.col("found") < F.coalesce(F.col("minCount").cast("int"), F.lit(0))))
    event, text = _count_said(kind)
    return bad.select(F.col("this").alias("resource"), event.alias("event"), "constraint_id", F.lit(True).alias("triggered"), "severity", text.alias("text"))


def _all_checks(base: DataFrame, checks: dict[str, tuple[Column, tuple[str, str], tuple[str, ...]]], kind: str | None, compat: bool = False) -> DataFrame:
    """row_checks() and count_check() of base in one pass and one grouping; nothing is written in between. kind: none for a base of both
    kinds, as _by_entity() gives it: what is not compiled into the method that all rows go through is left to those that fired.

    A row of base gives a row for each check that fires, and one to be counted. Both are summed
    before the shuffle: violations by their event and text, counts by entity, path and constraint."""
    asked = list(checks.values())
    bounds = (F.col("minCount").isNotNull() | F.col("maxCount").isNotNull()) & ~F.col("edeleted")
    rows = _fired(base, {-1: bounds, **{i: cond for i, (cond, _, _) in enumerate(asked)}})
    rows = rows if kind else rows.withColumns(_paths())
    counts = F.col("_n") == -1
    event, text = _said(asked)
    one = F.when(counts & ~F.coalesce("deleted", F.lit(False)) & F.col("type").isNotNull(), 1).otherwise(0)
    of_counts = ("path", "parentPath", "minCount", "maxCount", *(() if kind else ("attributeType",)))
    rows = rows.select("this", "constraint_id", "severity", "_n", event.alias("_event"), text.alias("_text"), one.alias("_one"), *[F.when(counts, F.col(c)).alias(c) for c in of_counts])
    keys = ("this", "constraint_id", "severity", "_n", "_event", "_text", *of_counts)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("times"), (F.sum_distinct("_one") if compat else F.sum("_one")).alias("found"))
    bad = (F.col("found") > F.col("maxCount").cast("int")) | (F.col("found") < F.coalesce(F.col("minCount").cast("int"), F.lit(0)))
    # Violations that are alike stay as many rows as they were.
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.when(counts, 1).otherwise(F.col("times"))))
    rows = sums.where(~counts | bad).withColumn("_each", each)
    if kind:
        count_event, count_text = _count_said(kind)
    else:
        (count_event, of_rel), (_, of_prop) = _count_said("relationship"), _count_said("property")
        count_text = F.when(F.col("attributeType") == m.RELATIONSHIP, of_rel).otherwise(of_prop)
    return rows.select(F.col("this").alias("resource"), F.when(counts, count_event).otherwise(F.col("_event")).alias("event"), "constraint_id", F.lit(True).alias("triggered"), "severity", F.when(counts, count_text).otherwise(F.col("_text")).alias("text"))


def chk_all_rel(base: DataFrame) -> DataFrame:
    """All relationship checks and the counts, in one pass over the base."""
    return _all_checks(base, relationship_checks(), "relationship")


def chk_all_prop(base: DataFrame, compat: bool = False) -> DataFrame:
    """All property checks, likewise."""
    return _all_checks(base, property_checks(compat), "property", compat)


def all_checks(entities: DataFrame, attributes: DataFrame, constraints: DataFrame, rdf: DataFrame, targets: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """chk_all_rel() and chk_all_prop() of entities (one row for each id), which are dealt out with their attributes once. The
    result lies by resource.

    targets: the entities that may be pointed to, if others than those that are checked."""
    base = _by_entity(entities, attributes, constraints, rdf, targets)
    rel = F.col("attributeType") == m.RELATIONSHIP
    kinds = {name: (rel & cond, *said) for name, (cond, *said) in relationship_checks().items()} | property_checks(compat)
    return _all_checks(base, kinds, None, compat)


def named_by(constraints: DataFrame, combinations: DataFrame, operations: Sequence[str] = ("OR", "PUBLISH")) -> DataFrame:
    """The constraints whose violations some operations ask for; those of others need not be looked for."""
    members = combinations.where(F.col("operation").isin(*operations)).select(F.col("member_constraint_id").alias("id"))
    return constraints.join(members.distinct(), "id", "left_semi")


def combine_or(triggers: DataFrame, combinations: DataFrame, constraints: DataFrame) -> DataFrame:
    """Alternatives: a target fires for a resource if all its members fired; else its row is ok."""
    members = combinations.where("operation = 'OR'").select(F.col("member_constraint_id").alias("constraint_id"), "target_constraint_id")
    needed = members.groupBy("target_constraint_id").agg(F.count("*").alias("needed"))
    fired = triggers.join(members, "constraint_id").groupBy("resource", "target_constraint_id").agg(F.size(F.collect_set(F.when(F.col("triggered"), F.col("constraint_id")))).cast("long").alias("fired"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("triggered"), F.col("text")))), " AND ").alias("texts"))
    c = constraints.select(F.col("id").alias("target_constraint_id"), "severity")
    rows = fired.join(needed, "target_constraint_id").join(c, "target_constraint_id").withColumn("triggered", F.col("needed") == F.col("fired"))
    return rows.select("resource", F.concat(F.lit("OR Constraint id "), F.col("target_constraint_id").cast("string")).alias("event"), F.col("target_constraint_id").alias("constraint_id"), "triggered", F.when(F.col("triggered"), F.col("severity")).otherwise("ok").alias("severity"), F.when(F.col("triggered"), F.col("texts")).otherwise("All ok").alias("text"))


def publish_alerts(triggers: DataFrame, combinations: DataFrame) -> DataFrame:
    """Alerts of those triggers whose constraint is published."""
    published = combinations.where("operation = 'PUBLISH'").select(F.col("member_constraint_id").alias("constraint_id"))
    rows = triggers.join(published, "constraint_id").groupBy("resource", "event").agg(F.max("severity").alias("severity"), F.max("text").alias("text"))
    return rows.select("resource", "event", F.lit("Development").alias("environment"), F.array(F.lit("SHACL Validator")).alias("service"), "severity", F.lit("customer").alias("customer"), "text")


def alerts(triggers: DataFrame, combinations: DataFrame, constraints: DataFrame) -> DataFrame:
    """publish_alerts() of triggers (of checks) and of their combine_or(), in one grouping, so that triggers are made once and not
    written, and are not dealt out where they lie by resource."""
    published = combinations.where("operation = 'PUBLISH'").select(F.col("member_constraint_id").alias("constraint_id")).distinct()
    members = combinations.where("operation = 'OR'").select(F.col("member_constraint_id").alias("constraint_id"), F.col("target_constraint_id").alias("target"))
    # What is known of a target, by a union: a join is taken for as large as the product of its sides, and no longer sent to where rows lie.
    known = [members.select("target", F.lit(1).alias("n")), published.select(F.col("constraint_id").alias("target"), F.lit(True).alias("p")), constraints.select(F.col("id").alias("target"), F.lit(True).alias("c"), F.col("severity").alias("_severity"))]
    targets = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), known).groupBy("target").agg(F.sum("n").alias("_needed"), F.max("_severity").alias("_severity"), F.max("p").alias("p"), F.max("c").alias("c")).where("p and c").drop("p", "c")
    rows = triggers.join(published.unionByName(members.distinct().join(targets, "target"), allowMissingColumns=True), "constraint_id")
    own = F.col("target").isNull()
    member = lambda c: F.collect_set(F.when(~own & F.col("triggered"), F.col(c)))
    rows = rows.withColumn("event", F.when(own, F.col("event"))).groupBy("resource", "target", "event").agg(F.max("severity").alias("severity"), F.max("text").alias("text"), member("constraint_id").alias("_fired"), member("text").alias("_texts"), F.max("_needed").alias("_needed"), F.max("_severity").alias("_severity"))
    all_fired = F.size("_fired") == F.col("_needed")
    event = F.when(own, F.col("event")).otherwise(F.concat(F.lit("OR Constraint id "), F.col("target").cast("string"))).alias("event")
    severity = F.when(own, F.col("severity")).when(all_fired, F.col("_severity")).otherwise("ok").alias("severity")
    text = F.when(own, F.col("text")).when(all_fired, F.array_join(F.sort_array("_texts"), " AND ")).otherwise("All ok").alias("text")
    return rows.select("resource", event, F.lit("Development").alias("environment"), F.array(F.lit("SHACL Validator")).alias("service"), severity, F.lit("customer").alias("customer"), text)
