"""The supplied star-schema and event tables, projected into the entity and attribute model.

entities and attributes come from orders, customers, parts, suppliers, nations and
regions; events are a change log of attributes; classes and nations are triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.sources import buckets

START = "2020-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, by: str) -> DataFrame:
    """df, dealt out by a key into parts of a size, so that one file keeps all cores busy and no task's share grows with the table."""
    n = buckets.tasks(df)
    return df.repartition(n, by) if df.rdd.getNumPartitions() < n else df


def decimal_text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)").cast("string")


def _urn(kind: str, key: str) -> str:
    return f"concat('urn:{kind}:', cast({key} AS string))"


def _text(value: str | None) -> str:
    """A SQL string; none: null."""
    return "cast(NULL AS string)" if value is None else f"'{value}'"


def _decimal(column: str) -> str:
    return f"cast(cast({column} AS decimal(18,2)) AS string)"


_START = f"cast('{START}' AS timestamp)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current entities. Customers with a negative balance are logically deleted."""
    wide = ("orders", "customer", "part")
    rows = [
        ("orders", "order", "o_orderkey", "'Order'", "false", "o_orderdate"),
        ("customer", "customer", "c_custkey", "concat('Customer/', c_mktsegment)", "c_acctbal < 0", _START),
        ("part", "part", "p_partkey", "concat('Part/', p_type)", "false", _START),
        ("supplier", "supplier", "s_suppkey", "'Supplier'", "false", _START),
        ("nation", "nation", "n_nationkey", "'Nation'", "false", _START),
        ("region", "region", "r_regionkey", "'Region'", "false", _START),
    ]
    read = lambda name, by: spread(table(spark, sf_dir, name), by) if name in wide else table(spark, sf_dir, name)
    parts = [read(name, key).selectExpr(f"{_urn(kind, key)} AS id", f"{type_} AS type", f"{deleted} AS deleted", f"{ts} AS ts") for name, kind, key, type_, deleted, ts in rows]
    return reduce(DataFrame.unionByName, parts)


def _attributes(df: DataFrame, kind: str, key: str, ts: str, rows: list[tuple]) -> DataFrame:
    """Unpivot: one pass over df. rows: (name, node type, value type, attribute type, value, deleted, parent).

    Value and deleted are SQL, and so is a node type that isn't one name. SQL, because hundreds of
    column objects take seconds to build."""
    made = []
    for name, node, value_type, type_, value, deleted, parent in rows:
        node_type = _text(node) if node.startswith("@") else node
        made.append(f"named_struct('name', '{name}', 'nodeType', {node_type}, 'valueType', {_text(value_type)}, 'type', '{type_}', 'attributeValue', {value}, 'deleted', {deleted}, 'parent', {_text(parent)})")
    d = df.selectExpr(f"{_urn(kind, key)} AS entityId", f"{ts} AS ts", f"explode(array({', '.join(made)})) AS a")
    sep = r"'\\'"
    return d.selectExpr(
        f"CASE WHEN a.parent IS NULL THEN concat_ws({sep}, entityId, a.name) ELSE concat_ws({sep}, entityId, a.parent, a.name) END AS id",
        f"CASE WHEN a.parent IS NOT NULL THEN concat_ws({sep}, entityId, a.parent) END AS parentId", "entityId", "a.name", "a.nodeType", "a.valueType", "a.type", "a.attributeValue",
        "'@none' AS datasetId", "cast(NULL AS string) AS unitCode", "cast(NULL AS string) AS lang", "a.deleted", "true AS synced", "ts",
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current attributes, in the columns of model.ATTRIBUTES."""
    double, integer, string = (m.XSD + t for t in ("double", "integer", "string"))
    no = "false"
    orders = _attributes(spread(table(spark, sf_dir, "orders"), "o_orderkey"), "order", "o_orderkey", "o_orderdate", [
        ("totalPrice", "@value", double, m.PROPERTY, _decimal("o_totalprice"), no, None),
        ("currency", "@value", string, m.PROPERTY, "element_at(array('EUR', 'USD', 'usd'), cast(o_orderkey % 3 + 1 AS int))", no, "totalPrice"),
        ("status", "@value", string, m.PROPERTY, "o_orderstatus", no, None),
        ("priority", "@value", string, m.PROPERTY, "o_orderpriority", "o_orderkey % 10 = 9", None),
        ("placedBy", "@id", None, m.RELATIONSHIP, _urn("customer", "o_custkey"), no, None),
    ])
    customers = _attributes(spread(table(spark, sf_dir, "customer"), "c_custkey"), "customer", "c_custkey", _START, [
        ("acctBal", "@value", double, m.PROPERTY, _decimal("c_acctbal"), no, None),
        ("segment", "@id", None, m.PROPERTY, "concat('seg/', c_mktsegment)", no, None),
        ("livesIn", "@id", None, m.RELATIONSHIP, _urn("nation", "c_nationkey"), no, None),
    ])
    parts = _attributes(spread(table(spark, sf_dir, "part"), "p_partkey"), "part", "p_partkey", _START, [
        ("size", "@value", integer, m.PROPERTY, "CASE WHEN p_partkey % 9 = 8 THEN 'big' ELSE cast(p_size AS string) END", no, None),
        ("brand", "CASE WHEN p_partkey % 13 = 0 THEN '@id' ELSE '@value' END", string, m.PROPERTY, "p_brand", no, None),
        ("meta", "@json", None, m.JSON_PROPERTY, "CASE WHEN p_partkey % 7 = 0 THEN '[1]' ELSE concat('{\"size\":', cast(p_size AS string), '}') END", no, None),
        ("dims", "@list", None, m.LIST_PROPERTY, "CASE WHEN p_partkey % 11 = 0 THEN '{\"a\":1}' ELSE concat('[', cast(p_size AS string), ',2]') END", no, None),
    ])
    suppliers = _attributes(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", _START, [
        ("acctBal", "@value", double, m.PROPERTY, _decimal("s_acctbal"), no, None),
        ("livesIn", "@id", None, m.RELATIONSHIP, _urn("nation", "s_nationkey"), no, None),
    ])
    return reduce(DataFrame.unionByName, [orders, customers, parts, suppliers])


def attribute_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of user attributes, with event_id as offset."""
    e = table(spark, sf_dir, "events")
    user = F.concat(F.lit("urn:user:"), F.col("user_id").cast("string"))
    null = F.lit(None).cast("string")
    return e.select(
        F.concat_ws("\\", user, "event_type").alias("id"), null.alias("parentId"), user.alias("entityId"), F.col("event_type").alias("name"), F.lit("@value").alias("nodeType"), F.lit(m.XSD + "double").alias("valueType"), F.lit(m.PROPERTY).alias("type"),
        decimal_text("value").alias("attributeValue"), F.lit("@none").alias("datasetId"), null.alias("unitCode"), null.alias("lang"), (F.col("event_id") % 17 == 0).alias("deleted"), (F.col("event_id") % 2 == 0).alias("synced"), "ts", F.col("event_id").alias("offset"),
    )


def rdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge triples: class trees of the entity types, segments, and nations as parts of regions."""
    iri = lambda x: f"concat('<', {x}, '>')"
    row = lambda df, s, p, o: df.selectExpr(f"{s} AS subject", f"'{p}' AS predicate", f"{o} AS object")
    part, customer, nation, region = (table(spark, sf_dir, t) for t in ("part", "customer", "nation", "region"))
    segments = customer.select("c_mktsegment").distinct()
    of_nation, of_region = (iri(_urn(kind, key)) for kind, key in (("nation", "n_nationkey"), ("region", "n_regionkey")))
    rows = [
        row(part.select("p_type").distinct(), iri("concat('Part/', p_type)"), m.SUBCLASS, "'<Part>'"),
        row(segments, iri("concat('Customer/', c_mktsegment)"), m.SUBCLASS, "'<Customer>'"),
        row(segments.where("c_mktsegment <> 'FURNITURE'"), iri("concat('seg/', c_mktsegment)"), m.RDF_TYPE, "'<Segment>'"),
        row(nation, of_nation, "<partOf>", of_region),
        row(region, iri(_urn("region", "r_regionkey")), "<partOf>", "'<urn:world>'"),
        spark.createDataFrame(FIXED_TRIPLES, "subject string, predicate string, object string"),
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("index", F.lit(0))


#: The upper classes, and a label list over blank nodes.
FIXED_TRIPLES = [
    ("<Part>", m.SUBCLASS, "<Item>"),
    ("<Item>", m.SUBCLASS, "<Thing>"),
    ("<Customer>", m.SUBCLASS, "<Party>"),
    ("<Supplier>", m.SUBCLASS, "<Party>"),
    ("<Party>", m.SUBCLASS, "<Thing>"),
    ("<Order>", m.SUBCLASS, "<Document>"),
    ("<partOf>", m.RDF_TYPE, m.TRANSITIVE),
    ("<Order>", "<label>", "_:l1"),
    ("_:l1", m.RDF_FIRST, '"order"'),
    ("_:l1", m.RDF_REST, "_:l2"),
    ("_:l2", m.RDF_FIRST, '"Auftrag"'),
    ("_:l2", m.RDF_REST, m.RDF_NIL),
]

#: Constraints, as (id, {column: value}).
_D, _I, _S = (m.XSD + t for t in ("double", "integer", "string"))
CONSTRAINT_ROWS = [
    (1, {"targetClass": "Order", "propertyPath": "totalPrice", "propertyNodetype": "@value", "attributeType": m.PROPERTY, "minCount": "1", "maxCount": "1", "severity": "warning", "minExclusive": "5000", "maxExclusive": "480000", "minInclusive": "8000", "maxInclusive": "450000", "datatypes": _D}),
    (2, {"targetClass": "Order", "propertyPath": "priority", "propertyNodetype": "@value", "attributeType": m.PROPERTY, "minCount": "1", "severity": "critical", "minLength": "6", "maxLength": "10", "pattern": "^[1-3]-", "ins": '"1-URGENT","2-HIGH","3-MEDIUM"', "datatypes": _S}),
    (3, {"targetClass": "Order", "propertyPath": "placedBy", "propertyClass": "Customer", "attributeType": m.RELATIONSHIP, "minCount": "1", "maxCount": "1", "severity": "major"}),
    (4, {"targetClass": "Order", "propertyPath": "totalPrice", "subpropertyPath": "currency", "propertyNodetype": "@value", "attributeType": m.PROPERTY, "severity": "minor", "pattern": "^[A-Z]{3}$", "ins": '"EUR","USD"', "maxLength": "2"}),
    (5, {"targetClass": "Customer", "propertyPath": "acctBal", "propertyNodetype": "@value", "attributeType": m.PROPERTY, "minCount": "1", "severity": "warning", "minInclusive": "1000"}),
    (6, {"targetClass": "Customer/FURNITURE", "propertyPath": "segment", "propertyClass": "Segment", "propertyNodetype": "@id", "attributeType": m.PROPERTY, "severity": "warning"}),
    (7, {"targetClass": "Part/PROMO", "propertyPath": "size", "propertyNodetype": "@value", "attributeType": m.PROPERTY, "severity": "warning", "maxInclusive": "45", "datatypes": _I}),
    (8, {"targetClass": "Part/PROMO", "propertyPath": "meta", "propertyNodetype": "@json", "attributeType": m.JSON_PROPERTY, "severity": "warning"}),
    (9, {"targetClass": "Part/PROMO", "propertyPath": "dims", "propertyNodetype": "@list", "attributeType": m.LIST_PROPERTY, "severity": "warning"}),
    (10, {"targetClass": "Part/PROMO", "propertyPath": "brand", "propertyNodetype": "@value", "attributeType": m.PROPERTY, "severity": "major", "hasValue": "Brand#13"}),
    (11, {"targetClass": "Part/PROMO", "propertyPath": "warranty", "propertyNodetype": "@value", "attributeType": m.PROPERTY, "minCount": "1", "severity": "minor"}),
    (12, {"targetClass": "Supplier", "propertyPath": "livesIn", "propertyClass": "Nation", "attributeType": m.RELATIONSHIP, "minCount": "0", "maxCount": "0", "severity": "minor"}),
    (13, {"targetClass": "Order", "propertyPath": "status", "propertyNodetype": "@value", "attributeType": m.PROPERTY, "severity": "warning", "hasValue": "O"}),
    (14, {"targetClass": "Order", "propertyPath": "priority", "propertyNodetype": "@id", "attributeType": m.RELATIONSHIP, "severity": "minor", "propertyClass": "Priority"}),
    (100, {"targetClass": "Order", "severity": "critical"}),
]
#: Fixed values: (member, operation, target); 100 stands for "10 and 13 both fire", the others publish.
COMBINATION_ROWS = [(i, "PUBLISH", i) for i in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)] + [(2, "OR", 100), (13, "OR", 100), (100, "PUBLISH", 100)]


def _fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed rows, as SQL: so a plan knows how few they are, and deals out no table for a join with them."""
    sql = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = [c.split(" ") for c in schema.split(", ")]
    made = ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'cast({name} AS {kind}) AS {name}' for name, kind in columns)} FROM VALUES {made} AS t({', '.join(name for name, _ in columns)})")


def constraints(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return _fixed(spark, [(i, *(row.get(c) for c in m.CONSTRAINT_COLUMNS)) for i, row in CONSTRAINT_ROWS], m.CONSTRAINTS)


def combinations(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return _fixed(spark, COMBINATION_ROWS, m.COMBINATIONS)
