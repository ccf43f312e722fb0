"""Queries of the constraint checks, rules and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.operators import checks, graph, patterns, rules
from plantstate.plans import base_sql as b
from plantstate.plans.registry import query
from plantstate.sources import adapter


def shapes(spark: SparkSession, d: str) -> DataFrame:
    classes = adapter.rdf(spark, d).where(F.col("predicate") == m.SUBCLASS)
    return graph.cut(checks.inherited(adapter.constraints(spark), graph.transitive_closure(classes)))


def base_prop(spark: SparkSession, d: str, by: DataFrame | None = None) -> DataFrame:
    return checks.check_base_prop(adapter.entities(spark, d), adapter.attributes(spark, d), shapes(spark, d) if by is None else by, adapter.rdf(spark, d))


def base_rel(spark: SparkSession, d: str, by: DataFrame | None = None) -> DataFrame:
    return checks.check_base_rel(adapter.entities(spark, d), adapter.attributes(spark, d), shapes(spark, d) if by is None else by)


def triggers(spark: SparkSession, d: str, operations: Sequence[str]) -> DataFrame:
    """Violations of the constraints that some operations of the combinations ask for, lying by resource. The triples are written
    first, as a table of unknown size would have the whole base dealt out for a join with it."""
    by = checks.named_by(shapes(spark, d), adapter.combinations(spark), operations)
    return checks.all_checks(adapter.entities(spark, d), adapter.attributes(spark, d), by, graph.cut(adapter.rdf(spark, d)))


BASE = ("this", "path", "parentPath", "constraint_id", "edeleted", "attributeValue", "nodeType", "type", "found")


@query("check_base_prop", b.CHECKS + "SELECT " + ", ".join(BASE) + " FROM a1_prop")
def check_base_prop(spark, d):
    return base_prop(spark, d).select(*BASE)


@query("check_base_rel", b.CHECKS + "SELECT " + ", ".join(BASE) + " FROM a1_rel")
def check_base_rel(spark, d):
    return base_rel(spark, d).select(*BASE)


def _row_query(name: str, prop: bool) -> None:
    sql = b.CHECKS + b.row_sql("a1_prop" if prop else "a1_rel", (b.PROP_SQL if prop else b.REL_SQL)[name])

    @query(name, sql)
    def run(spark, d):
        if prop:
            return checks.row_checks(base_prop(spark, d), checks.property_checks(), [name])
        return checks.row_checks(base_rel(spark, d), checks.relationship_checks(), [name])


for _name in b.PROP_SQL:
    _row_query(_name, True)
for _name in b.REL_SQL:
    _row_query(_name, False)


@query("chk_prop_count", b.CHECKS + b.count_sql("a1_prop", "property"))
def chk_prop_count(spark, d):
    return checks.count_check(base_prop(spark, d), "property")


@query("chk_rel_count", b.CHECKS + b.count_sql("a1_rel", "relationship"))
def chk_rel_count(spark, d):
    return checks.count_check(base_rel(spark, d), "relationship")


@query("chk_all_rel", b.CHECKS + b.ALL_REL)
def chk_all_rel(spark, d):
    return checks.chk_all_rel(base_rel(spark, d))


@query("chk_all_prop", b.CHECKS + b.ALL_PROP)
def chk_all_prop(spark, d):
    return checks.chk_all_prop(base_prop(spark, d))


@query("chk_subproperty", b.CHECKS + f"SELECT * FROM ({b.ALL_PROP}) WHERE contains(event, '==>')")
def chk_subproperty(spark, d):
    base = base_prop(spark, d).where(F.col("subpropertyPath").isNotNull())
    return checks.chk_all_prop(base)


@query("chk_inherited", b.CHECKS + "SELECT id, targetClass, propertyPath FROM shapes")
def chk_inherited(spark, d):
    return shapes(spark, d).select("id", "targetClass", "propertyPath")


@query("combine_or", b.CHECKS + f", {b.TRIGGERS}, {b.COMBINED} SELECT * FROM combined")
def combine_or(spark, d):
    return checks.combine_or(triggers(spark, d, ["OR"]), adapter.combinations(spark), adapter.constraints(spark))


@query("publish_alerts", b.CHECKS + f", {b.TRIGGERS}, {b.COMBINED} {b.PUBLISHED}")
def publish_alerts(spark, d):
    """All alerts: every check, the alternatives, and what is published of them."""
    return checks.alerts(triggers(spark, d, ["OR", "PUBLISH"]), adapter.combinations(spark), adapter.constraints(spark))


def _late_orders(spark, d):
    """Orders over 300000 whose customer lives in a nation of region 1."""
    e, a = adapter.entities(spark, d), adapter.attributes(spark, d)
    orders = patterns.match_type(e.select(F.col("id").alias("this")), e, "this", cls="Order")
    rows = patterns.match_property(orders, a, "totalPrice", "price")
    rows = patterns.match_relationship_fwd(rows, a, e, "placedBy", "customer")
    rows = patterns.match_relationship_fwd(rows, a, e, "livesIn", "nation", s="customer")
    inside = patterns.match_triple(None, adapter.rdf(spark, d), "<partOf>", "n", "<urn:region:1>").select(F.regexp_replace("n", "[<>]", "").alias("nation"))
    return patterns.bgp_join(rows, inside, ["nation"]).where(F.col("price").try_cast("double") > 300000)


_LATE = """late AS (SELECT o.id AS this, p.attributeValue AS price, c.id AS customer, n.attributeValue AS nation FROM entities o
  JOIN attributes p ON p.entityId = o.id AND p.name = 'totalPrice' JOIN attributes k ON k.entityId = o.id AND k.name = 'placedBy' JOIN entities c ON c.id = k.attributeValue AND NOT c.deleted
  JOIN attributes n ON n.entityId = c.id AND n.name = 'livesIn' JOIN rdf r ON r.predicate = '<partOf>' AND r.subject = '<' || n.attributeValue || '>' AND r.object = '<urn:region:1>'
  WHERE o.type = 'Order' AND try_cast(p.attributeValue AS DOUBLE) > 300000)"""


@query("sparql_constraint", b.STATE + f", {_LATE} SELECT o.id AS resource, 'SPARQLConstraintComponent(DearOrder)' AS event, CASE WHEN l.this IS NULL THEN 'ok' ELSE 'major' END AS severity, CASE WHEN l.this IS NULL THEN 'All ok' ELSE 'Price ' || l.price || ' of ' || l.customer || ' is NULL!' END AS text FROM entities o LEFT JOIN late l ON l.this = o.id WHERE o.type = 'Order'")
def sparql_constraint(spark, d):
    targets = adapter.entities(spark, d).where("type = 'Order'").select(F.col("id").alias("this"))
    return rules.sparql_constraint(_late_orders(spark, d), targets, "DearOrder", "major", "Price {?price} of {$customer} is {?missing}!")


@query("shape_result_outer", b.STATE + f", {_LATE} SELECT o.id AS resource, 'SPARQLConstraintComponent(S)' AS event, CASE WHEN l.this IS NULL THEN 'ok' ELSE 'warning' END AS severity, CASE WHEN l.this IS NULL THEN 'All ok' ELSE l.nation END AS text FROM entities o LEFT JOIN late l ON l.this = o.id WHERE o.type = 'Order'")
def shape_result_outer(spark, d):
    targets = adapter.entities(spark, d).where("type = 'Order'").select(F.col("id").alias("this"))
    return rules.shape_result_outer(targets, _late_orders(spark, d), "S", "warning", F.col("nation"))


@query("message_template", b.STATE + f", {_LATE} SELECT this, 'x ' || price || '/' || nation || ' NULL' AS text FROM late")
def message_template(spark, d):
    rows = _late_orders(spark, d)
    return rows.select("this", rules.message_template("x {?price}/{$nation} {?none}", rows.columns).alias("text"))


@query("construct_rule", b.STATE + f""", {_LATE} SELECT DISTINCT this || chr(92) || 'rank' AS id, this AS "entityId", 'rank' AS name, '@value' AS "nodeType", 'urn:int' AS "valueType", 'dear' AS "attributeValue", false AS deleted FROM late
  UNION SELECT this || chr(92) || 'from', this, 'from', '@id', NULL, nation, false FROM late""")
def construct_rule(spark, d):
    made = rules.construct_rule(_late_orders(spark, d), [("rank", F.lit("dear"), "@value", "urn:int"), ("from", F.col("nation"), "@id", None)])
    return made.select("id", "entityId", "name", "nodeType", "valueType", "attributeValue", "deleted")
