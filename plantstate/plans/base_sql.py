"""The model tables as DuckDB common table expressions, for the SQL that checks the queries."""

from __future__ import annotations

from plantstate import model as m
from plantstate.sources.adapter import COMBINATION_ROWS, CONSTRAINT_ROWS, FIXED_TRIPLES, START


def lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") AS v({columns}))"


def _attr(kind: str, table: str, key: str, ts: str, rows: list[tuple]) -> str:
    out = []
    for name, node, vt, type_, value, deleted, parent in rows:
        urn = f"'urn:{kind}:' || {key}"
        own = f"{urn} || chr(92) || '{name}'" if parent is None else f"{urn} || chr(92) || '{parent}' || chr(92) || '{name}'"
        up = "NULL::VARCHAR" if parent is None else f"{urn} || chr(92) || '{parent}'"
        out.append(f"SELECT {own} AS id, {up} AS parentId, {urn} AS entityId, '{name}' AS name, {node} AS nodeType, {lit(vt)}::VARCHAR AS valueType, {lit(type_)} AS type, {value} AS attributeValue, '@none' AS datasetId, NULL::VARCHAR AS unitCode, NULL::VARCHAR AS lang, {deleted} AS deleted, true AS synced, {ts} AS ts FROM {table}")
    return " UNION ALL ".join(out)


_T = f"TIMESTAMP '{START}'"
_DEC = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)".format
_D, _I, _S = (m.XSD + t for t in ("double", "integer", "string"))

ENTITIES = f"""entities AS (
  SELECT 'urn:order:' || o_orderkey AS id, 'Order' AS type, false AS deleted, o_orderdate::TIMESTAMP AS ts FROM orders
  UNION ALL SELECT 'urn:customer:' || c_custkey, 'Customer/' || c_mktsegment, c_acctbal < 0, {_T} FROM customer
  UNION ALL SELECT 'urn:part:' || p_partkey, 'Part/' || p_type, false, {_T} FROM part
  UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'Supplier', false, {_T} FROM supplier
  UNION ALL SELECT 'urn:nation:' || n_nationkey, 'Nation', false, {_T} FROM nation
  UNION ALL SELECT 'urn:region:' || r_regionkey, 'Region', false, {_T} FROM region)"""

ATTRIBUTES = "attributes AS (" + " UNION ALL ".join([
    _attr("order", "orders", "o_orderkey", "o_orderdate::TIMESTAMP", [
        ("totalPrice", "'@value'", _D, m.PROPERTY, _DEC("o_totalprice"), "false", None),
        ("currency", "'@value'", _S, m.PROPERTY, "(['EUR', 'USD', 'usd'])[o_orderkey % 3 + 1]", "false", "totalPrice"),
        ("status", "'@value'", _S, m.PROPERTY, "o_orderstatus", "false", None),
        ("priority", "'@value'", _S, m.PROPERTY, "o_orderpriority", "o_orderkey % 10 = 9", None),
        ("placedBy", "'@id'", None, m.RELATIONSHIP, "'urn:customer:' || o_custkey", "false", None),
    ]),
    _attr("customer", "customer", "c_custkey", _T, [
        ("acctBal", "'@value'", _D, m.PROPERTY, _DEC("c_acctbal"), "false", None),
        ("segment", "'@id'", None, m.PROPERTY, "'seg/' || c_mktsegment", "false", None),
        ("livesIn", "'@id'", None, m.RELATIONSHIP, "'urn:nation:' || c_nationkey", "false", None),
    ]),
    _attr("part", "part", "p_partkey", _T, [
        ("size", "'@value'", _I, m.PROPERTY, "CASE WHEN p_partkey % 9 = 8 THEN 'big' ELSE p_size::VARCHAR END", "false", None),
        ("brand", "CASE WHEN p_partkey % 13 = 0 THEN '@id' ELSE '@value' END", _S, m.PROPERTY, "p_brand", "false", None),
        ("meta", "'@json'", None, m.JSON_PROPERTY, "CASE WHEN p_partkey % 7 = 0 THEN '[1]' ELSE '{\"size\":' || p_size || '}' END", "false", None),
        ("dims", "'@list'", None, m.LIST_PROPERTY, "CASE WHEN p_partkey % 11 = 0 THEN '{\"a\":1}' ELSE '[' || p_size || ',2]' END", "false", None),
    ]),
    _attr("supplier", "supplier", "s_suppkey", _T, [
        ("acctBal", "'@value'", _D, m.PROPERTY, _DEC("s_acctbal"), "false", None),
        ("livesIn", "'@id'", None, m.RELATIONSHIP, "'urn:nation:' || s_nationkey", "false", None),
    ]),
]) + ")"

LOG = f"""attr_log AS (
  SELECT 'urn:user:' || user_id || chr(92) || event_type AS id, NULL::VARCHAR AS parentId, 'urn:user:' || user_id AS entityId, event_type AS name, '@value' AS nodeType, '{_D}' AS valueType, '{m.PROPERTY}' AS type,
         {_DEC('value')} AS attributeValue, '@none' AS datasetId, NULL::VARCHAR AS unitCode, NULL::VARCHAR AS lang, event_id % 17 = 0 AS deleted, event_id % 2 = 0 AS synced, ts, event_id AS "offset" FROM events)"""

RDF = f"""rdf AS (SELECT *, 0 AS index FROM (
  SELECT DISTINCT '<Part/' || p_type || '>' AS subject, '{m.SUBCLASS}' AS predicate, '<Part>' AS object FROM part
  UNION ALL SELECT DISTINCT '<Customer/' || c_mktsegment || '>', '{m.SUBCLASS}', '<Customer>' FROM customer
  UNION ALL SELECT DISTINCT '<seg/' || c_mktsegment || '>', '{m.RDF_TYPE}', '<Segment>' FROM customer WHERE c_mktsegment <> 'FURNITURE'
  UNION ALL SELECT '<urn:nation:' || n_nationkey || '>', '<partOf>', '<urn:region:' || n_regionkey || '>' FROM nation
  UNION ALL SELECT '<urn:region:' || r_regionkey || '>', '<partOf>', '<urn:world>' FROM region
  UNION ALL SELECT * FROM {values(FIXED_TRIPLES, 'a, b, c')}))"""

CLOSURE = f"""closed AS (
  SELECT subject, predicate, object FROM rdf WHERE predicate IN ('{m.SUBCLASS}', '<partOf>')
  UNION SELECT c.subject, c.predicate, r.object FROM closed c JOIN rdf r ON r.predicate = c.predicate AND r.subject = c.object),
closure AS (SELECT subject, predicate, object FROM rdf UNION SELECT * FROM closed)"""

CONSTRAINTS = "constraints AS " + values([(i, *(row.get(c) for c in m.CONSTRAINT_COLUMNS)) for i, row in CONSTRAINT_ROWS], "id, " + ", ".join(f'"{c}"' for c in m.CONSTRAINT_COLUMNS))
COMBINATIONS = "combinations AS " + values(COMBINATION_ROWS, "member_constraint_id, operation, target_constraint_id")

INHERITED = """shapes AS (SELECT * FROM constraints UNION
  SELECT c.id, replace(replace(k.subject, '<', ''), '>', ''), c.* EXCLUDE (id, targetClass) FROM constraints c JOIN closure k ON k.predicate LIKE '%subClassOf>' AND k.object = '<' || c.targetClass || '>' AND k.subject <> k.object)"""


def _a1(name: str, kinds: str, live: str, extra: str, found: str) -> str:
    coal = ", ".join(f"coalesce(e.{c}, b.{c}) AS {c}" for c in ("nodeType", "valueType", "type", "attributeValue", "datasetId", "deleted"))
    index = "CASE WHEN {0}.datasetId = '@none' THEN '0' ELSE {0}.datasetId END".format
    return f"""{name} AS (SELECT x.*, {found} AS found FROM (
  SELECT a.id AS this, a.deleted AS edeleted, coalesce(d.subpropertyPath, d.propertyPath) AS path,
    CASE WHEN d.subpropertyPath IS NULL THEN '' ELSE d.propertyPath || '[' || {index('b')} || '] ==> ' END AS parentPath, {coal}, d.* EXCLUDE (id), d.id AS constraint_id
  FROM entities a JOIN shapes d ON a.type = d.targetClass
  LEFT JOIN attributes b ON b.entityId = a.id AND b.name = d.propertyPath AND b.parentId IS NULL {live.format('b')}
  LEFT JOIN attributes e ON e.entityId = a.id AND e.name = d.subpropertyPath AND e.parentId = b.id {live.format('e')}
  WHERE (d.subpropertyPath IS NULL OR e.id IS NOT NULL) AND d.attributeType IN ({kinds})) x {extra})"""


A1_PROP = _a1("a1_prop", ", ".join(lit(k) for k in (m.PROPERTY, m.LIST_PROPERTY, m.JSON_PROPERTY)), "", f"LEFT JOIN (SELECT DISTINCT subject, object FROM rdf WHERE predicate = '{m.RDF_TYPE}') r ON r.subject = '<' || x.attributeValue || '>' AND r.object = '<' || x.propertyClass || '>'", "r.object")
A1_REL = _a1("a1_rel", lit(m.RELATIONSHIP), "AND NOT {0}.deleted", "LEFT JOIN entities t ON t.id = x.attributeValue AND NOT t.deleted", "t.type")


def with_model(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


STATE = with_model(ENTITIES, ATTRIBUTES, LOG, RDF)
GRAPH = with_model(RDF, CLOSURE)
CHECKS = with_model(ENTITIES, ATTRIBUTES, RDF, CLOSURE, CONSTRAINTS, COMBINATIONS, INHERITED, A1_PROP, A1_REL)

_LIVE = "NOT edeleted AND NOT coalesce(deleted, false) AND type IS NOT NULL AND datasetId IS NOT NULL"
_PRINT = "path || '[' || CASE WHEN datasetId = '@none' THEN '0' ELSE datasetId END || ']'"
_DOUBLE = r"^(0|[+-]?(\d+\.\d*|\.\d+|\d+[eE][+-]?\d+))$"


def _text(kind: str, rest: str) -> str:
    return f"'Model validation for {kind} ' || path || ' failed for ' || this || '. ' || {rest}"


def _event(component: str, path: str = _PRINT) -> str:
    return f"'{component}(' || parentPath || {path} || ')'"


_V = "coalesce(attributeValue, 'NULL')"
_OF = "(contains(datatypes, '{0}') AND coalesce(valueType, '{0}') = '{0}')".format
#: Property checks: name -> (condition, event, text).
PROP_SQL = {
    "chk_prop_class": (f"propertyNodetype = '@id' AND propertyClass IS NOT NULL AND {_LIVE} AND found IS NULL", _event("DatatypeConstraintComponent"), _text("property", f"'Value ' || {_V} || ' is not of type ' || propertyClass || '.'")),
    "chk_prop_nodekind": (f"propertyNodetype IS NOT NULL AND {_LIVE} AND (nodeType <> propertyNodetype OR type <> attributeType)", _event("NodeKindConstraintComponent"), _text("property", "'Node type ' || nodeType || ' or attribute type ' || type || ' is not the required one.'")),
    "chk_min_length": (f"minLength IS NOT NULL AND {_LIVE} AND length(attributeValue) < minLength::INT", _event("MinLengthConstraintComponent"), _text("property", f"'Length of ' || {_V} || ' is < ' || minLength || '.'")),
    "chk_max_length": (f"maxLength IS NOT NULL AND {_LIVE} AND length(attributeValue) > maxLength::INT", _event("MaxLengthConstraintComponent"), _text("property", f"'Length of ' || {_V} || ' is > ' || maxLength || '.'")),
    "chk_pattern": (f"pattern IS NOT NULL AND {_LIVE} AND NOT regexp_matches(attributeValue, pattern)", _event("PatternConstraintComponent"), _text("property", f"'Value ' || {_V} || ' does not match ' || pattern || '.'")),
    "chk_in": (f"ins IS NOT NULL AND {_LIVE} AND NOT coalesce(contains(',' || ins || ',', ',\"' || attributeValue || '\",'), false)", _event("InConstraintComponent"), _text("property", f"'Value ' || {_V} || ' is not allowed.'")),
    "chk_datatype_literal": (f"{_LIVE} AND datatypes IS NOT NULL AND propertyNodetype = '@value' AND (attributeValue IS NULL OR NOT (({_OF(_D)} AND regexp_matches(attributeValue, '{_DOUBLE}')) OR ({_OF(_I)} AND regexp_matches(attributeValue, '^[+-]?\\d+$')) OR {_OF(_S)}))", _event("DatatypeConstraintComponent"), _text("property", f"'Value ' || {_V} || ' is not of ' || datatypes || '.'")),
    "chk_datatype_json": (f"propertyNodetype = '@json' AND {_LIVE} AND NOT coalesce(json_type(CASE WHEN json_valid(attributeValue) THEN attributeValue END) = 'OBJECT', false)", _event("DatatypeConstraintComponent"), _text("property", f"'Value ' || {_V} || ' is not a JSON object.'")),
    "chk_datatype_list": (f"propertyNodetype = '@list' AND {_LIVE} AND NOT coalesce(json_type(CASE WHEN json_valid(attributeValue) THEN attributeValue END) = 'ARRAY', false)", _event("DatatypeConstraintComponent"), _text("property", f"'Value ' || {_V} || ' is not a JSON array.'")),
    "chk_has_value": (f"hasValue IS NOT NULL AND {_LIVE} AND attributeValue <> hasValue", _event("HasValueConstraintComponent", "path"), _text("property", f"'Value ' || {_V} || ' is not ' || hasValue || '.'")),
}
for _name, _component, _column, _op in (("chk_min_exclusive", "MinExclusive", "minExclusive", ">"), ("chk_max_exclusive", "MaxExclusive", "maxExclusive", "<"), ("chk_min_inclusive", "MinInclusive", "minInclusive", ">="), ("chk_max_inclusive", "MaxInclusive", "maxInclusive", "<=")):
    PROP_SQL[_name] = (f"{_column} IS NOT NULL AND {_LIVE} AND NOT coalesce(try_cast(attributeValue AS DOUBLE) {_op} try_cast({_column} AS DOUBLE), false)", _event(f"{_component}ConstraintComponent"), _text("property", f"'Value ' || {_V} || ' is not {_op} ' || {_column} || '.'"))
REL_SQL = {
    "chk_rel_class": (f"propertyClass IS NOT NULL AND {_LIVE} AND found IS NULL", _event("ClassConstraintComponent"), _text("relationship", "'No entity of type ' || propertyClass || ' is linked.'")),
    "chk_rel_nodekind": (f"{_LIVE} AND (nodeType <> '@id' OR type <> attributeType)", _event("NodeKindConstraintComponent"), _text("relationship", "'Node type ' || nodeType || ' is not an IRI or type is not a relationship.'")),
}


def row_sql(base: str, check: tuple[str, str, str]) -> str:
    cond, event, text = check
    return f"SELECT this AS resource, {event} AS event, constraint_id, true AS triggered, severity, {text} AS text FROM {base} WHERE {cond}"


def count_sql(base: str, kind: str) -> str:
    text = _text(kind, "'Found ' || found || ' instead of [' || coalesce(minCount, '0') || ', ' || coalesce(maxCount, '*') || '].'")
    return f"""SELECT this AS resource, {_event('CountConstraintComponent', 'path')} AS event, constraint_id, true AS triggered, severity, {text} AS text FROM (
  SELECT this, path, minCount, maxCount, severity, constraint_id, parentPath, sum(CASE WHEN NOT coalesce(deleted, false) AND type IS NOT NULL THEN 1 ELSE 0 END) AS found
  FROM {base} WHERE NOT edeleted AND (minCount IS NOT NULL OR maxCount IS NOT NULL) GROUP BY ALL) WHERE found > maxCount::INT OR found < coalesce(minCount::INT, 0)"""


ALL_REL = " UNION ALL ".join([*(row_sql("a1_rel", c) for c in REL_SQL.values()), count_sql("a1_rel", "relationship")])
ALL_PROP = " UNION ALL ".join([*(row_sql("a1_prop", c) for c in PROP_SQL.values()), count_sql("a1_prop", "property")])
TRIGGERS = f"triggers AS ({ALL_REL} UNION ALL {ALL_PROP})"
COMBINED = """combined AS (
  SELECT f.resource, 'OR Constraint id ' || f.target AS event, f.target AS constraint_id, needed = fired AS triggered, CASE WHEN needed = fired THEN c.severity ELSE 'ok' END AS severity, CASE WHEN needed = fired THEN texts ELSE 'All ok' END AS text
  FROM (SELECT t.resource, k.target_constraint_id AS target, count(DISTINCT t.constraint_id) FILTER (t.triggered) AS fired, string_agg(DISTINCT t.text, ' AND ' ORDER BY t.text) FILTER (t.triggered) AS texts
        FROM triggers t JOIN combinations k ON k.operation = 'OR' AND k.member_constraint_id = t.constraint_id GROUP BY ALL) f
  JOIN (SELECT target_constraint_id AS target, count(*) AS needed FROM combinations WHERE operation = 'OR' GROUP BY ALL) n ON n.target = f.target JOIN constraints c ON c.id = f.target)"""
PUBLISHED = """SELECT t.resource, t.event, 'Development' AS environment, ['SHACL Validator'] AS service, max(t.severity) AS severity, 'customer' AS customer, max(t.text) AS text
FROM (SELECT * FROM triggers UNION ALL SELECT * FROM combined) t JOIN combinations k ON k.operation = 'PUBLISH' AND k.member_constraint_id = t.constraint_id GROUP BY t.resource, t.event"""
