"""Operators on small hand-made rows."""

from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.functions import terms
from plantstate.operators import aggregates, alerts, catalog, cdc, checks, graph, onto, patterns, rules, state
from plantstate.sources import adapter, logs


def test_latest_row_wins_and_ties_break(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", 1, 1, None)], "k string, ts int, o int, v string")
    assert {(r.k, r.v) for r in state.latest_by_key(df, ["k"], "ts", "o").collect()} == {("a", "z"), ("b", None)}


def state_ms(spark, points):
    df = spark.createDataFrame([("k", s, t) for t, s in points], "k string, s int, t bigint")
    return aggregates.state_time(df, ["k"], "s", "t").collect()[0].state_ms


def test_state_time(spark):
    assert state_ms(spark, [(1100, 1), (1300, 0), (1700, 1), (1900, 0), (2300, 0), (2900, 1), (3100, 1)]) == 600
    assert state_ms(spark, [(1, 0), (5, 0)]) is None
    assert state_ms(spark, [(5, 0), (1, 1), (None, 1)]) == 4


def test_alerts_only_change(spark):
    rows = [(i, s) for i, s in enumerate("ok warning ok ok critical critical ok ok ok".split())]
    df = spark.createDataFrame([("r", s, s, i) for i, s in rows], "resource string, severity string, text string, ts int")
    got = [r.severity for r in alerts.alert_changes(df, ["resource"], "ts", "severity").orderBy("ts").collect()]
    assert got == ["ok", "warning", "ok", "critical", "ok"]


def test_counts_and_compatibility(spark):
    entities = spark.createDataFrame([("e", "T", False, None)], m.ENTITIES)
    attr = lambda i, d: (f"a{i}", None, "e", "p", "@value", None, m.PROPERTY, "1", d, None, None, False, True, None)
    attributes = spark.createDataFrame([attr(1, "@none"), attr(2, "d2")], m.ATTRIBUTES)
    row = {"targetClass": "T", "propertyPath": "p", "attributeType": m.PROPERTY, "propertyNodetype": "@value", "maxCount": "1", "severity": "warning"}
    constraints = spark.createDataFrame([(1, *(row.get(c) for c in m.CONSTRAINT_COLUMNS))], m.CONSTRAINTS)
    rdf = spark.createDataFrame([], m.RDF)
    base = checks.check_base_prop(entities, attributes, constraints, rdf)
    assert [r.event for r in checks.count_check(base, "property").collect()] == ["CountConstraintComponent(p)"]
    assert checks.count_check(base, "property", compat=True).isEmpty()


def test_closure_ends_on_cycles(spark):
    t = spark.createDataFrame([("<a>", m.SUBCLASS, "<b>"), ("<b>", m.SUBCLASS, "<c>"), ("<c>", m.SUBCLASS, "<a>")], "subject string, predicate string, object string")
    assert graph.transitive_closure(t).count() == 9


def test_patterns_compose(spark):
    e = spark.createDataFrame([("o1", "Order", False, None), ("c1", "Customer", True, None)], m.ENTITIES)
    a = spark.createDataFrame([("x", None, "o1", "by", "@id", None, m.RELATIONSHIP, "c1", "@none", None, None, False, True, None)], m.ATTRIBUTES)
    this = e.select(F.col("id").alias("this"))
    assert patterns.match_relationship_fwd(this, a, e, "by", "c").isEmpty()
    assert patterns.match_relationship_fwd(this, a, e.withColumn("deleted", F.lit(None).cast("boolean")), "by", "c").count() == 1


def test_message_and_rule(spark):
    df = spark.createDataFrame([("t", "v", None)], "this string, v string, w string")
    assert df.select(rules.message_template("a {?v} b {$w} {?none}.", df.columns).alias("x")).collect()[0].x == "a v b NULL NULL."
    assert rules.construct_rule(df, [("n", F.col("v"), "@value", None), ("m", F.col("w"), "@value", None)]).count() == 1


def test_cdc_last_duplicate_wins(spark):
    n = m.NGSI
    doc = f'{{"p":[{{"@type":["{m.PROPERTY}"],"{n}hasValue":[{{"@value":"1"}}]}},{{"@type":["{m.PROPERTY}"],"{n}hasValue":[{{"@value":"2"}}]}}],"bad":"x","q":[{{"@type":["Odd"]}}]}}'
    got = cdc.cdc_flatten(spark.createDataFrame([("e", doc), ("f", None), ("g", "{")], "id string, entity string")).collect()
    assert [(r.id, r.attributeValue) for r in got] == [("e\\p", "2")]


def test_terms(spark):
    df = spark.createDataFrame([("<http://x/a#b>", "camelCase name")], "i string, n string")
    r = df.select(terms.strip_iri(F.col("i")).alias("a"), terms.local_name(terms.strip_iri(F.col("i"))).alias("b"), terms.snake_case(F.col("n")).alias("c"), terms.kebab_case(F.col("n")).alias("d")).collect()[0]
    assert (r.a, r.b, r.c, r.d) == ("http://x/a#b", "b", "camel_case_name", "camel-case-name")


def test_constraint_rows_match_schema(spark):
    assert adapter.constraints(spark).columns[0] == "id" and adapter.combinations(spark).count() == len(adapter.COMBINATION_ROWS)


def test_history_of_a_day_is_merged(spark, tmp_path):
    from datetime import datetime

    def batch(rows):
        full = [(i, None, "e", "p", "@value", None, m.PROPERTY, v, "@none", None, None, False, True, datetime(2024, 1, day, hour), o) for o, (i, day, hour, v) in enumerate(rows)]
        return spark.createDataFrame(full, m.ATTRIBUTES.replace("ts timestamp", "ts timestamp, offset long") if isinstance(m.ATTRIBUTES, str) else m.ATTRIBUTES.add("offset", "long"))

    path = str(tmp_path / "log")
    for rows in ([("a", 1, 1, "old"), ("b", 1, 2, "x"), ("c", 2, 1, "y")], [("a", 1, 1, "new"), ("d", 1, 3, "z")], [("e", 3, 1, "w")]):
        logs.write_history(batch(rows), path)
    got = {(r.id, r.value, r.observedAt.day) for r in spark.read.parquet(path).collect()}
    assert got == {("a", "new", 1), ("b", "x", 1), ("d", "z", 1), ("c", "y", 2), ("e", "w", 3)}
    seen = lambda i, hour: (i, "T", datetime(2024, 1, 1, hour), False)
    for rows in ([seen("a", 1)], [seen("b", 1), seen("a", 2)]):
        logs.write_history(spark.createDataFrame(rows, "id string, type string, ts timestamp, deleted boolean"), path + "-e", entity=True)
    assert sorted((r.id, r.observedAt.hour) for r in spark.read.parquet(path + "-e").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert [p.name for p in (tmp_path / "log-merge").glob("*")] == []


def test_long_lists_are_whole_and_cycles_raise(spark):
    import pytest

    n = 1500
    rows = [(f"c{i}", m.RDF_FIRST, str(i)) for i in range(n)] + [(f"c{i}", m.RDF_REST, f"c{i + 1}" if i < n - 1 else m.RDF_NIL) for i in range(n)]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string")
    got = {r.head: r["items"] for r in graph.rdf_list_to_array(triples, spark.createDataFrame([("c0",), ("c1490",), ("none",)], "head string")).collect()}
    assert got == {"c0": [str(i) for i in range(n)], "c1490": [str(i) for i in range(1490, n)], "none": []}
    loop = spark.createDataFrame([("a", m.RDF_FIRST, "1"), ("a", m.RDF_REST, "b"), ("b", m.RDF_REST, "a")], "subject string, predicate string, object string")
    with pytest.raises(ValueError):
        graph.rdf_list_to_array(loop, spark.createDataFrame([("a",)], "head string"))


def test_deep_findings_have_context(spark):
    parents = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "s") for i in range(53)] + [("x", "y", "s"), ("y", "x", "s")], "child string, parent string, step string")
    report = spark.createDataFrame([("n0",), ("x",)], "focus string")
    got = {r.focus: (r.entity, r.path) for r in onto.violation_context(report, parents, spark.createDataFrame([("n53",)], "node string")).collect()}
    assert got == {"n0": ("n53", "/".join(["s"] * 53)), "x": (None, None)}


def test_long_json_keeps_its_end(spark):
    text = '{"value":"' + "x" * 1_000_100 + '"}'
    got = spark.createDataFrame([(text,)], "a string").select(cdc.concise_to_normalized(F.col("a")).alias("n")).collect()[0].n
    assert got == '{"type":"Property",' + text[1:]


def test_all_of_is_followed_to_its_end(spark):
    doc = '[{"$id":"A","allOf":[{"$ref":"B"},{"properties":{"i":{"type":"string"}},"required":["i","c"]}]},{"$id":"B","allOf":[{"$ref":"C"}]},{"$id":"C","properties":{"c":{"type":"string"}}}]'
    got = {(r.id, r.name, r.needed) for r in catalog.schema_properties(spark.createDataFrame([(doc,)], "doc string")).collect()}
    assert got == {("A", "i", True), ("A", "c", True), ("B", "c", False), ("C", "c", False)}


def test_attributes_are_flattened_at_any_depth(spark):
    """A chain of nested attributes, several instances, an object in place of an array, and an unknown kind with something in it."""
    n = m.NGSI
    item = lambda v, more="": '{"@type":["%s"],"%shasValue":[{"@value":"%s"}]%s}' % (m.PROPERTY, n, v, more)
    deep = item("v6")
    for i in range(5, 0, -1):
        deep = item(f"v{i}", f',"urn:p{i + 1}":[{deep}]')
    doc = '{"@id":"e","@type":["T"],"urn:p1":[%s],"urn:many":[%s,%s],"urn:one":%s,"urn:odd":[{"@type":["urn:Unknown"],"urn:in":[%s]}],"%screatedAt":[{"@value":"x"}]}' % (
        deep, item("a"), item("b", f',"{n}datasetId":[{{"@id":"urn:d"}}],"urn:sub":[{item("s")}]'), item("o"), item("lost"), n,
    )
    rows = cdc.cdc_flatten(spark.createDataFrame([("e", doc), ("f", "{}"), ("g", None), ("h", "{broken")], "id string, entity string")).collect()
    by = {r.attributeValue: r for r in rows}
    assert set(by) == {f"v{i}" for i in range(1, 7)} | {"a", "b", "s", "o"}
    for i in range(2, 7):
        assert by[f"v{i}"].parentId == by[f"v{i - 1}"].id and by[f"v{i}"].name == f"urn:p{i}"
    assert by["s"].parentId == by["b"].id and by["b"].datasetId == "urn:d" and by["a"].id == "e\\urn:many" and by["v1"].parentId is None
    assert cdc.cdc_flatten(spark.createDataFrame([], "id string, entity string")).count() == 0


def test_chains_have_no_limit(spark):
    up = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(130)] + [("n130", "n125"), ("x", "x")], "a string, b string")
    got = {(r.node, r.ancestor): r.depth for r in graph.depths(up).collect()}
    assert got["n0", "n130"] == 130
    assert got["n128", "n127"] == 5 and got["n7", "n7"] == 0 and got["x", "x"] == 0 and ("n5", "n4") not in got
    start = spark.createDataFrame([("n96",), ("n120",)], "start string")
    assert graph.reached(start, up).count() == 35
    long = "<urn:a/" + "y" * 20_000
    df = spark.createDataFrame([(long + ">",), (long + "/z>",)], "iri string")
    assert [r.iri for r in df.where(graph.in_namespace(F.col("iri"), "urn:a/")).collect()] == [long + ">"]


def test_current_state_stream_goes_on_after_a_restart(spark, tmp_path):
    from plantstate.streaming import flows

    def write(name, rows):
        spark.createDataFrame(rows, "k string, ts int, o int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("k string, ts int, o int, v string").parquet(str(tmp_path / "in"))
        got = flows.current_state_stream(stream, ["k"], str(tmp_path / "table"), "ts", "o", state=str(tmp_path / "state"))
        return sorted((r.k, r.v) for r in got.collect())

    write("1", [("a", 1, 1, "x"), ("b", 1, 1, "y")])
    assert run() == [("a", "x"), ("b", "y")]
    write("2", [("a", 2, 1, "z"), ("b", 0, 1, "old")])
    assert run() == [("a", "z"), ("b", "y")]
    assert run() == [("a", "z"), ("b", "y")]


def suite(spark, constraints, entities, attributes, rdf=()):
    """Events of all checks for hand-made rows: constraints (id, {..}), entities (id, type), attributes (entity, name, node type, value type, type, value, dataset)."""
    c = spark.createDataFrame([(i, *(row.get(x) for x in m.CONSTRAINT_COLUMNS)) for i, row in constraints], m.CONSTRAINTS)
    e = spark.createDataFrame([(i, t, False) for i, t in entities], "id string, type string, deleted boolean")
    a = spark.createDataFrame(
        [(f"{x}\\{name}\\{d}", None, x, name, node, vt, t, v, d, False) for x, name, node, vt, t, v, d in attributes],
        "id string, parentId string, entityId string, name string, nodeType string, valueType string, type string, attributeValue string, datasetId string, deleted boolean",
    )
    r = spark.createDataFrame(list(rdf), "subject string, predicate string, object string")
    props = checks.chk_all_prop(checks.check_base_prop(e, a, c, r))
    return checks.chk_all_rel(checks.check_base_rel(e, a, c)).unionByName(props), c


def test_suite_of_simple_constraints(spark):
    """Class, count, node kind, enumeration, pattern, length and ranges. A link need only lead to an entity, of whatever type."""
    text, number = m.XSD + "string", m.XSD + "double"
    prop = lambda path, **more: {"targetClass": "Cutter", "propertyPath": path, "propertyNodetype": "@value", "attributeType": m.PROPERTY, "severity": "warning"} | more
    constraints = [
        (1, prop("temp", minInclusive="10", maxInclusive="50", minCount="1", maxCount="1")), (2, prop("code", pattern="^A", minLength="3", maxLength="5")), (3, prop("mode", ins='"ON","OFF"', severity="minor")),
        (4, prop("state", propertyNodetype="@id", propertyClass="State", severity="critical")), (5, {"targetClass": "Cutter", "propertyPath": "filter", "propertyClass": "Filter", "attributeType": m.RELATIONSHIP, "minCount": "1", "maxCount": "1", "severity": "major"}),
    ]
    value = lambda x, name, v, vt=text, d="@none": (x, name, "@value", vt, m.PROPERTY, v, d)
    iri = lambda x, name, v, t: (x, name, "@id", None, t, v, "@none")
    good = [value("ok", "temp", "20", number), value("ok", "code", "Abcd"), value("ok", "mode", "ON"), iri("ok", "state", "s/on", m.PROPERTY), iri("ok", "filter", "f1", m.RELATIONSHIP)]
    bad = [
        value("bad", "temp", "60", number), value("bad", "temp", "5", number, "urn:d2"), value("bad", "code", "bx"), value("bad", "mode", "HALF"), iri("bad", "state", "s/none", m.PROPERTY), iri("bad", "filter", "ok", m.RELATIONSHIP),
        value("kind", "temp", "20", number), value("kind", "state", "s/on"), iri("kind", "filter", "gone", m.RELATIONSHIP),
    ]
    got, _ = suite(spark, constraints, [("ok", "Cutter"), ("bad", "Cutter"), ("kind", "Cutter"), ("f1", "Filter")], good + bad, [("<s/on>", m.RDF_TYPE, "<State>")])
    assert {(r.resource, r.event, r.severity) for r in got.collect()} == {
        ("bad", "MaxInclusiveConstraintComponent(temp[0])", "warning"), ("bad", "MinInclusiveConstraintComponent(temp[urn:d2])", "warning"), ("bad", "CountConstraintComponent(temp)", "warning"),
        ("bad", "PatternConstraintComponent(code[0])", "warning"), ("bad", "MinLengthConstraintComponent(code[0])", "warning"), ("bad", "InConstraintComponent(mode[0])", "minor"), ("bad", "DatatypeConstraintComponent(state[0])", "critical"),
        ("kind", "NodeKindConstraintComponent(state[0])", "critical"), ("kind", "ClassConstraintComponent(filter[0])", "major"),
    }


def test_suite_of_alternatives(spark):
    """An OR fires if all its members do, and says ok otherwise."""
    text = m.XSD + "string"
    prop = lambda **more: {"targetClass": "T", "propertyPath": "v", "propertyNodetype": "@value", "attributeType": m.PROPERTY, "severity": "warning"} | more
    value = lambda x, v: (x, "v", "@value", text, m.PROPERTY, v, "@none")
    got, c = suite(spark, [(1, prop(pattern="^A")), (2, prop(minLength="3")), (100, {"targetClass": "T", "severity": "critical"})], [("both", "T"), ("one", "T"), ("none", "T")], [value("both", "x"), value("one", "Ax"), value("none", "Abc")])
    combos = spark.createDataFrame([(1, "OR", 100), (2, "OR", 100), (100, "PUBLISH", 100)], m.COMBINATIONS)
    fired = checks.combine_or(got, combos, c)
    assert {(r.resource, r.event, r.severity) for r in fired.collect()} == {("both", "OR Constraint id 100", "critical"), ("one", "OR Constraint id 100", "ok")}
    alerts_ = checks.publish_alerts(got.unionByName(fired), combos).collect()
    assert {(r.resource, r.severity) for r in alerts_} == {("both", "critical"), ("one", "ok")}


def test_suite_of_value_types(spark):
    """Numbers, truth values, JSON objects and lists, each right and wrong."""
    of = lambda path, t, kind="@value", a=m.PROPERTY: {"targetClass": "T", "propertyPath": path, "propertyNodetype": kind, "attributeType": a, "datatypes": m.XSD + t if t else None, "severity": "warning"}
    constraints = [(1, of("i", "integer")), (2, of("d", "double")), (3, of("b", "boolean")), (4, of("j", None, "@json", m.JSON_PROPERTY)), (5, of("l", None, "@list", m.LIST_PROPERTY))]
    rows = lambda x, i, d, b, j, lst: [(x, "i", "@value", m.XSD + "integer", m.PROPERTY, i, "@none"), (x, "d", "@value", m.XSD + "double", m.PROPERTY, d, "@none"), (x, "b", "@value", m.XSD + "boolean", m.PROPERTY, b, "@none"), (x, "j", "@json", None, m.JSON_PROPERTY, j, "@none"), (x, "l", "@list", None, m.LIST_PROPERTY, lst, "@none")]
    got, _ = suite(spark, constraints, [("ok", "T"), ("bad", "T")], rows("ok", "-7", "1.5", "true", '{"a":1}', "[1,2]") + rows("bad", "7.5", "x", "maybe", "[1]", '{"a":1}'))
    assert {(r.resource, r.event) for r in got.collect()} == {("bad", f"DatatypeConstraintComponent({p}[0])") for p in "idbjl"}
