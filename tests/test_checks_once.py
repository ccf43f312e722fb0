"""All checks, alternatives and alerts over entities and attributes that are dealt out once."""

import random
import re
from datetime import datetime

import pytest

from plantstate import model as m
from plantstate.operators import checks, graph
from plantstate.plans import check_queries
from plantstate.sources import adapter

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
ROWS = [
    (1, {"targetClass": "T", "propertyPath": "p", "attributeType": m.PROPERTY, "propertyNodetype": "@value", "minCount": "1", "maxCount": "1", "severity": "warning", "maxInclusive": "50", "minExclusive": "7"}),
    (2, {"targetClass": "T", "propertyPath": "r", "attributeType": m.RELATIONSHIP, "propertyClass": "U", "minCount": "1", "maxCount": "2", "severity": "major", "pattern": "never", "propertyNodetype": "@value"}),
    (3, {"targetClass": "T", "propertyPath": "p", "attributeType": m.PROPERTY, "propertyNodetype": "@value", "severity": "minor", "pattern": "^[0-9]+$"}),
    (4, {"targetClass": "T", "propertyPath": "p", "subpropertyPath": "s", "attributeType": m.PROPERTY, "propertyNodetype": "@value", "severity": "minor", "ins": '"a","b"', "maxCount": "1"}),
    (5, {"targetClass": "U", "propertyPath": "k", "propertyClass": "K", "attributeType": m.PROPERTY, "propertyNodetype": "@id", "severity": "minor", "minCount": "1"}),
    (6, {"targetClass": "T", "propertyPath": "r", "subpropertyPath": "r", "propertyClass": "V", "attributeType": m.RELATIONSHIP, "severity": "major", "minCount": "1", "maxCount": "1"}),
    (7, {"targetClass": "T", "propertyPath": "r", "attributeType": m.PROPERTY, "propertyNodetype": "@value", "severity": "minor", "maxCount": "1"}),
    (9, {"targetClass": "T", "severity": "critical"}),
]
COMBINATIONS = [(1, "PUBLISH", 1), (2, "PUBLISH", 2), (2, "PUBLISH", 3), (4, "PUBLISH", 4), (6, "PUBLISH", 6), (7, "PUBLISH", 7), (1, "OR", 9), (3, "OR", 9), (9, "PUBLISH", 9), (4, "OR", 8), (8, "PUBLISH", 8)]


def tables(spark):
    rng = random.Random(11)
    ids = [f"t{i}" for i in range(40)] + [f"u{i}" for i in range(8)]
    entities = [(x, rng.choice(["U", "V"]) if x[0] == "u" else rng.choice(["T", "T", "T", "X"]), rng.choice([False, False, True, None]), START) for x in ids] + [(None, "T", False, START)]
    attributes = []

    def put(entity, name, value, parent=None, kind=m.PROPERTY, dataset="@none"):
        node = rng.choice(["@id", "@id", "@value"]) if kind == m.RELATIONSHIP or name == "k" else rng.choice(["@value", "@value", None])
        own = f"{parent or entity}/{name}/{dataset}"
        attributes.append((own, parent, entity, name, node, None, kind, value, dataset, None, None, rng.choice([False, False, False, True, None]), True, START))
        return own

    for x in ids:
        for dataset in rng.sample(["@none", "d2", None], rng.randint(0, 3)):
            p = put(x, "p", rng.choice(["10", "70", "x", "5", None]), dataset=dataset)
            for sub in rng.sample(["@none", "d3"], rng.randint(0, 2)):
                put(x, "s", rng.choice(["a", "c", None]), p, dataset=sub)
        for dataset in rng.sample(["@none", "d2"], rng.randint(0, 2)):
            r = put(x, "r", rng.choice(["u1", "u2", "u5", "nobody", None]), kind=m.RELATIONSHIP, dataset=dataset)
            if rng.random() < 0.6:
                put(x, "r", rng.choice(["u1", "u3", "u5"]), r, m.RELATIONSHIP)
        if x[0] == "u" and rng.random() < 0.7:
            put(x, "k", rng.choice(["k1", "k2", None]))
        put(x, "unnamed", "1")
    constraints = spark.createDataFrame([(i, *(row.get(c) for c in m.CONSTRAINT_COLUMNS)) for i, row in ROWS], m.CONSTRAINTS)
    rdf = spark.createDataFrame([("<k1>", m.RDF_TYPE, "<K>", 0), ("<k1>", m.RDF_TYPE, "<L>", 0), ("<k2>", m.RDF_TYPE, "<L>", 0)], m.RDF)
    return [graph.cut(t) for t in (spark.createDataFrame(entities, m.ENTITIES), spark.createDataFrame(attributes, m.ATTRIBUTES), constraints, rdf)]


def listed(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("compat", [False, True])
def test_all_checks_are_those_of_both_bases(spark, compat):
    e, a, c, rdf = tables(spark)
    apart = checks.chk_all_rel(checks.check_base_rel(e, a, c)).unionByName(checks.chk_all_prop(checks.check_base_prop(e, a, c, rdf), compat))
    once = checks.all_checks(e, a, c, rdf, compat=compat)
    assert len(listed(apart)) > 100 and listed(once) == listed(apart)
    fewer = e.where("id <> 't1' or id is null")
    apart = checks.chk_all_rel(checks.check_base_rel(fewer, a, c, e)).unionByName(checks.chk_all_prop(checks.check_base_prop(fewer, a, c, rdf), compat))
    assert listed(checks.all_checks(fewer, a, c, rdf, e, compat)) == listed(apart)


def test_alerts_are_those_of_triggers_and_alternatives(spark):
    e, a, c, rdf = tables(spark)
    combos = spark.createDataFrame(COMBINATIONS, m.COMBINATIONS)
    t = graph.cut(checks.all_checks(e, a, c, rdf))
    want = listed(checks.publish_alerts(t.unionByName(checks.combine_or(t, combos, c)), combos))
    named = checks.all_checks(e, a, checks.named_by(c, combos), rdf)
    assert any("OR Constraint" in r for r in want) and listed(checks.alerts(named, combos, c)) == want


def dealt_by(df):
    """The lists of keys by which a plan deals rows out."""
    found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
    return {tuple(re.findall(r"(\w+)#", keys)) for keys in found}


def test_alerts_are_made_where_entities_lie(spark, monkeypatch):
    """No base row, violation or alert is dealt out or written; only entities, attributes and what they point to."""
    written, cut = [], graph.cut
    monkeypatch.setattr(check_queries.graph, "cut", lambda df: written.append(df.columns) or cut(df))
    for query in (check_queries.publish_alerts, check_queries.combine_or):
        keys = dealt_by(query(spark, SF))
        assert {k for k in keys if {"this", "b_entity", "resource"} & {*k}} == {("this",), ("b_entity",), ("b_entity", "b_id")}
    assert not [columns for columns in written if "event" in columns]


def test_what_all_rows_go_through_is_compiled(spark):
    """The JVM does not compile methods of more than 8000 bytes."""
    got = checks.alerts(check_queries.triggers(spark, SF, ["OR", "PUBLISH"]), adapter.combinations(spark), adapter.constraints(spark))
    got.collect()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(got._jdf.queryExecution().executedPlan()))
    assert sizes and max(map(int, sizes)) < 8000
