"""Joins and groupings are dealt into as many parts as the files need, so that a task's share does not grow with them."""

import pytest

from plantstate.operators import cdc, checks, onto
from plantstate.plans import flow_queries, graph_queries
from plantstate.sources import adapter, buckets

SF = "/root/testdata/sf0.001"


def test_flattened_rows_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(buckets, "TASK_BYTES", 5_000)
    docs = cdc.cdc_entity(flow_queries.changes(spark, SF), "after").select("id", "entity")
    assert cdc.cdc_flatten(docs).rdd.getNumPartitions() > 12


def test_reference_triples_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(buckets, "TASK_BYTES", 5_000)
    r = graph_queries.refs(spark, SF)
    assert onto.references_to_triples(r).rdd.getNumPartitions() == buckets.tasks(r) > 8


def test_bases_of_checks_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(buckets, "TASK_BYTES", 5_000)
    e, a, c = adapter.entities(spark, SF), adapter.attributes(spark, SF), adapter.constraints(spark)
    assert checks.check_base_prop(e, a, c, adapter.rdf(spark, SF)).rdd.getNumPartitions() == buckets.tasks(a) > 8


def test_conditions_of_checks_are_compiled(spark):
    """Higher-order functions are interpreted, with all that they are made of."""
    e, a, c = adapter.entities(spark, SF), adapter.attributes(spark, SF), adapter.constraints(spark)
    base = checks.check_base_prop(e, a, c, adapter.rdf(spark, SF))
    for made in (checks.chk_all_prop(base), checks.row_checks(base, checks.property_checks())):
        assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_node_sets_are_written_by_size(spark, monkeypatch):
    monkeypatch.setattr(buckets, "TASK_BYTES", 100)
    got = flow_queries.src_nodeset_xml(spark, SF)
    assert len(got.inputFiles()) > 8 and got.count() == 2 * adapter.table(spark, SF, "part").count()


def test_the_change_log_is_made_once(spark, monkeypatch):
    class Stop(Exception):
        pass

    def replayed(log, *rest):
        assert not [f for f in log.inputFiles() if SF in f]
        raise Stop

    monkeypatch.setattr(flow_queries.flows, "replayed", replayed)
    with pytest.raises(Stop):
        flow_queries.alerts_incremental(spark, SF)
