"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver runs all of them.
NAMES = [
    "latest_by_key", "match_relationship_fwd", "optional_join", "not_exists", "chk_all_rel", "chk_all_prop", "combine_or", "publish_alerts", "sparql_constraint", "construct_rule", "state_time", "udaf_state_time", "cast_int", "hash_id", "iso_millis",
    "transitive_closure", "common_supertype", "is_subclass", "types_in_namespace", "contract_consistency", "subcomponent_closure", "type_contracts", "constraint_catalog", "schema_catalog", "violation_context", "cdc_flatten", "cdc_diff", "cdc_route", "telemetry_to_attributes", "sink_upsert", "sink_attribute_history", "sink_entity_history", "src_nodeset_xml",
    "tumble_updates", "session_debounce", "stream_last_value", "stream_session_debounce", "stream_alert_changes", "state_time_stream", "current_state_stream", "seq_check_stream", "alert_changes", "value_change_rows", "seq_check", "state_ttl", "state_time_ends", "state_time_retract",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    if hasattr(x, "tolist"):
        x = x.tolist()
    return str(pd.Timestamp(x).tz_localize(None)) if isinstance(x, pd.Timestamp) else str(int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else x)


def rows(df):
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
