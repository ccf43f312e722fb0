"""Queries of current state, patterns, aggregations and scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.functions import terms
from plantstate.operators import aggregates, patterns, state
from plantstate.plans import base_sql as b
from plantstate.plans.registry import query
from plantstate.sources import adapter

S = b.STATE
LATEST = 'latest AS (SELECT * FROM attr_log QUALIFY row_number() OVER (PARTITION BY id, datasetId ORDER BY ts DESC, "offset" DESC) = 1)'


def ents(spark: SparkSession, d: str) -> DataFrame:
    return adapter.entities(spark, d)


def attrs(spark: SparkSession, d: str) -> DataFrame:
    return adapter.attributes(spark, d)


def log(spark: SparkSession, d: str) -> DataFrame:
    return adapter.attribute_log(spark, d)


def this(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = state.live_filter(ents(spark, d))
    return (e.where(F.col("type") == kind) if kind else e).select(F.col("id").alias("this"))


@query("latest_by_key", S + f', {LATEST} SELECT id, datasetId, attributeValue, deleted, ts, "offset" FROM latest')
def latest_by_key(spark, d):
    return state.latest_by_key(log(spark, d), ["id", "datasetId"], "ts", "offset").select("id", "datasetId", "attributeValue", "deleted", "ts", "offset")


@query("latest_insert_view", S + f", {LATEST} SELECT entityId, name, attributeValue FROM latest WHERE NOT deleted")
def latest_insert_view(spark, d):
    return state.live_filter(state.latest_by_key(log(spark, d), ["id", "datasetId"], "ts", "offset")).select("entityId", "name", "attributeValue")


@query("live_filter", S + "SELECT id, type FROM entities WHERE NOT deleted")
def live_filter(spark, d):
    return state.live_filter(ents(spark, d)).select("id", "type")


@query("project_vars", S + "SELECT id, type, NULL::VARCHAR AS missing FROM entities")
def project_vars(spark, d):
    return state.project_vars(ents(spark, d), ["id", "type", "missing"])


@query("distinct", S + "SELECT DISTINCT name, attributeValue FROM attributes WHERE name IN ('status', 'priority', 'brand')")
def distinct(spark, d):
    return attrs(spark, d).where(F.col("name").isin("status", "priority", "brand")).select("name", "attributeValue").distinct()


@query("bind", S + "SELECT id, upper(type) AS kind FROM entities")
def bind(spark, d):
    return state.bind(ents(spark, d), "kind", F.upper("type")).select("id", "kind")


@query("filter_expr", S + "SELECT id, attributeValue FROM attributes WHERE (name = 'status' AND attributeValue = 'O') OR NOT (name IN ('status', 'totalPrice', 'currency', 'priority', 'placedBy', 'meta', 'dims'))")
def filter_expr(spark, d):
    cond = ((F.col("name") == "status") & (F.col("attributeValue") == "O")) | ~F.col("name").isin("status", "totalPrice", "currency", "priority", "placedBy", "meta", "dims")
    return state.filter_expr(attrs(spark, d), cond).select("id", "attributeValue")


@query("compare", "SELECT o_orderkey, o_totalprice > 1000 AS gt, o_totalprice <= 90000.5 AS le, o_orderstatus <> 'O' AS ne, o_orderstatus IN ('O', 'F') AS is_in, o_orderkey NOT IN (1, 2) AS not_in FROM orders")
def compare(spark, d):
    o, c = adapter.table(spark, d, "orders"), state.compare
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return o.select("o_orderkey", c(price, ">", 1000).alias("gt"), c(price, "<=", 90000.5).alias("le"), c(status, "!=", "O").alias("ne"), c(status, "in", ["O", "F"]).alias("is_in"), c(F.col("o_orderkey"), "not in", [1, 2]).alias("not_in"))


@query("history_query", S + 'SELECT id, ts, attributeValue FROM attr_log WHERE name = \'purchase\' AND "entityId" LIKE \'urn:user:1%\' ORDER BY ts DESC, id LIMIT 100')
def history_query(spark, d):
    return state.history_query(log(spark, d), {"name": "purchase"}, {"entityId": "urn:user:1%"}, ["-ts", "id"], 100, ["id", "ts", "attributeValue"])


@query("history_count", S + "SELECT entityId, count(*) AS n FROM attr_log WHERE name = 'error' GROUP BY entityId")
def history_count(spark, d):
    return state.history_query(log(spark, d), {"name": "error"}).groupBy("entityId").agg(F.count("*").alias("n"))


_POINTS = "points AS (SELECT CASE WHEN event_id % 7 = 0 THEN event_type ELSE 'urn:m:' || event_type END AS n, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE props END AS v, CASE WHEN event_id % 2 = 0 THEN 'JsonProperty' WHEN event_id % 3 = 0 THEN 'ListProperty' END AS t, ts, event_id FROM events)"


@query("datapoint_validate", f"WITH {_POINTS} SELECT event_id, coalesce(t, 'Property') AS type, CASE WHEN n NOT LIKE 'urn:%' THEN 'name' WHEN t = 'JsonProperty' AND v = 'x' THEN 'json' WHEN t = 'ListProperty' THEN 'list' END AS reason, coalesce(t, 'Property') || '/' || n AS metric FROM points")
def datapoint_validate(spark, d):
    e = adapter.table(spark, d, "events")
    k = F.col("event_id")
    p = e.select(F.when(k % 7 == 0, F.col("event_type")).otherwise(F.concat(F.lit("urn:m:"), "event_type")).alias("n"), F.when(k % 5 == 0, "x").otherwise(F.col("props")).alias("v"), F.when(k % 2 == 0, "JsonProperty").when(k % 3 == 0, "ListProperty").alias("t"), "ts", "event_id")
    return state.datapoint_validate(p).select("event_id", "type", "reason", "metric")


@query("unsent_latest", "SELECT n, ts FROM (SELECT user_id || '/' || event_type AS n, ts, (event_id % 2)::INTEGER AS sent, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1 AND sent = 0")
def unsent_latest(spark, d):
    e = adapter.table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("n"), "ts", (F.col("event_id") % 2).alias("sent"))
    return state.unsent_latest(e).select("n", "ts")


@query("retention_trim", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS")
def retention_trim(spark, d):
    e = adapter.table(spark, d, "events").select("event_id", "ts")
    newest = e.agg(F.max("ts")).first()[0]
    return state.retention_trim(e, F.lit(newest), 86400)


@query("rank_latest", S + 'SELECT id, ts, row_number() OVER (PARTITION BY id ORDER BY ts DESC, "offset" DESC)::INTEGER AS row_num FROM attr_log')
def rank_latest(spark, d):
    return state.rank_latest(log(spark, d), ["id"], "ts", "offset").select("id", "ts", "row_num")


@query("rank_latest_in_window", S + "SELECT id, ts, row_num FROM (SELECT *, row_number() OVER (PARTITION BY id, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts DESC, \"offset\" DESC)::INTEGER AS row_num FROM attr_log) WHERE row_num = 1")
def rank_latest_in_window(spark, d):
    return state.rank_latest_in_window(log(spark, d), ["id"], "1 hour", "ts", "offset").where("row_num = 1").select("id", "ts", "row_num")


@query("value_change_rows", "SELECT event_id FROM (SELECT event_id, event_type, row_number() OVER w AS n, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM before")
def value_change_rows(spark, d):
    return state.value_change_rows(adapter.table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("event_id")


@query("union_all", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation")
def union_all(spark, d):
    t = lambda n, c: adapter.table(spark, d, n).select(F.col(c).alias("name"))
    return state.union_all(t("customer", "c_name"), t("supplier", "s_name"), t("nation", "n_name"))


@query("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def order_limit(spark, d):
    return state.order_limit(adapter.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50)


# Patterns


@query("match_property", S + "SELECT e.id AS this, a.attributeValue AS price FROM entities e JOIN attributes a ON a.entityId = e.id AND a.name = 'totalPrice' AND a.parentId IS NULL AND NOT a.deleted WHERE NOT e.deleted")
def match_property(spark, d):
    return patterns.match_property(this(spark, d), attrs(spark, d), "totalPrice", "price")


_FWD = "SELECT e.id AS this, c.id AS customer FROM entities e JOIN attributes a ON a.entityId = e.id AND a.name = 'placedBy' JOIN entities c ON c.id = a.attributeValue AND NOT c.deleted"


@query("match_relationship_fwd", S + _FWD + " WHERE NOT e.deleted")
def match_relationship_fwd(spark, d):
    return patterns.match_relationship_fwd(this(spark, d), attrs(spark, d), ents(spark, d), "placedBy", "customer")


@query("match_relationship_rev", S + "SELECT n.id AS this, e.id AS who FROM entities n JOIN attributes a ON a.name = 'livesIn' AND a.attributeValue = n.id JOIN entities e ON e.id = a.entityId AND NOT e.deleted WHERE n.type = 'Nation'")
def match_relationship_rev(spark, d):
    return patterns.match_relationship_rev(this(spark, d, "Nation"), attrs(spark, d), ents(spark, d), "livesIn", "who")


@query("match_observed_at", S + "SELECT e.id AS this, a.attributeValue AS status, a.ts AS at FROM entities e JOIN attributes a ON a.entityId = e.id AND a.name = 'status' WHERE NOT e.deleted")
def match_observed_at(spark, d):
    return patterns.match_observed_at(this(spark, d), attrs(spark, d), "status", "status", "at")


@query("match_type", S + "SELECT e.id AS this, e.type AS kind FROM entities e WHERE NOT deleted AND type LIKE 'Customer/%'")
def match_type(spark, d):
    return patterns.match_type(this(spark, d), ents(spark, d), var="kind").where("kind LIKE 'Customer/%'")


@query("match_triple", S + "SELECT a.subject AS nation, b.subject AS region FROM rdf a JOIN rdf b ON a.object = b.subject WHERE a.predicate = '<partOf>' AND b.predicate = '<partOf>' AND b.object = '<urn:world>'")
def match_triple(spark, d):
    r = adapter.rdf(spark, d)
    return patterns.match_triple(patterns.match_triple(None, r, "<partOf>", "region", "<urn:world>"), r, "<partOf>", "nation", "region").select("nation", "region")


@query("match_triple_bnode", S + f"SELECT a.subject AS s, b.object AS o FROM rdf a JOIN rdf b ON a.object = b.subject WHERE a.predicate = '<label>' AND b.predicate = '{m.RDF_FIRST}' AND a.object LIKE '\\_:%' ESCAPE '\\' UNION ALL SELECT '<o/' || o_orderkey || '>', '\"' || o_orderstatus || '\"' FROM orders")
def match_triple_bnode(spark, d):
    """Labels in blank nodes: those of the triples, and one of each order."""
    o = adapter.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus")
    row = lambda s, p, v: o.select(s.alias("subject"), F.lit(p).alias("predicate"), v.alias("object"))
    node = F.concat(F.lit("_:o"), "k")
    triples = adapter.rdf(spark, d).select("subject", "predicate", "object").unionByName(row(F.concat(F.lit("<o/"), "k", F.lit(">")), "<label>", node)).unionByName(row(node, m.RDF_FIRST, F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))))
    return patterns.match_triple_bnode(None, triples, "<label>", m.RDF_FIRST, "s", "o").select("s", "o")


@query("subclass_of_target", b.with_model(b.ENTITIES, b.RDF, b.CLOSURE) + f"SELECT id AS this, type FROM entities WHERE NOT deleted AND type IN (SELECT replace(replace(subject, '<', ''), '>', '') FROM closure WHERE predicate = '{m.SUBCLASS}' AND object = '<Party>')")
def subclass_of_target(spark, d):
    from plantstate.operators.graph import transitive_closure

    return patterns.subclass_of_target(ents(spark, d), transitive_closure(adapter.rdf(spark, d)), "Party")


def _two(spark, d):
    return patterns.match_property(this(spark, d, "Order"), attrs(spark, d), "totalPrice", "price"), patterns.match_property(this(spark, d, "Order"), attrs(spark, d), "priority", "priority")


_TWO = "SELECT p.entityId AS this, p.attributeValue AS price, q.attributeValue AS priority FROM attributes p {} JOIN attributes q ON q.entityId = p.entityId AND q.name = 'priority' AND NOT q.deleted WHERE p.name = 'totalPrice'"


@query("bgp_join", S + _TWO.format(""))
def bgp_join(spark, d):
    return patterns.bgp_join(*_two(spark, d), ["this"])


@query("optional_join", S + _TWO.format("LEFT"))
def optional_join(spark, d):
    return patterns.optional_join(*_two(spark, d), ["this"])


@query("not_exists", S + "SELECT p.entityId AS this, p.attributeValue AS price FROM attributes p WHERE p.name = 'totalPrice' AND NOT EXISTS (SELECT 1 FROM attributes q WHERE q.entityId = p.entityId AND q.name = 'priority' AND NOT q.deleted)")
def not_exists(spark, d):
    return patterns.not_exists(*_two(spark, d), ["this"])


# Aggregations


def _bindings(spark, d):
    return log(spark, d).select(F.col("entityId").alias("this"), "name", F.col("attributeValue").cast("decimal(18,2)").alias("v"), "offset")


_B = "b AS (SELECT entityId AS this, name, attributeValue::DECIMAL(18,2) AS v FROM attr_log)"


@query("agg_count", S + f", {_B} SELECT this, name, count(v) AS n FROM b GROUP BY this, name")
def agg_count(spark, d):
    return aggregates.agg_count(_bindings(spark, d), ["this", "name"], "v")


@query("agg_count_distinct", S + f", {_B} SELECT this, count(DISTINCT v) AS n FROM b GROUP BY this")
def agg_count_distinct(spark, d):
    return aggregates.agg_count(_bindings(spark, d), ["this"], "v", distinct=True)


@query("agg_sum", S + f", {_B} SELECT this, sum(v)::DOUBLE AS total FROM b GROUP BY this")
def agg_sum(spark, d):
    return aggregates.agg_sum(_bindings(spark, d), ["this"], "v").select("this", F.col("total").cast("double").alias("total"))


@query("agg_sum_distinct", S + f", {_B} SELECT this, sum(DISTINCT v)::DOUBLE AS total FROM b GROUP BY this")
def agg_sum_distinct(spark, d):
    return aggregates.agg_sum(_bindings(spark, d), ["this"], "v", distinct=True).select("this", F.col("total").cast("double").alias("total"))


@query("group_by_this", S + f", {_B} SELECT this, name, max(v)::DOUBLE AS top FROM b GROUP BY this, name")
def group_by_this(spark, d):
    return aggregates.group_by_this(_bindings(spark, d), ["name"]).agg(F.max("v").cast("double").alias("top"))


@query("agg_over_history", S + f", {LATEST} SELECT l.entityId AS this, n, l.attributeValue AS now FROM latest l JOIN (SELECT entityId, count(*) AS n FROM attr_log WHERE name = 'view' GROUP BY entityId) h ON h.entityId = l.entityId WHERE l.name = 'view' AND NOT l.deleted")
def agg_over_history(spark, d):
    """Aggregated variables read the whole log, the others the current view."""
    views = log(spark, d).where("name = 'view'")
    counts = views.groupBy(F.col("entityId").alias("this")).agg(F.count("*").alias("n"))
    now = state.live_filter(state.latest_by_key(views, ["id", "datasetId"], "ts", "offset")).select(F.col("entityId").alias("this"), F.col("attributeValue").alias("now"))
    return counts.join(now, "this").select("this", "n", "now")


@query("oee_counts", "SELECT l_suppkey AS machine, count(DISTINCT l_partkey) AS total, count(DISTINCT l_partkey) FILTER (p_size < 25) AS good FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_suppkey")
def oee_counts(spark, d):
    lines = adapter.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("machine"), F.col("l_partkey").alias("output"), F.col("l_shipdate").alias("ts"))
    parts = adapter.table(spark, d, "part").select(F.col("p_partkey").alias("output"), "p_size")
    span = [F.lit(x).cast("timestamp") for x in ("1997-01-01", "1998-01-01")]
    return aggregates.oee_counts(parts, lines, "machine", "output", F.col("p_size") < 25, *span)


_POINT = "SELECT user_id, (event_type IN ('view', 'click'))::INTEGER AS state, epoch_us(ts) // 1000 AS ms FROM events"
STATE_SQL = f"SELECT user_id, sum(CASE WHEN state = 1 THEN nxt - ms END)::BIGINT AS state_ms FROM (SELECT user_id, state, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS nxt FROM (SELECT user_id, ms, max(state) AS state FROM ({_POINT}) GROUP BY user_id, ms)) GROUP BY user_id"


def state_points(spark, d):
    e = adapter.table(spark, d, "events")
    return e.select("user_id", F.col("event_type").isin("view", "click").cast("int").alias("state"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("state_time", STATE_SQL)
def state_time(spark, d):
    return aggregates.state_time(state_points(spark, d), ["user_id"], "state", "ms")


@query("last_value_agg", S + 'SELECT id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, max_by(attributeValue, (ts, "offset")) AS attributeValue FROM attr_log GROUP BY ALL')
def last_value_agg(spark, d):
    return aggregates.last_value_agg(log(spark, d), ["id"], "1 hour", "ts", "offset").select("id", "window_start", "attributeValue")


@query("string_agg", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_type) AS texts FROM events GROUP BY user_id")
def string_agg(spark, d):
    return aggregates.string_agg(adapter.table(spark, d, "events"), ["user_id"], "event_type", "ts", ">")


_TRUST = "r AS (SELECT user_id AS binding, event_type AS \"datasetId\", event_id % 3 AS part, value / 1000 AS trust FROM events), k AS (SELECT user_id AS binding, 3::BIGINT AS parts, max(value) / 1200 AS trust FROM events GROUP BY user_id)"


@query("trust_level", f"WITH {_TRUST} SELECT g.binding, \"datasetId\", CASE WHEN n = parts AND different = parts THEN least(least_, k.trust) ELSE 0.0 END AS trust FROM (SELECT binding, \"datasetId\", min(trust) AS least_, count(*) AS n, count(DISTINCT part) AS different FROM r GROUP BY ALL) g JOIN k ON k.binding = g.binding")
def trust_level(spark, d):
    e = adapter.table(spark, d, "events")
    results = e.select(F.col("user_id").alias("binding"), F.col("event_type").alias("datasetId"), (F.col("event_id") % 3).alias("part"), (F.col("value") / 1000).alias("trust"))
    bindings = e.groupBy(F.col("user_id").alias("binding")).agg(F.lit(3).cast("long").alias("parts"), (F.max("value") / 1200).alias("trust"))
    return aggregates.trust_level(results, bindings)


@query("firmware_pick", "SELECT p_brand AS binding, p_type AS firmware, p_partkey FROM (SELECT *, bool_or(p_type = 'PROMO') OVER (PARTITION BY p_brand) AS has, min(p_type) OVER (PARTITION BY p_brand) AS first_ FROM part) WHERE p_type = CASE WHEN has THEN 'PROMO' ELSE first_ END")
def firmware_pick(spark, d):
    p = adapter.table(spark, d, "part").select(F.col("p_brand").alias("binding"), F.col("p_type").alias("firmware"), "p_partkey")
    return aggregates.firmware_pick(p, "PROMO")


# Scalar functions


def _values(spark, d):
    return attrs(spark, d).where(F.col("name").isin("totalPrice", "size", "brand")).select("id", F.col("attributeValue").alias("v"))


_VALUES = "vals AS (SELECT id, attributeValue AS v FROM attributes WHERE name IN ('totalPrice', 'size', 'brand'))"


@query("cast_int", S + f", {_VALUES} SELECT id, CASE WHEN regexp_matches(v, '^[+-]?\\d+$') THEN v::INTEGER END AS v FROM vals")
def cast_int(spark, d):
    return _values(spark, d).select("id", terms.cast_int(F.col("v")).alias("v"))


@query("cast_float", S + f", {_VALUES} SELECT id, try_cast(v AS DOUBLE) AS v FROM vals")
def cast_float(spark, d):
    return _values(spark, d).select("id", terms.cast_float(F.col("v")).alias("v"))


@query("cast_string", "SELECT o_orderkey, o_custkey::VARCHAR AS v FROM orders")
def cast_string(spark, d):
    return adapter.table(spark, d, "orders").select("o_orderkey", terms.cast_string(F.col("o_custkey")).alias("v"))


@query("cast_datetime_ms", "SELECT event_id, epoch_ms(date_trunc('second', ts)) AS ms FROM events")
def cast_datetime_ms(spark, d):
    return adapter.table(spark, d, "events").select("event_id", terms.cast_datetime_ms(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ms"))


@query("now", "SELECT o_orderkey, true AS past FROM orders")
def now(spark, d):
    return adapter.table(spark, d, "orders").select("o_orderkey", (F.current_timestamp() > F.col("o_orderdate")).alias("past"))


@query("if_expr", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'dear' ELSE 'cheap' END AS v FROM orders")
def if_expr(spark, d):
    return adapter.table(spark, d, "orders").select("o_orderkey", terms.if_expr(F.col("o_totalprice") > 200000, F.lit("dear"), F.lit("cheap")).alias("v"))


@query("bound", S + "SELECT id, valueType IS NOT NULL AS v FROM attributes")
def bound(spark, d):
    return attrs(spark, d).select("id", terms.bound(F.col("valueType")).alias("v"))


@query("add_sub", "SELECT o_orderkey, o_totalprice + 1.5 - o_custkey AS v FROM orders")
def add_sub(spark, d):
    return adapter.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") + 1.5 - F.col("o_custkey")).alias("v"))


@query("mul_div", "SELECT o_orderkey, o_totalprice * 2 / (o_custkey + 1) AS v FROM orders")
def mul_div(spark, d):
    return adapter.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 2 / (F.col("o_custkey") + 1)).alias("v"))


@query("strip_iri", b.GRAPH + "SELECT subject, regexp_replace(object, '^<(.*)>$', '\\1') AS v FROM rdf")
def strip_iri(spark, d):
    return adapter.rdf(spark, d).select("subject", terms.strip_iri(F.col("object")).alias("v"))


@query("strip_literal", b.GRAPH + "SELECT subject, trim(object, '\"') AS v FROM rdf")
def strip_literal(spark, d):
    return adapter.rdf(spark, d).select("subject", terms.strip_literal(F.col("object")).alias("v"))


@query("wrap_iri", S + "SELECT '<' || id || '>' AS v FROM entities")
def wrap_iri(spark, d):
    return ents(spark, d).select(terms.wrap_iri(F.col("id")).alias("v"))


@query("wrap_literal", S + "SELECT '\"' || type || '\"' AS v FROM entities")
def wrap_literal(spark, d):
    return ents(spark, d).select(terms.wrap_literal(F.col("type")).alias("v"))


@query("term_format", S + "SELECT id, CASE WHEN nodeType = '@id' THEN '<' || attributeValue || '>' WHEN valueType LIKE '%double' THEN attributeValue ELSE '\"' || attributeValue || '\"' END AS v FROM attributes")
def term_format(spark, d):
    kind = F.when(F.col("nodeType") == "@id", "iri").when(F.col("valueType").endswith("double"), "number").otherwise("literal")
    return attrs(spark, d).select("id", terms.term_format(kind, F.col("attributeValue")).alias("v"))


@query("local_name", S + "SELECT id, regexp_extract(type, '([^/#]*)$', 1) AS v FROM attributes")
def local_name(spark, d):
    return attrs(spark, d).select("id", terms.local_name(F.col("type")).alias("v"))


@query("snake_case", S + "SELECT DISTINCT name, lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s-]+', '_', 'g')) AS v FROM attributes")
def snake_case(spark, d):
    return attrs(spark, d).select("name", terms.snake_case(F.col("name")).alias("v")).distinct()


@query("kebab_case", S + "SELECT DISTINCT name, lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[\\s_]+', '-', 'g')) AS v FROM attributes")
def kebab_case(spark, d):
    return attrs(spark, d).select("name", terms.kebab_case(F.col("name")).alias("v")).distinct()


@query("hash_id", S + "SELECT id, substr(sha256(name || chr(92) || datasetId), 1, 24) AS v FROM attributes")
def hash_id(spark, d):
    return attrs(spark, d).select("id", terms.hash_id(F.col("name"), F.col("datasetId")).alias("v"))


@query("iso_millis", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS v FROM events")
def iso_millis(spark, d):
    return adapter.table(spark, d, "events").select("event_id", terms.iso_millis(F.col("ts")).alias("v"))


@query("json_object_test", S + "SELECT id, json_type(attributeValue) = 'OBJECT' AS v FROM attributes WHERE name IN ('meta', 'dims')")
def json_object_test(spark, d):
    return attrs(spark, d).where(F.col("name").isin("meta", "dims")).select("id", terms.json_object_test(F.col("attributeValue")).alias("v"))


@query("json_array_test", S + "SELECT id, json_type(attributeValue) = 'ARRAY' AS v FROM attributes WHERE name IN ('meta', 'dims')")
def json_array_test(spark, d):
    return attrs(spark, d).where(F.col("name").isin("meta", "dims")).select("id", terms.json_array_test(F.col("attributeValue")).alias("v"))


def _nodeid():
    return F.concat(F.when(F.col("p_partkey") % 3 == 0, "").otherwise("ns=2;"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("i="), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("s="), "p_brand")))


_NODEID = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS ns, CASE WHEN p_partkey % 2 = 0 THEN 'i' ELSE 's' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE p_brand END AS value FROM part"


@query("parse_nodeid", _NODEID)
def parse_nodeid(spark, d):
    return adapter.table(spark, d, "part").select("p_partkey", terms.parse_nodeid(_nodeid()).alias("x")).select("p_partkey", "x.ns", "x.kind", "x.value")


@query("nodeid_to_iri", f"SELECT p_partkey, 'http://x/' || ns || '/node' || kind || value AS iri FROM ({_NODEID})")
def nodeid_to_iri(spark, d):
    ns = F.when(F.col("p_partkey") % 3 == 0, "http://x/0/").otherwise("http://x/2/")
    return adapter.table(spark, d, "part").select("p_partkey", terms.nodeid_to_iri(_nodeid(), ns).alias("iri"))


_TYPES = ("Boolean", "Int32", "Double", "String", "Number", "Structure")


def _typed(spark, d):
    return adapter.table(spark, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("t"), (F.col("p_partkey") % 3 - 1).alias("rank"))


@query("map_datatype", "SELECT p_partkey, ([" + ", ".join(f"'{x}'" for x in (m.XSD + "boolean", m.XSD + "integer", m.XSD + "double", m.XSD + "string", m.XSD + "double|" + m.XSD + "integer", "json")) + "])[p_partkey % 6 + 1] AS v FROM part")
def map_datatype(spark, d):
    return _typed(spark, d).select("p_partkey", F.array_join(terms.map_datatype(F.col("t")), "|").alias("v"))


@query("default_value", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN x ELSE '[' || CASE WHEN p_partkey % 3 = 1 THEN x || ',' || x || ',' || x || ',' || x ELSE x || ',' || x || ',' || x || ',' || x END || ']' END AS v FROM (SELECT p_partkey, (['false', '0', '0.0', '', '0.0', ''])[p_partkey % 6 + 1] AS x FROM part)")
def default_value(spark, d):
    t = _typed(spark, d)
    return t.select("p_partkey", terms.default_value(F.get(terms.map_datatype(F.col("t")), F.lit(0)), F.col("rank"), F.array(F.lit(2), F.lit(2))).alias("v"))


@query("udf_hash", "SELECT o_orderkey, o_custkey * 12 AS v FROM orders")
def udf_hash(spark, d):
    return adapter.table(spark, d, "orders").select("o_orderkey", terms.times_twelve(F.col("o_custkey")).alias("v"))


@query("register_functions", "SELECT o_orderkey, o_custkey * 12 AS v FROM orders")
def register_functions(spark, d):
    """An Arrow-batched function, callable from SQL by its name."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("bigint")
    def twelve(x: pd.Series) -> pd.Series:
        return x * 12

    spark.udf.register("twelve", twelve)
    return adapter.table(spark, d, "orders").selectExpr("o_orderkey", "twelve(o_custkey) AS v")


@query("udaf_state_time", STATE_SQL)
def udaf_state_time(spark, d):
    """The same totals by a grouped Arrow aggregate, as a cross-check of the window form."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("bigint")
    def total(state: pd.Series, ms: pd.Series) -> int:
        import numpy as np

        points = dict(sorted(zip(ms.tolist(), state.tolist())))
        t = np.array(sorted(points))
        held = [b - a for a, b in zip(t[:-1], t[1:]) if points[a] == 1]
        return int(sum(held)) if held else None

    p = state_points(spark, d).groupBy("user_id", "ms").agg(F.max("state").alias("state"))
    return p.groupBy("user_id").agg(total("state", "ms").alias("state_ms"))
