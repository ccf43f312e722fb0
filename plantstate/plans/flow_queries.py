"""Queries of sources, change-data capture, telemetry, history, updates, alerts and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantstate import model as m

from plantstate.operators import aggregates, alerts, cdc, checks, graph, history, telemetry, updates
from plantstate.plans import base_sql as b
from plantstate.plans.registry import query
from plantstate.plans.state_queries import LATEST, STATE_SQL
from plantstate.sources import adapter, logs
from plantstate.sources.adapter import table
from plantstate.streaming import flows
from plantstate.streaming.views import AlertView

S = b.STATE
USER = "'urn:user:' || user_id"


def user() -> Column:
    return F.concat(F.lit("urn:user:"), F.col("user_id").cast("string"))


# Sources and sinks


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON records, every 50th of them broken."""
    e = table(spark, d, "events")
    record = F.to_json(F.struct("event_id", "event_type", "value"))
    return e.select(F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(record).alias("value"), F.col("ts").alias("timestamp"))


@query("src_json_log", "SELECT event_id, event_type, value, ts FROM events WHERE event_id % 50 <> 0")
def src_json_log(spark, d):
    return logs.json_log(_lines(spark, d), "event_id bigint, event_type string, value double")


@query("src_upsert_log", "SELECT user_id::VARCHAR AS id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, event_id % 5 = 0 AS deleted, ts FROM events")
def src_upsert_log(spark, d):
    e = table(spark, d, "events").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("id"))).alias("key"), F.when(F.col("event_id") % 5 != 0, F.to_json(F.struct("event_type"))).alias("value"), F.col("ts").alias("timestamp"))
    return logs.upsert_log(e, "event_type string", ["id"])


@query("src_cdc_table", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 3 = 0")
def src_cdc_table(spark, d):
    c = table(spark, d, "customer")
    row = lambda df, v, deleted, day: df.select(F.col("c_custkey").alias("id"), v.alias("v"), F.lit(deleted).alias("deleted"), F.lit(f"2024-01-0{day}").cast("timestamp").alias("ts"))
    changes = row(c.where("c_custkey % 7 = 0"), F.col("c_mktsegment"), True, 2).unionByName(row(c.where("c_custkey % 3 = 0"), F.lit("new"), False, 3))
    return logs.cdc_table(row(c, F.col("c_mktsegment"), False, 1), changes, ["id"]).select("id", "v")


@query("sink_upsert", S + f", {LATEST} SELECT id, attributeValue, ts FROM latest")
def sink_upsert(spark, d):
    """Two batches of the log merged into one table."""
    path = flows.folder(spark, "upsert")
    log = adapter.attribute_log(spark, d).select("id", "attributeValue", "ts", "offset")
    for part in (0, 1):
        logs.upsert(log.where(F.col("offset") % 2 == part), path, ["id"], "ts", "offset")
    return logs.read_upserted(spark, path).select("id", "attributeValue", "ts")


HISTORY_SQL = S + "SELECT id, ts AS observedAt, name AS attributeId, CASE WHEN regexp_matches(attributeValue, '^[+-]?\\d+\\.0+$') THEN regexp_extract(attributeValue, '^([+-]?\\d+)', 1) ELSE attributeValue END AS value, deleted FROM attr_log QUALIFY row_number() OVER (PARTITION BY id, ts, datasetId ORDER BY \"offset\" DESC) = 1"


@query("sink_attribute_history", HISTORY_SQL)
def sink_attribute_history(spark, d):
    """Two batches of the log that share days merged into one history."""
    path = flows.folder(spark, "history")
    log = adapter.attribute_log(spark, d)
    for part in (0, 1):
        # By key, so that points of one key keep the order of their offsets.
        logs.merge_history(log.where(F.pmod(F.xxhash64("id", "ts", "datasetId"), F.lit(2)) == part), path)
    return logs.read_history(spark, path).select("id", "observedAt", "attributeId", "value", "deleted")


@query("attribute_history", HISTORY_SQL)
def attribute_history(spark, d):
    return history.attribute_history(adapter.attribute_log(spark, d)).select("id", "observedAt", "attributeId", "value", "deleted")


@query("sink_entity_history", S + "SELECT id, ts AS observedAt, type, deleted FROM entities")
def sink_entity_history(spark, d):
    """Two batches of the entities that share days merged into one history."""
    path = flows.folder(spark, "history")
    for part in (0, 1):
        logs.merge_history(adapter.entities(spark, d).where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), path, entity=True)
    return logs.read_history(spark, path).select("id", "observedAt", "type", "deleted")


@query("src_nodeset_xml", "SELECT 'ns=1;i=' || p_partkey AS node, 'HasTypeDefinition' AS type, true AS forward, 'ns=1;s=' || p_type AS target FROM part UNION ALL SELECT 'ns=1;i=' || p_partkey, 'HasComponent', false, 'ns=1;s=' || p_brand FROM part")
def src_nodeset_xml(spark, d):
    """Parts written as node set XML and read again."""
    # A file is read by one task, so it is written from a part of a size.
    p = adapter.spread(table(spark, d, "part"), "p_partkey")
    ref = lambda kind, forward, to: F.struct(F.lit(kind).alias("_ReferenceType"), F.lit(forward).alias("_IsForward"), F.concat(F.lit("ns=1;s="), to).alias("_VALUE"))
    rows = p.select(F.concat(F.lit("ns=1;i="), F.col("p_partkey").cast("string")).alias("_NodeId"), F.col("p_name").alias("_BrowseName"), F.struct(F.array(ref("HasTypeDefinition", True, F.col("p_type")), ref("HasComponent", False, F.col("p_brand"))).alias("Reference")).alias("References"))
    path = flows.folder(spark, "nodes")
    rows.write.format("xml").option("rowTag", "UAVariable").option("rootTag", "UANodeSet").save(path)
    return logs.nodeset_references(logs.nodeset_rows(spark, path, "UAVariable", rows.schema))


# Change-data capture: orders with an older and a newer image


def order_doc(price: Column, sync: Column) -> Column:
    n = m.NGSI
    return F.concat(
        F.lit('{"urn:price":[{"@type":["' + m.PROPERTY + f'"],"{n}hasValue":[{{"@value":"'), price, F.lit('","@type":"' + m.XSD + f'double"}}],"{n}unitCode":[{{"@value":"EUR"}}],"urn:vat":[{{"@type":["{m.PROPERTY}"],"{n}hasValue":[{{"@value":"'), F.col("o_orderpriority"),
        F.lit(f'"}}]}}]}}],"urn:by":[{{"@type":["{m.RELATIONSHIP}"],"{n}hasObject":[{{"@id":"urn:customer:'), F.col("o_custkey").cast("string"), F.lit(f'"}}]}}],"urn:odd":[{{"@type":["Unknown"]}}],"urn:list":[{{"@type":["{m.LIST_PROPERTY}"],"{n}hasValueList":[{{"@list":[1,2]}}],"{n}datasetId":[{{"@id":"urn:d1"}}]}}],"urn:sync":"'), sync, F.lit('"}'),
    )


def changes(spark: SparkSession, d: str) -> DataFrame:
    o = adapter.spread(table(spark, d, "orders"), "o_orderkey")
    k = F.col("o_orderkey")
    image = lambda price, sync: F.struct(F.concat(F.lit("urn:order:"), k.cast("string")).alias("id"), F.array(F.lit("Order")).alias("e_types"), order_doc(price, sync).alias("entity"))
    old, new = adapter.decimal_text("o_totalprice"), adapter.decimal_text(F.when(k % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return o.select(F.when(k % 5 != 0, image(old, F.lit("a"))).alias("before"), F.when(k % 7 != 0, image(new, F.when(k % 11 == 0, "b").otherwise("a"))).alias("after"))


def flat(spark, d, side: str) -> DataFrame:
    return cdc.cdc_flatten(cdc.cdc_entity(changes(spark, d), side).select("id", "entity"))


_H = "substr(sha256({} || chr(92) || '{}'), 1, 24)".format
_NEW = "CAST(CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(18,2)) AS VARCHAR)"


def flat_sql(side: str) -> str:
    price, keep = (b._DEC("o_totalprice"), "o_orderkey % 5 <> 0") if side == "before" else (_NEW, "o_orderkey % 7 <> 0")
    e, s = "'urn:order:' || o_orderkey", "chr(92)"
    return f"""SELECT {e} || {s} || 'urn:price' AS id, NULL::VARCHAR AS parentId, {e} AS entityId, 'urn:price' AS name, '{m.PROPERTY}' AS type, '@value' AS nodeType, '{m.XSD}double' AS valueType, {price} AS attributeValue, '@none' AS datasetId, 'EUR' AS unitCode FROM orders WHERE {keep}
    UNION ALL SELECT {e} || {s} || {_H(f"{e} || {s} || 'urn:price' || {s} || 'urn:vat'", '@none')}, {e} || {s} || 'urn:price', {e}, 'urn:vat', '{m.PROPERTY}', '@value', NULL, o_orderpriority, '@none', NULL FROM orders WHERE {keep}
    UNION ALL SELECT {e} || {s} || 'urn:by', NULL, {e}, 'urn:by', '{m.RELATIONSHIP}', '@id', NULL, 'urn:customer:' || o_custkey, '@none', NULL FROM orders WHERE {keep}
    UNION ALL SELECT {e} || {s} || {_H("'urn:list'", 'urn:d1')}, NULL, {e}, 'urn:list', '{m.LIST_PROPERTY}', '@list', NULL, '[1,2]', 'urn:d1', NULL FROM orders WHERE {keep}"""


FLAT = ["id", "parentId", "entityId", "name", "type", "nodeType", "valueType", "attributeValue", "datasetId", "unitCode"]


@query("cdc_flatten", flat_sql("after"))
def cdc_flatten(spark, d):
    return flat(spark, d, "after").select(*FLAT)


@query("src_jsonld_entities", flat_sql("before"))
def src_jsonld_entities(spark, d):
    docs = changes(spark, d).where(F.col("before").isNotNull()).select(F.concat(F.lit('{"@id":"'), "before.id", F.lit('","@type":["Order"],'), F.substr("before.entity", F.lit(2))).alias("doc"))
    return logs.entity_documents(docs)[1].select(*FLAT)


DIFF_SQL = f"""diff AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'deleted' WHEN b.id IS NULL THEN 'inserted' WHEN a.attributeValue IS DISTINCT FROM b.attributeValue THEN 'updated' END AS op, coalesce(a.entityId, b.entityId) AS entityId, a.attributeValue
  FROM ({flat_sql('after')}) a FULL JOIN ({flat_sql('before')}) b ON a.id = b.id)"""


@query("cdc_diff", f"WITH {DIFF_SQL} SELECT * FROM diff WHERE op IS NOT NULL")
def cdc_diff(spark, d):
    return cdc.cdc_changes(changes(spark, d)).select("id", "op", "entityId", "attributeValue")


ENTITY_OPS = "SELECT 'urn:order:' || o_orderkey AS id, 'Order' AS type, CASE WHEN o_orderkey % 5 = 0 THEN 'created' WHEN o_orderkey % 7 = 0 THEN 'deleted' ELSE 'updated' END AS op FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0) AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 11 = 0)"


@query("cdc_entity_diff", ENTITY_OPS)
def cdc_entity_diff(spark, d):
    return cdc.cdc_entity_diff(changes(spark, d))


@query("cdc_loop_guard", "SELECT 'urn:order:' || o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0) AND NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)")
def cdc_loop_guard(spark, d):
    return cdc.cdc_loop_guard(changes(spark, d)).select(F.coalesce("after.id", "before.id").alias("id")).where(F.col("id").isNotNull())


@query("cdc_route", f"WITH {DIFF_SQL} SELECT 'attribute' AS kind, id, op = 'deleted' AS deleted FROM diff WHERE op IS NOT NULL UNION ALL SELECT 'entity', id, op = 'deleted' FROM ({ENTITY_OPS}) WHERE op <> 'updated'")
def cdc_route(spark, d):
    diff = cdc.cdc_changes(changes(spark, d))
    entities, attributes = cdc.cdc_route(diff, cdc.cdc_entity_diff(changes(spark, d)), F.current_timestamp())
    return attributes.select(F.lit("attribute").alias("kind"), "id", "deleted").unionByName(entities.select(F.lit("entity").alias("kind"), "id", "deleted"))


@query("merge_patch", "SELECT 'o' || o_orderkey AS entityId, 'status' AS name, '@none' AS datasetId, CASE WHEN o_orderkey % 2 = 0 THEN 'patched' ELSE o_orderstatus END AS attributeValue FROM orders WHERE o_orderkey % 6 <> 0 UNION ALL SELECT 'x' || o_orderkey, 'status', '@none', 'patched' FROM orders WHERE o_orderkey % 10 = 4")
def merge_patch(spark, d):
    o = table(spark, d, "orders")
    row = lambda df, p, v: df.select(F.concat(F.lit(p), F.col("o_orderkey").cast("string")).alias("entityId"), F.lit("status").alias("name"), F.lit("@none").alias("datasetId"), v.alias("attributeValue"))
    even = o.where("o_orderkey % 2 = 0")
    patches = row(even, "o", F.when(F.col("o_orderkey") % 6 == 0, "urn:ngsi-ld:null").otherwise("patched")).unionByName(row(o.where("o_orderkey % 10 = 4"), "x", F.lit("patched")))
    return cdc.merge_patch(row(o, "o", F.col("o_orderstatus")), patches)


@query("concise_to_normalized", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{\"type\":\"Relationship\",\"object\":\"urn:c:' || o_custkey || '\"}' ELSE '{\"type\":\"Property\",\"value\":' || o_custkey || '}' END AS v FROM orders")
def concise_to_normalized(spark, d):
    c = F.col("o_custkey").cast("string")
    v = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"object":"urn:c:'), c, F.lit('"}'))).when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"value":'), c, F.lit("}"))).otherwise(c)
    return table(spark, d, "orders").select("o_orderkey", cdc.concise_to_normalized(v).alias("v"))


@query("normalized_to_concise", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{\"object\":\"urn:c:' || o_custkey || '\"}' ELSE o_custkey::VARCHAR END AS v FROM orders")
def normalized_to_concise(spark, d):
    c = F.col("o_custkey").cast("string")
    v = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"type":"Relationship","object":"urn:c:'), c, F.lit('"}'))).otherwise(F.concat(F.lit('{"type":"Property","value":'), c, F.lit("}")))
    return table(spark, d, "orders").select("o_orderkey", cdc.normalized_to_concise(v).alias("v"))


# Telemetry: an event is a message of one or two metrics


def messages(spark: SparkSession, d: str) -> DataFrame:
    e = adapter.spread(table(spark, d, "events"), "event_id")
    k = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Property", "Relationship", "JsonProperty", "Other")]), (k % 4 + 1).cast("int"))
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    metric = F.concat(F.lit('{"name":"'), kind, F.lit("/urn:"), "event_type", F.lit('","timestamp":'), ms, F.lit(',"dataType":"String","value":"'), adapter.decimal_text("value"), F.when(k % 3 == 0, '","properties":{"keys":["datasetId","lang"],"values":["urn:d","en"]}}').otherwise('"}'))
    metrics = F.when(k % 20 == 0, "").otherwise(metric)
    payload = F.concat(F.lit('{"timestamp":'), ms, F.when(k % 30 == 7, "").otherwise(F.concat(F.lit(',"seq":'), (k % 256).cast("string"))), F.lit(',"metrics":['), metrics, F.lit("]}"))
    topic = F.concat(F.lit("spBv1.0/acc/"), F.when(k % 10 == 1, "DBIRTH").otherwise("DDATA"), F.lit("/node/"), user())
    return e.select("event_id", topic.alias("topic"), payload.alias("payload"))


_OK = "event_id % 20 <> 0 AND event_id % 30 <> 7"


@query("telemetry_validate", f"SELECT event_id, {_OK} AS ok FROM events")
def telemetry_validate(spark, d):
    return telemetry.telemetry_validate(messages(spark, d)).select("event_id", "ok")


@query("telemetry_to_attributes", f"""SELECT {USER} || chr(92) || substr(sha256('urn:' || event_type || chr(92) || CASE WHEN event_id % 3 = 0 THEN 'urn:d' ELSE '@none' END), 1, 24) AS id, 'urn:' || event_type AS name, (['{m.PROPERTY}', '{m.RELATIONSHIP}', '{m.JSON_PROPERTY}'])[event_id % 4 + 1] AS type, (['@value', '@id', '@json'])[event_id % 4 + 1] AS "nodeType",
  CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS "attributeValue", CASE WHEN event_id % 3 = 0 THEN 'urn:d' ELSE '@none' END AS "datasetId", CASE WHEN event_id % 3 = 0 THEN 'en' END AS lang, date_trunc('millisecond', ts) AS ts FROM events WHERE {_OK} AND event_id % 10 <> 1 AND event_id % 4 < 3""")
def telemetry_to_attributes(spark, d):
    return telemetry.telemetry_to_attributes(telemetry.telemetry_validate(messages(spark, d))).select("id", "name", "type", "nodeType", "attributeValue", "datasetId", "lang", "ts")


SEQ_SQL = "SELECT event_id, CASE WHEN event_id % 97 = 0 THEN seq = 0 ELSE coalesce(seq > before OR (before = 255 AND seq = 0), false) END AS valid FROM (SELECT *, lag(seq) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, event_id % 256 AS seq FROM events))"


@query("seq_check", SEQ_SQL)
def seq_check(spark, d):
    e = table(spark, d, "events").withColumn("seq", F.col("event_id") % 256)
    return telemetry.seq_check(e, "user_id", "seq", ["ts", "event_id"], F.col("event_id") % 97 == 0).select("event_id", "valid")


# Updates and alerts

_FRAG = f"""'{{"observedAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","type":"{m.PROPERTY}","datasetId":"@none","value":' || attributeValue || '}}'"""
TUMBLE_SQL = S + f""", last AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, entityId, name, max_by({_FRAG}, (ts, "offset")) AS j FROM attr_log WHERE NOT synced GROUP BY ALL)
SELECT w AS window_start, 'update' AS op, true AS "overwriteOrReplace", true AS "noForward", '[{{"id":"' || entityId || '",' || string_agg('"' || name || '":[' || j || ']', ',' ORDER BY name) || '}}]' AS entities FROM last GROUP BY w, entityId"""


@query("tumble_updates", TUMBLE_SQL)
def tumble_updates(spark, d):
    return updates.tumble_updates(adapter.attribute_log(spark, d), "1 hour", "offset")


@query("tumble_writeback", S + 'SELECT id, attributeValue, ts, deleted FROM attr_log QUALIFY row_number() OVER (PARTITION BY id, datasetId, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts DESC, "offset" DESC) = 1')
def tumble_writeback(spark, d):
    return updates.tumble_writeback(adapter.attribute_log(spark, d), "1 hour", "offset").select("id", "attributeValue", "ts", "deleted")


@query("update_normalize", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[{\"id\":\"u' || user_id || '\",\"p\":[{\"value\":1}],\"urn:sync\":true}]' ELSE '[{\"id\":\"u' || user_id || '\",\"p\":[{\"value\":1}]}]' END AS entities FROM events WHERE event_id % 9 <> 0")
def update_normalize(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit('[{"id":"u'), F.col("user_id").cast("string"), F.lit('","p":[{"datasetId":"@none","value":1}]}]'))
    u = e.select("event_id", F.lit("update").alias("op"), (F.col("event_id") % 2 == 0).alias("noForward"), F.when(F.col("event_id") % 9 == 0, "broken").otherwise(text).alias("entities"))
    return updates.update_normalize(u).select("event_id", "entities")


def raised(e: DataFrame) -> DataFrame:
    """Events as alerts of their users."""
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "flush").when(F.col("event_type") == "purchase", "ok").otherwise("warning")
    event = F.when(F.col("event_id") % 13 == 0, "heartbeat").otherwise("state")
    return e.select(user().alias("resource"), event.alias("event"), F.when(F.col("event_id") % 11 != 0, severity).alias("severity"), "event_type", F.col("event_type").alias("text"), "ts", "event_id")


_ALERT = f"alert AS (SELECT {USER} AS resource, event_id % 13 = 0 AS heartbeat, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'flush' WHEN 'purchase' THEN 'ok' ELSE 'warning' END END AS severity, event_type AS text, ts, event_id FROM events)"
_CHANGED = "n = 1 OR text IS DISTINCT FROM before OR severity IS DISTINCT FROM before_s"
_BEFORE = "row_number() OVER w AS n, lag(text) OVER w AS before, lag(severity) OVER w AS before_s"


@query("alert_changes", f"WITH {_ALERT} SELECT resource, severity, text, event_id FROM (SELECT *, {_BEFORE} FROM alert WINDOW w AS (PARTITION BY resource ORDER BY ts, event_id)) WHERE {_CHANGED}")
def alert_changes(spark, d):
    return alerts.alert_changes(raised(table(spark, d, "events")), ["resource"], "ts", "event_id").select("resource", "severity", "text", "event_id")


SESSION_SQL = f"""WITH {_ALERT}, s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY resource ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY resource ORDER BY ts, event_id) AS before FROM alert WHERE NOT heartbeat))
SELECT resource, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, arg_max_null(severity, (ts, event_id)) AS severity, max(event_id) FILTER (true) AS n_last FROM s GROUP BY resource, k"""


@query("session_debounce", SESSION_SQL.replace(", max(event_id) FILTER (true) AS n_last", ""))
def session_debounce(spark, d):
    return alerts.session_debounce(raised(table(spark, d, "events")), ["resource"], "6 hours", "ts", "event_id").select("resource", "session_start", "session_end", "severity")


@query("tombstone_to_ok", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE 'major' END AS severity, CASE WHEN event_id % 3 = 0 THEN 'Ok' ELSE event_type END AS text, CASE WHEN event_id % 2 = 0 THEN 'Development' ELSE 'Production' END AS environment FROM events")
def tombstone_to_ok(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.when(k % 3 != 0, "major").alias("severity"), F.when(k % 3 != 0, F.col("event_type")).alias("text"), F.when(k % 2 != 0, "Production").alias("environment"))
    return alerts.tombstone_to_ok(e)


@query("alert_dispatch_filter", "SELECT event_id FROM events WHERE event_id % 4 <> 0 AND event_id % 5 <> 0")
def alert_dispatch_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, "r").alias("resource"), F.when(F.col("event_id") % 5 != 0, "e").alias("event"))
    return alerts.alert_dispatch_filter(e).select("event_id")


@query("alert_retraction", "SELECT o_orderkey, CASE WHEN o_totalprice - 20000 > 300000 THEN 'major' ELSE 'ok' END AS severity FROM orders WHERE o_totalprice > 300000 AND (o_totalprice - 20000 <= 300000 OR o_orderkey % 2 = 0)")
def alert_retraction(spark, d):
    """Violations before and after prices fell by 20000: gone ones become ok, changed ones are sent again."""
    o = table(spark, d, "orders")
    rows = lambda cut_, text: o.where(F.col("o_totalprice") - cut_ > 300000).select("o_orderkey", F.lit("major").alias("severity"), text.alias("text"))
    before = rows(0, F.lit("dear"))
    after = rows(20000, F.when(F.col("o_orderkey") % 2 == 0, "dear still").otherwise("dear"))
    return flows.alert_state(before, after, ["o_orderkey"]).select("o_orderkey", "severity")


# Streams over the events file


def _stream_log(spark, d) -> DataFrame:
    e = flows.event_stream(spark, d)
    null = F.lit(None).cast("string")
    return e.select(user().alias("entityId"), F.concat_ws("\\", user(), "event_type").alias("id"), null.alias("parentId"), F.col("event_type").alias("name"), F.lit("@value").alias("nodeType"), F.lit(m.PROPERTY).alias("type"), adapter.decimal_text("value").alias("attributeValue"), F.lit("@none").alias("datasetId"), F.lit(False).alias("deleted"), (F.col("event_id") % 2 == 0).alias("synced"), "ts", F.col("event_id").alias("offset"))


def _run(spark, d, stream: DataFrame, name: str) -> DataFrame:
    """A stream of the events, with its state in partitions by their size."""
    return flows.run_available(stream, name, tasks=flows.state_tasks(table(spark, d, "events")))


def _shards(spark, d) -> int:
    return flows.shards_of(flows.state_tasks(table(spark, d, "events")))


_CLOSED = "<= (SELECT max(ts) FROM events)"


@query("stream_last_value", S + f'SELECT id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, max_by(attributeValue, (ts, "offset")) AS attributeValue FROM attr_log WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR {_CLOSED} GROUP BY ALL')
def stream_last_value(spark, d):
    """Windows that the watermark has closed, by watermark_monotone() and last_value_agg() on a stream."""
    s = flows.watermark_monotone(_stream_log(spark, d)).select("id", "attributeValue", "ts", "offset")
    return _run(spark, d, aggregates.last_value_agg(s, ["id"], "1 hour", "ts", "offset").select("id", "window_start", "attributeValue"), "last")


@query("stream_session_debounce", f"SELECT resource, session_start, session_end, severity FROM ({SESSION_SQL}) WHERE session_end {_CLOSED}")
def stream_session_debounce(spark, d):
    s = flows.watermark_delay(raised(flows.event_stream(spark, d)), "0 seconds").select("resource", "event", "severity", "text", "ts", "event_id")
    return _run(spark, d, alerts.session_debounce(s, ["resource"], "6 hours", "ts", "event_id").select("resource", "session_start", "session_end", "severity"), "session")


@query("stream_alert_changes", f"WITH {_ALERT} SELECT resource, text, event_id FROM (SELECT *, {_BEFORE} FROM alert WINDOW w AS (PARTITION BY resource ORDER BY ts, event_id)) WHERE {_CHANGED}")
def stream_alert_changes(spark, d):
    s = raised(flows.event_stream(spark, d)).select("resource", "severity", "text", "ts", "event_id")
    return _run(spark, d, flows.alert_changes_stream(s, "resource", ["severity", "text"], ["ts", "event_id"], shards=_shards(spark, d)), "changes").select("resource", "text", "event_id")


def _points() -> list[Column]:
    return [F.col("user_id"), F.col("event_type").isin("view", "click").cast("int").alias("state"), F.unix_millis("ts").alias("ms")]


@query("state_time_stream", STATE_SQL)
def state_time_stream(spark, d):
    """Points come in batches that have nothing to do with their times."""
    return flows.state_time_stream(flows.event_stream(spark, d, mixed=True, columns=_points()), flows.folder(spark, "totals"), "user_id", "state", "ms")


@query("state_time_ends", STATE_SQL)
def state_time_ends(spark, d):
    """Points in order of time, by the rule that only looks at the ends of what is known."""
    return flows.state_time_stream(flows.event_stream(spark, d, columns=_points()), flows.folder(spark, "totals"), "user_id", "state", "ms", compat=True, tasks=flows.state_tasks(table(spark, d, "events")))


@query("state_time_retract", STATE_SQL.replace("FROM events)", "FROM events WHERE event_id % 10 <> 3)"))
def state_time_retract(spark, d):
    """Every tenth point is taken back, in a batch of its own choice."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    both = e.withColumn("removed", F.lit(False)).unionByName(e.where("event_id % 10 = 3").withColumn("removed", F.lit(True)))
    points = flows.replayed(both, F.xxhash64("event_id", "removed"), columns=[*_points(), "removed"])
    return flows.state_time_stream(points, flows.folder(spark, "totals"), "user_id", "state", "ms", "removed")


@query("current_state_stream", S + f", {LATEST} SELECT id, attributeValue, ts FROM latest")
def current_state_stream(spark, d):
    s = _stream_log(spark, d).select("id", "attributeValue", "ts", "offset")
    return flows.current_state_stream(s, ["id"], flows.folder(spark, "view"), "ts", "offset").select("id", "attributeValue", "ts")


@query("seq_check_stream", SEQ_SQL)
def seq_check_stream(spark, d):
    s = flows.event_stream(spark, d).select("user_id", "event_id", "ts", (F.col("event_id") % 256).cast("int").alias("seq"), (F.col("event_id") % 97 == 0).alias("birth"))
    return _run(spark, d, flows.seq_check_stream(s, "user_id", "seq", "birth", ["ts", "event_id"], shards=_shards(spark, d)), "seq").select("event_id", "valid")


def _hours(spark, d, stream: DataFrame, name: str) -> DataFrame:
    return _run(spark, d, aggregates.last_value_agg(stream.select("id", "attributeValue", "ts", "offset"), ["id"], "1 hour", "ts", "offset").select("id", "window_start", "attributeValue"), name)


def _hours_sql(delay: str) -> str:
    return S + f'SELECT id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, max_by(attributeValue, (ts, "offset")) AS attributeValue FROM attr_log WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR + INTERVAL {delay} {_CLOSED} GROUP BY ALL'


@query("watermark_monotone", _hours_sql("0 HOUR"))
def watermark_monotone(spark, d):
    return _hours(spark, d, flows.watermark_monotone(_stream_log(spark, d)), "monotone")


@query("watermark_delay", _hours_sql("5 HOUR"))
def watermark_delay(spark, d):
    return _hours(spark, d, flows.watermark_delay(_stream_log(spark, d), "5 hours"), "delay")


@query("idle_sources", _hours_sql("0 HOUR"))
def idle_sources(spark, d):
    """A second source has no records that count, and its watermark stands still."""
    idle = flows.watermark_monotone(_stream_log(spark, d).where("false"))
    with flows.idle_sources(spark):
        return _hours(spark, d, flows.watermark_monotone(_stream_log(spark, d)).unionByName(idle), "idle")


@query("state_ttl", f"WITH {_ALERT} SELECT resource, text, event_id FROM (SELECT *, {_BEFORE}, lag(ts) OVER w AS since FROM alert WINDOW w AS (PARTITION BY resource ORDER BY ts, event_id)) WHERE {_CHANGED} OR ts - since > INTERVAL 12 HOUR")
def state_ttl(spark, d):
    """State that is twelve hours old has expired, and its timer removes it."""
    s = raised(flows.event_stream(spark, d)).select("resource", "severity", "text", "ts", "event_id")
    return _run(spark, d, flows.alert_changes_stream(s, "resource", ["severity", "text"], ["ts", "event_id"], ttl="12 hours", shards=_shards(spark, d)), "ttl").select("resource", "text", "event_id")


def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Entities and attributes as changes in three batches. A third of the attributes and a fifth of the entities come first
    in another state, a day before."""
    some = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)) == 0
    before = F.col("ts") - F.expr("INTERVAL 1 DAY")
    e, a = adapter.entities(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), adapter.attributes(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    entity = lambda df, batch: df.select(batch.alias("batch"), F.struct("id", "type", "deleted", "ts").alias("entity"), F.lit(None).cast(f"struct<{m.ATTRIBUTES.replace(' ', ':').replace(',:', ',')}>").alias("attribute"))
    attribute = lambda df, batch: df.select(batch.alias("batch"), F.lit(None).cast("struct<id:string,type:string,deleted:boolean,ts:timestamp>").alias("entity"), F.struct(*[c.split(" ")[0] for c in m.ATTRIBUTES.split(", ")]).alias("attribute"))
    later = F.when(some("id", 15), 2).otherwise(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(3)))
    return (
        entity(e.where(some("id", 5)).withColumns({"deleted": ~F.col("deleted"), "ts": before}), F.lit(0))
        .unionByName(entity(e, F.when(some("id", 5), 2).otherwise(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(3)))))
        .unionByName(attribute(a.where(some("id", 3)).withColumns({"attributeValue": F.lit("1"), "ts": before}), F.lit(0)))
        .unionByName(attribute(a, F.when(some("id", 3), F.greatest(F.lit(1), later)).otherwise(later)))
    )


@query("alerts_incremental", b.CHECKS + f", {b.TRIGGERS}, {b.COMBINED} {b.PUBLISHED}")
def alerts_incremental(spark, d):
    """The alerts after three batches of changes, each of which made only what it touched anew."""
    classes = adapter.rdf(spark, d).where(F.col("predicate") == m.SUBCLASS)
    shapes = graph.cut(checks.inherited(adapter.constraints(spark), graph.transitive_closure(classes)))
    view = AlertView(spark, flows.folder(spark, "alerts"), lambda: shapes, adapter.combinations(spark), adapter.constraints(spark), graph.cut(adapter.rdf(spark, d)))
    # Written once, as every batch is taken out of it; and the files of a batch follow the size of its rows, not of the tables they are made of.
    log = graph.cut(change_log(spark, d))

    def each(batch: DataFrame, number: int) -> None:
        one = lambda name: batch.where(F.col(name).isNotNull()).select(f"{name}.*")
        view.apply(one("entity"), one("attribute"), number, stored=True)

    flows.run_batches(flows.replayed(log, F.col("batch"), 3), "alerts", each)
    return view.alerts()
