"""Bucketed tables, segmented scans, and results kept up to date, against full runs."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.operators import aggregates, alerts, checks, segments, state
from plantstate.sources import buckets
from plantstate.streaming import flows
from plantstate.streaming.views import AlertView, StateTimeView

SCHEMA = "k string, ts int, o int, v string"


def folders(spark, path):
    return {p: set(buckets.names(spark, f"{path}/data/{p}")) - {"_SUCCESS"} for p in buckets.names(spark, f"{path}/data")}


def test_a_batch_writes_its_buckets_and_old_data_go(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(1)
    best = {}
    for i in range(9):
        rows = [(rng.choice(["a", "b", None]) if i else f"k{j}", rng.randint(0, 5), j, f"{i}.{j}") for j in range(3 if i else 60)]
        before = {b: list(p) for b, p in buckets.version(spark, path).parts.items()} if i else {}
        assert buckets.upsert(spark.createDataFrame(rows, SCHEMA), path, ["k"], "ts", "o", buckets=8)
        for k, ts, o, v in rows:
            best[k] = max(best.get(k, (-1, 0, "")), (ts, o, v))
        now = buckets.version(spark, path)
        touched = {str(r[0]) for r in spark.createDataFrame(rows, SCHEMA).select(F.pmod(F.xxhash64("k"), F.lit(8))).distinct().collect()}
        assert {b for b in now.parts if now.parts[b] != before.get(b)} == touched
        assert all(len(p) <= buckets.DELTAS for p in now.parts.values())
        assert {r.k: (r.ts, r.o, r.v) for r in buckets.read(spark, path).collect()} == best
    assert buckets.versions(spark, path) == [8, 9]
    named = {p for n in (8, 9) for parts in buckets.version(spark, path, n).parts.values() for p in parts}
    assert {f"{top}/{b}" for top, bs in folders(spark, path).items() for b in bs if b.startswith("_bucket")} == named
    wanted = spark.createDataFrame([("a",), (None,), ("none",)], "x string")
    assert {r.k for r in buckets.read_keys(wanted, path).collect()} == {"a", None} & set(best)
    files = {f.split("_bucket=")[1].split("/")[0] for f in buckets.read_keys(wanted, path).inputFiles()}
    assert len(files) <= 3


def test_numbered_batches_are_applied_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1, 1, "x")], SCHEMA)
    assert buckets.upsert(df, path, ["k"], batch=0)
    assert not buckets.upsert(df.withColumn("ts", F.lit(9)), path, ["k"], batch=0)
    assert buckets.read(spark, path).first().ts == 1
    assert buckets.upsert(df.limit(0), path, ["k"], batch=1) and buckets.read(spark, path).count() == 1
    assert buckets.upsert(df.limit(0), str(tmp_path / "e"), ["k"]) and buckets.read(spark, str(tmp_path / "e")).count() == 0


def test_a_hot_key_is_spread_and_borders_are_stitched(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None]), rng.randint(0, 300), i, rng.choice(["x", "y", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts int, o int, v string")
    w = Window.partitionBy("k").orderBy("ts", "o")
    want = df.withColumns({"_first": F.row_number().over(w) == 1, "p": F.lag("v").over(w), "q": F.lag("o").over(w)})
    got = segments.before(df, ["k"], ["ts", "o"], {"p": "v", "q": "o"}, segments=16)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    dealt = df.repartitionByRange(16, "k", "ts", "o").withColumn("s", F.spark_partition_id())
    assert dealt.where("k = 'hot'").select("s").distinct().count() >= 6
    changes = state.value_change_rows(df, "k", "v", "ts", "o").count()
    assert changes == want.where("_first or not v <=> p").count()
    assert segments.before(df.limit(0), ["k"], ["ts", "o"], {"p": "v"}).count() == 0


def test_segments_of_time_give_the_whole_time(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice("abc"), t, rng.randint(0, 1)) for t in rng.sample(range(1000), 300)] + [("d", 5, 1), ("e", 1, 0), ("e", 9, 0)], "key string, ms bigint, state int")
    parts = aggregates.state_segments(df.withColumn("seg", F.floor(F.col("ms") / 100)), ["key"], "seg", "state", "ms")
    assert sorted(aggregates.state_of_segments(parts, ["key"], "seg").collect()) == sorted(aggregates.state_time(df, ["key"], "state", "ms").collect())


def test_state_time_in_any_order_with_points_taken_back(spark, tmp_path):
    rng = random.Random(4)
    points = [(rng.choice("ab"), rng.randint(0, 400), rng.randint(0, 1), False) for _ in range(120)] + [("c", 7, 1, False), (None, 3, 1, False)]
    gone = [p[:3] + (True,) for p in rng.sample(points, 40)] + [("c", 7, 1, True), ("a", None, 1, False), ("a", 3, None, False)]
    log = points + gone
    rng.shuffle(log)
    view = StateTimeView(spark, str(tmp_path / "v"), width_ms=50, n_buckets=4)
    schema = "key string, ms bigint, state int, removed boolean"
    for i in range(4):
        batch = spark.createDataFrame(log[i::4], schema)
        view.apply(batch, i)
        view.apply(batch, i)
        seen = [p for j in range(i + 1) for p in log[j::4]]
        left = {}
        for k, ms, s, removed in seen:
            if k is not None and ms is not None and s is not None:
                left[k, ms, s] = left.get((k, ms, s), 0) + (-1 if removed else 1)
        rest = spark.createDataFrame([k for k, n in left.items() if n > 0], "key string, ms bigint, state int")
        assert sorted(map(repr, view.totals().collect())) == sorted(map(repr, aggregates.state_time(rest, ["key"], "state", "ms").collect()))


def test_state_time_by_the_ends_only(spark, tmp_path):
    for i, rows in enumerate([[("k", 100, 1), ("k", 300, 0)], [("k", 200, 0), ("k", 50, 1), ("k", 400, 0)]]):
        spark.createDataFrame(rows, "key string, ms bigint, state int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key string, ms bigint, state int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ends = flows.state_time_stream(stream(), str(tmp_path / "e"), "key", "state", "ms", compat=True).collect()
    whole = flows.state_time_stream(stream(), str(tmp_path / "w"), "key", "state", "ms").collect()
    assert [r.state_ms for r in ends] == [250] and [r.state_ms for r in whole] == [150]


def attribute(entity, name, value, ts, kind=m.PROPERTY, deleted=False, dataset="@none"):
    node = "@id" if kind == m.RELATIONSHIP else "@value"
    return (f"{entity}\\{name}\\{dataset}", None, entity, name, node, None, kind, value, dataset, None, None, deleted, True, ts)


def constraint_rows(spark, rows):
    return spark.createDataFrame([(i, *(row.get(c) for c in m.CONSTRAINT_COLUMNS)) for i, row in rows], m.CONSTRAINTS)


def full_alerts(entities, attributes, shapes, combos, rdf):
    e, a = state.latest_by_key(entities, ["id"]), state.latest_by_key(attributes, ["id"])
    fired = checks.chk_all_rel(checks.check_base_rel(e, a, shapes)).unionByName(checks.chk_all_prop(checks.check_base_prop(e, a, shapes, rdf)))
    return checks.publish_alerts(fired.unionByName(checks.combine_or(fired, combos, shapes)), combos)


def test_alerts_after_each_batch_are_those_of_a_full_run(spark, tmp_path):
    from datetime import datetime, timedelta

    rng, start = random.Random(5), datetime(2024, 1, 1)
    base = [
        (1, {"targetClass": "T", "propertyPath": "p", "attributeType": m.PROPERTY, "propertyNodetype": "@value", "minCount": "1", "maxCount": "1", "severity": "warning", "maxInclusive": "50"}),
        (2, {"targetClass": "T", "propertyPath": "r", "attributeType": m.RELATIONSHIP, "propertyClass": "U", "minCount": "1", "severity": "major"}),
        (3, {"targetClass": "T", "propertyPath": "p", "attributeType": m.PROPERTY, "propertyNodetype": "@value", "severity": "minor", "pattern": "^[0-9]+$"}),
        (9, {"targetClass": "T", "severity": "critical"}),
    ]
    tighter = [(i, row | ({"maxInclusive": "20"} if i == 1 else {})) for i, row in base]
    asked = [base]
    combos = spark.createDataFrame([(1, "PUBLISH", 1), (2, "PUBLISH", 2), (1, "OR", 9), (3, "OR", 9), (9, "PUBLISH", 9)], m.COMBINATIONS)
    rdf = spark.createDataFrame([], m.RDF)
    view = AlertView(spark, str(tmp_path / "v"), lambda: constraint_rows(spark, asked[0]), combos, constraint_rows(spark, base), rdf, n_buckets=4)
    entities, attributes, known = [], [], {}
    for i in range(5):
        ts = start + timedelta(hours=i)
        ids = [f"t{j}" for j in range(25)] if i == 0 else rng.sample([f"t{j}" for j in range(25)], 4)
        new_e = [(x, "T", i > 0 and rng.random() < 0.3, ts) for x in ids] + ([(f"u{j}", rng.choice("UV"), False, ts) for j in range(5)] if i == 0 else [(f"u{i}", rng.choice("UV"), True, ts)])
        new_a = [attribute(x, "p", rng.choice(["10", "30", "70", "x"]), ts, deleted=rng.random() < 0.2) for x in ids]
        new_a += [attribute(x, "p", "5", ts, dataset="d2", deleted=rng.random() < 0.6) for x in ids[:3]]
        new_a += [attribute(x, "r", f"u{rng.randint(0, 5)}", ts, m.RELATIONSHIP) for x in ids if rng.random() < 0.8]
        if i == 3:
            asked[0] = tighter
        if i == 4:
            new_e, new_a = [], []
        entities, attributes = entities + new_e, attributes + new_a
        e, a = spark.createDataFrame(new_e, m.ENTITIES), spark.createDataFrame(new_a, m.ATTRIBUTES)
        sent = {(r.resource, r.event): (r.severity, r.text) for r in view.apply(e, a, i).collect()}
        want = {(r.resource, r.event): (r.severity, r.text) for r in full_alerts(spark.createDataFrame(entities, m.ENTITIES), spark.createDataFrame(attributes, m.ATTRIBUTES), constraint_rows(spark, asked[0]), combos, rdf).collect()}
        assert {(r.resource, r.event): (r.severity, r.text) for r in view.alerts().collect()} == want
        assert sent == {k: v for k, v in want.items() if known.get(k) != v} | {k: ("ok", "Ok") for k in known if k not in want}
        assert {(r.resource, r.event): (r.severity, r.text) for r in view.apply(e, a, i).collect()} == sent
        known = want
    assert not sent


def test_state_expires_and_its_timer_removes_it(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "k string, s string, t string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("k string, s string, t string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = flows.alert_changes_stream(stream, "k", ["s", "t"], ["ts"], ttl="1 hour")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = {(r.k, r.s, r.t, str(r.ts)[11:16]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        return rows, [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]

    put([("a", "ok", "x", "2024-01-01 00:00:00"), ("b", "ok", "x", "2024-01-01 00:00:00"), ("a", "ok", "x", "2024-01-01 00:10:00")])
    put([("a", "major", "x", "2024-01-01 00:20:00"), ("a", None, "x", "2024-01-01 00:30:00")])
    rows, total = run()
    assert len(rows) == 4
    assert ("a", None, "x", "00:30") in rows and max(total) == 2
    put([("c", "ok", "x", "2024-01-01 03:00:00")])
    put([("c", "ok", "x", "2024-01-01 03:10:00"), ("b", "ok", "x", "2024-01-01 03:10:00")])
    rows, total = run()
    assert total[-1] == 2 and ("b", "ok", "x", "03:10") in rows and ("c", "ok", "x", "03:10") not in rows


def test_heartbeats_go_and_tombstones_stay(spark):
    df = spark.createDataFrame([("r", "state", "major", "x", "2024-01-01 00:00:00"), ("r", "heartbeat", "flush", None, "2024-01-01 00:00:30"), ("r", "state", None, None, "2024-01-01 00:00:40"), ("r", "state", "flush", "y", "2024-01-01 02:00:00"), ("r", None, "ok", "z", "2024-01-01 04:00:00")], "resource string, event string, severity string, text string, ts string")
    got = alerts.session_debounce(df.withColumn("ts", F.col("ts").cast("timestamp")), ["resource"], "1 minute").orderBy("session_start").collect()
    assert [(r.severity, r.text) for r in got] == [(None, None), ("flush", "y"), ("ok", "z")]


def test_a_batch_of_points_takes_few_jobs_and_empties_keys(spark, tmp_path):
    schema = "key string, ms bigint, state int, removed boolean"
    view = StateTimeView(spark, str(tmp_path / "v"), width_ms=50, n_buckets=4)
    batches = [
        [("a", 10, 1, False), ("a", 120, 0, False), ("a", 130, 0, None), ("b", 5, 1, False), ("c", 1, 0, False)],
        [("a", 60, 0, False), ("b", 5, 1, True), ("a", 130, 0, True), ("d", 9, 1, True)],
        [("b", 7, 1, False), ("b", 300, 1, False), ("d", 9, 1, False), ("d", 9, 1, False)],
    ]
    want = [
        {"a": (110, False), "b": (None, False), "c": (None, False)},
        {"a": (50, False), "b": (None, True), "d": (None, True)},
        {"b": (293, False), "d": (None, False)},
    ]
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        spark.sparkContext.setJobGroup(f"points {number}", "")
        got = view.apply(df, number)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"points {number}"))
        assert {r.key: (r.state_ms, r.deleted) for r in got.collect()} == want[number]
        assert {r.key: (r.state_ms, r.deleted) for r in view.apply(df, number).collect()} == want[number]
        assert jobs <= 16, jobs
    spark.sparkContext.setJobGroup("", "")
    # A batch before the last one changes nothing, and its keys are those it touches.
    assert {r.key for r in view.apply(spark.createDataFrame(batches[0], schema), 0).collect()} == {"a", "b", "c"}
    assert {r.key: r.state_ms for r in view.totals().collect()} == {"a": 50, "b": 293, "c": None, "d": None}


def test_a_streamed_batch_of_points_writes_two_parts_besides_its_tables(spark, tmp_path, monkeypatch):
    from plantstate.streaming import views

    rng, parts, cut = random.Random(7), [], views.cut
    rows = [(rng.choice("abc"), rng.randint(0, 10**9), rng.randint(0, 1)) for _ in range(90)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], "key string, ms bigint, state int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    monkeypatch.setattr(views, "cut", lambda df: parts.append(df.columns) or cut(df))
    stream = spark.readStream.schema("key string, ms bigint, state int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = flows.state_time_stream(stream, str(tmp_path / "w"), "key", "state", "ms").collect()
    whole = aggregates.state_time(spark.read.parquet(str(tmp_path / "in")), ["key"], "state", "ms").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and len(parts) <= 2 * 3


def test_a_late_point_writes_itself_and_its_segment_only(spark, tmp_path, monkeypatch):
    from plantstate.streaming import views

    written, cut = [], views.cut
    monkeypatch.setattr(views, "cut", lambda df: written.append(cut(df)) or written[-1])
    schema = "key string, ms bigint, state int, removed boolean"
    view = StateTimeView(spark, str(tmp_path / "v"), width_ms=1000, n_buckets=2)
    first = [("a", t, 1, False) for t in range(0, 1000, 2)] + [("a", 2500, 0, False), ("b", 7, 0, False), ("b", 7, 1, False), ("b", 9, 2, False)]
    assert {tuple(r) for r in view.apply(spark.createDataFrame(first, schema), 0).collect()} == {("a", 2500, False), ("b", 2, False)}
    written.clear()
    # In the middle of a segment: a row for the point and one for the segment, of 501 points.
    assert view.apply(spark.createDataFrame([("a", 501, 0, False)], schema), 1).first()["state_ms"] == 2499
    assert written[0].count() <= 2
    # Both ends of a segment go, and one of two points of one time.
    gone = [("a", 0, 1, True), ("a", 998, 1, True), ("b", 7, 1, True)]
    assert {tuple(r) for r in view.apply(spark.createDataFrame(gone, schema), 2).collect()} == {("a", 2497, False), ("b", None, False)}


def test_a_replayed_stream_has_the_columns_that_are_asked_for(spark, tmp_path):
    spark.range(40).selectExpr("id", "id % 3 AS k", "'long text' AS t").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.replayed(spark.read.parquet(str(tmp_path / "in")), F.xxhash64("id"), columns=["k", (F.col("id") * 2).alias("v")])
    got = flows.run_available(stream, "copy")
    assert got.columns == ["k", "v"] and sorted(map(tuple, got.collect())) == sorted((i % 3, 2 * i) for i in range(40))


def test_wanted_rows_are_asked_for_before_the_newest(spark, tmp_path):
    """Rows of a key lie where those that are wanted were looked for, and only the columns that are asked for are dealt out."""
    path = str(tmp_path / "t")
    schema = "k string, id string, ts int, v string, rest string"
    for i in range(3):
        buckets.upsert(spark.createDataFrame([(f"k{j % 9}" if j % 10 else None, f"i{j}", i if j % 3 else -i, f"{i}.{j}", "long") for j in range(90)], schema), path, ["id"], by=["k"], buckets=4)
    newest = {r.id: (r.k, r.v) for r in buckets.read(spark, path).collect()}
    for wanted in (["k1", "k5", "none"], ["k2", None]):
        asked = spark.createDataFrame([(w,) for w in wanted], "w string")
        got = buckets.read_keys(asked, path, ["id", "k", "v"])
        assert got.columns == ["id", "k", "v"] and {r.id: (r.k, r.v) for r in got.collect()} == {i: kv for i, kv in newest.items() if kv[0] in wanted}
        assert buckets.read_keys(asked, path).columns == ["k", "id", "ts", "v", "rest"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = buckets.read_keys(spark.createDataFrame([("k1",)], "w string"), path, ["id", "v"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2 and "rest#" not in plan


def test_a_batch_of_files_is_not_written_before(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from plantstate.streaming import views

    written, cut = [], views.cut
    monkeypatch.setattr(views, "cut", lambda df: written.append(df.columns) or cut(df))
    c = constraint_rows(spark, [(1, {"targetClass": "T", "propertyPath": "p", "attributeType": m.PROPERTY, "propertyNodetype": "@value", "severity": "minor", "maxInclusive": "5"})])
    view = AlertView(spark, str(tmp_path / "v"), lambda: c, spark.createDataFrame([(1, "PUBLISH", 1)], m.COMBINATIONS), c, spark.createDataFrame([], m.RDF), n_buckets=2)
    ts = datetime(2024, 1, 1)
    spark.createDataFrame([("t", "T", False, ts)], m.ENTITIES).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([attribute("t", "p", "9", ts)], m.ATTRIBUTES).write.parquet(str(tmp_path / "a"))
    sent = view.apply(spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "a")), 0, stored=True)
    assert [(r.resource, r.severity) for r in sent.collect()] == [("t", "minor")] and sent.columns == view.alerts().columns
    # What was touched and is looked at: without the columns that no check has, and no violations.
    assert not [columns for columns in written if {"synced", "event"} & {*columns}]
