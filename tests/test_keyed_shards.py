"""Keyed state in shards: a call of Python and a state row per shard, not per key; results as those of plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantstate.sources import buckets
from plantstate.streaming import flows

KEYS = [f"k{i}" for i in range(60)] + [None]
SHARDS = 4


@pytest.fixture
def points(spark, tmp_path):
    """(key, n, ts) in three batches, as a stream and as rows in order."""
    rng, start, rows = random.Random(3), datetime(2024, 1, 1), []
    for batch in range(3):
        part = [(rng.choice(KEYS), rng.choice([0, 1, 255, rng.randint(0, 255)]), start + timedelta(minutes=1000 * batch + i)) for i in range(400)]
        spark.createDataFrame(part, "k string, n int, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows += part
    return spark.readStream.schema("k string, n int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), rows


def ran(stream, tmp_path, mode="append"):
    out = []
    put = lambda batch, number: out.extend((number, *r) for r in batch.collect())
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= SHARDS
    return out


def test_alert_changes_in_shards(spark, points, tmp_path):
    stream, rows = points
    got = ran(flows.alert_changes_stream(stream.withColumn("n", F.col("n") % 2), "k", "n", ["ts"], shards=SHARDS), tmp_path)
    last, want = {}, []
    for k, n, ts in rows:
        want += [(k, n % 2, ts)] if k not in last or last[k] != n % 2 else []
        last[k] = n % 2
    assert sorted(map(repr, (r[1:] for r in got))) == sorted(map(repr, want))


def test_expiring_alert_changes_in_shards(spark, points, tmp_path):
    stream, rows = points
    got = ran(flows.alert_changes_stream(stream.withColumn("n", F.col("n") % 2), "k", "n", ["ts"], ttl="2 hours", shards=SHARDS), tmp_path)
    last, want = {}, []
    for k, n, ts in rows:
        want += [(k, n % 2, ts)] if k not in last or last[k][0] != n % 2 or ts - last[k][1] > timedelta(hours=2) else []
        last[k] = n % 2, ts
    assert sorted(map(repr, (r[1:] for r in got))) == sorted(map(repr, want))


def test_sequence_numbers_in_shards(spark, points, tmp_path):
    stream, rows = points
    got = ran(flows.seq_check_stream(stream.withColumn("b", F.col("n") % 7 == 0), "k", "n", "b", ["ts"], shards=SHARDS), tmp_path)
    last, want = {}, []
    for k, n, ts in rows:
        before = last.get(k)
        want.append((k, n, ts, n % 7 == 0, n == 0 if n % 7 == 0 else before is not None and (n > before or (before == 255 and n == 0))))
        last[k] = n
    assert sorted(map(repr, (r[1:] for r in got))) == sorted(map(repr, want))


def test_ends_of_state_time_in_shards(spark, tmp_path):
    rng, batches = random.Random(4), []
    for _ in range(4):
        batches.append([(rng.choice(KEYS[:30]), rng.randint(0, 1000), rng.choice([0, 1, None])) for _ in range(80)])
        spark.createDataFrame(batches[-1], "k string, ms bigint, s int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ms bigint, s int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r[0], r[1]): r[2] for r in ran(flows.state_time_ends(stream, "k", "s", "ms", shards=SHARDS), tmp_path, "update")}
    known, want = {}, {}
    for number, batch in enumerate(batches):
        for k in {r[0] for r in batch}:
            total, first, last = known.get(k, (None, None, None))
            at = {}
            for _, ms, s in (r for r in batch if r[0] == k and r[2] is not None):
                at[ms] = max(s, at.get(ms, s))
            for ms in sorted(at):
                if last is None:
                    first = last = (at[ms], ms)
                elif ms > last[1]:
                    total = (total or 0) + ms - last[1] if last[0] == 1 else total
                    last = (at[ms], ms)
            for ms in sorted(at, reverse=True):
                if ms < first[1]:
                    total = (total or 0) + first[1] - ms if at[ms] == 1 else total
                    first = (at[ms], ms)
            known[k] = total, first, last
            want[number, k] = total
    assert got == want


def test_replayed_batches_have_more_files_where_the_input_is_larger(spark, tmp_path, monkeypatch):
    spark.range(5000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(flows, "FILE_BYTES", buckets.stored_bytes(table) // 12)
    stream, seen = flows.replayed(table, F.col("id")).withColumn("f", F.col("_metadata.file_path")), []
    flows.run_batches(stream, "seen", lambda b, n: seen.append(b.agg(F.min("id"), F.max("id"), F.count("*"), F.count_distinct("f")).first()))
    assert [r[3] for r in seen] == [3] * 4
    assert sum(r[2] for r in seen) == 5000 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_state_has_partitions_by_the_size_of_its_rows(spark, points, tmp_path, monkeypatch):
    from plantstate.plans import flow_queries as q

    stream, rows = points
    spark.createDataFrame(rows, "user_id string, value int, ts timestamp").withColumns({"event_id": F.monotonically_increasing_id(), "event_type": F.lit("view")}).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    table = spark.read.parquet(str(tmp_path / "events.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert flows.state_tasks(table) == cores
    monkeypatch.setattr(flows, "folder", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert q.state_ttl(spark, str(tmp_path)).count() >= len(KEYS)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len([n for n in buckets.names(spark, str(tmp_path / "ttl/state/state/0")) if n.isdigit()]) == cores
    monkeypatch.setattr(flows, "FILE_BYTES", buckets.stored_bytes(table) // (4 * 3 * cores))
    assert flows.state_tasks(table) >= 3 * cores
