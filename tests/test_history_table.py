"""History points in a versioned table."""

from datetime import date, datetime

import pytest

from plantstate import model as m
from plantstate.sources import buckets, logs


def batch(spark, rows):
    full = [(i, None, "e", "p", "@value", None, m.PROPERTY, v, "@none", None, None, False, True, at, o) for o, (i, at, v) in enumerate(rows)]
    schema = m.ATTRIBUTES.replace("ts timestamp", "ts timestamp, offset long") if isinstance(m.ATTRIBUTES, str) else m.ATTRIBUTES.add("offset", "long")
    return spark.createDataFrame(full, schema)


def points(df):
    return sorted((r.id, r.observedAt.day if r.observedAt else None, r.value) for r in df.collect())


def test_the_later_batch_stays_and_batches_are_applied_once(spark, tmp_path):
    path = str(tmp_path / "log")
    at = lambda day, hour=1: datetime(2024, 1, day, hour)
    batches = [
        [("a", at(1), "old"), ("b", at(1, 2), "x"), ("c", at(2), "y"), ("n", None, "no time")],
        [("a", at(1), "new"), ("d", at(1, 3), "z"), ("n", None, "still none")],
        [],
        [("e", at(3), "w"), ("a", at(1), "newest"), ("a", at(1), "last in its batch")],
    ]
    want = {}
    for number, rows in enumerate(batches):
        assert logs.merge_history(batch(spark, rows), path, batch=number)
        assert not logs.merge_history(batch(spark, [("a", at(1), "again")]), path, batch=number)
        want |= {(i, t): v for i, t, v in rows}
        assert points(logs.read_history(spark, path)) == sorted(((i, t.day if t else None, v) for (i, t), v in want.items()), key=lambda x: x)
    asked = spark.createDataFrame([(date(2024, 1, 3),), (date(2024, 1, 2),)], "d date")
    assert points(logs.read_history(spark, path, asked)) == [("c", 2, "y"), ("e", 3, "w")]


def test_a_batch_that_stops_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    at = datetime(2024, 1, 1, 5)
    logs.merge_history(batch(spark, [("a", at, "1"), ("b", at, "1")]), path)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(buckets, "_commit", stop)
        with pytest.raises(RuntimeError):
            logs.merge_history(batch(spark, [("a", at, "2"), ("b", at, "2")]), path)
    assert points(logs.read_history(spark, path)) == [("a", 1, "1"), ("b", 1, "1")]
    logs.merge_history(batch(spark, [("a", at, "2"), ("b", at, "2")]), path)
    assert points(logs.read_history(spark, path)) == [("a", 1, "2"), ("b", 1, "2")]


def test_entities_too(spark, tmp_path):
    path = str(tmp_path / "log")
    seen = lambda i, hour: (i, "T", datetime(2024, 1, 1, hour), False)
    for rows in ([seen("a", 1)], [seen("b", 1), seen("a", 2)], [seen("a", 2)]):
        logs.merge_history(spark.createDataFrame(rows, "id string, type string, ts timestamp, deleted boolean"), path, entity=True)
    assert sorted((r.id, r.observedAt.hour) for r in logs.read_history(spark, path).collect()) == [("a", 1), ("a", 2), ("b", 1)]
