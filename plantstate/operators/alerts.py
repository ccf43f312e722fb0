"""Alerts: changes only, debounce, tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantstate.operators.segments import before


def alert_changes(alerts: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Alerts whose severity or text differs from the one before, per key; the first one counts."""
    d = before(alerts, keys, [ts, tie], {"_s": "severity", "_t": "text"})
    return d.where(F.col("_first") | ~F.col("severity").eqNullSafe(F.col("_s")) | ~F.col("text").eqNullSafe(F.col("_t"))).drop("_first", "_s", "_t")


def tombstone_to_ok(alerts: DataFrame) -> DataFrame:
    """Keys without a value mean that the alert is over."""
    gone = F.col("severity").isNull()
    return alerts.withColumns({"severity": F.coalesce("severity", F.lit("ok")), "text": F.when(gone, "Ok").otherwise(F.col("text")), "environment": F.coalesce("environment", F.lit("Development"))})


def alert_dispatch_filter(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("resource").isNotNull() & F.col("event").isNotNull())


def session_debounce(alerts: DataFrame, keys: Sequence[str], gap: str, ts: str = "ts", tie: str | None = None, event: str = "event", heartbeat: str = "heartbeat") -> DataFrame:
    """The last alert of each session of a key (records closer than the gap). Works on streams, too.

    Records whose event is the heartbeat only move time on; they are dropped before the sessions
    are made. Tombstones (null severity) and rows with a null event are alerts like any."""
    order = [c for c in (ts, tie) if c]
    rest = [c for c in alerts.columns if c not in keys and c not in order]
    live = alerts.where(~F.col(event).eqNullSafe(F.lit(heartbeat)))
    top = live.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.max(F.struct(*order, *rest)).alias("l"))
    return top.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "l.*")
