"""Aggregations over bindings and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantstate.operators.segments import before


def group_by_this(df: DataFrame, keys: Sequence[str] = ()):
    """Groups by the keys and always by this."""
    return df.groupBy(*dict.fromkeys(["this", *keys]))


def agg_count(df: DataFrame, keys: Sequence[str], col: str, name: str = "n", distinct: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg((F.count_distinct(col) if distinct else F.count(col)).alias(name))


def agg_sum(df: DataFrame, keys: Sequence[str], col: str, name: str = "total", distinct: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum_distinct(F.col(col)) if distinct else F.sum(col)).alias(name))


def string_agg(df: DataFrame, keys: Sequence[str], col: str, order: str, sep: str = ",", name: str = "texts") -> DataFrame:
    """Values joined in an order; equal order values are ordered by the text."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), sep).alias(name))


def state_time(df: DataFrame, keys: Sequence[str], state: str, ts_ms: str, name: str = "state_ms") -> DataFrame:
    """Milliseconds in state 1: each point holds until the next one. Null if the state was never held.

    Of points of one time the last by state counts; null states and times are left out. A key's
    points are spread over tasks by time, and sums are combined before the last shuffle."""
    points = df.where(F.col(state).isNotNull() & F.col(ts_ms).isNotNull()).groupBy(*keys, ts_ms).agg(F.max(state).alias("_state"))
    held = before(points, keys, [ts_ms], {"_s": "_state", "_t": ts_ms})
    return held.groupBy(*keys).agg(F.sum(F.when(F.col("_s") == 1, F.col(ts_ms) - F.col("_t"))).alias(name))


def state_segments(points: DataFrame, keys: Sequence[str], segment: str, state: str, ts_ms: str) -> DataFrame:
    """What state_time() has to know of each segment of a key's time: its first and last point, and the time held inside.

    points has one row per key and time; a segment is a range of times. Rows with a null state
    are no points: a segment that has no others has nulls."""
    there = F.col(state).isNotNull()
    within = Window.partitionBy(*keys, segment, there).orderBy(ts_ms)
    inner = F.when(F.col(state) == 1, F.lead(ts_ms).over(within) - F.col(ts_ms))
    point = F.when(there, F.struct(F.col(ts_ms).alias("ms"), F.col(state).alias("state")))
    return points.withColumn("_in", inner).groupBy(*keys, segment).agg(F.min(point).alias("first"), F.max(point).alias("last"), F.sum("_in").alias("inner_ms"))


def state_of_segments(segments: DataFrame, keys: Sequence[str], segment: str, name: str = "state_ms", empty: str | None = None, newest: str | None = None) -> DataFrame:
    """state_time() from state_segments(): the time inside, and between a segment and the next that has points.

    empty: a column that says that a key has no points. newest: of rows of one segment the one with the largest value of this counts."""
    w = Window.partitionBy(*keys).orderBy(F.desc(segment), *([F.desc(newest)] if newest else []))
    old = F.lag(segment).over(w).eqNullSafe(F.col(segment)) if newest else F.lit(False)
    rows = segments.select(*keys, segment, *([newest] if newest else []), F.col("first.ms").alias("_first"), F.col("last.ms").alias("_last"), F.col("last.state").alias("_state"), "inner_ms").withColumn("_old", old)
    # From the last segment to the first one: the next is the nearest above.
    after = F.last(F.when(~F.col("_old"), F.col("_first")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    across = F.when(F.col("_state") == 1, after - F.col("_last"))
    both = F.when(across.isNull() & F.col("inner_ms").isNull(), F.lit(None)).otherwise(F.coalesce(across, F.lit(0)) + F.coalesce("inner_ms", F.lit(0)))
    more = [F.min(F.col("_first").isNull()).alias(empty)] if empty else []
    return rows.withColumn("_ms", both).where(~F.col("_old")).groupBy(*keys).agg(F.sum("_ms").alias(name), *more)


def last_value_agg(df: DataFrame, keys: Sequence[str], window: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The last row of each key in each tumbling window."""
    order = [c for c in (ts, tie) if c]
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "_top.*")


def oee_counts(links: DataFrame, log: DataFrame, machine: str, output: str, good: Column, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Distinct outputs of each machine inside a time span, and those that are good."""
    inside = log.where((F.col(ts) >= start) & (F.col(ts) < end))
    rows = links.join(inside, output)
    return rows.groupBy(machine).agg(F.count_distinct(output).alias("total"), F.count_distinct(F.when(good, F.col(output))).alias("good"))


def trust_level(results: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per (binding, datasetId): the least of attribute, input and row trust; duplicate or missing parts give 0.

    bindings: binding, parts (number of inputs), trust; results: binding, datasetId, part, trust."""
    got = results.groupBy("binding", "datasetId").agg(F.min("trust").alias("least"), F.count("*").alias("n"), F.count_distinct("part").alias("different"))
    rows = got.join(bindings.withColumnRenamed("trust", "own"), "binding")
    whole = (F.col("n") == F.col("parts")) & (F.col("different") == F.col("parts"))
    return rows.select("binding", "datasetId", F.when(whole, F.least("least", "own")).otherwise(F.lit(0.0)).alias("trust"))


def firmware_pick(bindings: DataFrame, version: str, key: str = "binding", firmware: str = "firmware") -> DataFrame:
    """The binding rows of the requested version if there are any, else those of the first version by name."""
    choice = bindings.groupBy(key).agg(F.max(F.col(firmware) == version).alias("has"), F.min(firmware).alias("first"))
    pick = choice.select(key, F.when(F.col("has"), F.lit(version)).otherwise(F.col("first")).alias(firmware))
    return bindings.join(pick, [key, firmware], "left_semi")
