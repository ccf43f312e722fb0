"""Current state from change rows, and plain relational steps of patterns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantstate.functions.terms import json_array_test, json_object_test
from plantstate.operators.segments import before


def latest_by_key(df: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The newest row of each key; of equal times the one of the largest tie column.

    A maximum of a struct is combined before the shuffle, so a key with many changes is no
    bottleneck; nothing is sorted."""
    order = [c for c in (ts, tie) if c]
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_top.{c}").alias(c) for c in df.columns])


def rank_latest(df: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """df with row_num: 1 for the newest row of each key."""
    order = [F.col(c).desc() for c in (ts, tie) if c]
    return df.withColumn("row_num", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rank_latest_in_window(df: DataFrame, keys: Sequence[str], window: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    return rank_latest(df.withColumn("window_start", F.window(ts, window)["start"]), [*keys, "window_start"], ts, tie)


def live_filter(df: DataFrame, deleted: str = "deleted") -> DataFrame:
    """Without logically deleted rows; null counts as live."""
    return df.where(~F.coalesce(F.col(deleted), F.lit(False)))


def project_vars(bindings: DataFrame, names: Sequence[str]) -> DataFrame:
    """The variables asked for; those that aren't bound are null."""
    return bindings.select(*[F.col(n) if n in bindings.columns else F.lit(None).cast("string").alias(n) for n in names])


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def filter_expr(df: DataFrame, cond: Column) -> DataFrame:
    return df.where(cond)


def compare(a: Column, op: str, b) -> Column:
    """=, !=, <, >, <=, >=, in and not in."""
    if op in ("in", "not in"):
        found = a.isin(*b)
        return found if op == "in" else ~found
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def history_query(df: DataFrame, equal: dict[str, str] | None = None, like: dict[str, str] | None = None, order: Sequence[str] = (), limit: int | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """History lookup: conditions, order (-name descends), limit, columns."""
    for name, value in (equal or {}).items():
        df = df.where(F.col(name) == value)
    for name, value in (like or {}).items():
        df = df.where(F.col(name).like(value))
    if order:
        df = df.orderBy(*[F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order])
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns) if columns else df


def datapoint_validate(df: DataFrame) -> DataFrame:
    """Submissions (n name, v value, t kind, ts) with type, ok and reason.

    A name must be an IRI, JSON and list values must parse; the kind is Property and the time
    now where they are missing."""
    kind = F.coalesce("t", F.lit("Property"))
    is_iri = F.coalesce(F.col("n").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:\S+$"), F.lit(False))
    reason = F.when(~is_iri, "name").when((kind == "JsonProperty") & ~F.coalesce(json_object_test(F.col("v")), F.lit(False)), "json").when((kind == "ListProperty") & ~F.coalesce(json_array_test(F.col("v")), F.lit(False)), "list")
    return df.withColumns({"type": kind, "ts": F.coalesce("ts", F.current_timestamp()), "reason": reason, "ok": reason.isNull(), "metric": F.concat_ws("/", kind, "n")})


def unsent_latest(df: DataFrame, key: str = "n", ts: str = "ts", sent: str = "sent") -> DataFrame:
    """The newest row of each metric, if it is still unsent."""
    return latest_by_key(df, [key], ts).where(F.col(sent) == 0)


def retention_trim(df: DataFrame, now: Column, seconds: int, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def value_change_rows(df: DataFrame, key: str, value: str, ts: str, tie: str) -> DataFrame:
    """Rows whose value differs from the one before (null-safe); the first row of a key counts."""
    d = before(df, [key], [ts, tie], {"_v": value})
    return d.where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_v"))).drop("_first", "_v")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def order_limit(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
