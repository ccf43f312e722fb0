"""Ordered scans of keys that may hold most of the rows: local results with border values, stitched over the borders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantstate.operators.graph import cut


def before(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], first: str = "_first", segments: int | None = None) -> DataFrame:
    """df with columns of the row before of the same key, in an order ({new name: column}), and first: whether there is none.

    Rows are dealt into ranges of (keys, order), so a key with many rows is spread over many
    tasks. Inside a range a window looks at the row before; the first row of a key in a range
    takes the last one of the key's range before: those are one row per key and range. The order
    should tell all rows of a key apart. segments: the number of ranges, else as many as shuffles have."""
    spark = df.sparkSession
    n = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, as the range that a row lies in must be the same whenever it is read.
    dealt = cut(df.repartitionByRange(n, *keys, *order).withColumn("_seg", F.spark_partition_id()))
    within = Window.partitionBy("_seg", *keys).orderBy(*order)
    last = F.struct(*[F.col(c).alias(name) for name, c in columns.items()])
    ends = dealt.groupBy("_seg", *keys).agg(F.max_by(last, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_border", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_seg"))).where("_border is not null").select("_seg", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_border")
    local = dealt.withColumn("_lag", F.lag(last).over(within))
    same = [local[k].eqNullSafe(ends[f"_k{i}"]) for i, k in enumerate(keys)]
    cond = local["_seg"] == ends["_seg"]
    for s in same:
        cond = cond & s
    joined = local.join(ends, cond, "left").select(*[local[c] for c in df.columns], F.coalesce(local["_lag"], ends["_border"]).alias("_before"))
    return joined.select(*df.columns, F.col("_before").isNull().alias(first), *[F.col(f"_before.{name}").alias(name) for name in columns])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | None, name: str, segments: int | None = None) -> DataFrame:
    """df with name: the sum of value (None: the number) of the rows before of the same key, in an order; 0 for the first.

    Rows are dealt into ranges as in before(); a range's rows start from the sums of the key's
    ranges before it, which are one row per key and range. Without keys these are one row per range."""
    spark = df.sparkSession
    n = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *keys, *order).withColumn("_seg", F.spark_partition_id()))
    each = F.lit(1) if value is None else F.col(value)
    sums = dealt.groupBy("_seg", *keys).agg(F.sum(each).alias("_sum"))
    above = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.sum("_sum").over(above)).where("_start is not null").select("_seg", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    within = Window.partitionBy("_seg", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_here", F.sum(each).over(within))
    cond = local["_seg"] == starts["_seg"]
    for i, k in enumerate(keys):
        cond = cond & local[k].eqNullSafe(starts[f"_k{i}"])
    total = F.coalesce(local["_here"], F.lit(0)) + F.coalesce(starts["_start"], F.lit(0))
    return local.join(starts, cond, "left").select(*[local[c] for c in df.columns], total.alias(name))
