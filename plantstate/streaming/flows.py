"""Structured Streaming: the same operators on streams, and keyed state where a plan has none."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plantstate.operators.graph import shared_folder
from plantstate.sources import buckets
from plantstate.streaming.views import StateTimeView


#: A file of a replayed batch stands for so many bytes of the tables it is made of.
FILE_BYTES = 2 << 20


def replayed(table: DataFrame, order: Column, batches: int = 4, files: int | None = None, columns: Sequence[Column | str] = ("*",)) -> DataFrame:
    """A table as a stream of micro-batches: order (a number) is cut into ranges, and each range is a batch of so many files.

    columns: what the stream has of a row; others are not dealt out and written. files: if not named, one for each FILE_BYTES of the table's files, so that no task writes or reads more of a batch."""
    spark = table.sparkSession
    path = folder(spark, "replay")
    d = table.select(*columns, order.cast("long").alias("_o"))
    cuts = d.agg(F.percentile_approx("_o", [i / batches for i in range(1, batches)], 10000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    n = files or max(1, buckets.stored_bytes(table) // (FILE_BYTES * batches))
    if n > 1:
        # All batches must have as many files: every task that deals rows out, or one of them at least, fills all.
        part = sum((F.coalesce(F.col("_o") > c, F.lit(False)).cast("int") for c in edges[1:-1]), F.lit(0))
        sizes = [r["count"] for r in d.groupBy(part.alias("p")).count().collect()]
        n = max(1, min(n, min(sizes) // d.rdd.getNumPartitions())) if len(sizes) == len(edges) - 1 else 1
    for low, high in zip(edges, edges[1:]):
        part = d if low is None else d.where(F.col("_o") > low)
        part = part if high is None else part.where(F.col("_o") <= high)
        # One after the other, as a stream takes files by their time.
        part.drop("_o").repartition(n).write.mode("append").parquet(path)
    return spark.readStream.schema(d.drop("_o").schema).option("maxFilesPerTrigger", n).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str, batches: int = 4, mixed: bool = False, columns: Sequence[Column | str] = ("*",)) -> DataFrame:
    """The events table as a stream of micro-batches, by time or (mixed) in an order that has nothing to do with it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return replayed(e, F.xxhash64("event_id") if mixed else F.unix_micros("ts"), batches, columns=columns)


def watermark_monotone(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time moves with the newest record."""
    return stream.withWatermark(ts, "0 seconds")


def watermark_delay(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    return stream.withWatermark(ts, delay)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def state_tasks(table: DataFrame, batches: int = 4) -> int:
    """The number of partitions of the state of a replayed table: as many as a batch has files, or there are cores.

    Each partition costs every batch a task, a call of Python's worker and files of state, with rows or without."""
    return max(table.sparkSession.sparkContext.defaultParallelism, buckets.stored_bytes(table) // (FILE_BYTES * batches))


@contextmanager
def state_partitions(spark: SparkSession, tasks: int | None) -> Iterator[None]:
    """Within, streams start with state in so many partitions (None: as many as shuffles have). A checkpoint keeps its number."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(tasks or before))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(stream: DataFrame, name: str, mode: str = "append", tasks: int | None = None) -> DataFrame:
    """Run a stream over all that there is now, into Parquet files, and read those. tasks: see state_partitions()."""
    spark = stream.sparkSession
    path = folder(spark, name)
    with state_partitions(spark, tasks):
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Run a stream over all that there is now; each(batch, number) writes what it makes. state: the checkpoint, if not a new one."""
    path = state or f"{folder(stream.sparkSession, name)}/state"
    stream.writeStream.foreachBatch(each).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()


def current_state_stream(stream: DataFrame, keys: list[str], path: str, ts: str, tie: str, state: str | None = None) -> DataFrame:
    """Each batch is merged into the bucketed table at path: it writes the buckets of its keys.

    So a stream that starts again from its checkpoint (state) goes on from the table, and a
    batch that is run again changes nothing: the newest row of a key stays."""
    spark = stream.sparkSession
    run_batches(stream, "merge", lambda batch, number: buckets.upsert(batch, path, keys, ts, tie), state)
    return buckets.read(spark, path) if buckets.version(spark, path) else spark.createDataFrame([], stream.schema)


#: Keys of a keyed state lie in so many shards.
SHARDS = 1024


def shards_of(tasks: int | None) -> int:
    """So many shards for a state of so many partitions: a call of Python costs more than hundreds of rows do."""
    return SHARDS if tasks is None else min(SHARDS, 32 * tasks)


def _sharded(stream: DataFrame, key: str, shards: int) -> DataFrame:
    """With the key as text and the shard it lies in. By the text, as that is what tells the keys of a shard apart."""
    d = stream.withColumn("_key", F.col(key).cast("string"))
    return d.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards)))


def alert_changes_stream(stream: DataFrame, key: str, values: str | Sequence[str], order: list[str], ttl: str | None = None, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """Rows of which one of some values (for alerts: severity and text) differs from the last row's, per key; the first row passes.

    State: the values, and the time of the key's last row. ttl: state that is older in event time
    (the first order column) has expired: the next row of its key passes, and a timer removes the
    state when the watermark (delay behind the newest row) has passed that time, even if the key
    never comes again. Keys are dealt into shards by their hash, and a shard's state holds those of
    its keys, so that a call of Python is one per shard and batch, not one per key; a checkpoint
    keeps its number of shards. A task holds the rows that one batch has of a shard: bound batches
    by maxFilesPerTrigger or maxOffsetsPerTrigger."""
    names = [values] if isinstance(values, str) else list(values)
    columns = [f.name for f in stream.schema.fields]
    age = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)
    timed = stream if age is None else stream.withWatermark(order[0], delay)
    text = F.to_json(F.array(*[F.col(n).cast("string") for n in names]))
    timed = _sharded(timed, key, shards).withColumns({"_ms": F.lit(0).cast("long") if age is None else F.unix_millis(order[0]), "_now": text})

    def changed(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, last, at = state.get if state.exists else ([], [], [])
        old = pd.DataFrame({"_key": pd.Series(keys, dtype=object), "_now": pd.Series(last, dtype=object), "_ms": pd.Series(at, dtype="int64")})
        if state.hasTimedOut:
            new = old[old["_ms"] + age > state.getCurrentWatermarkMs()]
        else:
            rows = pd.concat(list(batches)).sort_values(order, kind="stable")
            both = pd.concat([old, rows[["_key", "_now", "_ms"]]], ignore_index=True)
            ids, _ = pd.factorize(both["_key"], use_na_sentinel=False)
            of_key = both.groupby(ids, sort=False)
            before, since = of_key["_now"].shift(), of_key["_ms"].cummax().groupby(ids).shift()
            differs = (before != both["_now"]) | (False if age is None else both["_ms"] - since > age)
            both["_ms"] = of_key["_ms"].cummax()
            new = both[~pd.Series(ids).duplicated(keep="last").to_numpy()]
            yield rows.loc[differs.to_numpy()[len(old):], columns]
        if len(new) == 0:
            state.remove()
            return
        state.update((new["_key"].tolist(), new["_now"].tolist(), new["_ms"].tolist()))
        if age is not None:
            # A timer must lie behind the watermark.
            state.setTimeoutTimestamp(max(int(new["_ms"].min()) + age, state.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.NoTimeout if age is None else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy("_shard").applyInPandasWithState(changed, stream.schema, "keys array<string>, last array<string>, at array<bigint>", "append", timeout)


@contextmanager
def idle_sources(spark: SparkSession) -> Iterator[None]:
    """Within, the watermark of joined or united streams follows the fastest one: a source without records doesn't hold time back."""
    name = "spark.sql.streaming.multipleWatermarkPolicy"
    before = spark.conf.get(name)
    spark.conf.set(name, "max")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def state_time_stream(stream: DataFrame, path: str, key: str, state_col: str, ts_ms: str, removed: str | None = None, compat: bool = False, state: str | None = None, tasks: int | None = None) -> DataFrame:
    """key, state_ms after all that there is now: milliseconds in state 1, of points in any order.

    removed: a column that says that a row takes back an earlier point. path holds the points and
    the segments they make (see StateTimeView), and the totals. compat: points inside the known
    span are ignored and nothing can be taken back (see state_time_ends); tasks: the partitions of
    its state (see state_partitions). state: the checkpoint."""
    spark = stream.sparkSession
    gone = F.col(removed) if removed else F.lit(False)
    view = StateTimeView(spark, path)
    if compat:
        totals = state_time_ends(stream, key, state_col, ts_ms, shards_of(tasks))
        put = lambda batch, number: buckets.upsert(batch.withColumn("batch", F.lit(number).cast("long")), f"{path}/totals", [key], "batch")
        with state_partitions(spark, tasks):
            totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state or f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        return buckets.read(spark, f"{path}/totals").select(key, "state_ms")
    points = stream.select(F.col(key).alias("key"), F.col(ts_ms).alias("ms"), F.col(state_col).alias("state"), gone.alias("removed"))
    run_batches(points, "points", lambda batch, number: view.apply(batch, number) and None, state or f"{path}/state")
    return view.totals().withColumnRenamed("key", key)


def state_time_ends(stream: DataFrame, key: str, state_col: str, ts_ms: str, shards: int = SHARDS) -> DataFrame:
    """key, state_ms after each batch: milliseconds in state 1, of points that extend the known span at either end.

    State: total, and state and time of the first and the last point, of the keys of a shard (see
    alert_changes_stream). Points inside the span are ignored; of points of one time in a batch the
    largest state counts."""
    fields = ("total", "first_state", "first_ms", "last_state", "last_ms")

    def totals(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, *known = state.get if state.exists else ([], *([] for _ in fields))
        old = pd.DataFrame({f: pd.array(v, "Int64") for f, v in zip(fields, known)})
        rows = pd.concat(list(batches))
        ids, names = pd.factorize(pd.concat([pd.Series(keys, dtype=object), rows["_key"]], ignore_index=True), use_na_sentinel=False)
        old = old.reindex(range(len(names)))
        points = rows.assign(i=ids[len(keys):]).dropna(subset=[state_col, ts_ms]).groupby(["i", ts_ms])[state_col].max().reset_index()
        i, ms, s = (points[c].astype("int64").to_numpy() for c in ("i", ts_ms, state_col))
        end = lambda f: old[f].fillna(0).astype("int64").to_numpy()[i]
        new_key = old["last_ms"].isna().to_numpy()[i]
        held = np.zeros(len(names), "int64")
        added = np.zeros(len(names), bool)
        # Behind the last point: each stretch has the state of the point before it.
        late = new_key | (ms > end("last_ms"))
        li, lms, ls = i[late], ms[late], s[late]
        starts = np.r_[True, li[1:] != li[:-1]] if len(li) else np.zeros(0, bool)
        before_ms, before_s = np.where(starts, end("last_ms")[late], np.r_[0, lms[:-1]] if len(li) else lms), np.where(starts, end("last_state")[late], np.r_[0, ls[:-1]] if len(li) else ls)
        on = (before_s == 1) & ~(starts & new_key[late])
        np.add.at(held, li[on], (lms - before_ms)[on])
        added[li[on]] = True
        ends = np.r_[starts[1:], True] if len(li) else starts
        # Before the first one: each stretch has the state of the point it begins with.
        early = ~new_key & (ms < end("first_ms"))
        ei, ems, es = i[early], ms[early], s[early]
        stop = np.r_[ei[1:] != ei[:-1], True] if len(ei) else np.zeros(0, bool)
        on = es == 1
        np.add.at(held, ei[on], (np.where(stop, end("first_ms")[early], np.r_[ems[1:], 0] if len(ei) else ems) - ems)[on])
        added[ei[on]] = True
        begins = np.r_[True, ei[1:] != ei[:-1]] if len(ei) else stop
        fresh = starts & new_key[late]
        columns = {f: old[f].to_numpy(dtype=object, na_value=None) for f in fields}
        columns["total"] = np.where(added, end_sum(old["total"], held), columns["total"])
        for f, where, what in (("first_ms", li[fresh], lms[fresh]), ("first_state", li[fresh], ls[fresh]), ("first_ms", ei[begins], ems[begins]), ("first_state", ei[begins], es[begins]), ("last_ms", li[ends], lms[ends]), ("last_state", li[ends], ls[ends])):
            columns[f][where] = what
        state.update(([None if pd.isna(n) else n for n in names], *([None if v is None else int(v) for v in columns[f]] for f in fields)))
        here, at = np.unique(ids[len(keys):], return_index=True)
        yield pd.DataFrame({key: rows[key].iloc[at].to_numpy(), "state_ms": pd.array([columns["total"][x] for x in here], "Int64")})

    def end_sum(total: pd.Series, held: np.ndarray) -> np.ndarray:
        return total.fillna(0).astype("int64").to_numpy() + held

    key_type = stream.schema[key].dataType.simpleString()
    schema = ", ".join(f"{f} array<{'int' if f.endswith('state') else 'bigint'}>" for f in fields)
    return _sharded(stream, key, shards).groupBy("_shard").applyInPandasWithState(totals, f"{key} {key_type}, state_ms bigint", f"keys array<string>, {schema}", "update", GroupStateTimeout.NoTimeout)


def seq_check_stream(stream: DataFrame, key: str, seq: str, birth: str, order: list[str], shards: int = SHARDS) -> DataFrame:
    """Rows with valid, as the batch form has it. State: the last number of each key of a shard (see alert_changes_stream)."""
    names = [f.name for f in stream.schema.fields]

    def check(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, last = state.get if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        both = pd.concat([pd.DataFrame({"_key": pd.Series(keys, dtype=object), "_n": pd.Series(last, dtype="int64")}), rows[["_key"]].assign(_n=rows[seq].astype("int64"))], ignore_index=True)
        ids, _ = pd.factorize(both["_key"], use_na_sentinel=False)
        before = both["_n"].groupby(ids).shift().to_numpy()[len(keys):]
        now = both["_n"].to_numpy()[len(keys):]
        follows = (now > before) | ((before == 255) & (now == 0))
        new = both[~pd.Series(ids).duplicated(keep="last").to_numpy()]
        state.update((new["_key"].tolist(), new["_n"].tolist()))
        yield rows.assign(valid=np.where(rows[birth].astype(bool), now == 0, follows))[[*names, "valid"]]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return _sharded(stream, key, shards).groupBy("_shard").applyInPandasWithState(check, f"{ddl}, valid boolean", "keys array<string>, last array<bigint>", "append", GroupStateTimeout.NoTimeout)


def alert_state(previous: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Alert rows to send after a recomputation: new and changed ones, and ok for those that are gone."""
    p = previous.select(*keys, F.col("severity").alias("_s"), F.col("text").alias("_t"))
    j = now.join(p, keys, "full_outer")
    gone = F.col("severity").isNull()
    same = F.col("severity").eqNullSafe(F.col("_s")) & F.col("text").eqNullSafe(F.col("_t"))
    return j.where(~same).select(*keys, F.coalesce("severity", F.lit("ok")).alias("severity"), F.when(gone, "Ok").otherwise(F.col("text")).alias("text"))
