"""Results that are kept up to date: a batch of changes is applied, and only what it touches is read and written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.operators import aggregates, checks
from plantstate.operators.graph import cut
from plantstate.sources import buckets
from plantstate.sources.buckets import read_keys, upsert, version


#: A part of points or segments that is dealt out stands for so many bytes of files, and a point for so many of them. Smaller parts
#: cost more: each takes pages of memory of its own for hashing and sorting.
PART_BYTES, POINT_BYTES = 4 << 20, 10


class AlertView:
    """Alerts of all checks, kept up to date from batches of changed entities and attributes.

    A change touches the entity it belongs to, and the entities whose relationships point to it,
    as their class checks look at the target. Their violations are made anew from their own rows
    and compared with their published alerts: what differs is sent, and kept. Tables in hash
    buckets hold entities (by id), attributes (by entity), links (by target) and alerts (by
    resource), so a batch reads and writes the buckets of touched keys only.

    shapes() gives the constraints, subclasses included, and is asked at every batch: where they
    have changed since the last one, the entities of the types they are about are touched, too.
    combinations, constraints and rdf are fixed. Batches have growing numbers; one that is applied
    again changes nothing. All that a batch did becomes visible with the alerts table's version."""

    def __init__(self, spark: SparkSession, path: str, shapes: Callable[[], DataFrame], combinations: DataFrame, constraints: DataFrame, rdf: DataFrame, n_buckets: int = buckets.BUCKETS):
        self.spark, self.path, self.n_buckets = spark, path.rstrip("/"), n_buckets
        self.shapes, self.combinations, self.constraints, self.rdf = shapes, combinations, constraints, rdf

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _there(self, table: str) -> bool:
        return version(self.spark, self._at(table)) is not None

    def _reshaped(self, now: DataFrame, batch: int) -> DataFrame | None:
        """typ: the types whose constraints differ from those of the batch before; None if there was none."""
        before = sorted(int(n) for n in buckets.names(self.spark, self._at("shapes")) if n.isdigit() and int(n) < batch)
        now.write.mode("overwrite").parquet(f"{self._at('shapes')}/{batch}")
        if not before:
            return None
        old = self.spark.read.schema(now.schema).parquet(f"{self._at('shapes')}/{before[-1]}")
        return now.exceptAll(old).unionByName(old.exceptAll(now)).select(F.col("targetClass").alias("typ")).distinct()

    def _touched(self, entities: DataFrame, attributes: DataFrame, types: DataFrame | None) -> DataFrame:
        changed = entities.select("id")
        found = changed.union(attributes.select("entityId"))
        if self._there("links"):
            found = found.union(read_keys(changed, self._at("links")).select("entityId"))
        if types is not None and self._there("entities"):
            known = buckets.read(self.spark, self._at("entities"))
            found = found.union(known.join(types, known["type"] == types["typ"], "left_semi").select("id"))
        return cut(found.where("id is not null").distinct())

    def _violations(self, touched: DataFrame, shapes: DataFrame) -> DataFrame:
        """The alerts of touched entities. Both kinds of checks are made of one reading of them, and constraints of which nothing is published are left out."""
        e = cut(read_keys(touched, self._at("entities"), ["id", "type", "deleted"]))
        a = cut(read_keys(touched, self._at("attributes"), ["id", "parentId", "entityId", "name", *checks.FIELDS]))
        targets = read_keys(a.where((F.col("type") == m.RELATIONSHIP) & F.col("attributeValue").isNotNull()).select("attributeValue"), self._at("entities"), ["id", "type", "deleted"])
        fired = checks.all_checks(e, a, checks.named_by(shapes, self.combinations), self.rdf, targets)
        return checks.alerts(fired, self.combinations, self.constraints)

    def apply(self, entities: DataFrame, attributes: DataFrame, batch: int, stored: bool = False) -> DataFrame:
        """Apply changed rows (of model.ENTITIES and model.ATTRIBUTES) and return the alerts to send: new and changed ones,
        and severity ok for those that are over. Empty batches send nothing. stored: the rows are little more than read from
        files, and are not written before they are looked at several times."""
        sent = f"{self._at('sent')}/{batch}"
        done = version(self.spark, self._at("alerts"))
        if done is not None and batch <= done.batch:
            return self._sent(sent)
        if not stored:
            entities, attributes = cut(entities), cut(attributes)
        shapes = cut(self.shapes())
        touched = self._touched(entities, attributes, self._reshaped(shapes, batch))
        links = attributes.where((F.col("type") == m.RELATIONSHIP) & F.col("attributeValue").isNotNull()).select(F.col("attributeValue").alias("target"), "id", "entityId", "ts")
        upsert(entities, self._at("entities"), ["id"], "ts", buckets=self.n_buckets, batch=batch)
        upsert(attributes, self._at("attributes"), ["id"], "ts", by=["entityId"], buckets=self.n_buckets, batch=batch)
        upsert(links, self._at("links"), ["target", "id"], "ts", by=["target"], buckets=self.n_buckets, batch=batch)

        now = self._violations(touched, shapes).withColumns({"deleted": F.lit(False), "batch": F.lit(batch).cast("long")})
        if done is None:
            old = self.spark.createDataFrame([], now.schema)
        else:
            old = read_keys(touched, self._at("alerts")).where("not deleted")
        o = old.select("resource", "event", F.struct("environment", "service", "severity", "customer", "text").alias("was"))
        n = now.select("resource", "event", F.struct("environment", "service", "severity", "customer", "text").alias("is"))
        differs = n.join(o, ["resource", "event"], "full_outer").where(~F.col("is").eqNullSafe(F.col("was")))
        over = F.col("is").isNull()
        rows = differs.select("resource", "event", *[F.coalesce(f"is.{c}", f"was.{c}").alias(c) for c in ("environment", "service")], F.when(over, "ok").otherwise(F.col("is.severity")).alias("severity"), F.coalesce("is.customer", "was.customer").alias("customer"), F.when(over, "Ok").otherwise(F.col("is.text")).alias("text"), over.alias("deleted"), F.lit(batch).cast("long").alias("batch"))
        # Written once: what is sent is what the table takes in.
        rows.write.mode("overwrite").parquet(sent)
        rows = self.spark.read.schema(rows.schema).parquet(sent)
        upsert(rows, self._at("alerts"), ["resource", "event"], "batch", by=["resource"], buckets=self.n_buckets, batch=batch, unique=True)
        return self._sent(sent)

    def _sent(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path).drop("deleted", "batch")

    def alerts(self) -> DataFrame:
        """The alerts in force, as publish_alerts() gives them."""
        return buckets.read(self.spark, self._at("alerts")).where("not deleted").drop("deleted", "batch")


class StateTimeView:
    """state_time() of each key, kept up to date from batches of points in any order, some of which take back earlier ones.

    A key's time is cut into segments of width_ms. Points are kept by key and segment, and for
    each segment its first and last point and the time held inside. A batch reads the points of
    the segments it touches; totals are made from the segments' few numbers. A point that was
    added twice has to be taken back twice, and may be taken back before it comes."""

    def __init__(self, spark: SparkSession, path: str, width_ms: int = 86_400_000, n_buckets: int = buckets.BUCKETS):
        self.spark, self.path, self.width_ms, self.n_buckets = spark, path.rstrip("/"), width_ms, n_buckets

    def _put(self, rows: DataFrame, table: str, keys: list[str], by: list[str], batch: int) -> None:
        upsert(rows.withColumn("batch", F.lit(batch).cast("long")), f"{self.path}/{table}", keys, "batch", by=by, buckets=self.n_buckets, batch=batch, unique=True)

    def _buckets(self, table: str) -> int:
        found = version(self.spark, f"{self.path}/{table}")
        return found.buckets if found else self.n_buckets

    def _parts(self, size: int) -> int:
        return max(self.spark.sparkContext.defaultParallelism, size // PART_BYTES)

    def _changes(self, good: DataFrame, numbers: list[int], n_rows: int, batch: int) -> DataFrame:
        """The points that the batch (of n_rows) changes (changed), with their new counts; and of each segment that it touches one
        row, that of its first point (of_segment), with the numbers that state_segments() gives (1: first, 2: last). Rows are dealt out by
        segment once, into parts by size, and sorted once; what is not changed is not written."""
        known = version(self.spark, f"{self.path}/points")
        point = ["key", "seg", "ms", "state"]
        added = F.lit(0) if known is not None and batch <= known.batch else F.when(F.col("removed"), -1).otherwise(1)
        # The batch's own rows have no number of a batch.
        rows = good.select(*point, added.cast("long").alias("n"), F.lit(None).cast("long").alias("batch"))
        size = n_rows * POINT_BYTES
        if known is not None:
            old = buckets.deltas(self.spark, f"{self.path}/points", numbers)
            rows, size = rows.unionByName(old.select(*point, "n", "batch")), size + buckets.stored_bytes(old)
        own = F.col("batch").isNull()
        n = F.coalesce(F.max_by("n", "batch"), F.lit(0)) + F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0))
        counts = rows.repartition(self._parts(size), "key", "seg").groupBy(*point).agg(n.alias("n"), F.max(own).alias("changed"))

        w = Window.partitionBy("key", "seg").orderBy("ms", "state")
        start, end = Window.unboundedPreceding, Window.unboundedFollowing
        newest = lambda c, *frame: F.last(c, ignorenulls=True).over(w.rowsBetween(*frame))
        d = counts.withColumns({c: F.when(F.col("n") > 0, F.col(of)) for c, of in (("_ms", "ms"), ("_state", "state"))})
        d = d.withColumns({"_ms0": newest("_ms", start, -1), "_state0": newest("_state", start, -1), "_first": F.min("_ms").over(w.rowsBetween(start, 0)), "_row": F.row_number().over(w)})
        # Of points of one time the last one, by state, counts.
        held = F.when((F.col("_state0") == 1) & (F.col("_ms0") < F.col("_ms")), F.col("_ms") - F.col("_ms0"))
        whole = {
            "inner_ms": F.sum(held).over(w.rowsBetween(start, end)), "of_segment": (F.col("_row") == 1) & F.max("changed").over(w.rowsBetween(start, end)),
            "_ms1": newest(F.when(F.col("_ms") == F.col("_first"), F.col("_ms")), start, end), "_state1": newest(F.when(F.col("_ms") == F.col("_first"), F.col("_state")), start, end),
            "_ms2": newest("_ms", start, end), "_state2": newest("_state", start, end),
        }
        ends = [F.when(F.col("of_segment"), F.col(c)).alias(c) for c in ("inner_ms", "_ms1", "_state1", "_ms2", "_state2")]
        return d.withColumns(whole).where("changed or of_segment").select(*point, "n", "changed", "of_segment", *ends)

    def _totals(self, keys: DataFrame, numbers: list[int]) -> DataFrame:
        """key, state_ms, deleted: of some keys, from their segments, which are dealt out by key once, into parts by size."""
        rows = buckets.deltas(self.spark, f"{self.path}/segments", numbers)
        return aggregates.state_of_segments(rows.repartition(self._parts(buckets.stored_bytes(rows)), "key"), ["key"], "seg", empty="deleted", newest="batch").join(keys, "key", "left_semi")

    def apply(self, points: DataFrame, batch: int) -> DataFrame:
        """Apply points (key, ms, state, removed) and return key, state_ms, deleted for the keys they touch. Rows with a null key, state or time are left out."""
        good = points.where("key is not null and state is not null and ms is not null").withColumn("seg", F.floor(F.col("ms") / self.width_ms).cast("long"))
        # At most as many pairs as there are pairs of buckets.
        touched = good.groupBy(buckets.bucket(["key", "seg"], self._buckets("points")), buckets.bucket(["key"], self._buckets("segments"))).count().collect()
        of_points, of_keys = sorted({r[0] for r in touched}), sorted({r[1] for r in touched})
        if not touched:
            return self.spark.createDataFrame([], points.select("key", F.lit(0).cast("long").alias("state_ms"), F.lit(False).alias("deleted")).schema)
        now = cut(self._changes(good, of_points, sum(r[2] for r in touched), batch))
        self._put(now.where("changed").select("key", "seg", "ms", "state", "n"), "points", ["key", "seg", "ms", "state"], ["key", "seg"], batch)
        # A segment that has lost all its points stays as an empty one.
        segments = now.where("of_segment")
        ends = [F.when(F.col(f"_ms{i}").isNotNull(), F.struct(F.col(f"_ms{i}").alias("ms"), F.col(f"_state{i}").alias("state"))).alias(end) for i, end in ((1, "first"), (2, "last"))]
        self._put(segments.select("key", "seg", *ends, "inner_ms"), "segments", ["key", "seg"], ["key"], batch)
        totals = cut(self._totals(segments.select("key"), of_keys))
        self._put(totals, "totals", ["key"], ["key"], batch)
        return totals

    def totals(self) -> DataFrame:
        """key, state_ms: of all keys that have points."""
        return buckets.read(self.spark, f"{self.path}/totals").where("not deleted").select("key", "state_ms")
