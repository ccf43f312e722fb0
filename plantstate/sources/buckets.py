"""Upserted tables in hash buckets: a batch writes only the buckets that it touches.

A table is a folder with `data/`, where every write has a folder of Parquet files by bucket,
and `versions/`, where version n is a JSON file that names the folders of each bucket. A write
adds a delta to each bucket it touches; a bucket with more than DELTAS of them is merged into
one. The version file appears by a rename when all data are there, so readers see one whole
version, and a lost executor or driver leaves the last one in force. The KEPT newest versions
can be read; data that none of them names are removed. A table has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantstate.operators.state import latest_by_key

BUCKETS, DELTAS, KEPT = 16, 4, 2
#: A task gets about so many bytes of files, where rows are dealt by size.
TASK_BYTES = 1 << 20


@dataclass
class Version:
    """What version `number` of a table is made of. batch: the last one that has been applied, of those that are numbered."""

    number: int
    keys: list[str]
    by: list[str]
    ts: str
    tie: str | None
    buckets: int
    schema: dict
    batch: int = -1
    parts: dict[str, list[str]] = field(default_factory=dict)


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _system(spark, path), _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def stored_bytes(df: DataFrame) -> int:
    """The size of the files that df reads."""
    spark = df.sparkSession
    return sum(_system(spark, f).getFileStatus(_path(spark, f)).getLen() for f in map(unquote, df.inputFiles()))


def tasks(df: DataFrame) -> int:
    """A number of partitions that follows the size of df's files, so that a task's share does not grow with them."""
    return max(df.sparkSession.sparkContext.defaultParallelism, stored_bytes(df) // TASK_BYTES)


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in names(spark, f"{path}/versions") if n.endswith(".json") and n[:-5].isdigit()]


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version, or that of a number."""
    found = versions(spark, path)
    if not found or (number is not None and number not in found):
        return None
    at = _path(spark, path, "versions", f"{found[-1] if number is None else number:010d}.json")
    stream = _system(spark, path).open(at)
    try:
        return Version(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, new: Version) -> None:
    fs = _system(spark, path)
    final, draft = _path(spark, path, "versions", f"{new.number:010d}.json"), _path(spark, path, "versions", f".{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(asdict(new)), "utf-8"))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise ValueError(f"version {new.number} of {path} was written by another writer")


def _remove_old(spark: SparkSession, path: str) -> None:
    """Versions but the KEPT newest, and data that none of these names."""
    fs = _system(spark, path)
    found = versions(spark, path)
    for n in found[:-KEPT]:
        fs.delete(_path(spark, path, "versions", f"{n:010d}.json"), False)
    named = {p for n in found[-KEPT:] for parts in version(spark, path, n).parts.values() for p in parts}
    for top in names(spark, f"{path}/data"):
        inside = {f"{top}/{n}" for n in names(spark, f"{path}/data/{top}") if n.startswith("_bucket=")}
        if not inside & named:
            fs.delete(_path(spark, path, "data", top), True)
        else:
            for gone in inside - named:
                fs.delete(_path(spark, path, "data", gone), True)


def bucket(columns: Sequence[str], n: int) -> Column:
    """The number of the bucket, of n, that a row lies in by some columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def _write(rows: DataFrame, path: str, v: Version, name: str) -> dict[str, str]:
    """Rows by bucket, as bucket -> folder. A bucket is one file, unless it is so large that it is split."""
    spark = rows.sparkSession
    rows.withColumn("_bucket", bucket(v.by, v.buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{name}")
    return {n.removeprefix("_bucket="): f"{name}/{n}" for n in names(spark, f"{path}/data/{name}") if n.startswith("_bucket=")}


def _deltas(spark: SparkSession, path: str, v: Version, buckets: Sequence[str] | None = None) -> DataFrame:
    parts = [v.parts[b] for b in (v.parts if buckets is None else buckets) if b in v.parts]
    schema = StructType.fromJson(v.schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{p}" for ps in parts for p in ps]) if parts else spark.createDataFrame([], schema)


def _rows(spark: SparkSession, path: str, v: Version, buckets: Sequence[str] | None = None) -> DataFrame:
    rows = _deltas(spark, path, v, buckets)
    several = any(len(v.parts[b]) > 1 for b in (v.parts if buckets is None else buckets) if b in v.parts)
    return latest_by_key(rows, v.keys, v.ts, v.tie) if several else rows


def deltas(spark: SparkSession, path: str, numbers: Sequence[int]) -> DataFrame:
    """The rows of some buckets, older ones of a key, too: for those who group them anyway."""
    return _deltas(spark, path, version(spark, path), [str(n) for n in numbers])


def upsert(df: DataFrame, path: str, keys: Sequence[str], ts: str = "ts", tie: str | None = None, by: Sequence[str] | None = None, buckets: int = BUCKETS, batch: int | None = None, unique: bool = False) -> bool:
    """Merge rows into the table: of a key the newest row stays, whichever batch brings it.

    by: the columns whose hash gives the bucket, functions of the key; the keys themselves if
    not named. batch: a batch of this or a later number that has been applied is not applied
    again (the result says whether it was). keys, by and buckets are fixed by the first write.
    unique: df has one row per key. A null in a key is a value like any."""
    spark = df.sparkSession
    old = version(spark, path)
    if old is not None and batch is not None and batch <= old.batch:
        return False
    if old is None:
        old = Version(0, list(keys), list(by or keys), ts, tie, buckets, json.loads(df.schema.json()))
    new = Version(old.number + 1, old.keys, old.by, old.ts, old.tie, old.buckets, old.schema, old.batch if batch is None else batch, dict(old.parts))
    columns = [f.name for f in StructType.fromJson(old.schema).fields]
    name = f"{new.number:010d}-{uuid.uuid4().hex[:8]}"
    rows = df.select(*columns)
    written = _write(rows if unique else latest_by_key(rows, old.keys, old.ts, old.tie), path, old, name)
    for b, part in written.items():
        new.parts[b] = [*new.parts.get(b, []), part]
    long = [b for b in written if len(new.parts[b]) > DELTAS]
    if long:
        new.parts |= {b: [part] for b, part in _write(_rows(spark, path, new, long), path, old, f"{name}-merged").items()}
    _commit(spark, path, new)
    _remove_old(spark, path)
    return True


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table's rows, one per key, of its newest version."""
    found = version(spark, path, number)
    if found is None:
        raise ValueError(f"there is no table at {path}, or no such version of it")
    return _rows(spark, path, found)


def read_keys(wanted: DataFrame, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows whose bucket columns are in wanted (one column each, in their order), read from the buckets of these only.

    columns: those that are asked for; others are not read, nor dealt out. Older rows of a key go after those that nobody wants, where
    the rows lie. A table that isn't there gives no rows of no known columns: ask version() first."""
    spark = wanted.sparkSession
    found = version(spark, path)
    names = [f"_w{i}" for i in range(len(found.by))]
    asked = wanted.toDF(*names).distinct()
    nulls = F.lit(False)
    for n in names:
        nulls = nulls | F.col(n).isNull()
    # At most as many numbers as there are buckets, twice.
    touched = asked.select(bucket(names, found.buckets), nulls).distinct().collect()
    numbers = sorted({str(r[0]) for r in touched})
    rows = _deltas(spark, path, found, numbers)
    order = [c for c in (found.ts, found.tie) if c]
    rows = rows if columns is None else rows.select(*dict.fromkeys([*columns, *found.by, *found.keys, *order]))
    # Equal without nulls, so that Spark knows that rows lie by these columns.
    same = [rows[b].eqNullSafe(asked[n]) if any(r[1] for r in touched) else rows[b] == asked[n] for b, n in zip(found.by, names)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    rows = rows.join(asked, cond, "left_semi")
    several = any(len(found.parts[b]) > 1 for b in numbers if b in found.parts)
    rows = latest_by_key(rows, [*found.by, *[k for k in found.keys if k not in found.by]], found.ts, found.tie) if several else rows
    return rows if columns is None else rows.select(*columns)
