"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word pattern [^\x20\x09-\x0D]+.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine (tests) one of our own where it is unset."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dir


def row_id(*columns: Column) -> Column:
    """128 bits of a row's values, as text: rows are told apart by them. A null counts, and where it stands."""
    parts = [p for c in columns for p in (c, c.isNull())]
    return F.concat(F.hex(F.xxhash64(*parts)), F.lit("."), F.hex(F.xxhash64(F.lit(7), *parts)))


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select columns by their exact names and rename them: pick(df, key="doc_id").

    Other columns go, so their names can't clash with an operator's own, not even
    by case or by dots."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"c{df.columns.index(name)}"].alias(to) for to, name in names.items()])


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns renamed c0, c1, ... so that added columns can't clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def at(df: DataFrame, name: str) -> str:
    """The name that numbered() gives to a column."""
    return f"c{df.columns.index(name)}"


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and white space give an empty one."""
    trimmed = F.btrim(blank_if_null(text), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being evaluated once: a one-element array binds it to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Matches of a text that are handled at once, so that work doesn't grow with the square of their number.
CHUNK = 64
PLACES = "array<struct<start:int,end:int,value:string>>"


def chunks(n: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) for each chunk c of an array of n elements, as an array."""
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), body)


def placed(text: Column, pattern: str | Column) -> Column:
    """All leftmost non-overlapping matches of a text as an array of (start, end, value), in code points.

    The lengths of the parts between matches and of the matches add up to the places. The
    text is split only where there is a match. The pattern must not match an empty text."""
    by = F.lit(pattern) if isinstance(pattern, str) else pattern

    def sums(pairs: Column) -> Column:
        def one(c: Column) -> Column:
            before = F.aggregate(F.slice(pairs, F.lit(1), c * CHUNK), F.lit(0), lambda n, x: n + x["gap"] + F.length(x["value"]))
            start = F.struct(before.alias("pos"), F.array().cast(PLACES).alias("out"))

            def step(acc: Column, x: Column) -> Column:
                start, end = acc["pos"] + x["gap"], acc["pos"] + x["gap"] + F.length(x["value"])
                return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

            return F.aggregate(F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)), start, step, lambda acc: acc["out"])

        return F.flatten(chunks(F.size(pairs), one))

    def some(found: Column) -> Column:
        gaps = F.transform(F.split(text, by, -1), lambda x: F.length(x))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda a, b: F.struct(a.alias("gap"), b.alias("value")))
        return F.when(F.size(found) > 0, let(pairs, sums)).otherwise(F.array().cast(PLACES))

    return let(F.regexp_extract_all(text, by, F.lit(0)), some)


def rewritten(text: Column, spans: Column) -> Column:
    """The text with spans (sorted, apart from each other: start, end, to) replaced by their `to`."""

    def piece(s: Column) -> Callable[[Column], Column]:
        def one(c: Column) -> Column:
            part = F.slice(s, c * CHUNK + 1, F.lit(CHUNK))
            start = F.when(c == 0, F.lit(0)).otherwise(F.get(s, c * CHUNK - 1)["end"])

            def cut(x: Column) -> Column:
                body = F.substr(text, x["from"] + 1, F.element_at(x["part"], -1)["end"] - x["from"])

                def inside(b: Column) -> Column:
                    before = lambda i: F.when(i == 0, x["from"]).otherwise(F.get(x["part"], i - 1)["end"])
                    return F.array_join(F.transform(x["part"], lambda y, i: F.concat(F.substr(b, before(i) - x["from"] + 1, y["start"] - before(i)), y["to"])), "")

                return let(body, inside)

            return let(F.struct(part.alias("part"), start.alias("from")), cut)

        return one

    def whole(s: Column) -> Column:
        return F.concat(F.array_join(chunks(F.size(s), piece(s)), ""), F.substr(text, F.element_at(s, -1)["end"] + 1))

    return let(spans, lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(text))
