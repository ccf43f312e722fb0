"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its id. Words are summed by source and hash bucket;
the bucket in which a source's budget ends is refined, and only that one, until it
holds one hash. Rows are then filtered by a threshold: nothing is sorted, and a
smaller budget always selects a subset of a larger one's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantstate.llm.common import WORD, at, numbered, stage

BITS = 60
STEP = 12


def hash_bits(key: Column, seed: str) -> Column:
    """60 hash bits of an id; a null id hashes as an empty string."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def copies(most: int) -> Column:
    """How often a row is taken, from its h and its source's reps, cut and cut_in."""
    extra = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("cut_in"))
    return F.least(F.col("reps") + F.when(extra, 1).otherwise(0), F.lit(most).cast("long"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """key, src, size (words) and h (hash_bits of the id)."""
    d = numbered(docs)
    key = d[at(docs, id_col)]
    return d.select(
        key.alias("key"),
        d[at(docs, source_col)].cast("string").alias("src"),
        F.coalesce(F.regexp_count(d[at(docs, text_col)], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hash_bits(key, seed).alias("h"),
    )


def targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """src, source_size, target: sources in code-point order (null last) take the weights in turn.

    The sum of the targets is share x all words. A target stops at most x the size of its
    source; what exceeds it goes to the others by weight. With r = stop / weight ascending,
    the first source whose own r isn't below (words left) / (weight left) fixes the level.
    One row per source is windowed, never the documents."""
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    place = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % n + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("stop", F.col("source_size") * float(most))
    upto = Window.orderBy((F.col("stop") / F.col("w")).asc(), F.col("src").asc_nulls_last())
    before, after, everything = (upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy())
    s = s.withColumns({
        "level": (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("w").over(after),
    })
    level = F.min(F.when(F.col("level") <= F.col("stop") / F.col("w"), F.struct(F.col("stop") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"]
    return s.withColumn("line", level).select("src", "source_size", F.least("stop", F.col("w") * F.coalesce("line", F.lit(float("inf")))).alias("target"))


def thresholds(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """For each source: reps (whole times all its rows are taken), cut (rows with a hash below
    it are taken once more) and cut_in (whether the hash equal to it is, too).

    At the last hash the nearer side of the target wins."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    edge = aims.withColumn("reps", whole).select("src", "source_size", "target", "reps", (F.col("target") - F.col("reps") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("cut"), F.lit(0.0).alias("last"))
    for level in range(BITS // STEP):
        above, below = BITS - STEP * level, BITS - STEP * (level + 1)
        e = edge.select(F.col("src").alias("e_src"), "source_size", "target", "reps", "rest", "cut")
        inside = rows.join(e, F.col("src").eqNullSafe(F.col("e_src")) & (F.shiftright("h", above) == F.col("cut")))
        hist = inside.groupBy("src", "source_size", "target", "reps", "rest", F.shiftright("h", below).alias("cut")).agg(F.sum("size").alias("words"))
        own = Window.partitionBy("src").orderBy("cut")
        hist = hist.withColumns({"upto": F.sum("words").over(own), "final": F.lead("cut").over(own).isNull()})
        hit = hist.where((F.col("upto") > F.col("rest")) | F.col("final"))
        edge = hit.groupBy("src", "source_size", "target", "reps", "rest").agg(F.min(F.struct("cut", (F.col("upto") - F.col("words")).alias("under"), "words")).alias("b"))
        edge = edge.select("src", "source_size", "target", "reps", (F.col("rest") - F.col("b.under")).alias("rest"), F.col("b.cut").alias("cut"), F.col("b.words").cast("double").alias("last"))
    return edge.select("src", "source_size", "target", "reps", "cut", (F.col("rest") * 2 >= F.col("last")).alias("cut_in"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: str = "mix") -> DataFrame:
    """key, src, size, source_size, target, copies (0 to most) and taken (copies x size), a row per document.

    Null text and text without words: size 0. Null source: a source of its own, last.
    A source without any words is taken whole, once: its target of 0 is met in any case.
    Rows with the same id share a hash, so they are taken or left together. An empty
    table gives no rows. Other columns of docs play no part."""
    rows = stage(sized(docs, id_col, text_col, source_col, seed), "mix")
    return applied(rows, thresholds(rows, targets(rows, weights, share, most)), most)


def applied(rows: DataFrame, cuts: DataFrame, most: int = 3) -> DataFrame:
    c = cuts.withColumnRenamed("src", "c_src")
    joined = rows.join(c, F.col("src").eqNullSafe(F.col("c_src")), "left").withColumn("copies", copies(most))
    return joined.select("key", "src", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes, each as often as it takes them, with all their columns."""
    rows = stage(sized(docs, id_col, text_col, source_col, seed), "mix")
    cuts = thresholds(rows, targets(rows, weights, share, most)).withColumnRenamed("src", "c_src")
    d, names = numbered(docs), docs.columns
    d = d.withColumns({"h": hash_bits(d[at(docs, id_col)], seed), "src": d[at(docs, source_col)].cast("string")})
    times = copies(most).cast("int")
    taken = d.join(cuts, F.col("src").eqNullSafe(F.col("c_src")), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where(times >= F.col("copy"))
    return taken.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
