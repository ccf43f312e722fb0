"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each feature of a document falls into an integer bucket; a sketch is the count of documents
by bucket, so that sketches of any parts of the data merge by adding counts. The
sketch of a (language, source) sets its cuts, drawn to those of its language by the weight of
PRIOR documents, as these are to those of everything: a small group follows its language, a
large one its own documents, and none changes all at once. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantstate.llm.common import WHITE, at, blank_if_null, let, numbered, row_id, stage, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Feature:
    """value = floor(scale x top / bottom); bucket: its first ten binary digits. wide: the least spread. low, high: the sides that are cut."""

    name: str
    top: str
    bottom: str
    scale: int
    wide: int
    low: bool
    high: bool


FEATURES = (
    Feature("word_length", "word_chars", "n_words", 20, 10, True, True),
    Feature("symbols", "n_symbols", "n_words", 100, 10, False, True),
    Feature("dup_lines", "n_dup_lines", "n_lines", 100, 20, False, True),
    Feature("repeats", "n_repeat_words", "n_words", 100, 10, False, True),
    Feature("echoes", "n_echo_words", "n_words", 100, 10, False, True),
    Feature("shouting", "n_loud", "word_chars", 200, 10, False, True),
)
#: Spreads beyond the quartiles at which a document is cut; documents that the wider group counts as.
REACH, PRIOR = 3, 200


def repeated_words(hashes: Column) -> Column:
    """Words, given by their hashes, that lie in a window of eight found at least twice in the text.

    Windows are compared by 64-bit hashes. Only where some hash recurs are the positions
    of those that do sorted; each covers eight words or up to the next."""
    last = F.size(hashes) - WINDOW

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda p: let(_positions(p), _length)))

    return F.when(last < 1, F.lit(0)).otherwise(let(windows(hashes), covered))


def _positions(pairs: Column) -> Column:
    n = F.size(pairs)
    behind = F.zip_with(pairs, F.slice(pairs, F.lit(2), n), lambda a, b: F.when(a["x"] == b["x"], a["i"]))
    ahead = F.zip_with(F.slice(pairs, F.lit(2), n), pairs, lambda a, b: F.when(a["x"] == b["x"], a["i"]))
    return F.sort_array(F.array_distinct(F.filter(F.concat(behind, ahead), lambda i: i.isNotNull())))


def _length(places: Column) -> Column:
    steps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def echoed_words(hashes: Column) -> Column:
    """Words that are followed by themselves."""
    return F.size(F.filter(hashes, lambda x, i: x == F.get(hashes, i + 1)))


def statistics(text: Column) -> dict[str, Column]:
    """The counts that the rules use, as columns over one text (null: empty)."""
    t = blank_if_null(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return {
        "by_word": let(F.transform(words_of(t), lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).cast("long").alias("n_repeat_words"), echoed_words(h).cast("long").alias("n_echo_words"))),
        "by_line": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_loud": F.regexp_count(t, F.lit(r"[A-Z!]")).cast("long"),
    }


def bucket(value: Column) -> Column:
    """A value below 1024 is its own bucket; larger ones keep their first ten binary digits, so a bucket is at most
    1/512 wide of its value, no value is cut off, and a sketch has at most 1024 + 53 x 512 buckets however many documents."""
    return value - F.pmod(value, F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(value)) - 10, F.lit(0))))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """key, lang, src, row (128 bits of the whole row), the counts, base_failed and a bucket per feature."""
    d = numbered(docs)
    counts = statistics(d[at(docs, text_col)])
    m = d.select(d[at(docs, id_col)].alias("key"), d[at(docs, lang_col)].cast("string").alias("lang"), d[at(docs, source_col)].cast("string").alias("src"), row_id(*[d[at(docs, c)] for c in (id_col, text_col, lang_col, source_col)]).alias("row"), *[c.alias(n) for n, c in counts.items()])
    m = m.select("key", "lang", "src", "row", "by_word.*", "by_line.*", "word_chars", "n_symbols", "n_loud")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    values = [F.when(F.col(f.bottom) > 0, F.expr(f"{f.scale} * {f.top} div {f.bottom}")).otherwise(F.lit(0)).cast("long").alias(f"v_{f.name}") for f in FEATURES]
    m = m.select("*", failed.alias("base_failed"), *values)
    return m.select(*[c for c in m.columns if not c.startswith("v_")], *[bucket(F.col(f"v_{f.name}")).alias(f"b_{f.name}") for f in FEATURES])


def sketches(rows: DataFrame) -> DataFrame:
    """lang, src, feature, bucket, n: the sketch of each (language, source)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("feature"), F.col(f"b_{f.name}").alias("bucket")) for f in FEATURES]))
    return rows.where("n_words > 0").select("lang", "src", pairs.alias("p")).groupBy("lang", "src", "p.feature", "p.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, by: list[str], level: str) -> DataFrame:
    """by, feature, and n, lo, hi of a level: its documents, and its own cuts. lo is 0 where nothing is too low, else one more
    than the highest bucket that is."""
    own = Window.partitionBy(*by, "feature")
    ranked = sketch.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(own.orderBy("bucket")), "total": F.sum("n").over(own)})
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))
    q = ranked.groupBy(*by, "feature").agg(F.max("total").alias("n"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    wide, low, high = (F.create_map(*[F.lit(x) for f in FEATURES for x in (f.name, getattr(f, side))])[F.col("feature")] for side in ("wide", "low", "high"))
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), wide)
    lo = F.when(low, F.greatest(F.col("q1") - reach, F.lit(0))).otherwise(F.lit(0))
    hi = F.when(high, F.col("q3") + reach).otherwise(F.lit(1 << 40))
    return q.select(*[F.col(b).alias(f"{level}_{b}") for b in by], F.col("feature").alias(f"{level}_feature"), F.col("n").alias(f"{level}_n"), lo.alias(f"{level}_lo"), hi.alias(f"{level}_hi"))


def cuts(sketch: DataFrame) -> DataFrame:
    """lang, src and an array cut of (feature, lo, hi): buckets below lo or above hi are cut.

    Each level is joined by its own keys: groups to their language, languages to everything."""
    g, l, a = _fences(sketch, ["lang", "src"], "g"), _fences(sketch, ["lang"], "l"), _fences(sketch, [], "a")  # noqa: E741
    langs = l.join(a, F.col("l_feature") == F.col("a_feature"))
    drawn = lambda n, own, wider: F.expr(f"({n} * {own} + {PRIOR} * {wider}) div ({n} + {PRIOR})")
    langs = langs.select("l_lang", "l_feature", drawn("l_n", "l_lo", "a_lo").alias("w_lo"), drawn("l_n", "l_hi", "a_hi").alias("w_hi"))
    both = g.join(langs, (F.col("g_feature") == F.col("l_feature")) & F.col("g_lang").eqNullSafe(F.col("l_lang")))
    return both.groupBy(F.col("g_lang").alias("lang"), F.col("g_src").alias("src")).agg(
        F.collect_list(F.struct(F.col("g_feature").alias("feature"), drawn("g_n", "g_lo", "w_lo").alias("lo"), drawn("g_n", "g_hi", "w_hi").alias("hi"))).alias("cut")
    )


def judged(docs: DataFrame, **columns: str) -> DataFrame:
    """measured() and kept: false for base_failed, else whether every feature lies between its cuts.

    Null text is empty: no words, base_failed. Null language or source: a group of its
    own. Repeated rows are judged alike. An empty table gives no rows."""
    rows = stage(measured(docs, **columns), "quality")
    c = cuts(sketches(rows)).select(F.col("lang").alias("c_lang"), F.col("src").alias("c_src"), "cut")
    joined = rows.join(c, F.col("lang").eqNullSafe(F.col("c_lang")) & F.col("src").eqNullSafe(F.col("c_src")), "left")
    value = F.create_map(*[x for f in FEATURES for x in (F.lit(f.name), F.col(f"b_{f.name}"))])
    inside = F.forall(F.coalesce(F.col("cut"), F.array().cast("array<struct<feature:string,lo:bigint,hi:bigint>>")), lambda x: value[x["feature"]].between(x["lo"], x["hi"]))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("c_lang", "c_src", "cut")


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns. The rejected rows' hashes are anti-joined, so the texts are read again, not measured again."""
    gone = judged(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col).where(~F.col("kept")).select(F.col("row").alias("gone")).distinct()
    d = numbered(docs)
    row = row_id(*[d[at(docs, c)] for c in (id_col, text_col, lang_col, source_col)])
    return d.withColumn("row", row).join(gone, F.col("row") == F.col("gone"), "left_anti").drop("row").toDF(*docs.columns)
