"""Secret scans: fixed patterns, and Markov models of characters that find random strings.

Two first-order models, of random strings and of ordinary identifiers, are compared by the
log-likelihood ratio of a string. They are trained from labelled samples: keyed digests of
the documents in the usual encodings are random by construction, and the identifiers of
the texts that no pattern matches are ordinary. Both grow with the corpus. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantstate.llm.common import CHUNK, at, blank_if_null, chunks, let, numbered, placed, rewritten

#: The patterns of the base scan, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 characters or more
KINDS = ("assign", "access", "hex", "random")

#: Strings that the models judge: whole runs of these characters, with no letter of another alphabet at their ends.
CANDIDATE = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_-]{12,}+={0,2}+(?![\p{L}\p{N}+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio of a whole string, in nats, from which it counts as random: at even odds of both
#: models one ordinary string in e^12 (160,000) passes.
LEAST_RATIO = 12.0
#: Counts by which a model trusts how often a character stands at all.
BACKOFF = 20
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as an array of (start, kind, end, value)."""
    return F.transform(placed(text, pattern), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """The base scan of one text. An assignment is dropped after matching if its value has under 12 characters."""
    assign = F.filter(spans_of(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 12)
    return F.sort_array(F.concat(assign, spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)))


def random_strings(key: Column) -> Column:
    """Random strings of a key, in the usual encodings: base64, its URL form, letters and digits, capitals and digits, hex."""

    def coded(digest: Column) -> Column:
        code = F.base64(F.unhex(digest))
        plain = F.translate(code, "+/=", "")
        return F.array(code, F.translate(code, "+/=", "-_"), plain, F.substring(plain, 1, 24), F.substring(F.upper(plain), 1, 20), F.substring(digest, 1, 40))

    return let(F.sha2(F.concat(F.lit("sample:"), key), 256), coded)


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """value, label, times: samples for training, from all documents. Encoded digests of (id, length of the text) are
    random strings (1); runs of 6 or more letters, digits, _ and - that stand in the corpus twice or more and
    hold no base span are ordinary identifiers (0): secrets stand alone."""
    texts = numbered(docs).select(F.concat_ws("|", F.col(at(docs, id_col)).cast("string"), F.length(at(docs, text_col)).cast("string")).alias("k"), blank_if_null(F.col(at(docs, text_col))).alias("t"))
    made = texts.select(F.explode(random_strings(F.col("k"))).alias("value"), F.lit(1).alias("label"), F.lit(1).cast("long").alias("times"))
    words = F.regexp_extract_all("t", F.lit(r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9_-]{6,}+(?![\p{L}\p{N}+/_=-])"), F.lit(0))
    plain = texts.select(F.explode(words).alias("value")).groupBy("value").agg(F.count("*").alias("times")).where((F.col("times") > 1) & ~F.col("value").rlike(f"{HEX}|{ACCESS}"))
    return made.unionByName(plain.withColumn("label", F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio for each pair of characters, row by row of ALPHABET.

    Pairs are counted over all samples (value, label, times). The chance of a character after another is its
    count there with BACKOFF counts added, dealt by how often the character stands at all.
    The counts are at most 2 x 67 x 67 rows, whatever the data, so they may come to the driver."""
    import math

    n = len(ALPHABET)
    first = F.expr(f"instr('{ALPHABET}', a) - 1")
    second = F.expr(f"instr('{ALPHABET}', b) - 1")
    distinct = samples.groupBy("value", "label").agg(F.sum("times").alias("times"))
    neighbours = let(F.split("value", ""), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.concat(a, b)))
    pairs = distinct.where(F.length("value") > 1).select("label", "times", F.explode(neighbours).alias("pair"))
    counted = pairs.groupBy("label", "pair").agg(F.sum("times").alias("times")).select("label", F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b"), "times")
    table = {(r.label, r.i, r.j): r.times for r in counted.select("label", first.alias("i"), second.alias("j"), "times").where("i >= 0 and j >= 0").collect()}
    rows = {(label, i): sum(table.get((label, i, j), 0) for j in range(n)) for label in (0, 1) for i in range(n)}
    columns = {(label, j): sum(table.get((label, i, j), 0) for i in range(n)) for label in (0, 1) for j in range(n)}
    whole = [sum(columns[label, j] for j in range(n)) for label in (0, 1)]

    def log_p(label: int, i: int, j: int) -> float:
        alone = (columns[label, j] + 1) / (whole[label] + n)
        return math.log((table.get((label, i, j), 0) + BACKOFF * alone) / (rows[label, i] + BACKOFF))

    return [round(log_p(1, i, j) - log_p(0, i, j), 6) for i in range(n) for j in range(n)]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string: the sum over its character pairs."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    n = len(ALPHABET)
    places = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    pairs = let(places, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.element_at(table, (a * n + b + 1).cast("int"))))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def scanned(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """All columns of docs renamed by position, and base and spans: arrays of (start, kind, end, value).

    spans: the base spans and those strings that the models judge random and no base span
    overlaps. Null text is empty; a text without secrets has empty arrays. Repeated rows
    give repeated rows. Texts of any length are scanned whole. An empty table gives no rows."""
    model = train(labelled(docs, id_col, text_col)) if model is None else model
    d = numbered(docs)
    d = d.withColumn("base", base_spans(blank_if_null(d[at(docs, text_col)])))
    # Places are worked out for texts with a random string only.
    text = blank_if_null(d[at(docs, text_col)])
    strings = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))), lambda v: ratio(v, model) >= least)
    apart = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = let(strings, lambda v: F.when(F.size(v) > 0, F.filter(spans_of(text, CANDIDATE, 3), lambda s: F.array_contains(v, s["value"]) & apart(s))).otherwise(F.array().cast(SPAN)))
    return d.withColumn("spans", F.sort_array(F.concat("base", found)))


def merged(spans: Column, mark: str) -> Column:
    """start, end, to: sorted spans as spans apart from each other; of overlapping ones the first has the mark."""
    out = F.array().cast("array<struct<start:int,end:int,to:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(acc["pos"], x["start"])
        one = F.struct(start.alias("start"), x["end"].alias("end"), F.when(x["start"] >= acc["pos"], mark).otherwise("").alias("to"))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(x["end"] > start, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def parts(s: Column) -> Column:
        upto = lambda c: F.coalesce(F.array_max(F.transform(F.slice(s, F.lit(1), c * CHUNK), lambda x: x["end"])), F.lit(0))
        return F.flatten(chunks(F.size(s), lambda c: F.aggregate(F.slice(s, c * CHUNK + 1, F.lit(CHUNK)), F.struct(upto(c).alias("pos"), out.alias("out")), step, lambda acc: acc["out"])))

    return let(spans, lambda s: F.when(F.size(s) > 0, parts(s)).otherwise(out))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", mark: str = "<SECRET>", model: list[float] | None = None) -> DataFrame:
    """docs with every span of its text replaced by mark (overlapping spans by one) and length_col, if any, set anew.

    Texts without secrets, and null ones, stay as they are."""
    s = scanned(docs, model, id_col, text_col)
    clean = rewritten(F.col(at(docs, text_col)), merged(F.col("spans"), mark))
    s = s.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(F.col(at(docs, text_col))))
    out = []
    for i, name in enumerate(docs.columns):
        if name == text_col:
            out.append(F.col("clean").alias(f"c{i}"))
        elif name == length_col:
            out.append(F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[i].dataType)).otherwise(F.col(f"c{i}")).alias(f"c{i}"))
        else:
            out.append(F.col(f"c{i}"))
    return s.select(*out).toDF(*docs.columns)
