"""Passages that repeat in a corpus: seed and extend from winnowed anchors.

A window is LENGTH consecutive words. Its anchor is the rightmost smallest of the
fingerprints of its shingles of SEED words: equal windows have equal anchors at equal
places, so every repeat of LENGTH words or more shares one, and consecutive windows
that share an anchor are kept as one seed (a dozen words apart on average).

Seeds are joined on their anchors. Each is extended both ways as far as the windows of
its anchor reach: seeds whose whole surroundings are equal form a class, and a class of
two or more is a repeat in full. Where an anchor has several classes, they may still
share a part: one seed of each such class is extended word by word, as the windows of
its surroundings, and windows that meet are repeats. Overlapping repeats of a text are
merged, so that what is left are maximal spans.

Anchors, classes and windows are counted before they are joined, never paired: rows grow
with the text, not with the square of a group. Copies of a text meet as one text first,
and only seeds whose anchor occurs again go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantstate.llm.common import at, blank_if_null, numbered, stage
from plantstate.llm.omh import CHUNK, mixed, powers

LENGTH, SEED = 35, 12

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of some texts as fingerprints, and prefix sums that give the fingerprint of any run of words."""

    def __init__(self, texts: list[bytes]):
        ends = np.cumsum([len(t) + 1 for t in texts])
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        up, down = powers(len(data) + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])])
        word = mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(_U) * _U(0xD6E8FEB86659FD93))
        self.owner = np.searchsorted(ends, start, "right")
        self.count = np.bincount(self.owner, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.place = np.arange(len(word)) - self.first[self.owner]
        self._down = down
        self._sums = [np.concatenate([np.zeros(1, _U), np.cumsum(w * up[: len(word)])]) for w in (word, mixed(word ^ _U(0xA0761D6478BD642F)))]

    def run(self, start: np.ndarray, length: np.ndarray | int, half: int) -> np.ndarray:
        """Fingerprints (half 0 or 1 of 128 bits) of the words from start on."""
        s = self._sums[half]
        return mixed((s[start + length] - s[start]) * self._down[start] + _U(half))


def seeds(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, anchor): runs of windows, by their first words, that share an anchor, with its fingerprint."""
    n = len(words.owner)
    wide = length - seed + 1
    begin = np.flatnonzero(words.place + length <= words.count[words.owner]) if n else np.zeros(0, np.int64)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(_U)
    shingle = words.run(np.arange(n - seed + 1), seed, 0)
    view = np.lib.stride_tricks.sliding_window_view(shingle, wide)[:, ::-1]
    chosen = np.empty(len(begin), np.int64)
    for i in range(0, len(begin), 1 << 16):
        at_ = begin[i : i + (1 << 16)]
        chosen[i : i + len(at_)] = at_ + wide - 1 - view[at_].argmin(axis=1)
    new = np.flatnonzero(np.concatenate([[True], np.diff(chosen) != 0]))
    last = np.append(new[1:], len(begin)) - 1
    return begin[new], begin[last], shingle[chosen[new]]


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are handled at once."""
    i = 0
    while i < len(texts):
        size, j = len(texts[i]), i + 1
        while j < len(texts) and size + len(texts[j]) < CHUNK:
            size, j = size + len(texts[j]), j + 1
        yield i, j
        i = j


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64) if values.dtype == _U else values, kind))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, x and y (128 bits of the text), pick (of the id, to tell copies apart), s (the text)."""
    d = numbered(docs)
    d = d.select(d[at(docs, id_col)].cast("long").alias("key"), blank_if_null(d[at(docs, text_col)]).alias("s"))
    return d.select("key", F.xxhash64("s").alias("x"), F.xxhash64(F.lit(5), "s").alias("y"), F.xxhash64("key").alias("pick"), "s")


def profiles(rows: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """x, y, pick, n_words, digest (of all words), and arrays start, last, anchor, around of the seeds of each text."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("pick", pa.int64()), ("n_words", pa.int64()), ("digest", pa.binary()), ("start", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("anchor", pa.list_(pa.int64())), ("around", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for i, j in _parts(texts):
                part = texts[i:j]
                w = Words(part)
                start, last, anchor = seeds(w, length, seed)
                owner = w.owner[start]
                found = [(start - w.first[owner]).astype(np.int32), (last - w.first[owner]).astype(np.int32), anchor, w.run(start, last - start + length, 0)]
                digest = [hashlib.sha256(b" ".join(t.split())).digest() for t in part]
                own = [batch.column(k).slice(i, j - i) for k in range(3)]
                made = [*own, pa.array(w.count, pa.int64()), pa.array(digest, pa.binary()), *(_lists(v, owner, j - i, f.type.value_type) for v, f in zip(found, list(schema)[5:]))]
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    ddl = "x long, y long, pick long, n_words long, digest binary, start array<int>, last array<int>, anchor array<long>, around array<long>"
    return rows.select("x", "y", "pick", F.encode("s", "UTF-8")).mapInArrow(run, ddl)


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """w1, w2, t, start, copies: the windows of the seeds (array todo of start, last, copies) of each text s."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, texts, todo = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, j in _parts(texts):
                w = Words(texts[i:j])
                asked = np.array([(k, s["start"], s["last"], s["copies"]) for k in range(i, j) for s in todo[k]], np.int64).reshape(-1, 4)
                sizes = asked[:, 2] - asked[:, 1] + 1
                row = np.repeat(np.arange(len(asked)), sizes)
                start = asked[row, 1] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                here = w.first[asked[row, 0] - i] + start
                made = [w.run(here, length, 0).view(np.int64), w.run(here, length, 1).view(np.int64), t[asked[row, 0]], start.astype(np.int32), asked[row, 3]]
                for k in range(0, len(row), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 16)], f.type) for v, f in zip(made, schema)], schema=schema)

    return texts.select("t", F.encode("s", "UTF-8"), "todo").mapInArrow(run, "w1 long, w2 long, t long, start int, copies long")


def _cleared(texts: DataFrame, length: int) -> DataFrame:
    """t, n_removed, digest, kept, spans: a text s without the words under its windows (array spans of start, last)."""
    schema = pa.schema([("t", pa.int64()), ("n_removed", pa.int64()), ("digest", pa.binary()), ("kept", pa.string()), ("spans", pa.list_(pa.int32()))])

    def one(t: int, text: bytes, spans: list[dict]) -> tuple:
        words = text.split()
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, [s["start"] for s in spans], 1)
        np.add.at(edge, [s["last"] + length for s in spans], -1)
        gone = np.cumsum(edge[:-1]) > 0
        cut = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
        return t, int(gone.sum()), hashlib.sha256(kept).digest(), kept.decode("utf-8", "replace"), cut.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return texts.select("t", F.encode("s", "UTF-8"), "spans").mapInArrow(run, "t long, n_removed long, digest binary, kept string, spans array<int>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, kept, spans: a row per document without its words under repeated windows.

    spans are maximal (from, to, from, to, ...), by word, end exclusive. kept is null where all
    words stay and empty where none do, or if with_text is false; kept_sha256 is that of the
    kept words joined by one space in any case. A window is a repeat if its words also start
    anywhere else, in another row or in its own, also overlapping; all occurrences go. Repeated
    rows, and other rows of a text, are copies of it: all their words go if there are `length`
    or more. Null and empty texts and those shorter than `length` lose nothing. Very long texts
    are whole, one at a time. An empty table gives no rows. Surroundings and windows count as
    equal by 128 bits (surroundings: 64 of the anchor and 64 of their own)."""
    rows = _rows(docs, id_col, text_col)
    seen = profiles(rows, length, seed)
    # One row per text, with its number of copies; copies are counted before the shuffle.
    one = seen.groupBy("x", "y").agg(F.count("*").alias("copies"), F.min("pick").alias("pick"), F.first(F.struct("n_words", "digest", "start", "last", "anchor", "around")).alias("p"))
    texts = stage(one.select("x", "y", "pick", "copies", "p.*").withColumn("t", F.monotonically_increasing_id()), "texts")
    found = texts.select("t", "copies", F.explode(F.arrays_zip("start", "last", "anchor", "around")).alias("s")).select("t", "copies", "s.*")

    # Seeds whose anchor occurs again. Where all its surroundings are equal, each is a repeat in full.
    anchors = found.groupBy("anchor").agg(F.sum("copies").alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    anchors = stage(anchors.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("several")), "anchors")
    again = stage(found.join(anchors, "anchor"), "again")
    classes = stage(again.where("several").groupBy("anchor", "around").agg(F.sum("copies").alias("copies"), F.min(F.struct("t", "start", "last")).alias("at")), "classes")
    shared = classes.where("copies > 1").select("anchor", "around")
    single = again.where("copies = 1")
    # Each join is written by itself: its two exchanges are then read by nothing else, and a hot key's partition can be split.
    alike = stage(single.where("several").join(shared, ["anchor", "around"], "left_semi").select("t", "start", "last"), "alike")
    full = single.where("not several").select("t", "start", "last").unionByName(alike)

    # One seed of each class of the other anchors is extended word by word.
    named = texts.select("t", "x", "y", "pick")
    todo = classes.groupBy(F.col("at.t").alias("t")).agg(F.collect_list(F.struct("at.start", "at.last", "copies")).alias("todo")).join(named, "t")
    source = rows.select("x", "y", "pick", "s")
    windows = stage(_windows(source.join(stage(todo, "todo"), ["x", "y", "pick"]), length), "windows")
    place = F.struct("t", "start")
    met = windows.groupBy("w1", "w2").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("copies").alias("copies")).where("copies > 1 or low <> high")
    met = stage(met.select("w1", "w2"), "met")
    partial = stage(windows.where("copies = 1").join(met, ["w1", "w2"], "left_semi").select("t", "start", F.col("start").alias("last")), "partial")

    # Texts with copies lose all words, the others what lies under their windows.
    spans = full.unionByName(partial).groupBy("t").agg(F.collect_list(F.struct("start", "last")).alias("spans")).join(named, "t")
    cleared = _cleared(source.join(stage(spans, "spans"), ["x", "y", "pick"]), length).withColumnRenamed("digest", "left_")
    nothing = F.lit(hashlib.sha256(b"").digest())
    copied = (F.col("copies") > 1) & (F.size("start") > 0)
    info = texts.join(cleared if with_text else cleared.drop("kept"), "t", "left").select(
        "x", "y", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, nothing).otherwise(F.coalesce("left_", "digest")).alias("digest"),
        F.when(copied, F.lit("")).otherwise(F.col("kept") if with_text else F.lit(None).cast("string")).alias("kept"),
        F.when(copied, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.coalesce("spans", F.array().cast("array<int>"))).alias("spans"),
    )
    # Written, so that the join reads two plain exchanges and a text with many copies can be split.
    out = rows.select("key", "x", "y").join(stage(info, "kept"), ["x", "y"])
    return out.select("key", "n_words", "n_removed", F.lower(F.hex("digest")).alias("kept_sha256"), "kept", "spans")
