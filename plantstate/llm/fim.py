"""Fill-in-middle: texts are cut at two ranks of their units and put together in another order.

A unit is a run of letters or any other single character. The ranks count units, the
cuts are code points; an indexable skip list leads from one to the other. Its lowest
lane has a link for each unit, each lane above links every STRIDE-th node of the lane
below, and every link carries how many units and how many code points it spans. A
descent from the top adds up both widths while the next link still fits under the rank.

A chunk of texts shares one list: the rank of a cut is the units before its text, plus
the units before the cut. All cuts of a chunk go down together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantstate.llm.common import at, blank_if_null, numbered

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
STRIDE = 16
#: Code points whose list is built at once; a longer text has a list of its own.
CHUNK = 1 << 20


class Lane(NamedTuple):
    """Links of one lane: link i spans units[i] units and points[i] code points."""

    units: np.ndarray
    points: np.ndarray


class SkipList:
    """Widths of consecutive units, indexed by unit. Link i of a lane starts at link i * STRIDE of the lane below."""

    def __init__(self, widths: np.ndarray):
        self.lanes = [Lane(np.ones(len(widths), np.int64), widths.astype(np.int64))]
        while len(self.lanes[-1].units) > STRIDE:
            below = self.lanes[-1]
            starts = np.arange(0, len(below.units), STRIDE)
            self.lanes.append(Lane(np.add.reduceat(below.units, starts), np.add.reduceat(below.points, starts)))

    def points_before(self, ranks: np.ndarray) -> np.ndarray:
        """Code points before each rank (0 to the number of units)."""
        left, points, link = ranks.astype(np.int64), np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for level in range(len(self.lanes) - 1, -1, -1):
            lane, moving = self.lanes[level], np.arange(len(ranks))
            while len(moving):
                moving = moving[link[moving] < len(lane.units)]
                moving = moving[lane.units[link[moving]] <= left[moving]]
                left[moving] -= lane.units[link[moving]]
                points[moving] += lane.points[link[moving]]
                link[moving] += 1
            link *= STRIDE if level else 1
        return points


def widths_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of each unit of all texts, units of each text)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    letter = (((points | 32) - 97) < 26) & (points < 128)
    inside = np.zeros(len(points), bool)
    inside[1:] = letter[1:] & letter[:-1]
    first = (ends - sizes)[sizes > 0]
    inside[first] = False
    starts = np.flatnonzero(~inside)
    units = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - sizes)
    return np.diff(np.append(starts, len(points))), units


def dealt(key: int | None) -> list[int]:
    """Four numbers of 32 bits, drawn from the id of a text; a null id draws as an empty one."""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def joined(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == PSM:
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text, from output and form alone.

    A transformed text holds no mark and no mark overlaps itself or another, so the first of each is the true one."""
    if form == PLAIN:
        return output
    second, third = output.index(SUFFIX if form == PSM else PREFIX), output.index(MIDDLE)
    one, two, middle = output[3:second], output[second + 3 : third], output[third + 3 :]
    prefix, suffix = (one, two) if form == PSM else (two, one)
    return prefix + middle + suffix


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = 10, spm: int = 20) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output, restored: one row per document.

    plain: percent of texts left as they are, spm: percent of the others that begin with the
    suffix. Empty and null texts, and texts that hold a mark, stay plain; a plain text has null
    prefix_chars and middle_chars and is its own output. Cuts depend on the id and the text
    only: repeated rows give the same row each; of rows with a null id texts of one length are
    cut alike. Two equal cuts leave an empty middle. Long texts are whole; memory holds one
    chunk. An empty table gives no rows."""
    d = numbered(docs)
    key = d[at(docs, id_col)].cast("long")
    d = d.select(key.alias("key"), blank_if_null(d[at(docs, text_col)]).alias("t"))
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("restored", pa.string())])

    def some(keys: list, texts: list[str]) -> pa.RecordBatch:
        widths, units = widths_of(texts)
        drawn = [dealt(k) for k in keys]
        draws = np.array(drawn, np.int64).reshape(-1, 4)
        ranks = np.sort(draws[:, :2] % (units[:, None] + 1), axis=1)
        before = np.cumsum(units) - units
        lists = SkipList(widths)
        base = lists.points_before(before)
        a, b = (lists.points_before(before + ranks[:, i]) - base for i in (0, 1))
        rows = []
        for k, t, n, (_, _, third, fourth), i, j in zip(keys, texts, units.tolist(), drawn, a.tolist(), b.tolist()):
            if not t or third % 100 >= 100 - plain or PREFIX in t or SUFFIX in t or MIDDLE in t:
                rows.append((k, n, PLAIN, None, None, t, t))
                continue
            form = SPM if fourth % 100 < spm else PSM
            output = joined(form, t[:i], t[i:j], t[j:])
            rows.append((k, n, form, i, j - i, output, restored(output, form)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, i = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while i < len(texts):
                size, j = len(texts[i]), i + 1
                while j < len(texts) and size + len(texts[j]) <= CHUNK:
                    size, j = size + len(texts[j]), j + 1
                yield some(keys[i:j], texts[i:j])
                i = j

    return d.mapInArrow(run, "key long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
