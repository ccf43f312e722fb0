"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by angle. For a cluster with centroid c whose members lie within
an angle b of it, no member u scores more than |u| |x| cos(max(0, angle(x, c) - b)) on a
row x. Rows are sorted by that bound once for a cluster, and every member walks down
the list until the bound of what is left shows that nothing of it can be returned: so
results are those of a full scan, whatever the clusters are.

Rows are dealt in blocks by a hash and each block has lists of its own; anchors meet
every block, and a window over the blocks' best merges them. A first walk finds the
positives of an anchor, a second one its negatives, whose scores are bounded by the
positives'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantstate.llm.common import at, numbered, stage

#: Anchors of the sample that centroids are fitted on, and the most clusters.
SAMPLE, CLUSTERS = 4096, 64
ANCHOR_BLOCK, ROW_BLOCK, STEP = 4096, 8192, 512
#: Bounds of scores, and of scores times rows, up to which floats and 64-bit keys are exact.
EXACT_SCORE, EXACT_KEY = float(1 << 52), float(1 << 62)
_NONE = np.iinfo(np.int64).min


def labelled_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """id, uid, label, v: floor(scale x component) of each vector, written. Rows whose id, label or vector is null, or
    that hold null or non-finite components, take no part. uid numbers the rows, as ids may repeat."""
    d = numbered(df)
    d = d.select(d[at(df, id_col)].cast("long").alias("id"), d[at(df, label_col)].cast("long").alias("label"), d[at(df, vector_col)].cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    return stage(d.select("id", F.monotonically_increasing_id().alias("uid"), "label", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")), "vectors")


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows of integers, shorter ones filled up with zeros."""
    v = column.combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    lengths, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(v), max(width, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, norms) of rows; a row of zeros has no direction."""
    v = v.astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    return v / np.maximum(norm, 1e-300)[:, None], norm


def centroids(anchors: DataFrame, sample: int = SAMPLE, most: int = CLUSTERS, rounds: int = 5) -> np.ndarray:
    """Directions of at most `most` clusters, fitted on a sample of anchors: those of the smallest hashes, whatever the table's size."""
    found = anchors.select("v", F.xxhash64("uid").alias("h")).orderBy("h").limit(sample).select("v").toArrow()
    if not found.num_rows:
        return np.zeros((1, 0))
    v, _ = unit(matrix(found.column("v")))
    k = min(most, max(1, round(np.sqrt(len(v)))))
    center = v[:k]
    for _ in range(rounds):
        nearest = (v @ center.T).argmax(axis=1)
        total = np.zeros_like(center)
        np.add.at(total, nearest, v)
        center = np.where(np.abs(total).sum(axis=1, keepdims=True) > 0, unit(total)[0], center)
    return center


def clustered(anchors: DataFrame, centers: np.ndarray) -> DataFrame:
    """anchors with the number of their nearest centroid as cluster. Dimensions that the sample didn't have don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(pa.chunked_array([batch.column("v")]), centers.shape[1]).astype(np.float64)
            near = (v[:, : centers.shape[1]] @ centers.T).argmax(axis=1)
            yield batch.append_column("cluster", pa.array(near.astype(np.int32)))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(run, f"{ddl}, cluster int")


def bounds(members: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The most that any member, by its norm, can score on each row.

    The middle of the members is their mean direction; angles have some slack, as floats are not exact."""
    (u, size), (x, norm) = unit(members), unit(v)
    middle = unit(u.sum(axis=0, keepdims=True))[0][0]
    angle = lambda rows: np.arccos(np.clip(rows @ middle, -1, 1))
    wide = angle(u[size > 0]).max(initial=0.0)
    return norm * np.cos(np.clip(angle(x) - wide - 1e-6, 0, np.pi))


def walk(q: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The best k rows for each member and slot of a cluster, as keys: score x n + n - 1 - row, or none.

    rows: (uid, label, vectors), in the order that ties are settled in. low, high (members x
    slots): the scores that a slot takes. same: rows of the member's own label, without its own
    row, or those of another label."""
    uid, other, v = rows
    n = len(uid)
    norm = unit(q)[1]
    highest = float(norm.max(initial=0)) * float(unit(v)[1].max(initial=0))
    kind = np.int64 if highest < EXACT_SCORE and highest * n < EXACT_KEY else object
    none = _NONE if kind is np.int64 else -(1 << 200)
    best = np.full((*low.shape, k), none, kind)
    bound = bounds(q, v)
    order = np.argsort(-bound, kind="stable")
    rank = (n - 1 - np.arange(n)).astype(kind)
    active = np.arange(len(q))
    for i in range(0, n, STEP):
        # What is left scores no more than its first row's bound; equal scores may still win by a smaller id.
        rest = norm[active] * bound[order[i]] * (1 + 1e-9) + 1
        worst = best[active, :, 0] // n
        open_ = ((rest[:, None] >= low[active]) & (rest[:, None] >= worst)).any(axis=1)
        active = active[open_]
        if not len(active):
            break
        at_ = order[i : i + STEP]
        if kind is np.int64:
            score = np.rint(q[active].astype(np.float64) @ v[at_].astype(np.float64).T).astype(np.int64)
        else:
            score = q[active].astype(object) @ v[at_].astype(object).T
        fits = (label[active][:, None] == other[at_][None, :]) & (own[active][:, None] != uid[at_][None, :]) if same else label[active][:, None] != other[at_][None, :]
        key = score * n + rank[at_][None, :]
        for slot in range(low.shape[1]):
            lo, hi, worst = (x[active, slot][:, None] for x in (low, high, best[:, :, 0]))
            better = fits & (score >= lo) & (score <= hi) & (key > worst)
            hit = np.flatnonzero(better.any(axis=1))
            if len(hit):
                offered = np.where(better[hit], key[hit], none)
                both = np.concatenate([best[active[hit], slot], offered], axis=1)
                best[active[hit], slot] = np.sort(both, axis=1)[:, -k:]
    return best[:, :, ::-1]


def _block(n: int):
    return F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")


def best_rows(anchors: DataFrame, rows: DataFrame, same: bool, k: int, anchor_block: int, row_block: int) -> DataFrame:
    """anchor (uid), slot, id, uid, score: for each anchor and slot (arrays low and high: the scores it takes) the best k rows of each block."""
    n_anchor = max(1, -(-anchors.count() // anchor_block))
    n_row = max(1, -(-rows.count() // row_block))
    left = anchors.withColumns({"ab": _block(n_anchor), "rb": F.explode(F.sequence(F.lit(0), F.lit(n_row - 1)))})
    right = rows.withColumns({"rb": _block(n_row), "ab": F.explode(F.sequence(F.lit(0), F.lit(n_anchor - 1)))})
    empty = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])

    def search(a: pa.Table, r: pa.Table) -> pa.Table:
        if not a.num_rows or not r.num_rows:
            return empty.empty_table()
        ids, uids, labels = (r.column(c).to_numpy() for c in ("id", "uid", "label"))
        order = np.lexsort((uids, ids))
        ids, uids, labels = ids[order], uids[order], labels[order]
        v = matrix(r.column("v"))[order]
        q = matrix(a.column("v"), v.shape[1])
        v = np.pad(v, ((0, 0), (0, q.shape[1] - v.shape[1])))
        own, label, cluster = (a.column(c).to_numpy() for c in ("uid", "label", "cluster"))
        low, high = (matrix(a.column(c)) for c in ("low", "high"))
        # Slots that an anchor lacks take nothing.
        slots = np.array([len(x) for x in a.column("low").to_pylist()])
        high[np.arange(high.shape[1])[None, :] >= slots[:, None]] = _NONE
        low[np.arange(low.shape[1])[None, :] >= slots[:, None]] = np.iinfo(np.int64).max
        made = []
        for c in np.unique(cluster):
            m = np.flatnonzero(cluster == c)
            best = walk(q[m], own[m], label[m], same, low[m], high[m], k, (uids, labels, v))
            member, slot, _ = found = np.nonzero(best > (_NONE if best.dtype == np.int64 else -(1 << 200)))
            key = best[found]
            row = (len(ids) - 1 - key % len(ids)).astype(np.int64)
            made.append((own[m][member], slot.astype(np.int32), ids[row], uids[row], (key // len(ids)).astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*made), empty)], schema=empty)

    found = left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(search, "anchor long, slot int, id long, uid long, score long")
    first = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", "uid")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mined(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`; positives the best other rows of the
    anchor's label; negatives, for each positive, the best rows of another label whose score is
    least to most percent of the positive's. Scores are integer inner products, ties go to the
    smaller id. An anchor without positives, and a positive without negatives, has no rows;
    fewer than asked for are returned as they are. With a positive score below zero the range
    is empty. Rows that share an id are rows like any, but for an anchor's own row. Vectors of
    different lengths meet in the components that both have. Scores must fit 64 bits. Empty
    tables give no rows."""
    rows = labelled_vectors(df, id_col, vector_col, label_col, scale)
    anchors = rows.where(F.col("id") % every == 0)
    anchors = stage(clustered(anchors, centroids(anchors)), "anchors")
    lowest, highest = _NONE // 4, -(_NONE // 4)
    every_score = anchors.withColumns({"low": F.array(F.lit(lowest)), "high": F.array(F.lit(highest))})
    good = stage(best_rows(every_score, rows, True, positives, anchor_block, row_block).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # The scores that each positive's negatives may have, rounded to whole numbers within.
    p = F.col("positive_score").cast("decimal(25,0)")
    span = F.struct("slot", F.ceil(p * least / 100).cast("long").alias("low"), F.floor(p * most / 100).cast("long").alias("high"))
    spans = good.groupBy("anchor").agg(F.sort_array(F.collect_list(span)).alias("s")).select(F.col("anchor").alias("uid"), F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    bad = best_rows(stage(anchors.join(spans, "uid"), "asked"), rows, False, negatives, anchor_block, row_block)
    pairs = bad.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(good, ["anchor", "slot"])
    return pairs.join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
