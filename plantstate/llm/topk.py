"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks.

Vectors are sparse integer rows, their dimensions the terms. A block of rows has a
posting list (rows, weights) for each term; each term of a query adds its weight times
the postings into a dense array of scores. Each block selects its k best for a query
with a partial sort, and a window over those merges the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantstate.llm.common import at, numbered, stage

QUERY_BLOCK, ROW_BLOCK, SLICE = 1024, 4096, 64


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """id, uid, v: floor(scale x component) of each vector, written. Rows whose id or vector is null, or that hold
    null or non-finite components, are left out: they take no part. uid numbers the rows, as ids may repeat."""
    d = numbered(df)
    v = F.col("x")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.select(d[at(df, id_col)].cast("long").alias("id"), d[at(df, vector_col)].cast("array<double>").alias("x"))
    d = d.where(F.col("id").isNotNull() & v.isNotNull() & ~bad)
    return stage(d.select("id", F.monotonically_increasing_id().alias("uid"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")), "vectors")


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, row numbers and a dense matrix; shorter vectors are filled up with zeros."""
    ids, uids = table.column("id").to_numpy(), table.column("uid").to_numpy()
    v = table.column("v").combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) and v.num_chunks else v
    if len(ids) == 0:
        return ids, uids, np.zeros((0, 0), np.int64)
    lengths, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return ids, uids, out


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """(rows, weights) of each term. A term that most rows hold keeps its zeros, as a slice is faster than a list."""
    out = []
    for t in range(rows.shape[1]):
        there = np.flatnonzero(rows[:, t])
        out.append((there, rows[there, t].copy()) if 2 * len(there) < len(rows) else (slice(None), rows[:, t].copy()))
    return out


def scores(queries: np.ndarray, lists: list[tuple[np.ndarray | slice, np.ndarray]], n: int, kind: type) -> np.ndarray:
    """Inner products of some queries with a block, a term at a time."""
    total = np.zeros((len(queries), n), kind)
    product = np.empty_like(total)
    for t, (where, weights) in enumerate(lists[: queries.shape[1]]):
        with_term = np.flatnonzero(queries[:, t])
        if not len(with_term) or not len(weights):
            continue
        q = queries[with_term, t].astype(kind)[:, None]
        if isinstance(where, slice) and len(with_term) == len(queries):
            total += np.multiply(q, weights[None, :].astype(kind), out=product)
        elif isinstance(where, slice):
            total[with_term] += q * weights[None, :].astype(kind)
        else:
            total[with_term[:, None], where[None, :]] += q * weights[None, :].astype(kind)
    return total


def best_of_block(queries: pa.Table, rows: pa.Table, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """query id and row number, ids, row numbers and scores of its k best rows in the block, but for its own row."""
    (q_ids, q_uids, q), (ids, uids, v) = matrix(queries), matrix(rows)
    if not len(q_ids) or not len(ids):
        return
    order = np.lexsort((uids, ids))
    ids, uids, v = ids[order], uids[order], v[order]
    place = {u: i for i, u in enumerate(uids.tolist())}
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, v.shape[1])
    kind = np.int32 if most < 2**31 - 1 else np.int64
    none, lists = np.iinfo(kind).min, postings(v)
    for i in range(0, len(q_ids), SLICE):
        block = scores(q[i : i + SLICE], lists, len(ids), kind)
        for row, u in zip(block, q_uids[i : i + SLICE].tolist()):
            if u in place:
                row[place[u]] = none
        if len(ids) > k:
            least = np.partition(block, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            least = np.full(len(block), none, kind)
        for j, row in enumerate(block):
            found = np.flatnonzero(row >= least[j]) if least[j] > none else np.flatnonzero(row > none)
            found = found[np.argsort(-row[found].astype(np.int64), kind="stable")[:k]]
            yield int(q_ids[i + j]), int(q_uids[i + j]), ids[found], uids[found], row[found].astype(np.int64)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank (from 1), id, score: the k highest inner products, ties to the smaller id.

    queries and rows have id and uid long, v array<long>; uid is a row's number, the same in
    both. A query's own row is left out, others of its id are rows like any; queries that
    share an id have k rows each. Vectors of different lengths meet in the terms that both
    have. Scores must fit 64 bits. Blocks of rows, by a hash of uid, meet blocks of queries;
    a task holds one pair of blocks. Empty tables give no rows."""
    n_query = max(1, -(-queries.count() // query_block))
    n_row = max(1, -(-rows.count() // row_block))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    left = queries.select("id", "uid", "v", block(n_query).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_row - 1))).alias("rb"))
    right = rows.select("id", "uid", "v", block(n_row).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"))

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        found = list(best_of_block(q, r, k))
        each = lambda i: np.repeat([x[i] for x in found], [len(x[2]) for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        one = lambda i: np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64)
        return pa.table({"query_id": each(0), "query_uid": each(1), "id": one(2), "uid": one(3), "score": one(4)})

    blocks = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(search, "query_id long, query_uid long, id long, uid long, score long")
    best = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "id", "uid")
    return blocks.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def search_table(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """top_k() of the rows whose id is divisible by `every` against all rows."""
    rows = integer_vectors(df, id_col, vector_col)
    return top_k(rows.where(F.col("id") % every == 0), rows, k)
