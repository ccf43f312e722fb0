"""Near-duplicate documents by order MinHash, candidates verified by banded alignment.

A document is its sequence of shingles of five words, each labelled with its occurrence
number, so that a label is unique in its document. A sketch takes, for each of BANDS
hash functions, the PICKED smallest labels and hashes them in text order: two documents
share it if they share these labels in this order. Documents that share one are
candidates. They are verified by alignment: the longest common subsequence of their labels
inside the band of shifts that LEAST allows. Similarity is the words that it covers, over
the words of either: a changed word costs one word, not the five shingles it is in.

Candidates are not expanded into pairs. First every document meets one leader of each
of its buckets; links make components. A bucket whose other members still lie in
several components is then compared in blocks inside tasks, which return a spanning
set of links. So no link that a bucket holds is lost, and rows grow with documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantstate.llm.common import at, blank_if_null, numbered, row_id, stage
from plantstate.llm.graphs import components

SHINGLE, BANDS, PICKED, LEAST = 5, 24, 4, 0.8
#: Members of a bucket that one task compares with as many others.
BLOCK = 256
#: Bytes of text that are hashed at once: the arrays of a chunk take some twenty times as much.
CHUNK = 1 << 19

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_ODD = (np.random.RandomState(11).randint(0, 1 << 62, BANDS, dtype=np.int64).astype(_U) << _U(1)) | _U(1)
_STEPS = (np.random.RandomState(12).randint(0, 1 << 62, 16, dtype=np.int64).astype(_U) << _U(1)) | _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n, kept for up to twice CHUNK."""
    size = 1 << max(10, int(n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _P, _U), np.full(size, pow(_P, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if size > 2 * CHUNK:
            return made
        _POWERS.clear()
        _POWERS[size] = made
    return _POWERS[size]


def labels(texts: list[bytes]) -> list[np.ndarray]:
    """The occurrence-labelled shingles of each text as 64-bit hashes, in text order.

    Texts of one to four words have one shingle, texts without words none."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = powers(len(data) + 1)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])])
    word = mixed((total[stop] - total[start]) * down[start])
    owner = np.searchsorted(ends, start, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)])
    shingle = np.zeros(len(word), _U)
    for k in range(SHINGLE):
        shingle[: len(word) - k] += word[k:] * _STEPS[k] * (owner[k:] == owner[: len(word) - k]).astype(_U)
    place = np.arange(len(word)) - first[owner]
    kept = place < np.maximum(n_words[owner] - SHINGLE + 1, 1)
    shingle, owner = mixed(shingle[kept]), owner[kept]
    # Occurrence numbers: a stable sort brings the same shingles of a document together in text order.
    order = np.argsort(shingle + mixed(owner.astype(_U) + _U(77)), kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (shingle[order[1:]] == shingle[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    run = np.arange(len(order))
    occurrence = np.zeros(len(order), _U)
    occurrence[order] = (run - np.maximum.accumulate(np.where(same, 0, run))).astype(_U)
    label = mixed(shingle + occurrence * _STEPS[8])
    return np.split(label, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])


def sketch(label: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of PICKED smallest labels in text order."""
    hashes = label[None, :] * _ODD[:, None]
    k = min(PICKED, len(label))
    at_ = np.argpartition(hashes, k - 1, axis=1)[:, :k] if k < len(label) else np.tile(np.arange(k), (BANDS, 1))
    picked = label[np.sort(at_, axis=1)]
    return mixed((picked * _STEPS[:k][None, :]).sum(axis=1, dtype=_U) + np.arange(BANDS).astype(_U)).view(np.int64)


def words(labels: int | np.ndarray) -> int | np.ndarray:
    """Words of a text by its labels; one of less than SHINGLE words counts as SHINGLE."""
    return labels + SHINGLE - 1


def chain(j: np.ndarray) -> np.ndarray:
    """Places of a longest increasing subsequence."""
    if (np.diff(j) > 0).all():
        return np.arange(len(j))
    tails: list[int] = []
    at_: list[int] = []
    before = np.full(len(j), -1)
    for place, x in enumerate(j.tolist()):
        k = bisect_left(tails, x)
        before[place] = at_[k - 1] if k else -1
        tails[k : k + 1], at_[k : k + 1] = [x], [place]
    out = [at_[-1]]
    while before[out[-1]] >= 0:
        out.append(int(before[out[-1]]))
    return np.array(out[::-1])


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Similarity of two label sequences, or 0 where a bound shows that it is below least."""
    if not len(a) or not len(b):
        return 0.0
    n, m = words(len(a)), words(len(b))
    common = least * (n + m) / (1 + least) - 1e-9
    if min(n, m) < least * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if SHINGLE * len(i) < common:
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    # Words that the best alignment leaves out on both sides bound the shift of any two aligned ones.
    near = np.abs(i - j) <= int(n + m - 2 * common) + 1
    i, j = i[near], j[near]
    if not len(j):
        return 0.0
    kept = chain(j)
    i, j = i[kept], j[kept]
    covered = SHINGLE + int(np.minimum(np.minimum(np.diff(i), np.diff(j)), SHINGLE).sum())
    return covered / (n + m - covered)


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, row, node (16 bytes of the words' digest), sketch, labels (binary, 32 bits each)."""
    d = numbered(docs)
    key, text = d[at(docs, id_col)], d[at(docs, text_col)]
    d = d.select(key.alias("key"), row_id(key, text).alias("row"), F.encode(blank_if_null(text), "UTF-8").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, i = batch["t"].tolist(), 0
            while i < len(texts):
                size, j = len(texts[i]), i + 1
                while j < len(texts) and j - i < 500 and size + len(texts[j]) < CHUNK:
                    size, j = size + len(texts[j]), j + 1
                part = texts[i:j]
                found = labels(part)
                yield pd.DataFrame({
                    "key": batch["key"].iloc[i:j].to_numpy(),
                    "row": batch["row"].iloc[i:j].to_numpy(),
                    "node": [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in part],
                    "sketch": [sketch(x) if len(x) else np.zeros(0, np.int64) for x in found],
                    "labels": [x.astype(np.uint32).tobytes() for x in found],
                })
                i = j

    return d.mapInPandas(run, f"key {d.schema['key'].dataType.simpleString()}, row string, node binary, sketch array<long>, labels binary")


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) >= least for x, y in zip(batch["x"], batch["y"])]
            yield batch.loc[good, ["a", "b"]]

    return pairs.select("a", "b", "x", "y").mapInPandas(run, "a binary, b binary")


def _compared(left: list, right: list | None, band: int, least: float) -> Iterator[tuple[bytes, bytes]]:
    """Links between members (node, root, sketch, labels) of one bucket: a spanning set of those between different roots.

    A pair is compared only in the first band that it shares."""
    above: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    others = left if right is None else right
    sketches = np.stack([m[2] for m in others])
    sizes = np.array([len(m[3]) for m in others])
    for i, (node, start, own, x) in enumerate(left):
        first = (sketches == own[None, :]).argmax(axis=1) == band
        fits = first & (np.minimum(words(sizes), words(len(x))) >= least * np.maximum(words(sizes), words(len(x))))
        for j in np.flatnonzero(fits).tolist():
            if right is None and j <= i:
                continue
            other = others[j]
            if root(start) != root(other[1]) and aligned(x, other[3], least) >= least:
                above[root(start)] = root(other[1])
                yield node, other[0]


def links(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b: verified links that join all documents which any bucket's links join, from profiles()."""
    one = rows.select("node", "sketch").where(F.size("sketch") > 0).dropDuplicates(["node"])
    members = one.select("node", F.posexplode("sketch").alias("band", "hash"))
    # Written, so that the join below reads two plain exchanges and a hot bucket's partition can be split.
    leaders = stage(members.groupBy("band", "hash").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1"), "leaders")
    buckets = stage(members.join(leaders, ["band", "hash"]).select("band", "hash", "leader", "node", "size"), "buckets")
    pairs = buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    asked = buckets.select("node").distinct()
    labelled = stage(rows.join(asked, "node", "left_semi").select("node", "labels", "sketch").dropDuplicates(["node"]), "labels")
    side = lambda n, x: labelled.select(F.col("node").alias(n), F.col("labels").alias(x))
    found = stage(_verified(pairs.join(side("b", "y"), "b").join(side("a", "x"), "a"), least), "links")
    roots = components(found)

    # Buckets whose members but for the leader, that all have met, lie in several components.
    at_root = buckets.where("node <> leader and size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at_root = stage(at_root.select("band", "hash", "node", "root"), "rooted")
    open_ = at_root.groupBy("band", "hash").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("others")).where("low <> high")
    blocks = F.ceil(F.col("others") / BLOCK).cast("int")
    left = at_root.join(open_, ["band", "hash"]).withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    # A member of block i goes to the tasks (i, j) and (j, i), smaller number first.
    spread = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "hash", "node", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
    spread = spread.join(labelled, "node")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        band, _, i, j = key
        group = group.sort_values("node")
        part = [[(n, r, s, np.frombuffer(x, np.uint32)) for n, r, s, x in zip(g["node"], g["root"], g["sketch"], g["labels"])] for g in (group[group["mine"] == i], group[group["mine"] == j])]
        if not part[0] or not part[1]:
            return pd.DataFrame({"a": [], "b": []})
        return pd.DataFrame(_compared(part[0], None if i == j else part[1], int(band), least), columns=["a", "b"])

    more = spread.groupBy("band", "hash", "i", "j").applyInPandas(compare, "a binary, b binary")
    return found.unionByName(stage(more, "links"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """key, row (128 bits of id and text), root (of the class), class_id (its smallest id) and class_size, a row per document.

    Documents with the same words are copies and meet as one; null texts and texts without
    words are copies of each other. A class is a connected component of links of similarity
    least or more; a similarity of exactly least is a link. Repeated rows each have their row.
    An empty table gives no rows. Labels are compared by 32 of their bits once documents
    share a sketch: two different ones of a pair are equal by chance once in four billion."""
    rows = stage(profiles(docs, id_col, text_col), "profiles")
    roots = components(links(rows, least))
    placed = rows.select("key", "row", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = stage(placed.groupBy("root").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size")), "names")
    return placed.join(names, "root").select("key", "row", "root", "class_id", "class_size")


def first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One document of each class, that of the smallest id, with all its columns."""
    found = stage(classes(docs, id_col, text_col, least), "classes")
    keep = found.groupBy("root").agg(F.min(F.struct("key", "row")).alias("k")).select(F.col("k.row").alias("k_row"))
    d = numbered(docs).withColumn("row", row_id(F.col(at(docs, id_col)), F.col(at(docs, text_col))))
    kept = d.join(keep, F.col("row") == F.col("k_row"), "left_semi")
    if not found.groupBy("row").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["row"])
    return kept.drop("row").toDF(*docs.columns)
