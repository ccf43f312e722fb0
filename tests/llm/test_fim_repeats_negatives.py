"""Fill-in-middle, repeated passages and hard negatives against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from plantstate.llm import fim, negatives, repeats


def test_skip_list_finds_every_rank():
    rng = np.random.RandomState(1)
    for n in (0, 1, 15, 16, 17, 300, 5000):
        widths = rng.randint(1, 9, n)
        got = fim.SkipList(widths).points_before(np.arange(n + 1))
        assert got.tolist() == [0, *np.cumsum(widths).tolist()]
    lanes = fim.SkipList(np.ones(5000, np.int64)).lanes
    assert [len(x.units) for x in lanes] == [5000, 313, 20, 2] and all(x.units.sum() == x.points.sum() == 5000 for x in lanes)


def test_fill_in_middle(spark, monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 200)
    rng = random.Random(5)
    texts = [None, "", "a", "word", "é", "😀 two\n\nlines é😀b", "holds <P> a mark", "<M>", "x<S", "<<P", "a1b2<", "ab" * 3000 + " 9" * 2000, "İKK"]
    texts += ["".join(rng.choice("ab <PSM>\né\U0001f600") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id at all", "x"), (7, texts[7], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEY string")
    got = fim.transformed(df).collect()
    assert len(got) == len(rows)
    want = Counter()
    for key, text, _ in rows:
        t = text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
            want[key, len(units), "plain", None, None, t, t] += 1
        elif h[3] % 100 < 20:
            want[key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t] += 1
        else:
            want[key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t] += 1
    assert Counter(tuple(r) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(df.limit(0)).count() == 0


def plain_repeats(texts, length):
    """(words, removed, kept) of each text, by all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("length, seed", [(35, 12), (6, 3), (5, 5), (4, 1)])
def test_repeats_are_those_of_all_windows(spark, length, seed):
    rng = random.Random(length)
    word = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(n))
    passages = [word(length + rng.randint(-2, 12)) for _ in range(6)]
    texts = [None, "", "  ", "a", "x " * (3 * length), "x " * (length - 1), "u v " * length]
    for _ in range(120):
        parts = [word(rng.randint(0, 2 * length)) if rng.random() < 0.6 else rng.choice(passages)[rng.choice([0, 0, 3]) :] for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(parts))
    texts += [texts[20], texts[20].replace(" ", "\n"), texts[21] + " more words", passages[0], passages[0], word(40 * length)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(30, texts[30], "en"), (None, texts[31], "en")]
    want = plain_repeats([t for _, t, _ in rows], length)
    df = spark.createDataFrame(rows, "doc_id long, text string, X string")
    got = repeats.without_repeats(df, length=length, seed=seed).collect()
    found = Counter((r.key, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert found == Counter((k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (k, _, _), (n, gone, kept) in zip(rows, want))
    for r in got:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed
        assert all(b - a >= length for a, b in zip(r.spans[::2], r.spans[1::2])) and r.spans == sorted(set(r.spans))
        assert (r.kept is None) == (r.n_removed == 0)
    assert sum(gone for _, gone, _ in want) > 0 and any(0 < gone < n for n, gone, _ in want)
    assert repeats.without_repeats(df.limit(0), length=length, seed=seed).count() == 0


def test_seeds_cover_all_windows_and_depend_on_words_only():
    rng = random.Random(2)
    text = [rng.choice("abcd") for _ in range(400)]
    texts = [" ".join(text), "q r s " + " ".join(text[100:300]) + " z", "short"]
    w = repeats.Words([t.encode() for t in texts])
    start, last, anchor = repeats.seeds(w, 20, 6)
    covered = [i for a, b in zip(start, last) for i in range(a, b + 1)]
    assert covered == np.flatnonzero(w.place + 20 <= w.count[w.owner]).tolist()
    of = {i: h for a, b, h in zip(start.tolist(), last.tolist(), anchor.tolist()) for i in range(a, b + 1)}
    second = int(w.first[1])
    assert all(of[100 + i] == of[second + 3 + i] for i in range(180))


def plain_negatives(rows, every, positives, negatives_, least, most, scale):
    vectors = []
    for uid, (i, v, label) in enumerate(rows):
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.append((i, uid, label, [int(np.floor(float(np.float32(x)) * scale)) for x in v]))
    out = []
    for i, uid, label, v in vectors:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, u, lab) for j, u, lab, w in vectors if u != uid)
        for p, j, _, _ in [s for s in scored if s[3] == label][:positives]:
            fits = [(n, s) for n, s, _, lab in scored if lab != label and least * -p <= -100 * n <= most * -p][:negatives_]
            out += [(i, j, k + 1, s, -p, -n) for k, (n, s) in enumerate(fits)]
    return Counter(out)


@pytest.mark.parametrize("big", [1.0, 3e5])
def test_hard_negatives_are_those_of_a_full_scan(spark, big):
    rng = np.random.RandomState(8)
    centers = rng.normal(size=(5, 8))
    rows = []
    for i in range(700):
        v = centers[i % 5] + rng.normal(size=8) * rng.choice([0.05, 0.6])
        rows.append((i, [float(x) * (big if i % 9 == 0 else 1) for x in np.round(v, 1)][: 8 - (i % 11 == 0)], int(rng.randint(3))))
    rows += [(20, None, 1), (40, [1.0] * 8, None), (None, [1.0] * 8, 1), (60, [1.0, None], 1), (80, [float("nan")] * 8, 2), (100, [float("inf")] * 8, 0), (120, [], 1), (140, [0.0] * 8, 2), (20, rows[20][1], 1), rows[33], (160, [1.0] * 8, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain_negatives(rows, 20, 5, 10, 30, 90, 256)
    got = negatives.mined(df.withColumn("CLUSTER", df.label), every=20, anchor_block=16, row_block=200).collect()
    assert Counter(tuple(r) for r in got) == want
    assert len(want) > 500
    assert negatives.mined(df.limit(0)).count() == 0


def test_walks_end_before_the_list_does(monkeypatch):
    rng = np.random.RandomState(3)
    centers = np.eye(8) * 4000
    v = np.rint(np.concatenate([c + rng.normal(size=(2000, 8)) * 60 for c in centers])).astype(np.int64)
    q = v[:20]
    uid, label = np.arange(len(v)), np.zeros(len(v), np.int64)
    asked = []
    bound = negatives.bounds(q, v)
    assert (bound[None, :] * np.sqrt((q * q).sum(axis=1))[:, None] + 1 >= q @ v.T).all()
    original = np.rint
    monkeypatch.setattr(negatives.np, "rint", lambda x: asked.append(x.shape[1]) or original(x))
    low, high = np.full((20, 1), -(1 << 40)), np.full((20, 1), 1 << 40)
    best = negatives.walk(q, uid[:20], label[:20], True, low, high, 5, (uid, label, v))
    scores = q @ v.T
    for i in range(20):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-scores[i, j], j))[:5]
        assert [(len(v) - 1 - k % len(v)) for k in best[i, 0].tolist()] == order
    assert sum(asked) < len(v) / 4
