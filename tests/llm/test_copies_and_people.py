"""Near-duplicates and surrogates against plain Python."""

import random
import re
import time
from collections import Counter

import numpy as np

from plantstate.llm import graphs, omh, pii

SCHEMA = "doc_id long, text string, lang string, Root string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    s = [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []
    seen, out = Counter(), []
    for x in s:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def similarity(a, b):
    """Words that the longest common subsequence of labelled shingles covers, over the words of either."""
    a, b = shingles(a), shingles(b)
    if not a or not b:
        return float(a == b)
    at = {x: i for i, x in enumerate(b)}
    pairs = [(i, at[x]) for i, x in enumerate(a) if x in at]
    if not pairs:
        return 0.0
    # The best chain up to each pair: its length, and the words it covers.
    best = []
    for n, (i, j) in enumerate(pairs):
        if n and j > pairs[n - 1][1] and best[n - 1][0] == max(x[0] for x in best):
            before = [n - 1]
        else:
            before = [k for k in range(n) if pairs[k][1] < j]
        best.append(max(((best[k][0] + 1, best[k][1] + min(5, i - pairs[k][0], j - pairs[k][1])) for k in before), default=(1, 5)))
    common = max(best)[1]
    return common / (len(a) + len(b) + 8 - common)


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    out = [None, "", "  ", "one", "one", "two words", " two  words ", "a b c d e", "x " * 400, "x " * 401, "x " * 250]
    for _ in range(30):
        base = [word() for _ in range(rng.randint(30, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append("\n".join(copy))
    return out


def test_labels_match_plain_shingles():
    t = texts()
    got = omh.labels([(x or "").encode() for x in t])
    ids = {}
    for x, label in zip(t, got):
        want = shingles(x)
        assert len(label) == len(want) and len(set(label.tolist())) == len(label)
        for s, h in zip(want, label.tolist()):
            assert ids.setdefault(s, h) == h
    assert len(set(ids.values())) == len(ids)


def test_alignment():
    t = [x for x in texts() if shingles(x)][:60]
    arrays = [x.astype(np.uint32) for x in omh.labels([x.encode() for x in t])]
    for i in range(0, len(t), 3):
        for j in range(len(t)):
            want = similarity(t[i], t[j])
            got = omh.aligned(arrays[i], arrays[j])
            assert abs(got - want) < 1e-9 if want >= 0.8 else got < 0.8


def brute(t):
    keys = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for x in t]
    parent = list(range(len(t)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(t)):
        for j in range(i):
            if root(i) != root(j) and (keys[i] == keys[j] or (keys[i] and keys[j] and similarity(t[i], t[j]) >= 0.8)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(t))]


def test_classes_are_all_links(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, "en", "r") for i, x in enumerate(t)], SCHEMA)
    got = {r.key: r.class_id for r in omh.classes(df).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)
    first = omh.first_of_class(df)
    assert first.columns == df.columns
    assert sorted(r.doc_id for r in first.collect()) == sorted(set(brute(t)))
    twice = df.unionByName(df.where("doc_id < 20"))
    assert sorted(r.doc_id for r in omh.first_of_class(twice).collect()) == sorted(set(brute(t)))
    assert omh.classes(df.limit(0)).count() == 0


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    """Copies that differ from their leader by more than the limit, but not from each other."""
    monkeypatch.setattr(omh, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    t = []
    for g in range(4):
        own = list(base)
        for k in rng.sample(range(120), 14):
            own[k] = f"g{g}x{k}"
        for c in range(6):
            copy = list(own)
            copy[rng.randrange(120)] = f"c{g}{c}"
            t.append(" ".join(copy))
    df = spark.createDataFrame([(i, x, "en", "r") for i, x in enumerate(t)], SCHEMA)
    got = {r.key: r.class_id for r in omh.classes(df).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)


def test_copies_with_every_twentieth_word_changed_are_found(spark):
    rng = random.Random(12)
    common = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = []
    for i in range(300):
        base = [rng.choice(common) for _ in range(rng.randint(60, 400))]
        start = rng.randrange(20)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join("zz" + w if k % 20 == start else w for k, w in enumerate(base)))]
    df = spark.createDataFrame([(i, x, "en", "r") for i, x in rows], SCHEMA)
    got = {r.key: r.class_id for r in omh.classes(df).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(300)) >= 0.9 * 300
    assert all(got[i] // 2 == i // 2 for i in got)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(150)] + [(900, i) for i in range(901, 1000)] + [(5, 5)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


PEOPLE = [
    None, "", "Mail 19@mail5.example.com or Bob.Smith@Mail.Example.org; again bob.smith@mail.example.ORG.", "Call +1 (743) 555-3824 or +1 743 555 3824, +33 1 23 45 67 89.",
    "Card 4916 5786 2252 5678 and 4916578622525678, 4539 1488 0343 6467 at 152.143.123.131", "Mrs. Anna Schmidt met Mr Jones and Frau Weber; Anna Schmidt left. SCHMIDT's car.",
    "Госпожа Анна Иванова и Господин Петров; Иванова", "Version 1.2.3.4.5 and 12345 and token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "DE89 3704 0044 0532 0130 00 paid, GB82WEST12345698765432", "nothing here, Not Even Names",
    "Mail 19@mail5.example.com", "+49 301 234 5678 is +493012345678", "Dr. O'Brien-Smith and John McDonald (McDonald); Mr Smith, Mr John Smith", "ssn 123-45-6789", "Mrs. Anna Schmidt met Mr Jones and Frau Weber; Anna Schmidt left. SCHMIDT's car.",
]


def brute_hits(text):
    """Entities of a text with the same patterns, by the regex module and plain loops."""
    import regex

    word = lambda p: p.replace("++", "+").replace("*+", "*").replace("}+", "}")
    titles = "|".join(sorted(pii.TITLES, key=len, reverse=True))
    names = {}
    for m in regex.finditer(word(pii.PERSON), text):
        parts = [w for w in regex.sub(rf"^(?:(?:{titles})\.? )+", "", m[0]).split(" ") if not w.endswith(".")]
        female = regex.match(rf"(?:(?:{titles})\.? )*(?:{'|'.join(pii.FEMALE_TITLES)})\b", m[0]) or parts[0] in pii.FEMALE_NAMES
        if len(parts) > 1:
            names.setdefault(parts[0].lower(), set()).add("given_f" if female else "given_m")
        names.setdefault(parts[-1].lower(), set()).add("surname")
    out = []
    for m in regex.finditer(pii.NUMERIC + (f"|(?:{word(pii.CAPITAL)})" if names else ""), text):
        kind = next((k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, m[0])), None) or min(names.get(m[0].lower(), [None]))
        if kind:
            out.append((kind, m.start(), m[0]))
    return out


def normal(kind, value):
    if kind in ("email", *pii.NAMES):
        return value.lower()
    return re.sub(r"[^A-Z0-9+]" if kind in ("iban", "phone") else r"[^0-9.]", "", value)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + (i % 2 == len(digits) % 2)), 10)) for i, d in enumerate(digits)) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_surrogates(spark):
    df = spark.createDataFrame([(i, x, "en", "r") for i, x in enumerate(PEOPLE)], SCHEMA)
    got = {r.key: r for r in pii.replaced(df, "k").collect()}
    again = {r.key: r.text for r in pii.replaced(df.repartition(3), "k").collect()}
    other = {r.key: r.text for r in pii.replaced(df, "other").collect()}
    assert {k: r.text for k, r in got.items()} == again and other[2] != again[2]
    made = {}
    for k, text in enumerate(PEOPLE):
        hits = brute_hits(text or "")
        assert [(f.kind, f.start, f.value) for f in got[k].found] == hits and got[k].n_entities == len(hits)
        # The text is that of the surrogates put in place; one entity has one of them in all its spellings.
        out, end = "", 0
        for f in got[k].found:
            out, end = out + (text[end : f.start] + f.surrogate), f.start + len(f.value)
            assert made.setdefault((f.kind, normal(f.kind, f.value)), normal(f.kind, f.surrogate)) == normal(f.kind, f.surrogate)
        assert got[k].text == (None if text is None else out + text[end:])
    assert len(set(made.values())) == len(made) and not {(k, v) for (k, _), v in made.items()} & set(made)
    shape = lambda s: re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", s)))
    for r in got.values():
        for f in r.found:
            if f.kind not in ("ip", *pii.NAMES):
                assert shape(f.value) == shape(f.surrogate)
            if f.kind == "iban":
                assert mod97(normal("iban", f.surrogate)) == 1 and f.surrogate[:2] == f.value[:2]
            if f.kind == "card" and luhn(normal("card", f.value)):
                assert luhn(normal("card", f.surrogate))
            if f.kind in pii.NAMES:
                assert bool(re.search("[а-я]", f.value)) == bool(re.search("[а-я]", f.surrogate)) and f.value.isupper() == f.surrogate.isupper()
            if f.kind in ("given_f", "given_m"):
                assert f.surrogate[-1] in ("aа" if f.kind == "given_f" else "oв")
    assert got[3].found[0].surrogate.startswith("+1 (") and got[3].found[2].surrogate.startswith("+33 ") and got[11].found[1].surrogate.startswith("+49")
    assert got[5].text.startswith("Mrs. ") and got[10].found[0].surrogate == got[2].found[0].surrogate and got[14].text == got[5].text
    assert pii.replaced(df.limit(0), "k").count() == 0


def test_surrogates_of_long_texts(spark):
    """Texts that are one entity, or made of what looks like the start of one."""
    long = ["a@" + "b." * 100_000 + "com", "a@" + "b." * 100_000 + "1", "a@b" * 100_000, "1 " * 100_000, "+1" + " 2" * 100_000, "AB12" + "C3D4" * 50_000, "Mr Smith " + "Smith Ab " * 1000]
    df = spark.createDataFrame([(i, x, "en", "r") for i, x in enumerate(long)], SCHEMA)
    started = time.time()
    got = {r.key: r for r in pii.replaced(df, "k").collect()}
    assert time.time() - started < 60
    assert [got[i].n_entities for i in range(7)] == [1, 0, 0, 0, 0, 0, 1001] and len(got[0].text) == len(long[0])


def test_collisions_are_drawn_again(spark):
    """Three-letter domains of two-letter names leave so few surrogates that many collide."""
    letters = "abcdefgh"
    mails = [f"{a}@{b}.io" for a in letters for b in letters]
    df = spark.createDataFrame([(i, f"write {m} now", "en", "r") for i, m in enumerate(mails)], SCHEMA)
    got = pii.replaced(df, "k").collect()
    made = [r.found[0].surrogate for r in got]
    assert len(set(made)) == len(mails) and not set(made) & set(mails)


def test_no_surrogate_is_an_entity_of_another_kind(spark):
    first = pii.replaced(spark.createDataFrame([(0, "Mrs. Anna Nowak and Peter Falk met.", "en", "r")], SCHEMA), "k").first()
    given = next(f.surrogate for f in first.found if f.kind == "given_f")
    df = spark.createDataFrame([(0, "Mrs. Anna Nowak and Peter Falk met.", "en", "r"), (1, f"Mr. {given} called.", "en", "r"), (2, f"Mrs. {given} Nowak", "en", "r")], SCHEMA)
    got = pii.replaced(df, "k").collect()
    entities = {f.value.lower() for r in got for f in r.found}
    made = {}
    for r in got:
        for f in r.found:
            assert made.setdefault((f.kind, f.value), f.surrogate) == f.surrogate and f.surrogate.lower() not in entities
    assert len(set(made.values())) == len(made)


def test_many_mentions_of_few_persons(spark):
    long = "Mr. Ab " + "Ab " * 50_000
    started = time.time()
    got = pii.replaced(spark.createDataFrame([(0, long, "en", "r")], SCHEMA), "k").first()
    assert got.n_entities == 50_001 and time.time() - started < 60
