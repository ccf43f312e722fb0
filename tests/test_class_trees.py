"""Class trees and searches against plain loops."""

import random

from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.operators import classtree, graph, segments


def below_of(edges):
    """node -> all that is below it, itself included."""
    nodes = {x for e in edges for x in e}
    down = {n: {a for a, b in edges if b == n} for n in nodes}
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for x in down[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[n] = seen
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "a string, b string")


def some(seed, nodes, edges, cycles):
    r = random.Random(seed)
    out = []
    for _ in range(edges):
        a, b = r.sample(range(nodes), 2)
        out.append((f"n{a}", f"n{b}") if cycles or a > b else (f"n{b}", f"n{a}"))
    return out


def check(spark, edges):
    want = below_of([e for e in edges if None not in e])
    known = classtree.labels(frame(spark, edges))
    names = spark.createDataFrame([(n,) for n in [*want, "not there"]], "base string")
    got = {}
    for r in classtree.below(names, known).collect():
        assert r.node not in got.setdefault(r.base, set())
        got[r.base].add(r.node)
    assert got == {**want, "not there": {"not there"}}
    lo = sorted(r.lo for r in known.nodes.collect())
    assert lo == list(range(len(want)))
    return known, want


def test_labels_of_trees_graphs_and_cycles(spark):
    check(spark, [(f"n{i}", f"n{(i - 1) // 3}") for i in range(1, 60)])
    check(spark, some(1, 40, 70, False) + [("n1", "n1"), ("n1", None), (None, "n1")])
    check(spark, some(2, 25, 40, True))
    check(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y"), ("y", "x")])


def test_tests_of_pairs(spark):
    known, want = check(spark, some(3, 25, 35, False))
    pairs = [(a, b) for a in want for b in want] + [("q", "q"), ("q", "n1")]
    got = {tuple(r) for r in classtree.are_below(spark.createDataFrame(pairs, "sub string, super string"), known).collect()}
    assert got == {(a, b) for b in want for a in want[b]} | {("q", "q")}


def test_empty_graphs(spark):
    known = classtree.labels(frame(spark, []))
    assert known.nodes.count() == known.extra.count() == 0
    assert [r.node for r in classtree.below(spark.createDataFrame([("x",)], "base string"), known).collect()] == ["x"]
    assert graph.reached(spark.createDataFrame([("x",)], "start string"), frame(spark, [])).count() == 1
    assert graph.depths(frame(spark, [])).count() == 0


def test_ranges_are_blocks(spark):
    rows = [(0, 0), (0, 7), (3, 12), (5, 5), (1, 1 << 35)]
    got = spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", classtree._blocks(F.col("lo"), F.col("hi")).alias("b")).collect()
    for r in got:
        parts = sorted((x.n << x.k, (x.n + 1 << x.k) - 1) for x in r.b)
        assert parts[0][0] == r.lo and parts[-1][1] == r.hi and all(p[1] + 1 == q[0] for p, q in zip(parts, parts[1:]))


def test_classes_of_a_path(spark):
    edges = some(5, 20, 26, False)
    want = below_of(edges)
    triples = spark.createDataFrame([(a, m.SUBCLASS, b) for a, b in edges], "subject string, predicate string, object string")
    r = random.Random(6)
    rows = [(f"t{r.randrange(3)}", f"p{r.randrange(3)}", r.choice([*want, "none"])) for _ in range(80)]
    got = [tuple(x) for x in classtree.contract_consistency(spark.createDataFrame(rows, "type string, path string, cls string"), triples).collect()]
    own = lambda c: want.get(c, {c})
    plain = {(t, p, x, y) for t, p, x in rows for t2, p2, y in rows if (t, p) == (t2, p2) and x < y and x not in own(y) and y not in own(x)}
    assert len(got) == len(set(got)) and set(got) == plain


def test_nearest_common_supertypes(spark):
    edges = some(7, 20, 30, True)
    want = below_of(edges)
    d = {(x.node, x.ancestor): x.depth for x in graph.depths(frame(spark, edges)).collect()}
    assert set(d) == {(a, b) for b in want for a in want[b]}
    chosen = frame(spark, edges).select(F.col("a").alias("node")).where("node like 'n1%'").distinct()
    few = {(x.node, x.ancestor): x.depth for x in graph.depths(frame(spark, edges), chosen).collect()}
    names = {x.node for x in chosen.collect()}
    assert few == {k: v for k, v in d.items() if k[0] in names}
    triples = spark.createDataFrame([(a, m.SUBCLASS, b) for a, b in edges], "subject string, predicate string, object string")
    pairs = [(a, b) for a in want for b in want if a < b][:60]
    got = {(x.x, x.y): (x.steps, x.super) for x in classtree.common_supertype(spark.createDataFrame(pairs, "x string, y string"), triples).collect()}
    plain = {(a, b): min(((d[a, s] + d[b, s], s) for s in want if (a, s) in d and (b, s) in d), default=None) for a, b in pairs}
    assert got == {k: v for k, v in plain.items() if v}


def test_searches_equal_plain_ones(spark):
    for seed in (11, 12):
        edges = some(seed, 30, 38, True) + [("n1", "n2"), ("n1", "n2"), ("n3", "n3")]
        want = below_of([(b, a) for a, b in edges])
        starts = ["n1", "n2", "n7", "none"]
        s = spark.createDataFrame([(x,) for x in [*starts, "n1"]], "start string")
        got = [tuple(r) for r in graph.reachable(s, frame(spark, edges)).collect()]
        plain = {(x, y) for x in starts for y in want.get(x, {x})}
        assert len(got) == len(set(got)) and set(got) == plain
        assert sorted(r.node for r in graph.reached(s, frame(spark, edges)).collect()) == sorted({y for _, y in plain})


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    edges = spark.range(n).select(F.concat(F.lit("n"), "id").alias("a"), F.concat(F.lit("n"), F.col("id") + 1).alias("b"))
    rounds = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or real(df))
    start = spark.createDataFrame([("n0",), ("n9000",)], "start string")
    assert graph.reached(start, edges).count() == n + 1
    # Two searches: doubling of 9000 steps, and what is left of the chain, an edge from start to start.
    assert len(rounds) <= 24
    assert graph.reachable(start, edges).count() == n + 1 + 1001


def test_running_sums_of_a_key_over_many_ranges(spark):
    rows = [("a", i, i % 7) for i in range(500)] + [(None, i, 1) for i in range(40)] + [("b", 3, 5)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.before for r in segments.running(df, ["k"], ["o"], "v", "before", 6).collect()}
    assert got == {(k, o): sum(v2 for k2, o2, v2 in rows if k2 == k and o2 < o) for k, o, _ in rows}
    whole = segments.running(df, [], ["o", "k"], None, "n", 6)
    assert sorted(r.n for r in whole.collect()) == list(range(len(rows)))
