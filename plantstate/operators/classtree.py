"""Class trees: interval labels, so that "is below" is a comparison of numbers and no table of all pairs is built.

Every node of a class graph has one tree edge, to the first of its parents by name. Numbering the
tree from the top, a node before what is below it, gives each node a range (lo, hi) that holds just
the nodes below it. The edges that are left over (of nodes with several parents, or closing a
cycle) lead from a range into others. Labels of an empty graph are empty; repeated edges, edges
of a node to itself and those with a null end don't count."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.operators.graph import cut, depths, in_namespace, subclass_edges
from plantstate.operators.segments import running

#: Blocks of 2^k numbers that a range or a number may lie in: k runs to this.
LEVELS = 40


class Labels(NamedTuple):
    nodes: DataFrame
    """node, lo, hi: the nodes below it, itself included, are those whose lo lies in lo to hi."""
    extra: DataFrame
    """up, lo, hi: an edge that the tree has not. up is the number of its upper end, lo to hi the range of its lower one."""


def _jumps(parents: DataFrame, nodes: int) -> tuple[list[DataFrame], bool]:
    """Tables (node, to, low) of the ways of 1, 2, 4, .. steps up, while there are any; low is the first name on the way.

    True if ways longer than the number of nodes are left: those go round in a cycle."""
    tables = [cut(parents.where("parent is not null").select("node", F.col("parent").alias("to"), F.col("node").alias("low")))]
    while not tables[-1].isEmpty():
        if 2 ** (len(tables) - 1) > nodes:
            return tables, True
        near = tables[-1]
        far = near.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("low").alias("low2"))
        tables.append(cut(near.join(far, "to").select("node", F.col("next").alias("to"), F.least("low", "low2").alias("low"))))
    return tables[:-1], False


def labels(edges: DataFrame) -> Labels:
    """Labels of the graph of edges (a below b), in rounds that grow with the logarithm of its depth.

    Ways up double each round. Sizes of what is below, and the sums of the sizes of earlier
    siblings along the way up, add up over these ways; siblings are summed in ranges, so a
    class with most of the nodes directly below it is spread over tasks. A cycle is cut below
    its first node by name; the edge cut is an extra one."""
    e = cut(edges.where("a <> b").select("a", "b").distinct())
    first = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
    tops = e.select(F.col("b").alias("node")).distinct().join(first, "node", "left_anti")
    parents = cut(first.unionByName(tops.withColumn("parent", F.lit(None).cast("string"))))
    jumps, cyclic = _jumps(parents, parents.count())
    if cyclic:
        last = jumps[-1]
        # After so many steps all are on a cycle and have seen the whole of it.
        heads = last.join(last.select(F.col("to").alias("node")).distinct(), "node", "left_semi").where("node = low").select("node", F.lit(True).alias("head"))
        parents = cut(parents.join(heads, "node", "left").select("node", F.when(F.col("head").isNull(), F.col("parent")).alias("parent")))
        jumps, _ = _jumps(parents, parents.count())
    size = parents.select("node", F.lit(1).cast("long").alias("size"))
    for jump in jumps:
        more = jump.join(size, "node").groupBy(F.col("to").alias("node")).agg(F.sum("size").alias("more"))
        size = cut(size.join(more, "node", "left").select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    order = running(parents.join(size, "node"), ["parent"], ["node"], "size", "earlier")
    way = order.select("node", "size", (F.col("earlier") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("lo"))
    for jump in jumps:
        up = jump.select("node", "to").join(way.select(F.col("node").alias("to"), F.col("lo").alias("more")), "to").select("node", "more")
        way = cut(way.join(up, "node", "left").select("node", "size", (F.col("lo") + F.coalesce("more", F.lit(0))).alias("lo")))
    nodes = cut(way.select("node", "lo", (F.col("lo") + F.col("size") - 1).alias("hi")))
    left = e.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("b")), ["a", "b"], "left_anti")
    upper, lower = nodes.select(F.col("node").alias("b"), F.col("lo").alias("up")), nodes.withColumnRenamed("node", "a")
    extra = cut(left.join(upper, "b").join(lower, "a").select("up", "lo", "hi"))
    return Labels(nodes, extra)


def _blocks(lo: Column, hi: Column) -> Column:
    """The fewest blocks (k, number) of 2^k numbers that make up a range, at most two of a size."""

    def of(k: Column) -> Column:
        width = F.pow(F.lit(2.0), k).cast("long")
        left, right = F.floor((lo + width - 1) / width), F.floor((hi + 1) / width)
        block = lambda when, n: F.when((left < right) & when, F.struct(k.alias("k"), n.cast("long").alias("n")))
        return F.array_compact(F.array(block(left % 2 == 1, left), block(right % 2 == 1, right - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of))


def inside(points: DataFrame, at: str, ranges: DataFrame) -> DataFrame:
    """Each row of points with each row of ranges (lo, hi, ..) that holds its number.

    A join by equal blocks, which can be split and hashed, in place of one by comparisons. Only
    sizes of blocks that some range is made of are looked up."""
    cover = ranges.withColumn("_b", F.explode(_blocks(F.col("lo"), F.col("hi")))).withColumns({"_k": F.col("_b.k"), "_n": F.col("_b.n")}).drop("_b")
    # At most LEVELS + 1 numbers, in one row.
    sizes = cover.agg(F.collect_set("_k").alias("_sizes"))
    spread = points.join(F.broadcast(sizes)).withColumn("_k", F.explode("_sizes")).drop("_sizes")
    spread = spread.withColumn("_n", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("_k"))).cast("long"))
    return spread.join(cover, ["_k", "_n"]).drop("_k", "_n")


def ranges_below(bases: DataFrame, known: Labels) -> DataFrame:
    """base, lo, hi: the ranges of all that is below each base (base), itself included. One range for a base in a tree.

    Each round follows the extra edges that end in a range found: as many rounds as such edges
    follow each other, and one for a tree. Bases that aren't in the graph have no range."""
    found = front = cut(bases.select("base").distinct().join(known.nodes.withColumnRenamed("node", "base"), "base").select("base", "lo", "hi"))
    if known.extra.isEmpty():
        return found
    extra = known.extra.select("up", F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi")).distinct()
    while True:
        step = inside(extra, "up", front).where(~F.col("x_lo").between(F.col("lo"), F.col("hi")))
        step = step.select("base", F.col("x_lo").alias("lo"), F.col("x_hi").alias("hi")).distinct()
        front = cut(step.join(found, ["base", "lo"], "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def below(bases: DataFrame, known: Labels) -> DataFrame:
    """base, node: the nodes below each base, and the base itself whether the graph has it or not."""
    nodes = inside(known.nodes.select("node", F.col("lo").alias("at")), "at", ranges_below(bases, known)).select("base", "node")
    return nodes.unionByName(bases.select("base", F.col("base").alias("node"))).distinct()


def are_below(pairs: DataFrame, known: Labels) -> DataFrame:
    """Those pairs (sub, super) of which sub is super or below it: its number lies in a range of super."""
    p = pairs.select("sub", "super").distinct()
    ranges = ranges_below(p.select(F.col("super").alias("base")), known).withColumnRenamed("base", "super")
    at = known.nodes.select(F.col("node").alias("sub"), F.col("lo").alias("at"))
    hit = p.join(at, "sub").join(ranges, "super").where(F.col("at").between(F.col("lo"), F.col("hi"))).select("sub", "super")
    return hit.unionByName(p.where("sub = super")).distinct()


def _one(df: DataFrame, base: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(base,)], "base string")


def below_one(triples: DataFrame, base: str, predicate: str = m.SUBCLASS) -> DataFrame:
    """node: base and all that is below it by one predicate."""
    return below(_one(triples, base), labels(subclass_edges(triples, predicate))).select("node")


def supertype_chain(types: DataFrame, triples: DataFrame) -> DataFrame:
    """type, ancestor, depth for the types asked for that the tree has, by depth (0 is the type). Others have no rows built."""
    return depths(subclass_edges(triples), types.select(F.col("type").alias("node"))).withColumnRenamed("node", "type")


def common_supertype(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """x, y, super, steps: the common ancestor with the smallest sum of depths; of equals the first by name."""
    asked = pairs.select("x", "y").distinct()
    d = cut(supertype_chain(asked.select(F.col("x").alias("type")).union(asked.select("y")), triples))
    up = lambda side: d.select(F.col("type").alias(side), F.col("ancestor").alias("super"), F.col("depth").alias(f"d_{side}"))
    both = asked.join(up("x"), "x").join(up("y"), ["y", "super"])
    best = both.groupBy("x", "y").agg(F.min(F.struct((F.col("d_x") + F.col("d_y")).alias("steps"), "super")).alias("b"))
    return best.select("x", "y", "b.super", "b.steps")


def types_in_namespace(triples: DataFrame, base: str, prefix: str) -> DataFrame:
    """iri: the types below base, itself included if the tree has it, whose IRI is directly below the prefix."""
    known = labels(subclass_edges(triples))
    # The prefix goes first, as it leaves few nodes to look up.
    named = known.nodes.where(in_namespace(F.col("node"), prefix)).select("node", F.col("lo").alias("at"))
    return inside(named, "at", ranges_below(_one(triples, base), known)).select(F.col("node").alias("iri")).distinct()


def objects_in_namespace(triples: DataFrame, base: str, prefix: str) -> DataFrame:
    """Individuals of base or a subclass of it whose IRI is directly below the prefix."""
    typed = triples.where((F.col("predicate") == m.RDF_TYPE) & in_namespace(F.col("subject"), prefix))
    return typed.join(below_one(triples, base).withColumnRenamed("node", "object"), "object", "left_semi").select(F.col("subject").alias("iri")).distinct()


def sub_references(edges: DataFrame, triples: DataFrame, predicate: str) -> DataFrame:
    """Those triples whose predicate is the given one or a sub-property of it."""
    return edges.join(below_one(triples, predicate, m.SUBPROPERTY).withColumnRenamed("node", "predicate"), "predicate", "left_semi")


def subclass_extract(triples: DataFrame, base: str) -> DataFrame:
    """The subclass edges of all types below a type; those of the type itself go."""
    under = below_one(triples, base).where(F.col("node") != base).withColumnRenamed("node", "a")
    edges = subclass_edges(triples).join(under, "a", "left_semi")
    return edges.select(F.col("a").alias("subject"), F.lit(m.SUBCLASS).alias("predicate"), F.col("b").alias("object"))


def contract_consistency(contracts: DataFrame, triples: DataFrame) -> DataFrame:
    """type, path, x, y: classes of one type's path (x before y) of which neither is below the other. contracts: type, path, cls.

    Pairs that the tree itself relates go by one comparison of their ranges; only the others are
    looked up over extra edges. A class that the tree has not is related to none but itself."""
    known = labels(subclass_edges(triples))
    n = known.nodes.withColumnRenamed("node", "cls")
    rows = cut(contracts.select("type", "path", "cls").distinct().join(n, "cls", "left"))
    side = lambda c: rows.select("type", "path", F.col("cls").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi"))
    nested = F.col("x_lo").between(F.col("y_lo"), F.col("y_hi")) | F.col("y_lo").between(F.col("x_lo"), F.col("x_hi"))
    apart = side("x").join(side("y"), ["type", "path"]).where(F.col("x") < F.col("y")).where(~F.coalesce(nested, F.lit(False))).select("type", "path", "x", "y")
    if known.extra.isEmpty():
        return apart
    pairs = cut(apart.select("x", "y").distinct())
    up = pairs.select(F.col("x").alias("sub"), F.col("y").alias("super"))
    down = pairs.select(F.col("y").alias("sub"), F.col("x").alias("super"))
    hit = cut(are_below(up.unionByName(down), known))
    related = hit.select(F.least("sub", "super").alias("x"), F.greatest("sub", "super").alias("y")).distinct()
    return apart.join(related, ["x", "y"], "left_anti").select("type", "path", "x", "y")
