"""Closures and searches over triples, by iterated joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantstate import model as m

_own_dir: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share: spark.checkpoint.dir; on one machine (tests) one of our own where it is unset."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dir


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure_pairs(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Transitive closure of edges (keys..., a, b): paths double each round, until none is new.

    Chains may have any length, and cycles end, as pairs are distinct and only new ones go on."""
    known = cut(edges.select(*keys, "a", "b").distinct())
    new = known
    while True:
        step = new.withColumnRenamed("b", "x").join(known.withColumnRenamed("a", "x"), [*keys, "x"]).select(*keys, "a", "b").distinct()
        new = cut(step.join(known, [*keys, "a", "b"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def transitive_closure(triples: DataFrame) -> DataFrame:
    """triples with the closure of subClassOf and of every property that is typed transitive."""
    # Written, as it is read for the properties, for the edges and for the result.
    t = cut(triples.select("subject", "predicate", "object"))
    named = t.where((F.col("predicate") == m.RDF_TYPE) & (F.col("object") == m.TRANSITIVE)).select(F.col("subject").alias("predicate"))
    which = named.unionByName(t.sparkSession.createDataFrame([(m.SUBCLASS,)], "predicate string")).distinct()
    edges = t.join(which, "predicate", "left_semi").select("predicate", F.col("subject").alias("a"), F.col("object").alias("b"))
    closed = closure_pairs(edges, ("predicate",)).select(F.col("a").alias("subject"), "predicate", F.col("b").alias("object"))
    return t.unionByName(closed).distinct()


def reflexive_classes(triples: DataFrame) -> DataFrame:
    """Every class is a subclass of itself."""
    t = triples.select("subject", "predicate", "object")
    edges = t.where(F.col("predicate") == m.SUBCLASS)
    classes = edges.select(F.col("subject").alias("c")).union(edges.select("object")).union(t.where((F.col("predicate") == m.RDF_TYPE) & (F.col("object") == m.CLASS)).select("subject")).distinct()
    return t.unionByName(classes.select(F.col("c").alias("subject"), F.lit(m.SUBCLASS).alias("predicate"), F.col("c").alias("object"))).distinct()


def bag_members(triples: DataFrame) -> DataFrame:
    """Container memberships rdf:_n also as rdfs:member."""
    t = triples.select("subject", "predicate", "object")
    numbered = t.where(F.col("predicate").rlike(r"^<http://www\.w3\.org/1999/02/22-rdf-syntax-ns#_\d+>$"))
    return t.unionByName(numbered.select("subject", F.lit(m.RDF_MEMBER).alias("predicate"), "object")).distinct()


def triples_index(triples: DataFrame) -> DataFrame:
    """Triples with an index from 0 per (subject, predicate), by object; literal subjects go."""
    from pyspark.sql import Window

    order = Window.partitionBy("subject", "predicate").orderBy("object")
    return triples.where(~F.col("subject").startswith('"')).select("subject", "predicate", "object").distinct().withColumn("index", F.row_number().over(order) - 1)


def is_subclass(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Those pairs (sub, super) that the closure of subClassOf holds."""
    c = closure.where(F.col("predicate") == m.SUBCLASS).select(F.col("subject").alias("sub"), F.col("object").alias("super"))
    return pairs.join(c.distinct(), ["sub", "super"], "left_semi")


def depths(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """node, ancestor, depth: the shortest way up edges (a below b) from each start (node; none given: from all), itself at 0.

    The ways from the starts double each round: what is within n steps, and what is up to n
    steps further, by the table of what lies n steps above each node. So only pairs of starts
    and their ancestors are built. Chains may have any length, and cycles end. Starts that the
    edges don't have go."""
    e = edges.select("a", "b").distinct()
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    jump = cut(e.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("up")))
    begin = nodes if starts is None else nodes.join(starts.select("node"), "node", "left_semi")
    known = cut(begin.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    reach = 1
    while True:
        step = known.join(jump, known["ancestor"] == jump["x"]).groupBy("node", F.col("up").alias("ancestor")).agg((F.min("depth") + reach).alias("depth"))
        new = cut(step.join(known, ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        jump = cut(jump.join(jump.select(F.col("x").alias("up"), F.col("up").alias("next")), "up").select("x", F.col("next").alias("up")).distinct())
        reach *= 2


def subclass_edges(triples: DataFrame, predicate: str = m.SUBCLASS) -> DataFrame:
    return triples.where((F.col("predicate") == predicate) & (F.col("subject") != F.col("object"))).select(F.col("subject").alias("a"), F.col("object").alias("b"))


def in_namespace(iris: Column, prefix: str) -> Column:
    """IRIs directly below a prefix: no further / or #."""
    return iris.startswith("<" + prefix) & ~F.substr(iris, F.lit(len(prefix) + 2)).rlike("[/#]")


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """start, node: all nodes that edges (a, b) reach from each start, the start included. Trees and chains are contracted first; then a round per step, however many."""
    return _reached(starts.select(F.col("start"), F.col("start").alias("node")), edges, ["start", "node"])


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """node: all nodes that edges (a, b) reach from any start, the starts included; each once, whoever reaches it."""
    return _reached(starts.select(F.col("start").alias("node")), edges, ["node"])


def _contracted(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(edges, node to head): a node that is no start and has one edge into it is reached just when the other end is.

    So it is one with that end, and with what that end is one with: whole trees and chains become
    their heads, by ways that double each round. Joined nodes share their edges, so more may have
    one edge into them: this goes on as long as it halves the edges. Edges inside a head go, and
    cycles that nothing enters."""
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    heads, n = None, edges.count()
    while n:
        into = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"), F.count("*").alias("n")).where("n = 1")
        way = cut(into.join(starts, "node", "left_anti").select("node", "to"))
        most, steps = way.count(), 1
        while steps <= most:
            on = way.select(F.col("node").alias("to"), F.col("to").alias("next"))
            far = cut(way.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on")))
            way, steps = far.select("node", "to"), 2 * steps
            if far.where("on").isEmpty():
                break
        # Ways that still lead on go round in a cycle that no start reaches.
        ends = cut(way.join(way.select(F.col("node").alias("to")), "to", "left_anti").select("node", F.col("to").alias("head")))
        if heads is None:
            heads = ends
        else:
            moved = heads.withColumnRenamed("head", "mid").join(ends.withColumnRenamed("node", "mid"), "mid", "left")
            heads = cut(moved.select("node", F.coalesce("head", "mid").alias("head")).unionByName(ends))
        at = edges.join(ends.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("head", "a").alias("a"), "b")
        at = at.join(ends.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("head", "b").alias("b"))
        edges = cut(at.where("a <> b").distinct())
        before, n = n, edges.count()
        if 2 * n > before:
            break
    return edges, heads


def _reached(front: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    known = front = cut(front.distinct())
    e, heads = _contracted(edges, front.select("node").distinct())
    i = 0
    while True:
        step = front.join(e, front["node"] == e["a"]).select(*columns[:-1], F.col("b").alias("node")).distinct()
        front = cut(step.join(known, columns, "left_anti"))
        if front.isEmpty():
            break
        i += 1
        # Written together now and then, so that the plan of a long search stays short.
        known = known.unionByName(front) if i % 8 else cut(known.unionByName(front))
    if heads is None:
        return known
    return known.unionByName(known.join(heads.select("head", F.col("node").alias("under")), F.col("node") == F.col("head")).select(*columns[:-1], F.col("under").alias("node")))


def reachable_subgraph(starts: DataFrame, triples: DataFrame) -> DataFrame:
    """The triples of each start and of the blank nodes below it."""
    through = triples.where(F.col("object").startswith("_:")).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return reachable(starts, through).join(triples, F.col("node") == F.col("subject")).select("start", "subject", "predicate", "object")


def subcomponent_closure(roots: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """root, id: the components below each root, through live relationships of some names."""
    links = attributes.where((F.col("type") == m.RELATIONSHIP) & F.col("name").isin(*names) & ~F.coalesce("deleted", F.lit(False)))
    found = reachable(roots.select(F.col("root").alias("start")), links.select(F.col("entityId").alias("a"), F.col("attributeValue").alias("b")))
    return found.select(F.col("start").alias("root"), F.col("node").alias("id"))


def rdf_list_to_array(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """head, items: the list that starts at each head, in order; the end and missing heads give an empty list.

    Steps double each round, so a list of n items takes log n rounds. Lists with a cycle raise an
    error. An item that is itself a list stays its head; give such heads to read it."""
    first = triples.where(F.col("predicate") == m.RDF_FIRST).select(F.col("subject").alias("node"), F.col("object").alias("item"))
    rest = triples.where((F.col("predicate") == m.RDF_REST) & (F.col("object") != m.RDF_NIL)).select(F.col("subject").alias("node"), F.col("object").alias("next"))
    jump = cut(rest)
    longest, step = jump.count(), 1
    parts = cut(heads.select("head", F.col("head").alias("node"), F.lit(0).cast("long").alias("i")))
    while True:
        # parts has the places below step; jump leads step places ahead.
        ahead = cut(parts.join(jump, "node").select("head", F.col("next").alias("node"), (F.col("i") + step).alias("i")))
        if ahead.isEmpty():
            break
        if step > longest:
            raise ValueError("a list has a cycle")
        parts = parts.unionByName(ahead)
        jump = cut(jump.join(jump.select(F.col("node").alias("next"), F.col("next").alias("to")), "next").select("node", F.col("to").alias("next")))
        step *= 2
    items = parts.join(first, "node").groupBy("head").agg(F.sort_array(F.collect_list(F.struct("i", "item"))).alias("p"))
    return heads.select("head").join(items, "head", "left").select("head", F.coalesce(F.transform("p", lambda x: x["item"]), F.array().cast("array<string>")).alias("items"))


def retype_nodes(triples: DataFrame, instance_of: str = "<instanceOf>") -> DataFrame:
    """rdf:type to a class that another class specialises or that is a type node becomes instanceOf."""
    types = triples.where(F.col("predicate") == m.SUBCLASS).select(F.col("subject").alias("object")).distinct()
    typed = triples.where(F.col("predicate") == m.RDF_TYPE).select("subject", "predicate", "object")
    to = typed.join(types, "object", "left_semi").select("subject", F.lit(instance_of).alias("predicate"), "object")
    return triples.where(F.col("predicate") != m.RDF_TYPE).select("subject", "predicate", "object").unionByName(typed.join(types, "object", "left_anti").select("subject", "predicate", "object")).unionByName(to)
