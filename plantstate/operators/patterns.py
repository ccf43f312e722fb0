"""Graph patterns as equi-joins over entities, attributes and triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.operators.state import live_filter


def _top(attributes: DataFrame, name: str, kind: Sequence[str]) -> DataFrame:
    return live_filter(attributes).where((F.col("name") == name) & F.col("parentId").isNull() & F.col("type").isin(*kind))


def match_property(bindings: DataFrame, attributes: DataFrame, name: str, var: str, s: str = "this", ts: str | None = None) -> DataFrame:
    """bindings with var: the value of a live top-level property of s; ts: also its time."""
    found = _top(attributes, name, (m.PROPERTY, m.JSON_PROPERTY, m.LIST_PROPERTY)).select(F.col("entityId").alias("_s"), F.col("attributeValue").alias(var), *([F.col("ts").alias(ts)] if ts else []))
    return bindings.join(found, bindings[s] == found["_s"]).drop("_s")


def match_observed_at(bindings: DataFrame, attributes: DataFrame, name: str, var: str, ts: str, s: str = "this") -> DataFrame:
    return match_property(bindings, attributes, name, var, s, ts)


def match_relationship_fwd(bindings: DataFrame, attributes: DataFrame, entities: DataFrame, name: str, var: str, s: str = "this") -> DataFrame:
    """Follow a relationship of s to a live entity."""
    links = _top(attributes, name, (m.RELATIONSHIP,)).select(F.col("entityId").alias("_s"), F.col("attributeValue").alias(var))
    there = live_filter(entities).select(F.col("id").alias("_t"))
    return bindings.join(links, bindings[s] == links["_s"]).drop("_s").join(there, F.col(var) == F.col("_t")).drop("_t")


def match_relationship_rev(bindings: DataFrame, attributes: DataFrame, entities: DataFrame, name: str, var: str, o: str = "this") -> DataFrame:
    """The live entities whose relationship points to o."""
    links = _top(attributes, name, (m.RELATIONSHIP,)).select(F.col("attributeValue").alias("_o"), F.col("entityId").alias(var))
    there = live_filter(entities).select(F.col("id").alias("_t"))
    return bindings.join(links, bindings[o] == links["_o"]).drop("_o").join(there, F.col(var) == F.col("_t")).drop("_t")


def match_type(bindings: DataFrame, entities: DataFrame, s: str = "this", cls: str | None = None, var: str | None = None) -> DataFrame:
    """Keep s of a class, or bind var to its class."""
    e = live_filter(entities)
    if cls is not None:
        return bindings.join(e.where(F.col("type") == cls).select(F.col("id").alias("_s")), F.col(s) == F.col("_s"), "left_semi")
    return bindings.join(e.select(F.col("id").alias("_s"), F.col("type").alias(var)), F.col(s) == F.col("_s")).drop("_s")


def match_triple(bindings: DataFrame | None, rdf: DataFrame, predicate: str, s: str, o: str) -> DataFrame:
    """Triples of a predicate; s and o are variables (joined if bound, else bound now) or fixed terms."""
    t = rdf.where(F.col("predicate") == predicate).select(F.col("subject").alias("_s"), F.col("object").alias("_o"))
    is_term = lambda x: x[:1] in '<"_'
    for side, x in (("_s", s), ("_o", o)):
        if is_term(x):
            t = t.where(F.col(side) == x).drop(side)
        else:
            t = t.withColumnRenamed(side, x)
    if bindings is None:
        return t
    keys = [c for c in t.columns if c in bindings.columns]
    if not keys:
        raise ValueError("the triple shares no variable with what is bound")
    return bindings.join(t, keys)


def match_triple_bnode(bindings: DataFrame | None, rdf: DataFrame, p1: str, p2: str, s: str, o: str) -> DataFrame:
    """s p1 [ p2 o ]: two hops through a blank node."""
    one = match_triple(None, rdf, p1, s, "bnode").where(F.col("bnode").startswith("_:"))
    two = match_triple(None, rdf, p2, "bnode", o)
    hops = one.join(two, "bnode").drop("bnode")
    keys = [c for c in hops.columns if bindings is not None and c in bindings.columns]
    return bindings.join(hops, keys) if keys else hops


def subclass_of_target(entities: DataFrame, closure: DataFrame, cls: str) -> DataFrame:
    """this: live entities whose type is cls or a subclass of it. closure: triples of closed subClassOf."""
    subs = closure.where((F.col("predicate") == m.SUBCLASS) & (F.col("object") == f"<{cls}>")).select(F.regexp_replace("subject", "^<(.*)>$", "$1").alias("type")).distinct()
    return live_filter(entities).join(subs.unionByName(subs.sparkSession.createDataFrame([(cls,)], "type string")).distinct(), "type", "left_semi").select(F.col("id").alias("this"), "type")


def bgp_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def optional_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def not_exists(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")
