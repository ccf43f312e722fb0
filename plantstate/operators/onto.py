"""Ontology rows: nodes and references to triples, contracts, instances and consistency checks.

nodes: node, kind, browse, datatype, rank, dims. refs: node, type, forward, target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.functions.terms import map_datatype
from plantstate.operators import classtree, graph
from plantstate.sources import buckets

IGNORED = ("HasSubtype", "HasTypeDefinition")
TYPE_KINDS = ("UAObjectType", "UAVariableType", "UADataType", "UAReferenceType")


def triple(df: DataFrame, s: Column | str, p: Column | str, o: Column) -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(col(s).alias("subject"), col(p).alias("predicate"), o.alias("object"))


def by_size(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """df, dealt by keys into as many parts as the files of source need: a task's rows do not grow with them."""
    return df.repartition(buckets.tasks(source), *keys)


def nodes_to_triples(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Class, browse name and data type of each node; data types go through the alias table (alias, iri) where it has them."""
    n = F.col("node")
    named = nodes.where(F.col("datatype").isNotNull()).join(aliases.withColumnRenamed("alias", "datatype"), "datatype", "left")
    return reduce(DataFrame.unionByName, [
        triple(nodes, n, m.RDF_TYPE, F.concat(F.lit("<opcua:"), "kind", F.lit(">"))),
        triple(nodes.where(F.col("browse").isNotNull()), n, "<hasBrowseName>", F.concat(F.lit('"'), "browse", F.lit('"'))),
        triple(named, n, "<hasDatatype>", F.coalesce("iri", F.concat(F.lit("<opcua:"), "datatype", F.lit(">")))),
    ])


def references_to_triples(refs: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """One triple per reference, turned round where it isn't forward."""
    r = refs.where(~F.col("type").isin(*ignored))
    s, o = F.when(F.col("forward"), F.col("node")).otherwise(F.col("target")), F.when(F.col("forward"), F.col("target")).otherwise(F.col("node"))
    return by_size(triple(r, s, F.concat(F.lit("<opcua:"), "type", F.lit(">")), o), refs, "subject", "object").distinct()


def type_definition(refs: DataFrame) -> DataFrame:
    return triple(refs.where((F.col("type") == "HasTypeDefinition") & F.col("forward")), F.col("node"), m.RDF_TYPE, F.col("target"))


def type_hierarchy(nodes: DataFrame, refs: DataFrame, roots: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(triples, errors): subclass edges (sub-property edges of reference types), and type nodes without a supertype."""
    h = refs.where(F.col("type") == "HasSubtype").select(F.when(F.col("forward"), F.col("target")).otherwise(F.col("node")).alias("sub"), F.when(F.col("forward"), F.col("node")).otherwise(F.col("target")).alias("sup")).distinct()
    types = nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("node", "kind")
    j = types.join(h, F.col("node") == F.col("sub"))
    edges = triple(j, F.col("sub"), F.when(F.col("kind") == "UAReferenceType", m.SUBPROPERTY).otherwise(m.SUBCLASS), F.col("sup"))
    defined = triple(types, F.col("node"), "<definesType>", F.col("node"))
    errors = types.join(h.select(F.col("sub").alias("node")), "node", "left_anti").where(~F.col("node").isin(*roots)) if roots else types.join(h.select(F.col("sub").alias("node")), "node", "left_anti")
    return edges.unionByName(defined), errors.select("node")


def semantic_bridge(triples: DataFrame, aggregates: tuple[str, ...] = ("<opcua:HasComponent>", "<opcua:HasProperty>")) -> DataFrame:
    """For aggregate references one more edge, named after the target's browse name."""
    names = triples.where(F.col("predicate") == "<hasBrowseName>").select(F.col("subject").alias("object"), F.regexp_replace("object", '^"|"$', "").alias("name"))
    links = by_size(triples.where(F.col("predicate").isin(*aggregates)), triples, "object")
    return links.join(by_size(names, triples, "object"), "object").select("subject", F.concat(F.lit("<has_"), F.regexp_replace("name", r"\s+", "_"), F.lit(">")).alias("predicate"), "object").distinct()


def enum_and_field_triples(fields: DataFrame) -> DataFrame:
    """fields (node, name, value, datatype): values are individuals with a numeric value node, others structure fields."""
    is_enum = F.col("value").isNotNull()
    individual = F.concat(F.regexp_replace("node", ">$", ""), F.lit("/"), "name", F.lit(">"))
    enum, field = fields.where(is_enum), fields.where(~is_enum)
    value_node = F.concat(F.lit("_:v"), F.substring(F.md5(F.concat_ws("/", "node", "name")), 1, 12))
    return reduce(DataFrame.unionByName, [
        triple(enum, individual, m.RDF_TYPE, F.col("node")),
        triple(enum, individual, "<hasEnumValue>", value_node),
        triple(enum, value_node, "<hasValue>", F.col("value").cast("string")),
        triple(field, F.col("node"), "<hasField>", individual),
        triple(field, individual, "<hasDatatype>", F.concat(F.lit("<opcua:"), "datatype", F.lit(">"))),
    ])


def node_details_to_triples(nodes: DataFrame) -> DataFrame:
    """Value rank, dimensions and access flags (bits of access) of each node that has them."""
    flag = lambda bit: F.col("access").bitwiseAND(1 << bit) != 0
    text = lambda c: c.cast("string")
    made = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in (("<hasValueRank>", text(F.col("rank"))), ("<hasArrayDimensions>", F.array_join(F.transform("dims", lambda x: x.cast("string")), ",")), ("<isReadable>", text(flag(0))), ("<isWritable>", text(flag(1))))])
    return nodes.select("node", F.explode(made).alias("x")).where(F.col("x.o").isNotNull()).select(F.col("node").alias("subject"), F.col("x.p").alias("predicate"), F.col("x.o").alias("object"))


def inherited_value(own: Column, template: Column, type_: Column) -> Column:
    return F.coalesce(own, template, type_, F.lit(-1))


def modelling_rule(members: DataFrame, rules: DataFrame) -> DataFrame:
    """members (.., rule) with optional, placeholder and known flags from rules (rule, optional, placeholder)."""
    return members.join(rules, "rule", "left").withColumn("known", F.col("optional").isNotNull()).withColumns({"optional": F.coalesce("optional", F.lit(False)), "placeholder": F.coalesce("placeholder", F.lit(False))})


def type_contracts(types: DataFrame, members: DataFrame, triples: DataFrame) -> DataFrame:
    """Constraint rows of each type: its members, own and inherited over the ordered supertypes.

    members: owner, path, target, kind, datatype, rank, optional, placeholder, known. The most
    special definition of a path wins; members without a modelling rule are skipped."""
    chain = classtree.supertype_chain(types, triples)
    rows = chain.join(members.where("known"), chain["ancestor"] == members["owner"])
    first = Window.partitionBy("type", "path").orderBy("depth", "owner", "target")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    is_object = F.col("kind") == "UAObject"
    value = F.when(F.col("rank") >= 0, "@list").when(F.get(map_datatype(F.col("datatype")), F.lit(0)) == "json", "@json").otherwise("@value")
    return rows.select(
        F.col("type").alias("targetClass"), F.col("path").alias("propertyPath"), F.when(is_object, F.col("target")).alias("propertyClass"), F.when(is_object, "@id").otherwise(value).alias("propertyNodetype"), F.when(is_object, m.RELATIONSHIP).when(value == "@list", m.LIST_PROPERTY).when(value == "@json", m.JSON_PROPERTY).otherwise(m.PROPERTY).alias("attributeType"),
        F.when(F.col("optional"), "0").otherwise("1").alias("minCount"), F.when(~F.col("placeholder"), "1").alias("maxCount"), F.when(~is_object & (value == "@value"), F.array_join(map_datatype(F.col("datatype")), ",")).alias("datatypes"), "depth",
    )


def instances_to_attributes(root: DataFrame, refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, attributes) of all that forward references reach from the roots (start): objects are
    entities and relationships, variables typed attributes."""
    edges = refs.where(F.col("forward") & ~F.col("type").isin(*IGNORED))
    found = graph.reached(root, edges.select(F.col("node").alias("a"), F.col("target").alias("b")))
    here = nodes.join(found, "node", "left_semi")
    entities = here.where("kind = 'UAObject'").select(F.col("node").alias("id"), F.col("browse").alias("type"))
    ends = here.select(F.col("node").alias("target"), "kind", "browse", "datatype")
    links = by_size(by_size(edges, refs, "node").join(by_size(found, refs, "node"), "node", "left_semi"), refs, "target").join(by_size(ends, refs, "target"), "target")
    is_object = F.col("kind") == "UAObject"
    attributes = links.select(F.concat_ws("\\", "node", "browse", "target").alias("id"), F.col("node").alias("entityId"), F.col("browse").alias("name"), F.when(is_object, "@id").otherwise("@value").alias("nodeType"), F.when(is_object, m.RELATIONSHIP).otherwise(m.PROPERTY).alias("type"), F.when(is_object, F.col("target")).otherwise(F.get(map_datatype(F.col("datatype")), F.lit(0))).alias("attributeValue"), F.col("target").alias("datasetId"))
    return entities, by_size(attributes, refs, "id").distinct()


def binding_extract(triples: DataFrame) -> DataFrame:
    """binding, entity, attribute, parameter (null if there is none) from <bindsEntity>, <bindsAttribute> and optional <hasParameter> triples."""
    of = lambda p, name: triples.where(F.col("predicate") == p).select(F.col("subject").alias("binding"), F.col("object").alias(name))
    return of("<bindsEntity>", "entity").join(of("<bindsAttribute>", "attribute"), "binding").join(of("<hasParameter>", "parameter"), "binding", "left")


def machines_and_types(triples: DataFrame, folder: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(machine, type) below a folder, and the types in a namespace that some node has."""
    typed = triples.where(F.col("predicate") == m.RDF_TYPE).select(F.col("subject").alias("machine"), F.col("object").alias("type")).where(~F.col("type").startswith("<opcua:UA"))
    listed = triples.where((F.col("subject") == folder) & (F.col("predicate") == "<opcua:Organizes>")).select(F.col("object").alias("machine"))
    return typed.join(listed, "machine", "left_semi"), typed.where(F.col("type").startswith("<" + prefix)).select("type").distinct()


def target_nodes_extract(triples: DataFrame, given: DataFrame) -> DataFrame:
    """Triples of all nodes that share a type, other than a node class, with the given nodes (node)."""
    typed = triples.where((F.col("predicate") == m.RDF_TYPE) & ~F.col("object").startswith("<opcua:UA")).select(F.col("subject").alias("node"), F.col("object").alias("type"))
    types = typed.join(given, "node", "left_semi").select("type").distinct()
    same = typed.join(types, "type", "left_semi").select(F.col("node").alias("subject")).distinct()
    return triples.join(same, "subject", "left_semi").select("subject", "predicate", "object")


def violation_context(report: DataFrame, parents: DataFrame, names: DataFrame) -> DataFrame:
    """report (focus, ..) with entity and path: up the parents (child, parent, step) until a named node (node).

    However deep that is; a way up does not come to one node twice."""
    out = None
    front = report.select("focus", F.col("focus").alias("node"), F.array().cast("array<string>").alias("path"), F.array("focus").alias("seen")).distinct()
    named = names.select("node").distinct()
    while True:
        front = graph.cut(front)
        if out is not None and front.isEmpty():
            break
        done = front.join(named, "node", "left_semi")
        out = done if out is None else out.unionByName(done)
        front = front.join(named, "node", "left_anti").join(parents, front["node"] == parents["child"]).where(~F.array_contains("seen", F.col("parent")))
        front = front.select("focus", F.col("parent").alias("node"), F.concat(F.array("step"), "path").alias("path"), F.concat("seen", F.array("parent")).alias("seen"))
    context = out.select("focus", F.col("node").alias("entity"), F.array_join("path", "/").alias("path"))
    return report.join(context, "focus", "left")


def violation_report(*violations: DataFrame) -> DataFrame:
    """focus, severity, message of all checks, and how often each occurs."""
    rows = reduce(DataFrame.unionByName, [v.select("focus", "severity", "message") for v in violations])
    return rows.groupBy("focus", "severity", "message").agg(F.count("*").alias("n"))


def _violation(df: DataFrame, focus: str, message: str, severity: str = "violation") -> DataFrame:
    return df.select(F.col(focus).alias("focus"), F.lit(severity).alias("severity"), F.lit(message).alias("message")).distinct()


def onto_value_rank(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """nodes (node, type, rank, dims) against types (type, type_rank): compatible ranks, one dimension per rank."""
    j = nodes.join(types, "type", "left")
    rank, own = F.col("rank"), F.col("type_rank")
    allowed = F.when(own == -2, True).when(own == -3, rank.isin(-3, -1, 1)).when(own == 0, rank >= 0).otherwise(rank == own)
    return reduce(DataFrame.unionByName, [
        _violation(j.where(~F.coalesce(allowed, F.lit(True))), "node", "rank does not fit the type's"),
        _violation(j.where((rank > 0) & (F.coalesce(F.size("dims"), F.lit(0)) > 0) & (F.size("dims") != rank)), "node", "dimensions do not fit the rank"),
        _violation(j.where((rank > 0) & F.col("dims").isNull()), "node", "rank without dimensions", "warning"),
        _violation(j.where(rank < -3), "node", "rank below -3"),
    ])


def onto_edges(edges: DataFrame, nodes: DataFrame, name: str, sources: tuple[str, ...], targets: tuple[str, ...]) -> DataFrame:
    """Edges of a reference type whose ends are not of the kinds allowed."""
    e = edges.where((F.col("type") == name) & F.col("forward"))
    kinds = lambda c, k: nodes.select(F.col("node").alias(c), F.col("kind").alias(k))
    j = e.join(kinds("node", "k1"), "node").join(kinds("target", "k2"), "target")
    return _violation(j.where(~F.col("k2").isin(*targets)), "target", f"{name} target of a wrong kind").unionByName(_violation(j.where(~F.col("k1").isin(*sources)), "node", f"{name} source of a wrong kind"))


def onto_has_component(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return onto_edges(edges, nodes, "HasComponent", ("UAObject", "UAObjectType", "UAVariable", "UAVariableType"), ("UAObject", "UAVariable", "UAMethod"))


def onto_has_property(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Property targets are variables, and a property has no properties."""
    kinds = nodes.select(F.col("node").alias("target"), "kind")
    props = edges.where((F.col("type") == "HasProperty") & F.col("forward"))
    nested = props.join(props.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
    return _violation(props.join(kinds, "target").where("kind <> 'UAVariable'"), "target", "HasProperty target of a wrong kind").unionByName(_violation(nested, "node", "property with properties"))


def at_most_one(rows: DataFrame, focus: str, value: str, allowed: tuple, message: str) -> DataFrame:
    """Values must be of a list, and at most one per node."""
    many = rows.groupBy(focus).agg(F.count_distinct(value).alias("n")).where("n > 1")
    return _violation(rows.where(~F.col(value).isin(*allowed)), focus, f"{message} not allowed").unionByName(_violation(many, focus, f"more than one {message}"))


def onto_modelling_rule(rows: DataFrame) -> DataFrame:
    return at_most_one(rows, "node", "rule", ("Mandatory", "Optional", "MandatoryPlaceholder", "OptionalPlaceholder"), "modelling rule")


def onto_historizing(rows: DataFrame) -> DataFrame:
    """rows: node, kind, historizing (text). Booleans only, at most one, on variables only."""
    return at_most_one(rows, "node", "historizing", ("true", "false"), "historizing").unionByName(_violation(rows.where(~F.col("kind").isin("UAVariable", "UAVariableType")), "node", "historizing of a node that is no variable"))
