"""Queries of closures, ontology operators and catalogues, on triples that Spark derives from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.operators import catalog, classtree, graph, onto
from plantstate.plans import base_sql as b
from plantstate.plans.registry import query
from plantstate.sources import adapter, buckets
from plantstate.sources.adapter import table

G = b.GRAPH
SUB = m.SUBCLASS


def rdf(spark: SparkSession, d: str) -> DataFrame:
    return adapter.rdf(spark, d).select("subject", "predicate", "object")


@query("transitive_closure", G + "SELECT * FROM closure")
def transitive_closure(spark, d):
    return graph.transitive_closure(rdf(spark, d))


@query("reflexive_classes", G + f"SELECT subject, predicate, object FROM rdf UNION SELECT c, '{SUB}', c FROM (SELECT subject AS c FROM rdf WHERE predicate = '{SUB}' UNION SELECT object FROM rdf WHERE predicate = '{SUB}')")
def reflexive_classes(spark, d):
    return graph.reflexive_classes(rdf(spark, d))


_BAG = "SELECT '<bag/' || o_custkey || '>' AS subject, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#_' || (o_orderkey % 5) || '>' AS predicate, '<o/' || o_orderkey || '>' AS object FROM orders"


@query("bag_members", f"WITH x AS ({_BAG}) SELECT * FROM x UNION SELECT subject, '{m.RDF_MEMBER}', object FROM x")
def bag_members(spark, d):
    o = table(spark, d, "orders")
    t = o.select(F.concat(F.lit("<bag/"), F.col("o_custkey").cast("string"), F.lit(">")).alias("subject"), F.concat(F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#_"), (F.col("o_orderkey") % 5).cast("string"), F.lit(">")).alias("predicate"), F.concat(F.lit("<o/"), F.col("o_orderkey").cast("string"), F.lit(">")).alias("object"))
    return graph.bag_members(t)


@query("triples_index", G + "SELECT DISTINCT subject, predicate, object, (dense_rank() OVER (PARTITION BY subject, predicate ORDER BY object) - 1)::INTEGER AS index FROM closure WHERE subject NOT LIKE '\"%'")
def triples_index(spark, d):
    return graph.triples_index(graph.transitive_closure(rdf(spark, d)))


@query("is_subclass", b.with_model(b.ENTITIES, b.RDF, b.CLOSURE) + f"SELECT DISTINCT '<' || type || '>' AS sub, '<Thing>' AS super FROM entities WHERE '<' || type || '>' IN (SELECT subject FROM closure WHERE predicate = '{SUB}' AND object = '<Thing>')")
def is_subclass(spark, d):
    pairs = adapter.entities(spark, d).select(F.concat(F.lit("<"), "type", F.lit(">")).alias("sub"), F.lit("<Thing>").alias("super")).distinct()
    return classtree.are_below(pairs, classtree.labels(graph.subclass_edges(rdf(spark, d)))).select("sub", "super")


_UP = f"""up AS (SELECT DISTINCT x AS node, x AS ancestor, 0 AS depth FROM (SELECT subject AS x FROM rdf WHERE predicate = '{SUB}' UNION SELECT object FROM rdf WHERE predicate = '{SUB}')
  UNION SELECT u.node, r.object, u.depth + 1 FROM up u JOIN rdf r ON r.predicate = '{SUB}' AND r.subject = u.ancestor)"""


@query("supertype_chain", G + f", {_UP} SELECT node AS type, ancestor, depth FROM up WHERE node LIKE '<Part/%' OR node LIKE '<Customer/%'")
def supertype_chain(spark, d):
    t = rdf(spark, d)
    types = t.where((F.col("predicate") == SUB) & F.col("subject").rlike("^<(Part|Customer)/")).select(F.col("subject").alias("type"))
    return classtree.supertype_chain(types, t)


@query("common_supertype", G + f", {_UP} SELECT a.node AS x, b.node AS y, arg_min(a.ancestor, (a.depth + b.depth, a.ancestor)) AS super, min(a.depth + b.depth) AS steps FROM up a JOIN up b ON a.ancestor = b.ancestor WHERE a.node LIKE '<Part/%' AND b.node LIKE '<%' AND a.node < b.node GROUP BY a.node, b.node")
def common_supertype(spark, d):
    t = rdf(spark, d)
    known = classtree.labels(graph.subclass_edges(t))
    # Pairs with an ancestor in common: the part types, and all below what is above them.
    above = graph.cut(classtree.supertype_chain(known.nodes.where("node LIKE '<Part/%'").select(F.col("node").alias("type")), t))
    under = classtree.below(above.select(F.col("ancestor").alias("base")), known)
    pairs = above.join(under, F.col("ancestor") == F.col("base")).where("type < node").select(F.col("type").alias("x"), F.col("node").alias("y")).distinct()
    return classtree.common_supertype(pairs, t)


@query("types_in_namespace", G + f", {_UP} SELECT DISTINCT node AS iri FROM up WHERE ancestor = '<Item>' AND regexp_matches(node, '^<Part/[^/#]*$')")
def types_in_namespace(spark, d):
    return classtree.types_in_namespace(rdf(spark, d), "<Item>", "Part/")


def things(spark: SparkSession, d: str) -> DataFrame:
    """Triples of the class tree and a type for each part."""
    p = table(spark, d, "part")
    typed = p.select(F.concat(F.lit("<n/"), F.col("p_partkey").cast("string"), F.lit(">")).alias("subject"), F.lit(m.RDF_TYPE).alias("predicate"), F.concat(F.lit("<Part/"), "p_type", F.lit(">")).alias("object"))
    return rdf(spark, d).unionByName(typed)


@query("objects_in_namespace", "SELECT '<n/' || p_partkey || '>' AS iri FROM part")
def objects_in_namespace(spark, d):
    return classtree.objects_in_namespace(things(spark, d), "<Item>", "n/")


@query("retype_nodes", "SELECT count(*) AS n FROM part")
def retype_nodes(spark, d):
    return graph.retype_nodes(things(spark, d)).where("predicate = '<instanceOf>'").agg(F.count("*").alias("n"))


_BNODES = "SELECT '<o/' || o_orderkey || '>' AS subject, '<has>' AS predicate, '_:c' || o_custkey AS object FROM orders UNION SELECT '_:c' || c_custkey, '<in>', '_:n' || c_nationkey FROM customer UNION SELECT '_:n' || n_nationkey, '<name>', '\"' || n_name || '\"' FROM nation"


@query("reachable_subgraph", f"WITH t AS ({_BNODES}) SELECT a.subject AS start, x.subject, x.predicate, x.object FROM t a, LATERAL (SELECT a.subject, a.predicate, a.object UNION ALL SELECT b.subject, b.predicate, b.object FROM t b WHERE b.subject = a.object UNION ALL SELECT c.subject, c.predicate, c.object FROM t b JOIN t c ON c.subject = b.object WHERE b.subject = a.object) x WHERE a.predicate = '<has>'")
def reachable_subgraph(spark, d):
    text = lambda p, c, s="": F.concat(F.lit(p), F.col(c).cast("string"), F.lit(s))
    o = table(spark, d, "orders").select(text("<o/", "o_orderkey", ">").alias("subject"), F.lit("<has>").alias("predicate"), text("_:c", "o_custkey").alias("object"))
    c = table(spark, d, "customer").select(text("_:c", "c_custkey").alias("subject"), F.lit("<in>").alias("predicate"), text("_:n", "c_nationkey").alias("object"))
    n = table(spark, d, "nation").select(text("_:n", "n_nationkey").alias("subject"), F.lit("<name>").alias("predicate"), text('"', "n_name", '"').alias("object"))
    t = graph.cut(o.unionByName(c).unionByName(n))
    return graph.reachable_subgraph(o.select(F.col("subject").alias("start")), t)


@query("subcomponent_closure", b.STATE + "SELECT 'urn:order:' || o_orderkey AS root, x AS id FROM orders, LATERAL (SELECT 'urn:order:' || o_orderkey AS x UNION ALL SELECT 'urn:customer:' || o_custkey UNION ALL SELECT 'urn:nation:' || c_nationkey FROM customer WHERE c_custkey = o_custkey) t")
def subcomponent_closure(spark, d):
    roots = table(spark, d, "orders").select(F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string")).alias("root"))
    return graph.subcomponent_closure(roots, adapter.attributes(spark, d), ["placedBy", "livesIn"])


@query("sub_references", "SELECT DISTINCT 's' || l_suppkey AS node, '<r/' || l_returnflag || '>' AS predicate, 'p' || l_partkey AS target FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def sub_references(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node"), F.concat(F.lit("<r/"), "l_returnflag", F.lit(">")).alias("predicate"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")).distinct()
    t = spark.createDataFrame([("<r/A>", m.SUBPROPERTY, "<r/R>"), ("<r/N>", m.SUBPROPERTY, "<r/X>")], "subject string, predicate string, object string")
    return classtree.sub_references(edges, t, "<r/R>").select("node", "predicate", "target")


@query("rdf_list_to_array", "SELECT user_id AS head, string_agg(event_type, '|' ORDER BY ts, event_id) AS items FROM events GROUP BY user_id")
def rdf_list_to_array(spark, d):
    """The events of each user, as lists of first and rest triples."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("n", n)
    cell = lambda i: F.concat_ws("/", F.col("user_id").cast("string"), i.cast("string"))
    first = e.select(cell(F.col("n")).alias("subject"), F.lit(m.RDF_FIRST).alias("predicate"), F.col("event_type").alias("object"))
    last = F.lead("n").over(Window.partitionBy("user_id").orderBy("n")).isNull()
    rest = e.select(cell(F.col("n")).alias("subject"), F.lit(m.RDF_REST).alias("predicate"), F.when(last, m.RDF_NIL).otherwise(cell(F.col("n") + 1)).alias("object"))
    heads = e.where("n = 1").select(cell(F.col("n")).alias("head"))
    items = graph.rdf_list_to_array(graph.cut(first.unionByName(rest)), heads)
    return items.select(F.split("head", "/")[0].cast("long").alias("head"), F.array_join("items", "|").alias("items"))


# Ontology rows: suppliers are objects, parts variables, part types variable types


def nodes(spark: SparkSession, d: str) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    make = lambda df, prefix, key, kind, browse, datatype, rank, dims: df.select(F.concat(F.lit(f"<{prefix}/"), F.col(key).cast("string"), F.lit(">")).alias("node"), F.lit(kind).alias("kind"), browse.alias("browse"), datatype.alias("datatype"), rank.cast("int").alias("rank"), dims.alias("dims"))
    p = table(spark, d, "part")
    datatype = F.element_at(F.array(F.lit("Double"), F.lit("Int32"), F.lit("MyType")), (F.col("p_partkey") % 3 + 1).cast("int"))
    parts = make(p, "p", "p_partkey", "UAVariable", F.col("p_name"), datatype, F.col("p_partkey") % 4 - 1, F.when(F.col("p_partkey") % 4 == 2, F.array(F.lit(2))).when(F.col("p_partkey") % 4 == 3, F.array(F.lit(2))))
    suppliers = make(table(spark, d, "supplier"), "s", "s_suppkey", "UAObject", F.col("s_name"), null("string"), null("int"), null("array<int>"))
    types = make(p.select("p_type").distinct(), "t", "p_type", "UAVariableType", F.col("p_type"), F.lit("Double"), F.lit(-1), null("array<int>"))
    base = make(spark.createDataFrame([("Base",)], "x string"), "t", "x", "UAVariableType", F.col("x"), F.lit("Double"), F.lit(-2), null("array<int>"))
    return reduce(DataFrame.unionByName, [parts, suppliers, types, base])


def refs(spark: SparkSession, d: str) -> DataFrame:
    n = lambda prefix, c: F.concat(F.lit(f"<{prefix}/"), F.col(c).cast("string"), F.lit(">"))
    make = lambda df, a, type_, forward, z: df.select(a.alias("node"), F.lit(type_).alias("type"), F.lit(forward).alias("forward"), z.alias("target"))
    # Dealt by size: a task's pairs do not grow with the table.
    lines, p = table(spark, d, "lineitem"), table(spark, d, "part")
    lines = lines.select("l_suppkey", "l_partkey").repartition(buckets.tasks(lines), "l_suppkey", "l_partkey").distinct()
    return reduce(DataFrame.unionByName, [
        make(lines.where("l_partkey % 2 = 0"), n("s", "l_suppkey"), "HasComponent", True, n("p", "l_partkey")),
        make(lines.where("l_partkey % 2 = 1"), n("p", "l_partkey"), "HasComponent", False, n("s", "l_suppkey")),
        make(p, n("p", "p_partkey"), "HasTypeDefinition", True, n("t", "p_type")),
        make(p.select("p_type").distinct(), n("t", "p_type"), "HasSubtype", False, F.lit("<t/Base>")),
    ])


_NODES = """nodes AS (SELECT '<p/' || p_partkey || '>' AS node, 'UAVariable' AS kind, p_name AS browse, (['Double', 'Int32', 'MyType'])[p_partkey % 3 + 1] AS datatype, (p_partkey % 4 - 1)::INTEGER AS rank, CASE WHEN p_partkey % 4 >= 2 THEN '2' END AS dims FROM part
  UNION ALL SELECT '<s/' || s_suppkey || '>', 'UAObject', s_name, NULL, NULL, NULL FROM supplier UNION ALL SELECT DISTINCT '<t/' || p_type || '>', 'UAVariableType', p_type, 'Double', -1, NULL FROM part UNION ALL SELECT '<t/Base>', 'UAVariableType', 'Base', 'Double', -2, NULL)"""
_LINKS = "links AS (SELECT DISTINCT '<s/' || l_suppkey || '>' AS s, '<p/' || l_partkey || '>' AS p FROM lineitem)"


@query("nodes_to_triples", f"WITH {_NODES} SELECT node AS subject, '{m.RDF_TYPE}' AS predicate, '<opcua:' || kind || '>' AS object FROM nodes UNION ALL SELECT node, '<hasBrowseName>', '\"' || browse || '\"' FROM nodes UNION ALL SELECT node, '<hasDatatype>', CASE WHEN datatype = 'MyType' THEN '<urn:mine>' ELSE '<opcua:' || datatype || '>' END FROM nodes WHERE datatype IS NOT NULL")
def nodes_to_triples(spark, d):
    return onto.nodes_to_triples(nodes(spark, d), spark.createDataFrame([("MyType", "<urn:mine>")], "alias string, iri string"))


@query("references_to_triples", f"WITH {_LINKS} SELECT s AS subject, '<opcua:HasComponent>' AS predicate, p AS object FROM links")
def references_to_triples(spark, d):
    return onto.references_to_triples(refs(spark, d))


@query("type_definition", f"SELECT '<p/' || p_partkey || '>' AS subject, '{m.RDF_TYPE}' AS predicate, '<t/' || p_type || '>' AS object FROM part")
def type_definition(spark, d):
    return onto.type_definition(refs(spark, d))


@query("type_hierarchy", f"WITH t AS (SELECT DISTINCT '<t/' || p_type || '>' AS x FROM part) SELECT x AS subject, '{SUB}' AS predicate, '<t/Base>' AS object FROM t UNION ALL SELECT x, '<definesType>', x FROM t UNION ALL SELECT '<t/Base>', '<definesType>', '<t/Base>' UNION ALL SELECT '<t/Base>', 'error', 'no supertype'")
def type_hierarchy(spark, d):
    triples, errors = onto.type_hierarchy(nodes(spark, d), refs(spark, d))
    return triples.unionByName(onto.triple(errors, F.col("node"), "error", F.lit("no supertype")))


def facts(spark: SparkSession, d: str) -> DataFrame:
    n, r = nodes(spark, d), refs(spark, d)
    aliases = spark.createDataFrame([], "alias string, iri string")
    return reduce(DataFrame.unionByName, [onto.nodes_to_triples(n, aliases), onto.references_to_triples(r), onto.type_definition(r), onto.type_hierarchy(n, r)[0]])


@query("semantic_bridge", f"WITH {_LINKS} SELECT DISTINCT s AS subject, '<has_' || regexp_replace(p_name, '\\s+', '_', 'g') || '>' AS predicate, p AS object FROM links JOIN part ON p = '<p/' || p_partkey || '>'")
def semantic_bridge(spark, d):
    return onto.semantic_bridge(facts(spark, d))


@query("enum_and_field_triples", "SELECT * FROM (SELECT '<e/' || p_brand || '/' || p_partkey || '>' AS subject, '" + m.RDF_TYPE + "' AS predicate, '<e/' || p_brand || '>' AS object FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT '<e/' || p_brand || '/' || p_partkey || '>', '<hasEnumValue>', '_:v' || substr(md5('<e/' || p_brand || '>/' || p_partkey), 1, 12) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT '_:v' || substr(md5('<e/' || p_brand || '>/' || p_partkey), 1, 12), '<hasValue>', p_size::VARCHAR FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT '<e/' || p_brand || '>', '<hasField>', '<e/' || p_brand || '/' || p_partkey || '>' FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT '<e/' || p_brand || '/' || p_partkey || '>', '<hasDatatype>', '<opcua:' || p_type || '>' FROM part WHERE p_partkey % 2 = 1)")
def enum_and_field_triples(spark, d):
    f = table(spark, d, "part").select(F.concat(F.lit("<e/"), "p_brand", F.lit(">")).alias("node"), F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("value"), F.col("p_type").alias("datatype"))
    return onto.enum_and_field_triples(f)


@query("node_details_to_triples", f"WITH {_NODES}, n AS (SELECT * FROM nodes WHERE kind = 'UAVariable') SELECT node AS subject, '<hasValueRank>' AS predicate, rank::VARCHAR AS object FROM n UNION ALL SELECT node, '<hasArrayDimensions>', dims FROM n WHERE dims IS NOT NULL UNION ALL SELECT node, '<isReadable>', 'true' FROM n UNION ALL SELECT node, '<isWritable>', CASE WHEN rank >= 1 THEN 'true' ELSE 'false' END FROM n")
def node_details_to_triples(spark, d):
    n = nodes(spark, d).where("kind = 'UAVariable'").withColumn("access", F.when(F.col("rank") >= 1, 3).otherwise(1))
    return onto.node_details_to_triples(n)


@query("inherited_value", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size END, CASE WHEN p_partkey % 3 = 0 THEN 7 END, CASE WHEN p_type = 'PROMO' THEN 8 END, -1) AS rank FROM part")
def inherited_value(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", onto.inherited_value(F.when(k % 2 == 0, F.col("p_size")), F.when(k % 3 == 0, 7), F.when(F.col("p_type") == "PROMO", 8)).alias("rank"))


RULES = [("Mandatory", False, False), ("Optional", True, False), ("OptionalPlaceholder", True, True)]
_RULE = "(['Mandatory', 'Optional', 'OptionalPlaceholder', 'Other'])[p_partkey % 4 + 1]"


def members(spark: SparkSession, d: str) -> DataFrame:
    """Parts as members of their type, every fifth one of the base type."""
    rule = F.element_at(F.array(*[F.lit(x) for x in ("Mandatory", "Optional", "OptionalPlaceholder", "Other")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 5 == 0, "<t/Base>").otherwise(F.concat(F.lit("<t/"), "p_type", F.lit(">"))).alias("owner"), F.col("p_brand").alias("path"), F.concat(F.lit("<p/"), F.col("p_partkey").cast("string"), F.lit(">")).alias("target"), F.when(F.col("p_size") > 40, "UAObject").otherwise("UAVariable").alias("kind"), F.lit("Double").alias("datatype"), F.lit(-1).alias("rank"), rule.alias("rule"))
    return onto.modelling_rule(p, spark.createDataFrame(RULES, "rule string, optional boolean, placeholder boolean"))


_MEMBERS = f"members AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN '<t/Base>' ELSE '<t/' || p_type || '>' END AS owner, p_brand AS path, '<p/' || p_partkey || '>' AS target, p_size > 40 AS is_object, {_RULE} AS rule, p_partkey % 4 IN (1, 2) AS optional, p_partkey % 4 = 2 AS placeholder, p_partkey % 4 < 3 AS known FROM part)"


@query("modelling_rule", f"WITH {_MEMBERS} SELECT target, rule, optional, placeholder, known FROM members")
def modelling_rule(spark, d):
    return members(spark, d).select("target", "rule", "optional", "placeholder", "known")


@query("type_contracts", f"""WITH {_MEMBERS}, t AS (SELECT DISTINCT '<t/' || p_type || '>' AS type FROM part), chain AS (SELECT type, type AS ancestor, 0 AS depth FROM t UNION ALL SELECT type, '<t/Base>', 1 FROM t)
SELECT type AS "targetClass", path AS "propertyPath", CASE WHEN is_object THEN target END AS "propertyClass", CASE WHEN is_object THEN '@id' ELSE '@value' END AS "propertyNodetype", CASE WHEN is_object THEN '{m.RELATIONSHIP}' ELSE '{m.PROPERTY}' END AS "attributeType", CASE WHEN optional THEN '0' ELSE '1' END AS "minCount", CASE WHEN NOT placeholder THEN '1' END AS "maxCount", CASE WHEN NOT is_object THEN '{m.XSD}double' END AS datatypes, depth
FROM chain JOIN members ON ancestor = owner AND known QUALIFY row_number() OVER (PARTITION BY type, path ORDER BY depth, owner, target) = 1""")
def type_contracts(spark, d):
    types = table(spark, d, "part").select(F.concat(F.lit("<t/"), "p_type", F.lit(">")).alias("type")).distinct()
    return onto.type_contracts(types, members(spark, d), onto.type_hierarchy(nodes(spark, d), refs(spark, d))[0])


@query("contract_consistency", "SELECT DISTINCT a.p_brand AS type, a.p_size::VARCHAR AS path, '<Part/' || a.p_type || '>' AS x, '<Part/' || b.p_type || '>' AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type < b.p_type")
def contract_consistency(spark, d):
    c = table(spark, d, "part").select(F.col("p_brand").alias("type"), F.col("p_size").cast("string").alias("path"), F.concat(F.lit("<Part/"), "p_type", F.lit(">")).alias("cls")).distinct()
    return classtree.contract_consistency(c, rdf(spark, d))


@query("instances_to_attributes", f"WITH {_LINKS} SELECT s || chr(92) || p_name || chr(92) || p AS id, s AS \"entityId\", p_name AS name, '@value' AS \"nodeType\", (['{m.XSD}double', '{m.XSD}integer', 'json'])[p_partkey % 3 + 1] AS \"attributeValue\" FROM links JOIN part ON p = '<p/' || p_partkey || '>' WHERE p_partkey % 2 = 0")
def instances_to_attributes(spark, d):
    root = table(spark, d, "supplier").select(F.concat(F.lit("<s/"), F.col("s_suppkey").cast("string"), F.lit(">")).alias("start"))
    return onto.instances_to_attributes(root, refs(spark, d), nodes(spark, d))[1].select("id", "entityId", "name", "nodeType", "attributeValue")


@query("binding_extract", "SELECT '<b/' || o_orderkey || '>' AS binding, '<c/' || o_custkey || '>' AS entity, '<a/' || o_orderstatus || '>' AS attribute, CASE WHEN o_orderkey % 3 = 0 THEN '\"' || o_orderpriority || '\"' END AS parameter FROM orders")
def binding_extract(spark, d):
    o = table(spark, d, "orders")
    iri = lambda p, c: F.concat(F.lit(f"<{p}/"), F.col(c).cast("string"), F.lit(">"))
    t = onto.triple(o, iri("b", "o_orderkey"), "<bindsEntity>", iri("c", "o_custkey")).unionByName(onto.triple(o, iri("b", "o_orderkey"), "<bindsAttribute>", iri("a", "o_orderstatus"))).unionByName(onto.triple(o.where("o_orderkey % 3 = 0"), iri("b", "o_orderkey"), "<hasParameter>", F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))))
    return onto.binding_extract(t)


@query("machines_and_types", "SELECT '<p/' || p_partkey || '>' AS machine, '<t/' || p_type || '>' AS type FROM part WHERE p_size < 10 UNION ALL SELECT DISTINCT NULL, '<t/' || p_type || '>' FROM part")
def machines_and_types(spark, d):
    folder = onto.triple(table(spark, d, "part").where("p_size < 10"), "<Machines>", "<opcua:Organizes>", F.concat(F.lit("<p/"), F.col("p_partkey").cast("string"), F.lit(">")))
    machines, types = onto.machines_and_types(facts(spark, d).unionByName(folder), "<Machines>", "t/")
    return machines.select("machine", "type").unionByName(types.select(F.lit(None).cast("string").alias("machine"), "type"))


@query("subclass_extract", G + f", {_UP} SELECT DISTINCT r.subject, r.predicate, r.object FROM rdf r JOIN up u ON u.node = r.subject AND u.ancestor = '<Party>' WHERE r.predicate = '{SUB}' AND r.subject <> '<Party>'")
def subclass_extract(spark, d):
    return classtree.subclass_extract(rdf(spark, d), "<Party>")


@query("target_nodes_extract", "WITH k AS (SELECT DISTINCT p_type FROM part WHERE p_size = 1) SELECT '<n/' || p_partkey || '>' AS subject, '" + m.RDF_TYPE + "' AS predicate, '<Part/' || p_type || '>' AS object FROM part WHERE p_type IN (SELECT p_type FROM k)")
def target_nodes_extract(spark, d):
    given = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("<n/"), F.col("p_partkey").cast("string"), F.lit(">")).alias("node"))
    return onto.target_nodes_extract(things(spark, d), given)


@query("violation_context", "SELECT 'o' || o_orderkey AS focus, 'n' || c_nationkey AS entity, 'livesIn/placedBy' AS path FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 450000")
def violation_context(spark, d):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    report = o.where("o_totalprice > 450000").select(text("o", "o_orderkey").alias("focus"))
    parents = o.select(text("o", "o_orderkey").alias("child"), text("c", "o_custkey").alias("parent"), F.lit("placedBy").alias("step")).unionByName(c.select(text("c", "c_custkey").alias("child"), text("n", "c_nationkey").alias("parent"), F.lit("livesIn").alias("step")))
    return onto.violation_context(report, parents, table(spark, d, "nation").select(text("n", "n_nationkey").alias("node")))


def _ranked(spark, d):
    n = nodes(spark, d).where("kind = 'UAVariable'").join(onto.type_definition(refs(spark, d)).select(F.col("subject").alias("node"), F.col("object").alias("type")), "node")
    return n, nodes(spark, d).where("kind = 'UAVariableType'").select(F.col("node").alias("type"), F.col("rank").alias("type_rank"))


_RANK = "SELECT '<p/' || p_partkey || '>' AS focus, 'violation' AS severity, 'rank does not fit the type''s' AS message FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT '<p/' || p_partkey || '>', 'violation', 'dimensions do not fit the rank' FROM part WHERE p_partkey % 4 = 3"
_NOPROP = "SELECT '<p/' || p_partkey || '>' AS focus, 'violation' AS severity, 'HasProperty target of a wrong kind' AS message FROM part WHERE false"


@query("onto_value_rank", _RANK)
def onto_value_rank(spark, d):
    return onto.onto_value_rank(*_ranked(spark, d))


@query("onto_has_component", "SELECT DISTINCT '<t/' || p_type || '>' AS focus, 'violation' AS severity, 'HasComponent target of a wrong kind' AS message FROM part")
def onto_has_component(spark, d):
    wrong = table(spark, d, "part").select(F.concat(F.lit("<p/"), F.col("p_partkey").cast("string"), F.lit(">")).alias("node"), F.lit("HasComponent").alias("type"), F.lit(True).alias("forward"), F.concat(F.lit("<t/"), "p_type", F.lit(">")).alias("target"))
    return onto.onto_has_component(refs(spark, d).unionByName(wrong), nodes(spark, d))


@query("onto_has_property", "SELECT DISTINCT '<s/' || l_suppkey || '>' AS focus, 'violation' AS severity, 'HasProperty target of a wrong kind' AS message FROM lineitem WHERE l_partkey % 2 = 1 UNION ALL SELECT DISTINCT '<p/' || l_partkey || '>', 'violation', 'property with properties' FROM lineitem a WHERE l_partkey % 2 = 1 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey % 2 = 0 AND a.l_partkey + 1 = b.l_partkey)")
def onto_has_property(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    n = lambda p, c: F.concat(F.lit(f"<{p}/"), c.cast("string"), F.lit(">"))
    make = lambda df, a, z: df.select(a.alias("node"), F.lit("HasProperty").alias("type"), F.lit(True).alias("forward"), z.alias("target"))
    to_supplier = make(lines.where("l_partkey % 2 = 1"), n("p", F.col("l_partkey")), n("s", F.col("l_suppkey")))
    to_part = make(lines.where("l_partkey % 2 = 0"), n("s", F.col("l_suppkey") + 1_000_000), n("p", F.col("l_partkey") - 1))
    return onto.onto_has_property(to_supplier.unionByName(to_part), nodes(spark, d))


@query("onto_modelling_rule", "SELECT '<p/' || p_partkey || '>' AS focus, 'violation' AS severity, 'modelling rule not allowed' AS message FROM part WHERE p_partkey % 4 = 3")
def onto_modelling_rule(spark, d):
    return onto.onto_modelling_rule(members(spark, d).select(F.col("target").alias("node"), "rule"))


@query("onto_historizing", "SELECT '<p/' || p_partkey || '>' AS focus, 'violation' AS severity, 'historizing not allowed' AS message FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT '<p/' || p_partkey || '>', 'violation', 'historizing of a node that is no variable' FROM part WHERE p_size > 40")
def onto_historizing(spark, d):
    h = F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("maybe")), (F.regexp_extract("target", r"(\d+)", 1).cast("int") % 3 + 1).cast("int"))
    return onto.onto_historizing(members(spark, d).select(F.col("target").alias("node"), "kind", h.alias("historizing")))


@query("violation_report", f"SELECT focus, severity, message, count(*) AS n FROM ({_RANK} UNION ALL SELECT '<p/' || p_partkey || '>', 'violation', 'modelling rule not allowed' FROM part WHERE p_partkey % 4 = 3) GROUP BY ALL")
def violation_report(spark, d):
    return onto.violation_report(onto_value_rank(spark, d), onto_modelling_rule(spark, d))


# Catalogues: a shape for each part type


def shape_triples(spark: SparkSession, d: str) -> DataFrame:
    """Node shape, property shape and facts per part type; PROMO has two branches."""
    t = table(spark, d, "part").groupBy("p_type").agg(F.max("p_size").alias("top"))
    iri = lambda p: F.concat(F.lit(f"<{p}/"), "p_type", F.lit(">"))
    sh = lambda p: f"<{catalog.SH}{p}>"
    promo = t.where("p_type = 'PROMO'")
    return reduce(DataFrame.unionByName, [
        onto.triple(t, iri("shape"), sh("targetClass"), iri("class")), onto.triple(t, iri("shape"), sh("property"), iri("prop")), onto.triple(t, iri("prop"), sh("path"), F.lit("<size>")),
        onto.triple(t, iri("prop"), sh("maxInclusive"), F.concat(F.lit('"'), F.col("top").cast("string"), F.lit('"'))),
        onto.triple(promo, iri("prop"), sh("or"), iri("b1")), onto.triple(promo, iri("prop"), sh("or"), iri("b2")), onto.triple(promo, iri("b1"), sh("datatype"), F.lit(f"<{m.XSD}integer>")), onto.triple(promo, iri("b2"), sh("datatype"), F.lit(f"<{m.XSD}double>")),
    ])


@query("shape_normalize_or", f"SELECT '<prop/' || p_type || '>' AS subject, '<prop/' || p_type || '>' AS object, 'or' AS p FROM part WHERE p_type <> 'PROMO' GROUP BY p_type UNION ALL SELECT '<prop/' || p_type || '>', '\"' || max(p_size) || '\"', 'maxInclusive' FROM part WHERE p_type <> 'PROMO' GROUP BY p_type UNION ALL SELECT b, '\"' || (SELECT max(p_size) FROM part WHERE p_type = 'PROMO') || '\"', 'maxInclusive' FROM (VALUES ('<b1/PROMO>'), ('<b2/PROMO>')) v(b) UNION ALL SELECT '<prop/PROMO>', b, 'or' FROM (VALUES ('<b1/PROMO>'), ('<b2/PROMO>')) v(b)")
def shape_normalize_or(spark, d):
    t = catalog.shape_normalize_or(shape_triples(spark, d))
    return t.select("subject", "object", F.regexp_extract("predicate", "#(.*)>", 1).alias("p")).where("p in ('or', 'maxInclusive')")


@query("constraint_catalog", "WITH t AS (SELECT p_type, max(p_size)::VARCHAR AS top FROM part GROUP BY p_type), r AS (SELECT 'class/' || p_type AS \"targetClass\", top, '' AS branch FROM t WHERE p_type <> 'PROMO' UNION ALL SELECT 'class/PROMO', top, b FROM t, (VALUES ('integer'), ('double')) v(b) WHERE p_type = 'PROMO') SELECT \"targetClass\", 'size' AS \"propertyPath\", top AS \"maxInclusive\", CASE WHEN branch <> '' THEN '" + m.XSD + "' || branch END AS datatypes, 'warning' AS severity FROM r UNION ALL SELECT 'class/PROMO', NULL, NULL, NULL, 'warning'")
def constraint_catalog(spark, d):
    constraints, _ = catalog.constraint_catalog(catalog.shape_normalize_or(shape_triples(spark, d)))
    return constraints.select("targetClass", "propertyPath", "maxInclusive", "datatypes", "severity")


def schema_docs(spark: SparkSession, d: str) -> DataFrame:
    """A schema document per part type, with bounds from the data."""
    t = table(spark, d, "part").groupBy("p_type").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    return t.select(F.concat(F.lit('[{"$id":"urn:'), "p_type", F.lit('","properties":{"size":{"minimum":"'), F.col("lo").cast("string"), F.lit('","maximum":"'), F.col("hi").cast("string"), F.lit('"},"madeBy":{"relationship":"urn:Supplier"},"state":{"enum":["on","off"]}},"required":["size"],"allOf":[{"$ref":"urn:base"}]}]')).alias("doc")).unionByName(spark.createDataFrame([('[{"$id":"urn:base","properties":{"label":{"minLength":"2"}},"required":["label"]}]',)], "doc string"))


@query("schema_catalog", "WITH t AS (SELECT 'urn:' || p_type AS c, min(p_size)::VARCHAR AS lo, max(p_size)::VARCHAR AS hi FROM part GROUP BY p_type) SELECT c AS \"targetClass\", 'size' AS \"propertyPath\", NULL AS \"propertyClass\", '1' AS \"minCount\", lo AS \"minInclusive\", hi AS \"maxInclusive\", NULL AS \"minLength\", NULL AS ins FROM t UNION ALL SELECT c, 'madeBy', 'urn:Supplier', '0', NULL, NULL, NULL, NULL FROM t UNION ALL SELECT c, 'state', NULL, '0', NULL, NULL, NULL, '\"on\",\"off\"' FROM t UNION ALL SELECT c, 'label', NULL, '1', NULL, NULL, '2', NULL FROM (SELECT c FROM t UNION ALL SELECT 'urn:base')")
def schema_catalog(spark, d):
    return catalog.schema_catalog(schema_docs(spark, d)).select("targetClass", "propertyPath", "propertyClass", "minCount", "minInclusive", "maxInclusive", "minLength", "ins")


@query("domain_range_catalog", f"WITH t AS (SELECT DISTINCT 'urn:' || p_type AS c FROM part), p AS (SELECT c, n FROM t, (VALUES ('size'), ('madeBy'), ('state'), ('label')) v(n) UNION ALL SELECT 'urn:base', 'label') SELECT '<' || n || '>' AS subject, '{m.DOMAIN}' AS predicate, '<' || c || '>' AS object FROM p UNION SELECT '<' || n || '>', '{m.RANGE}', CASE WHEN n = 'madeBy' THEN '<{m.RELATIONSHIP}>' ELSE '<{m.PROPERTY}>' END FROM p")
def domain_range_catalog(spark, d):
    return catalog.domain_range_catalog(schema_docs(spark, d))
