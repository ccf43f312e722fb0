"""Change-data capture of entity documents: flatten, compare, guard and route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantstate import model as m
from plantstate.functions.terms import hash_id
from plantstate.operators.graph import cut
from plantstate.sources import buckets

#: Reserved names inside an attribute.
RESERVED = ("@type", *(m.NGSI + x for x in ("hasValue", "hasObject", "hasJSON", "hasValueList", "datasetId", "unitCode", "observedAt", "createdAt", "modifiedAt")))
SYNC = "urn:sync"
#: An instance of an attribute: the fields of its own, read at once.
ITEM = "`@type` array<string>, " + ", ".join(
    f"`{m.NGSI}{name}` array<struct<{', '.join(f'`@{x}`: string' for x in of)}>>"
    for name, of in {"hasValue": ("value", "id", "type"), "hasObject": ("id",), "hasJSON": ("value",), "hasValueList": ("list",), "datasetId": ("id",), "unitCode": ("value",), "observedAt": ("value",)}.items()
)


def _attributes(doc: Column) -> Column:
    """key, value (JSON text) of the attributes in a JSON object; reserved names and plain values go."""
    return F.filter(F.map_entries(F.from_json(doc, "map<string,string>")), lambda e: ~e["key"].isin("id", "@id", "type", *RESERVED) & e["value"].rlike(r"^\s*[\[{]"))


def _instances(value: Column) -> Column:
    """The instances of an attribute, as JSON text: an object stands for itself, an array for those in it."""
    return F.when(value.rlike(r"^\s*\["), F.from_json(value, "array<string>")).otherwise(F.array(value))


def _fields(s: Column) -> dict[str, Column]:
    at = lambda name, part: F.get(s[m.NGSI + name], F.lit(0))[f"@{part}"]
    kind, value = F.get(s["@type"], F.lit(0)), at("hasValue", "value")
    is_iri = at("hasValue", "id").isNotNull()
    return {
        "type": kind,
        "nodeType": F.when(kind == m.RELATIONSHIP, "@id").when(kind.isin(m.JSON_PROPERTY, m.GEO_PROPERTY), "@json").when(kind == m.LIST_PROPERTY, "@list").when((kind == m.PROPERTY) & is_iri, "@id").when(kind == m.PROPERTY, "@value"),
        "valueType": F.when((kind == m.PROPERTY) & ~is_iri, at("hasValue", "type")),
        "attributeValue": F.when(kind == m.RELATIONSHIP, at("hasObject", "id")).when(kind == m.JSON_PROPERTY, at("hasJSON", "value")).when(kind == m.LIST_PROPERTY, at("hasValueList", "list")).otherwise(F.coalesce(value, at("hasValue", "id"))),
        "datasetId": F.coalesce(at("datasetId", "id"), F.lit("@none")),
        "unitCode": at("unitCode", "value"),
        "observedAt": F.try_to_timestamp(at("observedAt", "value")),
    }


def cdc_entity(df: DataFrame, side: str) -> DataFrame:
    """id, type, entity of the before or after image."""
    return df.where(F.col(side).isNotNull()).select(F.col(f"{side}.id").alias("id"), F.get(F.col(f"{side}.e_types"), F.lit(0)).alias("type"), F.col(f"{side}.entity").alias("entity"))


FIELDS = ("type", "nodeType", "valueType", "attributeValue", "datasetId", "unitCode", "observedAt")
FLAT = ("parentId", "entityId", "name", *FIELDS)


def _instance_rows(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """id, pos, FLAT and carried columns of every instance in documents (id, entity JSON, carried), several of an id included."""
    front = docs.select(*carried, F.col("id").alias("entityId"), F.lit(None).cast("string").alias("parentId"), _attributes(F.col("entity")).alias("subs"))
    out = None
    while True:
        # Texts are read inside the generators: conditions on what these make are not pushed below them, where each would read the text anew.
        found = front.select(*carried, "entityId", "parentId", F.explode_outer("subs").alias("e"))
        read = F.transform(_instances(F.col("e.value")), lambda text: F.struct(text.alias("text"), F.from_json(text, ITEM).alias("s")))
        found = found.select(*carried, "entityId", "parentId", F.col("e.key").alias("name"), F.posexplode_outer(read).alias("pos", "i"))
        found = found.where(F.col("i").isNotNull() & _fields(F.col("i.s"))["nodeType"].isNotNull())
        found = found.select(*carried, "entityId", "parentId", "name", "pos", *[c.alias(n) for n, c in _fields(F.col("i.s")).items()], _attributes(F.col("i.text")).alias("subs"))
        top = F.when(F.col("datasetId") == "@none", F.col("name")).otherwise(hash_id(F.col("name"), F.col("datasetId")))
        below = hash_id(F.concat_ws("\\", "parentId", "name"), F.col("datasetId"))
        level = cut(found.withColumn("id", F.concat_ws("\\", "entityId", F.when(F.col("parentId").isNull(), top).otherwise(below))))
        rows = level.select("id", "pos", *FLAT, *carried)
        out = rows if out is None else out.unionByName(rows)
        front = level.where(F.size("subs") > 0).select(*carried, "entityId", F.col("id").alias("parentId"), "subs")
        if front.isEmpty():
            return out


def _by_id(rows: DataFrame) -> DataFrame:
    """Dealt by id into as many partitions as the written rows need: a task's share stays the same, and is sorted once."""
    return rows.repartition(buckets.tasks(rows), "id")


def cdc_flatten(docs: DataFrame) -> DataFrame:
    """Attribute rows of documents (id, entity JSON), at any depth: a written round per level of nesting.

    A top attribute's id is entity\\name, of a further dataset the name's hash; a sub-attribute's
    is entity\\hash of its whole path. Of instances with one id the last wins; unknown kinds go,
    with what is in them. An instance is read twice: for its own fields, and for its sub-attributes."""
    last = _by_id(_instance_rows(docs)).groupBy("id").agg(F.max(F.struct("pos", *FLAT)).alias("l"))
    return last.select("id", *[F.col(f"l.{c}").alias(c) for c in FLAT])


def cdc_changes(df: DataFrame) -> DataFrame:
    """cdc_diff() of change records (before, after): both images are flattened in one pass and compared in one grouping by id."""
    image = lambda side: df.where(F.col(side).isNotNull()).select(F.lit(side).alias("side"), F.col(f"{side}.id").alias("id"), F.col(f"{side}.entity").alias("entity"))
    rows = _instance_rows(image("before").unionByName(image("after")), ("side",))
    last = lambda side: F.max(F.when(F.col("side") == side, F.struct("pos", *FLAT))).alias(side)
    both = _by_id(rows).groupBy("id").agg(last("before"), last("after"))
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(f"after.{c}").eqNullSafe(F.col(f"before.{c}"))
    op = F.when(F.col("after").isNull(), "deleted").when(F.col("before").isNull(), "inserted").when(~same, "updated")
    kept = [F.coalesce("after", "before")[c].alias(c) for c in ("entityId", "name", "parentId", "type", "datasetId")]
    return both.withColumn("op", op).where(F.col("op").isNotNull()).select("id", "op", *kept, *[F.col(f"after.{c}").alias(c) for c in ("nodeType", "valueType", "attributeValue", "unitCode", "observedAt")])


#: What an attribute is compared by.
COMPARED = ("type", "nodeType", "valueType", "attributeValue", "datasetId", "unitCode")


def cdc_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Attribute rows of the after image with op inserted or updated, and those that are gone with op deleted."""
    b = before.select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in (*COMPARED, "entityId", "name", "parentId")])
    j = after.join(b, after["id"] == b["b_id"], "full_outer")
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    op = F.when(F.col("id").isNull(), "deleted").when(F.col("b_id").isNull(), "inserted").when(~same, "updated")
    keep = lambda c: F.when(F.col("id").isNull(), F.col(f"b_{c}")).otherwise(F.col(c)).alias(c)
    gone_less = lambda c: F.when(F.col("id").isNotNull(), F.col(c)).alias(c)
    return j.withColumn("op", op).where(F.col("op").isNotNull()).select(F.coalesce("id", "b_id").alias("_id"), "op", keep("entityId"), keep("name"), keep("parentId"), keep("type"), keep("datasetId"), gone_less("nodeType"), gone_less("valueType"), gone_less("attributeValue"), gone_less("unitCode"), gone_less("observedAt")).withColumnRenamed("_id", "id")


def cdc_entity_diff(df: DataFrame) -> DataFrame:
    """id, type, op: created, deleted or updated entities."""
    op = F.when(F.col("before").isNull() & F.col("after").isNotNull(), "created").when(F.col("before").isNotNull() & F.col("after").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "updated")
    return df.select(F.coalesce("after.id", "before.id").alias("id"), F.coalesce(F.get("after.e_types", F.lit(0)), F.get("before.e_types", F.lit(0))).alias("type"), op.alias("op")).where(F.col("op").isNotNull())


def cdc_loop_guard(df: DataFrame, marker: str = SYNC) -> DataFrame:
    """Without changes of the platform's own: there was a before image, and the sync marker changed."""
    sync = lambda side: F.get_json_object(f"{side}.entity", f"$['{marker}']")
    return df.where(~(F.col("before").isNotNull() & F.col("after").isNotNull() & ~sync("before").eqNullSafe(sync("after"))))


def cdc_route(diff: DataFrame, entity_ops: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entity rows, attribute rows) for the logs. Entities that are only updated have no row."""
    entities = entity_ops.where("op <> 'updated'").select("id", "type", (F.col("op") == "deleted").alias("deleted"), now.alias("ts"))
    attributes = diff.select("id", "parentId", "entityId", "name", "nodeType", "valueType", "type", "attributeValue", "datasetId", "unitCode", (F.col("op") == "deleted").alias("deleted"), F.lit(True).alias("synced"), F.coalesce("observedAt", now).alias("ts"))
    return entities, attributes


def merge_patch(state: DataFrame, patches: DataFrame, null_marker: str = "urn:ngsi-ld:null") -> DataFrame:
    """State rows (entityId, name, datasetId, attributeValue) after patches; the null marker removes."""
    keys = ["entityId", "name", "datasetId"]
    p = patches.select(*keys, F.col("attributeValue").alias("_new"), F.lit(True).alias("_has"))
    j = state.select(*keys, F.col("attributeValue").alias("_old")).join(p, keys, "full_outer")
    return j.withColumn("attributeValue", F.when(F.col("_has"), F.col("_new")).otherwise(F.col("_old"))).where(~F.coalesce(F.col("_has") & (F.col("_new") == null_marker), F.lit(False))).select(*keys, "attributeValue")


def concise_to_normalized(attr: Column) -> Column:
    """A concise attribute (JSON text of a value, or of an object) as {"type": .., "value": ..} text."""
    return F.when(F.get_json_object(attr, "$.type").isNotNull(), attr).when(F.get_json_object(attr, "$.object").isNotNull(), F.concat(F.lit('{"type":"Relationship",'), F.substr(attr, F.lit(2)))).when(F.get_json_object(attr, "$.value").isNotNull(), F.concat(F.lit('{"type":"Property",'), F.substr(attr, F.lit(2)))).otherwise(F.concat(F.lit('{"type":"Property","value":'), attr, F.lit("}")))


def normalized_to_concise(attr: Column) -> Column:
    """Back: the type goes, and a value alone stands for itself."""
    bare = F.regexp_replace(attr, r'^\{"type":"(?:Property|Relationship)",', "{")
    return F.when(bare.rlike(r'^\{"value":(?:[^{}\[\],]|"[^"]*")*\}$'), F.regexp_extract(bare, r'^\{"value":(.*)\}$', 1)).otherwise(bare)
