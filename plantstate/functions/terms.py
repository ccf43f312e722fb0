"""Scalar functions over terms, ids, casts and JSON text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantstate import model as m


def cast_int(c: Column) -> Column:
    """Integers only: text that isn't one gives null, on any engine."""
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("int"))


def cast_float(c: Column) -> Column:
    return c.try_cast("double")


def cast_string(c: Column) -> Column:
    return c.cast("string")


def cast_datetime_ms(c: Column) -> Column:
    """Timestamp text to milliseconds since 1970."""
    return F.unix_millis(F.try_to_timestamp(c))


def if_expr(cond: Column, yes: Column, no: Column) -> Column:
    return F.when(cond, yes).otherwise(no)


def bound(c: Column) -> Column:
    return c.isNotNull()


def strip_iri(c: Column) -> Column:
    return F.regexp_replace(c, "^<(.*)>$", "$1")


def strip_literal(c: Column) -> Column:
    return F.regexp_replace(c, '^"(.*)"$', "$1")


def wrap_iri(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def wrap_literal(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def term_format(kind: Column, c: Column) -> Column:
    """IRIs in <>, strings in quotes, numbers bare, blank nodes with _:."""
    return F.when(kind == "iri", wrap_iri(c)).when(kind == "bnode", F.concat(F.lit("_:"), c)).when(kind == "number", c).otherwise(wrap_literal(c))


def local_name(c: Column) -> Column:
    """What follows the last / or #."""
    return F.regexp_extract(c, r"([^/#]*)$", 1)


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"))


def kebab_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1-$2"), r"[\s_]+", "-"))


def hash_id(name: Column, dataset: Column, length: int = 24) -> Column:
    """The first hexadecimal digits of SHA-256 of name\\dataset."""
    return F.substring(F.sha2(F.concat_ws("\\", name, F.coalesce(dataset, F.lit("@none"))), 256), 1, length)


def iso_millis(ts: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSZ, with milliseconds always of three digits."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def json_object_test(c: Column) -> Column:
    """True for a JSON object, false for other text, null for null."""
    return F.when(c.isNotNull(), F.json_object_keys(c).isNotNull())


def json_array_test(c: Column) -> Column:
    return F.when(c.isNotNull(), F.json_array_length(c).isNotNull())


def nodeid_to_iri(nodeid: Column, namespace: Column) -> Column:
    """ns=1;i=42 with its namespace to <namespace>nodei42."""
    kind, value = F.regexp_extract(nodeid, r"(?:^|;)([isgb])=", 1), F.regexp_extract(nodeid, r"(?:^|;)[isgb]=(.*)$", 1)
    return F.concat(namespace, F.lit("node"), kind, value)


def parse_nodeid(nodeid: Column) -> Column:
    """(ns, kind, value); without ns= the namespace is 0."""
    ns = F.regexp_extract(nodeid, r"^ns=(\d+);", 1)
    return F.struct(F.when(ns == "", 0).otherwise(ns.try_cast("int")).alias("ns"), F.regexp_extract(nodeid, r"(?:^|;)([isgb])=", 1).alias("kind"), F.regexp_extract(nodeid, r"(?:^|;)[isgb]=(.*)$", 1).alias("value"))


#: XSD types of OPC UA types.
INTEGERS = ("Integer", "Int16", "Int32", "Int64", "SByte", "UInteger", "UInt16", "UInt32", "UInt64", "Byte")
DOUBLES = ("Decimal", "Double", "Duration", "Float")
STRINGS = ("String", "LocalizedText", "LocaleId", "NumericRange", "ByteString", "Guid", "XmlElement", "QualifiedName")


def map_datatype(c: Column) -> Column:
    """OPC UA type name to an array of XSD types; structures are JSON."""
    x = lambda *names: F.array(*[F.lit(m.XSD + n) for n in names])
    return F.when(c == "Boolean", x("boolean")).when(c.isin(*INTEGERS), x("integer")).when(c.isin(*DOUBLES), x("double")).when(c.isin(*STRINGS), x("string")).when(c == "Number", x("double", "integer")).when(c.isin("DateTime", "UtcTime", "Date"), x("dateTime")).when(c == "NodeId", F.array(F.lit("nodeid"))).when(c == "Enumeration", F.array(F.lit("iri"))).otherwise(F.array(F.lit("json")))


def default_value(datatype: Column, rank: Column, dims: Column) -> Column:
    """Default literal as text: a scalar for ranks below 0, else a list of the product of the dimensions."""
    one = F.when(datatype.endswith("boolean"), "false").when(datatype.endswith("integer"), "0").when(datatype.endswith("double"), "0.0").when(datatype.endswith("dateTime"), "1970-01-01T00:00:00Z").otherwise("")
    count = F.greatest(F.lit(1), F.aggregate(F.coalesce(dims, F.array().cast("array<int>")), F.lit(1), lambda s, x: s * F.greatest(x, F.lit(1))))
    return F.when(rank < 0, one).otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(one, count), ","), F.lit("]")))


def times_twelve(c: Column) -> Column:
    """The scalar function hash(x) * 12 for integers, whose hash is the integer itself."""
    return c.cast("bigint") * 12


def register_functions(spark, functions: dict[str, tuple]) -> None:
    """Make Python functions callable from SQL: name -> (function, type)."""
    for name, (fn, kind) in functions.items():
        spark.udf.register(name, fn, kind)
