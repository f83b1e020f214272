"""Column functions on JSON values held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def at(v: Column, path: str) -> Column:
    """The value at a path without wildcards; null if there is none."""
    return v if path == "$" else F.try_variant_get(v, path, "variant")


def type_name(v: Column) -> Column:
    """null, boolean, number, string, array or object; SQL null for a missing value."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(t == "VOID", "null")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "STRING", "string")
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def text_of(v: Column) -> Column:
    """The text a value is matched as: strings as they are, booleans as 1 and 0, objects and arrays as JSON."""
    kind = type_name(v)
    return F.when(kind == "string", v.cast("string")).when(kind == "boolean", F.when(v.cast("boolean"), "1").otherwise("0")).when(kind == "number", v.cast("string")).when(kind.isin("array", "object"), F.to_json(v))


def ordered(v: Column) -> Column:
    """A struct that compares like the value's storage class: numbers and booleans below text, null for null.

    Whole numbers keep all digits in ``big``; ``num`` decides between numbers of different kinds.
    """
    kind = type_name(v)
    num = F.when(kind == "boolean", v.cast("boolean").cast("double")).when(kind == "number", F.try_variant_get(v, "$", "double"))
    big = F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "decimal(38,0)")).otherwise(F.floor(F.when(F.abs(num) < 1e37, num)).cast("decimal(38,0)"))
    number = F.struct(F.lit(1).alias("class"), num.alias("num"), big.alias("big"), F.lit("").alias("txt"))
    text = F.struct(F.lit(2).alias("class"), F.lit(0.0).alias("num"), F.lit(0).cast("decimal(38,0)").alias("big"), F.coalesce(text_of(v), F.lit("")).alias("txt"))
    return F.when(kind.isin("boolean", "number"), number).when(kind.isin("string", "array", "object"), text)


def ordered_literal(value: bool | int | float | str) -> Column:
    """The same struct of a literal; booleans are numbers."""
    if isinstance(value, str):
        c, num, big, txt = 2, 0.0, 0, value
    else:
        c, num, big, txt = 1, float(value), int(value // 1), ""
    return F.struct(F.lit(c).alias("class"), F.lit(num).alias("num"), F.lit(str(big)).cast("decimal(38,0)").alias("big"), F.lit(txt).alias("txt"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def elements(v: Column) -> Column:
    """The elements of an array value; null for anything else."""
    return F.when(type_name(v) == "array", F.try_variant_get(v, "$", "array<variant>"))


def members(v: Column) -> Column:
    """The members of an object value as a map; null for anything else."""
    return F.when(type_name(v) == "object", F.try_variant_get(v, "$", "map<string,variant>"))


def parse(t: Column) -> Column:
    """JSON text as its value, null for other text.

    The engine's parser stops after the first value; what follows it shows inside brackets and braces.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
    only = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(only & (F.size(F.try_variant_get(member, "$", "map<string,variant>")) == 1), at(listed, "$[0]"))


def parse_or_text(t: Column) -> Column:
    """JSON text as its value, other text as a string value."""
    return F.coalesce(parse(t), t.cast("variant"))


def text_as_json(t: Column) -> Column:
    """The object or array a text holds, also through one string layer; null for scalars and other text."""
    once = parse(t)
    twice = parse(F.when(type_name(once) == "string", once.cast("string")))
    pick = lambda v: F.when(type_name(v).isin("object", "array"), v)
    return F.coalesce(pick(once), pick(twice))


def once(c: Column) -> Column:
    """A column that is worked out once a row: filters on it are not pushed below, where they would work it out for each use."""
    return F.explode(F.array(c))
