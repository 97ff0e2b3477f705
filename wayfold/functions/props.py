"""Schemaless JSON properties: extraction, type classes and comparisons.

A property is compared without coercion between numbers and text: any number is below any
text, true and false count as 1 and 0, a missing or null property gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant(column: Column) -> Column:
    """A JSON text column as VARIANT."""
    return F.try_parse_json(column)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: Spark would put a costly expression into each place of a filter that names it, but not through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def get(props: Column, key: str) -> Column:
    return F.try_variant_get(props, path(key), "variant")


def kind(v: Column) -> Column:
    """null, bool, number, string, array or object; null where the property is missing."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None))
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "bool")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("number")
    )


_TEXT = "^(STRING|OBJECT|ARRAY)"
_NOT_NUMBER = "^(STRING|OBJECT|ARRAY|VOID)"


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v).rlike(_TEXT)


def is_number(v: Column) -> Column:
    return ~F.schema_of_variant(v).rlike(_NOT_NUMBER)


def number(v: Column) -> Column:
    """The value of numbers and booleans, null for all else: "5" is no number."""
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def text(v: Column) -> Column:
    """The value of strings, and objects and arrays as JSON; null for all else."""
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def as_text(v: Column) -> Column:
    """Numbers, booleans (1 or 0) and strings as text, for patterns."""
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "int").cast("string")).otherwise(F.try_variant_get(v, "$", "string"))


# each test names a property's value and class once: the compiled filter stays small enough for code generation


def compare(v: Column, op: str, literal: str | float | bool) -> Column:
    """op is one of = < <= > >=; null where the property is missing or null."""
    if isinstance(literal, str):
        own, other, absent = text(v), is_number(v), op in ("<", "<=")
        value = F.lit(literal)
    else:
        own, other, absent = number(v), is_text(v), op in (">", ">=")
        value = F.lit(float(literal))
    test = {"=": own.__eq__, "<": own.__lt__, "<=": own.__le__, ">": own.__gt__, ">=": own.__ge__}[op](value)
    return F.coalesce(test, F.when(other, F.lit(absent)))


def differs(v: Column, literal: str | float | bool) -> Column:
    """Not equal; a missing property differs from everything."""
    return ~F.coalesce(compare(v, "=", literal), F.lit(False))


def among(v: Column, literals: list) -> Column:
    texts = [x for x in literals if isinstance(x, str)]
    numbers = [float(x) for x in literals if not isinstance(x, str)]
    return F.coalesce(
        number(v).isin(numbers) if numbers else F.when(is_number(v), F.lit(False)),
        text(v).isin(texts) if texts else F.when(is_text(v), F.lit(False)),
    )


def like(v: Column, pattern: str) -> Column:
    """SQL LIKE without an escape character, ASCII letters in either case."""
    parts = {"%": ".*", "_": "."}
    regex = "".join(parts.get(c, c if c.isalnum() and c.isascii() else "\\x{%x}" % ord(c)) for c in pattern)
    return as_text(v).rlike(f"(?is)^{regex}\\z")


def has(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) != "VOID", F.lit(False))


#: Keys that most filters ask for: stored activities have a typed copy of them, which scans can skip by.
HOT = ("activity_type", "total_distance", "moving_time", "elapsed_time", "average_speed", "elevation_gain")
HOT_TYPE = "struct<" + ", ".join(f"{k}: struct<text: string, number: double>" for k in HOT) + ">"


def hot(properties: Column) -> Column:
    """The typed copies of HOT of a VARIANT column: text as comparisons take it, and number."""
    return F.struct(*(F.struct(text(get(properties, k)).alias("text"), number(get(properties, k)).alias("number")).alias(k) for k in HOT))


def cell(c: Column) -> Column:
    """A CSV cell typed as JSON if it is, else a string."""
    return F.coalesce(F.try_parse_json(c), c.cast("variant"))


def round4(x: Column) -> Column:
    """Four decimals, halves away from zero."""
    v = x * 1e4
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)) / 1e4


def fragment(c: Column, kind: str) -> Column:
    """A value as JSON text."""
    if kind == "string":
        return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return c.cast("string")


def merge(*maps: Column) -> Column:
    """Maps of JSON fragments, the later one wins; null values are dropped."""
    entries = F.flatten(F.array(*(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps)))
    # the last entry of each key
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def object_text(m: Column) -> Column:
    """The JSON object of a map of fragments, keys sorted."""
    key = lambda e: F.concat(F.lit('"'), F.regexp_replace(e["key"], r'(["\\])', r"\\$1"), F.lit('"'))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(key(e), F.lit(":"), e["value"])), ","), F.lit("}"))
