"""Records as MAP<STRING, VARIANT>: a key that is absent differs from one whose value is null."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAP = "map<string,variant>"
# The empty value of each type, a number at a text's start, and the texts that are false.
EMPTY = {"string": "", "integer": 0, "number": 0, "boolean": False, "array": [], "object": {}}
NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
WHOLE = r"^\s*([+-]?[0-9]+)(?:\.[0-9]*)?(?![0-9]|\.|[eE][+-]?[0-9])"
PHP_SPACE = " \t\n\r\0\x0b"
FALSE_WORDS = ["", "0", "false", "no", "off"]
# The kinds of Spark's names of variants, the commonest first; a name that is not here is a kind of text.
_NUMBERS = ("DECIMAL", "BIGINT", "DOUBLE", "INT", "TINYINT", "SMALLINT", "FLOAT")
KINDS = {"STRING": "string", **dict.fromkeys(_NUMBERS, "number"), "OBJECT": "object", "ARRAY": "array", "BOOLEAN": "boolean", "VOID": "null"}
WHOLE_NAMES = r"^(?:TINYINT|SMALLINT|INT|BIGINT|DECIMAL\([0-9]+,0\))$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def from_json(text: Column) -> Column:
    """A JSON text's object as a payload; null if it is no object."""
    return as_map(F.try_parse_json(text))


def from_columns(*names: str) -> Column:
    """Columns as a payload; every key is present."""
    return as_map(F.parse_json(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})))


#: Types whose values are the same as variants and by way of JSON.
_PLAIN = (T.BooleanType, T.IntegralType, T.DecimalType, T.StringType, T.DateType)


def from_frame(df: DataFrame, *names: str) -> Column:
    """df's columns (all, unless named) as a payload, as `from_columns` makes it, without the way over JSON text where their types allow it."""
    entries = []
    for name in names or df.columns:
        kind, column = df.schema[name].dataType, F.col(f"`{name}`")
        by_json = F.try_variant_get(F.parse_json(F.to_json(F.struct(column.alias("x")), {"ignoreNullFields": "false"})), "$.x", "variant")
        if isinstance(kind, _PLAIN):
            value = column.cast("variant")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            value = F.when(F.isnan(column) | (F.abs(column) == float("inf")), by_json).otherwise(column.cast("variant"))
        else:
            value = by_json
        entries += [F.lit(name), F.coalesce(value, literal(None))]
    return F.create_map(*entries)


def to_json(payload: Column) -> Column:
    return F.to_json(F.to_variant_object(payload))


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", MAP)


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def literal(value: Any) -> Column:
    """A plan-time JSON value as a VARIANT."""
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))


def literal_map(values: dict[str, Any]) -> Column:
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), MAP)


def has(payload: Column, key: str) -> Column:
    return F.map_contains_key(payload, F.lit(key))


def only(payload: Column, keys: list[str]) -> Column:
    return F.map_filter(payload, lambda k, _: k.isin(keys) if keys else F.lit(False))


def get(payload: Column, key: str) -> Column:
    return F.try_element_at(payload, F.lit(key))


def kind(value: Column) -> Column:
    """null, boolean, string, integer-or-number, array, object; SQL null for an absent value."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), name), F.when(name.isNotNull(), "string"))


def number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def whole(value: Column) -> Column:
    """A number that is stored without a fraction, exactly, as decimal(38,0); null for others."""
    return F.when(F.schema_of_variant(value).rlike(WHOLE_NAMES), F.try_variant_get(value, "$", "decimal(38,0)"))


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def path(value: Column, dotted: str) -> Column:
    """The value at a dotted path, SQL null if there is none. A segment of digits is a key of an object and an index of a list.

    No value is both, so the likelier way comes first: each way that finds nothing costs an exception.
    """
    ways = ["$"]
    for segment in dotted.split(".") if dotted else []:
        quote = '"' if "'" in segment else "'"
        ways = [w + step for w in ways for step in ([f"[{int(segment)}]", f"[{quote}{segment}{quote}]"] if re.fullmatch("[0-9]{1,9}", segment) else [f"[{quote}{segment}{quote}]"])]
    return F.coalesce(*[F.try_variant_get(value, w, "variant") for w in ways]) if dotted else value


def _stringish(value: Column) -> Column:
    of = kind(value)
    return F.when(of == "boolean", F.when(F.try_variant_get(value, "$", "boolean"), "1").otherwise("")).when(of.isin("array", "object"), "").otherwise(text(value))


def _leading_number(value: Column) -> Column:
    of, plain = kind(value), text(value)
    found = F.regexp_extract(plain, NUMBER, 1).try_cast("double")
    size = F.coalesce(F.size(as_array(value)), F.size(as_map(value)))
    return (
        F.when(of == "number", number(value)).when(of == "boolean", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(of == "string", F.coalesce(found, F.lit(0.0))).otherwise(F.when(size > 0, 1.0).otherwise(0.0))
    )


def _truth(value: Column) -> Column:
    of = kind(value)
    size = F.coalesce(F.size(as_array(value)), F.size(as_map(value)))
    return (
        F.when(of == "string", ~F.lower(F.btrim(text(value), F.lit(PHP_SPACE))).isin(FALSE_WORDS)).when(of == "boolean", F.try_variant_get(value, "$", "boolean"))
        .when(of == "number", number(value) != 0).otherwise(size > 0)
    )


LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def _integer(value: Column) -> Column:
    """Fractions are cut off; what 64 bits do not hold becomes the nearest they do."""
    near = _leading_number(value)
    digits = F.when(kind(value) == "string", F.nullif(F.regexp_extract(text(value), WHOLE, 1), F.lit("")))
    exact = F.coalesce(whole(value), digits.try_cast("decimal(38,0)"))
    held = F.when(exact > GREATEST, F.lit(GREATEST)).when(exact < LEAST, F.lit(LEAST)).otherwise(exact.try_cast("bigint"))
    rounded = F.when(near >= float(GREATEST), F.lit(GREATEST)).when(near <= float(LEAST), F.lit(LEAST)).otherwise(F.when(near < 0, F.ceil(near)).otherwise(F.floor(near)).try_cast("bigint"))
    return F.coalesce(held, rounded)


CASTS = {
    "string": _stringish,
    "int": _integer,
    "float": _leading_number,
    "bool": _truth,
    "trim": lambda v: F.btrim(_stringish(v), F.lit(PHP_SPACE)),
}


def cast(name: str, value: Column) -> Column:
    """value, which is neither absent nor null, by a cast of the fixed vocabulary, as a VARIANT."""
    return CASTS[name](value).cast("variant")
