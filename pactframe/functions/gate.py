"""Compiles a JSON Schema into a boolean column over a payload. Keywords apply to values of their own type only."""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import payload as p
from . import recursive
from .recursive import FORMATS, REFUSED, Unsupported, known

class _Recursive(Exception):
    """A schema that refers to itself has no finite column."""


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


class _Compiler:
    def __init__(self, root: dict, formats: bool):
        self.formats, self.known = formats, known(root)

    def value(self, schema: dict | bool, v: Column, stack: tuple[str, ...] = ()) -> Column:
        if isinstance(schema, bool):
            return F.lit(schema)
        self._check(schema)
        if _flat(schema):
            return self._judged(schema, v, p.kind(v), stack)
        return p.let(p.kind(v), lambda of: self._judged(schema, v, of, stack))

    def _judged(self, schema: dict, v: Column, of: Column, stack: tuple[str, ...]) -> Column:
        """v, which is cheap to name, by the schema's keywords; of is its kind."""
        parts = []
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref in stack:
                raise _Recursive(ref)
            if ref not in self.known:
                raise ValueError(f"unresolved reference {ref}")
            parts.append(self.value(self.known[ref], v, (*stack, ref)))
        if "type" in schema:
            types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            parts.append(_any([self._type(t, v, of) for t in types]))
        if "enum" in schema:
            parts.append(_any([self._equals(x, v, of) for x in schema["enum"]]))
        if "const" in schema:
            parts.append(self._equals(schema["const"], v, of))
        only = lambda kind, test: F.when(of == kind, F.coalesce(test, F.lit(False))).otherwise(True)
        parts += [only(kind, _all(tests)) for kind, tests in (("string", self._string(schema, v)), ("number", self._number(schema, v))) if tests]
        if schema.keys() & ARRAY_WORDS:
            parts.append(only("array", p.let(p.as_array(v), lambda items: self._array(schema, items, stack))))
        if schema.keys() & OBJECT_WORDS:
            parts.append(only("object", p.let(p.as_map(v), lambda m: self.fields(schema, m, v, stack))))
        for word, join in (("allOf", _all), ("anyOf", _any)):
            if word in schema:
                parts.append(join([self.value(s, v, stack) for s in schema[word]]))
        if "oneOf" in schema:
            parts.append(reduce(lambda a, b: a + b, [self.value(s, v, stack).cast("int") for s in schema["oneOf"]]) == 1)
        if "not" in schema:
            parts.append(~self.value(schema["not"], v, stack))
        if "if" in schema:
            then, other = (self.value(schema.get(word, True), v, stack) for word in ("then", "else"))
            parts.append(F.when(self.value(schema["if"], v, stack), then).otherwise(other))
        return F.coalesce(_all(parts), F.lit(False))

    @staticmethod
    def _check(schema: dict) -> None:
        for word in REFUSED:
            if word in schema:
                raise Unsupported(f"the gate cannot check {word}")

    def _string(self, schema: dict, v: Column) -> list[Column]:
        length = F.char_length(p.text(v))
        tests = [length >= schema["minLength"]] if "minLength" in schema else []
        tests += [length <= schema["maxLength"]] if "maxLength" in schema else []
        patterns = [schema["pattern"]] if "pattern" in schema else []
        patterns += [FORMATS[schema["format"]]] if self.formats and schema.get("format") in FORMATS else []
        return tests + [p.text(v).rlike(x) for x in patterns]

    @staticmethod
    def _number(schema: dict, v: Column) -> list[Column]:
        tests = [_compared(v, schema[word], how) for word, how in (("minimum", "__ge__"), ("maximum", "__le__"), ("exclusiveMinimum", "__gt__"), ("exclusiveMaximum", "__lt__")) if word in schema]
        if "multipleOf" in schema:
            step = Decimal(str(schema["multipleOf"]))
            tests.append(F.try_variant_get(v, "$", "decimal(38,12)") % F.lit(step).cast("decimal(38,12)") == 0)
        return tests

    def _array(self, schema: dict, items: Column, stack: tuple[str, ...]) -> Column:
        tests = [F.size(items) >= schema["minItems"]] if "minItems" in schema else []
        tests += [F.size(items) <= schema["maxItems"]] if "maxItems" in schema else []
        first = schema.get("prefixItems", [])
        tests += [(F.size(items) <= i) | p.let(F.get(items, F.lit(i)), self._each(s, stack)) for i, s in enumerate(first)]
        if "items" in schema:
            rest = F.slice(items, len(first) + 1, F.greatest(F.size(items), F.lit(1))) if first else items
            tests.append(F.forall(rest, lambda x: self.value(schema["items"], x, stack)))
        if schema.get("uniqueItems"):
            spelled = F.transform(items, lambda x: F.when(p.kind(x) == "number", F.coalesce(p.whole(x).cast("string"), F.regexp_replace(p.number(x).cast("string"), r"\.0$", ""))).otherwise(F.to_json(x)))
            tests.append(F.size(F.array_distinct(spelled)) == F.size(items))
        if "contains" in schema:
            hits = F.size(F.filter(items, lambda x: self.value(schema["contains"], x, stack)))
            tests += [hits >= schema.get("minContains", 1), hits <= schema["maxContains"] if "maxContains" in schema else F.lit(True)]
        return _all(tests)

    def fields(self, schema: dict, m: Column, whole: Column, stack: tuple[str, ...] = ()) -> Column:
        """The keywords of objects, for the map m of the object `whole`."""
        properties, patterns = schema.get("properties") or {}, schema.get("patternProperties") or {}
        parts = [p.has(m, k) for k in schema.get("required") or []]
        bound = lambda s, v: self.value(s, v, stack) if _flat(s) else p.let(v, self._each(s, stack))
        parts += [~p.has(m, k) | bound(s, p.get(m, k)) for k, s in properties.items() if s not in (True, {})]
        of_pattern = lambda x: F.map_filter(m, lambda k, _: k.rlike(x))
        for x, sub in patterns.items():
            parts.append(F.forall(F.map_values(of_pattern(x)), self._each(sub, stack)))
        extra = schema.get("additionalProperties", True)
        if extra is not True:
            named = lambda k: _any([*([k.isin(list(properties))] if properties else []), *[k.rlike(x) for x in patterns]])
            others = F.map_filter(m, lambda k, _: ~named(k))
            parts.append(F.size(others) == 0 if extra is False else F.forall(F.map_values(others), self._each(extra, stack)))
        if "propertyNames" in schema:
            parts.append(F.forall(F.map_keys(m), lambda k: self.value(schema["propertyNames"], k.cast("variant"), stack)))
        parts += [F.size(m) >= schema["minProperties"]] if "minProperties" in schema else []
        parts += [F.size(m) <= schema["maxProperties"]] if "maxProperties" in schema else []
        parts += [~p.has(m, k) | _all([p.has(m, x) for x in needed]) for k, needed in (schema.get("dependentRequired") or {}).items()]
        parts += [~p.has(m, k) | self.value(s, whole, stack) for k, s in (schema.get("dependentSchemas") or {}).items()]
        return _all(parts)

    def _each(self, schema: dict | bool, stack: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda x: self.value(schema, x, stack)

    @staticmethod
    def _type(name: str, v: Column, of: Column) -> Column:
        if name == "integer":
            return (of == "number") & F.coalesce(p.number(v) == F.floor(p.number(v)), F.lit(False))
        return of == name

    @staticmethod
    def _equals(want: Any, v: Column, of: Column) -> Column:
        if isinstance(want, (int, float)) and not isinstance(want, bool):
            return (of == "number") & F.coalesce(_compared(v, want, "__eq__"), F.lit(False))
        if isinstance(want, str):
            return (of == "string") & F.coalesce(p.text(v) == want, F.lit(False))
        return F.to_json(v) == json.dumps(want, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


JOINS = {"allOf", "anyOf", "oneOf", "not", "if", "then", "else"}


def _flat(schema: dict | bool) -> bool:
    """Whether a schema names its value so few times that binding it, which leaves compiled code, costs more than it saves."""
    return isinstance(schema, bool) or not schema.keys() & {"$ref", *JOINS, *ARRAY_WORDS, *OBJECT_WORDS}


ARRAY_WORDS = {"minItems", "maxItems", "prefixItems", "items", "uniqueItems", "contains"}
OBJECT_WORDS = {"required", "properties", "additionalProperties", "patternProperties", "propertyNames", "minProperties", "maxProperties", "dependentRequired", "dependentSchemas"}


def _compared(v: Column, bound: float, how: str) -> Column:
    """A number against a bound of the schema: exactly where both are whole, else as doubles.

    Below 2^53 no other whole number rounds to the bound, so doubles tell as much.
    """
    by_double = getattr(p.number(v), how)(float(bound))
    if isinstance(bound, float) and not bound.is_integer() or abs(bound) < 2**53 or abs(bound) >= 10**38:
        return by_double
    exact = p.whole(v)
    return F.when(exact.isNotNull(), getattr(exact, how)(F.lit(Decimal(int(bound))).cast("decimal(38,0)"))).otherwise(by_double)


def accepts(schema: dict, payload: Column, formats: bool = False) -> Column:
    """Whether a payload (MAP<STRING, VARIANT>) validates against an object schema; null payloads do not.

    `format` is an annotation unless formats is set. A schema that refers to itself has no finite column: payloads then go
    to a validator of rows as JSON texts, in Arrow batches. Raises Unsupported for assertions that neither can check;
    unknown keywords are annotations.
    """
    kinds = schema.get("type", "object")
    if "object" not in (kinds if isinstance(kinds, list) else [kinds]):
        return F.lit(False)
    compiler = _Compiler(schema, formats)
    rest = {k: v for k, v in schema.items() if k in ("allOf", "anyOf", "oneOf", "not", "$ref", "enum", "const", "if", "then", "else", *REFUSED)}
    try:
        whole = p.let(F.to_variant_object(payload), lambda v: compiler.value(rest, v)) if rest else F.lit(True)
        found = compiler.fields(schema, payload, F.to_variant_object(payload)) & whole
    except _Recursive:
        found = recursive.validator(schema, formats)(p.to_json(payload))
    return F.coalesce(found, F.lit(False))
