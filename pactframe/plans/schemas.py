"""Schema documents at plan time: fingerprints, differences, identity, bundles. Documents are dicts of a few KB."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlsplit

# Keys that describe a schema and leave its structure alone; the words of migrations.
VOLATILE = {"examples", "example", "description", "title", "$comment", "$id", "$schema"}
MIGRATE_FROM, MIGRATE, SOURCE, OPTIONAL = "x-migrate-from", "x-migrate", "x-source", "x-optional"
# Keywords that hold a map of schemas, a schema, or a list of schemas.
MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")
SINGLES = ("items", "additionalProperties", "unevaluatedProperties", "unevaluatedItems", "contains", "propertyNames", "not", "if", "then", "else", "contentSchema")
LISTS = ("allOf", "anyOf", "oneOf", "prefixItems")
NULL = {"type": "null"}
#: What stands under a schema's keyword; all else in a document is data.
_UNDER = dict.fromkeys(MAPS, "map") | dict.fromkeys(LISTS, "list") | dict.fromkeys(SINGLES, "schema")


def escaped(key: str) -> str:
    """A key as a step of a JSON pointer."""
    return key.replace("~", "~0").replace("/", "~1")


def children(node: Any, place: str) -> list[tuple[Any, Any, str]]:
    """The (key or index, value, place) of what node holds; a place is schema, map, list or data."""
    if isinstance(node, dict):
        return [(k, v, "schema" if place == "map" else _UNDER.get(k, "data") if place == "schema" else "data") for k, v in node.items()]
    if isinstance(node, list):
        return [(i, v, "schema" if place == "list" else "data") for i, v in enumerate(node)]
    return []


def nodes(node: Any, pointer: str = "", place: str = "schema") -> Iterator[tuple[str, dict, str]]:
    """Every object of a document with its JSON pointer and its place."""
    if isinstance(node, dict):
        yield pointer, node, place
    for key, value, under in children(node, place):
        yield from nodes(value, f"{pointer}/{escaped(str(key))}", under)


def references_mapped(node: Any, change: Callable[[str, dict], Any]) -> Any:
    """node with change(reference, the keywords beside it) for every object that holds a text $ref."""
    if isinstance(node, list):
        return [references_mapped(x, change) for x in node]
    if not isinstance(node, dict):
        return node
    if isinstance(node.get("$ref"), str):
        return change(node["$ref"], {k: v for k, v in node.items() if k != "$ref"})
    return {k: references_mapped(v, change) for k, v in node.items()}


def _and_null(values: list, null: Any) -> list:
    return values if null in values else [*values, null]


def _null_type(schema: dict) -> dict:
    types = schema.get("type")
    return schema | {"type": "null" if types is None else _and_null(types if isinstance(types, list) else [types], "null")}


def _wide_enum(schema: dict) -> dict:
    return schema | {"enum": _and_null(schema["enum"], None)} if isinstance(schema.get("enum"), list) else schema


#: How a schema that may be null says so: the first row whose keyword it has.
_SAYS_NULL: tuple[tuple[str, Callable[[dict], dict]], ...] = (
    ("not", lambda s: {"anyOf": [s, NULL]}),
    ("$ref", lambda s: {"anyOf": [{"$ref": s["$ref"]}, NULL]} | {k: v for k, v in _wide_enum(s).items() if k != "$ref"}),
    ("anyOf", lambda s: _wide_enum(s) | {"anyOf": _and_null(s["anyOf"], NULL)}),
    ("", lambda s: _null_type(_wide_enum(s))),
)


def fold_nullable(node: dict) -> dict:
    """A boolean `nullable` written as the type, enum or union that says the same."""
    says = node.get("nullable")
    if not isinstance(says, bool):
        return node
    rest = {k: v for k, v in node.items() if k != "nullable"}
    return next(write for word, write in _SAYS_NULL if not word or rest.get(word) is not None)(rest) if says else rest


def canonical(node: Any, exclude: set[str] | frozenset[str] = frozenset(VOLATILE)) -> Any:
    """Keys sorted at every depth, excluded ones dropped, lists in their order."""
    if isinstance(node, list):
        return [canonical(x, exclude) for x in node]
    if isinstance(node, dict):
        folded = fold_nullable(node)
        return {k: canonical(folded[k], exclude) for k in sorted(folded) if k not in exclude}
    return node


def _written(canonical_node: Any) -> str:
    return json.dumps(canonical_node, ensure_ascii=False, separators=(",", ":"))


def fingerprint(schema: dict, exclude: set[str] | frozenset[str] = frozenset(VOLATILE)) -> str:
    return hashlib.sha256(_written(canonical(schema, exclude)).encode()).hexdigest()


def _without(more: Any, less: Any, word: str, places: tuple[str, ...], place: str = "schema") -> Any:
    """more without the keyword `word`, at these places, where less does not have it in the same position."""
    other = dict(enumerate(less)) if isinstance(less, list) else less if isinstance(less, dict) else {}
    left = [(k, _without(v, other.get(k), word, places, under)) for k, v, under in children(more, place) if not (k == word and place in places and k not in other)]
    return dict(left) if isinstance(more, dict) else [v for _, v in left] if isinstance(more, list) else more


def only_defaults_added(frozen: Any, current: Any) -> bool:
    """Whether current is frozen with further `default` keywords and nothing else."""
    old, new = canonical(frozen), canonical(current)
    return _written(_without(new, old, "default", ("schema", "map", "list", "data"))) == _written(old)


def only_optional_removed(frozen: Any, current: Any) -> bool:
    """Whether current is frozen less `x-optional` keywords in schema positions."""
    old, new = canonical(frozen), canonical(current)
    return _written(_without(old, new, OPTIONAL, ("schema",))) == _written(new)


def types_of(prop: dict) -> list[str]:
    """A property's accepted types, sorted and distinct; a reference is a type of its own."""
    if prop.get("$ref") is not None:
        return [f"$ref:{prop['$ref']}"]
    if isinstance(prop.get("anyOf"), list):
        return sorted({t for member in prop["anyOf"] for t in types_of(member)})
    types = prop.get("type", [])
    return sorted(set(types if isinstance(types, list) else [types]))


def widens(old: list[str], new: list[str]) -> bool:
    """Whether new accepts every old type and differs; an integer is a number."""
    return old != new and all(t in new or (t == "integer" and "number" in new) for t in old)


def diff(old: dict, new: dict) -> dict:
    """added, dropped, widened, changed and breaking, of top-level properties."""
    a, b = old.get("properties") or {}, new.get("properties") or {}
    moved = [{"field": k, "from": types_of(a[k]), "to": types_of(b[k])} for k in a if k in b and types_of(a[k]) != types_of(b[k])]
    widened = [m for m in moved if widens(m["from"], m["to"])]
    changed = [m for m in moved if m not in widened]
    dropped = [k for k in a if k not in b]
    return {"added": [k for k in b if k not in a], "dropped": dropped, "widened": widened, "changed": changed, "breaking": bool(dropped or changed)}


def version_of(identifier: str) -> int | None:
    last = identifier.rsplit("/", 1)[-1]
    return int(last) if re.fullmatch("[0-9]+", last) else None


def is_absolute(url: str) -> bool:
    parts = urlsplit(url)
    return bool(parts.scheme and parts.hostname)


class UndeclaredAuthority(ValueError):
    """No origin says where identifiers live."""


class MissingBaseUri(UndeclaredAuthority):
    pass


class NonAbsoluteBaseUri(UndeclaredAuthority):
    pass


class UnresolvableRelativeId(UndeclaredAuthority):
    pass


def versioned_id(name: str, version: int, base_uri: str | bool | None) -> str | None:
    """<base>/<name>/<version>; None where base_uri is False; raises where it is unset or not absolute."""
    if base_uri is False:
        return None
    if base_uri in (None, ""):
        raise MissingBaseUri("base_uri is neither an origin nor False")
    if not is_absolute(str(base_uri)):
        raise NonAbsoluteBaseUri(str(base_uri))
    return f"{str(base_uri).rstrip('/')}/{name.strip('/')}/{version}"


def resolve_id(ref: str, base_uri: str | bool | None) -> str:
    """An identifier as given if it is absolute, else under base_uri; relative to itself where that is False."""
    if is_absolute(ref):
        return ref
    if base_uri is False:
        return ref.lstrip("/")
    if base_uri in (None, ""):
        raise UnresolvableRelativeId(ref)
    return f"{str(base_uri).rstrip('/')}/{ref.lstrip('/')}"


# The longest slug of a file name, the part of it that stays in front, and what stands for the rest.
SLUG, HEAD, ELISION = 100, 48, "--"


def artifact_name(identifier: str, cap: int = SLUG, head: int = HEAD, elision: str = ELISION) -> str:
    """The file name of a frozen document: a readable slug and the start of the identifier's hash."""
    slug = re.sub("[^A-Za-z0-9]+", "-", identifier).strip("-")
    if len(slug) > cap:
        slug = slug[:head] + elision + slug[len(slug) - (cap - head - len(elision)) :]
    return f"{slug}.{hashlib.sha256(identifier.encode()).hexdigest()[:16]}.schema.json"


class MisplacedMigration(ValueError):
    pass


def check_placement(schema: dict) -> None:
    """Renames are declared on root properties only; raises with a JSON pointer to any other."""
    for pointer, node, place in nodes(schema):
        if place == "schema" and MIGRATE_FROM in node and not re.fullmatch("/properties/[^/]*", pointer):
            raise MisplacedMigration(f"{MIGRATE_FROM} is for root properties only, not {pointer}/{MIGRATE_FROM}")


def references(node: Any) -> list[str]:
    """The absolute references in a document, in order, each once."""
    return list(dict.fromkeys(n["$ref"] for _, n, _ in nodes(node) if isinstance(n.get("$ref"), str) and "://" in n["$ref"]))


def unresolvable(document: dict, registry: dict[str, dict] | None = None) -> list[str]:
    """The absolute references of a document and of what it refers to that neither it nor the registry has."""
    made = bundle(document, registry)
    known = {d["$id"] for _, d, _ in nodes(made) if isinstance(d.get("$id"), str)} | set(made.get("$defs") or {})
    return [r for r in references(made) if r not in known]


def bundle(document: dict, registry: dict[str, dict] | None = None) -> dict:
    """document with all documents it refers to, directly or not, under $defs."""
    own = document.get("$defs") or {}
    by_id = (registry or {}) | {d["$id"]: d for d in own.values() if isinstance(d, dict) and "$id" in d}
    found: dict[str, dict] = {}
    waiting = references({k: v for k, v in document.items() if k != "$defs"})
    while waiting:
        ref = waiting.pop(0)
        if ref in by_id and ref not in found:
            found[ref] = by_id[ref]
            waiting += references(by_id[ref])
    rest = {k: v for k, v in document.items() if k != "$defs"}
    defs = own | found
    out = rest | ({"$defs": defs} if defs else {})
    return out if "$schema" in out else {"$schema": "https://json-schema.org/draft/2020-12/schema", **out}
