"""What is done with a finished document: inline its references, hand it to OpenAPI, print it, name its file."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby
from typing import Any
from urllib.parse import urlsplit

from . import schemas as s

# The printed form's width and indent.
WIDTH, INDENT = 80, "    "
NAME = re.compile("[A-Za-z_][A-Za-z0-9_]*")


class NameCollision(ValueError):
    """Two definitions would be one component."""


def local_key(ref: str) -> str:
    """A key under $defs for a reference: its own, or an address's path with its slashes replaced."""
    if ref.startswith("#/$defs/"):
        return ref.removeprefix("#/$defs/")
    return (urlsplit(ref).path or ref).replace("/", "_").strip("_")


def _less(body: dict, *words: str) -> dict:
    return {k: v for k, v in body.items() if k not in words}


def dereference(document: dict, registry: dict[str, dict] | None = None) -> dict:
    """document with every known reference replaced by what it refers to, behind which its other keywords stand.

    What refers to itself stays a reference, to a definition kept under $defs.
    """
    own = document.get("$defs") or {}
    known = dict(registry or {}) | {f"#/$defs/{k}": d for k, d in own.items()} | {d["$id"]: d for d in own.values() if "$id" in d}
    kept: dict[str, str] = {}

    def inlined(body: dict, inside: frozenset[str]) -> Any:
        def instead(ref: str, beside: dict) -> dict:
            if ref not in known:
                return {"$ref": ref} | beside
            if ref in inside:
                kept.setdefault(local_key(ref), ref)
                return {"$ref": f"#/$defs/{local_key(ref)}"}
            return beside | inlined(_less(known[ref], "$id", "$schema", "$defs"), inside | {ref})

        return s.references_mapped(body, instead)

    out, defs = inlined(_less(document, "$defs"), frozenset()), {}
    while missing := [k for k in kept if k not in defs]:
        defs |= {k: inlined(_less(known[kept[k]], "$id", "$schema", "$defs"), frozenset()) for k in missing}
    return out | ({"$defs": defs} if defs else {})


@dataclass(frozen=True)
class Component:
    """A definition on its way to another document: its key, what identifies it, its name there."""

    key: str
    identity: str
    name: str
    body: dict

    @classmethod
    def of(cls, key: str, body: dict) -> Component:
        names = [n for n in (key, body.get("title")) if isinstance(n, str) and NAME.fullmatch(n)]
        return cls(key, body.get("$id", key), (names or [f"Schema_{hashlib.sha256(key.encode()).hexdigest()}"])[0], _less(body, "$id", "$schema"))

    @property
    def spellings(self) -> set[str]:
        return {self.key, self.identity, f"#/$defs/{s.escaped(self.key)}"}


def to_openapi(document: dict) -> dict:
    """document with its $defs as components/schemas and its references following them."""
    found = [Component.of(key, body) for key, body in (document.get("$defs") or {}).items()]
    at = {spelling: f"#/components/schemas/{c.name}" for c in found for spelling in c.spellings}

    def moved(body: Any) -> Any:
        return s.references_mapped(body, lambda ref, beside: {"$ref": at.get(ref, re.sub(r"^#/\$defs/", "#/components/schemas/", ref))} | {k: moved(v) for k, v in beside.items()})

    made = [(c.name, c.identity, moved(c.body)) for c in found]
    for name, same in groupby(sorted(made, key=lambda m: m[0]), key=lambda m: m[0]):
        if len({(identity, compact(body)) for _, identity, body in same}) > 1:
            raise NameCollision(name)
    return moved(_less(document, "$defs")) | ({"components": {"schemas": {name: body for name, _, body in made}}} if found else {})


def compact(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"))


@dataclass(frozen=True)
class Group:
    """Cells between brackets, each with a head. rows: a line each. flat: one line if it has room. fill: the same, else as many on a line as fit."""

    brackets: str
    cells: list[tuple[str, str | Group]]
    style: str

    @property
    def flat(self) -> str:
        return self.brackets[0] + ", ".join(head + (c if isinstance(c, str) else c.flat) for head, c in self.cells) + self.brackets[1]


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def grouped(value: Any) -> str | Group:
    if isinstance(value, dict) and value:
        return Group("{}", [(f"{json.dumps(str(k))}: ", grouped(v)) for k, v in value.items()], "rows")
    if not isinstance(value, list) or not value:
        return json.dumps(value)
    cells = [("", grouped(x)) for x in value]
    matrix = len(value) > 1 and all(isinstance(x, list) and len(x) > 1 for x in value)
    broken = matrix or any(isinstance(c, Group) and c.style == "rows" for _, c in cells)
    return Group("[]", cells, "rows" if broken else "fill" if all(map(_number, value)) else "flat")


class Page:
    """Lines of text; the last one is still open."""

    def __init__(self):
        self.lines = [""]

    def has_room(self, text: str) -> bool:
        return len(self.lines[-1]) + len(text) <= WIDTH

    def put(self, cell: str | Group, depth: int, then: str = "") -> None:
        """Writes cell, which `then` follows on the same line."""
        text = cell if isinstance(cell, str) else cell.flat + then if cell.style != "rows" else None
        if isinstance(cell, str) or (text and self.has_room(text)):
            self.lines[-1] += cell + then if isinstance(cell, str) else text
            return
        self.lines[-1] += cell.brackets[0]
        for left, (head, inner) in zip(range(len(cell.cells) - 1, -1, -1), cell.cells, strict=True):
            comma = "," if left else ""
            if cell.style == "fill" and self.lines[-1][-1] == "," and self.has_room(f" {inner}{comma}"):
                self.lines[-1] += f" {inner}{comma}"
            else:
                self.lines.append(INDENT * (depth + 1) + head)
                self.put(inner, depth + 1, comma)
        self.lines.append(INDENT * depth + cell.brackets[1] + then)


def pretty(value: Any) -> str:
    """The canonical printed form: four spaces, objects one member a line, lists on one line up to 80 columns."""
    page = Page()
    page.put(grouped(value), 0)
    return "\n".join(page.lines) + "\n"


def output_path(name: str, folder: str, structure: str | Callable[[str, str], str] = "namespace") -> str:
    """Where a type's document is written: by its dotted name, flat by its short name, or as a function says."""
    if callable(structure):
        return structure(name, folder)
    return f"{folder}/{name.rsplit('.', 1)[-1] if structure == 'flat' else name.replace('.', '/')}.schema.json"


def served(document: dict | None, if_none_match: str | None = None, cache: str = "public, max-age=31536000, immutable") -> tuple[int, dict[str, str], str]:
    """Status, headers and body of the answer to a request for a document by its $id."""
    if document is None:
        return 404, {"Cache-Control": "no-store"}, ""
    body = json.dumps(document, ensure_ascii=False, indent=4)
    tag = f'"{hashlib.sha256(body.encode()).hexdigest()}"'
    headers = {"Content-Type": "application/schema+json", "Cache-Control": cache, "ETag": tag}
    unchanged = if_none_match is not None and (if_none_match.strip() == "*" or tag in [x.strip().removeprefix("W/") for x in if_none_match.split(",")])
    return (304, headers, "") if unchanged else (200, headers, body)
