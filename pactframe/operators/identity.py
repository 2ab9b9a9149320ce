"""References to documents, resolved as columns: grammars in order, the absolute or relative one last."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import payload as p
from ..plans import schemas as s

#: What is cut off both ends of a reference.
WHITE = " \t\n\r\0\x0b"
Authority = str | bool | None


@dataclass(frozen=True)
class Grammar:
    """How references of one spelling are told (of the reference alone) and resolved under an authority; a null result is unresolvable."""

    handles: Callable[[Column], Column]
    parse: Callable[[Column, Authority], Column]


def is_absolute(url: Column) -> Column:
    """Whether a text has a scheme and a host."""
    part = lambda name: F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit("")) != ""
    return F.coalesce(part("HOST") & part("PROTOCOL"), F.lit(False))


def plain(ref: Column, base_uri: Authority) -> Column:
    """An absolute reference as it is; else under base_uri, or relative to itself where that is False; null without an absolute authority."""
    told = F.btrim(ref, F.lit(WHITE))
    inside = F.regexp_replace(told, "^/+", "")
    if base_uri is False:
        under = inside
    elif isinstance(base_uri, str) and s.is_absolute(base_uri.strip(WHITE)):
        under = F.concat(F.lit(base_uri.strip(WHITE).rstrip("/") + "/"), inside)
    else:
        under = F.lit(None).cast("string")
    return F.when(is_absolute(told), told).otherwise(under)


def resolved(ref: Column, base_uri: Authority, grammars: Sequence[Grammar] = ()) -> Column:
    """A struct (id, grammar, problem): the first grammar in order that handles the reference resolves it, the plain one where none does.

    grammar is its number, -1 for the plain one. What needs an authority that is not declared has a problem and no id; a null reference has neither.
    """
    found, which = plain(ref, base_uri), F.lit(-1)
    for i, g in reversed(list(enumerate(grammars))):
        mine = F.coalesce(g.handles(ref), F.lit(False))
        found, which = F.when(mine, g.parse(ref, base_uri)).otherwise(found), F.when(mine, i).otherwise(which)
    problem = F.when(ref.isNotNull() & found.isNull(), F.concat(F.lit("no authority is declared for "), ref))
    return F.struct(F.when(ref.isNotNull(), found).alias("id"), F.when(ref.isNotNull(), which).alias("grammar"), problem.alias("problem"))


def without_relative_id(document: Column) -> Column:
    """A document, a VARIANT, without a `$id` that is not absolute: validators refuse those."""
    named = p.get(p.as_map(document), "$id")
    relative = (p.kind(named) == "string") & ~p.text(named).contains("://")
    return F.when(F.coalesce(relative, F.lit(False)), F.to_variant_object(F.map_filter(p.as_map(document), lambda k, _: k != "$id"))).otherwise(document)
