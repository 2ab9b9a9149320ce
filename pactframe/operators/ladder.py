"""Migration and projection ladders over payload columns: the first rung whose candidate the gate accepts wins.

A ladder is compiled once into native column expressions (MAP<STRING, VARIANT> in, struct out), so batch and
streaming frames run it alike and no row leaves the JVM. Rungs in Python run as a second pass over the rows
that no native rung settled.
"""

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gate
from ..functions import payload as p
from ..plans import schemas as s

RESULT = ["original", "migrated", "quarantined", "rung", "confidence"]


def empty_for(prop: dict) -> Any:
    """The typed empty: of a union's first type that is not null."""
    types = prop.get("type")
    types = types if isinstance(types, list) else [types]
    first = next((t for t in types if t != "null"), None)
    value = p.EMPTY.get(first)
    return type(value)() if isinstance(value, (list, dict)) else value


def filler(prop: dict) -> Any:
    return prop["default"] if "default" in prop else empty_for(prop)


def _renames(target: dict) -> dict[str, str]:
    return {k: v[s.MIGRATE_FROM] for k, v in (target.get("properties") or {}).items() if isinstance(v.get(s.MIGRATE_FROM), str) and v[s.MIGRATE_FROM]}


def structural(stored: Column, old: dict, new: dict) -> Column:
    """Drops, fills what is added, keeps the rest; null where a declared rename's old key is present."""
    added = s.diff(old, new)["added"]
    props = new.get("properties") or {}
    out = F.map_concat(p.only(stored, [k for k in props if k not in added]), p.literal_map({k: filler(props[k]) for k in added}))
    pending = [p.has(stored, old_key) for old_key in _renames(new).values()]
    return F.when(~F.greatest(*pending, F.lit(False)), out) if pending else out


def declared(stored: Column, old: dict, new: dict) -> Column | None:
    """All declared renames at once, from the stored payload, then as `structural`; a rename without its old key fills nothing."""
    renames = _renames(new)
    if not renames:
        return None
    added, props = s.diff(old, new)["added"], new.get("properties") or {}
    leaving = set(renames.values())
    kept = [k for k in props if k not in renames and k not in added and k not in leaving]
    parts = [p.only(stored, kept), p.literal_map({k: filler(props[k]) for k in added if k not in renames})]
    for new_key, old_key in renames.items():
        stays = p.only(stored, [] if new_key in leaving else [new_key])
        parts.append(F.when(p.has(stored, old_key), F.create_map(F.lit(new_key), p.get(stored, old_key))).otherwise(stays))
    return F.map_concat(*parts)


def sources(target: dict) -> dict[str, dict]:
    """The valid source declarations by field; an unknown cast makes one invalid."""
    found = {k: v[s.SOURCE] for k, v in (target.get("properties") or {}).items() if isinstance(v.get(s.SOURCE), dict)}
    return {k: x for k, x in found.items() if isinstance(x.get("path"), str) and ("cast" not in x or x["cast"] in p.CASTS)}


def projected(foreign: Column, target: dict) -> Column | None:
    """A foreign VARIANT as target's fields: from their source paths, else from defaults."""
    declared_sources, entries = sources(target), []
    if not declared_sources:
        return None
    for key, prop in target["properties"].items():
        if key in declared_sources:
            spec = declared_sources[key]
            value = p.path(foreign, spec["path"])
            cast = p.cast(spec["cast"], value) if spec.get("cast") else value
            missing = value.isNull() | (p.kind(value) == "null")
            entries.append((key, F.when(missing, p.literal(spec.get("default"))).otherwise(cast)))
        else:
            entries.append((key, p.literal(filler(prop))))
    return F.create_map(*[x for key, value in entries for x in (F.lit(key), value)])


@dataclass
class Transforms:
    """Custom transforms by version pair or by name; the last registration wins.

    Each maps a payload column to one, or is `in_python`: a function of a record as a dict, whose results go to the gate the same way.
    """

    pairs: dict = field(default_factory=dict)
    names: dict = field(default_factory=dict)

    def for_pair(self, old_id: str, new_id: str, transform: Callable) -> "Transforms":
        self.pairs[old_id, new_id] = transform
        return self

    def named(self, name: str, transform: Callable) -> "Transforms":
        self.names[name] = transform
        return self

    @staticmethod
    def in_python(function: Callable[[dict], dict | None]) -> Callable[[Column], Column]:
        """A transform from a Python function of one record; it runs in Arrow batches of JSON texts. None abstains."""
        made = _proposals(PythonRung("", lambda record, old, new: function(record)), {}, {})
        return lambda stored: p.from_json(made(p.to_json(stored)))

    def find(self, old: dict, new: dict) -> Callable | None:
        """The pair's, else that of the first registered name among the target's pins other than llm."""
        pins = [v.get(s.MIGRATE) for v in (new.get("properties") or {}).values()]
        pair = self.pairs.get((old.get("$id"), new.get("$id")))
        return pair or next((self.names[n] for n in pins if n in self.names and n != "llm"), None)


@dataclass(frozen=True)
class Rung:
    """propose(payload, old, new) gives a candidate column, None to abstain. confidence is passed on."""

    name: str
    propose: Callable[[Column, dict, dict], Column | None]
    confidence: float = 1.0


@dataclass(frozen=True)
class PythonRung:
    """propose(payload as a dict, old, new) gives a dict or None; it runs on rows that native rungs leave over."""

    name: str
    propose: Callable[[dict, dict, dict], dict | None]
    confidence: float = 1.0


def custom(transforms: Transforms | None) -> Rung:
    def propose(stored: Column, old: dict, new: dict) -> Column | None:
        found = transforms.find(old, new) if transforms else None
        return found(stored) if found else None

    return Rung("custom-transform", propose)


def llm_try(migrator: Callable[[dict, dict, dict], dict | None], confidence: float = 1.0) -> PythonRung:
    """The seam for a model: only for targets with a property pinned to llm. No model comes with the package."""
    def propose(stored: dict, old: dict, new: dict) -> dict | None:
        return migrator(stored, old, new) if any(v.get(s.MIGRATE) == "llm" for v in new["properties"].values()) else None

    return PythonRung("llm-try", propose, confidence)


def _proposals(rung: PythonRung, old: dict, new: dict) -> Callable[[Column], Column]:
    """The rung's proposals for payloads as JSON texts."""
    @F.pandas_udf("string")
    def propose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            made = [rung.propose(json.loads(x), old, new) if x is not None else None for x in batch]
            yield pd.Series([None if m is None else json.dumps(m) for m in made], dtype=object)

    return propose


@dataclass(frozen=True)
class Ladder:
    steps: tuple[Rung | PythonRung, ...]
    formats: bool = False
    #: A second predicate on candidates, (schema, payload column) to a boolean column.
    also: Callable[[dict, Column], Column] | None = None

    @classmethod
    def default(cls, transforms: Transforms | None = None, **options) -> "Ladder":
        return cls((Rung("structural", structural), Rung("declared-mapping", declared), custom(transforms)), **options)

    def with_rungs(self, *rungs: Rung | PythonRung) -> "Ladder":
        return replace(self, steps=(*self.steps, *rungs))

    def rungs(self) -> list[str]:
        return [r.name for r in self.steps]

    def _accepts(self, new: dict, candidate: Column) -> Column:
        ok = gate.accepts(new, candidate, self.formats)
        return ok & self.also(new, candidate) if self.also else ok

    def _result(self, stored: Column, candidates: list[tuple[Rung | PythonRung, Column]], new: dict) -> Column:
        def row(migrated: Column, rung: Column, confidence: float) -> Column:
            return F.struct(stored.alias("original"), migrated.alias("migrated"), F.lit(rung is None).alias("quarantined"), F.lit(rung).alias("rung"), F.lit(confidence).alias("confidence"))

        out = row(F.lit(None).cast(p.MAP), None, 0.0)
        for rung, candidate in reversed(candidates):
            out = F.when(self._accepts(new, candidate), row(candidate, rung.name, rung.confidence)).otherwise(out)
        return out

    def _settled(self, df: DataFrame, stored: Column, proposals: list[tuple[Rung | PythonRung, Column]], new: dict, into: str) -> DataFrame:
        """df with the column `into`. Candidates are columns for a while: the gate names each many times and it is computed once."""
        made = {f"_candidate_{k}_of_{into}": c for k, (_, c) in enumerate(proposals)}
        held = df.withColumns(made | {f"_stored_of_{into}": stored})
        result = self._result(F.col(f"_stored_of_{into}"), [(rung, F.col(name)) for (rung, _), name in zip(proposals, made, strict=True)], new)
        return held.withColumn(into, result).drop(*made, f"_stored_of_{into}")

    def migrate(self, df: DataFrame, column: str, old: dict, new: dict, into: str = "result") -> DataFrame:
        """df with a struct column of RESULT; column is a payload."""
        native = [(r, c) for r in self.steps if isinstance(r, Rung) and (c := r.propose(F.col(column), old, new)) is not None]
        settled = self._settled(df, F.col(column), native, new, into)
        rest = [r for r in self.steps if isinstance(r, PythonRung)]
        return self._in_python(settled, column, old, new, into, rest) if rest else settled

    def _in_python(self, df: DataFrame, column: str, old: dict, new: dict, into: str, rest: list[PythonRung]) -> DataFrame:
        for k, rung in enumerate(rest):
            own, made = df.columns, f"_made_{k}"
            left = df.filter(F.col(f"{into}.quarantined")).withColumn(made, _proposals(rung, old, new)(p.to_json(F.col(column))))
            tried = self._settled(left.drop(into), F.col(column), [(rung, p.from_json(F.col(made)))], new, into)
            df = df.filter(~F.col(f"{into}.quarantined")).unionByName(tried.select(*own))
        return df

    def project(self, df: DataFrame, column: str, target: dict, into: str = "result", transforms: Transforms | None = None) -> DataFrame:
        """Foreign VARIANTs into target, which must have an $id; original is the foreign object as a payload."""
        if not target.get("$id"):
            raise ValueError("a projection's target needs an $id")
        foreign, stored = F.col(column), p.as_map(F.col(column))
        candidates = [(Rung("source-projection", structural), projected(foreign, target)), (custom(transforms), custom(transforms).propose(stored, {}, target))]
        return self._settled(df, stored, [(r, c) for r, c in candidates if c is not None], target, into)


def migrate_versions(df: DataFrame, column: str, id_column: str, schemas: dict[str, dict], new: dict, ladder: Ladder) -> DataFrame:
    """Records of several versions in one frame: each version, by the identifier in id_column, has its own plan."""
    parts = [ladder.migrate(df.filter(F.col(id_column) == i), column, old, new) for i, old in schemas.items()]
    known = F.coalesce(F.col(id_column).isin(list(schemas)), F.lit(False))
    parts.append(df.filter(~known).withColumn("result", ladder._result(F.col(column), [], new)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
