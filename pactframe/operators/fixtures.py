"""Fixtures: rows made from a schema's examples, named states and a cycling sequence, as columns over spark.range."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gate
from ..functions import payload as p

#: A state: fixed values, or a payload column from the one built so far.
State = dict[str, Any] | Callable[[Column], Column]


class UnknownState(ValueError):
    pass


def examples_of(schema: dict) -> dict[str, Any]:
    """The first example of each property that has one."""
    return {k: v["examples"][0] for k, v in (schema.get("properties") or {}).items() if v.get("examples")}


def state_name(key: str) -> str:
    """Camel case and underscores as lower case with hyphens."""
    return re.sub("(?<=[a-z0-9])(?=[A-Z])", "-", key.replace("_", "-")).lower()


class Fixtures:
    """Shapes with their defaults and hooks, and their states; what is defined again supersedes."""

    def __init__(self):
        self.shapes: dict[str, tuple[dict | None, tuple[State, ...], dict | None]] = {}
        self.states: dict[str, dict[str, State]] = {}

    def shape(self, name: str, defaults: dict | None = None, hooks: tuple[State, ...] = (), schema: dict | None = None) -> Fixtures:
        self.shapes[name] = (defaults, hooks, schema)
        return self

    def state(self, shape: str, name: str, values: State) -> Fixtures:
        self.states.setdefault(shape, {})[state_name(name)] = values
        return self

    def load(self, spark: SparkSession, shape: str, folder: str) -> Fixtures:
        """States from a folder's *.json files, named by them, in order. None is registered unless all are JSON objects."""
        read = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
        found = {}
        for row in read.orderBy("f").collect():  # hand-written files
            try:
                values = json.loads(row["value"])
            except ValueError as error:
                raise ValueError(f"{row['f']} is not valid JSON") from error
            if not isinstance(values, dict):
                raise ValueError(f"{row['f']} must be a JSON object")
            found[row["f"].removesuffix(".json")] = values
        for name, values in found.items():
            self.state(shape, name, values)
        return self

    def verify(self, spark: SparkSession, shape: str) -> DataFrame:
        """Rows (state, accepted): whether a state's own values, with no defaults or hooks, pass the shape's schema."""
        schema = self.shapes[shape][2] or {}
        rows = [(n, json.dumps(v)) for n, v in self.states.get(shape, {}).items() if isinstance(v, dict)]
        return spark.createDataFrame(rows, "state string, j string").select("state", gate.accepts(schema, p.from_json(F.col("j"))).alias("accepted"))

    def factory(self, shape: str) -> Factory:
        return Factory(self, shape)


def _over(payload: Column, values: State) -> Column:
    """payload with the values of a state in place of its own, key by key."""
    new = values(payload) if callable(values) else p.literal_map(values)
    return F.map_concat(F.map_filter(payload, lambda k, _: ~F.map_contains_key(new, k)), new)


@dataclass(frozen=True)
class Factory:
    """Later wins: defaults, states, the sequence's turn, overrides, then hooks."""

    index: Fixtures
    shape: str
    states: tuple[State, ...] = ()
    turns: tuple[dict, ...] = ()
    overrides: dict = field(default_factory=dict)
    n: int = 1

    def state(self, state: str | State, **overrides: Any) -> Factory:
        if isinstance(state, str):
            known = self.index.states.get(self.shape, {})
            if state_name(state) not in known:
                raise UnknownState(f"{self.shape} has no state {state}; it has {', '.join(known) or 'none'}")
            state = known[state_name(state)]
        return replace(self, states=(*self.states, state), overrides=self.overrides | overrides)

    def count(self, n: int) -> Factory:
        return replace(self, n=n)

    def sequence(self, *turns: dict) -> Factory:
        return replace(self, turns=turns)

    def raw(self, at: Column, **attributes: Any) -> Column:
        """The payload of the fixture at a place."""
        defaults, hooks, schema = self.index.shapes.get(self.shape, (None, (), None))
        built = p.literal_map(examples_of(schema or {}) if defaults is None else defaults)
        built = reduce(_over, self.states, built)
        if self.turns:
            turn = F.element_at(F.array(*map(p.literal_map, self.turns)), (F.pmod(at, F.lit(len(self.turns))) + 1).cast("int"))
            built = _over(built, lambda _: turn)
        return reduce(_over, [self.overrides | attributes, *hooks], built)

    def make(self, spark: SparkSession, **attributes: Any) -> DataFrame:
        """Rows (n, payload), one or as many as count says."""
        return spark.range(self.n).select(F.col("id").alias("n"), self.raw(F.col("id"), **attributes).alias("payload"))
