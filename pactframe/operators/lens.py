"""Reversible projections, get and put, and the certification of their round trips over evidence frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as p
from ..functions.shared import cut
from ..sources import store


def canonical(v: Column) -> Column:
    """A payload as text in which the order of keys does not matter."""
    return p.to_json(v)


@dataclass(frozen=True)
class Lens:
    """get: payload to rendering. put: (rendering, prior payload, complement) to payload. complement: prior to what get loses.

    A lens with private state has two more: private is what a rendering holds that no payload does, and restore puts it back on a
    rendering that get made.
    """

    key: str
    get: Callable[[Column], Column] = lambda v: v
    put: Callable[[Column, Column, Column | None], Column] = lambda v, prior, complement: v
    complement: Callable[[Column], Column] | None = None
    tier: str = "transform"
    declared_lossy: bool = False
    id: str | None = None
    private: Callable[[Column], Column] | None = None
    restore: Callable[[Column, Column], Column] | None = None

    def put_back(self, rendering: Column, prior: Column, stored: Column | None = None) -> Column:
        kept = stored if stored is not None else self.complement(prior) if self.complement else None
        return self.put(rendering, prior, kept)

    def get_put(self, prior: Column) -> Column:
        return canonical(self.put_back(self.get(prior), prior)) == canonical(prior)

    def put_get(self, rendering: Column, prior: Column) -> Column:
        return canonical(self.get(self.put_back(rendering, prior))) == canonical(rendering)

    def certify(self, evidence: DataFrame, prior: str, rendering: str) -> DataFrame:
        """One row: fidelity, lossless if there is evidence and both laws hold on all of it; else lossy."""
        laws = F.coalesce(self.get_put(F.col(prior)), F.lit(False)) & F.coalesce(self.put_get(F.col(rendering), F.col(prior)), F.lit(False))
        lossless = F.coalesce(F.bool_and(laws), F.lit(False)) & ~F.lit(self.declared_lossy)
        return evidence.agg(F.when(lossless, "lossless").otherwise("lossy").alias("fidelity"), F.count("*").alias("samples"))


class Kept:
    """What renderings lose between runs, by key, in a log of tables: the newest of a key counts.

    A run of `put` adds one table with the complement of every payload and the private state of every rendering that comes in;
    a later run of `get` joins the newest by key. Complements are folded by key before they are shuffled. A batch of a stream
    that comes again adds the same rows again, which changes nothing (`foreachBatch`).
    """

    SCHEMA = "key string, complement string, private string"

    def __init__(self, lens: Lens, log: store.Log):
        self.lens, self.log = lens, log

    def newest(self) -> DataFrame:
        """Rows (key, complement, private: JSON texts), one for each key."""
        last = F.max_by(F.struct("complement", "private"), F.struct("_commit", "complement", "private"))
        return self.log.numbered(self.SCHEMA).groupBy("key").agg(last.alias("kept")).select("key", "kept.*")

    def _joined(self, rows: DataFrame, key: str) -> DataFrame:
        found = self.newest().withColumnRenamed("key", "_key")
        return rows.select(F.struct(*rows.columns).alias("_row"), F.col(key).cast("string").alias("_of")).join(found, F.col("_of") == F.col("_key"), "left")

    def get(self, rows: DataFrame, key: str, payload: str, into: str = "rendering") -> DataFrame:
        """rows with the rendering of each payload, with the private state that its key kept."""
        made = self.lens.get(F.col(f"_row.`{payload}`"))
        if self.lens.restore:
            state = p.from_json(F.col("private"))
            made = F.when(state.isNull(), made).otherwise(self.lens.restore(made, state))
        return self._joined(rows, key).select(*[F.col(f"_row.`{c}`") for c in rows.columns if c != into], made.alias(into))

    def put(self, rows: DataFrame, key: str, rendering: str, prior: str, into: str = "payload") -> DataFrame:
        """rows with the payload that each rendering gives, from its prior payload or, where that is null, from what its key kept; keeps what the rendering has of its own."""
        held = self._joined(rows, key)
        view, before = F.col(f"_row.`{rendering}`"), F.col(f"_row.`{prior}`")
        stored = p.from_json(F.col("complement"))
        derived = self.lens.complement(before) if self.lens.complement else F.lit(None).cast(p.MAP)
        kept = F.when(before.isNull(), stored).otherwise(derived)
        told = lambda c: p.to_json(c) if c is not None else F.lit(None).cast("string")
        made = held.select("_row", "_of", self.lens.put(view, before, kept).alias("_made"), told(kept).alias("_kept"), told(self.lens.private(view) if self.lens.private else None).alias("_private"))
        made = cut(made)
        self.log.append(made.filter("_of IS NOT NULL").select(F.col("_of").alias("key"), F.col("_kept").alias("complement"), F.col("_private").alias("private")))
        return made.select(*[F.col(f"_row.`{c}`") for c in rows.columns if c != into], F.col("_made").alias(into))


class LensRegistry:
    """Lenses by key; a key is registered once and has no slash."""

    def __init__(self):
        self._lenses: dict[str, Lens] = {}

    def register(self, lens: Lens) -> None:
        if "/" in lens.key or lens.key in self._lenses:
            raise ValueError(f"the key {lens.key} is taken or has a slash")
        self._lenses[lens.key] = lens

    def get(self, key: str) -> Lens | None:
        return self._lenses.get(key)

    def all(self) -> list[Lens]:
        return list(self._lenses.values())

    def for_id(self, identifier: str) -> list[Lens]:
        """All lenses of the schema with this identifier, in the order they were registered."""
        return [x for x in self._lenses.values() if x.id == identifier]

    def fidelity(self, key: str, evidence: DataFrame, prior: str, rendering: str) -> str:
        """lossless or lossy by evidence; a key that is not registered is lossy."""
        found = self.get(key)
        return "lossy" if found is None else found.certify(evidence, prior, rendering).first()["fidelity"]

    def describe(self, evidence: dict[str, DataFrame], prior: str = "prior", rendering: str = "rendering") -> list[dict]:
        """A row for each lens: key, id, tier and what its evidence certifies; lossy without evidence."""
        told = {k: self.fidelity(k, df, prior, rendering) for k, df in evidence.items() if k in self._lenses}
        return [{"key": x.key, "id": x.id, "tier": x.tier, "fidelity": told.get(x.key, "lossy")} for x in self._lenses.values()]

    def of_tier(self, tier: str) -> list[Lens]:
        return [x for x in self._lenses.values() if x.tier == tier]
