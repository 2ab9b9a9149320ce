"""Where record types and documents come from: modules, other sources, tables and folders."""

from __future__ import annotations

import fnmatch
import importlib
import json
import pkgutil
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..plans.projection import RecordType

Source = Callable[[], list[RecordType]]
Collector = Callable[[RecordType], bool]


def collectable(namespace: str | None = None) -> Collector:
    """Concrete types, and abstract ones that are unions, whose name matches a wildcard."""
    return lambda kind: (not kind.abstract or kind.union is not None) and (namespace is None or fnmatch.fnmatchcase(kind.name, namespace))


def _kept(kinds: Iterable[RecordType], collectors: Iterable[Collector]) -> list[RecordType]:
    tests = list(collectors)
    return [k for k in kinds if any(t(k) for t in tests)]


def explicit(kind: RecordType, collectors: Iterable[Collector] = (collectable(),)) -> Source:
    """One type, unless no collector takes it."""
    return lambda: _kept([kind], collectors)


def scan(*packages: str, collectors: Iterable[Collector] = (collectable(),)) -> Source:
    """The record types that modules of packages hold, in order of their names."""
    def found() -> list[RecordType]:
        kinds: dict[str, RecordType] = {}
        for package in packages:
            top = importlib.import_module(package)
            inside = [m.name for m in pkgutil.walk_packages(getattr(top, "__path__", []), f"{package}.")]
            for module in [top, *map(importlib.import_module, inside)]:
                kinds |= {v.name: v for v in vars(module).values() if isinstance(v, RecordType)}
        return _kept([kinds[n] for n in sorted(kinds)], collectors)

    return found


def of_tables(spark: SparkSession, folder: str, names: Iterable[str], version: int | None = None) -> Source:
    """The types that Parquet tables already declare."""
    return lambda: [RecordType(n, spark.read.parquet(f"{folder}/{n}.parquet").schema, version=version) for n in names]


class Sources:
    """Sources by key, asked when they are read. The same key supersedes and keeps its place; so does the first type of a name."""

    def __init__(self):
        self.by_key: dict[str, Source] = {}

    def register(self, key: str, source: Source) -> Sources:
        if source == self.types or not callable(source):
            raise ValueError(f"{key} is no source")
        self.by_key[key] = source
        return self

    def types(self) -> list[RecordType]:
        kinds: dict[str, RecordType] = {}
        for source in self.by_key.values():
            for kind in source():
                kinds.setdefault(kind.name, kind)
        return list(kinds.values())

    def versioned(self) -> list[RecordType]:
        """What drift is checked of: concrete types with a version."""
        return [k for k in self.types() if k.version is not None and not k.abstract]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON objects of a folder's *.json files as rows (path, body); others are absent."""
    read = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return read.filter(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"))


def frozen(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of frozen documents as a catalog, by the $id each one holds and not by its file's name."""
    rows = documents(spark, folder).orderBy("path").select("body").collect()  # a catalog: documents of a few KB
    return catalog.catalog(spark, [d for d in (json.loads(r["body"]) for r in rows) if d.get("$id")])


def package_folders(installed: str, base: str, folder: str = "src/Data") -> dict[str, str]:
    """Folders of record types by package, sorted, from an installer's list of packages and where they lie."""
    listed = json.loads(installed)
    packages = listed.get("packages", []) if isinstance(listed, dict) else listed
    return {p["name"]: f"{base}/{p['install-path'].strip('/')}/{folder}" for p in sorted(packages, key=lambda p: p["name"]) if p.get("install-path")}
