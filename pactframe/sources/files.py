"""Folders of documents as a data source: one file for each document, named by its identifier, written by tasks and found by name.

`register(spark)`, then `spark.read.format("documents").load(folder)` gives rows (id, path, body). A filter on id
opens only the file that the identifier's name gives. `df.write.format("documents").mode("append").save(folder)` takes rows (path, body): tasks
write beside the folder, and the commit moves everything in place only after it has seen that no path comes twice and none
is taken; an abort leaves nothing. The folder is a path that the driver and all executors mount.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..plans import schemas as s

#: Files that one task of a read opens.
FILES_EACH = 256


class PathCollision(ValueError):
    """Two documents have one path, or a path is taken."""


def _mounted(folder: str) -> str:
    return folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "id string, path string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_mounted(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("documents are written once: use mode append")
        return _Writer(_mounted(self.options["path"]), schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.ids = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the identifiers that are asked for; the filters themselves stay with Spark, which checks the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = asked if self.ids is None else self.ids & asked
            yield f

    def partitions(self) -> list[_Files]:
        if self.ids is not None:
            names = sorted(s.artifact_name(i) for i in self.ids if isinstance(i, str))
        else:
            names = sorted(os.path.relpath(os.path.join(d, f), self.folder) for d, _, found in os.walk(self.folder) for f in found if f.endswith(".json"))
        return [_Files(names[i : i + FILES_EACH]) for i in range(0, len(names), FILES_EACH)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple[str | None, str, str]]:
        for name in partition.names:
            try:
                with open(os.path.join(self.folder, name), encoding="utf-8") as f:
                    body = f.read()
                found = json.loads(body)
            except (FileNotFoundError, ValueError):
                continue  # what is no document is absent
            if isinstance(found, dict):
                yield found.get("$id") if isinstance(found.get("$id"), str) else None, name, body


@dataclass
class _Written(WriterCommitMessage):
    staged: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.at = folder.rstrip("/"), (names.index("path"), names.index("body"))
        self.stage = f"{self.folder}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        """A task's files, under a folder of its own, so that a second attempt does not meet the first one's."""
        mine, staged = os.path.join(self.stage, uuid.uuid4().hex), []
        os.makedirs(mine)
        for i, row in enumerate(iterator):
            path, body = (row[k] for k in self.at)
            inside = os.path.normpath(path or "")
            if not path or body is None or os.path.isabs(inside) or inside.split(os.sep)[0] == ".." or inside == ".":
                raise ValueError(f"no document can be written to {path!r}")
            with open(os.path.join(mine, str(i)), "w", encoding="utf-8") as f:
                f.write(body)
            staged.append((inside, os.path.join(mine, str(i))))
        return _Written(staged)

    def commit(self, messages: list[_Written | None]) -> None:
        moves: dict[str, str] = {}
        try:
            for path, staged in (x for m in messages if m is not None for x in m.staged):
                if path in moves or os.path.lexists(os.path.join(self.folder, path)):
                    raise PathCollision(path)
                moves[path] = staged
            done = []
            try:
                for path, staged in sorted(moves.items()):
                    target = os.path.join(self.folder, path)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    os.link(staged, target)  # fails where another writer was first
                    done.append(target)
            except OSError as e:
                for target in done:
                    os.unlink(target)
                raise PathCollision(str(e)) from e
        finally:
            shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)
