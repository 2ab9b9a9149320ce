"""A write-once store of documents: a log of commits, each a Parquet table that appears whole or not at all.

A commit is staged under its own name and then renamed to the next number of the log. The file system refuses a rename
to a name that is taken, so of two writers one comes second, reads what the first one added, leaves out what is there by now
(or raises where it is there with another structure) and takes the next number. Freezing the same documents again
adds nothing, so a batch that runs twice, as under `foreachBatch`, leaves one copy.
"""

from __future__ import annotations

import errno
import os
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..operators import catalog

COLUMNS = "id string, body string, fingerprint string"
HOST = "app"


class FreezeRefused(ValueError):
    """A versioned document changed without a new version."""


@dataclass(frozen=True)
class Frozen:
    """What a freeze did: the number of its commit (None where nothing was new) and rows (id, owner, action)."""

    commit: int | None
    report: DataFrame


class Log:
    """Numbered tables under a folder that the driver and all executors share; a number is taken once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.folder, *parts]))

    def commits(self) -> list[int]:
        """The numbers of the log, in order."""
        top = self._path("commits")
        fs = top.getFileSystem(self._conf)
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n) for n in names if re.fullmatch("[0-9]{20}", n))

    def append(self, rows: DataFrame) -> int:
        """Adds a table, whatever the others hold; its number."""
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        while not self._published(staged, number := max(self.commits(), default=-1) + 1):
            pass
        return number

    def numbered(self, schema: str) -> DataFrame:
        """The rows of all tables with the number of theirs as `_commit`."""
        paths = [f"{self.folder}/commits/{n:020d}" for n in self.commits()]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, _commit bigint")
        number = F.regexp_extract(F.col("_metadata.file_path"), "/commits/([0-9]{20})/", 1).cast("bigint")
        return self.spark.read.schema(schema).parquet(*paths).withColumn("_commit", number)

    def _published(self, staged: str, number: int) -> bool:
        """Whether the staged table became commit `number`; False where another writer took it."""
        target = self._path("commits", f"{number:020d}")
        uri = target.getFileSystem(self._conf).getUri()
        context = self._hadoop.FileContext.getFileContext(uri, self._conf)
        context.mkdir(self._path("commits"), self._hadoop.permission.FsPermission.getDirDefault(), True)
        if uri.getScheme() == "file":  # where Hadoop looks first and then renames, and moves a folder into one that came between
            try:
                os.rename(self._hadoop.Path(staged).toUri().getPath(), target.toUri().getPath())
            except OSError as e:
                if e.errno in (errno.ENOTEMPTY, errno.EEXIST):
                    return False
                raise
            return True
        options = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = getattr(self._hadoop, "Options$Rename").NONE
        try:
            context.rename(self._hadoop.Path(staged), target, options)
        except Exception:
            if context.util().exists(target):
                return False
            raise
        return True


class Store(Log):
    """Documents (id, body, fingerprint), each frozen once."""

    def read(self, upto: int | None = None) -> DataFrame:
        """The documents of all commits, or of those before `upto`."""
        paths = [f"{self.folder}/commits/{n:020d}" for n in self.commits() if upto is None or n < upto]
        return self.spark.read.schema(COLUMNS).parquet(*paths) if paths else self.spark.createDataFrame([], COLUMNS)

    def versions(self, stem: str) -> list[int]:
        return [r["version"] for r in catalog.versions(self.read(), stem).collect()]

    def put(self, documents: DataFrame) -> int | None:
        """Adds documents (id, body, fingerprint) whose id is new, in one commit; its number, or None where none is new.

        Raises RegistryConflict where an id is there, or comes twice, with another fingerprint, and for misplaced renames.
        """
        documents = cut(documents.select("id", "body", "fingerprint"))
        while True:
            number = max(self.commits(), default=-1) + 1
            before = self.read(number)
            new = catalog.register(before, documents).join(before.select("id"), "id", "left_anti")
            staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
            new.select("id", "body", "fingerprint").write.parquet(staged)
            if not self.spark.read.schema(COLUMNS).parquet(staged).isEmpty():
                if self._published(staged, number):
                    return number
            self._path("staged").getFileSystem(self._conf).delete(self._hadoop.Path(staged), True)
            if number > max(self.commits(), default=-1):
                return None

    def freeze(self, current: DataFrame, scope: str = HOST, dry_run: bool = False, owner: str = "owner") -> Frozen:
        """Freezes what current (id, body, fingerprint, owner) has unfrozen in a scope: an owner, the host's own (app) or all.

        Everything is checked, whatever the scope; nothing is written where any document drifted. The report names what was
        frozen (would be, in a dry run) and what is out of scope. Documents without an owner are the host's.
        """
        statuses = cut(catalog.drift(current, self.read()))
        drifted = statuses.filter("status = 'drifted'").orderBy("id")
        if first := drifted.first():
            raise FreezeRefused(f"{drifted.count()} drifted, the first is {first['id']}: a new version comes first")
        owned = current.select("id", "body", "fingerprint", F.coalesce(owner, F.lit(HOST)).alias("owner"))
        unfrozen = cut(owned.join(statuses.filter("status = 'unfrozen'").select("id").distinct(), "id", "left_semi"))
        within = F.lit(True) if scope == "all" else F.col("owner") == scope
        action = F.when(within, "would freeze" if dry_run else "frozen").otherwise("out of scope")
        report = unfrozen.select("id", "owner", action.alias("action")).distinct()
        return Frozen(None if dry_run else self.put(unfrozen.filter(within)), report)

    def freeze_version(self, current: DataFrame, identifier: str) -> int | None:
        """Freezes one document of current; None where it is frozen with the same structure."""
        found = current.filter(F.col("id") == identifier)
        if found.isEmpty():
            raise KeyError(identifier)
        return self.put(found)

    def check(self, current: DataFrame) -> DataFrame:
        """Rows (id, status) of current's documents against the store."""
        return catalog.drift(current, self.read())

    def batch(self, bodies: DataFrame, number: int | None = None, body: str = "body") -> None:
        """Freezes a micro-batch of bodies; for `writeStream.foreachBatch`. A batch that comes again changes nothing."""
        documents = catalog.of_bodies(bodies.select(F.col(body).alias("body")))
        self.put(documents.filter("id IS NOT NULL"))
