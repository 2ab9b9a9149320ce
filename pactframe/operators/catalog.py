"""Schema catalogs as DataFrames: rows (id, body, fingerprint) and joins over them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as p
from ..functions.shared import cut, cut_counting
from ..plans import schemas as s
from . import nodes


class RegistryConflict(ValueError):
    """An identifier is frozen with another structure."""


def catalog(spark: SparkSession, documents: list[dict]) -> DataFrame:
    rows = [(d.get("$id"), json.dumps(d, ensure_ascii=False), s.fingerprint(d)) for d in documents]
    return spark.createDataFrame(rows, "id string, body string, fingerprint string")


def of_bodies(bodies: DataFrame, body: str = "body") -> DataFrame:
    """A catalog from a column of documents as JSON texts; other columns stay. What is no JSON has neither id nor fingerprint."""
    identifier = F.try_variant_get(F.try_parse_json(body), "$['$id']", "string")
    digest = F.sha2(F.col(body), 256)
    prints = nodes.fingerprints(bodies.select(digest.alias("id"), F.col(body).alias("body")).dropDuplicates(["id"])).withColumnsRenamed({"id": "_digest", "fingerprint": "_fingerprint"})
    rows = bodies.select(F.struct(*bodies.columns).alias("_row"), digest.alias("_of"), identifier.alias("_id")).join(prints, F.col("_of") == F.col("_digest"), "left")
    kept = [F.col(f"_row.`{c}`") for c in bodies.columns if c not in ("id", "fingerprint")]
    return rows.select(*kept, F.col("_id").alias("id"), F.col("_fingerprint").alias("fingerprint")).withColumnRenamed(body, "body")


def version_of(identifier: Column) -> Column:
    return F.regexp_extract(identifier, "(?:^|/)([0-9]+)$", 1).try_cast("bigint")


def stem_of(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "/[0-9]+$", "")


def origin_of(url: Column) -> Column:
    """scheme://host[:port]; null for a URL without both."""
    host, protocol = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PROTOCOL"))
    return F.when(host.isNotNull() & protocol.isNotNull(), F.concat(protocol, F.lit("://"), F.regexp_extract(url, r"^[^:]+://(?:[^/@?#]*@)?([^/?#]*)", 1)))


def host_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def path_of(identifier: Column) -> Column:
    """An identifier's path without its outer slashes; a relative one is all path."""
    return F.btrim(F.coalesce(F.try_parse_url(identifier, F.lit("PATH")), identifier), F.lit("/"))


def artifact_name(identifier: Column, cap: int = 100, head: int = 48, elision: str = "--") -> Column:
    slug = F.btrim(F.regexp_replace(identifier, "[^A-Za-z0-9]+", "-"), F.lit("-"))
    tail = cap - head - len(elision)
    short = F.when(F.length(slug) > cap, F.concat(F.substring(slug, 1, head), F.lit(elision), F.right(slug, F.lit(tail)))).otherwise(slug)
    return F.concat(short, F.lit("."), F.substring(F.sha2(identifier, 256), 1, 16), F.lit(".schema.json"))


def register(frozen: DataFrame, new: DataFrame) -> DataFrame:
    """frozen with the documents of new whose identifier it lacks. The same structure again changes nothing; another raises.

    Documents are checked where they are; what comes to the driver is the first problem.
    """
    old = frozen.select("id", F.col("fingerprint").alias("was"))
    told = new.groupBy("id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).join(old, "id", "left")
    clashes = told.filter("a <> b OR a <> was").select("id", F.lit(None).cast("string").alias("problem"))
    message = F.concat(F.lit(f"{s.MIGRATE_FROM} is for root properties only, not "), "pointer")
    misplaced = nodes.misplaced(new.select("id", "body")).select("id", message.alias("problem"))
    nameless = new.filter("id IS NULL OR id = ''").select("id", F.lit("a frozen document needs an $id").alias("problem"))
    found = clashes.unionByName(misplaced).unionByName(nameless).first()
    if found and found["problem"]:
        raise s.MisplacedMigration(found["problem"]) if s.MIGRATE_FROM in found["problem"] else ValueError(found["problem"])
    if found:
        raise RegistryConflict(found["id"])
    return frozen.unionByName(new.dropDuplicates(["id"]).join(frozen, "id", "left_anti").select(*frozen.columns))


def chain(*tiers: DataFrame) -> DataFrame:
    """The tiers' rows by id, the first tier that has it winning; a column `tier` tells which. Combined before the shuffle."""
    rows = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    return rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), "tier").alias("_first")).select("id", "_first.*").select(*rows.columns)


def union_of_sources(*sources: DataFrame, key: str = "class_name", order: str | None = None) -> DataFrame:
    """Distinct keys of sources in order; the first source that has one keeps its slot: with `order`, a column of every source, the least of it there, as `slot`."""
    numbered = [t.select(key, F.lit(i).alias("source"), *([F.col(order).alias("slot")] if order else [])) for i, t in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, numbered)
    if not order:
        return rows.groupBy(key).agg(F.min("source").alias("source"))
    return rows.groupBy(key).agg(F.min(F.struct("source", "slot")).alias("first")).select(key, "first.source", "first.slot")


def versions(frozen: DataFrame, stem: str) -> DataFrame:
    found = frozen.filter(stem_of(F.col("id")) == stem).select(version_of(F.col("id")).alias("version"))
    return found.filter("version IS NOT NULL").distinct().orderBy("version")


def compare(mine: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Rows (key, status): missing from other, orphaned in other, drifted or same. A row without a fingerprint is there all the same."""
    a = mine.select(key, F.col("fingerprint").alias("a"), F.lit(True).alias("in_a"))
    b = other.select(key, F.col("fingerprint").alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "orphaned").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("drifted")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def drift(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows (id, status) of current's documents: checked, unfrozen, refreezable, drifted or unreadable.

    What differs in fingerprint, or has none, is judged by a join of both documents' nodes on their paths: a first version that
    only gained `default`, or any version that only lost `x-optional` of schemas, may be frozen again. A frozen copy that is
    no JSON counts as absent, and a current document that is none is unreadable. A document without an id is checked.
    """
    readable = F.try_parse_json("body").isNotNull()
    old = frozen.filter(readable).select("id", F.col("fingerprint").alias("b"), F.col("body").alias("old"), F.lit(True).alias("there"))
    joined = current.select("id", F.col("fingerprint").alias("a"), F.col("body").alias("new"), readable.alias("readable")).join(old, "id", "left")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("a").isNotNull()
    status = F.when(F.col("id").isNull(), "checked").when(~F.col("readable"), "unreadable").when(F.col("there").isNull(), "unfrozen").when(same, "checked")
    told = cut(joined.withColumn("status", status))
    apart = told.filter("status IS NULL")
    sides = [nodes.walk(apart.select("id", F.col(c).alias("body"))) for c in ("old", "new")]
    gained = (F.col("side") == "new") & (F.col("key") == "default")
    lost = (F.col("side") == "old") & (F.col("key") == s.OPTIONAL) & (F.col("inside") == "schema")
    every = lambda c: F.min(F.coalesce(c, F.lit(False)))
    found = nodes.differences(*sides).groupBy("id").agg(every(gained).alias("gained"), every(lost).alias("lost"))
    inert = (F.col("gained") & (version_of(F.col("id")) == 1)) | F.col("lost")
    judged = apart.drop("status").join(found, "id", "left").select("id", F.when(F.col("gained").isNull(), "checked").when(inert, "refreezable").otherwise("drifted").alias("status"))
    return told.filter("status IS NOT NULL").select("id", "status").unionByName(judged)


def properties(documents: DataFrame) -> DataFrame:
    """Rows (id, field, types) of the top-level properties of documents (id, body): types sorted and distinct, a reference a type of its own.

    Unions in unions are taken apart one level at a time until none is left.
    """
    found = F.try_variant_get(F.try_parse_json("body"), "$.properties", "map<string,variant>")
    level = documents.select("id", F.explode(found).alias("field", "v"))
    none = F.array().cast("array<string>")
    parts = []
    while True:
        v = F.col("v")
        ref, members, kind = F.try_variant_get(v, "$['$ref']", "string"), F.try_variant_get(v, "$.anyOf", "array<variant>"), F.try_variant_get(v, "$.type", "variant")
        names = F.coalesce(F.try_variant_get(kind, "$", "array<string>"), F.array_compact(F.array(p.text(kind))))
        union = ref.isNull() & members.isNotNull()
        level, unions = cut_counting(level, union)
        parts.append(level.select("id", "field", F.when(ref.isNotNull(), F.array(F.concat(F.lit("$ref:"), ref))).when(union, none).otherwise(names).alias("names")))
        if not unions:
            break
        level = level.filter(union).select("id", "field", F.explode(members).alias("v"))
    return reduce(DataFrame.unionByName, parts).groupBy("id", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("types"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (id, field, kind, from, to, breaking) of what two catalogs' documents of the same id differ in: added, dropped, widened, changed.

    Documents that only one of them has are no differences of fields and are left to `compare`.
    """
    both = old.select("id").join(new.select("id"), "id").distinct()
    sides = [properties(x.join(both, "id", "left_semi")) for x in (old, new)]
    a, b = (x.select("id", "field", F.col("types").alias(name)) for x, name in zip(sides, ("from", "to"), strict=True))
    wider = F.forall("from", lambda t: F.array_contains("to", t) | ((t == "integer") & F.array_contains("to", "number")))
    kind = F.when(F.col("from").isNull(), "added").when(F.col("to").isNull(), "dropped").when(wider, "widened").otherwise("changed")
    changed = a.join(b, ["id", "field"], "full_outer").filter(~F.col("from").eqNullSafe(F.col("to"))).withColumn("kind", kind)
    return changed.select("id", "field", "kind", "from", "to", F.col("kind").isin("dropped", "changed").alias("breaking"))


def freeze(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """The rows of current that are not frozen yet."""
    return current.filter("id IS NOT NULL").join(frozen, "id", "left_anti")


def path_collisions(written: DataFrame) -> DataFrame:
    """Paths that several classes would write, with the classes in order. written has path, class_name and n, their order."""
    groups = written.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "class_name"))).alias("g"))
    return groups.filter("size(g) > 1").select("path", F.transform("g", lambda x: x["class_name"]).alias("classes"))


def _swept(openings: dict[int, list[tuple[list[str], str]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by owner over rows (part, key, owner, n) in the order of their keys; rows with an owner are roots. openings has, by partition, the roots that are open where it begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, int] = {}
        stack: list[tuple[list[str], str]] | None = None
        for batch in batches:
            for part, key, owner, n in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "owner", "n"))):
                if stack is None:
                    stack = list(openings.get(part, ()))
                while stack and key[: len(stack[-1][0])] != stack[-1][0]:
                    stack.pop()
                if owner is not None:
                    stack.append((key, owner))
                else:
                    told = stack[-1][1] if stack else None
                    counts[told] = counts.get(told, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["owner", "files"])

    return run


def owners(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files counted by owner, the largest first; the longest root that a path lies under owns it, the first by name of several. A null path is nobody's: app.

    Roots and paths, split into directories, are sorted once by ranges: then all that lies under a root follows it. Each partition
    is read once with a stack of the roots that are open; those open where it begins are the known ones among the
    directories of its first key, which are as many as partitions times depth. No path is repeated for its directories, and no directory is a key.
    """
    found = roots.groupBy("root").agg(F.min("owner").alias("owner")).filter("root IS NOT NULL AND owner IS NOT NULL")
    counted = files.groupBy("path").agg(F.count("*").alias("n"))
    under = lambda c: F.split(c, "/").alias("key")
    rows = found.select(under("root"), "owner", F.lit(0).cast("bigint").alias("n")).unionByName(counted.filter("path IS NOT NULL").select(under("path"), F.lit(None).cast("string").alias("owner"), "n"))
    spread = cut(rows.repartitionByRange("key").sortWithinPartitions("key", F.col("owner").isNull()).withColumn("part", F.spark_partition_id()))
    heads = spread.groupBy("part").agg(F.min("key").alias("first"))
    above = heads.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.size("first")), lambda i: F.slice("first", 1, i))).alias("at"))
    known = spread.filter("owner IS NOT NULL").select("key", "owner").join(F.broadcast(above), F.col("key") == F.col("at"))  # partitions times depth
    openings: dict[int, list[tuple[list[str], str]]] = {}
    for r in known.select("part", "key", "owner").collect():
        openings.setdefault(r["part"], []).append((r["key"], r["owner"]))
    openings = {part: sorted(found, key=lambda x: len(x[0])) for part, found in openings.items()}
    swept = spread.select("part", "key", "owner", "n").mapInArrow(_swept(openings), "owner string, files bigint")
    nobody = counted.filter("path IS NULL").select(F.lit(None).cast("string").alias("owner"), F.col("n").alias("files"))
    total = swept.unionByName(nobody).groupBy(F.coalesce("owner", F.lit("app")).alias("owner")).agg(F.sum("files").alias("files"))
    return total.filter("files > 0").orderBy(F.desc("files"), "owner")
