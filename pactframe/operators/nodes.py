"""Documents taken apart into a table of nodes, and what is put together from it: canonical texts, fingerprints, references, bundles.

A document is a row (id, body: JSON text). `walk` explodes all documents of a table one level at a time until no
container is left, so any depth is read; every node is a row with its path, its place (whether a schema, a map or a list
of schemas, or data stands there) and its token: `{`, `[` or a scalar as JSON. A canonical text is one sort of a
document's nodes; differences of documents are joins on paths. Bodies that are no JSON have no nodes.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as p
from ..functions.shared import cut, cut_counting, gathered, sent_if_small, spread
from ..plans import schemas as s

NULL = {"type": "null"}
DIALECT = "https://json-schema.org/draft/2020-12/schema"


def _present(m: Column, key: str) -> Column:
    """Whether key has a value other than null."""
    return F.coalesce(p.kind(p.get(m, key)) != "null", F.lit(False))


def _put(m: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def _list(items: Column) -> Column:
    return F.to_variant_object(items)


def _with_null(items: Column, null: object) -> Column:
    """A list that ends with null unless it has it."""
    told = F.to_json(F.to_variant_object(F.array(p.literal(null))))
    has = F.exists(items, lambda x: F.to_json(F.to_variant_object(F.array(x))) == told)
    return _list(F.when(has, items).otherwise(F.concat(items, F.array(p.literal(null)))))


def _wide_enum(m: Column) -> Column:
    values = p.as_array(p.get(m, "enum"))
    return F.when(values.isNotNull(), _put(m, "enum", _with_null(values, None))).otherwise(m)


def _null_type(m: Column) -> Column:
    types = p.get(m, "type")
    several = F.coalesce(p.as_array(types), F.array(types))
    return _put(m, "type", F.when(_present(m, "type"), _with_null(several, "null")).otherwise(p.literal("null")))


def folded(m: Column) -> Column:
    """An object's fields with a boolean `nullable` written as the type, enum or union that says the same (`schemas.fold_nullable`)."""
    says = F.when(p.kind(p.get(m, "nullable")) == "boolean", F.try_variant_get(p.get(m, "nullable"), "$", "boolean"))

    def written(rest: Column) -> Column:
        members = p.as_array(p.get(rest, "anyOf"))
        alone = F.create_map(F.lit("anyOf"), _list(F.array(F.to_variant_object(rest), p.literal(NULL))))
        reference = F.to_variant_object(F.create_map(F.lit("$ref"), p.get(rest, "$ref")))
        beside = F.map_filter(_wide_enum(rest), lambda k, _: k != "$ref")
        referred = F.when(p.has(beside, "anyOf"), beside).otherwise(F.map_concat(beside, F.create_map(F.lit("anyOf"), _list(F.array(reference, p.literal(NULL))))))
        united = _put(_wide_enum(rest), "anyOf", _with_null(members, NULL))
        return (
            F.when(_present(rest, "not"), alone).when(_present(rest, "$ref"), referred)
            .when(_present(rest, "anyOf") & members.isNotNull(), united).otherwise(_null_type(_wide_enum(rest)))
        )

    rest = F.map_filter(m, lambda k, _: k != "nullable")
    return F.when(says.isNull(), m).when(~says, rest).otherwise(p.let(rest, written))


#: Characters that are written in another way in a JSON text.
_ESCAPES = {'"': '\\"', "\\": "\\\\"} | {chr(c): {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(c, f"\\u{c:04x}") for c in range(32)}


def quoted(text: Column) -> Column:
    """A text as JSON, with no more escapes than are needed."""
    known = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    escaped = F.array_join(F.transform(characters, lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    return F.concat(F.lit('"'), F.when(text.rlike('[\\x00-\\x1f"\\\\]'), escaped).otherwise(text), F.lit('"'))


def _number(v: Column) -> Column:
    """A number as JSON: whole ones in digits, others as the shortest text of a double, with an exponent below 1e-4 and from 1e16 on."""
    kind, double = F.schema_of_variant(v), p.number(v)
    whole = p.whole(v).cast("string")
    digits = F.regexp_replace(double.cast("decimal(38,20)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    java = double.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(java, "^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(java, "E(.*)$", 1).cast("int")
    long = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    shown = F.when((double == 0) | F.abs(double).between(1e-4, 9.999999999999998e15), plain).otherwise(long)
    # a fraction of zero is dropped when it is stored: a decimal that 64 bits hold was written with one
    fraction = kind.startswith("DECIMAL") & (F.abs(double) < 2.0**63)
    return F.when(whole.isNotNull() & ~fraction, whole).otherwise(shown)


def _token(v: Column) -> Column:
    kind = p.kind(v)
    return (
        F.when(kind == "object", "{").when(kind == "array", "[").when(kind == "null", "null").when(kind == "string", quoted(p.text(v)))
        .when(kind == "boolean", p.text(v)).otherwise(_number(v))
    )


def walk(documents: DataFrame, fold: bool = True, exclude: set[str] | frozenset[str] = frozenset(s.VOLATILE)) -> DataFrame:
    """Rows (id, path, inside, place, token) for every node of documents (id, body).

    A step of a path is (n, key): a list's index and an empty text, or -1 and a key. inside is the place of the container.
    With fold, `nullable` is written out; excluded keys are left out at every depth.
    """
    under = F.create_map(*[F.lit(x) for pair in s._UNDER.items() for x in pair])
    step = lambda n, key: F.struct(n.cast("int").alias("n"), key.alias("key"))

    def children(v: Column, place: Column) -> Column:
        m = p.as_map(v)
        fields = F.map_filter(folded(m) if fold else m, lambda k, _: ~k.isin(sorted(exclude)) if exclude else F.lit(True))
        of_key = lambda k: F.when(place == "map", "schema").when(place == "schema", F.coalesce(F.try_element_at(under, k), F.lit("data"))).otherwise("data")
        by_key = F.transform(F.map_entries(fields), lambda e: F.struct(step(F.lit(-1), e["key"]).alias("step"), e["value"].alias("v"), of_key(e["key"]).alias("place")))
        by_index = F.transform(p.as_array(v), lambda x, i: F.struct(step(i, F.lit("")).alias("step"), x.alias("v"), F.when(place == "list", "schema").otherwise("data").alias("place")))
        return F.coalesce(by_key, by_index)

    root = F.array().cast("array<struct<n: int, key: string>>")
    level = documents.select("id", root.alias("path"), F.lit(None).cast("string").alias("inside"), F.lit("schema").alias("place"), F.try_parse_json("body").alias("v")).filter("v IS NOT NULL")
    levels, token, inner = [], _token(F.col("v")), F.explode(children(F.col("v"), F.col("place"))).alias("c")
    while True:
        level, containers = cut_counting(level.withColumn("token", token), F.col("token").isin("{", "["))
        levels.append(level.drop("v"))
        if not containers:
            return reduce(DataFrame.unionByName, levels).select("id", "path", "inside", "place", "token")
        below = level.select("id", "path", F.col("place").alias("inside"), inner)
        level = below.select("id", F.array_append("path", F.col("c.step")).alias("path"), "inside", F.col("c.place").alias("place"), F.col("c.v").alias("v"))


def _closed(node: Column, depth: Column) -> Column:
    """What closes after a node before one at depth follows: itself if it is a container, and those around it from depth on."""
    around = F.slice(node["path"], depth + 1, F.greatest(F.size(node["path"]) - depth, F.lit(0)))
    brackets = F.array_join(F.reverse(F.transform(around, lambda x: F.when(x["n"] < 0, "}").otherwise("]"))), "")
    own = F.when(node["token"] == "{", "}").when(node["token"] == "[", "]").otherwise("")
    return F.when(F.size(node["path"]) >= depth, F.concat(own, brackets)).otherwise("")


def texts(nodes: DataFrame) -> DataFrame:
    """Rows (id, text): documents written from their nodes, keys sorted at every depth, without white space."""
    whole = nodes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "token"))).alias("all"))

    def written(x: Column, i: Column) -> Column:
        before, depth = F.get("all", i - 1), F.size(x["path"])
        last = F.get(x["path"], depth - 1)
        more = F.when(F.size(before["path"]) >= depth, F.concat(_closed(before, depth), F.lit(","))).otherwise("")
        key = F.when(last["n"] < 0, F.concat(quoted(last["key"]), F.lit(":"))).otherwise("")
        return F.when(i == 0, x["token"]).otherwise(F.concat(more, key, x["token"]))

    return whole.select("id", F.concat(F.array_join(F.transform("all", written), ""), _closed(F.element_at("all", -1), F.lit(0))).alias("text"))


#: What a body may have that is written otherwise in a canonical text than Spark writes it: escapes, other than ASCII, numbers that are no short whole ones.
_UNEVEN = r"\\|[^\x20-\x7e\t\r\n]|[0-9][.eE]|[0-9]{16}"


def _plain_text(exclude: set[str] | frozenset[str]) -> Column:
    """The canonical text of an object `body` that needs no walk, null for others: excluded keys at its root only, no `nullable`, and nothing uneven."""
    root = F.map_filter(p.from_json(F.col("body")), lambda k, _: ~k.isin(sorted(exclude)) if exclude else F.lit(True))
    inner = '"(?:' + "|".join(re.escape(k) for k in sorted({"nullable", *exclude})) + ')":'
    told = F.when(~F.col("body").rlike(_UNEVEN), p.to_json(root))
    return p.let(told, lambda text: F.when(~text.rlike(inner), text))


def fingerprints(documents: DataFrame, exclude: set[str] | frozenset[str] = frozenset(s.VOLATILE)) -> DataFrame:
    """Rows (id, fingerprint) of documents (id, body) that are JSON; ids are unique.

    Objects that Spark writes in the canonical form already are written at once; all others are taken apart.
    """
    told = cut(spread(documents.select("id", "body"), "id").select("id", "body", _plain_text(exclude).alias("text")))
    plain, others = told.filter("text IS NOT NULL").select("id", "text"), told.filter("text IS NULL").select("id", "body")
    return plain.unionByName(texts(walk(others, True, exclude))).select("id", F.sha2("text", 256).alias("fingerprint"))


def pointer(path: Column) -> Column:
    """A path as a JSON pointer."""
    told = F.transform(path, lambda x: F.when(x["n"] < 0, F.replace(F.replace(x["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).otherwise(x["n"].cast("string")))
    return F.array_join(F.transform(told, lambda x: F.concat(F.lit("/"), x)), "")


def last_key(path: Column) -> Column:
    """The key at a path's end; null for a list's member and for the root."""
    last = F.get(path, F.size(path) - 1)
    return F.when(last["n"] < 0, last["key"])


def parent(path: Column) -> Column:
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (id, path, side, key, inside) of nodes two tables of nodes do not share: side is both, old or new, and of what only one has the topmost nodes stand for all below."""
    a = old.select("id", "path", F.col("token").alias("a"), F.col("inside").alias("in_a"))
    b = new.select("id", "path", F.col("token").alias("b"), F.col("inside").alias("in_b"))
    side = F.when(F.col("b").isNull(), "old").when(F.col("a").isNull(), "new").otherwise("both")
    apart = a.join(b, ["id", "path"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("id", "path", side.alias("side"), last_key(F.col("path")).alias("key"), F.coalesce("in_a", "in_b").alias("inside"))
    apart = cut(apart)
    above = apart.filter("side <> 'both'").select("id", F.col("path").alias("up"), "side")
    return apart.withColumn("up", parent(F.col("path"))).join(above, ["id", "up", "side"], "left_anti").drop("up")


def misplaced(documents: DataFrame) -> DataFrame:
    """Rows (id, pointer): renames declared elsewhere than on root properties."""
    # a key is spelled out in a body, unless it is escaped
    named = documents.filter(F.col("body").contains(s.MIGRATE_FROM) | F.col("body").contains("\\"))
    nodes = walk(named, False, frozenset())
    up = parent(F.col("path"))
    root_property = (F.size(up) == 2) & (F.get(up, F.lit(0))["key"] == "properties") & (F.get(up, F.lit(1))["n"] < 0)
    found = nodes.filter((last_key(F.col("path")) == s.MIGRATE_FROM) & (F.col("inside") == "schema") & ~root_property)
    return found.select("id", pointer(F.col("path")).alias("pointer"))


class References:
    """The references of documents and of what they refer to, found once for all documents of a table.

    documents and registry are rows (id, body), ids unique in each. A document's own definitions (`$defs` with an `$id`) come before the
    registry for that document. A reference is a text `$ref` with a scheme. The closure is a semi-naive fixpoint: each
    round joins only what the last one found, and ends when nothing is new, so cycles end too. References are numbered, above zero where
    the registry has them; a document is one row with the numbers it has seen, so a round moves what is new and not what was found before.
    """

    def __init__(self, documents: DataFrame, registry: DataFrame | None = None):
        self.documents = documents.select("id", "body")
        self.registry = documents.limit(0).select("id", "body") if registry is None else registry.select("id", "body")
        own = self._found(self.documents)
        known = own if registry is documents else self._found(self.registry)
        inside = (F.col("first") == "$defs") & (F.col("depth") > 1)
        ids = lambda x: x.filter("key = '$id'").select("id", "text")
        text = lambda x: x.filter("key = '$ref'").withColumnRenamed("text", "ref")
        self._ids = ids(own), ids(known)
        self.definitions = own.filter((F.col("key") == "$id") & inside & (F.col("depth") == 3)).select("id", F.col("under").alias("def"), F.col("text").alias("name"))
        self.links = text(own).select("id", F.when(inside, F.col("under")).alias("def"), "ref")
        self.registry_links = text(known).select("id", "ref").distinct()
        self._numbers = self._numbered()
        self._roots = cut(self.documents.select("id", F.monotonically_increasing_id().alias("root")))
        self._links = cut(self._by_number(self._rooted(self.links), "ref", "next"))
        self._reached = self._closure()

    @staticmethod
    def _found(documents: DataFrame) -> DataFrame:
        """Rows (id, depth, first, under, key, text) of the references and identifiers in documents: first and under are the first two keys on the way."""
        none = F.lit(None).cast("string")
        level = spread(documents, "id").select("id", none.alias("first"), none.alias("under"), F.try_parse_json("body").alias("v")).filter("v IS NOT NULL")
        members, levels, depth = documents.sparkSession.tvf.variant_explode(F.col("v").outer()), [], 0
        kind = F.schema_of_variant("value")
        while True:
            depth += 1
            told = F.coalesce("key", F.lit(""))  # a list's member has no key
            first, under = (told if depth == at else F.col(c) for at, c in ((1, "first"), (2, "under")))
            inner = kind.startswith("ARRAY") | kind.startswith("OBJECT")
            text = F.when(F.col("key").isin("$ref", "$id") & (kind == "STRING"), p.text(F.col("value")))
            below = level.lateralJoin(members).select("id", F.lit(depth).alias("depth"), first.alias("first"), under.alias("under"), "key", text.alias("text"), F.when(inner, F.col("value")).alias("v"))
            level, more = cut_counting(below.filter("v IS NOT NULL OR key = '$id' AND text IS NOT NULL OR contains(text, '://')"), F.col("v").isNotNull())
            levels.append(level.filter("text IS NOT NULL").drop("v"))
            if not more:
                return gathered(levels)
            level = level.filter("v IS NOT NULL").select("id", "first", "under", "v")

    def _numbered(self) -> DataFrame:
        """Rows (text, n): all identifiers and references, numbered from one, below zero where the registry has no such document."""
        named = lambda x, c, known: x.select(F.col(c).alias("text"), F.lit(known).alias("known"))
        all_texts = [named(self.registry, "id", True), named(self.links, "ref", False), named(self.registry_links, "ref", False), named(self.definitions, "name", False)]
        each = reduce(DataFrame.unionByName, all_texts).filter("text IS NOT NULL").groupBy("text").agg(F.max("known").alias("known"))
        return cut(each.select("text", (F.when(F.col("known"), 1).otherwise(-1) * (F.monotonically_increasing_id() + 1)).alias("n")))

    def _by_number(self, rows: DataFrame, column: str, into: str, keep: bool = False) -> DataFrame:
        found = rows.join(self._numbers.select(F.col("text").alias(column), F.col("n").alias(into)), column)
        return found if keep else found.drop(column)

    def _rooted(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._roots, "id").drop("id")

    def _closure(self) -> DataFrame:
        """Rows (root, own, seen): the numbers of every reference reached. own has, by number, the document's own definition that answers one and what that refers to."""
        none = F.array().cast("array<bigint>")
        direct = self._links.filter("def IS NULL").groupBy("root").agg(F.collect_set("next").alias("fresh"))
        answers = self._by_number(self._rooted(self.definitions.groupBy("id", "name").agg(F.max("def").alias("def"))), "name", "n", keep=True)
        of_own = self._links.filter("def IS NOT NULL").groupBy("root", "def").agg(F.collect_set("next").alias("next"))
        entry = F.struct("n", F.struct("def", "name", F.coalesce("next", none).alias("next")).alias("to"))
        own = answers.join(of_own, ["root", "def"], "left").groupBy("root").agg(F.map_from_entries(F.collect_list(entry)).alias("own"))
        edges = cut(self._by_number(self._by_number(self.registry_links, "ref", "next"), "id", "n").groupBy("n").agg(F.collect_set("next").alias("next")))
        without = F.create_map().cast("map<bigint, struct<def: string, name: string, next: array<bigint>>>")
        state = direct.join(own, "root", "left").select("root", F.coalesce("own", without).alias("own"), none.alias("seen"), "fresh")
        ended: list[DataFrame] = []
        while True:
            state, more = cut_counting(state, F.size("fresh") > 0)
            ended.append(state.filter("size(fresh) = 0").select("root", "own", "seen"))
            if not more:
                return gathered(ended)
            state = state.filter("size(fresh) > 0")
            asked = state.select("root", F.explode(_in_registry("fresh")).alias("n"))
            found = asked.join(edges, "n").groupBy("root").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("found"))
            by_own = F.flatten(F.transform("fresh", lambda n: F.coalesce(F.try_element_at("own", n)["next"], none)))
            seen = F.concat("seen", "fresh")
            state = state.join(found, "root", "left").select("root", "own", seen.alias("seen"), F.array_except(F.concat(by_own, F.coalesce("found", none)), seen).alias("fresh"))

    def unresolved(self) -> DataFrame:
        """Rows (id, ref): references in a document's bundle that nothing in it answers."""
        lone = self._reached.select("root", F.explode(F.filter("seen", lambda n: (n < 0) & ~F.map_contains_key("own", n))).alias("n"))
        unseen = self._links.filter("def IS NOT NULL").join(self._reached.select("root", "seen"), "root", "left").filter(~F.coalesce(F.array_contains("seen", F.col("next")), F.lit(False)))
        asked = lone.unionByName(unseen.select("root", F.col("next").alias("n"))).distinct()
        asked = cut(asked.join(self._numbers.select("n", F.col("text").alias("ref")), "n").join(self._roots, "root").select("root", "id", "ref"))
        own, known = self._ids
        holders = known.join(asked.select(F.col("ref").alias("text")).distinct(), "text", "left_semi")
        holders = sent_if_small(cut(self._by_number(holders, "id", "n").distinct()), 256)
        inner = self._reached.select("root", F.explode(_in_registry("seen")).alias("n")).join(holders, "n").select("root", F.col("text").alias("ref")).join(self._roots, "root").select("id", "ref")
        keys = self.documents.select("id", F.explode(F.map_keys(p.as_map(F.try_variant_get(F.try_parse_json("body"), "$['$defs']", "variant")))).alias("ref"))
        there = own.select("id", F.col("text").alias("ref")).unionByName(inner).unionByName(keys)
        return asked.select("id", "ref").join(there, ["id", "ref"], "left_anti")

    def bundles(self) -> DataFrame:
        """Rows (id, body): each document with all documents it refers to, directly or not, under `$defs` by their identifiers."""
        of = F.try_parse_json("body")
        defs = p.as_map(F.try_variant_get(of, "$['$defs']", "variant"))
        # documents with the same closure, such as those of a cycle, share what is put together from the registry
        sets = self._reached.select("root", F.array_sort(_in_registry("seen")).alias("set")).groupBy("set").agg(F.collect_list("root").alias("roots"))
        sets = cut(sets.select(F.monotonically_increasing_id().alias("of"), "set", "roots"))
        # a document is written as JSON once, and its text is put into every bundle that has it
        entry = lambda key, v: F.struct(key.alias("key"), F.concat(quoted(key), F.lit(":"), F.coalesce(F.to_json(v), F.lit("null"))).alias("text"))
        pool = self.registry.select(F.col("id").alias("text"), entry(F.col("id"), of).alias("entry")).join(self._numbers, "text").select("n", "entry")
        found = sets.select("of", F.explode("set").alias("n")).join(pool, "n").groupBy("of").agg(F.collect_list("entry").alias("found"))
        mine = self._reached.select("root", F.explode(F.map_values(F.map_filter("own", lambda n, _: F.array_contains("seen", n)))).alias("to")).select("root", "to.def", F.col("to.name").alias("ref"))
        mine = mine.join(self._rooted(self.documents.select("id", F.explode(defs).alias("def", "v"))), ["root", "def"]).groupBy("root").agg(F.collect_list(entry(F.col("ref"), F.col("v"))).alias("mine"))
        rows = self.documents.filter(of.isNotNull()).join(self._roots, "id", "left").join(mine, "root", "left").join(sets.select("of", F.explode("roots").alias("root")), "root", "left").join(found, "of", "left")
        written = lambda m: F.transform(F.map_entries(m), lambda x: entry(x["key"], x["value"]))
        none = F.array().cast("array<struct<key: string, text: string>>")
        joined = lambda entries: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda x: x["text"]), ","), F.lit("}"))
        rows = rows.select("id", p.as_map(of).alias("m"), F.coalesce(written(defs), none).alias("own"), F.concat(F.coalesce("mine", none), F.coalesce("found", none)).alias("found"))
        names = F.transform("found", lambda x: x["key"])
        inside = F.concat(p.let(names, lambda known: F.filter("own", lambda x: ~F.array_contains(known, x["key"]))), F.col("found"))
        embedded = F.struct(F.lit("$defs").alias("key"), F.concat(F.lit('"$defs":'), joined(inside)).alias("text"))
        dialect = F.struct(F.lit("$schema").alias("key"), F.lit(f'"$schema":"{DIALECT}"').alias("text"))
        rest = written(F.map_filter("m", lambda k, _: k != "$defs"))
        whole = F.concat(rest, F.when(F.size("own") + F.size("found") > 0, F.array(embedded)).otherwise(none), F.when(p.has(F.col("m"), "$schema"), none).otherwise(F.array(dialect)))
        return rows.select("id", joined(whole).alias("body"))


def _in_registry(numbers: str) -> Column:
    """Of numbers those that the registry answers, and no definition of the document's own."""
    return F.filter(numbers, lambda n: (n > 0) & ~F.map_contains_key("own", n))
