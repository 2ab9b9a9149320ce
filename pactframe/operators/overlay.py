"""Ordered patches on payloads: stacks of override, merge and unset actions folded into one VARIANT column.

Actions are data: a target's steps and a value, from documents of the plan or from a table of them. One generic step is folded
over a row's actions, so a plan does not grow with the number of actions, documents or keys.

Targets are `$`, `.name`, `['name']`, `[n]`, `[*]` and `[?(@.name=='text')]` or `[?(@=='text')]`. Each action
sees what the ones before made. The same fold runs on Python documents through `apply_to`.
"""

from __future__ import annotations

import copy
import json
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as p
from ..functions.shared import cut, sent_if_small

OPERATIONS = ("override", "merge", "unset")
_STEP = re.compile(r"\.(?P<name>[A-Za-z_][\w-]*)|\[(?P<q>['\"])(?P<quoted>.*?)(?P=q)\]|\[(?P<index>\d+)\]|\[(?P<all>\*)\]|\.(?P<dot>\*)|\[\?\(@(?:\.(?P<field>[\w-]+))?\s*==\s*(?P<r>['\"])(?P<text>.*?)(?P=r)\)\]")


class BadOverlay(ValueError):
    pass


def steps(target: str) -> list[tuple[str, Any]]:
    """A target's steps: ("key", k), ("index", n), ("all", None) or ("where", (field or None, text))."""
    if not target.startswith("$"):
        raise BadOverlay(f"a target starts with $: {target}")
    at, out = 1, []
    while at < len(target):
        m = _STEP.match(target, at)
        if not m:
            raise BadOverlay(f"cannot read {target[at:]} in {target}")
        if m["index"] is not None:
            out.append(("index", int(m["index"])))
        elif m["all"] or m["dot"]:
            out.append(("all", None))
        elif m["text"] is not None:
            out.append(("where", (m["field"], m["text"])))
        else:
            out.append(("key", m["name"] if m["name"] is not None else m["quoted"]))
        at = m.end()
    return out


@dataclass(frozen=True)
class Action:
    target: str
    operation: str
    value: Any = None

    @classmethod
    def parse(cls, raw: dict) -> Action:
        found = [k for k in OPERATIONS if k in raw]
        if not isinstance(raw.get("target"), str) or not raw["target"]:
            raise BadOverlay("an action needs a target")
        if len(found) != 1:
            raise BadOverlay("an action has exactly one of " + ", ".join(OPERATIONS))
        return cls(raw["target"], found[0], raw[found[0]])

    @property
    def concrete(self) -> bool:
        return all(kind in ("key", "index") for kind, _ in steps(self.target))


def parse_document(raw: dict) -> list[Action]:
    if not isinstance(raw.get("actions"), list):
        raise BadOverlay("an overlay needs a list of actions")
    return [Action.parse(a) for a in raw["actions"]]


#: An action as data. Steps say how they pick: key, index, all, where (a member whose field, or which itself, is a text), or put, a key
#: that is made where it is missing and makes an object of what is none. A merge is one `set` for each leaf of its patch.
HOWS = ("key", "put", "index", "all", "where")
STEP = "struct<how: string, key: string, n: bigint, text: string>"
OPERATION = f"struct<op: string, steps: array<{STEP}>, creates: boolean, value: variant>"
_OUT = {"override": "set", "merge": "set", "unset": "unset"}


def _as_data(step: tuple[str, Any]) -> dict:
    kind, key = step
    field, text = key if kind == "where" else (key if kind in ("key", "put") else None, None)
    return {"how": kind, "key": field, "n": key if kind == "index" else None, "text": text}


def _leaves(patch: Any, above: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Any]]:
    """The paths and values of a patch's leaves; an empty object is one."""
    if not isinstance(patch, dict) or not patch:
        return [(above, patch)]
    return [leaf for k, v in patch.items() for leaf in _leaves(v, (*above, k))]


def operations(documents: list[dict]) -> list[dict]:
    """The actions of documents in order, as data."""
    out = []
    for action in [a for d in documents for a in parse_document(d)]:
        path = [_as_data(x) for x in steps(action.target)]
        leaves = _leaves(action.value) if action.operation == "merge" else [((), action.value)]
        for names, value in leaves:
            op = "object" if action.operation == "merge" and value == {} else _OUT[action.operation]
            out.append({"op": op, "steps": [*path, *[_as_data(("put", k)) for k in names]], "creates": action.operation == "override" and action.concrete, "value": value})
    return out


def _object(fields: Column) -> Column:
    return F.to_variant_object(fields)


def _has(m: Column, key: Column) -> Column:
    """Whether a map has a key. In a fold, which is interpreted, `map_contains_key` ends each hit by an exception."""
    return F.exists(F.map_keys(m), lambda k: k == key)


@dataclass(frozen=True)
class Shape:
    """What operations have in them: how many steps at most, which kinds of steps and operations, and whether any makes what is missing."""

    deepest: int
    hows: frozenset[str]
    ops: frozenset[str]
    creates: bool

    @classmethod
    def of(cls, found: list[dict]) -> Shape:
        all_steps = [s["how"] for o in found for s in o["steps"]]
        return cls(max((len(o["steps"]) for o in found), default=0), frozenset(all_steps), frozenset(o["op"] for o in found), any(o["creates"] for o in found))


def _first(cases: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda out, c: F.when(c[0], c[1]).otherwise(out), reversed(cases), default)


def _acted(v: Column, o: Column, shape: Shape) -> Column:
    """v after an operation o of a shape. The expression grows with the number of steps, and holds no branch for kinds that do not occur."""
    path, op = o["steps"], o["op"]
    keyed = [h for h in ("key", "put") if h in shape.hows]
    makes, indexed = shape.creates or "put" in shape.hows, "index" in shape.hows
    by_key = lambda how: how.isin(keyed) if len(shape.hows) > len(keyed) else F.lit(True)
    empty = p.literal({})

    def end(x: Column) -> Column:
        cases = [("object", F.when(p.as_map(x).isNotNull(), x).otherwise(empty)), ("unset", p.literal(None))]
        return _first([(op == name, value) for name, value in cases if name in shape.ops], o["value"])

    def made(level: int) -> Column:
        """What the steps below a level make from nothing."""
        below = F.slice(path, level + 2, F.greatest(F.size(path) - level - 1, F.lit(0)))
        bottom = F.when(op == "object", empty).otherwise(o["value"]) if "object" in shape.ops else o["value"]
        if level + 1 == shape.deepest:
            return bottom
        field, member = (lambda x, s: _object(F.create_map(s["key"], x))), (lambda x, s: _object(F.array(x)))
        return F.aggregate(F.reverse(below), bottom, lambda x, s: F.when(by_key(s["how"]), field(x, s)).otherwise(member(x, s)) if indexed else field(x, s))

    def at(x: Column, level: int) -> Column:
        if level == shape.deepest:
            return end(x)
        s = F.get(path, F.lit(level))
        parts = F.struct(p.as_map(x).alias("m"), p.as_array(x).alias("a"), s.alias("s"))
        return F.when(F.size(path) <= level, end(x)).otherwise(p.let(parts, lambda it: inside(x, it["m"], it["a"], it["s"], level)))

    def inside(x: Column, m: Column, a: Column, s: Column, level: int) -> Column:
        how = s["how"]
        below = F.slice(path, level + 2, F.greatest(F.size(path) - level - 1, F.lit(0)))
        from_nothing = o["creates"] & F.forall(below, lambda z: by_key(z["how"]) | (z["n"] == 0)) if shape.creates else F.lit(False)
        able = (how == "put") | from_nothing if "put" in shape.hows else from_nothing
        last = (op == "unset") & (F.size(path) == level + 1)

        def text_of(y: Column) -> Column:
            value = F.when(s["key"].isNull(), y).otherwise(F.try_element_at(p.as_map(y), s["key"]))
            return F.coalesce((p.kind(value) == "string") & (p.text(value) == s["text"]), F.lit(False))

        of_key = lambda k: _first([(how == "all", F.lit(True))] if "all" in shape.hows else [], by_key(how) & (k == s["key"]))
        of_index = lambda y, i: _first([(how == h, test(y, i)) for h, test in (("index", lambda y, i: i == s["n"]), ("where", lambda y, i: text_of(y)), ("all", lambda y, i: F.lit(True))) if h in shape.hows], F.lit(False))

        def in_map(fields: Column) -> Column:
            if "unset" in shape.ops:
                fields = F.when(last, F.map_filter(fields, lambda k, _: ~of_key(k))).otherwise(fields)
            deep = F.transform_values(fields, lambda k, y: F.when(of_key(k), at(y, level + 1)).otherwise(y))
            if makes and keyed:
                deep = F.when(able & by_key(how) & ~_has(fields, s["key"]), F.map_concat(fields, F.create_map(s["key"], made(level)))).otherwise(deep)
            return _object(deep)

        def in_list(items: Column) -> Column:
            deep = F.transform(items, lambda y, i: F.when(of_index(y, i), at(y, level + 1)).otherwise(y))
            if "unset" in shape.ops:  # what moves up to a place that is freed is not looked at again
                deep = F.when(last, F.filter(items, lambda y, i: ~of_index(y, i))).otherwise(deep)
            if makes and indexed:
                deep = F.when(able & (how == "index") & (F.size(items) == s["n"]), F.concat(items, F.array(made(level)))).otherwise(deep)
            return _object(deep)

        fresh = []
        if makes and keyed:
            fresh.append((able & by_key(how), _object(F.create_map(s["key"], made(level)))))
        if makes and indexed:
            fresh.append((able & (how == "index") & (s["n"] == 0), _object(F.array(made(level)))))
        in_none = _first(fresh, x)
        pick = lambda hows: how.isin(hows) if set(hows) != shape.hows else F.lit(True)
        for_maps = [h for h in (*keyed, "all") if h in shape.hows]
        for_lists = [h for h in ("index", "where", "all") if h in shape.hows]
        cases = ([(m.isNotNull() & pick(for_maps), in_map(m))] if for_maps else []) + ([(a.isNotNull() & pick(for_lists), in_list(a))] if for_lists else [])
        return _first(cases, in_none)

    return at(v, 0)


#: Kinds of actions (all but the value) that get an expression of their own in a fold; others go through the generic step.
OWN = 16
_STATE = "struct<m: map<string,variant>, x: variant>"


def _kind_of(o: dict) -> tuple:
    return (o["op"], o["creates"], tuple((s["how"], s["key"], s["n"], s["text"]) for s in o["steps"]))


def _by_kind(state: Column, value: Column, kind: tuple) -> Column:
    """A fold's state after an action of a kind known in the plan: as `_acted`, with one branch, and nothing is made anew where nothing is hit.

    A state's m are the fields of an object, which stay apart from one action to the next, and its x is any other value.
    """
    op, creates, path = kind
    by_key = lambda how: how in ("key", "put")

    def made(level: int) -> Column:
        out = p.literal({}) if op == "object" else value
        for how, key, _, _ in reversed(path[level + 1 :]):
            out = _object(F.create_map(F.lit(key), out) if by_key(how) else F.array(out))
        return out

    def end(x: Column) -> Column:
        return {"object": lambda: F.when(p.as_map(x).isNotNull(), x).otherwise(p.literal({})), "unset": lambda: p.literal(None)}.get(op, lambda: value)()

    def able(level: int) -> bool:
        how = path[level][0]
        return how == "put" or creates and all(by_key(h) or n == 0 for h, _, n, _ in path[level + 1 :]) and how in ("key", "index")

    def last(level: int) -> bool:
        return op == "unset" and len(path) == level + 1

    def of_key(m: Column, level: int) -> Column:
        """The fields of an object after a step that names one of them."""
        key = F.lit(path[level][1])
        if last(level):
            return F.when(_has(m, key), F.map_filter(m, lambda k, _: k != key)).otherwise(m)
        changed = F.transform_values(m, lambda k, y: F.when(k == key, at(y, level + 1)).otherwise(y))
        return F.when(_has(m, key), changed).otherwise(F.map_concat(m, F.create_map(key, made(level))) if able(level) else m)

    def hit(y: Column, i: Column, how: str, key: str | None, n: int | None, text: str | None) -> Column:
        if how == "index":
            return i == n
        value = y if key is None else F.try_element_at(p.as_map(y), F.lit(key))
        return F.coalesce((p.kind(value) == "string") & (p.text(value) == text), F.lit(False))

    def of_items(a: Column, level: int) -> Column:
        """A list after a step that picks members of it."""
        step = path[level]
        every = step[0] == "all"
        if last(level):
            return _object(F.array().cast("array<variant>") if every else F.filter(a, lambda y, i: ~hit(y, i, *step)))
        deep = F.transform(a, lambda y, i: at(y, level + 1) if every else F.when(hit(y, i, *step), at(y, level + 1)).otherwise(y))
        if step[0] == "index" and able(level):
            deep = F.when(F.size(a) == step[2], F.concat(a, F.array(made(level)))).otherwise(deep)
        return _object(deep)

    def of_all(m: Column, level: int) -> Column:
        return F.map_filter(m, lambda k, _: F.lit(False)) if last(level) else F.transform_values(m, lambda k, y: at(y, level + 1))

    def at(x: Column, level: int) -> Column:
        if level == len(path):
            return end(x)
        how, key, n, _ = path[level]
        if by_key(how):
            fresh = _object(F.create_map(F.lit(key), made(level))) if able(level) else x
            return p.let(p.as_map(x), lambda m: F.when(m.isNull(), fresh).otherwise(_object(of_key(m, level))))
        fresh = _object(F.array(made(level))) if able(level) and n == 0 else x
        in_list = p.let(p.as_array(x), lambda a: F.when(a.isNull(), fresh).otherwise(of_items(a, level)))
        if how != "all":
            return in_list
        return p.let(p.as_map(x), lambda m: F.when(m.isNull(), in_list).otherwise(_object(of_all(m, level))))

    if not path or not (by_key(path[0][0]) or path[0][0] == "all"):
        return _state_of(at(_value_of(state), 0))
    m, nothing = state["m"], F.lit(None).cast("variant")
    if path[0][0] == "all":
        return F.when(m.isNull(), _state_of(at(state["x"], 0))).otherwise(_state(of_all(m, 0), nothing))
    fresh = _state(F.create_map(F.lit(path[0][1]), made(0)), nothing) if able(0) else state
    return F.when(m.isNull(), fresh).otherwise(_state(of_key(m, 0), nothing))


def _state(m: Column, x: Column) -> Column:
    return F.struct(m.alias("m"), x.alias("x")).cast(_STATE)


def _state_of(v: Column) -> Column:
    return p.let(v, lambda x: p.let(p.as_map(x), lambda m: _state(m, F.when(m.isNull(), x))))


def _value_of(state: Column) -> Column:
    return F.when(state["m"].isNotNull(), _object(state["m"])).otherwise(state["x"])


def _folded(v: Column, found: Column, kinds: list[tuple], shape: Shape | None) -> Column:
    """v after found, operations whose `own` is the number of their kind in kinds, or null for those of a shape that go through the generic step."""

    def step(state: Column, o: Column) -> Column:
        cases = [(o["own"] == i, _by_kind(state, o["value"], kind)) for i, kind in enumerate(kinds)]
        if shape is None:
            return _first(cases[:-1], cases[-1][1])
        return _first(cases, _state_of(_acted(_value_of(state), o, shape)))

    return _value_of(F.aggregate(found, _state_of(v), step))


OWN_OPERATION = f"struct<own: int, {OPERATION.removeprefix('struct<')}"


def _numbered(found: list[dict]) -> tuple[list[dict], list[tuple], Shape | None]:
    """Operations with the number of their kind, the kinds, commonest first, and the shape of the rest."""
    kinds = [k for k, _ in Counter(map(_kind_of, found)).most_common(OWN)]
    numbers = {k: i for i, k in enumerate(kinds)}
    rest = [o for o in found if _kind_of(o) not in numbers]
    return [{"own": numbers.get(_kind_of(o)), **o} for o in found], kinds, Shape.of(rest) if rest else None


def apply(v: Column, documents: list[dict]) -> Column:
    """v, a VARIANT, after all actions of all documents, in order: a fold over the actions, which are one literal."""
    found, kinds, shape = _numbered(operations(documents))
    if not found:
        return v
    return _folded(v, F.from_json(F.lit(json.dumps(found, ensure_ascii=False)), f"array<{OWN_OPERATION}>"), kinds, shape)


# Fixed patterns: one step of a target, and its kinds.
_NAME, _ONE, _TWO, _INDEX = r"\.([A-Za-z_][\w-]*)", r"\['([^']*)'\]", r"\[\"([^\"]*)\"\]", r"\[([0-9]+)\]"
_WHERE = r"\[\?\(@(?:\.([\w-]+))?\s*==\s*(?:'([^']*)'|\"([^\"]*)\")\)\]"
_ANY = "|".join([_NAME, _ONE, _TWO, _INDEX, r"\[\*\]", r"\.\*", _WHERE])


def _steps_of(target: Column) -> Column:
    """A target's steps as data; null if it cannot be read to its end."""
    found = F.regexp_extract_all(target, F.lit(_ANY), F.lit(0))
    field = lambda x, pattern, group=1: F.regexp_extract(x, f"^{pattern}$", group)
    none = F.lit(None).cast("string")

    def step(x: Column) -> Column:
        told = lambda how, key=none, n=none, text=none: F.struct(F.lit(how).alias("how"), key.alias("key"), n.cast("bigint").alias("n"), text.alias("text"))
        where = told("where", F.nullif(field(x, _WHERE), F.lit("")), none, F.when(x.contains("'"), field(x, _WHERE, 2)).otherwise(field(x, _WHERE, 3)))
        return (
            F.when(x.rlike(f"^{_INDEX}$"), told("index", none, F.nullif(field(x, _INDEX), F.lit("")))).when(x.isin("[*]", ".*"), told("all"))
            .when(x.startswith("[?"), where).when(x.startswith("['"), told("key", field(x, _ONE))).when(x.startswith("["), told("key", field(x, _TWO))).otherwise(told("key", field(x, _NAME)))
        )

    whole = F.concat(F.lit("$"), F.array_join(found, "")) == target
    return F.when(whole, F.transform(found, step))


def _actions(overlays: DataFrame) -> DataFrame:
    """Rows (key, n, a, target, word, value, problem) of overlays (key, n, body); a is an action's number in its document. Targets are not read yet."""
    listed = F.try_variant_get(F.try_parse_json("body"), "$.actions", "array<variant>")
    rows = overlays.select("key", "n", listed.isNull().alias("none"), F.posexplode_outer(listed).alias("a", "v")).withColumn("m", p.as_map(F.col("v")))
    words = F.filter(F.array(*map(F.lit, OPERATIONS)), lambda w: F.coalesce(F.map_contains_key("m", w), F.lit(False)))
    target = F.when(p.kind(p.get(F.col("m"), "target")) == "string", p.text(p.get(F.col("m"), "target")))
    problem = (
        F.when(F.col("none"), "an overlay needs a list of actions").when(F.col("a").isNull(), None).when(F.coalesce(target, F.lit("")) == "", "an action needs a target")
        .when(F.size(words) != 1, "an action has exactly one of " + ", ".join(OPERATIONS))
    )
    word = F.get(words, F.lit(0))
    return rows.select("key", "n", "a", target.alias("target"), word.alias("word"), F.try_element_at("m", word).alias("value"), problem.alias("problem")).filter("a IS NOT NULL OR problem IS NOT NULL")


def problems(overlays: DataFrame) -> DataFrame:
    """Rows (key, n, a, problem): documents and actions that cannot be read."""
    unread = F.when(_steps_of(F.col("target")).isNull() & F.col("a").isNotNull(), F.concat(F.lit("cannot read the target "), "target"))
    return _actions(overlays).select("key", "n", "a", F.coalesce("problem", unread).alias("problem")).filter("problem IS NOT NULL")


def compiled(overlays: DataFrame) -> DataFrame:
    """Rows (key, operations) of overlays (key, n, body: a document as JSON text): each key's actions in order, as data, values as JSON texts.

    The patches of merges are taken apart a level at a time until only leaves are left. Raises for what cannot be read.
    """
    return _compiled(overlays)[0]


def _compiled(overlays: DataFrame) -> tuple[DataFrame, list[tuple], Shape | None]:
    """`compiled`, cut; the kinds that its operations' numbers (`own`) name, and the shape of those without."""
    actions = cut(_actions(overlays))
    targets = cut(actions.select("target").distinct().withColumn("path", _steps_of(F.col("target"))))  # each target is read once
    targets = sent_if_small(targets, 400)
    if bad := actions.filter("problem IS NOT NULL").first():
        raise BadOverlay(f"{bad['key']}: {bad['problem']}")
    if bad := actions.join(targets.filter("path IS NULL").select("target"), "target").first():
        raise BadOverlay(f"{bad['key']}: cannot read the target {bad['target']}")
    merge = F.col("word") == "merge"
    level = actions.withColumn("names", F.array().cast("array<string>"))
    leaves = [level.filter(~merge)]
    level = level.filter(merge)
    while True:
        level = cut(level)
        fields = p.as_map(F.col("value"))
        inner = F.coalesce(F.size(fields) > 0, F.lit(False))
        leaves.append(level.filter(~inner))
        level = level.filter(inner).select("key", "n", "a", "target", "word", F.explode(fields).alias("k", "value"), "problem", "names")
        level = level.select("key", "n", "a", "target", "word", "value", "problem", F.array_append("names", F.col("k")).alias("names"))
        if level.isEmpty():
            break
    op = F.when(F.col("word") == "unset", "unset").when(merge & p.as_map(F.col("value")).isNotNull(), "object").otherwise("set")
    rows = reduce(DataFrame.unionByName, leaves).withColumn("op", op)
    put = F.transform("names", lambda k: F.struct(F.lit("put").alias("how"), k.alias("key"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("text")))
    concrete = (F.col("word") == "override") & F.forall("path", lambda x: x["how"].isin("key", "index"))
    told = lambda df: df.join(targets, "target").withColumn("steps", F.concat("path", put)).withColumn("creates", concrete)
    by = ["word", "op", "target", "names"]
    counts = rows.groupBy(*by).count()
    common = [r.asDict(True) for r in told(counts.orderBy(F.desc("count"), *by).limit(OWN + 1)).orderBy(F.desc("count"), *by).collect()]
    kinds = list(dict.fromkeys(map(_kind_of, common[:OWN])))
    same = lambda r: (F.col("word") == r["word"]) & (F.col("op") == r["op"]) & (F.col("target") == r["target"]) & (F.col("names") == F.array(*map(F.lit, r["names"])).cast("array<string>"))
    own, shape = _first([(same(r), F.lit(kinds.index(_kind_of(r)))) for r in common[:OWN]], F.lit(None).cast("int")), None
    if len(common) > OWN:
        rest = told(counts.filter(own.isNull())).select("op", "creates", F.col("steps.how").alias("hows"))
        has = [F.coalesce(F.max(F.array_contains("hows", h)), F.lit(False)) for h in HOWS]
        deepest, creates, ops, *there = rest.agg(F.max(F.size("hows")), F.max("creates"), F.collect_set("op"), *has).first()
        shape = Shape(deepest, frozenset(h for h, yes in zip(HOWS, there) if yes), frozenset(ops), creates)
    entry = F.struct("n", "a", "op", "steps", "creates", "value", "own")
    read = told(rows).withColumn("value", F.to_json("value")).withColumn("own", own).select("key", entry.alias("entry"))
    return cut(read.groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("operations"))), kinds, shape


def apply_stacks(rows: DataFrame, v: str, keys: str, overlays: DataFrame) -> DataFrame:
    """rows with v, a VARIANT, after the documents of overlays (key, n, body) for each of the row's keys, in the keys' order.

    The stack of each distinct list of keys is put together once, by joins; unknown keys are passed over, and rows without
    keys stay as they are. The plan depends on the commonest kinds of actions, `OWN` at most, and the deepest target of the others, not on
    the number of keys or actions.
    """
    found, kinds, shape = _compiled(overlays)
    if not kinds:
        return rows
    lists = rows.select(F.col(keys).alias("_keys")).filter("size(_keys) > 0").distinct()
    each = lists.select("_keys", F.posexplode("_keys").alias("_at", "key")).join(found, "key")
    stacks = each.groupBy("_keys").agg(F.array_sort(F.collect_list(F.struct("_at", "operations"))).alias("_all"))
    as_data = lambda o: F.struct(o["own"].alias("own"), o["op"].alias("op"), o["steps"].alias("steps"), o["creates"].alias("creates"), F.parse_json(o["value"]).alias("value"))
    stacks = cut(stacks.select("_keys", F.transform(F.flatten(F.transform("_all", lambda x: x["operations"])), as_data).alias("_operations")))
    size = stacks.agg(F.coalesce(F.sum(F.size("_operations")), F.lit(0))).first()[0]
    joined = rows.select(F.struct(*rows.columns).alias("_row")).join(F.broadcast(stacks) if size * 400 <= 64 << 20 else stacks, F.col(f"_row.`{keys}`") == F.col("_keys"), "left")
    # a list of operations that is carried along is read once, by the fold
    changed = F.when(F.col("_operations").isNull(), F.col(f"_row.`{v}`")).otherwise(_folded(F.col(f"_row.`{v}`"), F.col("_operations"), kinds, shape))
    return joined.select(*[changed.alias(c) if c == v else F.col(f"_row.`{c}`") for c in rows.columns])


class OverlayRegistry:
    """Overlay documents by key. A key holds its documents in order; registering it again replaces them."""

    def __init__(self, documents: dict[str, list[dict]] | None = None):
        self._documents: dict[str, list[dict]] = {}
        for key, found in (documents or {}).items():
            self.register(key, *found)

    def register(self, key: str, *documents: dict) -> OverlayRegistry:
        for d in documents:
            parse_document(d)
        self._documents[key] = list(documents)
        return self

    def has(self, key: str) -> bool:
        return key in self._documents

    def documents_for(self, key: str) -> list[dict]:
        return list(self._documents.get(key, ()))

    def stack_for(self, *keys: str) -> list[dict]:
        """The documents of all keys, in the keys' order; unknown keys are passed over."""
        return [d for k in keys for d in self.documents_for(k)]

    def keys(self) -> list[str]:
        return list(self._documents)


def apply_by_keys(v: Column, keys: Column, registry: OverlayRegistry | dict[str, list[dict]]) -> Column:
    """v after the documents of each of the row's keys, in the keys' order; unknown keys are passed over.

    The registry is plan-time data, a literal map of actions by key. `apply_stacks` takes overlays from a table.
    """
    known = registry if isinstance(registry, OverlayRegistry) else OverlayRegistry(registry)
    by_key = {name: operations(known.documents_for(name)) for name in known.keys()}
    if not any(by_key.values()):
        return v
    numbered, kinds, shape = _numbered([o for found in by_key.values() for o in found])
    each = iter(numbered)
    by_key = {name: [next(each) for _ in found] for name, found in by_key.items()}
    stacks = F.from_json(F.lit(json.dumps(by_key, ensure_ascii=False)), f"map<string, array<{OWN_OPERATION}>>")
    return _folded(v, F.flatten(F.array_compact(F.transform(keys, lambda k: F.try_element_at(stacks, k)))), kinds, shape)


def apply_to(document: Any, documents: list[dict]) -> Any:
    """The same on a Python document, such as a schema; an override that matches nothing raises unless its path is concrete."""
    document = copy.deepcopy(document)
    for action in [a for d in documents for a in parse_document(d)]:
        path, hits = steps(action.target), [0]

        def change(x: Any, action: Action = action, hits: list[int] = hits) -> Any:
            hits[0] += 1
            return copy.deepcopy(action.value) if action.operation == "override" else _merge_value(x, action.value)

        if action.operation == "unset":
            document = _walk(document, path[:-1], lambda x, last=path[-1]: _drop(x, last), False) if path else None
        else:
            document = _walk(document, path, change, action.operation == "override" and action.concrete)
            if action.operation == "override" and not hits[0]:
                raise BadOverlay(f"nothing matches {action.target}")
    return document


def _merge_value(x: Any, patch: Any) -> Any:
    if not (isinstance(x, dict) and isinstance(patch, dict)):
        return copy.deepcopy(patch)
    return x | {k: _merge_value(x[k], v) if k in x else copy.deepcopy(v) for k, v in patch.items()}


def _hit(x: Any, where: tuple[str | None, str]) -> bool:
    return (x.get(where[0]) if where[0] and isinstance(x, dict) else None if where[0] else x) == where[1]


def _drop(x: Any, last: tuple[str, Any]) -> Any:
    kind, key = last
    if isinstance(x, dict):
        return {k: v for k, v in x.items() if kind != "all" and (kind != "key" or k != key)}
    if isinstance(x, list):
        return [v for i, v in enumerate(x) if not (kind == "all" or (kind == "index" and i == key) or (kind == "where" and _hit(v, key)))]
    return x


def _creatable(path: list[tuple[str, Any]]) -> bool:
    """Whether a concrete path can be made from nothing: a new list has a place 0 only."""
    return all(kind == "key" or (kind == "index" and key == 0) for kind, key in path)


def _walk(x: Any, path: list[tuple[str, Any]], change: Callable[[Any], Any], create: bool) -> Any:
    if not path:
        return change(x)
    (kind, key), rest = path[0], path[1:]
    deeper = lambda y: _walk(y, rest, change, create)
    makes = create and _creatable(rest)
    if kind == "key":
        if isinstance(x, dict) and (key in x or makes):
            return x | {key: deeper(x.get(key))}
        return {key: deeper(None)} if makes and not isinstance(x, dict) else x
    if kind == "all" and isinstance(x, dict):
        return {k: deeper(v) for k, v in x.items()}
    if not isinstance(x, list):
        return [deeper(None)] if makes and kind == "index" and key == 0 else x
    if kind == "index" and makes and key == len(x):
        return [*x, deeper(None)]
    return [deeper(v) if kind == "all" or (kind == "index" and i == key) or (kind == "where" and _hit(v, key)) else v for i, v in enumerate(x)]
