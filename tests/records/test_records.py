import json

import duckdb
import pytest
from pyspark.sql import functions as F

from pactframe import queries
from pactframe.functions import gate, recursive
from pactframe.functions import payload as p
from pactframe.operators import ladder, overlay
from pactframe.plans import schemas as s

STRING = {"type": "string"}


def obj(properties, required=None, **more):
    return {"type": "object", "properties": properties, "required": list(properties) if required is None else required, **more}


def climbed(spark, record, old, new, steps=None):
    df = spark.createDataFrame([(json.dumps(record),)], "j string").withColumn("payload", p.from_json(F.col("j")))
    row = (steps or ladder.Ladder.default()).migrate(df, "payload", old, new).select("result.rung", p.to_json(F.col("result.migrated")).alias("m"), p.to_json(F.col("result.original")).alias("o"), "result.confidence").first()
    assert json.loads(row.o) == record
    return row.rung, row.m and json.loads(row.m)


CASES = [
    ({"name": "Ada"}, obj({"name": STRING}), obj({"name": STRING, "active": {"type": "boolean", "default": True}}), "structural", {"name": "Ada", "active": True}),
    ({"name": "Ada"}, obj({"name": STRING}), obj({"name": STRING, "tags": {"type": "array"}}), "structural", {"name": "Ada", "tags": []}),
    ({"name": "Ada", "legacy": 1}, obj({"name": STRING, "legacy": {}}), obj({"name": STRING}, additionalProperties=False), "structural", {"name": "Ada"}),
    ({"score": 7}, obj({"score": {"type": "integer"}}), obj({"score": {"type": "number"}}), "structural", {"score": 7}),
    ({"full_name": "Ada"}, obj({"full_name": STRING}), obj({"displayName": {"type": "string", "minLength": 1, "x-migrate-from": "full_name"}}), "declared-mapping", {"displayName": "Ada"}),
    ({"name": "Ada"}, obj({"name": STRING}), obj({"name": STRING, "email": {"type": "string", "minLength": 3}}), None, None),
    ({"a": "A", "b": "B"}, obj({"a": STRING, "b": STRING}), obj({"b": {**STRING, "x-migrate-from": "a"}, "c": {**STRING, "x-migrate-from": "b"}}), "declared-mapping", {"b": "A", "c": "B"}),
    ({"a": "A", "b": "B"}, obj({"a": STRING, "b": STRING}), obj({"a": {**STRING, "x-migrate-from": "b"}, "b": {**STRING, "x-migrate-from": "a"}}), "declared-mapping", {"a": "B", "b": "A"}),
    ({"summary": None}, obj({"summary": {"type": ["string", "null"]}}), obj({"blurb": {**STRING, "x-migrate-from": "summary"}}), None, None),
    ({"blurb": "x"}, obj({"blurb": STRING}), obj({"blurb": {**STRING, "x-migrate-from": "summary"}, "extra": {**STRING, "default": "e"}}), "structural", {"blurb": "x", "extra": "e"}),
]


@pytest.mark.parametrize("record,old,new,rung,want", CASES)
def test_ladder_cases(spark, record, old, new, rung, want):
    assert climbed(spark, record, old, new) == (rung, want)


def test_custom_and_python_rungs(spark):
    old, new = obj({"title": STRING}) | {"$id": "https://x.example/a/1"}, obj({"slug": {"type": "string", "minLength": 5, "x-migrate": "slugify"}}) | {"$id": "https://x.example/a/2"}
    slug = lambda m: F.create_map(F.lit("slug"), F.lower(F.regexp_replace(p.text(p.get(m, "title")), " ", "-")).cast("variant"))
    by_name, by_pair = ladder.Transforms().named("slugify", slug), ladder.Transforms().for_pair(old["$id"], new["$id"], slug)
    for t in (by_name, by_pair):
        assert climbed(spark, {"title": "Hello World"}, old, new, ladder.Ladder.default(t)) == ("custom-transform", {"slug": "hello-world"})
    assert climbed(spark, {"title": "no"}, old, new, ladder.Ladder.default(by_name)) == (None, None)
    model = obj({"summary": {**STRING, "minLength": 1, "x-migrate": "llm"}})
    steps = ladder.Ladder.default().with_rungs(ladder.llm_try(lambda record, a, b: {"summary": record["raw"][:4]}))
    assert climbed(spark, {"raw": "long text"}, obj({"raw": STRING}), model, steps) == ("llm-try", {"summary": "long"})
    assert steps.rungs() == ["structural", "declared-mapping", "custom-transform", "llm-try"]


def projected(spark, foreign, target):
    df = spark.createDataFrame([(json.dumps(foreign),)], "j string").withColumn("v", F.parse_json("j"))
    row = ladder.Ladder.default().project(df, "v", target).select("result.rung", p.to_json(F.col("result.migrated")).alias("m")).first()
    return row.rung, row.m and json.loads(row.m)


def test_projection(spark):
    field = lambda kind, **source: {"type": kind, "x-source": source}
    target = obj({"displayName": field("string", path="author.name", cast="trim"), "stars": field("integer", path="rating.value", cast="int")}) | {"$id": "https://x.example/r/1"}
    assert projected(spark, {"author": {"name": "  Ada  "}, "rating": {"value": "5"}}, target) == ("source-projection", {"displayName": "Ada", "stars": 5})
    anon = obj({"who": field("string", path="a.b", default="anon"), "tag": field("string", path="tags.1"), "more": {**STRING, "default": "d"}}) | {"$id": "x"}
    assert projected(spark, {"a": {"b": None}, "tags": ["p", "q"]}, anon) == ("source-projection", {"who": "anon", "tag": "q", "more": "d"})
    assert projected(spark, {"a": 1}, obj({"n": field("string", path="zzz")}) | {"$id": "x"}) == (None, None)
    assert projected(spark, {"a": 1}, obj({"n": field("string", path="a", cast="eval")}) | {"$id": "x"}) == (None, None)
    with pytest.raises(ValueError):
        projected(spark, {}, obj({}))


@pytest.mark.parametrize("cast,value,want", [
    ("string", 7, "7"), ("string", True, "1"), ("string", False, ""), ("string", [1], ""), ("int", "7abc", 7), ("int", "7.9", 7), ("int", "-7.9", -7), ("int", "x", 0), ("int", "1e3", 1000),
    ("int", True, 1), ("float", "7.5", 7.5), ("bool", "yes", True), ("bool", " OFF ", False), ("bool", "0", False), ("bool", 0, False), ("bool", 2, True), ("bool", [], False), ("trim", "\t x \n", "x"),
    ("int", 9007199254740993, 9007199254740993), ("int", "9007199254740993", 9007199254740993), ("int", " -9007199254740993.9x", -9007199254740993), ("int", "99999999999999999999", 2**63 - 1), ("int", -99999999999999999999, -(2**63)),
    ("int", "9" * 60, 2**63 - 1), ("int", "-" + "9" * 60, -(2**63)), ("int", "1e30", 2**63 - 1), ("int", ".5", 0), ("int", "-", 0), ("int", 7.9, 7), ("int", -7.9, -7), ("int", 1e300, 2**63 - 1), ("int", [], 0), ("int", {"a": 1}, 1),
])
def test_casts(spark, cast, value, want):
    got = spark.createDataFrame([(json.dumps(value),)], "j string").select(F.to_json(p.cast(cast, F.parse_json("j"))).alias("x")).first().x
    assert json.loads(got) == want


GATE = [
    ({"type": "integer"}, 1, True), ({"type": "integer"}, 1.0, True), ({"type": "integer"}, 1.5, False), ({"type": ["string", "null"]}, None, True), ({"type": "string"}, 1, False),
    ({"minLength": 2}, "😀", False), ({"minLength": 2}, 5, True), ({"maximum": 3}, 4, False), ({"items": {"type": "integer"}}, [1, 2], True), ({"items": {"type": "integer"}}, [1, "x"], False),
    ({"enum": ["a", 1, None]}, None, True), ({"enum": ["a", 1, None]}, 1.0, True), ({"enum": ["a"]}, "b", False), ({"const": {"a": 1}}, {"a": 1}, True), ({"not": {}}, 1, False),
    ({"oneOf": [{"type": "integer"}, {"minimum": 0}]}, -1, True), ({"oneOf": [{"type": "integer"}, {"minimum": 0}]}, 1, False), ({"anyOf": [{"const": 1}, {"const": 2}]}, 2, True),
    ({"required": ["a"]}, {"b": 1}, False), ({"properties": {"a": {"type": "string"}}, "additionalProperties": False}, {"a": "x", "b": 1}, False), ({"additionalProperties": {"type": "integer"}}, {"z": "x"}, False),
    ({"$ref": "#/$defs/n"}, 3, True), ({"$ref": "#/$defs/n"}, "3", False), ({"maxItems": 1}, [1, 2], False),
    ({"const": 9007199254740992}, 9007199254740993, False), ({"const": 9007199254740993}, 9007199254740993, True), ({"enum": [9007199254740993]}, 9007199254740992, False), ({"minimum": 9007199254740993}, 9007199254740992, False),
    ({"exclusiveMaximum": 9007199254740993}, 9007199254740992, True), ({"maximum": 99999999999999999999}, 99999999999999999998, True), ({"minimum": 0.5}, 1, True), ({"const": 1}, 1.0, True), ({"const": 1e3}, 1000, True),
    ({"uniqueItems": True}, [1, 2, 1], False), ({"uniqueItems": True}, [1, "1", True], True), ({"uniqueItems": True}, [{"a": 1, "b": 2}, {"b": 2, "a": 1}], False), ({"uniqueItems": True}, [1, 1.0], False), ({"uniqueItems": False}, [1, 1], True),
    ({"multipleOf": 3}, 9, True), ({"multipleOf": 3}, 10, False), ({"multipleOf": 0.01}, 0.07, True), ({"multipleOf": 0.01}, 0.075, False), ({"multipleOf": 2}, "x", True), ({"multipleOf": 7}, 9007199254740993, False),
    ({"minProperties": 2}, {"a": 1}, False), ({"maxProperties": 1}, {"a": 1}, True), ({"patternProperties": {"^x": {"type": "integer"}}}, {"x1": "a"}, False), ({"patternProperties": {"^x": {"type": "integer"}}}, {"y": "a"}, True),
    ({"patternProperties": {"^x": {}}, "properties": {"p": {}}, "additionalProperties": False}, {"x1": 1, "p": 2}, True), ({"patternProperties": {"^x": {}}, "additionalProperties": False}, {"z": 1}, False),
    ({"prefixItems": [{"type": "integer"}, {"type": "string"}]}, [1, "a", None], True), ({"prefixItems": [{"type": "integer"}, {"type": "string"}]}, [1, 2], False), ({"prefixItems": [{}, {}], "items": False}, [1], True), ({"prefixItems": [{}], "items": {"type": "null"}}, [1, 2], False),
    ({"contains": {"const": 1}}, [2, 1], True), ({"contains": {"const": 1}}, [2], False), ({"contains": {"const": 1}, "minContains": 0}, [], True), ({"contains": {"const": 1}, "maxContains": 1}, [1, 1], False), ({"contains": {"const": 1}}, "x", True),
    ({"propertyNames": {"maxLength": 2}}, {"abc": 1}, False), ({"propertyNames": {"maxLength": 2}}, {"ab": 1}, True), ({"dependentRequired": {"a": ["b"]}}, {"a": 1}, False), ({"dependentRequired": {"a": ["b"]}}, {"c": 1}, True),
    ({"dependentSchemas": {"a": {"required": ["b"]}}}, {"a": 1}, False), ({"dependentSchemas": {"a": {"required": ["b"]}}}, {"b": 1}, True), ({"if": {"type": "integer"}, "then": {"minimum": 3}, "else": {"minLength": 2}}, 2, False),
    ({"if": {"type": "integer"}, "then": {"minimum": 3}, "else": {"minLength": 2}}, "ab", True), ({"if": {"type": "integer"}, "else": {"minLength": 2}}, "a", False), ({"then": False}, 1, True),
    ({"$ref": "#/$defs/tree"}, {"n": 1, "kids": [{"n": 2, "kids": []}]}, True), ({"$ref": "#/$defs/tree"}, {"n": 1, "kids": [{"n": 2, "kids": [{"n": "x"}]}]}, False),
]


@pytest.mark.parametrize("schema,value,want", GATE)
def test_gate(spark, schema, value, want):
    tree = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "kids": {"items": {"$ref": "#/$defs/tree"}}}}
    whole = obj({"v": schema}) | {"$defs": {"n": {"type": "number"}, "tree": tree}}
    payload = p.from_json(F.lit(json.dumps({"v": value})))
    assert spark.range(1).select(gate.accepts(whole, payload).alias("ok")).first().ok is want


@pytest.mark.parametrize("schema,value,want", GATE)
def test_recursive_gate_agrees(schema, value, want):
    """The same cases by the validator of rows, which recursive schemas go to."""
    tree = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "kids": {"items": {"$ref": "#/$defs/tree"}}}}
    assert recursive.Rows({"$defs": {"n": {"type": "number"}, "tree": tree}}, False).valid(schema, json.loads(json.dumps(value))) is want


def test_gate_refuses_what_it_cannot_check():
    for word in ("unevaluatedProperties", "unevaluatedItems", "$dynamicRef"):
        with pytest.raises(gate.Unsupported, match=word.replace("$", ".")):
            gate.accepts(obj({"v": {word: False}}), F.lit(None))
    with pytest.raises(ValueError, match="unresolved"):
        gate.accepts(obj({"v": {"$ref": "#/$defs/none"}}), F.lit(None))


def test_recursive_schema_goes_to_rows(spark):
    node = {"type": "object", "required": ["kind"], "properties": {"kind": {"const": "node"}, "next": {"$ref": "#"}}}
    rows = [('{"kind":"node","next":{"kind":"node"}}',), ('{"kind":"node","next":{"kind":"leaf"}}',), (None,), ("[]",), ('{"kind":"node","next":' * 900 + '{"kind":"node"}' + "}" * 900,)]
    df = spark.createDataFrame(rows, "j string").select(gate.accepts(node, p.from_json(F.col("j"))).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, False, False, False, True]


def test_kind_of_absent_values(spark):
    row = spark.range(1).select(p.kind(F.lit(None).cast("variant")).alias("absent"), p.kind(F.parse_json(F.lit("null"))).alias("null"), p.kind(F.parse_json(F.lit("1"))).alias("n")).first()
    assert tuple(row) == (None, "null", "number")


def test_payloads_of_columns(spark):
    sql = "SELECT 9007199254740993L AS l, CAST(1.50 AS DECIMAL(8,2)) AS d, 1.5D AS f, double('NaN') AS nan, 'x' AS s, true AS b, DATE'2024-02-03' AS day, TIMESTAMP'2024-02-03 04:05:06' AS at, array(1, 2) AS a, named_struct('p', 1, 'q', NULL) AS o, CAST(NULL AS INT) AS none"
    df = spark.sql(sql)
    cheap, by_json = (df.select(F.to_json(F.to_variant_object(m)).alias("j")).first().j for m in (p.from_frame(df), p.from_columns(*df.columns)))
    assert json.loads(cheap) == json.loads(by_json) and json.loads(cheap).keys() == set(df.columns)
    kinds = [df.select(*[p.kind(p.get(m, c)).alias(c) for c in df.columns]).first() for m in (p.from_frame(df), p.from_columns(*df.columns))]
    assert kinds[0] == kinds[1]


OVERLAYS = [
    ({"target": "$.a.b", "override": 1}, {"a": {"b": 0, "c": 2}}, {"a": {"b": 1, "c": 2}}), ({"target": "$.x.y", "override": 1}, {"x": 5}, {"x": {"y": 1}}), ({"target": "$.l[*].n", "override": 0}, {"l": [{"n": 1}, {"n": 2}]}, {"l": [{"n": 0}, {"n": 0}]}),
    ({"target": "$['k k']", "merge": {"b": None}}, {"k k": {"a": 1}}, {"k k": {"a": 1, "b": None}}), ({"target": "$", "merge": {"a": {"b": 2}}}, {"a": {"c": 1}}, {"a": {"b": 2, "c": 1}}), ({"target": "$.a", "merge": [1]}, {"a": [1, 2]}, {"a": [1]}),
    ({"target": "$.t[1]", "unset": True}, {"t": [1, 2, 3]}, {"t": [1, 3]}), ({"target": "$.r[?(@=='email')]", "unset": True}, {"r": ["id", "email"]}, {"r": ["id"]}), ({"target": "$.zzz", "unset": True}, {"a": 1}, {"a": 1}),
    ({"target": "$.zzz", "merge": {"a": 1}}, {"a": 1}, {"a": 1}),
]


@pytest.mark.parametrize("action,before,after", OVERLAYS)
def test_overlays(spark, action, before, after):
    document = [{"overlay": "1.0.0", "actions": [action]}]
    assert overlay.apply_to(before, document) == after
    got = spark.range(1).select(F.to_json(overlay.apply(F.parse_json(F.lit(json.dumps(before))), document)).alias("j")).first().j
    assert json.loads(got) == after


@pytest.mark.parametrize("action,before,after", [
    ({"target": "$.t[0]", "unset": True}, {"t": [1, 2, 3]}, {"t": [2, 3]}), ({"target": "$.t[2]", "unset": True}, {"t": [1, 2, 3]}, {"t": [1, 2]}),
    ({"target": "$.t[1].a", "unset": True}, {"t": [{"a": 1}, {"a": 2, "b": 3}]}, {"t": [{"a": 1}, {"b": 3}]}),
    ({"target": "$.t[1][0]", "unset": True}, {"t": [[1, 2], [3, 4, 5]]}, {"t": [[1, 2], [4, 5]]}), ({"target": "$.t[*]", "unset": True}, {"t": [1, 2]}, {"t": []}),
])
def test_unset_members(spark, action, before, after):
    """What moves up to the place of a member that is taken out stays as it is."""
    test_overlays(spark, action, before, after)


#: Paths that cannot be made: a column leaves the record as it is, a document raises.
UNMADE = [("$.b[1]", {"a": {}}), ("$.a[1].c", {"a": []}), ("$.a[3]", {"a": [1]}), ("$.x.y[2].z", {"x": 1}), ("$.x.y[2].z", {"x": {"y": {}}}), ("$.i[?(@.id=='b')].v", {"i": [{"id": "a"}, {"id": "b"}]})]
MADE = [("$.b[0]", {"a": {}}, {"a": {}, "b": [7]}), ("$.a[1].c", {"a": [1]}, {"a": [1, {"c": 7}]}), ("$.a.b[0].c", {"a": [1]}, {"a": {"b": [{"c": 7}]}}), ("$.a[0]", {"a": 5}, {"a": [7]}), ("$.a.b.c.d.e", {}, {"a": {"b": {"c": {"d": {"e": 7}}}}})]


@pytest.mark.parametrize("target,before,after", [*MADE, *[(t, b, None) for t, b in UNMADE]])
def test_created_paths(spark, target, before, after):
    document = [{"actions": [{"target": target, "override": 7}]}]
    got = spark.range(1).select(F.to_json(overlay.apply(F.parse_json(F.lit(json.dumps(before))), document)).alias("j")).first().j
    assert json.loads(got) == (before if after is None else after)
    if after is None:
        with pytest.raises(overlay.BadOverlay):
            overlay.apply_to(before, document)
    else:
        assert overlay.apply_to(before, document) == after


def test_plans_of_overlays_grow_with_their_actions(spark):
    sizes = []
    for n in (10, 20, 40):
        actions = [{"target": f"$.a.k{i % 5}[0]", "override": i} if i % 3 else {"target": "$.a", "merge": {"m": {f"k{i}": i}}} for i in range(n)]
        df = spark.range(1).select(F.to_json(overlay.apply(F.parse_json(F.lit("{}")), [{"actions": actions}])).alias("j"))
        sizes.append(len(df._jdf.queryExecution().analyzed().toString()))
        assert json.loads(df.first().j) == overlay.apply_to({}, [{"actions": actions}])
    assert sizes[2] < 4.5 * sizes[0]


def test_kinds_and_bounds_take_one_look(spark):
    """A kind names its value's schema once; bounds below 2^53 are told by doubles, as exactly as before."""
    value = F.col("v")
    plan = spark.createDataFrame([("1",)], "j string").select(F.parse_json("j").alias("v"))
    assert plan.select(p.kind(value).alias("k"))._jdf.queryExecution().analyzed().toString().count("schema_of_variant(v") <= 2
    assert "schema_of_variant" not in plan.select(gate._compared(value, 40, "__le__").alias("k"))._jdf.queryExecution().analyzed().toString()
    rows = ["1", '"a"', "null", "true", "[1]", "{}", "1.5", "1e300", "99999999999999999999", "9007199254740993", "-9007199254740993", "40", "40.0", "41"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").withColumn("v", F.parse_json("j"))
    kinds = [r.k for r in df.orderBy("i").select(p.kind(value).alias("k")).collect()]
    assert kinds == ["number", "string", "null", "boolean", "array", "object", *["number"] * 8]
    assert [r.k for r in spark.sql("SELECT CAST(DATE '2020-01-01' AS VARIANT) AS v UNION ALL SELECT CAST(NULL AS VARIANT)").select(p.kind(value).alias("k")).collect()] == ["string", None]
    for bound in (40, -40, 2**53 - 1, 2**53, 2**53 + 1, -(2**53), 1 - 2**53):
        for how in ("__le__", "__ge__", "__eq__", "__lt__", "__gt__"):
            got = [r.k for r in df.filter("i >= 8").orderBy("i").select(gate._compared(value, bound, how).alias("k")).collect()]
            assert got == [getattr(int(float(r)) if "." in r else int(r), how)(bound) for r in rows[8:]], (bound, how)


def test_overlays_by_kind(spark, monkeypatch):
    """Kinds with an expression of their own, kinds beyond them and the generic step alone give the same."""
    befores = [{"a": {"b": [1, {"c": 2}]}, "l": [{"id": "x"}, {"id": "y", "n": 1}], "s": "t"}, {}, {"a": [1], "l": {"k": {"n": 1}}}, [1, 2], "text", None, {"l": [], "a": {"b": None}, "d": {}}]
    actions = [
        {"target": "$.a.b[1].c", "override": 5}, {"target": "$.l[?(@.id=='y')].n", "override": 7}, {"target": "$.l[*]", "merge": {"seen": {"by": "o"}, "e": {}}}, {"target": "$.new.path[0]", "override": "deep"}, {"target": "$.l[0]", "unset": True},
        {"target": "$.s", "override": None}, {"target": "$.d", "merge": {}}, {"target": "$.d.*", "unset": True}, {"target": "$.l[1]", "override": {"id": "z"}}, {"target": "$.a", "merge": {"q": [1]}}, {"target": "$.*", "merge": {"all": 1}}, {"target": "$.gone", "unset": True},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(befores)], "i int, j string").withColumn("v", F.parse_json("j"))

    def after(own, some):
        monkeypatch.setattr(overlay, "OWN", own)
        return {r.i: json.loads(r.o) for r in df.select("i", F.to_json(overlay.apply(F.col("v"), [{"actions": some}])).alias("o")).collect()}

    assert after(64, actions) == after(0, actions) == after(3, actions)
    found, kinds, rest = overlay._numbered(overlay.operations([{"actions": actions}]))
    assert len(kinds) == 3 and rest and {o["own"] for o in found} == {0, 1, 2, None}
    got = after(16, [{"target": "$", "override": {"x": 1}}, *actions[3:5]])
    assert list(got.values()) == [{"x": 1, "new": {"path": ["deep"]}}] * len(befores)


def test_overlay_registry(spark):
    one, two = ({"actions": [{"target": "$.a", "override": x}]} for x in (1, 2))
    known = overlay.OverlayRegistry({"one": [one]}).register("two", two)
    assert known.has("two") and not known.has("x") and known.documents_for("x") == [] and known.stack_for("two", "x", "one") == [two, one]
    df = spark.createDataFrame([(["one", "two"],), (["two", "x", "one"],), ([],)], "k array<string>")
    assert [r.j for r in df.select(F.to_json(overlay.apply_by_keys(F.parse_json(F.lit("{}")), F.col("k"), known)).alias("j")).collect()] == ['{"a":2}', '{"a":1}', "{}"]
    with pytest.raises(overlay.BadOverlay):
        known.register("bad", {"actions": [{"target": "$.a"}]})


@pytest.mark.parametrize("bad", [{"target": "", "unset": True}, {"target": "$.a"}, {"target": "$.a", "unset": True, "merge": {}}, {"target": "$..a", "unset": True}])
def test_bad_overlays(bad):
    with pytest.raises(overlay.BadOverlay):
        overlay.apply_to({"a": 1}, [{"actions": [bad]}])


def test_schema_documents():
    a, b = obj({"x": {"type": "integer"}, "y": STRING}), obj({"x": {"type": "number"}, "z": STRING})
    assert s.diff(a, b) == {"added": ["z"], "dropped": ["y"], "widened": [{"field": "x", "from": ["integer"], "to": ["number"]}], "changed": [], "breaking": True}
    assert s.fingerprint({"b": 1, "a": [1, 2], "title": "t"}) == s.fingerprint({"a": [1, 2], "b": 1}) != s.fingerprint({"a": [2, 1], "b": 1})
    assert s.fingerprint({"type": "string", "nullable": True}) == s.fingerprint({"type": ["string", "null"]})
    assert s.only_defaults_added(a, obj({"x": {"type": "integer", "default": 1}, "y": STRING})) and not s.only_defaults_added(a, b)
    assert s.only_optional_removed({"properties": {"p": {"x-optional": True}}}, {"properties": {"p": {}}}) and not s.only_optional_removed({"default": {"x-optional": True}}, {"default": {}})
    assert s.version_of("https://x/a/12") == 12 and s.version_of("https://x/a/v2") is None
    assert s.versioned_id("a/b", 3, "https://x.example/") == "https://x.example/a/b/3" and s.versioned_id("a", 1, False) is None
    with pytest.raises(s.MissingBaseUri):
        s.versioned_id("a", 1, None)
    with pytest.raises(s.NonAbsoluteBaseUri):
        s.versioned_id("a", 1, "/schemas")
    with pytest.raises(s.MisplacedMigration, match="/properties/a/properties/b"):
        s.check_placement({"properties": {"a": {"properties": {"b": {"x-migrate-from": "c"}}}}})
    registry = {"https://x/a/1": {"$id": "https://x/a/1", "properties": {"b": {"$ref": "https://x/b/1"}}}, "https://x/b/1": {"$id": "https://x/b/1"}}
    assert list(s.bundle({"$ref": "https://x/a/1"}, registry)["$defs"]) == ["https://x/a/1", "https://x/b/1"]
    assert len(s.artifact_name("https://x.example/" + "long-" * 60 + "/1")) == 100 + 1 + 16 + len(".schema.json")


def test_registry_is_write_once(spark):
    from pactframe.operators import catalog

    one = {"$id": "https://x/a/1", "type": "object"}
    frozen = catalog.register(catalog.catalog(spark, [one]), catalog.catalog(spark, [one | {"title": "t"}, {"$id": "https://x/b/1"}]))
    assert sorted(r.id for r in frozen.collect()) == ["https://x/a/1", "https://x/b/1"]
    with pytest.raises(catalog.RegistryConflict):
        catalog.register(frozen, catalog.catalog(spark, [one | {"type": "array"}]))
    with pytest.raises(catalog.RegistryConflict):
        catalog.register(frozen, catalog.catalog(spark, [{"$id": "https://x/c/1"}, {"$id": "https://x/c/1", "type": "object"}]))
    for bad, error in (({"$id": "https://x/d/1", "items": {s.MIGRATE_FROM: "a"}}, s.MisplacedMigration), ({"type": "object"}, ValueError)):
        with pytest.raises(error):
            catalog.register(frozen, catalog.catalog(spark, [bad]))


def test_schema_diff_of_tables(spark, sf):
    """The same differences from sets of (field, type), read from the files."""
    import pyarrow.parquet as pq

    names = {"int64": "long", "int32": "integer", "double": "double", "string": "string", "large_string": "string", "timestamp[us]": "timestamp_ntz", "date32[day]": "date"}
    fields = {t: {f.name.split("_", 1)[-1]: names.get(str(f.type), str(f.type)) for f in pq.read_schema(f"{sf}/{t}.parquet")} for t in queries.TABLES}
    want = set()
    for a, b in zip(queries.TABLES, queries.TABLES[1:]):
        x, y = fields[a], fields[b]
        kinds = {k: "added" for k in y.keys() - x.keys()} | {k: "dropped" for k in x.keys() - y.keys()} | {k: "changed" for k in x.keys() & y.keys() if x[k] != y[k]}
        breaking = bool({"dropped", "changed"} & set(kinds.values()))
        want |= {(a, b, kind, k, breaking) for k, kind in kinds.items()}
    assert {tuple(r) for r in queries.QUERIES["schema_diff_tables"](spark, sf).collect()} == want


def test_catalogs(spark):
    from pactframe.operators import catalog

    a = spark.createDataFrame([("x", None), ("y", "1"), ("z", "1"), ("v", None)], "id string, fingerprint string")
    b = spark.createDataFrame([("x", None), ("y", "2"), ("w", None), ("v", "1")], "id string, fingerprint string")
    assert {r.id: r.status for r in catalog.compare(a, b).collect()} == {"x": "same", "y": "drifted", "z": "missing", "w": "orphaned", "v": "drifted"}
    files = spark.createDataFrame([("src/a/b/c",), ("src/a/x",), ("lib",), (None,), ("src/a/x",)], "path string")
    roots = spark.createDataFrame([("src/a", "A"), ("src/a/b", "B"), ("src/a/b", "C")], "root string, owner string")
    assert {r.owner: r.files for r in catalog.owners(files, roots).collect()} == {"A": 2, "B": 1, "app": 2}
    assert catalog.owners(files.limit(0), roots).count() == 0
    docs = [obj({"p": {"anyOf": [{"type": "string"}, {"anyOf": [{"$ref": "#/$defs/q"}, {"type": ["null", "integer"]}]}]}, "r": {}, "t": {"$ref": "u", "type": "string"}})]
    got = {r.field: r.types for r in catalog.properties(catalog.catalog(spark, docs)).collect()}
    assert got == {k: s.types_of(v) for k, v in docs[0]["properties"].items()}
    assert s.unresolvable({"$ref": "https://x/a/1", "p": {"$ref": "#/$defs/z"}}, {"https://x/a/1": {"$id": "https://x/a/1", "q": {"$ref": "https://x/b/1"}}}) == ["https://x/b/1"]
    url = spark.range(1).select(catalog.host_of(F.lit("https://x.example:81/a/b/1")).alias("h"), catalog.path_of(F.lit("https://x.example:81/a/b/1")).alias("p"), catalog.path_of(F.lit("/rel/2")).alias("q")).first()
    assert tuple(url) == ("x.example", "a/b/1", "rel/2")


def test_python_transforms_by_name_and_pair(spark):
    old, new = obj({"title": STRING}) | {"$id": "https://x.example/a/1"}, obj({"slug": {"type": "string", "minLength": 5, "x-migrate": "slugify"}}) | {"$id": "https://x.example/a/2"}
    slug = ladder.Transforms.in_python(lambda record: {"slug": record["title"].lower().replace(" ", "-")} if record["title"] != "skip" else None)
    for t in (ladder.Transforms().named("slugify", slug), ladder.Transforms().for_pair(old["$id"], new["$id"], slug)):
        assert climbed(spark, {"title": "Hello World"}, old, new, ladder.Ladder.default(t)) == ("custom-transform", {"slug": "hello-world"})
        assert climbed(spark, {"title": "skip"}, old, new, ladder.Ladder.default(t)) == (None, None)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in (*queries.TABLES, "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = queries.QUERIES[name](spark, sf)
    names = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == sorted(want, key=str)


def test_ladder_on_a_stream(spark, sf, tmp_path):
    from pactframe.streaming import ladders

    ladders.project_stream(spark, sf, str(tmp_path / "out"), str(tmp_path / "checkpoint"), queries.EVENT, files="events*.parquet")
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "quarantined", "rung").collect()
    want = queries.QUERIES["source_projection_events"](spark, sf).select("event_id", "quarantined", "rung").collect()
    assert sorted(got) == sorted(want)
