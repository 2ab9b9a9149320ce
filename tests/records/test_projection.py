import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.functions import gate
from pactframe.functions import payload as p
from pactframe.operators import fixtures
from pactframe.plans import documents as d
from pactframe.plans import projection as x
from pactframe.sources import types as sources

TEXT, WHOLE = T.StringType(), T.LongType()


def record(name, *fields, **more):
    return x.RecordType(name, T.StructType([T.StructField(n, k, False, m) if len(f) == 3 else T.StructField(n, k, f[3], m) for f in fields for n, k, m in [f[:3]]]), **more)


def document(*kinds, mode="collapsed", base_uri=False, **more):
    return x.Projector(x.Types(*kinds, vocabularies=more.pop("vocabularies", None)), mode=mode, base_uri=base_uri, **more).document(kinds[0].name)


def prop(kind, meta, nullable=False, *others, **more):
    return document(record("A", ("f", kind, meta, nullable)), *others, **more)["properties"]["f"]


PLAIN = [
    (WHOLE, {"type": "integer"}), (T.DoubleType(), {"type": "number"}), (T.DecimalType(9, 2), {"type": "number"}), (T.BooleanType(), {"type": "boolean"}), (TEXT, {"type": "string"}),
    (T.TimestampType(), {"type": "string"}), (T.BinaryType(), {"type": "string", "format": "binary"}), (T.ArrayType(WHOLE), {"type": "array", "items": {"type": "integer"}}), (T.ArrayType(T.VariantType()), {"type": "array"}),
    (T.MapType(TEXT, WHOLE), {"type": "object", "additionalProperties": {"type": "integer"}}), (T.MapType(TEXT, T.VariantType()), {"type": "object"}),
]


@pytest.mark.parametrize("kind,want", PLAIN)
def test_types(kind, want):
    assert prop(kind, {}) == want


COLOUR = x.EnumType("app.Colour", ("red", "blue"), labels=("Red", "Blue"))
RULES = [
    (TEXT, [["max", 5], ["min", 1]], {"maxLength": 5, "minLength": 1}), (WHOLE, [["max", 5]], {"maximum": 5}), (T.ArrayType(TEXT), [["min", 2]], {"minItems": 2}),
    (WHOLE, [["between", 1, 9]], {"minimum": 1, "maximum": 9}), (TEXT, [["between", 1, 9]], {}), (TEXT, [["url"]], {"format": "uri", "examples": ["https://example.com"]}),
    (TEXT, [["in", "a", "b,c"]], {"enum": ["a", "b,c"], "examples": ["a"]}), (WHOLE, [["in", "1", "x", 2.5]], {"enum": [1], "examples": [1]}), (WHOLE, [["in", "x"]], {"not": {}}),
    (T.ArrayType(TEXT), [["in", "a"]], {"items": {"type": "string", "enum": ["a"]}}), (TEXT, [["exists_in", "none"]], {"not": {}}), (TEXT, [["exists_in", "some"]], {"enum": ["p", "q"], "examples": ["p"]}),
    (TEXT, [["enum", "app.Colour"]], {"enum": ["red", "blue"], "examples": ["red"]}),
]


@pytest.mark.parametrize("kind,rules,want", RULES)
def test_rules(kind, rules, want):
    got = prop(kind, {"rules": rules}, False, COLOUR, vocabularies={"none": list, "some": lambda: ["p", "q"]})
    assert got == prop(kind, {}) | want


def test_own_rule_and_nullable_vocabulary():
    assert prop(TEXT, {"rules": [["slug"]]}, rules={"slug": lambda: {"pattern": "^[a-z-]+$"}})["pattern"] == "^[a-z-]+$"
    assert prop(TEXT, {"rules": [["exists_in", "v"]]}, True, vocabularies={"v": lambda: ["p"]})["enum"] == ["p", None]


def test_modes_names_and_requiredness():
    kind = record("Post", ("title", TEXT, {"output": "heading", "input": "head"}), ("slug", TEXT, {"computed": True}), ("secret", TEXT, {"hidden": True}), ("note", TEXT, {"default": "x"}), ("late", TEXT, {"lazy": True}), ("maybe", TEXT, {"optional": True}))
    shape = {m: document(kind, mode=m) for m in x.MODES}
    assert list(shape["collapsed"]["properties"]) == ["heading", "slug", "note", "late", "maybe"] and shape["collapsed"]["required"] == ["heading", "slug", "note"]
    assert list(shape["request"]["properties"]) == ["head", "note", "late", "maybe"] and shape["request"]["required"] == ["head"]
    assert shape["response"]["required"] == ["heading", "slug", "note"]
    assert shape["collapsed"]["properties"]["late"] == {"type": "string", "readOnly": True, "x-lazy": True}
    strict = shape["llm_strict"]
    assert strict == {"type": "object", "properties": {"heading": {"type": "string"}, "slug": {"type": "string"}, "note": {"type": "string"}, "late": {"type": ["string", "null"]}, "maybe": {"type": ["string", "null"]}}, "additionalProperties": False, "required": ["heading", "slug", "note", "late", "maybe"]}
    with pytest.raises(x.Refused):
        document(kind, mode="other")


def test_strict_references():
    child = record("Child", ("n", WHOLE, {}))
    got = document(record("A", ("c", child.fields, {"ref": "Child", "description": "why"}), ("o", child.fields, {"ref": "Child", "optional": True})), child, mode="llm_strict")
    assert got["properties"] == {"c": {"anyOf": [{"$ref": "#/$defs/Child"}], "description": "why"}, "o": {"anyOf": [{"$ref": "#/$defs/Child"}, {"type": "null"}]}}


def test_defaults_fit_their_type():
    for kind, value, fits in [(TEXT, "a", True), (TEXT, 1, False), (T.DoubleType(), 1, True), (WHOLE, 1.5, False), (T.ArrayType(TEXT), [], True), (T.MapType(TEXT, TEXT), [], False), (WHOLE, True, False), (TEXT, None, False)]:
        assert ("default" in prop(kind, {"default": value})) == fits, (kind, value)
    assert prop(TEXT, {"ref": "app.Colour", "default": "red"}, False, COLOUR) == {"$ref": "#/$defs/Colour", "default": "red"}
    assert "default" not in prop(TEXT, {"ref": "app.Colour", "default": "green"}, False, COLOUR)


def test_identity_definitions_and_cycles():
    node = record("Node", ("next", T.VariantType(), {"ref": "Node"}, True), ("colour", TEXT, {"ref": "app.Colour"}))
    got = document(node, COLOUR)
    assert got["$id"] == "Node" and got["$defs"]["Node"]["properties"]["next"] == {"anyOf": [{"$ref": "#/$defs/Node"}, {"type": "null"}]}
    assert got["$defs"]["Colour"] == {"type": "string", "title": "Colour", "enum": ["red", "blue"], "enumNames": ["Red", "Blue"]}
    child = record("Child", ("n", WHOLE, {"was_named": "m", "source": {"path": "a.b"}}), version=2, identity="shop/child")
    parent = record("Parent", ("c", child.fields, {"ref": "Child"}), ("many", T.ArrayType(child.fields), {"ref": "Child"}))
    got = document(parent, child, base_uri="https://x.example/")
    assert got["properties"] == {"c": {"$ref": "https://x.example/shop/child/2"}, "many": {"type": "array", "items": {"$ref": "https://x.example/shop/child/2"}}}
    assert got["$defs"]["https://x.example/shop/child/2"]["properties"]["n"] == {"type": "integer", "x-migrate-from": "m", "x-source": {"path": "a.b"}}
    from pactframe.plans import schemas as s

    for base, error in ((None, s.MissingBaseUri), ("/x", s.NonAbsoluteBaseUri)):
        with pytest.raises(error):
            document(child, base_uri=base)
    assert "title" not in document(child, identifier_titles=False) and document(child)["$id"] == "Child"


def test_unions_and_refusals():
    cat, dog = record("Cat", ("kind", TEXT, {}), ("lives", WHOLE, {})), record("Dog", ("kind", TEXT, {}))
    pet = lambda **arms: record("Pet", ("kind", TEXT, {}), union=x.MorphUnion("kind", arms), abstract=True)
    got = document(pet(cat="Cat", dog="Dog"), cat, dog)
    assert got["oneOf"][0] == {"allOf": [{"$ref": "#/$defs/Cat"}, {"type": "object", "properties": {"kind": {"const": "cat"}}, "required": ["kind"]}]}
    for bad in (pet(), pet(cat="Colour"), record("Pet", ("other", TEXT, {}), union=x.MorphUnion("kind", {"cat": "Cat"}))):
        with pytest.raises(x.Refused):
            document(bad, cat, x.EnumType("Colour", ("red",)))
    with pytest.raises(x.Refused):
        prop(TEXT, {"keywords": {"label": 1}})
    assert prop(T.VariantType(), {"types": ["integer", "string"]}) == {"type": ["integer", "string"]}
    assert prop(T.VariantType(), {"types": [{"ref": "Dog"}, "string", "null"]}, False, dog)["anyOf"] == [{"$ref": "#/$defs/Dog"}, {"type": "string"}, {"type": "null"}]
    chain = x.Chain((lambda k: k.abstract, x.Projector(x.Types(pet(dog="Dog"), dog))), (lambda k: k.name == "Dog", x.Projector(x.Types(dog))))
    assert "oneOf" in chain.document(pet(dog="Dog")) and chain.document(dog)["title"] == "Dog"
    with pytest.raises(x.Refused):
        chain.document(cat)


def test_dereference_and_openapi():
    defs = {"B": {"$id": "B", "type": "object", "properties": {"c": {"$ref": "#/$defs/C"}}}, "C": {"type": "string"}}
    assert d.dereference({"properties": {"b": {"$ref": "#/$defs/B", "nullable": True}, "u": {"$ref": "#/$defs/U"}}, "$defs": defs}) == {"properties": {"b": {"type": "object", "properties": {"c": {"type": "string"}}, "nullable": True}, "u": {"$ref": "#/$defs/U"}}}
    loop = {"$ref": "https://x.example/n/1"}
    got = d.dereference(loop, {"https://x.example/n/1": {"$id": "https://x.example/n/1", "properties": {"next": {"$ref": "https://x.example/n/1"}}}})
    assert got["properties"]["next"] == {"$ref": "#/$defs/n_1"} and got["$defs"]["n_1"]["properties"]["next"]["properties"]["next"] == {"$ref": "#/$defs/n_1"}
    api = d.to_openapi({"properties": {"a": {"$ref": "https://x.example/a/1"}}, "$defs": {"https://x.example/a/1": {"$id": "https://x.example/a/1", "title": "Article", "type": "object"}}})
    assert api == {"properties": {"a": {"$ref": "#/components/schemas/Article"}}, "components": {"schemas": {"Article": {"title": "Article", "type": "object"}}}}
    with pytest.raises(d.NameCollision):
        d.to_openapi({"$defs": {"Article": {"type": "string"}, "https://x.example/a/1": {"title": "Article", "type": "object"}}})


PRINTED = [
    ({}, "{}"), ([], "[]"), ({"a": [1, 2], "b": {}}, '{\n    "a": [1, 2],\n    "b": {}\n}'), ([{"a": 1}], '[\n    {\n        "a": 1\n    }\n]'), ([[1, 2], [3, 4]], "[\n    [1, 2],\n    [3, 4]\n]"),
    (["x" * 40, "y" * 40], '[\n    "' + "x" * 40 + '",\n    "' + "y" * 40 + '"\n]'),
]


@pytest.mark.parametrize("value,want", PRINTED)
def test_printer(value, want):
    assert d.pretty(value) == want + "\n" and json.loads(d.pretty(value)) == value


def test_printer_fills_numbers():
    text = d.pretty(list(range(100)))
    assert json.loads(text) == list(range(100)) and max(map(len, text.splitlines())) <= 80 and len(text.splitlines()) < 10


def test_paths_and_door():
    assert [d.output_path("app.data.Post", "out", k) for k in ("namespace", "flat", "odd", lambda n, f: f"{f}!")] == ["out/app/data/Post.schema.json", "out/Post.schema.json", "out/app/data/Post.schema.json", "out!"]
    status, headers, body = d.served({"$id": "x"})
    assert status == 200 and json.loads(body) == {"$id": "x"} and d.served({"$id": "x"}, headers["ETag"])[0] == d.served({"$id": "x"}, "*")[0] == 304
    assert d.served(None) == (404, {"Cache-Control": "no-store"}, "")


def test_sources(spark, sf, tmp_path):
    a, b, hidden = record("app.A", ("n", WHOLE, {}), version=1), record("lib.B", ("n", WHOLE, {})), record("app.H", ("n", WHOLE, {}), abstract=True)
    found = sources.Sources().register("one", sources.explicit(a)).register("two", lambda: [record("app.A", ("m", TEXT, {})), b]).register("three", sources.explicit(hidden))
    assert found.types() == [a, b] and found.versioned() == [a]
    assert sources.explicit(b, [sources.collectable("app.*")])() == []
    with pytest.raises(ValueError):
        found.register("self", found.types)
    assert sources.of_tables(spark, sf, ["nation"])()[0].fields.names[0] == "n_nationkey"
    (tmp_path / "a.json").write_text('{"$id": "https://x.example/a/1", "type": "object"}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{broken")
    assert [r.id for r in sources.frozen(spark, str(tmp_path)).collect()] == ["https://x.example/a/1"]
    listed = json.dumps({"packages": [{"name": "z/z", "install-path": "../z"}, {"name": "a/a", "install-path": "../a/"}, {"name": "no/path"}]})
    assert sources.package_folders(listed, "vendor") == {"a/a": "vendor/../a/src/Data", "z/z": "vendor/../z/src/Data"}


def test_fixtures(spark, tmp_path):
    (tmp_path / "old-one.json").write_text('{"kind": "old"}')
    schema = {"type": "object", "properties": {"kind": {"type": "string", "examples": ["k"]}, "n": {"type": "integer"}}, "required": ["kind"]}
    twice = lambda m: F.create_map(F.lit("n"), (p.number(p.get(m, "n")) * 2).cast("bigint").cast("variant"))
    index = fixtures.Fixtures().shape("s", hooks=(twice,), schema=schema).load(spark, "s", str(tmp_path)).state("s", "bad", {"n": "x"})
    rows = index.factory("s").state("oldOne").sequence({"n": 1}, {"n": 2}).count(3).make(spark).select(p.to_json(F.col("payload")).alias("j")).collect()
    assert [json.loads(r.j) for r in rows] == [{"kind": "old", "n": n} for n in (2, 4, 2)]
    assert {r.state: r.accepted for r in index.verify(spark, "s").collect()} == {"old-one": True, "bad": False}
    with pytest.raises(fixtures.UnknownState, match="old-one"):
        index.factory("s").state("missing")
    (tmp_path / "z.json").write_text("[]")
    fresh = fixtures.Fixtures()
    with pytest.raises(ValueError):
        fresh.load(spark, "s", str(tmp_path))
    assert fresh.states == {}


def test_projected_schema_gates(spark):
    kind = record("A", ("n", WHOLE, {"rules": [["between", 1, 5]]}), ("t", TEXT, {"rules": [["in", "x"]]}, True))
    df = spark.createDataFrame([('{"n": 3, "t": "x"}',), ('{"n": 9, "t": "x"}',), ('{"n": 3, "t": null}',), ('{"t": "x"}',)], "j string")
    assert [r.ok for r in df.select(gate.accepts(document(kind), p.from_json(F.col("j"))).alias("ok")).collect()] == [True, False, True, False]
