import json

import pytest
from pyspark.sql import functions as F

from pactframe.operators import catalog, identity, nodes, overlay
from pactframe.plans import schemas as s

DOCUMENTS = [
    {}, {"b": 1, "a": [1, 2, {}], "title": "t"}, {"type": "string", "nullable": True}, {"nullable": True, "not": {"type": "null", "nullable": False}, "enum": [1]}, {"nullable": True, "$ref": "#/x", "enum": ["a"], "description": "d"},
    {"anyOf": [{"type": "string"}, {"type": "null"}], "nullable": True}, {"properties": {"x/y~": {"nullable": True, "anyOf": [{"type": "string"}], "enum": ["a", None]}}}, {"nullable": "x", "type": ["a", "null"], "b": [[], [[]], {"c": []}]},
    {"a": 'q"\\\n\t\x01é\x7f', "b": [True, False, None, -0, 1.0, 1.5, 1e3, 1e22, 1.5e-7, 0.0001, 123456789012345678901234567890, 2.50, 9007199254740993]}, {"nullable": True}, {"nullable": True, "type": ["string"], "anyOf": None},
    {"properties": {"nullable": {"type": "boolean"}}}, {"anyOf": [{"description": "d", "type": "null"}], "nullable": True}, [1, {"z": 1, "$id": "x"}], "text", 5,
]


def rows(spark, documents):
    return spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)) for k, v in documents.items()], "id string, body string")


def test_texts_and_fingerprints(spark):
    """Every document's canonical text and fingerprint as the driver's functions have them; broken and null bodies have none."""
    known = {str(i): json.dumps(d, ensure_ascii=False) for i, d in enumerate(DOCUMENTS)}
    df = rows(spark, known | {"broken": "{x", "none": None})
    texts = {r.id: r.text for r in nodes.texts(nodes.walk(df)).collect()}
    assert texts == {str(i): s._written(s.canonical(d)) for i, d in enumerate(DOCUMENTS)}
    prints = {r.id: r.fingerprint for r in nodes.fingerprints(df).collect()}
    assert prints == {str(i): s.fingerprint(d) for i, d in enumerate(DOCUMENTS)}
    assert nodes.fingerprints(df.limit(0)).count() == 0


def test_catalogs_of_bodies(spark):
    """Clashing columns stay the caller's or are replaced as named; what is no JSON has neither id nor fingerprint."""
    bodies = spark.createDataFrame([('{"$id":"a/1","x":1}', 1, "p"), ('{"x":1,"$id":"a/1"}', 2, "q"), ("{", 3, "r"), (None, 4, "s")], "doc string, id int, _row string")
    got = {r["_row"]: (r["id"], r["fingerprint"], r["body"]) for r in catalog.of_bodies(bodies, "doc").collect()}
    assert got["p"][1] == got["q"][1] == s.fingerprint({"x": 1}) and got["p"][0] == "a/1"
    assert got["r"] == (None, None, "{") and got["s"] == (None, None, None)


OLD = {"$id": "a/1", "properties": {"x": {"type": "string", "x-optional": True}, "y": {"type": "string"}}}
DRIFTS = [
    ("a/1", OLD, {"$id": "a/1", "properties": {"x": {"type": "string"}, "y": {"type": "string"}}}, "refreezable"), ("a/1", OLD, OLD | {"title": "t"}, "checked"), ("a/1", OLD, OLD | {"default": {"deep": [1]}}, "refreezable"), ("a/2", OLD, OLD | {"default": 1}, "drifted"),
    ("a/1", OLD, OLD | {"other": {"default": 1}}, "drifted"), ("a/1", {"enum": [{"x-optional": True}]}, {"enum": [{}]}, "drifted"), ("a/1", {"default": 1}, {"default": 2}, "drifted"), ("a/1", {"a": {}}, {"a": {"default": 1}}, "refreezable"), ("a/1", {"a": [1]}, {"a": {}}, "drifted"),
    ("a/1", OLD, None, "unfrozen"), ("a/1", None, OLD, "unreadable"), ("a/3", {"x-optional": True}, {}, "refreezable"), ("a/1", {"x-optional": True}, {"default": 1}, "drifted"),
]


def test_drift_by_nodes(spark):
    """Statuses as the driver's functions judge them; broken bodies and missing fingerprints on either side; no row is lost."""
    current, frozen, want = {}, {}, {}
    for i, (name, old, new, status) in enumerate(DRIFTS):
        key = f"https://x/{i}/{name}"
        current[key] = "{broken" if old is None else json.dumps(old if new is None else new)
        frozen[key] = json.dumps(old) if old is not None and new is not None else "[broken" if new is None else json.dumps(new)
        want[key] = status
        if old is not None and new is not None and status != "checked":
            inert = (s.version_of(key) == 1 and s.only_defaults_added(old, new)) or s.only_optional_removed(old, new)
            assert ("refreezable" if inert else "drifted") == status
    printed = lambda df: df.join(nodes.fingerprints(df), "id", "left")
    a, b = printed(rows(spark, current)), printed(rows(spark, frozen))
    assert {r.id: r.status for r in catalog.drift(a, b).collect()} == want
    for x, y in ((a.withColumn("fingerprint", F.lit(None).cast("string")), b), (a, b.withColumn("fingerprint", F.lit(None).cast("string")))):
        assert {r.id: r.status for r in catalog.drift(x, y).collect()} == want
    assert catalog.drift(a.limit(0), b).count() == 0


def test_deep_unions(spark):
    deep = {"type": "string"}
    for _ in range(7):
        deep = {"anyOf": [deep, {"type": "null"}]}
    made = lambda inner: {"$id": "a/1", "properties": {"x": json.loads(json.dumps(deep).replace("string", inner)), "y": {"anyOf": []}, "z": True}}
    old, new = catalog.catalog(spark, [made("string")]), catalog.catalog(spark, [made("boolean")])
    assert {r.field: r.types for r in catalog.properties(old).collect()} == {"x": ["null", "string"], "y": [], "z": []}
    assert [(r.field, r.kind, r.breaking) for r in catalog.diff(old, new).collect()] == [("x", "changed", True)]


LINKED = [
    {"$id": "https://x/a/1", "properties": {"b": {"$ref": "https://x/b/1"}}}, {"$id": "https://x/b/1", "items": {"$ref": "https://x/a/1"}, "$defs": {"q": {"$ref": "https://x/gone/1"}}}, {"$id": "https://x/d/1", "type": "object", "$schema": "s", "default": {"$ref": "#/local"}},
    {"$id": "https://x/c/1", "$ref": "https://x/loc/1", "$defs": {"loc": {"$id": "https://x/loc/1", "$ref": "https://x/b/1"}, "un": {"$ref": "https://x/un/1"}, "b": {"$id": "https://x/b/1", "type": "null"}}}, {"$id": "https://x/e/1", "$ref": "https://x/e/1"},
]


def test_bundles_and_resolvability(spark):
    """Cycles, own definitions before the registry, nested definitions and unknown references, as the driver's functions bundle one document."""
    by_id = {d["$id"]: d for d in LINKED}
    documents = rows(spark, by_id)
    for registry in (documents, documents.filter("id LIKE '%b/1'"), None):
        known = {} if registry is None else {k: by_id[k] for (k,) in registry.select("id").collect()}
        found = nodes.References(documents, registry)
        assert {r.id: json.loads(r.body) for r in found.bundles().collect()} == {k: s.bundle(d, known) for k, d in by_id.items()}
        told = {}
        for r in found.unresolved().collect():
            told.setdefault(r.id, set()).add(r.ref)
        assert told == {k: set(x) for k, d in by_id.items() if (x := s.unresolvable(d, known))}
    empty = nodes.References(documents.limit(0), documents)
    assert empty.bundles().count() == 0 and empty.unresolved().count() == 0


def test_a_long_chain(spark):
    chain = {f"https://x/{i}/1": {"$id": f"https://x/{i}/1", "items": {"$ref": f"https://x/{i + 1}/1"}} for i in range(12)}
    found = nodes.References(rows(spark, {"https://x/0/1": chain["https://x/0/1"]}), rows(spark, chain))
    assert len(json.loads(found.bundles().first().body)["$defs"]) == 11
    assert [tuple(r) for r in found.unresolved().collect()] == [("https://x/0/1", "https://x/12/1")]


def test_misplaced_renames(spark):
    documents = {"1": {"properties": {"a": {"x-migrate-from": "b"}}}, "2": {"properties": {"a": {"items": {"x-migrate-from": "b"}}}}, "3": {"x-migrate-from": "b"}, "4": {"enum": [{"x-migrate-from": "b"}]}, "5": {"properties": {"x-migrate-from": {}}}, "6": {"$defs": {"a/b": {"x-migrate-from": "b"}}}}
    got = {r.id: r.pointer for r in nodes.misplaced(rows(spark, documents)).collect()}
    assert got == {"2": "/properties/a/items/x-migrate-from", "3": "/x-migrate-from", "6": "/$defs/a~1b/x-migrate-from"}
    for k, d in documents.items():
        if k in got:
            with pytest.raises(s.MisplacedMigration):
                s.check_placement(d)
        else:
            s.check_placement(d)


ACTIONS = [
    [{"target": "$.a", "override": {"b": [1, {"c": None}]}}, {"target": "$.a.b[1].c", "override": "x"}, {"target": "$.a.b[2]", "override": 3}], [{"target": "$.l[*]", "merge": {"m": {"n": {}}}}, {"target": "$.l[?(@.id=='q\"s')].m.n", "override": 1.5}],
    [{"target": "$", "merge": {"a": {"x": {}, "y": [1]}, "new": {"deep": {"er": None}}}}, {"target": "$['k.k'][\"z z\"]", "override": True}], [{"target": "$.*", "unset": True}], [{"target": "$", "override": []}, {"target": "$[0].a", "override": 1}],
    [{"target": "$.t[?(@=='b')]", "unset": True}, {"target": "$.t[0]", "unset": True}], [{"target": "$.a", "merge": {}}, {"target": "$.s", "merge": {}}, {"target": "$.s", "merge": 5}], [],
]
BEFORE = {"a": {"b": 0, "x": 1}, "l": [{"id": 'q"s'}, 4], "t": ["a", "b"], "s": "text"}


def test_overlays_from_a_table(spark):
    """The same as on documents of the driver, for each stack of keys: order of keys, of documents in a key and of actions; unknown and null keys."""
    overlays = spark.createDataFrame([(f"k{i // 2}", i % 2, json.dumps({"actions": a})) for i, a in enumerate(ACTIONS)], "key string, n int, body string")
    documents = {f"k{j}": [{"actions": a} for a in ACTIONS[2 * j : 2 * j + 2]] for j in range(4)}
    stacks = [["k0"], ["k1", "k0"], ["k0", "k1", "zz", "k2"], [], None, ["zz"], ["k3", "k3"], ["k2", "k2"], [None, "k0"]]
    df = spark.createDataFrame([(i, k, "row") for i, k in enumerate(stacks)], "i int, _keys array<string>, _row string").withColumn("v", F.parse_json(F.lit(json.dumps(BEFORE))))
    got = overlay.apply_stacks(df, "v", "_keys", overlays)
    assert got.columns == df.columns
    found = {r.i: json.loads(r.j) for r in got.select("i", F.to_json("v").alias("j")).collect()}
    for i, keys in enumerate(stacks):
        stack = [d for k in keys or [] for d in documents.get(k, [])]
        assert found[i] == json.loads(spark.range(1).select(F.to_json(overlay.apply(F.parse_json(F.lit(json.dumps(BEFORE))), stack)).alias("j")).first().j), keys
        try:
            assert found[i] == overlay.apply_to(BEFORE, stack)
        except overlay.BadOverlay:
            pass  # a document raises where nothing matches, a column stays
    assert overlay.apply_stacks(df, "v", "_keys", overlays.limit(0)).count() == len(stacks)
    assert overlay.apply_stacks(df.limit(0), "v", "_keys", overlays).count() == 0


@pytest.mark.parametrize("body", ["{", None, '{"actions":{}}', '{"actions":[{"unset":true}]}', '{"actions":[{"target":"$.a"}]}', '{"actions":[{"target":"$.a","unset":true,"merge":{}}]}', '{"actions":[{"target":"$..a","unset":true}]}', '{"actions":[{"target":"a","unset":true}]}'])
def test_unreadable_overlays_of_a_table(spark, body):
    overlays = spark.createDataFrame([("k", 0, body), ("l", 0, '{"actions":[]}')], "key string, n int, body string")
    assert [r.key for r in overlay.problems(overlays).collect()] == ["k"]
    with pytest.raises(overlay.BadOverlay):
        overlay.apply_stacks(spark.sql("SELECT parse_json('{}') AS v, array('k') AS keys"), "v", "keys", overlays)


def test_plans_do_not_grow_with_keys_or_actions(spark):
    sizes = []
    for n in (2, 400):
        overlays = spark.range(n).selectExpr("concat('k', id) AS key", "0 AS n", """'{"actions":[{"target":"$.a","override":1},{"target":"$.b","override":2}]}' AS body""")
        out = overlay.apply_stacks(spark.range(n).selectExpr("array(concat('k', id)) AS keys", "parse_json('{}') AS v"), "v", "keys", overlays)
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
        assert out.filter("to_json(v) = '{\"a\":1,\"b\":2}'").count() == n
    assert sizes[1] < 1.1 * sizes[0]
    many = [{"target": f"$.k{i % 7}.v", "override": i} for i in range(200)]
    assert len(json.loads(spark.range(1).select(F.to_json(overlay.apply(F.parse_json(F.lit("{}")), [{"actions": many}])).alias("j")).first().j)) == 7


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_owners_by_longest_root(spark, partitions):
    """Roots in roots, roots that are paths, names that begin alike, repeated paths and roots, borders of partitions inside a root, null paths."""
    roots = [("a", "A"), ("a/b", "B"), ("a/b/c", "C"), ("a/b/c", "B2"), ("ab", "AB"), ("z/y", "Z"), (None, "N"), ("q", None), ("a/b/x.py", "X")]
    paths = ["a/1", "a/b/1", "a/b/c/1", "a/b/cc/1", "ab/1", "abc/1", "a", "z/1", "z/y", "z/y/1", "q/1", "a/b/x.py", "", "/a/1", None, None] + [f"a/b/{i % 50}/{i}" for i in range(300)] + ["a/1", "a/b!/1", "a!"]
    known = {}
    for root, owner in roots:
        if root is not None and owner is not None:
            known[root] = min(owner, known.get(root, owner))
    want = {}
    for path in paths:
        parts = path.split("/") if path is not None else []
        owner = next((known[r] for i in range(len(parts), 0, -1) if (r := "/".join(parts[:i])) in known), "app")
        want[owner] = want.get(owner, 0) + 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalog.owners(spark.createDataFrame([(x,) for x in paths], "path string"), spark.createDataFrame(roots, "root string, owner string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.owner: r.files for r in got} == want and [(-r.files, r.owner) for r in got] == sorted((-n, o) for o, n in want.items())


@pytest.mark.parametrize("base", ["https://x.example/s/", False, None, "", "/rel", True])
def test_references_resolve_as_on_the_driver(spark, base):
    refs = ["https://a.example/b/1", " /b/1", "b/1", "//b//1", "", "urn:x:y", None]
    rows = spark.createDataFrame(list(enumerate(refs)), "i int, ref string").select("i", identity.resolved(F.col("ref"), base).alias("r")).orderBy("i").collect()
    for ref, r in zip(refs, [x.r for x in rows]):
        if ref is None:
            assert r.id is None and r.problem is None and r.grammar is None
        elif s.is_absolute(ref) or base is False or isinstance(base, str) and s.is_absolute(base):
            assert (r.id, r.problem, r.grammar) == (s.resolve_id(ref.strip(), base if base != "https://x.example/s/" else "https://x.example/s"), None, -1)
        else:
            assert r.id is None and ref in r.problem


def test_the_first_source_keeps_its_slot(spark):
    a, b = (spark.createDataFrame(x, "class_name string, at int, more string") for x in ([("x", 5, "m"), ("y", 2, "m"), ("x", 3, "m")], [("y", 0, "m"), ("z", 9, "m"), ("z", 7, "m")]))
    got = catalog.union_of_sources(a, b, order="at").orderBy("source", "slot").collect()
    assert [tuple(r) for r in got] == [("y", 0, 2), ("x", 0, 3), ("z", 1, 7)]


def test_closures_are_one_row_for_each_document(spark):
    """Rounds move numbers of what is new, documents of a cycle share one closure, and identifiers are written as JSON wherever they stand."""
    name = lambda i: f'https://x/"{i}\\/1'
    by_id = {name(i): {"$id": name(i), "b": {"$ref": name((i + 1) % 5)}, "a": {"z": 1.5, "k": [{"$ref": "https://x/own/1"}]}, "$defs": {"q\n": {"$id": "https://x/own/1", "$ref": name(i)}}} for i in range(5)}
    documents = rows(spark, by_id)
    found = nodes.References(documents, documents)
    assert found._reached.count() == 5
    assert {r.id: json.loads(r.body) for r in found.bundles().collect()} == {k: s.bundle(d, by_id) for k, d in by_id.items()}
    assert found.unresolved().count() == 0


def test_plain_documents_are_not_taken_apart(spark, monkeypatch):
    """Objects that are written as they are, once the root's volatile keys are gone, are not walked; all fingerprints are the driver's."""
    plain = [{"$id": "a/1", "type": "object", "b": [1, {"z": None, "a": True}], "title": "t"}, {"b": "v:1", "a": {}}, {"title": "t"}]
    uneven = [{"a": {"title": "t"}}, {"a": {"nullable": True, "type": "string"}}, {"nullable": True, "type": "string"}, {"a": 1.0}, {"a": 10**20}, {"a": "q\"\\"}, {"a": "ü"}, {"a": 1e-7}]
    by_id, walked, walk = {str(i): d for i, d in enumerate([*plain, *uneven])}, [], nodes.walk
    monkeypatch.setattr(nodes, "walk", lambda documents, *more: walked.append(documents) or walk(documents, *more))
    assert {r.id: r.fingerprint for r in nodes.fingerprints(rows(spark, by_id)).collect()} == {k: s.fingerprint(d) for k, d in by_id.items()}
    assert {r.id for r in walked[0].collect()} == set(map(str, range(len(plain), len(by_id))))


def test_targets_and_kinds_are_told_once(spark, monkeypatch):
    """Many overlays of few targets: their commonest kinds are numbered, the others are left to the generic step, and nothing changes."""
    bodies = [(f"k{i}", 0, json.dumps({"actions": [{"target": "$.a", "override": i}, {"target": "$.m", "override": {}}, {"target": "$.m", "merge": {"x": {"y": i}, "e": {}}}, {"target": f"$.odd{i}", "override": None}]})) for i in range(9)]
    overlays = spark.createDataFrame(bodies, "key string, n int, body string")
    rows = spark.range(9).selectExpr("id", "array(concat('k', id)) AS keys", "parse_json('{}') AS v")
    for own in (3, 5, 64):
        monkeypatch.setattr(overlay, "OWN", own)
        found, kinds, shape = overlay._compiled(overlays)
        assert len(kinds) == min(own, 13) and (shape is None) == (own == 64) and {o.own for r in found.collect() for o in r.operations} == {*range(len(kinds)), *([] if own == 64 else [None])}
        got = {r.id: json.loads(r.j) for r in overlay.apply_stacks(rows, "v", "keys", overlays).selectExpr("id", "to_json(v) AS j").collect()}
        assert got == {i: {"a": i, "m": {"x": {"y": i}, "e": {}}, f"odd{i}": None} for i in range(9)}
