import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from pactframe.functions import gate
from pactframe.functions import payload as p
from pactframe.operators import catalog, lens, vocabulary
from pactframe.operators.catalog import RegistryConflict
from pactframe.plans import schemas as s
from pactframe.sources import files, store


def made(i, v=1, **more):
    return {"$id": f"https://x/d{i}/{v}", "properties": {"a": {"type": "string"}}, **more}


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/store")


def test_a_store_is_written_once(spark, kept):
    assert kept.commits() == [] and kept.read().count() == 0
    first = catalog.catalog(spark, [made(1), made(2)])
    assert kept.put(first) == 0 and kept.put(first) is None  # again: nothing new
    assert kept.put(catalog.catalog(spark, [made(2, title="t"), made(3)])) == 1
    assert {r.id for r in kept.read().collect()} == {f"https://x/d{i}/1" for i in (1, 2, 3)} and kept.commits() == [0, 1]
    with pytest.raises(RegistryConflict):
        kept.put(catalog.catalog(spark, [made(4), made(1, type="object")]))
    with pytest.raises(RegistryConflict):
        kept.put(catalog.catalog(spark, [made(5), made(5, type="object")]))
    with pytest.raises(s.MisplacedMigration):
        kept.put(catalog.catalog(spark, [made(6, items={"x-migrate-from": "b"})]))
    assert kept.commits() == [0, 1] and os.listdir(kept.folder.removeprefix("file://") + "/staged") == []
    assert kept.put(catalog.catalog(spark, [made(1, v=2), made(1, v=10)])) == 2 and kept.versions("https://x/d1") == [1, 2, 10]


def test_two_writers_at_once(spark, kept):
    """Both take the same number; one comes second, keeps what is new and leaves out, or refuses, what the other wrote."""
    published, meet, results = store.Store._published, threading.Barrier(3), {}

    def held(self, staged, number):
        if number == 0:
            meet.wait(120)
        return published(self, staged, number)

    sets = {"a": [made(i) for i in range(0, 6)], "b": [made(i) for i in range(3, 9)], "c": [made(2), made(20, type="object"), made(4, type="array")]}

    def run(name):
        try:
            results[name] = store.Store(spark, kept.folder).put(catalog.catalog(spark, sets[name]))
        except RegistryConflict as e:
            results[name] = e

    store.Store._published = held
    try:
        threads = [threading.Thread(target=run, args=(n,)) for n in sets]
        [t.start() for t in threads]
        [t.join(240) for t in threads]
    finally:
        store.Store._published = published
    rows = kept.read().collect()
    assert len(rows) == len({r.id for r in rows})
    lost = [n for n, x in results.items() if isinstance(x, RegistryConflict)]
    assert sorted(lost) in (["c"], ["a"], ["b"], ["a", "b"]) and sorted(x for x in results.values() if isinstance(x, int)) == kept.commits()
    told = {r.id: r.fingerprint for r in rows}
    assert all(told[d["$id"]] == s.fingerprint(d) for n in sets if n not in lost for d in sets[n])


def test_a_number_is_taken_once(spark, kept):
    """Writers that rename at the same moment: one has the number, and nothing gets into its folder."""
    top = kept.folder.removeprefix("file://")
    for number in range(60):
        meet, won = threading.Barrier(6), []
        for i in range(6):
            os.makedirs(f"{top}/staged/{number}-{i}")
            open(f"{top}/staged/{number}-{i}/part", "w").close()

        def run(i, number=number, meet=meet, won=won):
            own = store.Store(spark, kept.folder)
            meet.wait(60)
            if own._published(f"{kept.folder}/staged/{number}-{i}", number):
                won.append(i)

        threads = [threading.Thread(target=run, args=(i,)) for i in range(6)]
        [t.start() for t in threads]
        [t.join(60) for t in threads]
        assert len(won) == 1 and os.listdir(f"{top}/commits/{number:020d}") == ["part"]


def test_freezing_by_scope(spark, kept):
    current = catalog.catalog(spark, [made(1), made(2), made(3)]).withColumn("owner", F.expr("CASE WHEN id LIKE '%d1/%' THEN 'v/one' WHEN id LIKE '%d2/%' THEN 'v/two' END"))
    action = lambda f: {r.id.split("/")[3]: r.action for r in f.report.collect()}
    dry = kept.freeze(current, "all", dry_run=True)
    assert dry.commit is None and set(action(dry).values()) == {"would freeze"} and kept.commits() == []
    assert action(kept.freeze(current)) == {"d1": "out of scope", "d2": "out of scope", "d3": "frozen"}
    assert action(kept.freeze(current, "v/one")) == {"d1": "frozen", "d2": "out of scope"}
    assert action(kept.freeze(current, "v/none")) == {"d2": "out of scope"}
    assert kept.freeze_version(current, made(2)["$id"]) == 2 and kept.freeze_version(current, made(2)["$id"]) is None
    with pytest.raises(KeyError):
        kept.freeze_version(current, "https://x/none/1")
    drifted = catalog.catalog(spark, [made(1, type="object"), made(9)]).withColumn("owner", F.lit(None).cast("string"))
    with pytest.raises(store.FreezeRefused):
        kept.freeze(drifted, "all")
    assert {r.status for r in kept.check(current).collect()} == {"checked"} and len(kept.commits()) == 3


def test_a_stream_freezes_its_batches(spark, kept, tmp_path):
    os.makedirs(tmp_path / "in")
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(json.dumps(made(j)) for j in range(i, i + 2)) + "\n{broken\n")
    stream = spark.readStream.schema("body string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(kept.batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    kept.batch(spark.createDataFrame([(json.dumps(made(0)),)], "body string"), 0)  # a batch that comes again
    assert sorted(r.id for r in kept.read().collect()) == [f"https://x/d{i}/1" for i in range(4)] and len(kept.commits()) == 3


def test_folders_of_documents(spark, tmp_path):
    files.register(spark)
    folder = str(tmp_path / "docs")
    rows = [(s.artifact_name(made(i)["$id"]), json.dumps(made(i, title="é"))) for i in range(40)] + [("deep/er/x.json", "{}")]
    spark.createDataFrame(rows, "path string, body string").repartition(5).write.format("documents").mode("append").save(folder)
    read = spark.read.format("documents").load(folder)
    assert {(r.path, r.body) for r in read.collect()} == set(rows)
    assert {r.id for r in read.collect()} == {made(i)["$id"] for i in range(40)} | {None}
    bad = [([("a.json", "1"), ("a.json", "2")], "a.json"), ([("new.json", "1"), ("deep/er/x.json", "2")], "x.json"), ([("ok.json", "1"), ("../out.json", "2")], "out.json"), ([("ok.json", "1"), (None, "2")], "None"), ([("ok.json", "1"), ("n.json", None)], "n.json")]
    for pairs, told in bad:  # nothing is visible of a write that fails, and nothing is left
        with pytest.raises(Exception, match=told):
            spark.createDataFrame(pairs, "path string, body string").repartition(2).write.format("documents").mode("append").save(folder)
        assert not [x for x in os.listdir(folder) if x in ("a.json", "new.json", "ok.json")] and os.listdir(tmp_path) == ["docs"]
    (tmp_path / "docs" / "broken.json").write_text("{")
    assert read.count() == 41


def test_a_lookup_reads_one_file(spark, tmp_path):
    reader = files._Reader(str(tmp_path))
    asked = made(7)["$id"]
    assert list(reader.pushFilters([files.EqualTo(("id",), asked), files.EqualTo(("path",), "x")])) and [p.names for p in reader.partitions()] == [[s.artifact_name(asked)]]
    files.register(spark)
    for i in (7, 8):
        (tmp_path / s.artifact_name(made(i)["$id"])).write_text(json.dumps(made(i)))
    read = spark.read.format("documents").load(str(tmp_path))
    assert [r.id for r in read.filter(F.col("id") == asked).collect()] == [asked] and read.filter("id = 'https://x/none/1'").count() == 0
    assert read.filter(F.col("id").isin(asked, made(8)["$id"])).count() == 2


PAYLOADS = ['{"k":"a"}', '{"k":"zz"}', '{"k":null}', "{}", '{"k":["a"]}', '{"k":1}', '{"k":"1"}', '{"k":1.0}', None]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_live_vocabularies(spark, limit):
    """The same by broadcast and behind a Bloom filter: null rules, missing fields, lists, numbers and texts; an empty vocabulary accepts nothing."""
    rows = spark.createDataFrame([(i, x, "mine") for i, x in enumerate(PAYLOADS)], "i int, j string, _row string").withColumn("v", F.try_parse_json("j"))
    words, numbers = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "value string"), spark.createDataFrame([(1,), (2,)], "value int")
    told = lambda *x: [r.conforms for r in vocabulary.conforms(rows, "v", *x, limit=limit).orderBy("i").collect()]
    V = vocabulary.Vocabulary
    assert told(V("k", words)) == [True, False, False, True, False, False, False, False, False]
    assert told(V("k", words, nullable=True)) == [True, False, True, True, False, False, False, False, False]
    assert told(V("k", numbers)) == [False, False, False, True, False, True, False, True, False]
    assert told(V("k", words.limit(0))) == [False, False, False, True, False, False, False, False, False]
    assert told(V("k", words), V("other", words.limit(0))) == told(V("k", words)) and told() == [True] * 8 + [False]
    assert vocabulary.conforms(rows.withColumn("conforms", F.lit(1)), "v", V("k", words), limit=limit).columns == [*rows.columns, "conforms"]


def test_rows_without_a_value_are_spread(spark):
    """Beyond the limit rows are shuffled by their values; those that have none do not meet in one task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = F.when(F.col("id") == 0, '{"k":"a"}').when(F.col("id") % 2 == 0, '{"k":null}').otherwise("{}")
        rows = spark.range(2000).select("id", F.parse_json(made).alias("v"))
        got = vocabulary.conforms(rows, "v", vocabulary.Vocabulary("k", spark.createDataFrame([("a",)], "value string")), limit=0)
        assert got.filter("conforms").count() == 1001
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_vocabulary_of_a_million(spark):
    values = spark.range(1_000_000).select((F.col("id") * 3).alias("value"))
    rows = spark.range(3000).select("id", p.as_map(F.parse_json(F.concat(F.lit('{"k":'), (F.col("id") * 1001).cast("string"), F.lit("}")))).alias("payload"))
    got = vocabulary.conforms(rows, "payload", vocabulary.Vocabulary("k", values), limit=1 << 20)
    assert got.filter("conforms").count() == sum(i * 1001 % 3 == 0 and i * 1001 < 3_000_000 for i in range(3000))


REFERENCES = [
    ({"properties": {"a": {"type": "integer"}, "b": {"$ref": "#/properties/a"}}}, [('{"b":1}', True), ('{"b":"x"}', False)]), ({"properties": {"b": {"$ref": "#num"}, "c": {"$anchor": "num", "type": "integer"}}}, [('{"b":1}', True), ('{"b":[]}', False)]),
    ({"properties": {"b": {"$ref": "#/allOf/0/properties/x~1y"}}, "allOf": [{"properties": {"x/y": {"minimum": 3}}}]}, [('{"b":3}', True), ('{"b":2}', False)]), ({"$id": "https://x/r/1", "properties": {"b": {"$ref": "https://x/s/1#/properties/q%20q"}}, "$defs": {"s": {"$id": "https://x/s/1", "properties": {"q q": {"const": 1}}}}}, [('{"b":1}', True), ('{"b":2}', False)]),
    ({"properties": {"n": {"type": "integer"}, "next": {"$ref": "#/$defs/deep/anyOf/1"}}, "$defs": {"deep": {"anyOf": [{}, {"properties": {"n": {"type": "integer"}, "next": {"$ref": "#/$defs/deep/anyOf/1"}}}]}}}, [('{"n":1,"next":{"n":2,"next":{"n":3}}}', True), ('{"n":1,"next":{"n":2,"next":{"n":"x"}}}', False)]),
]


@pytest.mark.parametrize("schema,cases", REFERENCES)
def test_references_to_any_part(spark, schema, cases):
    rows = spark.createDataFrame(list(enumerate(x for x, _ in cases)), "i int, j string")
    assert [r.ok for r in rows.select("i", gate.accepts(schema, p.from_json(F.col("j"))).alias("ok")).orderBy("i").collect()] == [x for _, x in cases]


@pytest.mark.parametrize("ref", ["#/properties/none", "#none", "https://x/none/1", "#/properties/a/type/0"])
def test_references_to_nothing(spark, ref):
    with pytest.raises(ValueError, match="unresolved reference"):
        gate.accepts({"properties": {"a": {"type": "string"}, "b": {"$ref": ref}}}, F.lit(None).cast(p.MAP))


def test_lens_state_between_runs(spark, tmp_path):
    """The newest state of a key counts; keys without state and null keys pass; a batch that comes again changes nothing."""
    view = lens.Lens("view", get=lambda v: F.map_filter(v, lambda k, _: k != "secret"), put=lambda v, prior, kept: F.map_concat(F.map_filter(v, lambda k, _: ~k.isin("secret", "note")), F.coalesce(kept, p.literal_map({}))), complement=lambda prior: F.map_filter(prior, lambda k, _: k == "secret"),
                     private=lambda v: F.map_filter(v, lambda k, _: k == "note"), restore=lambda v, s: F.map_concat(v, s), id="https://x/a/1")
    kept = lens.Kept(view, store.Log(spark, f"file://{tmp_path}/lens"))
    maps = lambda rows, names: spark.createDataFrame(rows, f"key string, _row string, {names[0]} string, {names[1]} string").select("key", "_row", *[p.from_json(F.col(n)).alias(n) for n in names])
    rows = maps([("a", "1", '{"x":1,"note":"n"}', '{"x":0,"secret":5}'), ("b", "2", '{"x":2}', '{"x":0}'), (None, "3", '{"x":3,"note":"m"}', '{"secret":7}')], ("view", "prior"))
    shown = lambda df, c: {r["key"]: json.loads(r["j"]) for r in df.select("key", p.to_json(F.col(c)).alias("j")).collect()}
    assert kept.newest().count() == 0 and shown(kept.get(rows, "key", "prior"), "rendering") == {"a": {"x": 0}, "b": {"x": 0}, None: {}}
    for _ in range(2):
        assert shown(kept.put(rows, "key", "view", "prior"), "payload") == {"a": {"x": 1, "secret": 5}, "b": {"x": 2}, None: {"x": 3, "secret": 7}}
    got = kept.get(maps([("a", "1", '{"x":9}', None), ("b", "2", '{"x":8}', None), ("new", "4", '{"x":7}', None), (None, "3", '{"x":6}', None)], ("payload", "none")), "key", "payload")
    assert shown(got, "rendering") == {"a": {"x": 9, "note": "n"}, "b": {"x": 8}, "new": {"x": 7}, None: {"x": 6}} and got.columns == ["key", "_row", "payload", "none", "rendering"]
    lost = maps([("a", "1", '{"x":4,"note":"later"}', None), ("new", "4", '{"x":5}', None)], ("view", "prior"))
    assert shown(kept.put(lost, "key", "view", "prior"), "payload") == {"a": {"x": 4, "secret": 5}, "new": {"x": 5}}
    assert {r.key: (r.complement, r.private) for r in kept.newest().collect()} == {"a": ('{"secret":5}', '{"note":"later"}'), "b": ("{}", "{}"), "new": (None, "{}")}
    known = lens.LensRegistry()
    known.register(view)
    evidence = maps([("a", "1", '{"x":1}', '{"x":0,"secret":5}')], ("rendering", "prior"))
    assert known.for_id("https://x/a/1") == [view] and known.for_id("view") == [] and known.fidelity("none", evidence, "prior", "rendering") == "lossy"
    assert known.describe({"view": evidence}) == [{"key": "view", "id": "https://x/a/1", "tier": "transform", "fidelity": "lossless"}] and known.describe({})[0]["fidelity"] == "lossy"
