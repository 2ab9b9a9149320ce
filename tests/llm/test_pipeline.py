from collections import defaultdict

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from pactframe.llm import mixing, pieces, quality
from tests.llm.test_lines import brute as lines_left
from tests.llm.test_mixing import simulated
from tests.llm.test_pieces import PATH
from tests.llm.test_simhash import brute as simhash_of
from tests.llm.test_simhash import groups, similar_pairs


def test_pipeline_agrees_with_brute_force(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    good = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({quality.op2_sql()})").fetchall() if kept}
    docs = [Row(**r.asDict()) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.doc_id in good]
    # a source's copies count as one page
    texts = dict(zip([d.doc_id for d in docs], lines_left([(d.source, d.text) for d in docs], corpus_pipeline.LINE_RATIO, 3, once=True), strict=True))
    held = list(texts.values())
    stay = set(groups(list(texts), [simhash_of(t, 5) for t in held], similar_pairs(held)).values())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(stay)
    own = pieces.model(PATH)
    for r in rows:
        ids, found = own.encode(texts[r.doc_id], 4)
        assert (r.text, bytes(r.ids), list(r.scores), r.n_pieces) == (texts[r.doc_id], ids, [s for s, _ in found], len(ids) // 4)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_slots_reach_the_result(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids[r.source].append(r.doc_id)
    order = sorted(ids)
    want = simulated(mixing.parts([len(ids[s]) ** 0.5 for s in order], 1000), [-(-len(ids[s]) // 32) for s in order])
    places = {i: (k // 32, want[at][k // 32], k % 32) for at, s in enumerate(order) for k, i in enumerate(ids[s])}
    assert {r.doc_id: (r.block, r.slot, r.place) for r in rows} == places


def test_mixing_of_more_blocks_than_sources(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", f"text {i}") for i in range(300)], "doc_id long, source string, text string")
    rows = corpus_pipeline.encode_pieces(spark, docs, "").collect()
    shares = mixing.parts([225**0.5, 75**0.5], 1000)
    want = simulated(shares, [8, 3])
    assert len(rows) == 300 and {(r.source, r.block): r.slot for r in rows} == {(s, b): want[k][b] for k, (s, n) in enumerate((("a", 8), ("b", 3))) for b in range(n)}


def test_lines_of_minority_languages_go(spark):
    nav = {0: "la ligne de tous", 1: "die Zeile aller"}
    rows = [(i, f"{nav[i // 12]}\nown {i}" if i < 24 else f"own {i}", "x", "src", 1) for i in range(600)]  # each line on 2% of the pages
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {f"own {i}" for i in range(600)}


def test_copies_do_not_empty_each_other(spark):
    rows = [(i, "first line\nsecond line" if i < 40 else f"menu\nown {i}", "x", "src", 1) for i in range(200)]
    rows += [(200 + i, None, "x", None, 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert left == {i: "first line\nsecond line" if i < 40 else f"own {i}" if i < 200 else None for i in range(203)}


def test_run_on_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, repeated rows, copies without ids and further columns with names of the way; an empty table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    first = docs.limit(5)
    null = lambda c: docs.limit(2).withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    odd = docs.unionByName(first).unionByName(first.withColumn("doc_id", F.lit(None).cast("bigint")))
    for c in docs.columns:
        odd = odd.unionByName(null(c))
    odd = odd.withColumns({c: F.lit("mine") for c in ("_source", "_id", "_row", "_text", "_keys", "slot", "root")})
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    plain = {r.doc_id for r in corpus_pipeline.run(spark, _written(docs, f"{tmp_path}/plain")).collect()}
    assert {r.doc_id for r in rows} == plain and len(rows) == len(plain)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def _written(docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_target_weights_take_effect(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {"a": 1, "b": 3})
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"text {i}") for i in range(640)], "doc_id long, source string, text string")
    rows = corpus_pipeline.encode_pieces(spark, docs, "").collect()
    want = simulated([1, 3], [10, 10])
    assert {(r.source, r.block): r.slot for r in rows} == {(s, b): want[k][b] for k, s in enumerate("ab") for b in range(10)}
