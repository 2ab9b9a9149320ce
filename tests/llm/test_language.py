import unicodedata
import zlib

import numpy as np
import pytest

from pactframe.llm import language as l


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held_out", l.held_out(l.F.col("doc_id")))
    return l.train(docs.filter("NOT held_out"))


def plain(model, text):
    """Position probabilities of a text, one byte at a time with gates as they are defined."""
    w, data = model.weights, text.encode()
    out = []
    for a in range(0, len(data), l.WINDOW):
        piece = data[a : a + l.WINDOW]
        logits = np.zeros((len(piece), len(model.languages))) + w["out"]
        for d, order in (("f", range(len(piece))), ("b", range(len(piece) - 1, -1, -1))):
            n = w[f"{d}_new"].shape[1]
            h = np.zeros(n)
            for t in order:
                gates = 1 / (1 + np.exp(-2 * (w[f"{d}_gates"][piece[t]] + h @ w[f"{d}_to_gates"])))
                new = np.tanh(w[f"{d}_new"][piece[t]] + gates[n:] * (h @ w[f"{d}_to_new"]))
                h = (1 - gates[:n]) * new + gates[:n] * h
                logits[t] += h @ w[f"{d}_out"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        out.append(e / e.sum(1, keepdims=True))
    return np.concatenate(out)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in l.start(3, 4, 7).items()}
    x, y = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5)
    _, grads = l.gradients(w, x, y)
    for name, grad in grads.items():
        for at in [tuple(rng.integers(0, s) for s in grad.shape) for _ in range(4)] + [np.unravel_index(np.abs(grad).argmax(), grad.shape)]:
            losses = []
            for step in (1e-3, -1e-3):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += step
                losses.append(l.gradients(moved, x, y)[0])
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grad[at], abs=2e-4), name


def test_query_against_a_slow_network_and_held_out_labels(spark, sf, model):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in l.op12_language(spark, sf).collect()}
    assert set(got) == set(docs)
    right = held = 0
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if r["held_out"]:
            held += 1
            right += r["lang_pred"] == docs[k]["lang"]
    assert held > 20 and right >= 0.95 * held
    short = sorted(got, key=lambda k: len(docs[k]["text"] or ""))[:40]
    for k in short:
        text = docs[k]["text"]
        if not any(unicodedata.category(ch)[0] == "L" for ch in text or ""):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0)
            continue
        pooled = plain(model, text).mean(0)
        assert got[k]["score"] == pytest.approx(pooled.max(), abs=1e-4)
        assert got[k]["score"] == pytest.approx(pooled[model.languages.index(got[k]["lang_pred"])], abs=1e-4)


def test_language_source_and_id_change_no_prediction(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    other = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'elsewhere' AS source", "n_chars")
    a = {r["doc_id"]: tuple(r)[1:] for r in l.predict(docs, model).collect()}
    b = {r["doc_id"] - 1000000: tuple(r)[1:] for r in l.predict(other, model).collect()}
    assert a == b


def test_cases(spark, model):
    """Nulls, empty, letterless, very long and repeated texts, clashing columns, no rows, nothing to learn from."""
    long = "Is the and of with that. " * 20000
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "the and of with"), (5, long), (6, "the and of with"), (6, "the and of with"), (7, "é"), (8, "́ 5")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' AS _text", "1 AS score", "'b' AS lang_pred", "2 AS held_out")
    got = l.predict(df, model).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (1, 2, 3, 8))
    assert by_id[7]["lang_pred"] in model.languages and by_id[5]["lang_pred"] == "en"
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (6, None)} == {(by_id[6]["lang_pred"], by_id[6]["score"])}
    assert l.predict(df.limit(0), model).count() == 0
    none = l.train(spark.createDataFrame([(1, "x", None)], "doc_id bigint, text string, lang string"))
    assert {(r["lang_pred"], r["score"]) for r in l.predict(df, none).collect()} == {("und", 0.0)}
    one = l.train(spark.createDataFrame([(1, "only one", "zz")], "doc_id bigint, text string, lang string"), steps=3)
    assert {r["lang_pred"] for r in l.predict(df, one).collect()} == {"und", "zz"}
    assert spark.range(1).select(l.held_out(l.F.lit(None))).first()[0] is True


def test_spans_cover_every_byte(spark, model):
    text = "That is the one with the other and of them. " * 12 + "Der und die das nicht ein mit auf ist zu den. " * 12
    row = l.predict(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"), model, spans=True).orderBy("doc_id").collect()
    spans = row[0]["spans"]
    assert [s["start"] for s in spans] == [0, *[s["end"] for s in spans[:-1]]] and spans[-1]["end"] == len(text.encode())
    assert row[1]["spans"] == []
    best = plain(model, text).argmax(1)
    told = [s["lang"] for s in spans for _ in range(s["start"], s["end"])]
    assert np.mean([model.languages[b] == t for b, t in zip(best, told)]) > 0.999


def test_sample_is_bounded_and_even(spark):
    rows = [(i, "abc def " * (1 + i % 50), "big" if i % 10 else "small") for i in range(5000)]
    seen = {}
    fit = l.fit
    try:
        l.fit = lambda windows, labels, **k: seen.update(n=len(windows), of={x: labels.count(x) for x in set(labels)}, sizes={len(x) for x in windows}) or l.Model([], {})
        l.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=200, per_doc=1)
    finally:
        l.fit = fit
    assert seen == {"n": 200, "of": {"big": 100, "small": 100}, "sizes": {l.WINDOW}}
