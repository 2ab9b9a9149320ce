"""Operator 12, language identification: a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of `WINDOW` bytes, forward and backward, by gated recurrent units. Each position
gets a probability for each language from both directions; a document's probabilities are the means over all its positions.
The network is trained here, in numpy, by backpropagation through time with every position of a window labelled.

Training reads a bounded sample: `sample` documents over all languages, evenly by language and chosen by a hash of their ids,
`per_doc` windows of each, spread over its whole text. It is made on Spark and is a few hundred KB, whatever the corpus; the
fit runs once, on the driver, and the same weights go to all tasks, so a task that runs again gives the same rows. Prediction
reads every byte of every text, in groups of windows of bounded size.

Defined cases: a null text and one without a letter (Unicode) are `und` with score 0 and are never learned from; rows without
a language are predicted, not learned from; a row whose id is null is held out; ties between languages go to the first
by name; repeated rows get equal results; without any row to learn from everything is `und`; an empty table gives an empty
result; other columns are not read. More than `MOST_LANGUAGES` languages raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

WINDOW = 128
#: Windows that go through the network together, of four languages; fewer of more.
TOGETHER = 2048
HIDDEN = 8
MOST_LANGUAGES = 1000
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages by name, and weights: for both directions byte tables and recurrent weights of the gates and the candidate; output weights."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def start(n_languages: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {"out": np.zeros(n_languages)}
    for d in "fb":
        w |= {f"{d}_gates": rng.normal(0, 0.3, (256, 2 * hidden)), f"{d}_new": rng.normal(0, 0.3, (256, hidden))}
        w |= {f"{d}_to_gates": rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)), f"{d}_to_new": rng.normal(0, hidden**-0.5, (hidden, hidden))}
        w[f"{d}_out"] = rng.normal(0, hidden**-0.5, (hidden, n_languages))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _step(w: dict[str, np.ndarray], d: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gates (update and reset side by side), the candidate's recurrent part, the candidate and the next state. A gate is (1 + tanh) / 2."""
    n = h.shape[1]
    gates = np.tanh(w[f"{d}_gates"][x] + h @ w[f"{d}_to_gates"])
    gates *= 0.5
    gates += 0.5
    part = h @ w[f"{d}_to_new"]
    new = np.tanh(w[f"{d}_new"][x] + gates[:, n:] * part)
    return gates, part, new, new + gates[:, :n] * (h - new)


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over all positions of windows x (time, window) with languages y, and its gradients, by backpropagation through time."""
    times, n = x.shape
    hidden = w["f_new"].shape[1]
    runs, logits = {}, np.zeros((times, n, len(w["out"])), np.float32) + w["out"]
    for d, order in (("f", range(times)), ("b", range(times - 1, -1, -1))):
        h, kept = np.zeros((n, hidden), np.float32), {}
        for t in order:
            before, (gates, part, new, h) = h, _step(w, d, x[t], h)
            kept[t] = before, gates, part, new, h
            logits[t] += h @ w[f"{d}_out"]
        runs[d] = order, kept
    p = _softmax(logits)
    at = (slice(None), np.arange(n), y)
    loss = float(-np.log(np.maximum(p[at], 1e-9)).mean())
    p[at] -= 1
    p /= times * n
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["out"] = p.sum((0, 1))
    seen = np.eye(256, dtype=np.float32)
    for d, (order, kept) in runs.items():
        back = np.zeros((n, hidden), np.float32)
        for t in reversed(order):
            before, gates, part, new, h = kept[t]
            update, reset = gates[:, :hidden], gates[:, hidden:]
            grads[f"{d}_out"] += h.T @ p[t]
            back += p[t] @ w[f"{d}_out"].T
            d_new = back * (1 - update) * (1 - new * new)
            d_part = d_new * reset
            # a gate's slope in its argument is 2 g (1 - g)
            d_gates = np.concatenate([back * (before - new), d_new * part], 1) * (2 * gates * (1 - gates))
            one = seen[x[t]].T
            grads[f"{d}_new"] += one @ d_new
            grads[f"{d}_gates"] += one @ d_gates
            grads[f"{d}_to_new"] += before.T @ d_part
            grads[f"{d}_to_gates"] += before.T @ d_gates
            back = back * update + d_part @ w[f"{d}_to_new"].T + d_gates @ w[f"{d}_to_gates"].T
    return loss, grads


def fit(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = 200, batch: int = 128, rate: float = 0.01, seed: int = 42) -> Model:
    """A model of whole windows (all of one length) and their languages, by Adam with a falling rate. Batches take languages evenly."""
    languages = sorted(set(labels))
    x = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), -1)
    y = np.searchsorted(languages, labels)
    of = [np.flatnonzero(y == i) for i in range(len(languages))]
    w, rng = start(len(languages), hidden, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = np.array([of[i][rng.integers(len(of[i]))] for i in np.resize(rng.permutation(len(of)), batch)])
        _, grads = gradients(w, x[chosen].T, y[chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            w[k] -= (rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, w)


def _direction(w: dict[str, np.ndarray], d: str, x: np.ndarray, active: list[int]) -> np.ndarray:
    """Outputs (time, window, language) of one direction over windows x (time, window), longest first; buffers are written in place."""
    times, n = x.shape
    hidden, width = w[f"{d}_out"].shape
    out = np.zeros((times, n, width), np.float32)
    h, gates, new, of_gates, of_new = (np.zeros((n, k * hidden), np.float32) for k in (1, 2, 1, 2, 1))
    for t, m in enumerate(active):
        state, g, c = h[:m], gates[:m], new[:m]
        np.take(w[f"{d}_gates"], x[t, :m], axis=0, out=of_gates[:m], mode="clip")
        np.matmul(state, w[f"{d}_to_gates"], out=g)
        g += of_gates[:m]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        np.take(w[f"{d}_new"], x[t, :m], axis=0, out=of_new[:m], mode="clip")
        np.matmul(state, w[f"{d}_to_new"], out=c)
        c *= g[:, hidden:]
        c += of_new[:m]
        np.tanh(c, out=c)
        state -= c
        state *= g[:, :hidden]
        state += c
        np.matmul(state, w[f"{d}_out"], out=out[t, :m])
    return out


def _positions(model: Model, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities (position, language) of windows of data, longest first; at every step only windows that reach it take part."""
    n = len(starts)
    active = (n - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")).tolist()
    window = np.repeat(np.arange(n), lengths)
    step = np.arange(len(window)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    logits = np.zeros((len(data), len(model.languages)), np.float32) + model.weights["out"]
    for d in "fb":
        at = starts[window] + (step if d == "f" else lengths[window] - 1 - step)
        x = np.zeros((len(active), n), np.intp)
        x[step, window] = data[at]
        logits[at] += _direction(model.weights, d, x, active)[step, window]
    return _softmax(logits)


def probabilities(model: Model, texts: Iterator[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces (number of the text, probabilities of its next positions) over whole texts, in order, a bounded number of windows at a time."""
    waiting: list[tuple[int, bytes]] = []
    together = max(32, TOGETHER * 4 // max(4, len(model.languages)))

    def run() -> Iterator[tuple[int, np.ndarray]]:
        lengths = np.array([len(piece) for _, piece in waiting])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        order = np.argsort(-lengths, kind="stable")
        found = _positions(model, np.frombuffer(b"".join(piece for _, piece in waiting), np.uint8), starts[order], lengths[order])
        for (i, piece), a in zip(waiting, starts.tolist(), strict=True):
            yield i, found[a : a + len(piece)]

    for i, text in enumerate(texts):
        for a in range(0, len(text), WINDOW):
            waiting.append((i, text[a : a + WINDOW]))
            if len(waiting) == together:
                yield from run()
                waiting.clear()
    if waiting:
        yield from run()


def _spans(pieces: list[np.ndarray], languages: list[str]) -> list[dict]:
    """Runs of positions with the same most probable language, as byte ranges."""
    best = np.concatenate(pieces)
    edges = np.concatenate(([0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)]))
    return [{"start": int(a), "end": int(b), "lang": languages[best[a]]} for a, b in zip(edges, edges[1:])]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), spans: bool = False) -> DataFrame:
    """Rows (doc_id, keep, lang_pred, score), and with spans the byte ranges of each language in a text, labelled by position."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.languages
        for batch in batches:
            texts = [batch.column("_text")[i] for i in range(batch.num_rows)]
            sums, sizes, runs = np.zeros((len(texts), max(1, len(names)))), np.zeros(len(texts)), [[] for _ in texts]
            if names:
                for i, p in probabilities(sent.value, (x.as_py() or b"" for x in texts)):
                    sums[i] += p.sum(0, dtype=np.float64)
                    sizes[i] += len(p)
                    if spans:
                        runs[i].append(p.argmax(1).astype(np.int16))
            means = sums / np.maximum(sizes, 1)[:, None]
            best = means.argmax(1)
            told = [names[b] if n else UNKNOWN for b, n in zip(best, sizes)]
            columns = [*batch.columns[:-1], pa.array(told, pa.string()), pa.array(np.clip(means.max(1), 0, 1) * (sizes > 0))]
            if spans:
                columns.append(pa.array([_spans(r, names) if r else [] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score", *(["spans"] if spans else [])])

    body = F.col(text).cast("string")
    read = docs.select(F.col(doc_id), *keep, F.when(has_letter(body), body.cast("binary")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    return read.mapInArrow(run, f"{kinds}, lang_pred string, score double" + (", spans array<struct<start: bigint, end: bigint, lang: string>>" if spans else ""))


def _windows(rows: DataFrame, per_doc: int) -> DataFrame:
    """Rows (lang, window) of rows (lang, text): windows of WINDOW bytes spread over each whole text; short texts are repeated to that length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data = text.as_py()
                n = min(per_doc, -(-len(data) // WINDOW))
                for at in np.linspace(0, max(0, len(data) - WINDOW), n).astype(int).tolist():
                    piece = data[at : at + WINDOW]
                    langs.append(lang)
                    found.append((piece * -(-WINDOW // len(piece)))[:WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    return rows.mapInArrow(run, "lang string, window binary")


def train(rows: DataFrame, lang: str = "lang", text: str = "text", order: str = "doc_id", sample: int = 2000, per_doc: int = 4, **options) -> Model:
    """A model fitted on `sample` rows at most (or one for each language, if those are more), evenly by language, the least hashes of `order` first."""
    known = rows.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(order).alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], {})
    each = max(1, sample // len(sizes))
    rates = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * each / r["n"])) for r in sizes], "lang string, rate double")
    drawn = known.join(F.broadcast(rates), "lang").filter((F.pmod("h", F.lit(1 << 30)) < F.col("rate") * (1 << 30)) & has_letter(F.col("text")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.length("text")))
    chosen = drawn.withColumn("n", first).filter(F.col("n") <= each).select("lang", F.col("text").cast("binary").alias("text"))
    found = sorted((r["lang"], bytes(r["window"])) for r in _windows(chosen, per_doc).collect())  # bounded by sample and per_doc
    return fit([x for _, x in found], [x for x, _ in found], **options) if found else Model([], {})


def held_out(doc_id: Column) -> Column:
    """Whether the id's crc32 as a text leaves 0 modulo 5; an empty text stands for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    return predict(docs, train(docs.filter(~F.col("held_out"))), keep=("held_out",))


QUERIES = {"op12_language": op12_language}
ORACLE_SQL = {}
