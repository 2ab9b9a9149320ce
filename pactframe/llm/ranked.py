"""Operator 13, ranked lexical search over a tiered index: postings of high impact first, residual bounds, proofs, fall-through.

A posting's impact is what a term adds to a document's score, before the term's weight. A term's postings are filed in
tiers by impact: the first holds about its `first` highest, each further one `growth` times as many. With every tier goes
the highest impact below it, so after the tiers 0 to k a term can add no more than its weight times that residual bound.

A search reads tier 0 for all items. What an item's documents have gathered is a lower bound of their scores; the exact
scores of the `top` leading ones give a threshold. If the residuals of all terms of the item stay below it together, no
unread document can be among the best: the item is proven, every document whose upper bound reaches the threshold is scored
exactly from the forward index, and the item is done. Items without such a proof fall through to the next tier; in the
last, nothing is unread. Results are exact, ties included.

The index holds every document, and all terms or those of a given vocabulary (a search asks for no others). The vocabulary
goes to the tasks that count terms while its measured size allows it and is joined otherwise; so do an item's terms.
Postings, tiers and the forward index are Parquet tables in the shared folder, deleted when the result is written.

Defined cases: a null or empty text has no terms, and an item without any has no results; a row is a document, so repeated
rows and repeated ids are ranked each for itself, and repeated items are answered each; a null doc_id comes last among
equal scores; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, forget, shared_folder, small_enough, table

#: Bytes that belong to no term become spaces; A to Z become a to z. All bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Impacts are counted in steps of this size, so a term has at most 1000000 / LEVEL + 1 of them.
LEVEL = 4096
#: A vocabulary up to this many terms, of this many bytes in all, goes to the tasks that count.
MOST_TERMS, MOST_BYTES = 250_000, 16 << 20


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a whole text in UTF-8, in order, repeats included."""
    return text.translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Index:
    """An index in a folder: tables terms, forward and postings (by tier); n_docs documents have terms, n_terms in all."""

    spark: SparkSession
    folder: str
    n_docs: int
    n_terms: int
    last: int

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self) -> None:
        forget(self.spark, self.folder)


def _counted(docs: DataFrame, known: dict[bytes, int] | None) -> DataFrame:
    """Rows (d, doc_id, n, terms, tfs) of docs (d, doc_id, text); terms are numbers of the known ones, or all as texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, counts = [], [], []
            for value in batch.column("text").cast(pa.binary()):  # one text at a time
                tokens = terms(value.as_py())
                sizes.append(len(tokens))
                tally = Counter(tokens)
                if known is None:
                    found.append([t.decode() for t in tally])
                    counts.append(list(tally.values()))
                else:
                    both = [(known[t], tf) for t, tf in tally.items() if t in known]
                    found.append([t for t, _ in both])
                    counts.append([tf for _, tf in both])
            kind = pa.string() if known is None else pa.int64()
            columns = [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(kind)), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("doc_id"), *columns], names=["d", "doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"d bigint, doc_id bigint, n bigint, terms array<{'string' if known is None else 'bigint'}>, tfs array<bigint>")


def _forward(docs: DataFrame, vocabulary: DataFrame | None, folder: str) -> DataFrame:
    """Writes the forward index and returns the vocabulary's rows (term, t)."""
    if vocabulary is not None:
        vocabulary = cut(vocabulary.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
        n, size = vocabulary.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
        if n <= MOST_TERMS and (size or 0) <= MOST_BYTES:
            known = {r["term"].encode(): r["t"] for r in vocabulary.collect()}  # MOST_TERMS at most
            _counted(docs, known).write.parquet(f"{folder}/forward")
            return vocabulary
    _counted(docs, None).write.parquet(f"{folder}/counted")
    counted = docs.sparkSession.read.parquet(f"{folder}/counted")
    each = counted.select("d", F.inline(F.arrays_zip("terms", "tfs"))).withColumnRenamed("terms", "term")
    if vocabulary is None:
        vocabulary = cut(each.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    numbered = each.join(vocabulary, "term").groupBy("d").agg(F.collect_list(F.struct("t", "tfs")).alias("of"))
    rows = counted.select("d", "doc_id", "n").join(numbered, "d", "left")
    none = F.array().cast("array<bigint>")
    rows.select("d", "doc_id", "n", F.coalesce("of.t", none).alias("terms"), F.coalesce("of.tfs", none).alias("tfs")).write.parquet(f"{folder}/forward")
    return vocabulary


def _impacts(forward: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Rows (d, t, impact)."""
    each = forward.select("d", "n", F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "t", "tfs": "tf"})
    m = f"(50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L)"
    return each.select("d", "t", F.expr(f"(1000000000 * tf) div (1000 * tf + 20 * {m})").alias("impact"))


def _tiers(impacts: DataFrame, first: int, growth: int) -> DataFrame:
    """Rows (t, df, tiers): for each tier of a term its number, its least impact and its highest, in order."""
    level = F.expr(f"impact div {LEVEL}").alias("level")
    levels = impacts.groupBy("t", level).agg(F.count("*").alias("c"), F.max("impact").alias("top"))
    # a term has few levels, whatever its number of postings
    above = F.coalesce(F.sum("c").over(Window.partitionBy("t").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tier = F.when(F.col("above") < first, 0).otherwise(1 + F.floor(F.log(F.col("above") / first) / F.log(F.lit(float(growth))))).cast("int")
    filed = levels.withColumn("above", above).groupBy("t", tier.alias("tier")).agg(F.sum("c").alias("c"), (F.min("level") * LEVEL).alias("floor"), F.max("top").alias("top"))
    return filed.groupBy("t").agg(F.sum("c").alias("df"), F.array_sort(F.collect_list(F.struct("tier", "floor", "top"))).alias("tiers"))


def _sent(df: DataFrame, bytes_each: int) -> DataFrame:
    """df, already cut, to be broadcast if its measured size allows it."""
    return F.broadcast(df) if small_enough(df, bytes_each) else df


def build(docs: DataFrame, vocabulary: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", first: int = 1024, growth: int = 8) -> Index:
    """An index of docs, of all terms or of those of vocabulary (a column term)."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("d"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = _forward(rows, vocabulary, folder)
    forward = spark.read.parquet(f"{folder}/forward")
    n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    impacts = _impacts(forward, n_docs, n_terms)
    tiers = _tiers(impacts, first, growth)
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    words.join(tiers, "t").select("term", "t", "df", weight.alias("w"), "tiers").write.parquet(f"{folder}/terms")
    filed = cut(spark.read.parquet(f"{folder}/terms").select("t", "tiers"))
    last = filed.agg(F.max(F.element_at("tiers", -1)["tier"])).first()[0]
    tier = F.get(F.filter("tiers", lambda x: F.col("impact") >= x["floor"]), F.lit(0))["tier"]
    impacts.join(_sent(filed, 160), "t").select("t", "d", "impact", tier.alias("tier")).write.partitionBy("tier").parquet(f"{folder}/postings")
    return Index(spark, folder, n_docs, n_terms, -1 if last is None else last)


def _leading(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (q, d, lo) of a partition the top by lo of each q, holding no more than these and a few batches."""
    def best(q: np.ndarray, d: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((d, -lo, q))
        q, d, lo = q[order], d[order], lo[order]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        return q[rank < top], d[rank < top], lo[rank < top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, n = [], [], 0
        for batch in batches:
            waiting.append(tuple(batch.column(c).to_numpy() for c in ("q", "d", "lo")))
            n += batch.num_rows
            if n > 1 << 18:
                kept = [best(*map(np.concatenate, zip(*kept, *waiting)))]
                waiting, n = [], 0
        if kept or n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(*map(np.concatenate, zip(*kept, *waiting)))], names=["q", "d", "lo"])

    return run


def _asked(items: DataFrame, index: Index) -> DataFrame:
    """Rows (q, t, w, tiers): the terms of weight of each item, once each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(q, t.decode()) for q, x in zip(batch.column("q").to_pylist(), batch.column("text").cast(pa.binary())) for t in set(terms(x.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["q", "term"])

    return items.select("q", "text").mapInArrow(run, "q bigint, term string").join(index.read("terms"), "term").filter("w > 0").select("q", "t", "w", "tiers")


def _exact(pairs: DataFrame, asked: DataFrame, index: Index) -> DataFrame:
    """Rows (q, d, doc_id, score) of pairs (q, d), already cut, from the forward index."""
    forward = index.read("forward").join(_sent(pairs.select("d").distinct(), 32), "d", "left_semi")
    impacts = _impacts(forward, index.n_docs, index.n_terms).join(_sent(pairs, 48), "d")
    scores = impacts.join(asked.select("q", "t", "w"), ["q", "t"]).groupBy("q", "d").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    return forward.select("d", "doc_id").join(scores, "d").select("q", "d", "doc_id", "score")


def _ranked(rows: DataFrame, order: list, top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= top)


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = 50) -> DataFrame:
    """Rows (item_id, rank, doc_id, score, tier): the top documents of each item, and the tier at which the item was proven."""
    spark = items.sparkSession
    rows = cut(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")))
    results = spark.createDataFrame([], "q bigint, rank int, doc_id bigint, score bigint, tier int")
    if index.last >= 0:
        asked = cut(_asked(rows, index))
        sent = _sent(asked, 240)
        active, floor = asked.select("q").distinct(), None
        for k in range(index.last + 1):
            rest = F.coalesce(F.array_max(F.transform(F.filter("tiers", lambda x: x["tier"] > k), lambda x: x["top"])), F.lit(0)) * F.col("w")
            mine = cut(sent.join(active, "q", "left_semi").select("q", "t", "w", rest.alias("r")))
            read = index.read("postings").filter(F.col("tier") <= k)
            gathered = lambda of: read.join(_sent(of, 64), "t").groupBy("q", "d").agg(F.sum(F.col("w") * F.col("impact")).alias("lo"), F.sum("r").alias("seen"))  # noqa: B023, E731
            leading = gathered(mine).select("q", "d", "lo").mapInArrow(_leading(top), "q bigint, d bigint, lo bigint")
            seeds = cut(_ranked(leading, [F.desc("lo"), "d"], top).select("q", "d"))
            found = _exact(seeds, sent, index).groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("q", F.coalesce(F.get("s", F.lit(top - 1)), F.lit(0)).alias("least"))
            least = found if floor is None else found.unionByName(floor).groupBy("q").agg(F.max("least").alias("least"))
            states = cut(mine.groupBy("q").agg(F.sum("r").alias("rest")).join(least, "q", "left").select("q", "rest", F.coalesce("least", F.lit(0)).alias("least")))
            proven = F.expr("rest < least OR rest = 0")
            done, active = states.filter(proven), states.filter(~proven).select("q")
            floor = states.select("q", "least")
            if not done.isEmpty():
                bounds = _sent(cut(done), 48)
                reach = gathered(cut(mine.join(bounds.select("q"), "q", "left_semi"))).join(bounds, "q").filter("lo + rest - seen >= least AND lo > 0")
                best = _ranked(_exact(cut(reach.select("q", "d")), sent, index), [F.desc("score"), F.asc_nulls_last("doc_id"), "d"], top)
                results = results.unionByName(cut(best.select("q", "rank", "doc_id", "score", F.lit(k).alias("tier"))))
            if active.isEmpty():
                break
    return rows.select("q", "item_id").join(results, "q").select("item_id", "rank", "doc_id", "score", "tier")


def vocabulary(items: DataFrame, text: str = "text") -> DataFrame:
    """Rows (term): the terms of items, those of a batch once."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({t.decode() for x in batch.column(0).cast(pa.binary()) for t in terms(x.as_py())}), pa.string())], names=["term"])

    return items.select(F.col(text).cast("string")).mapInArrow(words, "term string")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    index = build(table(spark, sf_dir, "documents"), vocabulary(items))
    found = cut(search(index, items).drop("tier"))
    index.drop()
    return found


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LISTED = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLE_SQL = {
    "op13_ranked_search": f"""
WITH d AS (SELECT doc_id, unnest(ts) AS t, len(ts)::BIGINT AS n FROM (SELECT doc_id, {_LISTED} AS ts FROM documents)),
g AS (SELECT count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_LISTED}) AS t FROM benchmark),
p AS (SELECT doc_id, t, any_value(n) AS n, count(*)::BIGINT AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY t),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""
}
