"""Operator 9, document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame expressions only.

A text's paragraphs are its lines, cut after sentence ends. Each paragraph is hashed to a vector of
45 numbers, and the text's vector is their sum, so the order of paragraphs does not matter and a paragraph is
added or taken away in constant time (`added`, `removed`):

* the number of paragraphs;
* four 62-bit hashes, summed modulo 2^62, which tell texts apart;
* 120 hash bits of two seeds, three in each of forty numbers, each summed modulo 2^19 in its own lane of 20 bits.

The lanes give a likeness: with c ones among n paragraphs, 2 c - n is a random-sign sum, and the inner product
of two such vectors estimates the number of shared paragraphs. `likeness` is twice that over the sum of both
squares, held to 0 .. 1; it is 1 for equal vectors and has a standard error near 0.09 (one over the root of 120) for unrelated texts.

Defined cases: null counts as the empty text, which has no paragraphs and the zero vector; lines of white space
alone are no paragraphs; repeated paragraphs count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

PARAGRAPH_END = r"\n|(?<=[.!?])\s"
HASHES, LANE_SHIFTS = 4, 20
WIDE = 2 * LANE_SHIFTS
SPACE = " \t\x0b\x0c\r"
M62 = (1 << 62) - 1
LANE_BITS = 20
ONES = sum(1 << LANE_BITS * i for i in range(3))
LANES = ONES * ((1 << LANE_BITS - 1) - 1)
GUARDS = ONES << LANE_BITS - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once."""
    return F.transform(F.array(value), body)[0]


def _sum(items: Column, term: Callable[[Column], Column], mask: int) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: (a + term(x)).bitwiseAND(F.lit(mask)))


def vector(text: Column) -> Column:
    """The text's vector as array<bigint>."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: F.btrim(p, F.lit(SPACE)) != "")

    def of(p: Column) -> Column:
        hashes = [_sum(p, lambda x, k=k: F.xxhash64(x, F.lit(k)).bitwiseAND(F.lit(M62)), M62) for k in range(HASHES)]
        bits = lambda h: F.array(*[_sum(h, lambda x, k=k: F.shiftright(x, k).bitwiseAND(F.lit(ONES)), LANES) for k in range(LANE_SHIFTS)])
        # without a second argument xxhash64 starts from 42; with one, from the first one's hash
        seeded = [F.transform(p, lambda x: F.xxhash64(x)), F.transform(p, lambda x: F.xxhash64(x, F.lit("wide")))]
        return F.concat(F.array(F.size(p).cast("bigint"), *hashes), *[_let(h, bits) for h in seeded])

    return _let(paragraphs, of)


def _merge(a: Column, b: Column, sign: int) -> Column:
    def one(x: Column, y: Column, i: int) -> Column:
        if i == 0:
            return x + sign * y
        if i <= HASHES:
            return (x + sign * y).bitwiseAND(F.lit(M62))
        return (x + y if sign > 0 else x.bitwiseOR(F.lit(GUARDS)) - y).bitwiseAND(F.lit(LANES))

    return F.array(*[one(F.get(a, F.lit(i)), F.get(b, F.lit(i)), i) for i in range(1 + HASHES + WIDE)])


def added(a: Column, b: Column) -> Column:
    """The vector of both texts' paragraphs together."""
    return _merge(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """The vector of a's paragraphs without b's, which a must hold."""
    return _merge(a, b, -1)


def fingerprint(vec: Column) -> Column:
    """The vector as fixed-width lowercase hex."""
    return F.lower(F.array_join(F.transform(vec, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _dot(a: Column, b: Column) -> Column:
    lane = lambda x, s: F.shiftright(x, s * LANE_BITS).bitwiseAND(F.lit((1 << LANE_BITS - 1) - 1)) * 2.0
    wide = lambda v: F.slice(v, 2 + HASHES, WIDE)
    n, m = F.get(a, F.lit(0)).cast("double"), F.get(b, F.lit(0)).cast("double")
    terms = F.zip_with(wide(a), wide(b), lambda x, y: sum(((lane(x, s) - n) * (lane(y, s) - m) for s in range(3)), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    squares = _let(_dot(a, a) + _dot(b, b), lambda s: F.when(s > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * _dot(a, b) / s))).otherwise(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(squares)


def _following(docs: DataFrame) -> DataFrame:
    """Rows (key, to, need, rows): the document `key` follows `to` in descending order, the first follows the last.

    docs has key and n_chars. need is the length that `to` takes from its follower.
    """
    ids = docs.groupBy("key").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("rows"))
    spread = cut(ids.repartitionByRange(F.desc("key")).withColumn("part", F.spark_partition_id()))
    heads = spread.groupBy("part").agg(F.max("key").alias("head"))
    # one row per partition
    ends = cut(heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(Window.orderBy("part"))).alias("next_head")))
    inside = spread.withColumn("inner", F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key"))))
    return inside.join(ends, "part").select(F.coalesce("inner", "next_head").alias("key"), F.col("key").alias("to"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"), "rows")


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, vec, edited, edited_vec, and of the next document next_id, next_chars and next_vec.

    The edited text is the text with its last third replaced by as much of the start of the next document in
    descending id order. A null id comes last. Where several rows share an id, they have the same next
    document, and the one of them whose start sorts first is the next document for others.
    Two shuffles move text: whole texts by id, once, and the starts to those that need them. Both joins read
    the same columns of the first, so that it is made once and used again.
    """
    key = F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    base = docs.select(key.alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = cut(_following(base.select("key", F.length("text").alias("n_chars"))))
    placed = base.withColumn("n_chars", F.length("text")).withColumn("vec", vector(F.col("text"))).repartition("key")
    sent = placed.join(order, "key").select("to", F.expr("substring(text, 1, need)").alias("start"), F.col("vec").alias("next_vec"), F.col("doc_id").alias("next_id"), F.col("n_chars").alias("next_chars"))
    if not order.filter("rows > 1").isEmpty():
        sent = sent.groupBy("to").agg(F.min(F.struct("start", "next_vec", "next_id", "next_chars")).alias("s")).select("to", "s.*")
    taken = F.floor(F.col("n_chars") / 3).cast("int")
    joined = placed.join(sent, placed["key"] == sent["to"]).withColumn("_taken", taken)
    edited = joined.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - _taken), substring(start, 1, _taken))"))
    return edited.withColumn("edited_vec", vector(F.col("edited"))).select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "vec", "edited", "edited_vec", "next_id", F.col("next_chars").cast("bigint").alias("next_chars"), "next_vec")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("vec")).alias("fingerprint"), fingerprint(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"), likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
        "next_id", "next_chars",
    )


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLE_SQL = {}
