"""Links between texts whose shingle sets have a Jaccard similarity of a threshold or more.

SimHash cannot find these: at a similarity of 0.8 two fingerprints of 64 bits differ in about ten, and blocks that
stand ten differing bits are five bits long. The blocks here are instead groups of minima of the shingle hashes
(20 blocks of four: a pair at 0.8 shares one with a chance of 0.99997, a closer pair more surely). As in the pigeonhole
join, texts meet in blocks and every link is verified, on the whole shingle sets.

What is linked already is never compared. In each block every text is first held against the block's head, so copies in
thousands cost one comparison each; of a text's blocks the largest comes first, and the others only where it is still apart. For what is still apart then, the shingles that another group has as well are counted
for each text by classes of their hashes. Two texts have at most the sum of the lesser counts in common; a pair that would
need more is not formed. This loses no pair, and of a large group of near copies on both sides of the threshold it
leaves few. What it leaves is compared on the whole sets, so pairs just below the threshold do cost their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shingle_hashes, small_enough
from .components import components

BLOCKS = 20
MINIMA = 4
CLASSES = 64
_RULE = np.random.default_rng(42)
_MASKS = _RULE.integers(0, 1 << 64, BLOCKS * MINIMA, np.uint64)
_FACTORS = _RULE.integers(0, 1 << 64, BLOCKS * MINIMA, np.uint64) | np.uint64(1)


def block_keys(hashes: np.ndarray) -> np.ndarray:
    """One long for each block: its number and its minima, mixed; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BLOCKS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):  # bounded memory for very long texts
        mixed = (hashes[at : at + (1 << 12), None] ^ _MASKS) * _FACTORS
        least = np.minimum(least, mixed.min(axis=0))
    keys = np.arange(1, BLOCKS + 1, dtype=np.uint64)
    for column in least.reshape(BLOCKS, MINIMA).T:
        keys = (keys ^ column) * _FACTORS[0]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _sets(docs: DataFrame, ends: DataFrame, text: str, width: int) -> DataFrame:
    """Rows (t, hashes) for each t of ends: the distinct shingle hashes of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(shingle_hashes(value.as_py(), width)).view(np.int64) for value in batch.column("a")]  # one text at a time
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(held, pa.list_(pa.int64()))], names=["t", "hashes"])

    rows = docs.select(text_key(text).alias("t"), F.col(text).alias("a"))
    one = lambda df: df.groupBy("t").agg(F.min("a").alias("a"))  # noqa: E731 - copies are folded before they are shuffled
    texts = one(rows.join(F.broadcast(ends), "t", "left_semi")) if small_enough(ends, 64) else one(rows).join(ends, "t", "left_semi")
    return texts.mapInArrow(run, "t binary, hashes array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (t, t2, u, v), already cut, whose sets are similar, as (u, v).

    The sets of the second texts, few where these are heads, go to all tasks if their measured size allows it: then no set is shuffled for a pair.
    """
    common = F.size(F.array_intersect("hashes", "hashes2"))
    other = sets.join(pairs.select(F.col("t2").alias("t")).distinct(), "t", "left_semi").select(F.col("t").alias("t2"), F.col("hashes").alias("hashes2"))
    size = other.agg(F.sum(F.size("hashes2") * 8 + 64)).first()[0] or 0
    held = pairs.join(sets, "t").join(F.broadcast(other) if size <= 64 << 20 else other, "t2")
    return cut(held.filter(common / (F.size("hashes") + F.size("hashes2") - common) >= similarity).select("u", "v").distinct())


def _several(members: DataFrame) -> DataFrame:
    """The rows of members (key, t, n, root) in blocks that hold several groups."""
    blocks = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    return members.join(blocks, "key")


def _shared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (t, shared): for each class of hashes how many shingles of t another group of members has as well."""
    held = members.select("t", "root").distinct().join(sets, "t").select("t", "root", F.explode("hashes").alias("hash"))
    several = held.groupBy("hash").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("hash")
    counts = held.join(several, "hash").groupBy("t", F.col("hash").bitwiseAND(CLASSES - 1).cast("int").alias("c")).agg(F.count("*").cast("int").alias("m"))
    by_class = counts.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("of"))  # CLASSES entries at most
    classes = F.sequence(F.lit(0), F.lit(CLASSES - 1))
    return by_class.select("t", F.transform(classes, lambda c: F.coalesce(F.try_element_at("of", c), F.lit(0))).alias("shared"))


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda total, m: total + m)


def _apart(similarity: float) -> Column:
    """Whether a pair (n, root), (n2, root2) is in different groups and its sizes allow the similarity."""
    return (F.col("root") != F.col("root2")) & (F.least("n", "n2") >= F.floor(similarity * F.greatest("n", "n2")))


def _beside_heads(members: DataFrame, similarity: float) -> DataFrame:
    """Rows (t, t2, u, v, size): texts beside the head of each of their blocks, where they may be similar and are apart."""
    head = F.min(F.struct(F.xxhash64("t", "key").alias("order"), F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("root").alias("root2")))
    heads = members.groupBy("key").agg(head.alias("head"), F.count("*").alias("size")).select("key", "size", "head.t2", "head.n2", "head.root2")
    return members.join(heads, "key").filter(_apart(similarity)).select("t", "t2", *_ends(), "size")


def _ends() -> list[Column]:
    return [F.greatest("root", "root2").alias("u"), F.least("root", "root2").alias("v")]


def links(texts: DataFrame, docs: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """Pairs (u, v: long, u > v) of groups that hold similar texts, enough of them to connect all.

    texts has one row for each distinct text: t (text_key), n (distinct shingles), keys (block_keys), root (its group so
    far). docs has the texts themselves.
    """
    members = cut(_several(texts.select("t", "n", "root", F.explode("keys").alias("key"))))
    sets = cut(_sets(docs, cut(members.select("t").distinct()), text, width))
    found = None
    for every in (False, True):
        pairs = _beside_heads(members, similarity)
        if not every:  # first each text beside the head of its largest block alone: what that links need not meet in its other blocks
            pairs = pairs.groupBy("t").agg(F.max_by(F.struct("t2", "u", "v"), F.struct("size", "t2")).alias("first")).select("t", "first.*")
        links_found = _verified(cut(pairs.select("t", "t2", "u", "v").distinct()), sets, similarity)
        found = links_found if found is None else found.unionByName(links_found)
        merged = components(links_found)
        members = cut(_several(members.join(merged, members["root"] == merged["u"], "left").select("key", "t", "n", F.coalesce("component", "root").alias("root"))))
    able = members.join(_shared(members, sets), "t").filter(_sum(F.col("shared")) >= F.floor(F.col("n") * similarity))
    rest = cut(able.join(texts.select("t", "keys"), "t"))
    other = rest.select("key", *[F.col(c).alias(f"{c}2") for c in ("t", "n", "root", "keys", "shared")])
    # a pair that shares several blocks is formed in the first of them only
    here = F.element_at(F.array_intersect("keys", "keys2"), 1) == F.col("key")
    # similar sets of sizes n and n2 have at least (n + n2) * similarity / (1 + similarity) shingles in common
    enough = _sum(F.zip_with("shared", "shared2", lambda a, b: F.least(a, b))) >= F.floor((F.col("n") + F.col("n2")) * (similarity / (1 + similarity)))
    formed = rest.join(other, "key").filter(_apart(similarity) & (F.col("t") < F.col("t2")) & here & enough)
    return found.unionByName(_verified(cut(formed.select("t", "t2", *_ends())), sets, similarity))
