"""Operator 3, SimHash near-dedup: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint has 64 bits. With at most d differing bits and d + 2 blocks, two close fingerprints agree on at
least two blocks, so every pair of blocks is a join key (six keys of 32 bits for d = 2). Only distinct
fingerprints are joined. Where more than `crowded` distinct fingerprints share a key, pairs are not formed:
each fingerprint is instead filed under itself and under every value one bit away within the other blocks.
Two fingerprints at distance two or less meet under a common value, and all that meet there are within
distance two of each other, so linking each to the smallest loses nothing and stays linear.

Defined cases: a null or empty text has fingerprint zero, linked like any other; a text of fewer than
`width` words is hashed as one sequence; equal texts and repeated rows share a fingerprint; a null id takes
part in links, but never names a component (null only if no row of the component has an id); an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import similar
from .common import cut, fresh, restored, shingle_hashes, table
from .components import components

BITS = 64


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bit i is set if over half of them have it set."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text."""
    return majority(shingle_hashes(text, width))


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _block_masks(distance: int) -> list[int]:
    """For every pair of blocks, a mask of their bits."""
    edges = np.linspace(0, BITS, distance + 3).astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges.tolist())]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, distance: int = 2, crowded: int = 64) -> DataFrame:
    """Pairs (u, v) of vertices whose fingerprints differ in at most `distance` bits, enough of them to connect all that are close.

    prints has one row per distinct fingerprint: fp and vertex (both long). Buckets of up to `crowded`
    fingerprints are joined in full; larger ones are linked through shared one-bit neighbours.
    """
    if distance != 2:
        raise ValueError("the links of crowded buckets are exact for distance 2")
    masks = [_signed(m) for m in _block_masks(distance)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for k, m in enumerate(masks)]))
    filed = prints.select("fp", "vertex", keys.alias("key")).select("fp", "vertex", "key.*")
    sizes = filed.groupBy("k", "block").agg(F.count("*").alias("n")).filter("n > 1")
    filed = cut(filed.join(sizes, ["k", "block"]))
    sparse = filed.filter(F.col("n") <= crowded)
    other = sparse.select("k", "block", F.col("fp").alias("fp2"), F.col("vertex").alias("vertex2"))
    pairs = sparse.join(other, ["k", "block"]).filter((F.col("vertex") > F.col("vertex2")) & (hamming(F.col("fp"), F.col("fp2")) <= distance))
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << b)) for b in range(BITS)])
    within = F.filter(flips, lambda x: x.bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("k") + 1)) == 0)
    near = filed.filter(F.col("n") > crowded).select("k", "block", "vertex", F.explode(F.transform(within, lambda x: x.bitwiseXOR(F.col("fp")))).alias("at"))
    heads = near.groupBy("k", "block", "at").agg(F.min("vertex").alias("head"), F.count("*").alias("m")).filter("m > 1")
    stars = near.join(heads, ["k", "block", "at"]).filter("vertex > head").select(F.col("vertex").alias("u"), F.col("head").alias("v"))
    return pairs.select(F.col("vertex").alias("u"), F.col("vertex2").alias("v")).unionByName(stars)


def _sketched(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Rows (doc_id, fp, t, n, keys): with_fingerprints and what similar.links needs, in one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, keys = [], [], []
            for value in batch.column("text"):  # one text at a time
                hashes = shingle_hashes(value.as_py(), width)
                prints.append(majority(hashes))
                hashes = np.unique(hashes)
                sizes.append(len(hashes))
                keys.append(similar.block_keys(hashes))
            columns = [pa.array(np.array(prints, np.uint64).view(np.int64)), batch.column("t"), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "fp", "t", "n", "keys"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), similar.text_key(text).alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, t binary, n bigint, keys array<bigint>")


def _rooted(docs: DataFrame, doc_id: str, text: str, width: int, distance: int, crowded: int, similarity: float | None = None) -> DataFrame:
    """Rows (doc_id, fp, root, component_id), one per row of docs. Where ids repeat, components of different roots may share a name.

    With a similarity, groups that hold texts whose shingle sets are that similar are one component.
    """
    sketched = cut(with_fingerprints(docs, doc_id, text, width) if similarity is None else _sketched(docs, doc_id, text, width))
    rows = sketched.select("doc_id", "fp")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # the fingerprint itself names the vertex, so that rows without an id take part too
    found = components(links(prints.select("fp", F.col("fp").alias("vertex")), distance, crowded))
    named = prints.join(found, prints["fp"] == found["u"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    if similarity is not None:
        texts = sketched.filter("n > 0").groupBy("t", "fp").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
        texts = cut(texts.join(named.select("fp", "root"), "fp").drop("fp"))
        merged = components(similar.links(texts, docs, text, width, similarity))
        named = named.join(merged, named["root"] == merged["u"], "left").select("fp", "least", F.coalesce("component", "root").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(roots, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2, crowded: int = 64) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of docs; component_id is the smallest id of the component."""
    return _rooted(docs, doc_id, text, width, distance, crowded).drop("root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies: the row whose id names the component, with all its columns.

    Near are texts whose fingerprints are linked, and texts whose sets of shingles (`width` words) have a Jaccard
    similarity of `similarity` or more (see similar.py). Texts without words are one group.

    Of a component's rows that repeat its id those of the least fingerprint are taken, and the one of the least
    hash stays; an id that names several components stays once for each. Where no row of a component has an id, the one of
    the least hash stays.
    """
    rooted = cut(_rooted(docs, doc_id, text, width, 2, 64, similarity))
    nameless = rooted.filter("doc_id IS NULL AND component_id IS NULL").select(F.col("fp").alias("_fp"), "root").distinct()
    found = rooted.filter("doc_id IS NOT NULL")
    stay = found.filter("doc_id = component_id").groupBy("root", F.col("doc_id").alias(doc_id)).agg(F.min("fp").alias("_fp"))
    # texts are hashed again only where an id comes with several fingerprints
    mixed = cut(found.groupBy(F.col("doc_id").alias(doc_id)).agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a != b").select(doc_id))
    ided = docs.filter(F.col(doc_id).isNotNull())
    kept = [_first(ided.join(stay.join(mixed, doc_id, "left_anti"), doc_id, "left_semi"), [doc_id], docs.columns)]
    if not mixed.isEmpty():
        rows = _fingerprinted(ided.join(mixed, doc_id, "left_semi"), text, width)
        kept.append(_first(rows.join(stay, [doc_id, "_fp"], "left_semi"), [doc_id, "_fp"], docs.columns))
    if not nameless.isEmpty():
        rows = docs.filter(F.col(doc_id).isNull()).select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("text"))
        joined = _fingerprinted(rows, "text", width).drop("text").join(nameless, "_fp")
        least = joined.groupBy("root").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))  # combined before the shuffle
        kept.append(restored(least, docs.columns))
    return reduce(DataFrame.unionByName, kept)


def _first(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of the rows of equal keys the one whose columns have the least hash."""
    least, at = Window.partitionBy(*keys).orderBy(F.xxhash64(*columns)), fresh(rows.columns, "_at")
    return rows.withColumn(at, F.row_number().over(least)).filter(F.col(at) == 1).select(*columns)


def _fingerprinted(rows: DataFrame, text: str, width: int) -> DataFrame:
    """rows with the column _fp."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, "_fp"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_fp", LongType())]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLE_SQL = {}
