"""Operator 6, token ids in files of zstandard-compressed byte or bit planes.

Documents are put in ascending id order by range partitions, encoded, closed by an end id and cut into blocks
of `block_ids` ids that run across documents. A block's ids, as 32-bit little-endian integers, are transposed
into four byte planes (or 32 bit planes) and each plane is compressed alone. The file format is a Parquet
table with one row per block, so that any store Spark writes to will do and lost tasks leave nothing behind:

    shard, block     the range partition and the block's number in it
    first, n_ids     the shard-local place of the block's first id, and its ids
    kind, planes     "byte" or "bit", and the compressed planes
    doc_id, doc_start, doc_n   the chunk index: the documents that have ids in the block, with the
                     shard-local place of their first id and their number of ids

A document's place among all ids is its shard-local place plus the ids of all shards before.

Encoding is done by the tokenizers library on runs of non-space characters with the space before them. The
byte-level pre-tokenizer always cuts there, so a run's ids do not depend on its surroundings and each worker
asks the library once per distinct run. Texts that spell an added token are given to the library whole.

Defined cases: a null text is empty and has the end id alone; null ids come first; rows that share an id stay
apart, in no certain order among themselves; very long texts run over many blocks; an empty table writes and
reads an empty table; other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table

FORMAT = "shard int, block int, first bigint, n_ids int, kind string, planes array<binary>, doc_id array<bigint>, doc_start array<bigint>, doc_n array<bigint>"
# Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
RUN = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
SPACED = re.compile(f" [^{WHITE}]").match
# Letters and then symbols, between which the byte-level pattern cuts too.
WORD = re.compile(r"( ?[A-Za-z]+)([!-&(-/:-@\[-`{-~]+)").fullmatch
REMEMBERED = 1 << 20


class Encoder:
    """Texts to ids, as bytes of 32-bit little-endian integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        decoder = self.tokenizer.get_added_tokens_decoder()
        added = [t.content for t in decoder.values()]
        plain = [(t.content, i) for i, t in decoder.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.parting = plain[0] if plain else None
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        pre = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        self.sizes = None  # of tokens in bytes: a byte-level vocabulary spells each byte by one character
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            vocabulary = self.tokenizer.get_vocab()
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """The ids of runs, which hold no added token. Many go to the library as one text."""
        out = []
        for k in range(0, len(runs), 1024):
            part = runs[k : k + 1024]
            out += self._spaced(part) or self._parted(part)
        return out

    def _spaced(self, runs: list[str]) -> list[bytes] | None:
        """By bytes, for runs that begin with a space each and so are cut apart in one text; None if the ids do not end where the runs do."""
        if self.sizes is None or not all(map(SPACED, runs)):
            return None
        (ids,) = self._library(["".join(runs)])
        ends = np.cumsum([len(r) if r.isascii() else len(r.encode()) for r in runs])
        reached = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
        at = np.searchsorted(reached, ends)
        if len(reached) == 0 or reached[-1] != ends[-1] or (reached[at] != ends).any():
            return None
        cuts = [0, *(4 * (at + 1)).tolist()]
        return [ids[a:z] for a, z in zip(cuts, cuts[1:])]

    def _parted(self, runs: list[str]) -> list[bytes]:
        """By an added token between the runs."""
        if not self.parting:
            return self._library(runs)
        (ids,) = self._library([self.parting[0].join(runs)])
        ends = np.append(np.flatnonzero(np.frombuffer(ids, "<u4") == self.parting[1]), len(ids) // 4).tolist()
        return [ids[4 * a : 4 * z] for a, z in zip([0, *(e + 1 for e in ends)], ends)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            runs = [None if self.special and self.special.search(t) else RUN.findall(t) for t in part]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            known = self.known
            new = set().union(*filter(None, runs)).difference(known)
            halves = {r: m.groups() for r in new if (m := WORD(r))} if self.sizes is not None else {}
            new = {h for pair in halves.values() for h in pair}.difference(known).union(new.difference(halves))
            for own in ([r for r in new if SPACED(r)], [r for r in new if not SPACED(r)]):
                known.update(zip(own, self._runs(own), strict=True))
            known.update((r, known[a] + known[b]) for r, (a, b) in halves.items())
            for t, each in zip(part, runs, strict=True):
                yield self._library([t])[0] if each is None else b"".join(map(known.__getitem__, each))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Compressed planes of ids (uint32): byte b, or bit b, of every id is plane b."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        octets = np.packbits(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, bitorder="little")
    press = zstandard.ZstdCompressor(level=3)
    return [press.compress(np.ascontiguousarray(octets[:, b]).tobytes()) for b in range(octets.shape[1])]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    press = zstandard.ZstdDecompressor()
    columns = [np.frombuffer(press.decompress(p), np.uint8) for p in planes]
    octets = np.stack(columns, axis=1)
    if kind == "bit":
        octets = np.packbits(np.unpackbits(octets, axis=0, bitorder="little", count=n), axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class _Blocks:
    """Gathers documents' ids and gives out the rows of full blocks."""

    def __init__(self, shard: int, block_ids: int, kind: str):
        self.shard, self.block_ids, self.kind = shard, block_ids, kind
        self.buffer, self.first, self.block, self.docs = bytearray(), 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        self.docs.append((doc_id, self.first + len(self.buffer) // 4, len(ids) // 4))
        self.buffer += ids
        while len(self.buffer) >= 4 * self.block_ids:
            yield self.close(self.block_ids)

    def close(self, n: int) -> tuple:
        ids, end = np.frombuffer(bytes(self.buffer[: 4 * n]), "<u4"), self.first + n
        inside = [d for d in self.docs if d[1] < end]
        row = (self.shard, self.block, self.first, n, self.kind, to_planes(ids, self.kind), *map(list, zip(*inside)))
        self.docs = [d for d in self.docs if d[1] + d[2] > end]
        del self.buffer[: 4 * n]
        self.first, self.block = end, self.block + 1
        return row


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, block_ids: int = 1 << 16, kind: str = "byte") -> None:
    """Writes docs' ids to path."""
    import public_tokenizers
    from pyspark.sql.pandas.types import to_arrow_schema

    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], FORMAT).schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, own = _Blocks(TaskContext.get().partitionId(), block_ids, kind), encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                rows = [row for i, encoded in zip(ids[at : at + 256], own.encode(texts), strict=True) for row in blocks.add(i, encoded + end)]
                if rows:
                    yield _batch(rows, schema)
        if blocks.buffer:
            yield _batch([blocks.close(len(blocks.buffer) // 4)], schema)

    ordered = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, FORMAT).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) from files: start counts the ids of all documents before, ids are bytes as in Encoder."""
    blocks = spark.read.schema(FORMAT).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                ids = from_planes(b["planes"], b["n_ids"], b["kind"])
                lo, hi = b["first"], b["first"] + b["n_ids"]
                for i, start, n in zip(b["doc_id"], b["doc_start"], b["doc_n"], strict=True):
                    a, z = max(start, lo), min(start + n, hi)
                    rows.append((b["shard"], i, start, n, a, ids[a - lo : z - lo].tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["shard", "doc_id", "doc_start", "n_tokens", "at", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

    pieces = blocks.mapInArrow(run, "shard int, doc_id bigint, doc_start bigint, n_tokens bigint, at bigint, ids binary")
    whole = pieces.filter("octet_length(ids) = 4 * n_tokens").drop("at")
    parted = pieces.filter("octet_length(ids) < 4 * n_tokens").groupBy("shard", "doc_start").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("p")
    )  # only the documents across a block's end, one at most for each block
    joined = parted.select("shard", "doc_id", "doc_start", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row per shard
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["shard"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(offsets, "shard int, before bigint"))
    return whole.unionByName(joined).join(starts, "shard").select("doc_id", (F.col("before") + F.col("doc_start")).alias("start"), "n_tokens", "ids")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_token_files": op6_token_files}
ORACLE_SQL = {}
