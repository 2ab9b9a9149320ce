"""Operator 10, substring dedup: a compressed FM-index per shard, searched backward for matching statistics.

A window is `width` consecutive words. A word goes if a window over it also starts in a document with a
smaller id. Documents meet only where they may share windows:

1. Every window has a minimizer, the least hash of its runs of `gram` words; equal windows have equal
   minimizers. Documents and runs of windows are counted for each minimizer (combined before the shuffle);
   those of two documents or more are shared.
2. Runs of windows with a shared minimizer are found again in the documents: by a Bloom filter that is
   broadcast, sixteen bits to a key, where the counted keys fit 2^`map_bits` bits, and by a join on the
   minimizers where they do not. The filter may let others in; that costs work and changes nothing.
3. Those runs are cut out as segments, at most RUN windows each, and go to the shard of their minimizer. A
   task packs what it has for a shard: each text once, with the places where it stands. Shards are numbered by
   the counted runs, so that each has about `shard_runs`, whatever the size of the input.
4. A minimizer with more than `crowded` runs (a whole shard's) is cut into single windows, dealt by their own hash. Of these
   the shard gets only the texts with their least and greatest documents; the places stay outside and are
   joined with what the shard finds, so no task holds the places of a passage that is everywhere.
5. Each shard is indexed (`FMIndex`) and its segments are streamed backward through the index; at each place
   with a match of `width` words the index tells the least document with that window.
6. The intervals of words to remove are gathered by document. They are broadcast where their measured size
   allows it, and joined by document otherwise.

Defined cases: null or empty texts have no words and stay; texts shorter than a window stay; ids that are
null count as larger than all others; rows with one id are one document, so they do not take words from each
other; words repeated within a document alone stay; an empty table gives an empty result; `keep_unique`
replaces the text and leaves other columns, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, fresh, shared_folder, table, with_columns_dropped
from .fm_index import FMIndex

WIDTH, GRAM = 13, 5
NO_ID = (1 << 63) - 1
#: Windows in a segment at most; places of a minimizer in the bitmap; bits of it for a key; places a task gathers before it packs them.
RUN, PROBES, BITS_EACH, HELD = 16, 3, 16, 300_000
#: Shards of small packed size that are yet much work have a task each, up to so many.
MOST_TASKS = 50_000
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(64)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _FACTORS[62]
    h = (h ^ (h >> np.uint64(29))) * _FACTORS[63]
    return h ^ (h >> np.uint64(32))


def minimizers(tokens: list[bytes], width: int, gram: int) -> np.ndarray:
    """The minimizer (uint64) of each window."""
    n = len(tokens)
    if n < width:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, tokens), np.uint64, n)
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams += h[j : n - gram + 1 + j] * _FACTORS[j]
    grams = _mixed(grams)
    least = grams[: n - width + 1].copy()
    for j in range(1, width - gram + 1):
        np.minimum(least, grams[j : n - width + 1 + j], out=least)
    return least


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d and t tell rows apart: the id, and a hash of the text for rows that share one."""
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))


def _runs(text: str | None, width: int, gram: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A text's words and its runs of windows with one minimizer: first window, the one after the last, minimizer (int64)."""
    tokens = _tokens(text)
    m = minimizers(tokens, width, gram)
    starts = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1]))) if len(m) else np.zeros(0, np.int64)
    return tokens, starts, np.append(starts[1:], len(m)) if len(m) else starts, m[starts].view(np.int64)


def shared_minimizers(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Rows (m, runs): minimizers of two documents or more and how many runs of windows have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                found = [np.unique(_runs(t, width, gram)[3], return_counts=True) for t in batch.column("text").slice(at, 2000).to_pylist()]
                m, of = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                runs = np.bincount(of, weights=np.concatenate([f[1] for f in found]), minlength=len(m))
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(np.bincount(of, minlength=len(m))), pa.array(runs.astype(np.int64))], names=["m", "docs", "runs"])

    each = docs.select("text").mapInArrow(run, "m bigint, docs bigint, runs bigint")
    return each.groupBy("m").agg(F.sum("docs").alias("docs"), F.sum("runs").alias("runs")).filter("docs > 1").select("m", "runs")


def _places(m: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES places of minimizers (uint64) in a bitmap of 2^bits bits. The low bits of a minimum are even, its high ones are not."""
    mask = np.uint64((1 << bits) - 1)
    first, step = m & mask, m >> np.uint64(28) & mask
    return np.stack([(first + np.uint64(k) * step) & mask for k in range(PROBES)]).astype(np.int64)


def bitmap(keys: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter (uint8) of keys (m), count of them, and the power of its bits: BITS_EACH or more for each key."""
    bits = _bits_for(count)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            chunk, first = np.unique(place >> 16, return_index=True)
            parts = np.split((place & 65535).astype("<u2"), first[1:])
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "spots"])

    def pack(chunk: pa.Table) -> pa.Table:
        marks = np.zeros(65536, np.uint8)
        for spots in chunk.column("spots").to_pylist():
            marks[np.frombuffer(spots, "<u2")] = 1
        return pa.table({"chunk": chunk.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()])})

    marks = np.zeros(1 << bits - 3, np.uint8)
    chunks = keys.select("m").mapInArrow(spots, "chunk bigint, spots binary").groupBy("chunk").applyInArrow(pack, "chunk bigint, bits binary")
    for row in chunks.toLocalIterator():
        marks[row["chunk"] * 8192 : (row["chunk"] + 1) * 8192] = np.frombuffer(row["bits"], np.uint8)
    return marks, bits


def _bits_for(count: int) -> int:
    return max(16, (BITS_EACH * max(1, count) - 1).bit_length())


def _in(m: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    place = _places(m.view(np.uint64), bits)
    return (marks[place >> 3] >> (place & 7).astype(np.uint8) & 1).all(axis=0)


#: What a task packs for a shard: texts (zstandard, a line each), how many places each has, and these in turn (of a crowded minimizer's
#: windows: the least and the greatest document, t and at being null). Rows without a shard are a crowded window's place.
PACKED = "crowded boolean, shard bigint, texts binary, places array<int>, d array<bigint>, t array<bigint>, at array<int>, k1 bigint, k2 bigint, own_d bigint, own_t bigint, own_at int"
KINDS = (pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
NAMES = [c.split()[0] for c in PACKED.split(", ")]


def _packed_rows(n: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in zip(NAMES, KINDS, strict=True)], names=NAMES)


class _Gathered:
    """A task's segments until they are packed by shard."""

    def __init__(self, crowded: bool, shards: int):
        self.crowded, self.shards = crowded, shards
        self.known: dict[bytes, int] = {}
        self.m: list[int] = []
        self.places: list[tuple[int, int, int, int]] = []

    def add(self, m: int, segment: bytes, d: int, t: int, at: int) -> None:
        i = self.known.setdefault(segment, len(self.known))
        if i == len(self.m):
            self.m.append(m)
        self.places.append((i, d, t, at))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.places:
            return
        of, d, t, at = (np.array(c, np.int64) for c in zip(*self.places, strict=True))
        texts = np.array(list(self.known), object)
        shard = (np.array(self.m, np.int64).view(np.uint64) * _FACTORS[61] >> np.uint64(20)) % np.uint64(self.shards)
        if self.crowded:
            keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<i8").reshape(-1, 2)
            yield _packed_rows(len(of), {"k1": keys[of, 0].copy(), "k2": keys[of, 1].copy(), "own_d": d, "own_t": t, "own_at": at.astype(np.int32)})
        by_text = np.lexsort((d, of)) if self.crowded else np.argsort(of, kind="stable")
        first = np.searchsorted(of[by_text], np.arange(len(texts)))
        last = np.append(first[1:], len(of))
        order = np.argsort(shard, kind="stable")
        opens = np.flatnonzero(np.concatenate(([True], shard[order][1:] != shard[order][:-1])))
        pack = zstandard.ZstdCompressor(3).compress
        made = {c: [] for c in NAMES[:7]}
        for some in np.split(order, opens[1:]):
            if self.crowded:
                at_rows = by_text[np.stack([first[some], last[some] - 1], axis=1).reshape(-1)]
                counts, rest = np.full(len(some), 2), {"t": None, "at": None}
            else:
                counts = last[some] - first[some]
                at_rows = by_text[np.repeat(first[some] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())]
                rest = {"t": t[at_rows], "at": at[at_rows].astype(np.int32)}
            row = {"crowded": self.crowded, "shard": int(shard[some[0]]), "texts": pack(b"\n".join(texts[some])), "places": counts.astype(np.int32), "d": d[at_rows]} | rest
            for c, value in row.items():
                made[c].append(value)
        yield _packed_rows(len(opens), made)
        self.known, self.m, self.places = {}, [], []


def _cut_out(out: tuple[_Gathered, _Gathered], tokens: list[bytes], runs: list[tuple[int, int, int, bool]], d: int, t: int, width: int) -> None:
    """Gathers the segments of runs (first window, the one after the last, minimizer, crowded); a crowded run goes window by window."""
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1).tolist()
    for a, z, m, crowded in runs:
        step = 1 if crowded else RUN
        for i in range(a, z, step):
            segment = joined[ends[i - 1] if i else 0 : ends[min(i + step, z) + width - 2] - 1]
            out[crowded].add(xxhash.xxh64_intdigest(segment) - (1 << 63) if crowded else m, segment, d, t, i)


def _packed(batches: Iterator[pa.RecordBatch], runs_of, shards: tuple[int, int], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED; runs_of gives a row's words and runs for `_cut_out`."""
    out = _Gathered(False, shards[0]), _Gathered(True, shards[1])
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for row in batch.slice(at, 1000).to_pylist():
                tokens, runs = runs_of(row)
                if runs:
                    _cut_out(out, tokens, runs, row["d"], row["t"], width)
            for side in out:
                if len(side.places) > HELD:
                    yield from side.rows()
    for side in out:
        yield from side.rows()


def packed_by_filter(docs: DataFrame, shared: DataFrame, counts: tuple[int, int], crowded: int, shards: tuple[int, int], width: int, gram: int) -> DataFrame:
    """Rows of PACKED; the runs of windows are found by broadcast filters of the shared and the crowded minimizers."""
    filters = bitmap(shared, counts[0]), bitmap(shared.filter(F.col("runs") > crowded), counts[1])
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def runs_of(row: dict) -> tuple[list[bytes], list]:
        tokens, a, z, m = _runs(row["text"], width, gram)
        if not len(m):
            return tokens, []
        hit = _in(m, *sent.value[0])
        a, z, m = a[hit], z[hit], m[hit]
        return tokens, list(zip(a.tolist(), z.tolist(), m.tolist(), _in(m, *sent.value[1]).tolist(), strict=True))

    return docs.mapInArrow(lambda batches: _packed(batches, runs_of, shards, width), PACKED)


def packed_by_join(docs: DataFrame, shared: DataFrame, crowded: int, shards: tuple[int, int], width: int, gram: int) -> DataFrame:
    """The same rows; the runs of windows are joined with the minimizers and then with their documents."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [_runs(t, width, gram)[1:] for t in part.column("text").to_pylist()]
                n = [len(f[0]) for f in found]
                d, t = (np.repeat(part.column(c).to_numpy(), n) for c in ("d", "t"))
                a, z, m = (np.concatenate([f[k] for f in found]) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, t, a.astype(np.int32), z.astype(np.int32), m)], names=["d", "t", "a", "z", "m"])

    docs = docs.dropDuplicates(["d", "t"])
    runs = docs.mapInArrow(listed, "d bigint, t bigint, a int, z int, m bigint").join(shared, "m")
    lists = runs.groupBy("d", "t").agg(F.collect_list(F.struct("a", "z", "m", (F.col("runs") > crowded).alias("crowded"))).alias("found"))
    runs_of = lambda row: (_tokens(row["text"]), [(r["a"], r["z"], r["m"], r["crowded"]) for r in row["found"]])
    return docs.join(lists, ["d", "t"]).mapInArrow(lambda batches: _packed(batches, runs_of, shards, width), PACKED)


def _merged(spans: DataFrame) -> DataFrame:
    """Rows (d, t, spans) from rows (d, t, a, z): each document's intervals in order, those that touch as one."""
    def merge(part: pa.Table) -> pa.RecordBatch:
        d, t, a, z = (part.column(c).to_numpy() for c in ("d", "t", "a", "z"))
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        base = (np.cumsum(new) - 1) << 32
        reach = np.maximum.accumulate(base + z)
        opens = new.copy()
        opens[1:] |= base[1:] + a[1:] > reach[:-1]
        first, rows = np.flatnonzero(opens), np.flatnonzero(new)
        last = np.append(first[1:], len(d)) - 1
        pairs = pa.StructArray.from_arrays([pa.array(a[first]), pa.array((reach[last] - base[last]).astype(np.int32))], names=["a", "z"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(first, rows), len(first)).astype(np.int32)), pairs)
        return pa.RecordBatch.from_arrays([pa.array(d[rows]), pa.array(t[rows]), lists], names=["d", "t", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the last document so far, of which more may come
        for batch in batches:
            if not batch.num_rows:
                continue
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = np.flatnonzero((d != d[-1]) | (t != t[-1]))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            if cut_at or (held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (d[-1], t[-1])):
                yield merge(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield merge(pa.Table.from_batches(held))

    ordered = spans.select("d", "t", "a", "z").repartition("d", "t").sortWithinPartitions("d", "t", "a")
    return ordered.mapInArrow(run, "d bigint, t bigint, spans array<struct<a:int,z:int>>")


def _matched(shard: pa.Table, width: int):
    """For a shard's rows of PACKED: its distinct texts; for their places text, d, t, at; and the runs of windows that a smaller
    document than a text's greatest has: text, first window, the place after the last word, least document."""
    unpack = zstandard.ZstdDecompressor().decompress
    known: dict[bytes, int] = {}
    of_lists = [[known.setdefault(x, len(known)) for x in unpack(r).split(b"\n")] for r in shard.column("texts").to_pylist()]
    texts, lengths, codes, words = list(known), np.zeros(len(known), np.int64), [], {}
    for i, s in enumerate(texts):
        tokens = s.split(b" ")
        lengths[i] = len(tokens)
        codes += [words.setdefault(w, len(words) + 1) for w in tokens]
    codes = np.array(codes, np.int64)
    flat = lambda c: shard.column(c).combine_chunks().flatten().to_numpy()
    of = np.repeat(np.array([i for x in of_lists for i in x], np.int64), flat("places"))
    d = flat("d")
    order = np.lexsort((d, of))
    of, d = of[order], d[order]
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    least, most = d[first[:-1]], d[first[1:] - 1]
    index = FMIndex(codes, lengths, least, width)
    found, where = index.matching_statistics(codes, lengths)
    full = np.flatnonzero(found == width)
    owner = index.least_owner(where[full])
    text = np.repeat(np.arange(len(texts)), lengths)[full]
    i = full - (np.cumsum(lengths) - lengths)[text]
    real = owner < most[text]
    text, i, owner = text[real], i[real], owner[real]
    opens = np.ones(len(text), bool)
    opens[1:] = (text[1:] != text[:-1]) | (i[1:] != i[:-1] + 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(text)) - 1 if len(begin) else begin
    return texts, (first, order, d), (text[begin], i[begin], i[end] + width, owner[begin]), flat


def _search_shard(shard: pa.Table, width: int) -> pa.Table:
    """The intervals [a, z) of words to remove at the places of the shard's segments."""
    _, (first, order, d), (text, i, j, owner), flat = _matched(shard, width)
    n = first[text + 1] - first[text]
    run = np.repeat(np.arange(len(text)), n)
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[text], n)
    real = d[row] > owner[run]
    run, row = run[real], row[real]
    at, t = flat("at")[order[row]], flat("t")[order[row]]
    return pa.table({"d": pa.array(d[row]), "t": pa.array(t), "a": pa.array((at + i[run]).astype(np.int32)), "z": pa.array((at + j[run]).astype(np.int32))})


def _search_windows(shard: pa.Table, width: int) -> pa.Table:
    """The least documents of the shard's single windows, by the windows' hashes."""
    texts, _, (text, _, _, owner), _ = _matched(shard, width)
    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(texts[k]) for k in text.tolist()), "<i8").reshape(-1, 2)
    return pa.table({"k1": pa.array(keys[:, 0].copy()), "k2": pa.array(keys[:, 1].copy()), "least": pa.array(owner)})


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, map_bits: int = 28, crowded: int | None = None, shard_runs: int = 50_000) -> DataFrame:
    """Rows (d, t, spans): for each document and text hash, merged intervals [a, z) of words to remove. docs as `_prepared` gives it."""
    spark = docs.sparkSession
    crowded = crowded or shard_runs
    shared = cut(shared_minimizers(docs, width, gram))
    many = F.col("runs") > crowded
    n, n_crowded, runs, windows = shared.agg(F.count("*"), F.count_if(many), F.sum(F.when(~many, F.col("runs"))), F.sum(F.when(many, F.col("runs")))).first()
    shards = tuple(1 + (x or 0) // shard_runs for x in (runs, windows))
    if _bits_for(n) <= map_bits:
        packed = packed_by_filter(docs, shared, (n, n_crowded), crowded, shards, width, gram)
    else:
        packed = packed_by_join(docs, shared, crowded, shards, width, gram)
    path = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    packed.write.option("compression", "zstd").parquet(path)
    parts = spark.read.schema(PACKED).parquet(path)
    plain, single = (parts.filter(kind).repartition(min(count, MOST_TASKS), "shard") for kind, count in zip(("NOT crowded", "crowded"), shards, strict=True))
    spans = plain.select("shard", "texts", "places", "d", "t", "at").groupBy("shard").applyInArrow(lambda s: _search_shard(s, width), "d bigint, t bigint, a int, z int")
    found = single.select("shard", "texts", "places", "d").groupBy("shard").applyInArrow(lambda s: _search_windows(s, width), "k1 bigint, k2 bigint, least bigint")
    places = parts.filter("shard IS NULL").join(found, ["k1", "k2"]).filter("least < own_d")
    everywhere = places.select(F.col("own_d").alias("d"), F.col("own_t").alias("t"), F.col("own_at").alias("a"), (F.col("own_at") + width).alias("z"))
    merged = cut(_merged(spans.unionByName(everywhere) if n_crowded else spans))
    forget(spark, path)
    return merged


BROADCAST_BYTES = 64 << 20


def _with_spans(docs: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """docs, and as the last column the spans of each row's text."""
    d, t, of = (fresh(docs.columns, n) for n in ("_d", "_t", "_spans"))
    found = repeated_spans(_prepared(docs, doc_id, text), **options).select(F.col("d").alias(d), F.col("t").alias(t), F.col("spans").alias(of))
    size = found.agg(F.sum(64 + 8 * F.size(of))).first()[0] or 0
    same = (F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)) == F.col(d)) & (F.xxhash64(text) == F.col(t))
    return docs.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, same, "left").drop(d, t)


def keep_words(text: str | None, spans: list[dict] | None) -> tuple[int, int, list[bytes]]:
    """The text's number of words, how many of them the spans take, and those that stay."""
    tokens = _tokens(text)
    kept, at = [], 0
    for s in spans or ():
        kept += tokens[at : s["a"]]
        at = s["z"]
    kept += tokens[at:]
    return len(tokens), len(tokens) - len(kept), kept


ADDED = {"n_words": "bigint", "n_removed": "bigint", "kept": "string"}


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with ADDED: kept is the words that stay, joined by single spaces."""
    own = with_columns_dropped(docs, *[c for c in ADDED if c not in (doc_id, text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [keep_words(t, s) for t, s in zip(part.column(text).to_pylist(), part.columns[-1].to_pylist(), strict=True)]
                new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([b" ".join(r[2]).decode() for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], *ADDED])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema] + [f"{k} {v}" for k, v in ADDED.items()])
    return _with_spans(own, doc_id, text, **options).mapInArrow(run, fields)


def keep_unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with texts that lost words replaced by the words that stay."""
    found = removals(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_id", "_text", **options)
    row = lambda c: F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_text")).alias(c) if c == text else F.col(f"_row.`{c}`")
    return found.select(*map(row, docs.columns))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return removals(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_substrings": op10_substrings}
ORACLE_SQL = {
    "op10_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE first_id < doc_id),
k AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
s AS (SELECT k.doc_id, count(r.p) AS n_removed, string_agg(x, ' ' ORDER BY k.p) FILTER (r.p IS NULL) AS kept FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.p = k.p GROUP BY k.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
}
