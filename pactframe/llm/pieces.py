"""Operator 5, SentencePiece encoding and decoding with N-best segmentation.

A text is normalized as the model says (a space put before it, spaces written as U+2581) and laid out as a
lattice of pieces; a segmentation's score is the sum of its pieces' scores. A character no piece covers goes
to its bytes, at the lowest score less 10. Forward Viterbi scores are computed first; they are the exact
score of the best way from the start to each place, so a backward A* search from the end that adds them to
what it has gathered takes segmentations off its queue in order of score, N-best with no wasted path.

No piece spans a space that follows another character, or a character outside the vocabulary, so the lattice
falls apart into runs there. A run's best segmentation and what its second best loses are remembered by each
worker; among a text's N best, only the N - 1 runs that lose least can differ from the best, and the same A*
search, over a lattice of those runs' own N best, puts them together.

A segmentation other than the best is returned as its score and its swaps: (at, removed, ids) says that the
best's pieces from at on, as many as removed, become ids. `expand` writes it out.

Defined cases: a null or empty text has no pieces and one segmentation, the empty one; a text with fewer than
N segmentations has them all; equal scores come in a fixed order; U+2581 in a text reads back as a space, as
the model has it; very long runs take memory in proportion to their length; repeated rows are alike; an empty
table gives an empty result; added columns replace input columns of the same name.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns_dropped

SPACE = "▁"
UNKNOWN_LOSS = 10.0
#: Runs whose best segmentation, and whose N best, a worker remembers.
REMEMBERED, LISTED = 1 << 19, 1 << 16
Arc = tuple[int, float, object]  # where it starts, its score, what it stands for


def viterbi(arcs: Sequence[Sequence[Arc]]) -> list[float]:
    """The best score from place 0 to each place; arcs[j] lists the arcs that end at place j."""
    best = [0.0]
    for into in arcs[1:]:
        best.append(max((best[i] + s for i, s, _ in into), default=float("-inf")))
    return best


def n_best(arcs: Sequence[Sequence[Arc]], n: int) -> list[tuple[float, list]]:
    """The n best paths (score, labels from first to last), in order of score, by backward A*.

    arcs[j] lists the arcs that end at place j. Every place must be reached from place 0. Of equal scores the
    path begun last goes on, so that ties are followed to their end one by one.
    """
    ahead = viterbi(arcs)
    queue = [(-ahead[-1], 0, len(arcs) - 1, 0.0, None)]
    made, found = 1, []
    while queue and len(found) < n:
        _, _, j, gathered, path = heapq.heappop(queue)
        if j == 0:
            labels = []
            while path is not None:
                labels.append(path[0])
                path = path[1]
            found.append((gathered, labels))
            continue
        for i, s, label in arcs[j]:
            heapq.heappush(queue, (-(gathered + s + ahead[i]), -made, i, gathered + s, (label, path)))
            made += 1
    return found


class PieceModel:
    """The pieces of a SentencePiece model file, with their scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)} | set(self.bytes.values())
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(size) if i not in special}
        self.longest = max(map(len, self.pieces))
        self.unknown_score = min(s for _, s in self.pieces.values()) - UNKNOWN_LOSS
        self.text = [b""] * size
        for piece, (i, _) in self.pieces.items():
            self.text[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        if any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in self.pieces):
            raise ValueError("pieces that span a space need a lattice of whole texts")
        covered = "".join(sorted({c for p in self.pieces for c in p} - {SPACE}))
        self.runs = re.compile(f"{SPACE}*[{re.escape(covered)}]+|{SPACE}+|[^{re.escape(covered)}]")
        self.known: dict[str, tuple[float, bytes, float]] = {}
        self.listed: dict[str, list] = {}

    @functools.cached_property
    def trie(self) -> dict:
        """The pieces by their characters; workers that only decode do without."""
        trie: dict = {}
        for piece, (i, score) in self.pieces.items():
            node = trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (i.to_bytes(4, "little"), score)
        return trie

    def arcs(self, run: str) -> list[list[Arc]]:
        """The run's lattice; labels are tuples of ids."""
        pieces, longest = self.pieces, self.longest
        into: list[list[Arc]] = [[]]
        for j in range(1, len(run) + 1):
            here = []
            for i in range(max(0, j - longest), j):
                hit = pieces.get(run[i:j])
                if hit:
                    here.append((i, hit[1], hit[:1]))
            if not here or here[-1][0] != j - 1:
                here.append((j - 1, self.unknown_score, tuple(self.bytes[b] for b in run[j - 1].encode())))
            into.append(here)
        return into

    def best(self, run: str) -> tuple[float, bytes, float]:
        """The run's best score, its ids as 32-bit integers, and what the second best loses (infinite without one)."""
        got = self.known.get(run)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
                self.listed.clear()
            got = self.known[run] = self._best(run)
        return got

    def _best(self, run: str) -> tuple[float, bytes, float]:
        """Forward Viterbi with the two best scores to each place; pieces are found along a trie."""
        n, none = len(run), float("-inf")
        first, second, back = [none] * (n + 1), [none] * (n + 1), [None] * (n + 1)
        first[0] = 0.0
        for i in range(n):
            node, reached, runner_up, j = self.trie, first[i], second[i], i
            alone = True
            while j < n:
                node = node.get(run[j])
                if node is None:
                    break
                j += 1
                hit = node.get("")
                if hit is None:
                    continue
                alone = alone and j > i + 1
                score = reached + hit[1]
                if score > first[j]:
                    second[j] = first[j] if first[j] > runner_up + hit[1] else runner_up + hit[1]
                    first[j], back[j] = score, (i, hit[0])
                elif score > second[j]:
                    second[j] = score
            if alone:
                score, j = reached + self.unknown_score, i + 1
                low = runner_up + self.unknown_score
                if score > first[j]:
                    second[j] = first[j] if first[j] > low else low
                    first[j], back[j] = score, (i, b"".join([self.bytes[b].to_bytes(4, "little") for b in run[i].encode()]))
                elif score > second[j]:
                    second[j] = score
        path, j = [], n
        while j:
            path.append(back[j][1])
            j = back[j][0]
        path.reverse()
        return first[n], b"".join(path), first[n] - second[n]

    def listing(self, run: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The run's n best (score, ids)."""
        got = self.listed.get(run)
        if got is None or len(got) < n:
            if len(self.listed) >= LISTED:
                self.listed.clear()
            got = [(score, tuple(x for label in labels for x in label)) for score, labels in n_best(self.arcs(run), n)]
            self.listed[run] = got
        return got[:n]

    def encode(self, text: str | None, n: int) -> tuple[bytes, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
        """The best segmentation's ids, and for each of the n best its score and swaps."""
        runs = self.runs.findall(SPACE + text.replace(" ", SPACE)) if text else []
        each = [self.known.get(r) or self.best(r) for r in runs]
        ids = b"".join([e[1] for e in each])
        total = sum(e[0] for e in each)
        if n < 2:
            return ids, [(total, [])]
        losses = np.fromiter((e[2] for e in each), np.float64, len(each))
        chosen = np.sort(np.lexsort((np.arange(len(losses)), losses))[: n - 1] if len(losses) <= 4 * n else self._least(losses, n - 1)).tolist()
        arcs: list[list[Arc]] = [[]]
        for level, k in enumerate(chosen):
            arcs.append([(level, score - each[k][0], (k, alternative if rank else None)) for rank, (score, alternative) in enumerate(self._with_best_first(runs[k], each[k], n))])
        starts = None
        found = []
        for lost, labels in n_best(arcs, n):
            swaps = []
            for k, alternative in labels:
                if alternative is not None:
                    if starts is None:
                        starts = np.cumsum([0] + [len(e[1]) // 4 for e in each])
                    swaps.append((int(starts[k]), len(each[k][1]) // 4, list(alternative)))
            found.append((total + lost, swaps))
        return ids, found

    @staticmethod
    def _least(losses: np.ndarray, k: int) -> np.ndarray:
        limit = np.partition(losses, k - 1)[k - 1]
        below, equal = np.flatnonzero(losses < limit), np.flatnonzero(losses == limit)
        return np.concatenate((below, equal[: k - len(below)]))

    def _with_best_first(self, run: str, best: tuple[float, bytes, float], n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The run's n best, the one that the text's best uses before others of its score."""
        own = tuple(np.frombuffer(best[1], "<u4").tolist())
        listed = self.listing(run, n)
        rest = [x for x in listed if x[1] != own]
        return [(best[0], own), *rest][:n]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids."""
        text = b"".join([self.text[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ENCODED = {"ids": "binary", "segmentations": "array<struct<score:double,swaps:array<struct<at:int,removed:int,ids:array<int>>>>>"}


def _mapped(df: DataFrame, source: str, added: dict[str, str], values) -> DataFrame:
    """df with the columns `added`, values(list of source's values) a list of columns in their place."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = with_columns_dropped(df, *[c for c in added if c != source])
    new = to_arrow_schema(df.sparkSession.createDataFrame([], ", ".join(f"{k} {v}" for k, v in added.items())).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = [pa.array(c, f.type) for c, f in zip(values(part.column(source).to_pylist()), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *added])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema] + [f"{k} {v}" for k, v in added.items()])
    return own.mapInArrow(run, fields)


def encode(docs: DataFrame, text: str = "text", n: int = 4, path: str | None = None, decoded: str | None = None) -> DataFrame:
    """docs with ids, the best segmentation as 32-bit little-endian integers, and the n best segmentations.

    `decoded` names a column for the text of ids, read back by the same worker.
    """
    path = path or _default_path()

    def values(texts: list[str | None]) -> list[list]:
        own = model(path)
        rows = [own.encode(t, n) for t in texts]
        lists = [[{"score": s, "swaps": [{"at": a, "removed": r, "ids": i} for a, r, i in swaps]} for s, swaps in found] for _, found in rows]
        back = [[_decoded(own, ids) for ids, _ in rows]] if decoded else []
        return [[ids for ids, _ in rows], lists, *back]

    return _mapped(docs, text, ENCODED | ({decoded: "string"} if decoded else {}), values)


def _decoded(own: PieceModel, ids: bytes | None) -> str:
    return own.decode(np.frombuffer(ids or b"", "<u4").tolist())


def decode(encoded: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """encoded with the text of ids."""
    path = path or _default_path()
    return _mapped(encoded, ids, {into: "string"}, lambda column: [[_decoded(model(path), b) for b in column]])


def expand(ids: Sequence[int], swaps: Sequence[tuple[int, int, Sequence[int]]]) -> list[int]:
    """The ids of a segmentation: the best's, with its swaps made."""
    out, at = [], 0
    for start, removed, new in sorted(swaps, key=lambda s: s[0]):
        out += [*ids[at:start], *new]
        at = start + removed
    return out + list(ids[at:])


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"),
        F.transform("segmentations", lambda s: s["score"]).alias("scores"), F.sha2(F.to_json("segmentations"), 256).alias("segmentations_sha256"),
    )


QUERIES = {"op5_pieces": op5_pieces}
ORACLE_SQL = {}
