"""Operator 1, edit-aware token counts.

A document is kept as its pre-tokens with a segment tree over them: for each node the code points and the
tokens below it. An edit replaces a span of code points. The pattern that cuts pre-tokens reads at most two
characters past a pre-token's end and none before its start, so cutting starts again at the last boundary that
lies before the edit by that much, and stops at the first boundary past the edit that the old cut has too;
whatever lies outside keeps its counts, and sums are updated on the paths above the changed leaves. Counts are
those of a byte-level BPE vocabulary, which never merges across pre-tokens.

Edits are an array column beside the text, array<struct<start, removed, inserted>>, applied in order to what
the edits before have left, so no text is shuffled. `edits_by_document` makes such a column from a table.

Defined cases: a null or empty text has no tokens; null or empty edits change nothing; a start or length past
the end is held to the end, negative ones to zero, a null insertion is empty; rows that repeat an id are
counted alike; an empty table gives an empty result; added columns replace input columns of the same name.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, with_columns_dropped

LOOKAHEAD = 2
#: Pre-tokens whose counts a Python worker remembers.
REMEMBERED = 1 << 18
ADDED = {"n_tokens": "bigint", "n_tokens_edited": "bigint", "n_pretokens": "bigint", "n_pretokens_edited": "bigint", "n_reencoded": "bigint"}


@functools.cache
def _counter(vocabulary: str, pattern: str):
    """How many tokens a pre-token has, and the compiled pattern."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            if len(known) >= REMEMBERED:
                known.clear()
            n = len(encoding.encode_ordinary(piece))
            if len(piece) < 64:
                known[piece] = n
        return n

    return count, regex.compile(pattern)


class CountTree:
    """A text cut into pre-tokens, in leaves of `width`, under a tree of sums of (code points, tokens, pre-tokens).

    A leaf is a list of (piece, tokens). The tree is an array heap: node i has children 2 i and 2 i + 1.
    """

    def __init__(self, text: str, count, pattern, width: int = 64):
        self.count, self.pattern, self.width = count, pattern, width
        self.reencoded = 0
        self._build([(p, count(p)) for p in pattern.findall(text)])

    def _build(self, pieces: list[tuple[str, int]]) -> None:
        self.leaves = [pieces[i : i + self.width] for i in range(0, len(pieces), self.width)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0, 0)] * (2 * self.size)
        for i in range(len(self.leaves)):
            self.sums[self.size + i] = self._leaf(i)
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self._add(self.sums[2 * i], self.sums[2 * i + 1])

    def _leaf(self, i: int) -> tuple[int, int, int]:
        leaf = self.leaves[i]
        return sum(len(p) for p, _ in leaf), sum(n for _, n in leaf), len(leaf)

    @staticmethod
    def _add(a, b):
        return a[0] + b[0], a[1] + b[1], a[2] + b[2]

    def _update(self, i: int) -> None:
        node = self.size + i
        self.sums[node] = self._leaf(i)
        while node := node // 2:
            self.sums[node] = self._add(self.sums[2 * node], self.sums[2 * node + 1])

    @property
    def n_chars(self) -> int:
        return self.sums[1][0]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    @property
    def n_pretokens(self) -> int:
        return self.sums[1][2]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p, _ in leaf)

    def tokens_before(self, position: int) -> int:
        """Tokens of the pre-tokens that end at or before position."""
        leaf, offset, total = self._find(position)
        for piece, n in self.leaves[leaf]:
            offset += len(piece)
            if offset > position:
                break
            total += n
        return total

    def _find(self, position: int) -> tuple[int, int, int]:
        """The leaf that holds position, with the code points and tokens before that leaf."""
        node, chars, tokens = 1, 0, 0
        while node < self.size:
            node *= 2
            if not self.sums[node + 1][2] or (self.sums[node][2] and position < chars + self.sums[node][0]):
                continue
            chars, tokens, node = chars + self.sums[node][0], tokens + self.sums[node][1], node + 1
        return node - self.size, chars, tokens

    def edit(self, start: int, removed: int, inserted: str) -> None:
        start = min(max(start, 0), self.n_chars)
        end = min(start + max(removed, 0), self.n_chars)
        first, at, _ = self._find(max(0, start - LOOKAHEAD))
        kept = 0
        while kept < len(self.leaves[first]) and at + len(self.leaves[first][kept][0]) + LOOKAHEAD <= start:
            at += len(self.leaves[first][kept][0])
            kept += 1
        last = max(first, self._find(end)[0])
        while True:
            old = [x for i in range(first, last + 1) for x in self.leaves[i]][kept:]
            whole = at + sum(len(p) for p, _ in old) == self.n_chars
            fresh, meets = self._recut(old, start - at, end - at, inserted, whole)
            if meets is not None:
                break
            last = min(len(self.leaves) - 1, 2 * last - first + 1)
        self.reencoded += len(fresh)
        self._replace(first, last, self.leaves[first][:kept] + [(p, self.count(p)) for p in fresh] + old[meets:])

    def _recut(self, old: list[tuple[str, int]], start: int, end: int, inserted: str, whole: bool) -> tuple[list[str], int | None]:
        """The new pre-tokens up to where they meet the old cut, and from which of the old pieces on it holds; None if old is too short."""
        text = "".join(p for p, _ in old)
        new, past = text[:start] + inserted + text[end:], start + len(inserted)
        bounds, x = {}, 0
        for k, (p, _) in enumerate(old):
            if x >= end:
                bounds[x - end + past] = k
            x += len(p)
        fresh = []
        for m in self.pattern.finditer(new):
            if m.start() >= past and m.start() in bounds:
                return fresh, bounds[m.start()]
            if not whole and m.end() + LOOKAHEAD > len(new):
                return fresh, None
            fresh.append(m.group())
        return fresh, len(old) if whole else None

    def _replace(self, first: int, last: int, pieces: list[tuple[str, int]]) -> None:
        """pieces take the place of the leaves first to last."""
        if len(pieces) > 4 * self.width * (last - first + 1):  # they no longer fit: the tree is built anew
            self._build([x for leaf in (*self.leaves[:first], pieces, *self.leaves[last + 1 :]) for x in leaf])
            return
        each = -(-len(pieces) // (last - first + 1))
        for i in range(first, last + 1):
            self.leaves[i] = pieces[(i - first) * each : (i - first + 1) * each]
            self._update(i)


def edits_by_document(edits: DataFrame, doc_id: str = "doc_id", order: str = "seq") -> DataFrame:
    """Rows (doc_id, edits) from rows (doc_id, order, start, removed, inserted); a document's edits form one array."""
    one = F.struct(order, "start", "removed", "inserted")
    arrays = edits.groupBy(doc_id).agg(F.array_sort(F.collect_list(one)).alias("e"))
    return arrays.select(doc_id, F.transform("e", lambda x: F.struct(x["start"], x["removed"], x["inserted"])).alias("edits"))


def count_edited(docs: DataFrame, text: str = "text", edits: str = "edits", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs, without text and edits, and the columns ADDED: counts before and after the edits, and pre-tokens encoded again."""
    import public_tokenizers

    vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    own = [c for c in with_columns_dropped(docs, *ADDED).columns if c not in (text, edits)]
    of_text, of_edits = fresh(own, "_text"), fresh(own, "_edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, compiled = _counter(vocabulary, pattern)
        for batch in batches:
            rows = []
            for t, changes in zip(batch.column(of_text).to_pylist(), batch.column(of_edits).to_pylist(), strict=True):
                tree = CountTree(t or "", count, compiled)
                before = tree.n_tokens, tree.n_pretokens
                for e in changes or ():
                    tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                rows.append((before[0], tree.n_tokens, before[1], tree.n_pretokens, tree.reencoded))
            new = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(ADDED))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + new, names=[*own, *ADDED])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema] + [f"{k} {v}" for k, v in ADDED.items()])
    return docs.select(*own, F.col(text).alias(of_text), F.col(edits).alias(of_edits)).mapInArrow(run, fields)


def sample_edits(text: str = "text"):
    """Three edits of any text, from the text alone: its middle 40 code points move to a third, its start is cut, its end repeats."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    edit = lambda a, r, s: F.struct(a.cast("bigint").alias("start"), F.lit(r).cast("bigint").alias("removed"), s.alias("inserted"))
    return F.array(
        edit(F.floor(n / 3), 0, t.substr(F.floor(n / 2).cast("int"), F.lit(40))),
        edit(F.lit(0), 7, F.lit("")),
        edit(F.floor(n * 2 / 3), 20, F.concat(F.lit(" "), t.substr(F.greatest(n - 30, F.lit(1)), F.lit(30)))),
    )


def op1_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", sample_edits().alias("edits"))
    return count_edited(docs)


QUERIES = {"op1_edit_counts": op1_edit_counts}
ORACLE_SQL = {}
