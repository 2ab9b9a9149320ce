"""Operator 11, conversation structure repair: a recursive DuckDB query over hash-partitioned batches of turns.

A repaired conversation's roles are nothing, or a system turn or none and then pairs of user and assistant. Every row is kept
(0), gets another role (3) or is deleted (4, and must be where it is blank or repeats an earlier row); empty turns may be inserted
(3); a truncated row that stays costs 3 more. The grammar has four states: nothing yet, after system, after user, after
assistant. What one row can do is a small table of edges between states with costs and edits, inserted turns included.

One recursion advances every conversation of a batch by a turn and keeps for each grammar state the least cost and the
ASCII-least audit (two audits of one state and cost are never prefixes of each other, so the least stays least). Long conversations
are cut into segments of `SEGMENT` rows: a segment is walked from each state it can begin in, by itself, wherever its
hash puts it, and the same query then advances over a conversation's segments, a batch of them at a time. So no task
gathers a conversation. Only the repaired text and its digest need a conversation's rows in order: they are streamed,
sorted, with nothing held but the audit.

Defined cases: null roles and texts are one space, and a role of any other first letter fits no state; rows go by turn, nulls first, ties
by role and then text; a null conversation id is a conversation of its own; repeated rows are duplicates; a conversation
without rows gets an empty audit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SEGMENT = 512
#: Rows that go through one recursive query.
BATCH = 16384
WHITE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of a role, from states it may follow.
_AFTER = {"s": (SYSTEM, (NOTHING,)), "u": (USER, (NOTHING, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
#: What completes a conversation: the edits and their cost, by state.
_ENDS = {NOTHING: ("", 0), SYSTEM: ("II", 6), USER: ("I", 3), ASSISTANT: ("", 0)}


def _follows(state: int) -> str:
    """The role that is inserted after a state, or given to a row there."""
    return "assistant" if state == USER else "user"


def edges() -> list[tuple[str, int, int, int, str]]:
    """Rows (kind, start, goal, cost, edits): what a row of a kind (first letter of its role and of its fault) may do."""
    found = []
    for kind in (r + f for r in "suax" for f in ("", "d", "t")):
        extra = 3 if kind[1:] == "t" else 0
        for begin in range(4):
            found.append((kind, begin, begin, 4, "D"))
            at, inserted = begin, ""
            while kind[1:] != "d" and len(inserted) < 3:  # more than two inserted turns only go round
                after, before = _AFTER.get(kind[0], (0, ()))
                if at in before:
                    found.append((kind, begin, after, extra + 3 * len(inserted), inserted + "K"))
                found.append((kind, begin, _AFTER[_follows(at)[0]][0], extra + 3 * len(inserted) + 3, inserted + "R"))
                at, inserted = _AFTER[_follows(at)[0]][0], inserted + "I"
    return found


_EDGES = edges()
_WALK = """
WITH RECURSIVE walk(g, entry, state, k, cost, audit) USING KEY (g, entry, state) AS (
  SELECT g, entry, state, 0::BIGINT, cost, audit FROM starts
  UNION
  SELECT g, entry, goal, k, best.cost, best.audit FROM (
    SELECT w.g, w.entry, s.goal, s.k, min({'cost': w.cost + s.cost, 'audit': w.audit || s.audit}) AS best
    FROM walk w JOIN steps s ON s.g = w.g AND s.k = w.k + 1 AND s.start = w.state GROUP BY ALL)
)
SELECT g, entry, state, cost, audit FROM walk JOIN (SELECT g, max(k) AS k FROM steps GROUP BY g) USING (g, k) ORDER BY ALL"""
_STARTS = pa.schema([("g", pa.int64()), ("entry", pa.int64()), ("state", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def _walked(connection: duckdb.DuckDBPyConnection, starts: pa.Table, steps: str, rows: pa.Table) -> pa.Table:
    """Rows (g, entry, state, cost, audit) after the last of a group's steps; steps is SQL over rows."""
    connection.register("starts", starts)
    connection.register("rows", rows)
    connection.execute(f"CREATE OR REPLACE TEMP TABLE steps AS {steps}")
    return connection.sql(_WALK).to_arrow_table()


def _connected() -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    connection.execute("CREATE TABLE edges(kind VARCHAR, start BIGINT, goal BIGINT, cost BIGINT, edits VARCHAR)")
    connection.executemany("INSERT INTO edges VALUES (?, ?, ?, ?, ?)", _EDGES)
    return connection


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of about size rows with the places where a group of equal keys begins; rows come grouped, and no group is parted."""
    held: list[pa.RecordBatch] = []
    n = 0

    def begins(rows: pa.Table) -> list[int]:
        columns = [rows.column(k).to_pylist() for k in keys]
        seen = list(zip(*columns))
        return [i for i, x in enumerate(seen) if not i or x != seen[i - 1]]

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            rows = pa.Table.from_batches(held)
            at = begins(rows)
            if len(at) > 1:
                yield rows.slice(0, at[-1]), at[:-1]
                rows = rows.slice(at[-1])
            held, n = rows.combine_chunks().to_batches(), rows.num_rows
    if n:
        rows = pa.Table.from_batches(held)
        yield rows, begins(rows)


def _numbered(rows: pa.Table, at: list[int]) -> pa.Table:
    """rows with g, the number of their group, and k, their place in it from 1."""
    ends = [*at[1:], rows.num_rows]
    g = [i for i, (a, b) in enumerate(zip(at, ends)) for _ in range(a, b)]
    k = [x for a, b in zip(at, ends) for x in range(1, b - a + 1)]
    return rows.append_column("g", pa.array(g, pa.int64())).append_column("k", pa.array(k, pa.int64()))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, seg, entry, state, cost, audit): the cheapest way through a segment from each state to each."""
    connection = _connected()
    for rows, at in _groups(batches, ["seg", "conv"], BATCH):
        everywhere = [{"g": g, "entry": s, "state": s, "cost": 0, "audit": ""} for g in range(len(at)) for s in range(4)]
        steps = "SELECT g, k, start, goal, cost, edits AS audit FROM rows JOIN edges USING (kind)"
        found = _walked(connection, pa.Table.from_pylist(everywhere, _STARTS), steps, _numbered(rows.select(["kind"]), at))
        heads = rows.select(["conv", "seg"]).take(pa.array(at)).take(found.column("g"))
        out = pa.table([*heads.columns, *found.drop_columns(["g"]).columns], names=["conv", "seg", *found.column_names[1:]])
        yield from out.combine_chunks().to_batches()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, cost, audit) of rows (conv, seg, entry, state, cost, audit) by conversation and segment. What a conversation has come to is carried from batch to batch."""
    connection = _connected()
    carried: tuple[object, list[dict]] | None = None
    fresh = [{"entry": 0, "state": NOTHING, "cost": 0, "audit": ""}]

    def finished(conv: object, states: list[dict]) -> tuple[object, int, str]:
        return conv, *min((x["cost"] + _ENDS[x["state"]][1], x["audit"] + _ENDS[x["state"]][0]) for x in states)

    def batch_of(done: list[tuple[object, int, str]], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((kind, pa.int64(), pa.string()))], names=["conv", "cost", "audit"])

    kind = None
    for rows, at in _groups(batches, ["conv", "seg"], BATCH):
        kind = rows.schema.field("conv").type
        names = rows.column("conv").take(pa.array(at)).to_pylist()
        owner, place, convs = [], [], []
        for name in names:  # the conversation of each segment, and the segment's place in it
            if convs and convs[-1] == name:
                place.append(place[-1] + 1)
            else:
                convs.append(name)
                place.append(1)
            owner.append(len(convs) - 1)
        sizes = [b - a for a, b in zip(at, [*at[1:], rows.num_rows])]
        spread = lambda x: pa.array([v for v, n in zip(x, sizes) for _ in range(n)], pa.int64())  # noqa: B023, E731
        known = rows.select(["entry", "state", "cost", "audit"]).append_column("g", spread(owner)).append_column("k", spread(place))
        done = []
        if carried and carried[0] != convs[0]:
            done.append(finished(*carried))
            carried = None
        starts = [{"g": g, **s} for g in range(len(convs)) for s in (carried[1] if carried and not g else fresh)]
        found = _walked(connection, pa.Table.from_pylist(starts, _STARTS), 'SELECT g, k, entry AS start, "state" AS goal, cost, audit FROM rows', known)
        states: list[list[dict]] = [[] for _ in convs]
        for x in found.to_pylist():
            states[x.pop("g")].append(x)
        done += [finished(c, s) for c, s in zip(convs[:-1], states[:-1])]
        carried = convs[-1], states[-1]
        yield batch_of(done, kind)
    if carried:
        yield batch_of([finished(*carried)], kind)


def _repaired(row: dict, state: int, edits: Iterator[str], held: str | None) -> tuple[list[tuple[str, str, str]], int, str | None]:
    """The turns (role, text, edit) that a row gives, with those inserted before it, the state after them and the next edit read ahead."""
    made, edit = [], held
    while edit == "I":
        made.append((_follows(state), "", "I"))
        state = _AFTER[made[-1][0][0]][0]
        edit = next(edits, None)
    if edit != "D":
        made.append((row["role"] if edit == "K" else _follows(state), row["text"], edit))
        state = _AFTER[made[-1][0][0]][0]
    return made, state, next(edits, None)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[tuple[str, str, str]]]]:
    """Over a sorted stream of each conversation's audit (place -1) and rows: the row, and the turns it gives; a conversation's end comes with its audit's row again."""
    state, head, edits, held = NOTHING, None, iter(""), None

    def end() -> list[tuple[str, str, str]]:
        made, at, edit = [], state, held
        while edit == "I":
            made.append((_follows(at), "", "I"))
            at = _AFTER[made[-1][0][0]][0]
            edit = next(edits, None)
        return made

    for batch in batches:
        for row in batch.to_pylist():
            if row["pos"] < 0:
                if head is not None:
                    yield head, end()
                state, head, edits = NOTHING, row, iter(row["audit"] or "")
                held = next(edits, None)
                yield row, []
            else:
                made, state, held = _repaired(row, state, edits, held)
                yield row, made
    if head is not None:
        yield head, end()


_LEGAL = {"su", "ua", "au"}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done: list[tuple] = []
    digest, first, faults, turns, last, illegal, kind = hashlib.sha256(), True, {}, None, None, 0, None

    def flushed() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(kinds)], names=names)

    def typed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in stream:
            kind = batch.schema.field("conv").type
            yield batch

    opened = None
    for row, made in _turns(typed(batches)):
        for role, text, _ in made:
            digest.update((("" if first else "\n") + f"{role}:{text}").encode())
            first = False
        if row["pos"] >= 0:
            faults[row["fault"]] = faults.get(row["fault"], 0) + 1
            if (turn := row["turn"]) is not None:
                low, high, n = turns or (turn, None, 0)
                turns = low, turn, n + (turn != high)
            illegal += last is not None and last + row["role"][:1] not in _LEGAL
            last = row["role"][:1]
        elif opened is row:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((row["conv"], gaps, *[faults.get(f, 0) for f in ("blank", "duplicate", "truncated")], illegal, row["cost"] or 0, row["audit"] or "", digest.hexdigest()))
            if len(done) == 4096:
                yield flushed()
                done = []
        else:
            opened, digest, first, faults, turns, last, illegal = row, hashlib.sha256(), True, {}, None, None, 0
    if done:
        yield flushed()


def _found(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, pos, turn, role, text, fault), cut; pos orders a conversation's rows."""
    space = F.lit(" ")
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), space).alias(n) for c, n in ((role, "role"), (text, "text"))])
    order = ["conv", "turn", "role", "text"]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).withColumn("digest", F.md5("text")))
    first = placed.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("pos").alias("first"))
    same = placed["conv"].eqNullSafe(first["c"]) & (placed["role"] == first["r"]) & (placed["digest"] == first["d"])
    trimmed = F.expr(f"trim(TRAILING '{WHITE}' FROM text)")
    fault = F.when(trimmed == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return cut(placed.join(first, same).select("conv", "pos", "turn", "role", "text", fault.alias("fault")))


def _audited(rows: DataFrame, conv_type: str, segment: int) -> DataFrame:
    """Rows (conv, cost, audit)."""
    letter = F.left("role", F.lit(1))
    known = F.when(letter.isin("s", "u", "a"), letter).otherwise("x")
    kind = F.concat(known, F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise(""))
    small = rows.select("conv", F.expr(f"pos div {segment}").alias("seg"), "pos", kind.alias("kind"))
    walked = small.repartition("conv", "seg").sortWithinPartitions("pos").drop("pos").mapInArrow(_segments, f"conv {conv_type}, seg bigint, entry bigint, state bigint, cost bigint, audit string")
    return walked.repartition("conv").sortWithinPartitions("conv", "seg", "entry", "state").mapInArrow(_chained, f"conv {conv_type}, cost bigint, audit string")


def _stream(rows: DataFrame, convs: DataFrame, conv_type: str, segment: int) -> DataFrame:
    """Every conversation's audit, then its rows, sorted within hash partitions."""
    audits = _audited(rows, conv_type, segment).withColumnRenamed("conv", "c")
    heads = convs.join(audits, convs["conv"].eqNullSafe(audits["c"]), "left").select("conv", F.lit(-1).cast("bigint").alias("pos"), "cost", "audit")
    return rows.unionByName(heads, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "pos")


def audit(conversations: DataFrame, convs: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """A row for each conversation, also for those of convs (a column conv) that have no rows: faults, the cheapest repair's cost and audit, and the digest of its text."""
    kind = conversations.schema[conv].dataType.simpleString()
    known = (conversations.select(F.col(conv).alias("conv")) if convs is None else convs.select("conv")).distinct()
    stream = _stream(_found(conversations, conv, turn, role, text), known, kind, segment)
    return stream.mapInArrow(_digests, f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string").withColumnRenamed("conv", conv)


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The repaired turns: conversation, place from 0, role, text and the edit (K kept, R another role, I inserted) that made each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place, kind = [], 0, None

        def flushed() -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["conv", "place", "role", "text", "edit"])

        def typed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in stream:
                kind = batch.schema.field("conv").type
                yield batch

        for row, made in _turns(typed(batches)):
            if row["pos"] < 0 and not made:
                place = 0
            for turn_made in made:
                rows.append((row["conv"], place, *turn_made))
                place += 1
            if len(rows) >= 4096:
                yield flushed()
                rows = []
        if rows:
            yield flushed()

    kind = conversations.schema[conv].dataType.simpleString()
    known = conversations.select(F.col(conv).alias("conv")).distinct()
    stream = _stream(_found(conversations, conv, turn, role, text), known, kind, segment)
    return stream.mapInArrow(run, f"conv {kind}, place bigint, role string, text string, edit string").withColumnRenamed("conv", conv)


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults of known kinds, by the crc32 of `conv:turn` modulo 20: dropped, emptied, without full stops, repeated, given to the user. Nulls are one space."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate: Column = F.crc32(F.concat(written(conv), F.lit(":"), written(turn)).cast("binary")) % 20
    body = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    rows = conversations.select(conv, turn, written(role).alias("_role"), written(text).alias("_text"), fate.alias("_fate")).filter("_fate <> 0")
    made = rows.select(conv, turn, F.when(F.col("_fate") == 4, "user").otherwise(F.col("_role")).alias(role), body.alias(text), F.explode(F.sequence(F.lit(1), F.when(F.col("_fate") == 3, 2).otherwise(1))).alias("_copy"))
    return made.drop("_copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return audit(damage(conversations), conversations.select(F.col("conv_id").alias("conv")))


QUERIES = {"op11_conversations": op11_conversations}
ORACLE_SQL = {}
