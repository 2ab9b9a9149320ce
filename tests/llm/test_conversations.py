import hashlib
import itertools
import re
import zlib

import pytest

from pactframe.llm import conversations as c

GOOD = re.compile(r"(s?(ua)+)?\Z")
COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def faults_of(rows):
    """The fault of each of (turn, role, text), by the rules alone."""
    seen, found = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def slow(rows):
    """Cost, audit and repaired turns by a table over (rows read, whole role string's class), tried from every side: no edges, no DuckDB."""
    faults = faults_of(rows)
    # a role string is kept in full, so the pattern alone decides what is good; only its tail matters for what may follow
    states = {"": (0, "", [])}
    viable = lambda s: bool(re.fullmatch(r"s?(ua)*u?", s))

    def better(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def inserted(of):
        out = dict(of)
        for _ in range(2):
            for s, (cost, audit, made) in list(out.items()):
                for r in ("user", "assistant"):
                    if viable(s + r[0]):
                        better(out, short(s + r[0]), (cost + 3, audit + "I", [*made, (r, "")]))
        return out

    def short(s):
        """Equivalent shorter string: pairs after the first do not matter."""
        m = re.fullmatch("(s?)((?:ua)*)(u?)", s)
        return m[1] + m[2][:2] + m[3]

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for s, (cost, audit, made) in states.items():
            better(after, s, (cost + 4, audit + "D", made))
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault == "truncated" else 0
            for s, (cost, audit, made) in inserted(states).items():
                for r, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if viable(s + (r[:1] or "?")):
                        better(after, short(s + r[0]), (cost + price + extra, audit + letter, [*made, (r, text)]))
        states = after
    return min((x for s, x in inserted(states).items() if GOOD.match(s)), key=lambda x: x[:2])


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        w = lambda x: " " if x is None else str(x)
        role, text = w(role), w(text)
        fate = zlib.crc32(f"{w(conv)}:{w(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def expected(rows, convs):
    """A digest for each conversation, from rows (conv, turn, role, text)."""
    of = {k: [] for k in convs}
    for conv, turn, role, text in rows:
        of[conv].append((turn, role, text))
    out = {}
    for conv, mine in of.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [t for t, _, _ in mine if t is not None]
        faults = faults_of(mine)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, made = slow(mine)
        text = "\n".join(f"{r}:{x}" for r, x in made)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("segment", [c.SEGMENT, 2])
def test_query_against_a_slow_search(spark, sf, segment, monkeypatch):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = expected(damaged(rows), {r[0] for r in rows})
    if segment == c.SEGMENT:
        assert result(c.op11_conversations(spark, sf)) == want
    else:  # segments and batches so small that everything is put together from pieces
        monkeypatch.setattr(c, "BATCH", 8)
        assert result(c.audit(c.damage(table), table.selectExpr("conv_id AS conv"), segment=segment)) == want


CASES = [
    [],
    [(0, "user", "Hi."), (1, "assistant", "Yes.")],
    [(0, "system", "Be kind."), (1, "user", "Hi."), (2, "assistant", "Yes.")],
    [(0, "system", "Be kind.")],
    [(0, "assistant", "Yes."), (1, "user", "Hi.")],
    [(0, "user", "Hi."), (1, "user", "Hi."), (2, "assistant", "Yes.")],
    [(0, "user", "Hi"), (1, "assistant", "Yes")],
    [(0, "tool", "x."), (1, "", "y."), (2, "ugly", "z."), (3, "assistant", " \t")],
    [(None, None, None), (0, "user", "Hi."), (0, "user", "Ho."), (9, "assistant", "No!")],
    [(0, "user", "a."), (0, "system", "a."), (0, "assistant", "b?"), (5, "assistant", "c."), (5, "assistant", "d.")],
    [(i, ("user", "assistant")[i % 3 % 2], f"{i // 4}." if i % 5 else "trail") for i in range(40)],
    [(None, "user", "x."), (None, "assistant", "y.")],
]


@pytest.mark.parametrize("segment", [c.SEGMENT, 3, 1])
def test_cases(spark, segment):
    """Nulls, blank and repeated turns, strange roles, ties, long conversations, a null id; no rows at all."""
    rows = [(k if k != 3 else None, *r) for k, case in enumerate(CASES) for r in case]
    convs = [k if k != 3 else None for k in range(len(CASES))]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS pos", "1 AS seg", "2 AS conv", "3 AS fault")
    known = spark.createDataFrame([(k,) for k in convs], "conv bigint")
    filled = [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in rows]
    got = result(c.audit(df, known, segment=segment))
    want = expected(filled, convs)
    assert got == want
    assert got[0] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = c.repair(df, segment=segment).orderBy("conv_id", "place").collect()
    for conv in convs:
        mine = [r for r in turns if r["conv_id"] == conv]
        assert GOOD.match("".join(r["role"][:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == want[conv][-1]
        assert "".join(r["edit"] for r in mine) == want[conv][-2].replace("D", "")


def test_every_short_conversation_against_all_edits():
    """All role strings of up to three rows, every edit sequence tried: the slow search itself is held against plain enumeration."""
    inserts = ["", "u", "a", "ua", "au"]
    for n in range(4):
        for roles in itertools.product("suax", repeat=n):
            rows = [(i, r, f"{i}.") for i, r in enumerate(roles)]
            best = None
            for ops in itertools.product([(i, o) for i in inserts for o in ("K", "u", "a", "D")], repeat=n):
                for end in inserts:
                    string, cost, audit = "", 0, ""
                    for (ins, op), (_, r, _) in zip(ops, rows):
                        string += ins + {"K": r, "D": ""}.get(op, op)
                        cost += 3 * len(ins) + {"K": 0, "D": 4}.get(op, 3)
                        audit += "I" * len(ins) + (op if op in "KD" else "R")
                    if GOOD.match(string + end) and (best is None or (cost + 3 * len(end), audit + "I" * len(end)) < best):
                        best = cost + 3 * len(end), audit + "I" * len(end)
            assert slow(rows)[:2] == best, roles


def test_empty_table_and_a_conversation_that_fills_many_segments(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert c.audit(none).count() == 0 and c.repair(none).count() == 0
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(3000)] + [(2, i, "user", "same.") for i in range(1000)]
    got = result(c.audit(spark.createDataFrame(rows, COLUMNS).repartition(7), segment=64))
    assert got[1][5:7] == (0, "K" * 3000)
    assert got[2][1:7] == (0, 999, 0, 999, 4 * 999 + 3, "K" + "D" * 999 + "I")
