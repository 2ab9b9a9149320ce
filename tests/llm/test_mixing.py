import random
from collections import defaultdict
from fractions import Fraction

from pactframe.llm import mixing


def simulated(shares, blocks):
    """The slots of each source's blocks by a plain simulation, slot by slot, of the phases together."""
    left, done, slots, t, begin, ran = list(blocks), [0] * len(blocks), defaultdict(list), 0, 0, [0] * len(blocks)
    while any(left):
        total = sum(s for s, n in zip(shares, left) if n)
        ready = [(-(-(ran[i] + 1) * total // shares[i]), i) for i, n in enumerate(left) if n and ran[i] * total // shares[i] <= t - begin]
        _, i = min(ready)
        slots[i].append(t)
        t += 1
        ran[i] += 1
        left[i] -= 1
        if not left[i]:
            begin, ran = t, [0] * len(blocks)
    return slots


def test_period_keeps_within_one_block():
    rng = random.Random(2)
    for _ in range(200):
        shares = [rng.randint(1, 30) for _ in range(rng.randint(1, 7))]
        total, found = sum(shares), mixing.period(shares)
        assert sorted(t for s in found for t in s) == list(range(total))
        for s, at in zip(shares, found, strict=True):
            assert all(abs(sum(x < t for x in at) - Fraction(s * t, total)) < 1 for t in range(total + 1))
            assert all(j * total // s <= t < -(-(j + 1) * total // s) for j, t in enumerate(at))


def test_phases_agree_with_simulation():
    rng = random.Random(3)
    for _ in range(200):
        shares = [rng.randint(1, 12) for _ in range(rng.randint(1, 6))]
        blocks = [rng.randint(0, 40) for _ in shares]
        found = defaultdict(dict)
        for p in mixing.phases(shares, blocks):
            for b in range(p["lo"], p["hi"]):
                j = b - p["lo"]
                found[p["source"]][b] = p["start"] + j // p["m"] * p["total"] + p["slots"][j % p["m"]]
        want = simulated(shares, blocks)
        assert {i: [s[b] for b in range(len(s))] for i, s in found.items()} == dict(want)


def test_schedule_of_documents(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), 0) for i in range(600)] + [(None, "a", 0), (5, "z", 0), (5, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int")
    weights = {"a": 1, "b": 3, "c": 2}
    got = mixing.mix(df, weights, block_docs=4, resolution=12)
    assert got.columns == ["doc_id", "source", *mixing.ADDED]
    got = got.collect()
    assert sorted(str((r.doc_id, r.source)) for r in got) == sorted(str(r[:2]) for r in rows)
    of = {}
    for r in got:
        assert of.setdefault(r.slot, r.source) == r.source and r.release <= r.slot < r.deadline
    assert sorted(of) == list(range(len(of)))
    sizes = defaultdict(set)
    for i, s, _ in rows:
        sizes[s].add(i)
    order = sorted(sizes, key=lambda s: (s is not None, s or ""))
    shares = mixing.parts([weights.get(s) or 1 / 12 for s in order], 12)
    want = simulated(shares, [-(-len(sizes[s]) // 4) for s in order])
    assert {s: [t for t in sorted(of) if of[t] == s] for s in order} == {s: want[k] for k, s in enumerate(order)}
    places = [(r.slot, r.place) for r in got]
    assert places == sorted(places)
    for s in order:
        ids = [r.doc_id for r in sorted((r for r in got if r.source == s), key=lambda r: (r.slot, r.place))]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert mixing.mix(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = mixing.op7_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted((r.doc_id, r.source) for r in rows) == sorted((d.doc_id, d.source) for d in docs)
    assert all(r.release <= r.slot < r.deadline for r in rows)


def test_more_sources_than_the_bound(spark):
    rows = [(i, f"s{i % 5}") for i in range(400)] + [(i, f"host{i % 60}" if i % 60 else None) for i in range(1000, 1180)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for weights in (None, {"s1": 4, "s2": 2, "host7": 3}):
        got = mixing.schedule(df, weights, block_docs=4, resolution=100, max_sources=6).collect()
        assert sorted((r._id, str(r._source)) for r in got) == sorted((i, str(s)) for i, s in rows)
        big = [f"s{k}" for k in range(5)]
        weigh = (lambda s, n: n**0.5) if weights is None else (lambda s, n: weights.get(s, 2 / 100))
        small = {s for _, s in rows} - set(big)
        shares = mixing.parts([*[weigh(s, 80) for s in big], sum(weigh(s, 3) for s in small)], 100)
        want = simulated(shares, [20] * 5 + [45])
        assert {k: sorted({r.slot for r in got if (r._source in small) == (k == 5) and (k == 5 or r._source == big[k])}) for k in range(6)} == dict(want)
        assert all(r.release <= r.slot < r.deadline for r in got) and len({(r.slot, r.place) for r in got}) == len(rows)
        shared = [r for r in sorted(got, key=lambda r: (r.slot, r.place)) if r._source in small]
        assert all({r._source for r in shared[k : k + 60]} == small for k in (0, 60, 120))


def lags(slots, shares, blocks):
    """The largest deviation of any source, at any slot of the first phase, from its share."""
    end = min(s[-1] for i, s in slots.items()) + 1
    total, ran, worst = sum(shares), [0] * len(shares), Fraction(0)
    owner = {t: i for i, s in slots.items() for t in s}
    for t in range(end):
        ran[owner[t]] += 1
        worst = max(worst, abs(ran[owner[t]] - Fraction(shares[owner[t]] * (t + 1), total)))
    return worst


def test_tiny_weights_and_exact_fractions(spark):
    """A weight of 1e-5 beside two large ones keeps its own releases; fractions are not rounded."""
    rows = [(i, "abc"[i % 3]) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": Fraction(2, 3), "b": 0.33332, "c": 1e-5}
    got = mixing.schedule(df, weights, block_docs=10).collect()
    shares = mixing.exact_parts([Fraction(2, 3), Fraction("0.33332"), Fraction("1e-05")])
    want = simulated(shares, [300, 300, 300])
    slots = {k: sorted({r.slot for r in got if r._source == s}) for k, s in enumerate("abc")}
    assert slots == dict(want) and lags(slots, shares, [300] * 3) < 1
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_five_thousand_sources(spark):
    """Every source has a stream of its own: releases, deadlines and slots as in a slot-by-slot simulation."""
    rng = random.Random(5)
    sizes = [1 + min(6, int(rng.expovariate(0.8))) for _ in range(5000)]
    rows = [(i, f"s{k:04}") for k, n in enumerate(sizes) for i in range(n)]
    weights = {f"s{k:04}": 1 + k % 7 for k in range(5000)}
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=2).collect()
    assert len(got) == len(rows) and all(r.release <= r.slot < r.deadline for r in got)
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r._source, r.block)) == (r._source, r.block)
    assert sorted(slots) == list(range(sum(-(-n // 2) for n in sizes)))
    assert all(sorted({r.block for r in got if r._source == f"s{k:04}"}) == list(range(-(-sizes[k] // 2))) for k in range(0, 5000, 500))
    total = sum(weights.values())  # the first phase ends with the first source; until then every slot is by deadline among the released
    end = min(t for t, (s, b) in slots.items() if b == -(-sizes[int(s[1:])] // 2) - 1)
    order = [slots[t] for t in range(end + 1)]
    assert order == [(s, 0) for _, s in sorted((-(-total // w), s) for s, w in weights.items())[: end + 1]]


def test_query_against_a_simulation(spark, sf):
    """Every row of the query: block, slot, release, deadline and place from sorted ids and a slot-by-slot simulation."""
    ids = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids[r.source].append(r.doc_id)
    order = sorted(ids)
    shares, blocks = mixing.parts([len(ids[s]) ** 0.5 for s in order], 1000), [-(-len(ids[s]) // 32) for s in order]
    left, ran, begin, t, want = list(blocks), [0] * len(order), 0, 0, {}
    while any(left):
        total = sum(s for s, n in zip(shares, left) if n)
        _, i = min((-(-(ran[i] + 1) * total // shares[i]), i) for i, n in enumerate(left) if n and ran[i] * total // shares[i] <= t - begin)
        want[order[i], blocks[i] - left[i]] = t, begin + ran[i] * total // shares[i], begin - (-(ran[i] + 1) * total // shares[i])
        t, ran[i], left[i] = t + 1, ran[i] + 1, left[i] - 1
        if not left[i]:
            begin, ran = t, [0] * len(order)
    got = {r.doc_id: (r.source, r.block, r.slot, r.release, r.deadline, r.place) for r in mixing.op7_mixing(spark, sf).collect()}
    assert got == {d: (s, k // 32, *want[s, k // 32], k % 32) for s in order for k, d in enumerate(ids[s])}


def test_clashing_names_of_the_way(spark):
    rows = [(i, f"s{i % 3}", "mine") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _id string").selectExpr("*", "'b' AS _source", "1 AS _row", "2 AS _d", "3 AS _s", "4 AS _rank", "5 AS of", "6 AS at", "7 AS n")
    got = mixing.mix(df, block_docs=4)
    assert got.columns == [*df.columns, *mixing.ADDED]
    assert {tuple(r)[: len(df.columns)] for r in got.collect()} == {tuple(r) for r in df.collect()}
