import itertools
import re

import numpy as np
import xxhash

from pactframe.llm import components, simhash


def shingles(text, width):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)] * bool(w)


def brute(text, width=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def similar_pairs(texts):
    """Places of the texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = [set(shingles(t, 5)) for t in texts]
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) > 0 and 10 * len(x & y) >= 8 * len(x | y):
            yield a, b


def groups(keys, prints, more=()):
    """The least key that each key reaches over fingerprints two bits apart or less, and over more pairs of places."""
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    v = np.array(prints, np.uint64)
    close = ((a, a + 1 + b) for a in range(len(keys)) for b in np.flatnonzero(np.bitwise_count(v[a + 1 :] ^ v[a]) <= 2))
    for a, b in itertools.chain(close, more):
        x, y = find(keys[a]), find(keys[b])
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute(d.text) for d in docs]
    want = groups([d.doc_id for d in docs], prints)
    got = {r.doc_id: r for r in simhash.op3_simhash(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, p in zip(docs, prints, strict=True):
        assert (got[d.doc_id].fingerprint, got[d.doc_id].component_id) == (f"{p:016x}", want[d.doc_id])


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 1 << 63, 30).tolist():
        for _ in range(50):
            x = base
            for k in rng.integers(0, 63, rng.integers(0, 5)):
                x ^= 1 << int(k)
            prints.add(x)
    prints = sorted(prints)
    want = groups(prints, prints)
    df = spark.createDataFrame([(x, x) for x in prints], "fp long, vertex long")
    for crowded in (64, 3):
        found = {r.u: r.component for r in components.components(simhash.links(df, 2, crowded)).collect()}
        assert {x: found.get(x, x) for x in prints} == want


def test_long_chains(spark):
    df = spark.createDataFrame([(i + 1, i) for i in range(300)], "u long, v long")
    assert {r.component for r in components.components(df).collect()} == {0}
    assert components.components(df.limit(0)).count() == 0


def test_defined_cases(spark):
    rows = [(5, None, 1), (3, "", 1), (7, "two words", 1), (7, "two words", 1), (9, "TWO\twords", 1), (None, "two words", 1), (None, "alone here now", 1), (8, "ß" * 9, 1), (2, "z " * 70_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.classes(df).collect()), key=str)
    assert got == sorted([("5", 3), ("3", 3), ("7", 7), ("7", 7), ("9", 7), ("None", 7), ("None", None), ("8", 8), ("2", 2)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "7", "8", "None"]  # of the two rows without an id one is a copy of 7
    assert simhash.classes(df.limit(0)).count() == 0


def test_repeated_ids_lose_no_group(spark):
    shared = [f"the words of group {g} are its own {g * g}" for g in range(40)]
    # id 1 comes with 40 texts; group g also has a row of id 0 where g is even
    rows = [(1, t, g) for g, t in enumerate(shared)] + [(0, t, -1) for t in shared[::2]] + [(7, "alone", 5), (7, "alone", 4)]
    want = {(0, t) for t in shared[::2]} | {(1, t) for t in shared[1::2]} | {(7, "alone")}
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, n int").repartition(5)).collect()
        assert len(kept) == len(want) and {(r.doc_id, r.text) for r in kept} == want
        assert len({r.n for r in kept if r.doc_id == 7}) == 1


def variants(rng, base, count, edits):
    """Texts that differ from base in up to `edits` words."""
    for _ in range(count):
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(0, edits + 1)):
            w[k] = f"x{rng.integers(1 << 30)}"
        yield " ".join(w)


def test_similar_texts_lose_no_link(spark):
    rng = np.random.default_rng(3)
    texts = []
    for size in (6, 9, 30, 120, 700):
        for _ in range(6):
            texts += variants(rng, [f"w{x}" for x in rng.integers(0, 5000, size)], 12, size // 40 + 1)
    # a large group around one text, and one whose texts lie on both sides of the threshold
    texts += variants(rng, [f"h{x}" for x in rng.integers(0, 5000, 200)], 150, 5)
    texts += variants(rng, [f"g{x}" for x in rng.integers(0, 5000, 200)], 60, 14)
    texts += ["", None, "z " * 50_000, texts[0].upper(), texts[0]]
    order = [int(k) for k in rng.permutation(len(texts))]
    rows = [(at, texts[k], "clash", "clash") for at, k in enumerate(order)]
    held = [texts[k] for k in order]
    pairs = list(similar_pairs(held))
    prints = [brute(t, 5) for t in held]
    want = groups(list(range(len(held))), prints, pairs)
    assert len(set(groups(list(range(len(held))), prints).values())) > len(set(want.values())) + 100
    df = spark.createDataFrame(rows, "doc_id long, text string, root string, keys string").repartition(4)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_texts_below_the_similarity_stay(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles; a changed word in the middle takes five of them away
    near, far = list(base), list(base)
    for k in (20, 60):
        near[k] = "other"  # 90 of 110
    for k in (20, 50, 80):
        far[k] = "else"  # 85 of 115
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]
