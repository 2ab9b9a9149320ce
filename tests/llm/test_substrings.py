import random

import numpy as np
import pytest

from pactframe.llm import substrings as sub
from pactframe.llm.fm_index import BitVector, FMIndex, WaveletMatrix


def brute(rows, width):
    """rows (doc_id, text): for each, the words that stay."""
    tokens = [(t or "").encode().split() for _, t in rows]
    first = {}
    key = lambda d: sub.NO_ID if d is None else d
    for (d, _), w in zip(rows, tokens):
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, key(d)), key(d))
    out = []
    for (d, _), w in zip(rows, tokens):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                gone |= set(range(i, i + width))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, 200).astype(np.uint8)
    assert BitVector(bits).ones(np.arange(201)).tolist() == [0, *np.cumsum(bits).tolist()]
    codes = rng.integers(0, 11, 500)
    matrix = WaveletMatrix(codes, 11)
    for c in range(11):
        assert matrix.rank(np.full(501, c), np.arange(501)).tolist() == [0, *np.cumsum(codes == c).tolist()]


@pytest.mark.parametrize("depth", [1, 2, 5, 13])
def test_matching_statistics(depth):
    rng = np.random.default_rng(depth)
    for _ in range(20):
        lengths = rng.integers(1, 30, rng.integers(1, 8))
        codes = rng.integers(1, 4, lengths.sum())
        index = FMIndex(codes, lengths, np.arange(len(lengths)), depth)
        texts = np.split(codes, np.cumsum(lengths)[:-1])
        asked_lengths = rng.integers(1, 30, 5)
        asked = rng.choice([-1, 1, 2, 3, 9], asked_lengths.sum(), p=[0.05, 0.3, 0.3, 0.3, 0.05])
        found, where = index.matching_statistics(asked, asked_lengths)
        at = 0
        for n in asked_lengths:
            pattern = asked[at : at + n].tolist()
            for i in range(n):
                holders = lambda k: [o for o, t in enumerate(texts) if any(t[j : j + k].tolist() == pattern[i : i + k] for j in range(len(t) - k + 1))]  # noqa: B023, E731
                want = max([k for k in range(1, min(depth, n - i) + 1) if holders(k)], default=0)
                assert found[at + i] == want
                if want == depth:
                    assert index.least_owner(where[at + i : at + i + 1])[0] == min(holders(depth))
            at += n


def test_places_of_bits():
    rng = np.random.default_rng(2)
    for n, share in ((1, 1.0), (64, 0.5), (1000, 0.02), (1000, 0.9), (130, 0.0)):
        bits = rng.random(n) < share
        places = np.flatnonzero(bits)
        assert BitVector(bits).place(np.arange(len(places) + 1)).tolist() == [*places.tolist(), n]


@pytest.mark.parametrize(("crowded", "map_bits"), [(4096, 28), (1, 28), (4096, 10), (3, 10)])
def test_removals_agree_with_brute_force(spark, crowded, map_bits):
    rng = random.Random(7)
    passages = [[f"w{rng.randint(0, 40)}" for _ in range(rng.randint(4, 25))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 8)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 12))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), i))
    rows += [(200, None, 0), (None, rows[3][1], 0), (None, rows[3][1], 0), (201, "", 0), (202, "same " * 3000, 0), (203, "same " * 40, 0), (5, rows[5][1], 0), (5, rows[6][1] + " x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m long")
    for width, gram in ((13, 5), (5, 2)):
        got = {}
        for r in sub.removals(df, width=width, gram=gram, crowded=crowded, map_bits=map_bits, shard_runs=200).collect():
            got.setdefault((r.doc_id, r.text), []).append((r.n_words, r.n_removed, r.kept))
        for (d, t, _), kept in zip(rows, brute([r[:2] for r in rows], width), strict=True):
            n = len((t or "").split())
            assert got[d, t].pop() == (n, n - len(kept), b" ".join(kept).decode())
        assert not any(got.values())
    assert sub.removals(df.limit(0)).count() == 0
    assert sub.keep_unique(df).columns == df.columns and sub.keep_unique(df).count() == len(rows)
