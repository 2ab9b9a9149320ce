import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pactframe.llm import fingerprints as fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_vector(text):
    """The vector from its definition: counts and sums of hashes, with the hash of a text and a constant chained."""
    paragraphs = [p for p in re.split(r"\n|(?<=[.!?])[ \t\n\x0b\x0c\r]", text) if p.strip(" \t\x0b\x0c\r")]
    first = [xxhash.xxh64_intdigest(p.encode(), 42) for p in paragraphs]
    then = lambda data: [xxhash.xxh64_intdigest(data, h) for h in first]
    sums = [sum(then(k.to_bytes(4, "little"))) % (1 << 62) for k in range(4)]
    lanes = []
    for hashes in (first, then(b"wide")):
        for k in range(20):
            bits = [sum(signed(h) >> k + 20 * s & 1 for h in hashes) % (1 << 19) for s in range(3)]
            lanes.append(bits[0] | bits[1] << 20 | bits[2] << 40)
    return [len(paragraphs), *sums, *lanes]


def plain_likeness(a, b):
    lanes = lambda v: np.array([x >> 20 * s & (1 << 19) - 1 for x in v[5:] for s in range(3)], float) * 2 - v[0]
    x, y = lanes(a), lanes(b)
    return 1.0 if a == b else min(1.0, max(0.0, 2 * (x @ y) / (x @ x + y @ y))) if x @ x + y @ y else 0.0


def test_vectors_agree_with_plain_python(spark, sf):
    """Fingerprints and likenesses of the query over the whole table."""
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in fp.op9_fingerprints(spark, sf).collect()}
    written = lambda v: "".join(f"{x:016x}" for x in v)
    for k, (i, text) in enumerate(docs):
        n, following = len(text) // 3, docs[(k + 1) % len(docs)][1]
        v, edited, after = plain_vector(text), plain_vector(text[: len(text) - n] + following[:n]), plain_vector(following)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (written(v), written(edited)), i
        assert abs(got[i].near_edited - plain_likeness(v, edited)) < 1e-9 and abs(got[i].near_next - plain_likeness(v, after)) < 1e-9


def test_lines_of_white_space_are_no_paragraphs(spark):
    row = spark.createDataFrame([("a\n   \nb\n\t\n", "a\nb")], "s string, t string").select(fp.vector(F.col("s")).alias("s"), fp.vector(F.col("t")).alias("t")).first()
    assert row.s == row.t and row.s[0] == 2


def test_query(spark, sf):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in fp.op9_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, text) in enumerate(docs):
        n, following = len(text) // 3, docs[(k + 1) % len(docs)]
        edited = text[: len(text) - n] + following[1][:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (got[following[0]].fingerprint == r.fingerprint)
    assert len(set(by_text.values())) == len(by_text)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_sums_do_not_depend_on_order_and_can_be_taken_back(spark):
    paragraphs = [f"paragraph {i} says {i * i}." for i in range(300)]
    a, b = paragraphs[:200], paragraphs[150:]
    df = spark.createDataFrame([("\n".join(a), "\n".join(b), "\n".join(reversed(a)), "\n".join(b + a))], "a string, b string, r string, ab string")
    v = {c: fp.vector(F.col(c)) for c in df.columns}
    row = df.select(
        (v["a"] == v["r"]).alias("order"), (fp.added(v["a"], v["b"]) == v["ab"]).alias("added"), (fp.removed(v["ab"], v["b"]) == v["a"]).alias("removed"),
        (v["a"] == v["b"]).alias("equal"), fp.likeness(v["a"], v["b"]).alias("near"),
    ).first()
    assert (row.order, row.added, row.removed, row.equal) == (True, True, True, False)
    assert abs(row.near - 2 * 50 / 350) < 0.4


def test_many_equal_paragraphs_wrap_around(spark):
    """A lane holds its sum modulo 2^19, and still adds and takes back."""
    v = fp.vector(F.col("t"))
    row = spark.createDataFrame([("a\n" * 530_000,)], "t string").select((fp.removed(fp.added(v, v), v) == v).alias("same")).first()
    assert row.same


def test_defined_cases(spark):
    rows = [(3, None, 0), (2, "ab", 0), (2, "zzz.\nyy", 0), (None, "last one", 0), (1, "", 0), (9, "x" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted((str(r.doc_id), r.edited) for r in fp.edits(df).collect())
    want = [("9", "x" * 66_667 + ""), ("3", ""), ("2", "ab"), ("2", "zzz.\n"), ("1", ""), ("None", "last oxx")]
    assert got == sorted(want)
    assert fp.edits(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert fp.edits(one).first().edited == "abcdab"
