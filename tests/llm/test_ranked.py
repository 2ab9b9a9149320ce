import math
import re
from collections import Counter

import pytest

from pactframe.llm import ranked as r

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def listed(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, top=50):
    """Rows (item, rank, doc_id, score), every document scored for every item."""
    counts = [(k, Counter(listed(t))) for k, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for k, c in counts:
            m = 100 - 50 + (50 * c.total() * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(listed(text)) if c[t])
            if s > 0:
                scores.append((-s, k is None, k or 0))
        out += [(item, i + 1, None if none else k, -s) for i, (s, none, k) in enumerate(sorted(scores)[:top])]
    return Counter(out)


def found(df):
    return Counter((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in df.collect())


def rows(spark, sf, name, *columns):
    return [tuple(x) for x in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def test_query_against_all_pairs(spark, sf):
    want = slow(rows(spark, sf, "documents", "doc_id", "text"), rows(spark, sf, "benchmark", "item_id", "text"))
    assert found(r.op13_ranked_search(spark, sf)) == want


@pytest.mark.parametrize("first,growth,small", [(4, 4, True), (8, 4, False)])
def test_lower_tiers_and_joined_vocabularies(spark, sf, first, growth, small, monkeypatch):
    """Tiers so small that items are proven at different tiers; a vocabulary beyond its bound is joined."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    if not small:
        monkeypatch.setattr(r, "MOST_TERMS", 0)
        monkeypatch.setattr(r, "small_enough", lambda df, each: False)
    index = r.build(docs, r.vocabulary(items), first=first, growth=growth)
    got = r.cut(r.search(index, items, top=7))
    index.drop()
    assert found(got) == slow(rows(spark, sf, "documents", "doc_id", "text"), rows(spark, sf, "benchmark", "item_id", "text"), 7)
    assert len({x["tier"] for x in got.collect()}) > 1


def test_an_index_of_all_terms(spark):
    docs = [(i, " ".join(f"w{j}" for j in range(i % 17)) + " Common") for i in range(300)]
    items = [(1, "w3 w9"), (2, "COMMON"), (3, "absent")]
    index = r.build(spark.createDataFrame(docs, "doc_id bigint, text string"), first=4, growth=2)
    assert found(r.search(index, spark.createDataFrame(items, "item_id bigint, text string"), top=5)) == slow(docs, items, 5)
    assert index.read("terms").count() == 17
    index.drop()


def test_cases(spark):
    """Nulls, empty and very long texts, ties, repeated rows and items, clashing columns."""
    docs = [(1, None), (2, ""), (3, "-- !"), (4, "Straße Æ a"), (4, "Straße Æ a"), (None, "straße a"), (None, "b"), (5, "a " * 50000 + "rare"), *[(10 + i, "a b") for i in range(60)]]
    items = [(1, "STRAßE a"), (1, "STRAßE a"), (2, None), (3, "!"), (None, "rare æ"), (5, "b a b")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS d", "2 AS n", "'x' AS terms", "3 AS term", "4 AS t")
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS q", "'x' AS term", "2 AS rank", "5 AS score")
    for first in (1024, 2):
        index = r.build(df, first=first, growth=2)
        assert found(r.search(index, asked)) == slow(docs, items)
        index.drop()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    index = r.build(none)
    assert r.search(index, asked).count() == 0
    full = r.build(spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id bigint, text string"))
    assert r.search(full, asked.limit(0)).count() == 0
    assert found(r.search(full, asked)) == slow([(1, "a b"), (2, "a")], [(1, "a")])
