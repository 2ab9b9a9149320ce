"""Columns of the caller that are named like those the operators use on their way stay as they are."""

import pytest
from pyspark.sql import functions as F

from pactframe.llm import lines, mixing, quality, simhash, substrings, token_counts

INNER = ["_row", "_id", "_source", "_text", "_words", "_n_words", "_chars", "_common", "_ref_lang", "_lines", "_stays", "_keys", "_host", "_d", "_t", "_spans", "_at", "_fp", "_edits", "_rank", "_part", "root", "fp", "u", "v", "n", "t", "key", "seen"]
RUNS = {
    "lines": lambda df: lines.drop_boilerplate(df), "quality": lambda df: quality.score(df), "good": lambda df: quality.keep_good(df, quality.QualityRules(min_words=1)), "mixing": lambda df: mixing.mix(df), "removals": lambda df: substrings.removals(df),
    "unique": lambda df: substrings.keep_unique(df), "one": lambda df: simhash.keep_one(df), "counts": lambda df: token_counts.count_edited(df.withColumn("edits", token_counts.sample_edits())),
}


@pytest.mark.parametrize("name", RUNS)
def test_inner_names_are_free(spark, name):
    words = ["alpha", "beta", "gamma", "delta", "and", "the"]
    plain = spark.createDataFrame([(i, " ".join(words[(i * k) % 6] + str(i * k % 97) for k in range(60)), "en", f"s{i % 2}") for i in range(12)], "doc_id long, text string, lang string, source string")
    marked = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INNER})
    want = {r.doc_id: r.asDict() for r in RUNS[name](plain).collect()}
    got = RUNS[name](marked)
    rows = got.collect()
    assert len(rows) == len(want) > 0
    for r in rows:
        assert all(r[c] == f"{c}{r.doc_id}" for c in INNER)
        assert {c: r[c] for c in want[r.doc_id]} == want[r.doc_id]
