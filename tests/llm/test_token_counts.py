import random

import public_tokenizers
import regex

from pactframe.llm import token_counts as tc


def brute(text):
    count, pattern = tc._counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    pieces = pattern.findall(text)
    return sum(map(count, pieces)), len(pieces)


def test_edits_keep_counts_exact():
    count, pattern = tc._counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "'ll", "l", "1", "23", "é", "日", "!", "?!", "\t", "'v", "e"]
    for trial in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60, 400])))
        tree = tc.CountTree(text, count, pattern, width=rng.choice([1, 3, 8]))
        for _ in range(6):
            start, removed = rng.randint(-2, len(text) + 3), rng.choice([0, 1, 2, 5, 50])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 40])))
            tree.edit(start, removed, new)
            a = min(max(start, 0), len(text))
            text = text[:a] + new + text[min(a + removed, len(text)) :]
            assert tree.text() == text
            assert (tree.n_tokens, tree.n_pretokens, tree.n_chars) == (*brute(text), len(text)), (trial, text)
        at = rng.randint(0, len(text))
        ends = [m.end() for m in regex.finditer(public_tokenizers.PATTERN, text)]
        cut = max([e for e in ends if e <= at], default=0)
        assert tree.tokens_before(at) == brute(text[:cut])[0] or cut != at


def test_only_the_touched_region_is_encoded_again():
    count, pattern = tc._counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tree = tc.CountTree("word " * 20_000, count, pattern)
    tree.edit(50_000, 4, "other")
    assert tree.reencoded < 10


def test_query_agrees_with_full_encoding(spark):
    rows = [(1, "It's a text, and it'll change.\nTwice  over.", [(3, 2, "XX"), (0, 0, "\n ")]), (2, None, [(0, 5, "new")]), (3, "", None), (4, "same", []), (4, "same", []), (5, "x" * 50_000, [(25_000, 1, " ")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,removed:long,inserted:string>>")
    got = {r.doc_id: r for r in tc.count_edited(df).collect()}
    for i, text, edits in rows:
        text = text or ""
        assert got[i].n_tokens == brute(text)[0]
        for a, n, new in edits or []:
            text = text[:a] + new + text[a + n :]
        assert (got[i].n_tokens_edited, got[i].n_pretokens_edited) == brute(text)
    assert tc.count_edited(df.limit(0)).count() == 0
    table = spark.createDataFrame([(1, 2, 0, 0, "b"), (1, 1, 3, 2, "a")], "doc_id long, seq int, start long, removed long, inserted string")
    assert [tuple(e) for e in tc.edits_by_document(table).first().edits] == [(3, 2, "a"), (0, 0, "b")]


def test_query_over_all_documents(spark, sf):
    """The query's counts against the whole edited texts, encoded anew."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = tc.op1_edit_counts(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id]
        n, edited = len(text), text
        whole = max(n - 30, 1)
        moves = [(n // 3, 0, text[max(n // 2 - 1, 0) :][:40]), (0, 7, ""), (2 * n // 3, 20, " " + text[whole - 1 :][:30])]
        for start, removed, new in moves:
            at = min(start, len(edited))
            edited = edited[:at] + new + edited[at + removed :]
        assert (r.n_tokens, r.n_pretokens) == brute(text), r.doc_id
        assert (r.n_tokens_edited, r.n_pretokens_edited) == brute(edited), r.doc_id
