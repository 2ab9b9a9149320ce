import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pactframe.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def library(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_the_library():
    rng = random.Random(3)
    bits = ["word", "Ünï", " ", "  ", "\n", "\t", "'s", "'ll", "12", "!", "<|endoftext|>", "\x1c", "\x85", "\xa0", " ", "　", "日本", "​", "😀", "é", "\r\n", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["x" * 5000]
    own = list(tf.encoder(PATH).encode(texts))
    tokenizer = Tokenizer.from_file(PATH)
    for text, got in zip(texts, own, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_new_runs_go_to_the_library_without_marks_between_them(monkeypatch):
    own, asked = tf.Encoder(PATH), []
    library_of = own._library
    monkeypatch.setattr(own, "_library", lambda texts: asked.extend(texts) or library_of(texts))
    texts = [" one two&&& two*** &&& é two.' x", " 日本 two&&&! \x1c Ünï one_1 a'ss a!'s"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library(t) for t in texts]
    spaced = [a for a in asked if own.parting[0] not in a]
    assert sum(a.count(" two") for a in spaced) == 2  # " two" and " two.'"
    assert list(own.encode(texts)) == list(own.encode(texts)) and len(asked) == 2


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert tf.from_planes(tf.to_planes(ids, kind), n, kind).tolist() == ids.tolist()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_round_trip(spark, tmp_path, kind):
    rows = [(5, "five words are in here", 1), (2, None, 1), (9, "long " * 300, 1), (1, "", 1), (None, "no id", 1), (7, "tie", 1), (7, "tie", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    tf.write(docs, str(tmp_path / "t"), block_ids=16, kind=kind)
    got = sorted(tf.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, text, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        want = library(text) + [0]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (i, at, len(want), want)
        at += len(want)
    tf.write(docs.limit(0), str(tmp_path / "e"))
    assert tf.read(spark, str(tmp_path / "e")).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in tf.op6_token_files(spark, sf).collect()}
    at = 0
    for d in docs:
        ids = np.array(library(d.text) + [0], "<u4")
        r = got.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got
