import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from pactframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(own, text):
    """Every segmentation of the whole text's lattice: (score, ids)."""
    norm = pieces.SPACE + text.replace(" ", pieces.SPACE)
    arcs = own.arcs(norm)

    def into(j):
        if j == 0:
            return [(0.0, ())]
        return [(a + s, ids + label) for i, s, label in arcs[j] for a, ids in into(i)]

    return sorted(into(len(norm)), key=lambda x: -x[0])


def test_n_best_of_small_texts_is_exact():
    own, rng = pieces.model(PATH), random.Random(2)
    bits = ["the", " a", "tion", "\n", "é", " ", "  ", "ing", "日", "x", "▁", "1"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))[:9]
        want = all_segmentations(own, text)
        for n in (1, 2, 5, 12):
            ids, found = own.encode(text, n)
            best = np.frombuffer(ids, "<u4").tolist()
            assert [s for s, _ in found] == [s for s, _ in want[:n]], text
            made = [tuple(pieces.expand(best, swaps)) for _, swaps in found]
            assert len(set(made)) == len(made) and made[0] == tuple(best)
            scores = {}
            for s, i in want:
                scores.setdefault(i, s)
            assert all(scores[i] == s for i, (s, _) in zip(made, found, strict=True))
            assert all(own.decode(i) == text.replace("▁", " ") for i in made)


def test_best_score_agrees_with_the_library():
    """The library reads the same pieces as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own = pieces.model(PATH)
    score = {i: s for i, s in own.pieces.values()}
    for text in ["The quick brown fox.", "Ein schöner Tag, und noch einer", "a  b   c", "tion ing er", "l'été à la plage"]:
        ids, found = own.encode(text, 5)
        assert [s for s, _ in found] == [sum(score[i] for i in x) for x in library.nbest_encode(text, nbest_size=5)]


def test_whole_texts_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pieces.op5_pieces(spark, sf).collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    assert all(len(r.scores) == 4 and list(r.scores) == sorted(r.scores, reverse=True) for r in rows)


def test_defined_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x" * 30_000, 0), (4, "same", 0), (4, "same", 0), (None, "\x00 ▁ \t", 0), (6, "word " * 20_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.decode(pieces.encode(df, n=3)).collect()
    assert sorted((r.decoded for r in got)) == sorted((t or "").replace("▁", " ") for _, t, _ in rows)
    assert [len(r.segmentations) for r in got if not r.text] == [1, 1]
    assert sorted(r.back for r in pieces.encode(df, n=3, decoded="back").collect()) == sorted(r.decoded for r in got)
    assert pieces.decode(pieces.encode(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [1, 3, 20])
def test_a_star_on_random_lattices(n):
    rng = random.Random(n)
    for _ in range(100):
        places = rng.randint(1, 7)
        arcs = [[]] + [[(i, float(rng.randint(-5, 0)), (i, j, k)) for i in range(j) for k in range(2) if i == j - 1 or rng.random() < 0.5] for j in range(1, places + 1)]

        def into(j):
            return [0.0] if j == 0 else [a + s for i, s, _ in arcs[j] for a in into(i)]

        assert [s for s, _ in pieces.n_best(arcs, n)] == sorted(into(places), reverse=True)[:n]


def plain_n_best(own, text, n):
    """The N best scores of the whole text's lattice by keeping the N best at every place, without runs, memory or search."""
    norm = pieces.SPACE + text.replace(" ", pieces.SPACE)
    arcs, best = own.arcs(norm), [[0.0]]
    for j in range(1, len(norm) + 1):
        best.append(sorted((a + s for i, s, _ in arcs[j] for a in best[i]), reverse=True)[:n])
    return best[-1]


def test_query_against_plain_n_best(spark, sf):
    """Scores, ids and digests of the query, on all documents of up to six hundred characters and on the shortest others."""
    own = pieces.model(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    some = sorted(texts, key=lambda i: len(texts[i]))
    some = [i for i in some if 0 < len(texts[i]) <= 600] or some[:40]
    score = {i: s for i, s in own.pieces.values()}
    rows = {r.doc_id: r for r in pieces.op5_pieces(spark, sf).collect()}
    for i in some:
        want = plain_n_best(own, texts[i], 4)
        assert np.allclose(list(rows[i].scores), want, rtol=1e-12, atol=1e-9), i
        ids, found = own.encode(texts[i], 4)
        assert rows[i].n_pieces == len(ids) // 4 and rows[i].ids_crc32 == zlib.crc32(ids)
        assert own.decode(np.frombuffer(ids, "<u4").tolist()) == texts[i].replace("\u2581", " ")
        made = [pieces.expand(np.frombuffer(ids, "<u4").tolist(), swaps) for _, swaps in found]
        assert all(own.decode(m) == texts[i].replace("\u2581", " ") for m in made)
        assert all(abs(sum(score.get(x, 0.0) for x in m) - s) < 1e-6 for m, s in zip(made, want, strict=True) if all(x in score for x in m))
