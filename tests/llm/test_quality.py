import math
import re
from collections import Counter

from pyspark.sql import functions as F

from pactframe.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    places = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(places)


def js(p, q_):
    m = [(a + b) / 2 for a, b in zip(p, q_)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a > 0)
    return math.sqrt(max(0, (kl(p) + kl(q_)) / 2))


def test_measures_and_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in q.score(docs).collect()}
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    rules = q.QualityRules()
    plain = lambda t: re.findall(r"[A-Za-z\x80-\U0010FFFF]+", t or "")
    fold = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    common, chars = {}, {}
    for i, (t, lang) in texts.items():
        n = len(WORD.findall(t or ""))
        if n >= rules.min_words:
            cells = [re.findall(x, t) for x in ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[#*$%&|<>]", r"[^\x80-\U0010FFFFa-zA-Z0-9\x20\x09-\x0D#*$%&|<>]", r"[\x80-\U0010FFFF]")]
            chars[i] = [len(c) for c in cells]
            assert sum(chars[i]) == len(t)
        if n >= rules.min_words_common and plain(t):
            c = Counter(map(fold, plain(t)))
            row = [c[w] for w in q.COMMON_WORDS[lang]]
            common[i] = [*row, len(plain(t)) - sum(row)]

    def shares(rows):
        total = [sum(x) for x in zip(*rows)]
        return [x / sum(total) for x in total]

    passes = {i for i, (t, _) in texts.items() for n, *_, repeat in [measures(t)] if n >= 50 and 100 * repeat <= 50 * n}  # junk is no reference
    refs = {lang: [shares([c for i, c in of.items() if texts[i][1] == lang and i in passes]) for of in (chars, common)] for lang in q.COMMON_WORDS}
    near = lambda found, counts, ref: abs(found - js([x / sum(counts) for x in counts], ref)) < 1e-9
    for i, (t, lang) in texts.items():
        r = got[i]
        n, *rest = measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert near(r.char_distance, chars[i], refs[lang][0]) if i in chars else r.char_distance is None
        assert near(r.word_distance, common[i], refs[lang][1]) if i in common else r.word_distance is None
        assert r.kept == (not r.base_failed and not (r.char_distance or 0) > 0.23 and not (r.word_distance or 0) > 0.23)


def test_unlisted_languages_are_held_against_all(spark):
    prose, menu = "Plain words, of a text. " * 30, "Home | About | 12 | >> | " * 40
    rows = [(i, prose + f"number {i}", "en") for i in range(20)] + [(30, "so " + prose, None), (31, menu, None), (32, menu, "xx"), (33, "one two three four " * 5 + prose, "xx")]
    got = {r.doc_id: r for r in q.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), q.QualityRules(max_repeat_percent=100)).collect()}
    assert [got[i].kept for i in (0, 30, 31, 32, 33)] == [True, True, False, False, True] and got[31].word_distance is None


def test_common_words_in_any_case_and_beside_punctuation(spark):
    df = spark.createDataFrame([("The cat; the-end. \"THE\" (the) other",)], "t string")
    assert df.select(q._plain_words(F.col("t")).alias("w")).first().w == ["the", "cat", "the", "end", "the", "the", "other"]


def test_defined_cases(spark, monkeypatch):
    repeated = "a b c a b c x y z " * 30
    long = " ".join(f"w{i % 700}x{i}" for i in range(5000)) + " one two three four one two three"
    rows = [(1, None, "en", 0), (2, "", None, 0), (3, repeated, "en", 0), (3, repeated, "en", 0), (4, long, "xx", 0), (None, "🙂" * 60, None, 0), (5, "line\n\n line\nline\n" * 3, "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    for bits in (20, 10):  # with ten bits most texts take the slower path
        monkeypatch.setattr(q, "POSITION_BITS", bits)
        got = q.score(df)
        assert got.columns.count("n_words") == 1
        found = sorted(((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()))
        assert found == sorted((i or 0, *measures(t)) for i, t, _, _ in rows)
    kept = q.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [4]
    assert q.score(df.limit(0)).count() == 0
