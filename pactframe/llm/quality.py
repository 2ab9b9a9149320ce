"""Operator 2, quality rules: divergence of character classes and common words from language references.

Every step is a DataFrame expression; no Python runs on the executors. A document's two histograms are

* its characters by class (lower-case, capital, digit, white space, symbols, other ASCII, beyond ASCII), and
* its words by a short list of common words of its language, with one more bin for all other words; for this, A-Z are
  read as a-z and words end at all of ASCII that is no letter, so "The" and "the," are the word "the".

The references are the same histograms summed over all documents of the language that pass the base rule (junk that
repeats itself is no reference) and are long enough to judge; documents whose language is null or has no list are held against the characters of all languages together. A
document is rejected when the Jensen-Shannon distance (the square root of the divergence to base 2,
from 0 to 1) of either histogram from its reference exceeds a limit. Shorter documents have no distance.

Defined cases: a null or empty text has no words and fails the base rule; a language that is null or has no
list has no distance of words; a text without letters has none either; repeated rows are judged alike; an empty table gives
an empty result. Columns of the input named like an added column are replaced.
"""

from __future__ import annotations

import string
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, cut, restored, shared_folder, table, with_columns_dropped, words

# Common function words by language.
COMMON_WORDS = {
    "de": ["der", "die", "das", "und", "zu", "in", "den", "von", "ist", "mit", "ein", "nicht", "auf", "für", "dem", "sich"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "as", "be", "by", "at", "this"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "su"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}

# The characters that count as symbols; ASCII other than letters, where words of the histograms end.
SYMBOLS = "#*$%&|<>"
NO_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CLASSES = 7
#: The key of the reference of all languages together.
ANY = ""

#: Positions of words fit into so many bits of a packed window hash; longer texts take a slower path.
POSITION_BITS = 20


@dataclass(frozen=True)
class QualityRules:
    """min_words guards the base rule and the distance of characters, min_words_common that of common words. The limits are the 99.9th percentiles of the distances of documents labelled 1 (sf0.1), rounded up."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_char_distance: float = 0.23
    max_word_distance: float = 0.23
    min_words_common: int = 100
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _char_classes(text: Column, word_chars: Column) -> list[Column]:
    lower, capital, digit, symbol = (_without(text, f"[^{c}]+") for c in ("a-z", "A-Z", "0-9", SYMBOLS))
    beyond = _without(text, r"[\x00-\x7F]+")
    other = word_chars - lower - capital - digit - symbol - beyond
    return [lower, capital, digit, F.length(text) - word_chars, symbol, other, beyond]


def _plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), NO_LETTERS), "")


def _common_counts(tokens: Column, lang: Column, lists: dict) -> Column:
    """An array of counts, in the order of the language's list, and the count of all other words; null without a list."""
    def counts(listed: list[str]) -> Column:
        def binned(hits: Column) -> Column:
            bins = [F.size(hits) - F.size(F.array_remove(hits, F.lit(w))) for w in listed]
            return F.array(*bins, F.size(tokens) - F.size(hits)).cast("array<bigint>")
        return F.transform(F.array(F.filter(tokens, lambda w: w.isin(listed))), binned)[0]

    return reduce(lambda c, item: c.when(lang == item[0], counts(item[1])), lists.items(), F.when(F.lit(False), F.lit(None).cast("array<bigint>")))


def _histograms(df: DataFrame, text: str, lang: str, rules: QualityRules) -> DataFrame:
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", words(F.col("_text"))).withColumn("_word_chars", _without(F.col("_text"), GAP + "+"))
    df = df.withColumn("_n_words", F.size("_words"))
    long_enough = F.col("_n_words") >= rules.min_words
    df = df.withColumn("_chars", F.when(long_enough, F.array(*_char_classes(F.col("_text"), F.col("_word_chars"))).cast("array<bigint>")))
    counted = F.transform(F.array(_plain_words(F.col("_text"))), lambda w: F.when(F.size(w) > 0, _common_counts(w, F.col(lang), rules.common_words)))[0]
    return df.withColumn("_common", F.when(F.col("_n_words") >= rules.min_words_common, counted))


def _listed(lang: Column, rules: QualityRules) -> Column:
    return F.when(lang.isin(list(rules.common_words)), lang).otherwise(ANY)


def language_references(measured: DataFrame, rules: QualityRules = QualityRules(), lang: str = "lang") -> DataFrame:
    """One row per listed language and one for all together: lang, ref_chars and ref_common, histograms as shares, of those of `measure`'s rows that pass the base rule. At most one row more than lists."""
    bins = max(map(len, rules.common_words.values())) + 1
    zero = F.lit(0).cast("bigint")
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)])
    share = lambda c: F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: x / F.aggregate(c, zero, lambda a, y: a + F.coalesce(y, zero)))
    each = measured.filter("NOT base_failed").groupBy(_listed(F.col(lang), rules).alias("lang")).agg(sums("_chars", CLASSES).alias("c"), sums("_common", bins).alias("w"))
    totals = each.filter(F.col("lang") != ANY).unionByName(each.agg(F.lit(ANY).alias("lang"), sums("c", CLASSES).alias("c"), F.lit(None).cast("array<bigint>").alias("w")))
    return totals.filter(F.get("c", F.lit(0)).isNotNull()).select("lang", share(F.col("c")).alias("ref_chars"), share(F.col("w")).alias("ref_common"))


def js_distance(counts: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance of an array of counts from an array of shares of the same length."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.transform(F.array(total), lambda t: F.zip_with(counts, reference, lambda x, q: part(x / t, (x / t + q) / 2) + part(q, (x / t + q) / 2)))[0]
    return F.when(counts.isNotNull() & reference.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)))


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds _n_repeat: words within three-word windows that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hash. Most are told apart by sorting longs that pack a hash prefix and the
    position; only windows that share a prefix with another are compared in full.
    """
    mask = (1 << POSITION_BITS) - 1
    hashed = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    places = F.when(F.col("_n_words") >= 3, F.sequence(F.lit(0), F.col("_n_words") - 3)).otherwise(F.array().cast("array<int>"))
    packs = F.col("_n_words") <= mask
    df = df.withColumn("_packed", F.sort_array(F.when(packs, F.transform(places, lambda i: hashed(i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))))))
    near = lambda x, k: F.coalesce(x.bitwiseXOR(F.get("_packed", k)).between(0, mask), F.lit(False))
    alike = F.transform(F.filter("_packed", lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))
    df = df.withColumn("_alike", F.when(packs, alike).otherwise(places))
    df = df.withColumn("_full", F.sort_array(F.transform("_alike", lambda i: F.struct(hashed(i).alias("h"), i.alias("i")))))
    same = lambda x, k: F.coalesce(x["h"] == F.get("_full", k)["h"], F.lit(False))
    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter("_full", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    gained = F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get("_starts", k - 1), F.lit(3))))
    return df.withColumn("_n_repeat", F.aggregate(gained, F.lit(0), lambda a, x: a + x)).drop("_packed", "_alike", "_full", "_starts")


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def measure(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the counts of the base rule, base_failed, and the histograms _chars and _common."""
    own = with_columns_dropped(docs, *[c for c in ADDED if c not in (text, lang)])
    df = _repeated_words(_histograms(own, text, lang, rules))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.regexp_replace(x, GAP + "+", "")) > 0)
    df = df.withColumn("n_words", F.col("_n_words").cast("bigint")).withColumn("word_chars", F.col("_word_chars").cast("bigint"))
    df = df.withColumn("n_symbols", _without(F.col("_text"), f"[^{SYMBOLS}]+").cast("bigint"))
    df = df.withColumn("n_dup_lines", F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("bigint"))
    df = df.withColumn("n_repeat_words", F.col("_n_repeat").cast("bigint"))
    df = df.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    return df.select(*own.columns, *ADDED[:6], "_chars", "_common")


def judge(measured: DataFrame, references: DataFrame, rules: QualityRules = QualityRules(), lang: str = "lang") -> DataFrame:
    """measured with the distances and the verdict. references (one row per listed language, so bounded) is broadcast."""
    refs = references.select(F.col("lang").alias("_ref_lang"), F.col("ref_chars").alias("_ref_chars"), F.col("ref_common").alias("_ref_common"))
    df = measured.join(F.broadcast(refs), _listed(F.col(lang), rules) == F.col("_ref_lang"), "left")
    df = df.withColumn("char_distance", js_distance(F.col("_chars"), F.col("_ref_chars"))).withColumn("word_distance", js_distance(F.col("_common"), F.col("_ref_common")))
    diverges = (F.col("char_distance") > rules.max_char_distance) | (F.col("word_distance") > rules.max_word_distance)
    df = df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(diverges, F.lit(False)))
    return df.select(*[c for c in measured.columns if c not in ("_chars", "_common")], *ADDED[6:])


def score(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the columns ADDED. Rows and counts are written once to the shared folder, as a table; references and verdicts are read from it."""
    path = f"{shared_folder(docs.sparkSession)}/measured-{uuid.uuid4().hex}"
    own = with_columns_dropped(docs, *[c for c in ADDED if c not in (text, lang)])
    rows = docs.select(F.struct(*own.columns).alias("_row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    measured = measure(rows, rules).drop("text")
    measured.write.option("compression", "zstd").parquet(path)
    kept = docs.sparkSession.read.schema(measured.schema).parquet(path)
    return restored(judge(kept, cut(language_references(kept, rules)), rules), own.columns, *ADDED)


def verdicts(docs: DataFrame, rules: QualityRules = QualityRules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id and the columns ADDED of each row: texts are read once, and the counts kept in the shared folder."""
    counts = cut(measure(docs.select(doc_id, text, lang), rules, text, lang).drop(text))
    return judge(counts, language_references(counts, rules, lang), rules, lang)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with the columns they had."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    measured = measure(rows, rules).drop("text")
    path = f"{shared_folder(docs.sparkSession)}/measured-{uuid.uuid4().hex}"
    measured.write.option("compression", "zstd").parquet(path)
    kept = docs.sparkSession.read.schema(measured.schema).parquet(path)
    return judge(kept, cut(language_references(kept, rules)), rules).filter("kept").select("_row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", *[c for c in ADDED if not c.endswith("distance")])


def op2_sql(rules: QualityRules = QualityRules()) -> str:
    """The same result in DuckDB's SQL."""
    listed = " UNION ALL ".join(f"SELECT '{lang}' AS lang, {i} AS i, '{w}' AS w" for lang, ws in rules.common_words.items() for i, w in enumerate(ws))
    only = lambda c: f"length(regexp_replace(t, '[^{c}]+', '', 'g'))"
    return f"""
WITH listed AS ({listed}),
d AS (SELECT doc_id, CASE WHEN lang IN (SELECT lang FROM listed) THEN lang ELSE '' END AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT *, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  {only('#*$%&|<>')} AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM d),
g AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM m),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM
  (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g), LATERAL (SELECT unnest([i, i + 1, i + 2]) AS p) WHERE n > 1 GROUP BY doc_id),
b AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) - len(list_distinct(l)) AS n_dup_lines FROM m LEFT JOIN r USING (doc_id)),
h AS (SELECT doc_id, lang, unnest([0, 1, 2, 3, 4, 5, 6]) AS i,
  unnest([{only('a-z')}, {only('A-Z')}, {only('0-9')}, length(t) - word_chars, {only(SYMBOLS)},
    word_chars - {only('a-z')} - {only('A-Z')} - {only('0-9')} - {only(SYMBOLS)} - length(regexp_replace(t, '[\\x00-\\x7F]+', '', 'g')),
    length(regexp_replace(t, '[\\x00-\\x7F]+', '', 'g'))]) AS n, 'c' AS kind FROM b WHERE n_words >= {rules.min_words}),
plain AS (SELECT doc_id, lang, list_filter(string_split_regex(translate(t, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{NO_LETTERS}'), lambda x: x <> '') AS w FROM b WHERE n_words >= {rules.min_words_common}),
long AS (SELECT doc_id, lang, w, len(w) AS n FROM plain WHERE len(w) > 0),
hits AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM long) GROUP BY ALL),
common AS (SELECT long.doc_id, long.lang, listed.i, coalesce(hits.n, 0) AS n FROM long JOIN listed ON long.lang = listed.lang
  LEFT JOIN hits ON hits.doc_id = long.doc_id AND hits.w = listed.w),
k AS (SELECT * FROM h UNION ALL SELECT doc_id, lang, i, n, 'w' FROM common
  UNION ALL SELECT long.doc_id, long.lang, -1, any_value(long.n) - sum(c.n), 'w' FROM long JOIN common c USING (doc_id) GROUP BY ALL),
good AS (SELECT k.* FROM k JOIN b USING (doc_id) WHERE NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)),
sums AS (SELECT lang, kind, i, sum(n) AS n FROM good WHERE lang <> '' GROUP BY ALL UNION ALL SELECT '', kind, i, sum(n) FROM good WHERE kind = 'c' GROUP BY ALL),
ref AS (SELECT lang, kind, i, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM sums),
p AS (SELECT doc_id, lang, kind, i, n / sum(n) OVER (PARTITION BY doc_id, kind) AS p FROM k),
js AS (SELECT doc_id, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js
  FROM p JOIN ref USING (lang, kind, i) GROUP BY doc_id, kind),
bad AS (SELECT DISTINCT doc_id FROM js WHERE js > CASE kind WHEN 'c' THEN {rules.max_char_distance} ELSE {rules.max_word_distance} END)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM b)
"""


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL = {"op2_quality": op2_sql()}
