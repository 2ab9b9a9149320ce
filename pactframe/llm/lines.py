"""Operator 4, line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the number
of the host's pages; lines above `max_ratio` are boilerplate of that host and leave its pages. Lines are
compared without white space at their ends, by 64-bit hash.

Scale: page counts are combined before they are shuffled, so a host with a third of all pages is no single
task's work. A host with p pages of l lines on average has at most l / max_ratio boilerplate lines, so its
list is bounded whatever p is. The lists of all hosts are broadcast if they are measured to be small, and
joined by host otherwise (the adaptive planner splits a hot host).

Defined cases: a null or empty text counts as a page without lines and comes back as it was; null hosts form
one host; blank lines are neither counted nor dropped; a line repeated within a page counts once, and each
occurrence goes; each repeated row counts as a page (unless `copies_once`); lines on fewer than `min_pages` pages stay, so that
small hosts keep theirs; an empty table gives an empty result. Columns named like added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table, with_columns_dropped

SPACE = " \t\n\x0b\x0c\r"
BROADCAST_BYTES = 64 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE)))


def _is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) == ""


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float, min_pages: int, copies_once: bool = False) -> DataFrame:
    """Rows (host, keys): the hashes of the host's boilerplate lines."""
    seen = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: ~_is_blank(x)), _key))
    listed = pages.select(host.alias("host"), seen.alias("seen"))
    if copies_once:
        listed = listed.distinct()
    counts = listed.select("host", F.explode("seen").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    totals = listed.select(F.col("host").alias("h")).groupBy("h").agg(F.count("*").alias("pages"))
    frequent = counts.filter(F.col("n") >= min_pages).join(totals, F.col("host").eqNullSafe(F.col("h")))
    return frequent.filter(F.col("n") > max_ratio * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(pages: DataFrame, host: str | Column = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 3, copies_once: bool = False) -> DataFrame:
    """pages with `text` less its host's boilerplate lines, and with the columns n_lines and n_removed (long).

    With `copies_once`, a host's pages of the same lines in the same order count as one page, so that copies do
    not make each other's lines boilerplate.
    """
    host = F.col(host) if isinstance(host, str) else host
    of_host, keys, listed, left = (fresh(pages.columns, n) for n in ("_host", "_keys", "_lines", "_stays"))
    found = cut(boilerplate(pages, host, F.col(text), max_ratio, min_pages, copies_once)).select(F.col("host").alias(of_host), F.col("keys").alias(keys))
    size = found.agg(F.sum(8 * F.size(keys) + 64)).first()[0] or 0
    own = with_columns_dropped(pages, "n_lines", "n_removed")
    joined = pages.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, host.eqNullSafe(F.col(of_host)), "left")
    joined = joined.withColumn(listed, _lines(F.col(text)))
    stays = F.filter(listed, lambda x: _is_blank(x) | ~F.array_contains(keys, _key(x)))
    joined = joined.withColumn(left, F.when(F.col(keys).isNull(), F.col(listed)).otherwise(stays))
    n = F.coalesce(F.size(listed).cast("bigint"), F.lit(0).cast("bigint"))
    n = F.when(F.col(text).isNull(), F.lit(0).cast("bigint")).otherwise(n)
    kept = F.when(F.col(text).isNotNull(), F.array_join(left, "\n")).alias(text)
    removed = F.when(F.col(text).isNull(), F.lit(0).cast("bigint")).otherwise((F.size(listed) - F.size(left)).cast("bigint"))
    return joined.select(*[kept if c == text else F.col(c) for c in own.columns], n.alias("n_lines"), removed.alias("n_removed"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(pages).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op4_lines": op4_lines}
ORACLE_SQL = {
    "op4_lines": """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM l),
c AS (SELECT source, k, count(DISTINCT doc_id) AS n FROM k WHERE k <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT c.source, k FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n > 0.05::DOUBLE * pages),
m AS (SELECT k.*, b.k IS NOT NULL AS gone FROM k LEFT JOIN b ON b.k = k.k AND b.source IS NOT DISTINCT FROM k.source),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""
}
