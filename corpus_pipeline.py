"""A corpus from documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of documents; its text and n_chars follow what line dedup removes.

Defined cases: rows without a text fail the quality rules; a null source is a source of its own; a null language is judged by the characters of all
languages; repeated rows and copies leave one row, also where no row of theirs has an id; further columns of documents are carried to the last stage, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactframe.llm import lines, mixing, pieces, quality, simhash
from pactframe.llm.common import fresh, shared_folder

PLACE = ["block", "slot", "place"]

#: Above this share of a source's pages a line is boilerplate (op4_lines has 0.05, as its SQL says).
LINE_RATIO = 0.01
#: Target weights by source; without any a source weighs as the square root of its number of documents.
WEIGHTS: dict | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_boilerplate(docs, max_ratio=LINE_RATIO, copies_once=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    aside = {c: fresh(docs.columns, f"_{c}") for c in mixing.ADDED if c in docs.columns}
    mixed = mixing.mix(docs.withColumnsRenamed(aside), WEIGHTS).drop(*mixing.ADDED)
    return mixed.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of the best segmentation, their number, the scores of the N best, the text read back, and the place in the mix.

    Files read again have no order between them, so block, slot and place carry the mix; the same rows get the same schedule.
    """
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), decoded="decoded")
    scores = F.transform("segmentations", lambda s: s["score"]).alias("scores")
    rows = encoded.select("doc_id", "source", "ids", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), scores, F.col("decoded").alias("text"))
    plan = mixing.schedule(docs, WEIGHTS).select("_source", "_id", *PLACE).hint("shuffle_hash")
    return rows.join(plan, rows["doc_id"].eqNullSafe(plan["_id"]) & rows["source"].eqNullSafe(plan["_source"])).select(*rows.columns, *PLACE)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The bits of SimHash and the best segmentations are not for SQL; tests compare run() with a slow version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
