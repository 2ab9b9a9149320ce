"""What the training-data operators share: words, shared folders and Arrow helpers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the ASCII controls tab to carriage return.
GAP = r"[\x20\x09-\x0D]"
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of characters other than white space; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP + "+"), "")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included; one hash of the whole sequence where words are few, none without words."""
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - width + 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return folder or chosen.get()
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table of this run's own in the shared folder once nothing will read it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs a read and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_columns_dropped(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator adds under the same names."""
    return df.drop(*[c for c in df.columns if c in names])


def fresh(columns: list[str], name: str) -> str:
    """name, or one like it that is none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def restored(df: DataFrame, columns: list[str], *more: str | Column) -> DataFrame:
    """The caller's columns from the struct `_row` that carried them, so that no name of theirs meets one used on the way, and more."""
    return df.select(*[F.col(f"_row.`{c}`") for c in columns], *more)


def arrow_rows(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def small_enough(df: DataFrame, bytes_each: int, limit: int = 64 << 20) -> bool:
    """Whether df, already cut, has so few rows that a broadcast copy stays under limit."""
    return df.count() * bytes_each <= limit
