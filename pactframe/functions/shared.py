"""The folder that all executors share, and tables kept in it."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return folder or chosen.get()
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: a step of a loop does not drag the steps before it along, and a lost executor costs a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cut_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """df cut, and how many of its rows meet a condition, observed by the same job. A task that runs twice may count twice, so only zero is exact."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count_if(condition).alias("n")))
    return kept, seen.get["n"]


def sent_if_small(df: DataFrame, bytes_each: int, limit: int = 64 << 20) -> DataFrame:
    """df, already cut, to be broadcast if its measured size stays under limit."""
    return F.broadcast(df) if df.count() * bytes_each <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over a few tasks for each core: a small file is one task, however much work its rows are."""
    return df.repartition(_tasks(df), *keys)


def gathered(parts: list[DataFrame]) -> DataFrame:
    """The rows of tables of a loop's rounds, kept as one table: the rounds' many small partitions are read once."""
    return cut(reduce(DataFrame.unionByName, parts).coalesce(_tasks(parts[0])))


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
