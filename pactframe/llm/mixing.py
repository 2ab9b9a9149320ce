"""Operator 7, mixing sources to target weights by Pfair scheduling.

A source's documents, in id order, form blocks of `block_docs`. Weights are whole parts. While the active
sources have M parts in all, the j-th block (from 0) of a source with m parts is released at slot
floor(j M / m) and due at ceil((j + 1) M / m); each slot goes to the released block due first, ties by the
order of sources. At every slot each source has then had its share to within less than one block.

That schedule repeats after M slots, so it is simulated for one period at most, or until a source runs out, whichever comes
first; every block's slot follows from its number by arithmetic in the executors. When a source runs out, the others go on
with the weights they have among themselves. Given weights are taken as exact fractions, however small; weights that are
square roots are rounded to whole parts fine enough for the least of them to have one. What the driver walks through is never more
than one slot for each block, and one period for each source that ends: for few sources a few thousand slots, whatever the number of documents.

With `max_sources` the smallest sources beyond it share one stream of blocks with their weights
summed; in it each source's documents, in id order, are spread evenly over the whole. Ranks within a source come from ranges and partition totals: a source with a third of
all rows is spread over many tasks.

Defined cases: a null source is a source of its own; null ids come first in their source; rows that repeat a
source and id share one place; sources without a given weight get one part; an empty table gives an empty
result; every row gets a slot, none is dropped or repeated. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, restored, small_enough, table, with_columns_dropped

ADDED = ["block", "slot", "release", "deadline", "place"]


def parts(weights: Sequence[float], resolution: int) -> list[int]:
    """Whole parts, one at least each, in proportion to weights by largest remainders."""
    total = sum(weights)
    exact = [w / total * resolution for w in weights]
    whole = [max(1, int(x)) for x in exact]
    order = sorted(range(len(whole)), key=lambda i: (int(exact[i]) - exact[i], i))
    for i in order[: max(0, resolution - sum(whole))]:
        whole[i] += 1
    return whole


def exact_parts(weights: Sequence[Fraction]) -> list[int]:
    """The least whole numbers in the same proportion."""
    scale = math.lcm(*(w.denominator for w in weights))
    whole = [int(w * scale) for w in weights]
    return [w // math.gcd(*whole) for w in whole]


def walk(shares: Sequence[int], limits: Sequence[int] | None = None) -> tuple[list[list[int]], int | None]:
    """For each source the slots that earliest deadline first gives it, within one period of sum(shares) slots or until a source has its limit of blocks, and the slot at which that was."""
    total = sum(shares)
    slots: list[list[int]] = [[] for _ in shares]
    ready = [(-(-total // m), i) for i, m in enumerate(shares)]
    heapq.heapify(ready)
    waiting: list[tuple[int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * total // shares[i]), i))
        _, i = heapq.heappop(ready)
        slots[i].append(t)
        if limits is not None and len(slots[i]) == limits[i]:
            return slots, t
        if len(slots[i]) < shares[i]:
            heapq.heappush(waiting, (len(slots[i]) * total // shares[i], i))
    return slots, None


def period(shares: Sequence[int]) -> list[list[int]]:
    """For each source the slots, within one period of sum(shares) slots, that earliest deadline first gives it."""
    return walk(shares)[0]


def phases(shares: Sequence[int], blocks: Sequence[int]) -> list[dict]:
    """Rows (source, lo, hi, start, m, total, slots): blocks lo to hi of a source run in a phase from slot start on."""
    left, done, start, found = list(blocks), [0] * len(blocks), 0, []
    while active := [i for i, n in enumerate(left) if n]:
        m = [shares[i] for i in active]
        common = math.gcd(*m)
        m = [x // common for x in m]
        total = sum(m)
        slots, stopped = walk(m, [left[i] for i in active])
        if stopped is None:
            end = min((left[i] - 1) // s * total + at[(left[i] - 1) % s] for i, s, at in zip(active, m, slots, strict=True)) + 1
        else:
            end = stopped + 1
        for i, s, at in zip(active, m, slots, strict=True):
            ran = len(at) if stopped is not None else end // total * s + sum(x < end % total for x in at)
            if ran:
                found.append({"source": i, "lo": done[i], "hi": done[i] + ran, "start": start, "m": s, "total": total, "slots": at})
            left[i] -= ran
            done[i] += ran
        start += end
    return found


def _ranks(ids: DataFrame) -> DataFrame:
    """ids (_source, _id), made distinct, with the rank of each within its source, from 0."""
    spread = cut(ids.distinct().repartitionByRange("_source", "_id").withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, and one more per source: bounded by those, not by the documents
    offsets = cut(sizes.select("_source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    local = F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_id")) - 1
    ranked = spread.withColumn("_local", local)
    same = ranked["_source"].eqNullSafe(offsets["_source"]) & (ranked["_part"] == offsets["_part"])
    return ranked.join(offsets, same).select(ranked["_source"], "_id", (F.col("_local") + F.col("_offset")).alias("_rank"))


def _rest(sizes: DataFrame, weights: dict | None, least: float, kind: str) -> DataFrame:
    """Rows (_source, n, weight) of the sources that share a stream; weights are decimals, so that their sum has no order."""
    if not weights:
        return cut(sizes.withColumn("weight", F.sqrt("n").cast("decimal(28,12)")))
    given = sizes.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items() if w], f"given {kind}, w double")
    found = sizes.join(given, F.col("_source").eqNullSafe(F.col("given")), "left")
    return cut(found.select("_source", "n", F.coalesce("w", F.lit(least)).cast("decimal(28,12)").alias("weight")))


def _shared_ranks(ranked: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows (_source, _id, _rank) of rest's sources: ranks within all of them, each source spread evenly."""
    sizes = rest.select(F.col("_source").alias("of"), "n")
    own = ranked.join(sizes, F.col("_source").eqNullSafe(F.col("of")))
    at = ((F.col("_rank") + 0.5) / F.col("n")).alias("at")
    return cut(_ranks(own.select(F.lit(0).alias("_source"), F.struct(at, "_source", "_id").alias("_id"))).select("_id.*", "_rank")).select("_source", "_id", "_rank")


def _weighed(streams: list[tuple[int, object]], resolution: int | None) -> list[int]:
    """Whole parts of streams (number of documents, weight or None); without any weight, by the square root of that number."""
    given = [Fraction(str(w)) for _, w in streams if w]
    if resolution is None and given:
        least = min(given) / 1000
        return exact_parts([Fraction(str(w)) if w else least for _, w in streams])
    least = float(min(given)) / (resolution or 1000) if given else 0
    weights = [float(w or least) if given else n**0.5 for n, w in streams]
    fine = math.ceil(sum(weights) / min(weights)) if resolution is None else 0
    return parts(weights, max(resolution or 1000, len(streams), fine))


def schedule(
    docs: DataFrame, weights: dict | None = None, source: str = "source", doc_id: str = "doc_id", block_docs: int = 32, resolution: int | None = None, max_sources: int | None = None
) -> DataFrame:
    """Rows (_source, _id) and ADDED, one for each distinct source and id. place orders a block's documents.

    Without weights a source weighs as the square root of its number of documents. Weights (numbers, decimals or fractions above zero) are exact
    unless a resolution rounds them to so many parts; a source that has none weighs a thousandth (one in resolution) of the least.
    """
    spark = docs.sparkSession
    ranked = cut(_ranks(docs.select(F.col(source).alias("_source"), F.col(doc_id).alias("_id"))))
    sizes = ranked.groupBy("_source").agg(F.count("*").alias("n"))
    if ranked.isEmpty():
        return ranked.select("_source", "_id", *[F.lit(0).cast("bigint").alias(c) for c in ADDED])
    kind = docs.schema[source].dataType.simpleString()
    of_source = (lambda s: weights.get(s) or None) if weights else (lambda s: None)
    ranked = ranked.withColumns({"_stream": F.col("_source"), "_shared": F.lit(False)})
    rest = None
    if max_sources is not None and sizes.count() > max_sources:
        counts = sizes.orderBy(F.desc("n"), "_source").limit(max_sources - 1).orderBy("_source").collect()
        own = F.broadcast(spark.createDataFrame([(r["_source"],) for r in counts], f"of {kind}"))
        least = float(min(weights.values(), default=1)) / (resolution or 1000) if weights else 0.0
        rest = _rest(sizes.join(own, F.col("_source").eqNullSafe(F.col("of")), "left_anti"), weights, least, kind)
        shared = _shared_ranks(ranked, rest).withColumns({"_stream": F.lit(None).cast(kind), "_shared": F.lit(True)})
        ranked = ranked.join(own, F.col("_source").eqNullSafe(F.col("of")), "left_semi").unionByName(shared.select(ranked.columns))
    else:
        counts = sizes.orderBy("_source").collect()  # a row for each source
    names, streams = [(r["_source"], False) for r in counts], [(r["n"], of_source(r["_source"])) for r in counts]
    if rest is not None:
        n, weight = rest.agg(F.sum("n"), F.sum("weight").cast("double")).first()
        names.append((None, True))
        streams = [(n, w if weights else n**0.5) for n, w in streams] + [(n, weight)]
    shares = _weighed(streams, resolution if resolution is not None or rest is None else 1000)
    if sum(shares) >= 10**30:
        raise ValueError("the weights' common denominator is above 10^30: give rounder weights, or a resolution")
    rows = [(*names[x["source"]], x["lo"], x["hi"], x["start"], Decimal(x["m"]), Decimal(x["total"]), x["slots"]) for x in phases(shares, [-(-n // block_docs) for n, _ in streams])]
    plan = spark.createDataFrame(rows, f"of {kind}, shared boolean, lo bigint, hi bigint, start bigint, m decimal(38,0), total decimal(38,0), slots array<bigint>")
    j = plan.select("*", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("block")).withColumn("j", (F.col("block") - F.col("lo")).cast("decimal(18,0)"))
    each = cut(j.select(
        "of", "shared", F.col("block").alias("at"), F.expr("cast(start + (j div m) * total + slots[cast(j % m as int)] as bigint)").alias("slot"),
        F.expr("start + cast((j * total) div m as bigint)").alias("release"), F.expr("start + cast(((j + 1) * total + m - 1) div m as bigint)").alias("deadline"),
    ))
    known = F.broadcast(each) if small_enough(each, 64) else each
    ranked = ranked.withColumn("block", F.floor(F.col("_rank") / block_docs).cast("bigint"))
    same = F.col("_stream").eqNullSafe(F.col("of")) & (F.col("_shared") == F.col("shared")) & (F.col("block") == F.col("at"))
    return ranked.join(known, same).select("_source", "_id", "block", "slot", "release", "deadline", (F.col("_rank") % block_docs).cast("bigint").alias("place"))


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with ADDED, in mixed order: partitions hold ranges of slots, and rows within are sorted."""
    own = with_columns_dropped(docs, *ADDED)
    rows = docs.select(F.struct(*own.columns).alias("_row"), F.col(doc_id).alias("_d"), F.col(source).alias("_s"))
    plan = schedule(docs, weights, source, doc_id, **options)
    joined = rows.join(plan, F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")))
    return restored(joined, own.columns, *ADDED).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return schedule(docs).withColumnsRenamed({"_source": "source", "_id": "doc_id"})


QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL = {}
