"""Gates against live vocabularies: whether a payload's values are among those of a table, decided by existence joins.

A vocabulary is asked when the gate runs, not when the schema is made. Its distinct values are sent to all tasks where
their measured size allows it. Beyond that rows are shuffled to the values once for each such vocabulary; a row that has
no value to be looked up, as where the field is missing or null, goes to any task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as p
from ..functions.shared import cut

#: Texts, none of them a token, that rows without a value are spread by.
NOWHERE = 4096


@dataclass(frozen=True)
class Vocabulary:
    """The values (a column `value`, text or number) that a field at a dotted path may have. An empty vocabulary accepts nothing.

    A missing field is not checked. null passes only where the field is nullable. Lists and objects are no values.
    """

    field: str
    values: DataFrame
    nullable: bool = False


def _spelled(v: Column) -> Column:
    """A scalar as a text that equal values of one kind share; null for others."""
    of = p.kind(v)
    number = F.coalesce(p.whole(v).cast("string"), F.regexp_replace(p.number(v).cast("string"), r"\.0$", ""))
    return F.when(of == "string", F.concat(F.lit("s"), p.text(v))).when(of == "number", F.concat(F.lit("n"), number)).when(of == "boolean", F.concat(F.lit("b"), p.text(v)))


def _tokens(vocabulary: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Rows (_known): a vocabulary's distinct values as texts, and whether they are small enough to be sent to all tasks."""
    tokens = cut(vocabulary.select(_spelled(F.col("value").cast("variant")).alias("_known")).filter("_known IS NOT NULL").distinct())
    return tokens, tokens.agg(F.coalesce(F.sum(F.octet_length("_known") + 32), F.lit(0))).first()[0] <= limit


def conforms(rows: DataFrame, payload: str, *vocabularies: Vocabulary, into: str = "conforms", limit: int = 64 << 20) -> DataFrame:
    """rows with a boolean column `into`: whether the payload (a VARIANT or a payload map) has only values of the vocabularies. A null payload does not conform."""
    whole = F.col(payload) if rows.schema[payload].dataType.typeName() == "variant" else F.to_variant_object(F.col(payload))
    values = [p.path(F.col("_v"), x.field) for x in vocabularies]
    asked = rows.select(F.struct(*rows.columns).alias("_row"), whole.alias("_v"))
    held = asked.select("_row", F.col("_v").isNotNull().alias("_ok"), *[F.struct(p.kind(v).alias("kind"), _spelled(v).alias("token")).alias(f"_{i}") for i, v in enumerate(values)])
    for i, x in enumerate(vocabularies):
        known, small = _tokens(x.values, limit)
        token, kind = F.col(f"_{i}.token"), F.col(f"_{i}.kind")
        if small:
            joined = held.join(F.broadcast(known), token == F.col("_known"), "left")
        else:
            spread = F.coalesce(token, F.concat(F.lit("?"), (F.monotonically_increasing_id() % NOWHERE).cast("string")))
            joined = held.withColumn("_token", spread).join(known, F.col("_token") == F.col("_known"), "left")
        fits = F.when(kind.isNull(), True).when(kind == "null", F.lit(x.nullable)).otherwise(F.col("_known").isNotNull())
        held = joined.select("_row", (F.col("_ok") & fits).alias("_ok"), *[f"_{j}" for j in range(i + 1, len(vocabularies))])
    return held.select(*[F.col(f"_row.`{c}`") for c in rows.columns if c != into], F.col("_ok").alias(into))
