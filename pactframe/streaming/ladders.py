"""The record ladders on streams: they hold no state, so a streaming frame takes the batch plan as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import payload as p
from ..operators.ladder import Ladder


def project_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: dict, ladder: Ladder | None = None, files: str = "*.parquet") -> None:
    """Projects event rows (event_id, event_type, props) of a folder's Parquet files as they come, into Parquet; ends when all are read."""
    kinds = "event_id bigint, event_type string, props string"
    events = spark.readStream.schema(kinds).option("pathGlobFilter", files).parquet(source)
    fields = F.create_map(F.lit("event_type"), F.col("event_type").cast("variant"), F.lit("props"), F.try_parse_json("props"))
    out = (ladder or Ladder.default()).project(events.withColumn("foreign", F.to_variant_object(fields)), "foreign", schema)
    flat = out.select("event_id", "result.quarantined", "result.rung", p.to_json(F.col("result.migrated")).alias("migrated"))
    flat.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
