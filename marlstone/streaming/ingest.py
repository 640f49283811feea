"""New files screened as they arrive; a restart goes on where the checkpoint stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marlstone.plans import screening


def screen_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", profile: str = "legacy") -> DataFrame:
    """Verdicts of the JSON documents that arrive in a folder. Stateless: no watermark is needed."""
    return screening.screen(spark.readStream.schema(schema).json(folder), profile)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, profile: str = "legacy") -> StreamingQuery:
    """Screen all files that have not been screened before and append the verdicts to a Parquet table; ends when none is left."""
    stream = screen_stream(spark, folder, profile=profile).select("doc_id", "profile", "status", "reason", "score_total")
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
