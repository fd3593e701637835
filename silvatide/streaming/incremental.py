"""Running containment maxima over a landing folder: an extension of this engine.

A maximum only grows, so late files need no watermark; state grows with the number of (sample, genome) cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "sample string, genome string, v double"


def landing(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_max(stream: DataFrame) -> DataFrame:
    return stream.groupBy("sample", "genome").agg(F.max("v").alias("v"))


def run_available(stream: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Process what has landed and stop; the result is the in-memory table `name`."""
    return stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
