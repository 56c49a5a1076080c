"""Rates of an event stream in tumbling windows, with late data held back by a watermark.

The same plan runs over a stream and over a table, so a batch run is the stream's twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def rates(events: DataFrame, every: str = "1 hour", late: str = "30 minutes", ts: str = "ts", kind: str = "event_type", bad: str = "error") -> DataFrame:
    """``start, events, bad, value``: counts, failures and the summed value of each window."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", every)).agg(F.count("*").alias("events"), F.count_if(F.col(kind) == bad).alias("bad"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "events", "bad", "value")


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_rates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each window once it can no longer change; restarts go on from the checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
