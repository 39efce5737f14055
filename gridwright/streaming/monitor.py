"""Streams of trials: the running best and counts by window of event time. An extension; batch queries give the same figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TRIALS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def read_trials(spark: SparkSession, folder: str, schema: str = TRIALS, files_a_time: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_time).parquet(folder)


def windowed_best(trials: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """``window_start, event_type, trials, best`` by event time; rows later than the watermark allows are left out."""
    seen = trials.withWatermark("ts", late)
    out = seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("trials"), F.max("value").alias("best"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "trials", "best")


def write_windows(out: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a folder, exactly once by the checkpoint; works off what there is, then stops."""
    return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
