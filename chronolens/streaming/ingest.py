"""Beyond the batch engine: the same stamps and windows as Structured Streaming, over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_landing(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def first_vintages(stream: DataFrame, key: list[str], time: str = "knowable_at", late: str = "7 days") -> DataFrame:
    """Each (key, time) once, though full histories arrive again and again; state older than the watermark goes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([*key, time])


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Rows (start, end, keys, n, total, mean) of tumbling windows; each appears once the watermark has passed it."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return counts.select("window.start", "window.end", *keys, "n", "total", "mean")


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows (start, end, keys, n) of sessions that end after a gap."""
    counts = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("session_window.start", "session_window.end", *keys, "n")


def drain(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over all that has arrived, then stops: a daily batch with a stream's bookkeeping."""
    frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
