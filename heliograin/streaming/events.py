"""Count windows, event detection and event-time aggregates for batch tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_windows(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, stride: int) -> DataFrame:
    """Rows (keys, window, start, n, sum, max): sliding windows by row count; the incomplete tail is dropped."""
    numbered = df.withColumn("_i", (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    first = F.greatest(F.ceil((F.col("_i") - size + 1) / stride), F.lit(0)).cast("long")
    each = numbered.withColumn("window", F.explode(F.when(first <= F.floor(F.col("_i") / stride), F.sequence(first, F.floor(F.col("_i") / stride).cast("long")))))
    w = each.groupBy(*keys, "window").agg(F.min("_i").alias("start"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.max(value).alias("max"))
    return w.filter(F.col("n") == size)


def detect(windows: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Windows that score 1 or more, numbered from 0 in each key; their time is the window's start."""
    hit = windows.withColumn("score", score).filter("score >= 1.0")
    return hit.withColumn("event_id", F.row_number().over(W.partitionBy(*keys).orderBy("window")) - 1)


def latest(df: DataFrame, keys: list[str], time: str, arrival: str, value: str, good: Column) -> DataFrame:
    """Each key's latest good value by time, the last arrival of equals; null where there is none."""
    at = F.struct(time, arrival)
    return df.groupBy(*keys).agg(F.max_by(F.when(good, F.col(value)), F.when(good, at)).alias("value"))


def bounded_log(events: DataFrame, time: str, arrival: str, capacity: int) -> DataFrame:
    """The ``capacity`` latest events; of equal times the first arrived go first."""
    return events.orderBy(F.col(time).desc(), F.col(arrival).desc()).limit(capacity)


def between(events: DataFrame, time: str, start, end) -> DataFrame:
    return events.filter(F.col(time).between(start, end))


def hourly(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time windows with a watermark: count and sum; works on streams and tables."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum")).select(F.col("w.start").alias("start"), *keys, "n", "sum")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(stream: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")
