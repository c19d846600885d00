"""Windowed aggregation of timed rows with a watermark; late rows are counted, not lost silently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(rows: DataFrame, time: str, keys: list[str], value: str, size: str, lateness: str | None = None) -> DataFrame:
    """(keys, start, n, total) by tumbling windows; `lateness` sets a watermark, for streams."""
    r = rows.withWatermark(time, lateness) if lateness else rows
    w = r.groupBy(*keys, F.window(time, size).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(*keys, F.col("w.start").alias("start"), "n", "total")


def sessions(rows: DataFrame, time: str, keys: list[str], gap: str, lateness: str | None = None) -> DataFrame:
    """(keys, start, end, n) by sessions that a pause of `gap` ends."""
    r = rows.withWatermark(time, lateness) if lateness else rows
    w = r.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_per_run(rows: DataFrame, run: str, payload: str, order: str) -> DataFrame:
    """The earliest row of each run that carries a payload, exactly once however often it is delivered."""
    return rows.where(F.col(payload).isNotNull()).groupBy(run).agg(F.min_by(payload, order).alias(payload), F.min(order).alias(order))


def new_only(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not written before: what a restarted writer still has to do."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
