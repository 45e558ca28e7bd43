"""Event-time windows, the same for batch frames and streams, and keyed upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None, time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """STR-06: count and sum by window and key. late: watermark of a stream, whose time must be a timestamp with zone (TRAP-34)."""
    if late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return events.groupBy(F.window(time, length, slide) if slide else F.window(time, length), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def session_windowed(events: DataFrame, gap: str, late: str | None = None, time: str = "ts", key: str = "user_id", value: str = "value") -> DataFrame:
    """STR-04: plays as sessions of a key with no gap longer than given."""
    if late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def upsert_sink(read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """STR-05: a foreachBatch function: rows of a batch replace those of their key, the latest by `order` first.

    write(frame, batch) must be idempotent by batch, since a batch may come twice.
    """
    from ..operators.sequences import keep_one

    def upsert(batch: DataFrame, number: int) -> None:
        held = read()
        fresh = batch.withColumn("__fresh", F.lit(1))
        both = fresh if held is None else held.withColumn("__fresh", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
        write(keep_one(both, keys, [F.col("__fresh").desc(), F.col(order).desc()]).drop("__fresh"), number)

    return upsert
