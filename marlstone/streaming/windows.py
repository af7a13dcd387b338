"""Event-time windows, alike on tables and on streams.

On a stream a watermark bounds the state: events later than ``late`` behind the
newest one are dropped, and a window is final when the watermark has passed it.
On a table the watermark does nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(events: DataFrame, window: Column, ts: str, by: Sequence[str], late: str, measures: dict[str, Column] | None) -> DataFrame:
    kind = dict(events.dtypes)[ts]  # watermarks need an instant; results have the type of ``ts``
    held = events.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    told = {"events": F.count("*"), **(measures or {})}
    out = held.groupBy(window.alias("w"), *by).agg(*[v.alias(k) for k, v in told.items()])
    return out.select(F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"), *by, *told)


def tumbling(events: DataFrame, width: str, ts: str = "ts", by: Sequence[str] = (), late: str = "1 hour", measures: dict[str, Column] | None = None) -> DataFrame:
    """Windows side by side: each event is in one."""
    return _counted(events, F.window(ts, width), ts, by, late, measures)


def sliding(events: DataFrame, width: str, step: str, ts: str = "ts", by: Sequence[str] = (), late: str = "1 hour", measures: dict[str, Column] | None = None) -> DataFrame:
    """Windows that begin every ``step``: an event is in as many as overlap it."""
    return _counted(events, F.window(ts, width, step), ts, by, late, measures)


def sessions(events: DataFrame, gap: str, ts: str = "ts", by: Sequence[str] = (), late: str = "1 hour", measures: dict[str, Column] | None = None) -> DataFrame:
    """Runs of events of one ``by`` with less than ``gap`` between them; a window ends a gap after its last event."""
    return _counted(events, F.session_window(ts, gap), ts, by, late, measures)
