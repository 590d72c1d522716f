"""Classify records by event time against a window."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, is_blank
from ..functions.times import event_instant

STATUSES = ["kept", "missing", "invalid", "too_old", "future"]


def _utc(now: str | datetime) -> datetime:
    at = datetime.fromisoformat(now) if isinstance(now, str) else now
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def check_window(lookback_hours: float, tolerance_minutes: float) -> None:
    for name, value, least in (("lookback_hours", lookback_hours, None), ("future_tolerance_minutes", tolerance_minutes, 0)):
        if isinstance(value, bool) or not isinstance(value, (int, float)) or (value < least if least is not None else value <= 0):
            raise ValueError(f"{name} must be a number {'of 0 or more' if least is not None else 'above 0'}")


def window_status(instant: Column, any_value: Column, now: str | datetime, lookback_hours: float, tolerance_minutes: float) -> Column:
    """missing, invalid, too_old, future or kept, in this order of precedence; both bounds are inside."""
    at = _utc(now)
    lit = lambda d: F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")
    return (
        F.when(~any_value, "missing")
        .when(instant.isNull(), "invalid")
        .when(instant < lit(at - timedelta(hours=lookback_hours)), "too_old")
        .when(instant > lit(at + timedelta(minutes=tolerance_minutes)), "future")
        .otherwise("kept")
    )


def classify_by_time(articles: DataFrame, lookback_hours: float, *, now: str | datetime, future_tolerance_minutes: float = 15) -> DataFrame:
    """Append ``event_ts`` (UTC) and ``time_status``. The five outcomes are filters on the one status: one scan."""
    check_window(lookback_hours, future_tolerance_minutes)
    some = ~is_blank(F.col("published_at")) | ~is_blank(F.col("updated_at"))
    df = bound(articles, event_ts=event_instant(F.col("published_at"), F.col("updated_at")))
    return df.withColumn("time_status", window_status(F.col("event_ts"), some, now, lookback_hours, future_tolerance_minutes))


def status_counts(classified: DataFrame) -> DataFrame:
    """One row: the count of each status and the total."""
    return classified.agg(*(F.count_if(F.col("time_status") == s).alias(s) for s in STATUSES), F.count(F.lit(1)).alias("total"))
