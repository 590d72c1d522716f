"""The stream form: articles as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import schemas
from ..functions.times import event_instant
from ..functions.urls import canonical_url


def arriving(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Articles of parquet files that appear under a path, with ``canonical_url`` and ``event_ts``."""
    raw = spark.readStream.schema(schemas.ARTICLE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    at = event_instant(F.col("published_at"), F.col("updated_at"))
    # The watermark needs TIMESTAMP; the instants are UTC, as the session zone should be.
    return raw.withColumns({"canonical_url": canonical_url(F.col("url")), "event_ts": at.cast("timestamp")})


def first_arrivals(stream: DataFrame, *, late: str = "48 hours") -> DataFrame:
    """The first arrival of each canonical URL within the watermark; state is dropped behind it.

    It keeps the first, not the best: the best needs the whole group, which
    the batch operator has.
    """
    return stream.where("canonical_url IS NOT NULL AND event_ts IS NOT NULL").withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["canonical_url"])


def counts_by_window(stream: DataFrame, *, width: str = "6 hours", late: str = "48 hours") -> DataFrame:
    """Articles per category and tumbling window of event time."""
    return stream.withWatermark("event_ts", late).groupBy(F.window("event_ts", width), "category").agg(F.count(F.lit(1)).alias("articles")).select(F.col("window.start").alias("start"), "category", "articles")


def run_editions(stream: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to ``build``; with ``once`` everything there is now, then stop."""
    writer = stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
