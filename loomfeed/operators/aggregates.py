"""Counts and reports over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The origins of content, and the statuses each may come with.
ORIGINS = ["feed", "web", "curated", "summary", "none", "unknown"]
STATUS_ORIGINS = {"extracted": ["feed", "web", "curated"], "summary_fallback": ["summary"], "fetch_failed": ["none"]}


def report_status_counts(reports: DataFrame) -> DataFrame:
    """One row over source reports: total, fetched (not failed), each status, articles."""
    status = F.lower(strip(F.col("status")))
    return reports.agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(status != "failed").alias("fetched_count"),
        *(F.count_if(status == s).alias(f"{s}_count") for s in ("success", "warning", "failed")),
        F.coalesce(F.sum("article_count"), F.lit(0)).alias("article_count"),
    )


def zero_filled(df: DataFrame, column: Column, buckets: list[str], *, other: str | None = None, name: str = "bucket") -> DataFrame:
    """``name, n`` for every bucket, zero included; values of no bucket fold into ``other`` or are left out."""
    value = F.when(column.isin(buckets), column).otherwise(F.lit(other))
    counts = df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    all_ = df.sparkSession.createDataFrame([(b,) for b in buckets], f"{name} string")
    return all_.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def origin_of(records: DataFrame) -> Column:
    """The origin of a record; where it is null (older rows), from the status and whether anything was fetched."""
    status = F.lower(strip(F.col("status")))
    inferred = F.when(status == "extracted", F.when(F.col("http_status").isNull(), "feed").otherwise("web")).when(status == "summary_fallback", "summary").when(status == "fetch_failed", "none").otherwise("unknown")
    given = F.nullif(F.lower(strip(F.col("content_origin"))), F.lit(""))
    return F.coalesce(F.when(given.isin(ORIGINS), given).when(given.isNotNull(), "unknown"), inferred)


def enrichment_counts(records: DataFrame) -> DataFrame:
    """One row: requested, each status, and the extraction rate (0 when nothing was requested)."""
    status = F.lower(strip(F.col("status")))
    counted = records.agg(
        F.count(F.lit(1)).alias("requested_count"),
        *(F.count_if(status == s).alias(a) for s, a in (("extracted", "extracted_count"), ("summary_fallback", "fallback_count"), ("fetch_failed", "failed_count"))),
    )
    return counted.withColumn("extraction_rate", F.coalesce(F.try_divide("extracted_count", "requested_count"), F.lit(0.0)))


def origin_counts(records: DataFrame) -> DataFrame:
    return zero_filled(records, origin_of(records), ORIGINS, other="unknown", name="origin")


def problems(records: DataFrame) -> DataFrame:
    """Records that weren't extracted."""
    return records.where(F.coalesce(F.lower(strip(F.col("status"))) != "extracted", F.lit(True)))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` of the keys that come more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sources_by_category(sources: DataFrame) -> DataFrame:
    """Per category the enabled sources' names, by priority (high first), then name."""
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), F.col("name").alias("n")))), lambda x: x["n"])
    return sources.where("enabled").groupBy("category").agg(F.count(F.lit(1)).alias("source_count"), F.array_join(names, "|").alias("sources"))


def coverage(lessons: DataFrame) -> DataFrame:
    """One row over lessons (enabled, curated, estimated_minutes, order, id): counts, minutes, rate, first uncurated."""
    on, cur = F.col("enabled"), F.col("enabled") & F.col("curated")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("estimated_minutes"))), F.lit(0))
    made = lessons.agg(
        F.count(F.lit(1)).alias("lesson_count"), F.count_if(on).alias("enabled_count"), F.count_if(cur).alias("curated_count"),
        total(on).alias("enabled_minutes"), total(cur).alias("curated_minutes"),
        F.min(F.when(on & ~F.col("curated"), F.struct("order", "id")))["id"].alias("next_uncurated"),
    )
    return made.withColumn("coverage_rate", F.coalesce(F.try_divide("curated_count", "enabled_count"), F.lit(0.0)))


def exit_code(reports: DataFrame, fail_on_source_error: bool) -> int:
    """1 if every report failed (or there is none), or one failed and that is fatal; else 0."""
    row = report_status_counts(reports).first()
    return int(row.failed_count == row.source_count or (fail_on_source_error and row.failed_count > 0))
