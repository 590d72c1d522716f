"""Data-quality checks: violations per row and reconciliation of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_slug_id
from ..functions.urls import is_http_url
from .aggregates import STATUS_ORIGINS, origin_of

# What a source may declare.
FORMATS = {"feed": ["rss", "atom"], "html_index": ["html"]}
CADENCES = ["daily", "weekly"]


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks (a null outcome breaks a rule)."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def source_rules() -> dict[str, Column]:
    """Rules for a source: identity, provider and format, URL, priority, flags."""
    pair = [(F.col("provider") == p) & F.col("format").isin(f) for p, f in FORMATS.items()]
    return {
        "id": is_slug_id(F.col("id")),
        "name": ~is_blank(F.col("name")),
        "provider_format": pair[0] | pair[1],
        "url": is_http_url(F.col("url")),
        "category": ~is_blank(F.col("category")),
        "priority": F.col("priority").between(1, 10),
        "cadence": ~is_blank(F.col("cadence")),
        "flags": F.col("enabled").isNotNull() & F.col("official").isNotNull(),
    }


def source_violations(sources: DataFrame) -> DataFrame:
    """``id, violation``: one row per broken rule."""
    return sources.select("id", F.explode(violations(source_rules())).alias("violation"))


def category_rules() -> dict[str, Column]:
    return {"weight": F.col("weight").between(1, 10), "daily_quota": F.col("daily_quota") >= 0, "label": ~is_blank(F.col("label"))}


def enrichment_checks(records: DataFrame) -> DataFrame:
    """``check_name, passed, failing``: statuses known, origins allowed for their status, counts that add up."""
    status, origin = F.lower(F.trim("status")), origin_of(records)
    allowed = F.lit(False)
    for s, origins in STATUS_ORIGINS.items():
        allowed = allowed | ((status == s) & origin.isin(origins))
    known = status.isin(list(STATUS_ORIGINS))
    row = records.agg(
        F.count_if(~F.coalesce(known, F.lit(False))).alias("status_known"),
        F.count_if(F.coalesce(known, F.lit(False)) & ~F.coalesce(allowed, F.lit(False))).alias("origin_allowed"),
        F.count_if(F.col("word_count") < 0).alias("word_count_not_negative"),
    )
    checks = F.array(*(F.struct(F.lit(c).alias("check_name"), (F.col(c) == 0).alias("passed"), F.col(c).alias("failing")) for c in row.columns))
    return row.select(F.inline(checks))


def public_checks(payload: DataFrame, expected_total: int) -> DataFrame:
    """``check_name, passed, failing`` of a public payload: size within bounds, no content, ids unique."""
    row = payload.agg(
        F.greatest(F.count(F.lit(1)) - expected_total, F.lit(0)).alias("article_count_within_limit"),
        F.count_if(~is_blank(F.col("content_html")) | ~is_blank(F.col("content_text"))).alias("no_content"),
        F.count_if(~F.coalesce(F.col("content_status") == "not_requested", F.lit(True))).alias("status_reset"),
        (F.count("url") - F.count_distinct("url")).alias("urls_unique"),
    )
    checks = F.array(*(F.struct(F.lit(c).alias("check_name"), (F.col(c) == 0).alias("passed"), F.col(c).alias("failing")) for c in row.columns))
    return row.select(F.inline(checks))


def same_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, left_n, right_n`` where the two sides disagree on how often a key comes."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_n"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_n"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))
    return both.where("left_n <> right_n")


def file_digests(spark, path: str) -> DataFrame:
    """``path, digest``: SHA-256 of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("digest"))
