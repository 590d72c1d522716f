"""Content of pages, and what to keep when it can't be had."""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dom
from ..functions.text import is_blank, media_type
from ..functions.urls import is_http_url

#: The tag of records whose content was curated.
CURATED = "learning_content:curated"
CONTENT_SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n == "word_count" else T.StringType()) for n in ("content_html", "content_text", "status", "selector", "word_count")])


def extract_content(minimum: int = 400, maximum: int = 120_000):
    """Arrow UDF ``(html, base_url) -> content struct``."""

    @F.pandas_udf(CONTENT_SCHEMA)
    def run(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html, base in pages:
            yield pd.DataFrame([dom.extract(h, b, minimum=minimum, maximum=maximum) for h, b in zip(html, base, strict=True)], columns=["content_html", "content_text", "status", "selector", "word_count"])

    return run


@F.pandas_udf(T.StringType())
def clean_html(html: pd.Series) -> pd.Series:
    """Text of markup with white space collapsed."""
    return html.map(dom.visible_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def clean_text(text: pd.Series) -> pd.Series:
    """Entities resolved, white space of any kind collapsed."""
    return text.map(lambda t: re.sub(r"\s+", " ", html_module.unescape(t)).strip(), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding; ``functions.text.fold`` is the native form for common scripts."""
    return text.map(str.casefold, na_action="ignore")


def content_outcome(preloaded: Column, curated: Column, url: Column, error: Column, content_type: Column, size: Column, extraction: Column, summary: Column, maximum_bytes: int) -> tuple[Column, Column]:
    """``(status, origin)`` of a record's content from what fetching and extracting gave.

    Preloaded content stays and counts as extracted. A failed request falls
    back to a summary, or fails without one. Everything else that can't be
    used falls back to the summary.
    """
    fallback = F.lit("summary_fallback")
    kind = media_type(content_type)
    usable = (kind.isNull() | kind.isin("text/html", "application/xhtml+xml")) & size.between(1, maximum_bytes) & (extraction == "extracted")
    status = (
        F.when(preloaded, "extracted").when(~is_http_url(url), fallback).when(error.isNotNull() & is_blank(summary), "fetch_failed")
        .when(error.isNotNull(), fallback).when(F.coalesce(usable, F.lit(False)), "extracted").otherwise(fallback)
    )
    origin = F.when(preloaded, F.when(curated, "curated").otherwise("feed")).when(status == "extracted", "web").when(status == "fetch_failed", "none").otherwise("summary")
    return status, origin


def enrichment_records(enriched: DataFrame, fetched: DataFrame) -> DataFrame:
    """The log of content retrieval of enriched articles: one record each, with what fetching its URL gave."""
    pages = fetched.select("url", "http_status", "content_type", "duration_seconds", F.col("error").alias("fetch_error"))
    own = F.col("content_origin").isin("feed", "curated")
    told = lambda c: F.when(~own, F.col(c))
    return enriched.join(pages, "url", "left").select(
        *(c for c in ("rank_index", "section") if c in enriched.columns), "source_id", "title", "url", F.col("content_status").alias("status"), told("http_status").alias("http_status"), told("content_type").alias("content_type"), "selector",
        F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce(told("duration_seconds"), F.lit(0.0)).alias("duration_seconds"), told("fetch_error").alias("error"), "content_origin",
    )


def enrich(articles: DataFrame, fetched: DataFrame, *, minimum: int = 400, maximum_bytes: int = 5_000_000) -> DataFrame:
    """Articles with the content of their fetched pages.

    ``fetched`` has ``url, body, content_type, error`` (see the page source),
    one row per URL. Only rows without content of their own are extracted.
    """
    preloaded = ~is_blank(F.col("content_html")) | ~is_blank(F.col("content_text"))
    curated = F.coalesce(F.array_contains("source_tags", CURATED), F.lit(False))
    df = articles.join(fetched.select("url", "body", "content_type", "error"), "url", "left").withColumn("_pre", preloaded)
    body = F.when(~F.col("_pre") & F.col("error").isNull(), F.col("body"))
    df = df.withColumn("_x", extract_content(minimum)(body, F.col("url")))
    status, origin = content_outcome(F.col("_pre"), curated, F.col("url"), F.col("error"), F.col("content_type"), F.coalesce(F.octet_length("body"), F.lit(0)), F.col("_x.status"), F.col("summary"), maximum_bytes)
    df = df.withColumns({"_status": status, "_origin": origin})
    new = (F.col("_status") == "extracted") & ~F.col("_pre")
    done = {
        "content_html": F.when(new, F.col("_x.content_html")).otherwise(F.col("content_html")),
        "content_text": F.when(new, F.col("_x.content_text")).otherwise(F.col("content_text")),
        "content_status": F.col("_status"),
    }
    return df.withColumns(done | {"content_origin": F.col("_origin"), "selector": F.col("_x.selector"), "word_count": F.col("_x.word_count")}).select(*articles.columns, "content_origin", "selector", "word_count")
