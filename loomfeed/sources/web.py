"""Fetch pages and feeds over HTTP on the executors.

The retry policy is a pure function of what happened; the transport can be
replaced, so tests need no network. ``WebPages`` is the same as a Spark data
source: ``spark.read.format("web_pages").option("urls", "a\\nb").load()``.
"""

from __future__ import annotations

import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from . import feeds, index_pages

# What requests say, how long the second may wait, and who can be read.
ACCEPT = "application/atom+xml, application/rss+xml, application/xml;q=0.9, text/html;q=0.8, */*;q=0.5"
AGENT = "loomfeed/0.1"
BROWSER = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/140.0 Safari/537.36"
MOST_SECONDS, CHUNK = 60, 64 * 1024
PROVIDERS = ("feed", "html_index")


@dataclass(frozen=True)
class Answer:
    status: int | None = None
    content_type: str | None = None
    body: bytes = b""
    final_url: str | None = None
    timed_out: bool = False
    error: str | None = None


Transport = Callable[[str, float, dict[str, str], int], Answer]


def default_headers() -> dict[str, str]:
    return {"User-Agent": AGENT, "Accept": ACCEPT}


def browser_headers(url: str) -> dict[str, str]:
    parts = urlsplit(url)
    return {"User-Agent": BROWSER, "Accept": ACCEPT, "Accept-Language": "en-US,en;q=0.9", "Cache-Control": "no-cache", "Referer": f"{parts.scheme}://{parts.netloc}/"}


def longer_timeout(seconds: float) -> float:
    return min(max(2 * seconds, seconds + 10), MOST_SECONDS)


def retry_of(answer: Answer, seconds: float) -> tuple[str, float] | None:
    """``(profile, timeout)`` of the one retry that an answer calls for: after a timeout, or a refusal (403)."""
    if answer.timed_out:
        return "browser_compatible_timeout_retry", longer_timeout(seconds)
    if answer.status == 403:
        return "browser_compatible", seconds
    return None


def over_http(url: str, seconds: float, headers: dict[str, str], most_bytes: int) -> Answer:
    """GET with a byte limit: a body over it is an error, and isn't read to its end."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=seconds) as r:
            if int(r.headers.get("Content-Length") or 0) > most_bytes:
                return Answer(r.status, r.headers.get("Content-Type"), b"", r.url, error="body too large")
            parts, size = [], 0
            while part := r.read(CHUNK):
                size += len(part)
                if size > most_bytes:
                    return Answer(r.status, r.headers.get("Content-Type"), b"", r.url, error="body too large")
                parts.append(part)
            return Answer(r.status, r.headers.get("Content-Type"), b"".join(parts), r.url)
    except urllib.error.HTTPError as e:
        return Answer(e.code, error=f"HTTP {e.code}")
    except (TimeoutError, socket.timeout):
        return Answer(timed_out=True, error="timed out")
    except (urllib.error.URLError, OSError, ValueError) as e:
        return Answer(timed_out=isinstance(getattr(e, "reason", None), TimeoutError), error=str(e))


def fetch(url: str, seconds: float = 20, most_bytes: int = 5_000_000, transport: Transport = over_http) -> dict:
    """A row of ``schemas.PAGE``, with when it was fetched and how long that took."""
    now = lambda: f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
    started, clock = now(), time.perf_counter()
    answer, retries, profile = transport(url, seconds, default_headers(), most_bytes), 0, "default"
    if again := retry_of(answer, seconds):
        profile, timeout = again
        answer, retries = transport(url, timeout, browser_headers(url), most_bytes), 1
    error = answer.error or (f"HTTP {answer.status}" if answer.status is not None and answer.status >= 400 else None)
    return {"url": url, "http_status": answer.status, "content_type": answer.content_type, "body": None if error else answer.body, "final_url": answer.final_url or url, "error": error, "retry_count": retries, "request_profile": profile,
            "started_at": started, "completed_at": now(), "duration_seconds": round(time.perf_counter() - clock, 3)}


def fetch_pages(urls: DataFrame, *, seconds: float = 20, most_bytes: int = 5_000_000, transport: Transport = over_http) -> DataFrame:
    """Fetch each distinct ``url``; tasks fetch in parallel, one answer per row, errors as data."""

    arrow = schemas.arrow_schema(schemas.PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from schemas.batches([fetch(u, seconds, most_bytes, transport) for u in b.column(0).to_pylist()], arrow)

    return urls.select("url").where("url IS NOT NULL").distinct().mapInArrow(run, schemas.PAGE)


def collect(sources: DataFrame, fetched_at: str, *, seconds: float = 20, max_summary: int = 2000, transport: Transport = over_http, layouts: dict[str, index_pages.IndexLayout] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(articles, reports)`` of a source table with ``source_pos``; a failing source is a failed report, an unknown provider a ValueError."""
    src = sources.where("enabled")
    unknown = src.where(~F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False))).select("id", "provider").limit(10).collect()
    if unknown:
        raise ValueError(f"unknown providers: {', '.join(f'{r.provider} of {r.id}' for r in unknown)}; there are {', '.join(PROVIDERS)}")
    pages = fetch_pages(src, seconds=seconds, transport=transport)
    staged = src.join(pages, "url")
    from ..runtime import checkpoint

    staged = checkpoint(staged)
    good = staged.where("error IS NULL").drop("http_status", "content_type", "final_url", "error", "retry_count", "request_profile", "started_at", "completed_at", "duration_seconds")
    parsed = feeds.feed_articles(good.where("provider = 'feed'"), fetched_at, max_summary=max_summary)
    cards = index_pages.index_articles(good.where("provider = 'html_index'"), fetched_at, max_summary=max_summary, layouts=layouts)
    everything = checkpoint(parsed.unionByName(cards, allowMissingColumns=True))
    articles = everything.where("error IS NULL").drop("error", "feed_format", "feed_title")
    found = everything.groupBy("source_pos").agg(F.count_if(F.col("error").isNull()).cast("int").alias("article_count"), F.first("feed_title", ignorenulls=True).alias("feed_title"), F.max("error").alias("parse_error"))
    r = staged.join(found, "source_pos", "left").withColumn("error", F.coalesce("error", "parse_error"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("article_count", F.lit(0)) == 0, "warning").otherwise("success")
    reports = r.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), "category", "url", status.alias("status"), "started_at", "completed_at",
        "duration_seconds", F.coalesce("article_count", F.lit(0)).alias("article_count"), "http_status", "final_url", "feed_title",
        F.when(status == "warning", "no entries").alias("warning"), "error", "retry_count", "request_profile",
    )
    return articles, reports


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u.strip() for u in options.get("urls", "").splitlines() if u.strip()]
        self.seconds, self.most_bytes = float(options.get("timeout", 20)), int(options.get("most_bytes", 5_000_000))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield tuple(fetch(partition.value, self.seconds, self.most_bytes).values())


class WebPages(DataSource):
    """``web_pages``: one partition per URL."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return schemas.PAGE

    def reader(self, schema) -> _PageReader:
        return _PageReader(self.options)
