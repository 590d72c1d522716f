"""Schemas of the records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ARTICLE = (
    "source_id string, source_name string, category string, source_priority int, source_tags array<string>, title string, url string, external_id string, "
    "published_at string, updated_at string, summary string, author string, fetched_at string, content_html string, content_text string, content_status string"
)
ORDINAL = "source_pos int, entry_pos int"
REPORT = (
    "source_id string, source_name string, category string, url string, status string, started_at string, completed_at string, duration_seconds double, "
    "article_count int, http_status int, final_url string, feed_title string, warning string, error string, retry_count int, request_profile string"
)
SOURCE = "id string, name string, provider string, format string, url string, category string, priority int, cadence string, enabled boolean, official boolean, tags array<string>"
CATEGORY = "category_id string, label string, weight int, daily_quota int, position int"
LESSON = (
    "id string, title string, source_name string, url string, track string, order int, topics array<string>, difficulty string, estimated_minutes int, "
    "summary string, why_it_matters string, enabled boolean, content_html string"
)
EDITION = "date string, generated_at string, article_count int, path string, title string"
PAGE = "url string, http_status int, content_type string, body binary, final_url string, error string, retry_count int, request_profile string, started_at string, completed_at string, duration_seconds double"


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; made on the driver and shipped with the task."""
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def batches(rows: list[dict], schema: pa.Schema) -> list[pa.RecordBatch]:
    """Rows as record batches; absent fields are null."""
    return pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema).to_batches()
