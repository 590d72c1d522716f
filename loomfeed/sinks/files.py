"""Single documents, written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.aggregates import report_status_counts
from ..operators.editions import redact


def write_bytes(path: str | Path, data: bytes) -> None:
    """Write beside the target, then rename over it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temporary, target)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def write_text(path: str | Path, text: str) -> None:
    write_bytes(path, text.encode("utf-8"))


def write_json(path: str | Path, value: object) -> None:
    """UTF-8, two spaces, a line break at the end."""
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def rows_of(df: DataFrame, most: int) -> list[dict]:
    """Rows as dicts, for documents of bounded size; more than ``most`` is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a document holds at most {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_articles(articles: DataFrame, path: str) -> None:
    """Public form of all articles as JSON lines, in parallel."""
    redact(articles).write.mode("overwrite").json(path)


def write_source_report(reports: DataFrame, path: str | Path, project: dict, *, most: int = 100_000) -> dict:
    """The report of a collection, one document: counts by status and a row per source, in order."""
    columns = [c for c in reports.columns if c not in ("source_pos",)]
    rows = rows_of(reports.orderBy(*(["source_pos"] if "source_pos" in reports.columns else ["source_id"])).select(*columns), most)
    value = {"schema_version": 1, "project": project, "summary": report_status_counts(reports).first().asDict(), "sources": rows}
    write_json(path, value)
    return value


def ranked_payload(selected: DataFrame, project: dict, generated_at: str, summary: dict, *, most: int, lesson_ids: list[str] | None = None) -> dict:
    """The nested document of an edition, in rank order."""
    public = redact(selected)
    order = [c for c in ("section", "rank_index") if c in selected.columns]
    articles = rows_of(public.orderBy(*order).drop("section", "section_name", "event_ts", "canonical_url", "dedup_status", "group_ordinal", "freshness_seconds"), most)
    out = {"schema_version": 1, "project": project, "generated_at": generated_at, "summary": summary, "article_count": len(articles), "articles": articles}
    return out | ({"learning": {"enabled": True, "lesson_ids": lesson_ids}} if lesson_ids is not None else {})


def write_editions(editions: DataFrame, path: str) -> None:
    """Replace only the dates that come in (dynamic partition overwrite)."""
    editions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_date").parquet(path)


def grouped(articles: list[dict], categories: list[dict]) -> list[tuple[str, list[dict]]]:
    """``(label, articles)`` in profile order; unknown categories follow with a label made from their id; empty ones are left out."""
    labels = {c["category_id"]: c["label"] for c in sorted(categories, key=lambda c: c["position"])}
    groups: dict[str, list[dict]] = {k: [] for k in labels}
    for a in articles:
        groups.setdefault(a["category"] or "", []).append(a)
    return [(labels.get(k) or (k.replace("_", " ").strip().title() or "Other"), v) for k, v in groups.items() if v]


