"""Reports of an edition's contents, a curriculum and sources, as text, Markdown or JSON.

Counts come from aggregations; the rows shown are those of one edition or
curriculum, bounded by ``files.rows_of``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..operators.aggregates import coverage, enrichment_counts, origin_counts, origin_of, problems, report_status_counts
from .files import rows_of

#: Most rows that a report shows; more are an error.
MOST_ROWS = 10_000

# Labels of the reports.
CONTENT_TITLE = "Full-content EPUB"
CONTENT_LINES = [("Requested", "requested_count", "Requested articles"), ("Extracted", "extracted_count", "Full content extracted"), ("Summary fallback", "fallback_count", "Summary fallbacks"), ("Fetch failed", "failed_count", "Fetch failures")]
ORIGIN_LINES = [("From feed", "feed", "RSS or Atom feed"), ("From web", "web", "Web page extraction"), ("Curated lessons", "curated", "Curated learning"), ("Summary only", "summary", "Summary only"), ("No readable text", "none", "No readable text")]
STATUS_LABELS = {"extracted": "Extracted", "summary_fallback": "Fallback", "fetch_failed": "Failed"}
CONTENT_RATE, CONTENT_ORIGINS, UNKNOWN_ORIGIN = "Extraction rate", "Content origin", ("Unknown origin", "Unknown")
CONTENT_SECTIONS = {False: ("Article details", "No article records."), True: ("Articles using fallback", "No articles require fallback.")}
CONTENT_HEAD = ["#", "Status", "Origin", "Source", "Article", "Words", "HTTP", "Detail"]
COVERAGE_TITLE = "Technical Learning"
COVERAGE_HEAD = ["#", "Status", "Lesson", "Track", "Level", "Minutes", "Characters"]
NEXT_LESSON, NO_LESSONS = "Next lesson to curate", "No matching lessons"
SOURCE_HEAD = ("Source", "Status", "HTTP", "Articles", "Seconds", "Details")
COVERAGE_LINES = [("Total lessons", "lesson_count", None), ("Enabled lessons", "enabled_count", "Enabled lessons"), ("Curated offline lessons", "curated_count", "Curated offline lessons"), ("Lessons needing web", "uncurated_count", "Lessons needing web"),
                  ("Curated coverage", "coverage_rate", "Curated coverage"), ("Curated reading time", "curated_minutes", "Curated reading time"), ("Web-dependent time", "uncurated_minutes", "Web-dependent reading time")]


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``index`` from 1 in the given order (the rows of one report)."""
    return rows.withColumn("index", F.row_number().over(Window.orderBy(*order)))


def content_report(records: DataFrame, *, order: str = "record_id", problems_only: bool = False, most: int = MOST_ROWS) -> dict:
    """Counts, extraction rate, origins and records of content retrieval; with ``problems_only`` just the records that weren't extracted, under their numbers among all."""
    totals = enrichment_counts(records).first().asDict()
    origins = {r.origin: r.n for r in origin_counts(records).collect()}
    each = numbered(records.withColumns({"status": F.lower(strip(F.col("status"))), "content_origin": origin_of(records)}), order)
    shown = problems(each) if problems_only else each
    keep = [c for c in ("index", "source_id", "title", "url", "status", "http_status", "content_type", "selector", "word_count", "duration_seconds", "error", "content_origin") if c in shown.columns]
    return {**totals, "extraction_rate": round(totals["extraction_rate"], 4), "content_origins": origins, "problems_only": problems_only, "records": rows_of(shown.select(*keep).orderBy("index"), most)}


def coverage_report(lessons: DataFrame, *, uncurated_only: bool = False, most: int = MOST_ROWS) -> dict:
    """Counts, minutes and rate of curated lessons, the next to curate, and the lessons by (order, id)."""
    marked = lessons.withColumn("curated", ~is_blank(F.col("content_html")))
    totals = coverage(marked).first().asDict()
    totals |= {"uncurated_count": totals["enabled_count"] - totals["curated_count"], "uncurated_minutes": totals["enabled_minutes"] - totals["curated_minutes"], "coverage_rate": round(totals["coverage_rate"], 4)}
    each = numbered(marked.withColumn("content_characters", F.length(strip(F.coalesce("content_html", F.lit(""))))), "order", "id")
    shown = uncurated(each) if uncurated_only else each
    return {**totals, "records": rows_of(shown.select("index", "id", "order", "title", "track", "difficulty", "estimated_minutes", "enabled", "curated", "content_characters").orderBy("index"), most)}


def uncurated(lessons: DataFrame) -> DataFrame:
    """Enabled lessons without curated content."""
    return lessons.where(F.col("enabled") & ~F.col("curated"))


def source_report(reports: DataFrame, *, most: int = MOST_ROWS) -> dict:
    """Counts by status and the rows of a collection."""
    columns = ["source_id", "source_name", "category", "status", "article_count", "http_status", "duration_seconds", "feed_title", "final_url", "warning", "error"]
    totals = report_status_counts(reports).first().asDict()
    return {"schema_version": 1, "summary": totals, "sources": rows_of(reports.select(*columns).orderBy("source_id"), most)}


def _table(head: list[str], rows: list[list[object]]) -> list[str]:
    cell = lambda x: "—" if x is None or x == "" else str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\r\n", " ").replace("\n", " ").replace("\r", " ")
    return [f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)]


def _aligned(pairs: list[tuple[str, object]]) -> list[str]:
    width = max(len(a) for a, _ in pairs) + 2
    return [f"- {a + ':':<{width}}{b}" for a, b in pairs]


def _percent(rate: float) -> str:
    return f"{rate * 100:.1f}%"


def _shown(record: dict, key: str) -> object:
    return _percent(record[key]) if key.endswith("rate") else f"{record[key]} min" if key.endswith("minutes") else record[key]


def content_text(report: dict) -> str:
    """A content report as plain text."""
    origins = [(a, report["content_origins"][k]) for a, k, _ in ORIGIN_LINES]
    if report["content_origins"].get("unknown"):
        origins.append((UNKNOWN_ORIGIN[0], report["content_origins"]["unknown"]))
    lines = [f"{CONTENT_TITLE} report", *_aligned([*((a, report[k]) for a, k, _ in CONTENT_LINES), (CONTENT_RATE, _percent(report["extraction_rate"])), *origins]), ""]
    if not report["records"]:
        return "\n".join([*lines, CONTENT_SECTIONS[report["problems_only"]][1]])
    for r in report["records"]:
        detail = r.get("error") or r.get("selector")
        lines += [f"[{r['index']:02d}] {STATUS_LABELS.get(r['status'], r['status'])} | {r['content_origin']} | {r['source_id']} | {r['word_count']} words | HTTP {r['http_status'] if r['http_status'] is not None else '-'}", f"     {r['title']}", f"     {r['url']}", *([f"     {detail}"] if detail else []), ""]
    return "\n".join(lines).rstrip()


def content_markdown(report: dict) -> str:
    """A content report as Markdown."""
    origins = [[label, report["content_origins"][k]] for _, k, label in ORIGIN_LINES]
    if report["content_origins"].get("unknown"):
        origins.append([UNKNOWN_ORIGIN[1], report["content_origins"]["unknown"]])
    lines = [f"## {CONTENT_TITLE}", "", *_table(["Metric", "Value"], [*([label, report[k]] for _, k, label in CONTENT_LINES), [CONTENT_RATE, _percent(report["extraction_rate"])]]), "", f"### {CONTENT_ORIGINS}", "", *_table(["Origin", "Articles"], origins), ""]
    lines += [f"### {CONTENT_SECTIONS[report['problems_only']][0]}", ""]
    if not report["records"]:
        return "\n".join([*lines, CONTENT_SECTIONS[report["problems_only"]][1]])
    link = lambda r: f"[{(r['title'] or '').replace(']', chr(92) + ']')}]({(r['url'] or '').replace(')', '%29')})"
    rows = [[r["index"], STATUS_LABELS.get(r["status"], r["status"]), r["content_origin"], r["source_id"], link(r), r["word_count"], r["http_status"], r.get("error") or r.get("selector")] for r in report["records"]]
    return "\n".join([*lines, *_table(CONTENT_HEAD, rows)])


def coverage_text(report: dict) -> str:
    """A coverage report as plain text."""
    facts = [(a, _shown(report, k)) for a, k, _ in COVERAGE_LINES]
    lines = [f"{COVERAGE_TITLE} curated coverage", *_aligned([*facts, (NEXT_LESSON, report["next_uncurated"] or "none")]), ""]
    if not report["records"]:
        return "\n".join([*lines, f"{NO_LESSONS}."])
    for r in report["records"]:
        lines += [f"[{r['index']:02d}] {_state(r).upper()} | {r['estimated_minutes']} min | {r['content_characters']} chars", f"     {r['title']}", f"     id:         {r['id']}", f"     track:      {r['track']}", f"     difficulty: {r['difficulty']}", ""]
    return "\n".join(lines).rstrip()


def coverage_markdown(report: dict) -> str:
    """A coverage report as Markdown."""
    rows = [[r["index"], _state(r), r["title"], r["track"], r["difficulty"], r["estimated_minutes"], r["content_characters"]] for r in report["records"]] or [["-", "-", NO_LESSONS, "-", "-", "-", "-"]]
    facts = [[label, _shown(report, k)] for _, k, label in COVERAGE_LINES if label]
    return "\n".join([f"## {COVERAGE_TITLE} coverage", "", *_table(["Metric", "Value"], facts), "", f"{NEXT_LESSON}: `{report['next_uncurated'] or 'none'}`", "", *_table(COVERAGE_HEAD, rows)])


def _state(r: dict) -> str:
    return "disabled" if not r["enabled"] else "curated" if r["curated"] else "web"


def source_text(report: dict) -> str:
    """A source report as a table of plain text, with a line of counts."""
    show: Callable[[object], str] = lambda x: "-" if x is None or x == "" else str(x)
    rows = [SOURCE_HEAD, *((r["source_id"], (r["status"] or "").upper(), show(r["http_status"]), show(r["article_count"]), show(r["duration_seconds"]), show(r["error"] or r["warning"] or r["feed_title"])) for r in report["sources"])]
    widths = [max(len(str(r[i])) for r in rows) for i in range(len(SOURCE_HEAD))]
    lines = [" | ".join(str(v).ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    s = report["summary"]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:], "", f"Summary: {s['success_count']} success, {s['warning_count']} warning, {s['failed_count']} failed, {s['article_count']} articles"])
