"""From articles to an edition: classify, deduplicate, rank, select, render, publish."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from urllib.parse import urlsplit
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.urls import is_http_url
from ..operators import content, curriculum, dedup, editions, quality, ranking, selection, timewindow, verification
from ..operators.lessons import SOURCE as LESSON_SOURCE
from ..operators.lessons import lesson_id, lessons_to_articles, news_capacity
from ..runtime import checkpoint
from ..sinks import digest, files, reports, site
from ..sources import documents, web
from ..sources.config import Library
from ..sources.documents import lesson_table


@dataclass(frozen=True)
class EditionSettings:
    project: str = "Digest"
    zone: str = "UTC"
    lookback_hours: float = 48
    max_articles: int = 20
    fill_unused_slots: bool = True
    scores: bool = True
    scoring: ranking.Scoring = field(default_factory=ranking.Scoring)


def edition(articles: DataFrame, categories: DataFrame, now: str, settings: EditionSettings, *, ordinal: str = "input_ordinal", lessons: DataFrame | None = None, capacity: int | None = None) -> dict[str, DataFrame]:
    """The frames of an edition: classified, deduplicated, ranked, selected and combined.

    Only what the window keeps is deduplicated, only unique records are
    scored, only scored rows are ranked; the scored rows are written once
    (checkpoint inside the ranking) and every later step reads them there.
    Contents stay out of all of that: they join the selected rows, at most
    ``max_articles``, at the end.
    """
    heavy = [c for c in ("content_html", "content_text") if c in articles.columns]
    classified = timewindow.classify_by_time(articles.drop(*heavy), settings.lookback_hours, now=now)
    kept = classified.where("time_status = 'kept'").drop("time_status")
    unique = dedup.deduplicate(kept, ordinal)
    scored = ranking.score(ranking.with_weights(unique.where("dedup_status = 'kept'"), categories), now, settings.scoring)
    ranked = ranking.ranked(scored, ordinal)
    room = settings.max_articles if capacity is None else capacity
    picked = checkpoint(selection.select_by_quota(ranked, categories, max_articles=room, fill_unused_slots=settings.fill_unused_slots))
    selected = checkpoint(articles.select(ordinal, *heavy).join(F.broadcast(picked), ordinal)) if heavy else picked
    combined = selected if lessons is None else editions.union_sections(news=selected, lessons=lessons)
    return {"classified": classified, "unique": unique, "ranked": ranked, "selected": selected, "combined": combined}


@dataclass(frozen=True)
class Learning:
    """A curriculum in an edition: its lessons as ranked records, in order, and the places that are left for news."""

    lessons: DataFrame
    ids: list[str]
    capacity: int
    facts: dict


def prepare_lessons(library: Library, history: DataFrame, categories: DataFrame, now: str, settings: EditionSettings, category_of_track: dict[str, str]) -> Learning | None:
    """The lessons of the edition of ``now``'s local date; none if the selection is disabled.

    Lessons that count among the articles take their places; more of them than
    there are places is a ValueError.
    """
    selection = library.selection
    if not selection["enabled"]:
        return None
    spark = categories.sparkSession
    count = selection["daily_count"]
    lessons = lesson_table(spark, library.lessons)
    curriculum.check_curriculum(lessons, count, selection["history_source"])
    included = selection["include_in_max_articles"]
    if included and count > settings.max_articles:
        raise ValueError(f"{count} lessons are more than the {settings.max_articles} articles of an edition")
    date = local_day(now, selection["timezone"])
    chosen = checkpoint(curriculum.choose_lessons(lessons, history, date, count))
    articles = lessons_to_articles(chosen, now, category_of_track).withColumn("input_ordinal", F.monotonically_increasing_id())
    ranked = ranking.ranked(ranking.score(ranking.with_weights(articles, categories), now, settings.scoring), "input_ordinal")
    ordered = curriculum.ranked_in_order(chosen, ranked).drop("rank_index").withColumnRenamed("pick", "rank_index")
    rows = chosen.orderBy("pick").select("id", "previous", "reused", "cycle_reset").collect()  # a day's lessons
    facts = {"evaluated_date": date, "requested_lessons": count, "available_lessons": sum(x["enabled"] for x in library.lessons), "selected_lesson_ids": [r.id for r in rows], "previous_lesson_id": rows[0].previous, "reused_current_edition": rows[0].reused, "cycle_reset": rows[0].cycle_reset}
    return Learning(checkpoint(ordered), [r.id for r in rows], news_capacity(settings.max_articles, len(rows), included), facts)


def local_day(now: str, zone: str) -> str:
    """The local date of an instant; one without a zone is UTC."""
    at = datetime.fromisoformat(now.strip().replace("Z", "+00:00"))
    return f"{(at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(ZoneInfo(zone)):%Y-%m-%d}"


def with_contents(combined: DataFrame, *, seconds: float = 15, most_bytes: int = 5_000_000, transport: web.Transport = web.over_http) -> tuple[DataFrame, DataFrame]:
    """``(articles, records)``: an edition's articles with the contents of their pages, and the log of retrieval. Only rows without contents of their own are fetched."""
    wanted = combined.where(is_blank(F.col("content_html")) & is_blank(F.col("content_text")) & is_http_url(F.col("url")))
    pages = checkpoint(web.fetch_pages(wanted, seconds=seconds, most_bytes=most_bytes, transport=transport))
    full = checkpoint(content.enrich(combined, pages, maximum_bytes=most_bytes))
    return full, content.enrichment_records(full, pages)


def write_edition(
    frames: dict[str, DataFrame], categories: DataFrame, generated_at: str, output: str, settings: EditionSettings, *,
    site_dir: str | None = None, learning: Learning | None = None, full: DataFrame | None = None, records: DataFrame | None = None,
) -> dict:
    """Write payload and digests of an edition, and publish it if asked.

    Public documents hold no contents. With ``full`` (the articles with their
    contents) and ``records`` a second book holds them, and the payload the
    log of their retrieval.
    """
    order = [c for c in ("section", "rank_index") if c in frames["combined"].columns]
    most = settings.max_articles + (len(learning.ids) if learning else 0)
    public = editions.redact(frames["combined"])
    rows = files.rows_of(public.orderBy(*order), most)
    dims = files.rows_of(categories, 1000)
    summary = {
        "time_filter": timewindow.status_counts(frames["classified"]).first().asDict(),
        "deduplication": dedup.dedup_summary(frames["unique"]).first().asDict(),
        "ranking": ranking.ranking_summary(frames["ranked"]).first().asDict(),
        "selection": selection.selection_summary(frames["ranked"], frames["selected"]).first().asDict(),
    }
    out = Path(output)
    common = {"generated_at": generated_at, "project": settings.project, "zone": settings.zone}
    if full is not None:
        logged = reports.content_report(records.withColumn("_order", F.struct(*order)), order="_order", most=most)
        named = dict(zip(verification.LOGGED, ("requested_count", "extracted_count", "fallback_count", "failed_count"), strict=True))
        summary["content_enrichment"] = {k: logged[v] for k, v in named.items()} | {k: logged[k] for k in ("extraction_rate", "content_origins", "records")}
        files.write_bytes(out / "digest-full.epub", digest.epub(files.rows_of(full.orderBy(*order), most), dims, **common))
    if learning:
        summary["learning"] = learning.facts
    payload = files.ranked_payload(frames["combined"], {"name": settings.project}, generated_at, summary, most=most, lesson_ids=learning.ids if learning else None)
    files.write_json(out / "ranked_articles.json", payload)
    files.write_text(out / "digest.md", digest.markdown(rows, dims, scores=settings.scores, **common))
    files.write_text(out / "digest.html", digest.html(rows, dims, scores=settings.scores, epub_href="digest.epub", **common))
    files.write_bytes(out / "digest.epub", digest.epub(rows, dims, **common))
    return {"summary": summary, "article_count": len(rows), "site": site.publish(out, site_dir, zone=settings.zone, title=settings.project) if site_dir else None}


def verify_edition(spark: SparkSession, output: str, site_dir: str, *, expected_total: int = 20, expected_lessons: int = 1) -> DataFrame:
    """Checks of what an edition wrote and published: ``check_name, passed, failing``; missing or unreadable documents raise."""
    out, place = Path(output), Path(site_dir)
    if expected_lessons > expected_total or min(expected_lessons, expected_total) < 0:
        raise ValueError("expected lessons must be between 0 and the expected total")
    current, archived = read_edition(out / "ranked_articles.json"), None
    archive = documents.latest_payload(documents.read_payloads(spark, str(place / "archive"), name="ranked_articles.json")).first()
    if archive is None:
        raise FileNotFoundError(f"{place / 'archive'} holds no payload")
    archived_at = Path(urlsplit(archive.path).path)
    archived = read_edition(archived_at)
    articles = spark.createDataFrame([(i, a.get("url"), a.get("title"), a.get("category"), a.get("source_tags"), a.get("external_id"), a.get("source_id"), a.get("content_html"), a.get("content_text"), a.get("content_status")) for i, a in enumerate(current["articles"])],
                                     "pos int, url string, title string, category string, source_tags array<string>, external_id string, source_id string, content_html string, content_text string, content_status string")
    lessons = articles.where(F.col("source_id") == LESSON_SOURCE).withColumn("lesson_id", lesson_id(F.col("external_id"), F.col("source_tags")))
    ids = lambda p: spark.createDataFrame(list(enumerate((p.get("learning") or {}).get("lesson_ids") or [])), "pos int, lesson_id string")
    log = content_log(current)
    records = spark.createDataFrame([tuple(r.get(k) for k in ("source_id", "title", "status", "http_status", "content_origin")) for r in log.get("records") or []], "source_id string, title string, status string, http_status int, content_origin string")
    stated = lambda p: spark.createDataFrame([tuple(content_log(p).get(k) for k in verification.LOGGED)], ", ".join(f"{k} int" for k in verification.STATED)).withColumn("edition", F.lit(0))
    day = "-".join(archived_at.parent.parts[-3:])
    digests = quality.file_digests(spark, str(out)).unionByName(quality.file_digests(spark, str(place)))
    titles = [r.title for r in lessons.select("title").collect()]  # an edition's lessons
    chapter = digest.anchors(["Technical Learning"], ascii_only=True)[0] if titles else None
    book = lambda name, n: verification.epub_checks(documents.zip_members(spark, str(out / name)), articles=len(current["articles"]), full_content=n, chapter=chapter, titles=titles)
    named = lambda head, df: df.withColumn("check_name", F.concat(F.lit(f"{head}: "), "check_name"))
    catalog = spark.read.text(str(place / "opds" / "catalog.xml"), wholetext=True)
    different = lambda a, b: verification.as_checks(verification.same_values(stated(a), stated(b), "edition").agg(F.count(F.lit(1)).alias("counters_as_archived")))
    return verification.all_checks(
        named("payload", quality.public_checks(articles.select("url", "content_html", "content_text", "content_status"), expected_total)),
        named("payload", verification.as_checks(spark.createDataFrame([(abs((current.get("article_count") or 0) - len(current["articles"])),)], "article_count_as_listed int"))),
        named("lessons", verification.lesson_id_checks(ids(current), lessons, expected=expected_lessons)),
        named("archive", verification.lesson_id_checks(ids(archived), lessons)),
        named("contents", verification.counter_checks(stated(current), records)),
        named("contents", verification.lesson_content_checks(records.where(F.col("source_id") == LESSON_SOURCE), lessons)),
        named("archive", different(current, archived)),
        named("public book", book("digest.epub", 0)),
        named("full book", book("digest-full.epub", int(log.get("extracted_articles") or 0))),
        named("public book", verification.copy_checks(digests, f"{out.name}/digest.epub", [f"{place.name}/digest.epub", f"{place.name}/latest/digest.epub"])),
        named("full book", verification.copy_checks(digests, f"{out.name}/digest-full.epub", [f"{place.name}/digest-full.epub", f"{place.name}/opds/{site.BOOKS}/{day}.epub"])),
        named("catalog", verification.catalog_checks(catalog, f"{site.BOOKS}/{day}.epub", f"urn:edition:{day}")),
    )


def content_log(payload: dict) -> dict:
    """The log of contents of a payload, wherever its summary keeps it; empty if there is none."""
    summary = payload["summary"]
    found = (summary.get("processing") or summary).get("content_enrichment")
    return found if isinstance(found, dict) else {}


def read_edition(path: Path) -> dict:
    """A payload with a summary and a list of articles; ValueError if it is none."""
    data = json.loads(path.read_text("utf-8"))
    if not isinstance(data, dict) or not isinstance(data.get("articles"), list) or not isinstance(data.get("summary"), dict):
        raise ValueError(f"{path} is no payload of an edition")
    return data
