"""Registry of the core queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times, urls
from ..operators import aggregates, content, curriculum, dedup, editions, history, quality, ranking, selection, timewindow, verification
from ..operators.lessons import SOURCE as LESSON_SOURCE
from ..sinks import reports
from ..sources.documents import latest_payload
from ..operators.timestamps import restated_timestamps
from ..runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the queries.
NOW = "2026-02-01 00:00:00"
LOOKBACK_HOURS = 24 * 60
MAX_ARTICLES = 40
SAME_DAY, LATER_DAY = "2025-12-05", "2026-01-20"
SCORING = ranking.Scoring(
    high_keywords=ranking.keyword_list(["compiler", "kernel", "firmware", "tokenizer", "notes", "brings", "inside", "Übersetzer", "câble"]),
    low_keywords=ranking.keyword_list(["weekly", "workshop", "roundup"]),
)

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "article").select("article_id", "source_id", "published_at", "updated_at"))
    return restated_timestamps(a, table(spark, d, "source_clock"), "article_id", ["published_at", "updated_at"])


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return timewindow.classify_by_time(table(spark, d, "article"), LOOKBACK_HOURS, now=NOW)


def _unique(spark: SparkSession, d: str) -> DataFrame:
    kept = _classified(spark, d).where("time_status = 'kept'").drop("time_status", "content_html", "content_text")
    return dedup.deduplicate(kept, "article_id").where("dedup_status = 'kept'")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    weighted = ranking.with_weights(_unique(spark, d), table(spark, d, "category_profile"))
    return ranking.score(weighted, NOW, SCORING)


@query
def time_window_status(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("article_id", "time_status")


@query
def time_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return timewindow.status_counts(_classified(spark, d))


@query
def iso_instants(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article")
    return a.select("article_id", times.to_iso_z(times.iso_instant(F.col("published_at"))).alias("published_utc"))


@query
def freshness_bands(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article").withColumn("t", times.event_instant(F.col("published_at"), F.col("updated_at")))
    a = a.withColumn("s", times.freshness_seconds(F.col("t"), NOW))
    return a.select("article_id", F.coalesce(F.floor("s"), F.lit(-1)).alias("age_seconds"), ranking.freshness_points(F.col("s")).alias("points"))


@query
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article").select("article_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query
def url_dedup_best(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(table(spark, d, "article"), "article_id").select("article_id", "dedup_status", F.coalesce("group_ordinal", F.lit(-1)).alias("group_ordinal"))


@query
def url_dedup_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_best_windowed(table(spark, d, "article"), "article_id").select("article_id", "canonical_url")


@query
def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_summary(dedup.deduplicate(table(spark, d, "article"), "article_id"))


@query
def category_join_weight(spark: SparkSession, d: str) -> DataFrame:
    return ranking.with_weights(table(spark, d, "article"), table(spark, d, "category_profile")).select("article_id", "category_weight")


@query
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    weighted = ranking.with_weights(table(spark, d, "article"), table(spark, d, "category_profile"))
    s = ranking.score(weighted, NOW, SCORING)
    return s.select("article_id", "score", F.size("matched_high_priority_keywords").alias("high_hits"), F.size("matched_low_priority_keywords").alias("low_hits"))


@query
def score_reasons(spark: SparkSession, d: str) -> DataFrame:
    weighted = ranking.with_weights(table(spark, d, "article"), table(spark, d, "category_profile"))
    return ranking.score(weighted, NOW, SCORING).select("article_id", F.array_join("score_reasons", "; ").alias("reasons"))


@query
def ranking_order(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(_scored(spark, d), "article_id").select("article_id", "score", F.col("rank_index").cast("long").alias("rank_index"))


def _selected(spark: SparkSession, d: str, fill: bool) -> DataFrame:
    ranked = ranking.ranked(_scored(spark, d), "article_id")
    return selection.select_by_quota(ranked, table(spark, d, "category_profile"), max_articles=MAX_ARTICLES, fill_unused_slots=fill)


@query
def quota_select(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d, True).select("article_id", "category", F.col("rank_index").cast("long").alias("rank_index"), "within_quota")


@query
def quota_select_nofill(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d, False).select("article_id", "category", F.col("rank_index").cast("long").alias("rank_index"))


@query
def selection_counts_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return selection.category_counts(_selected(spark, d, True), table(spark, d, "category_profile"))


@query
def deferred_except(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.ranked(_scored(spark, d), "article_id")
    picked = selection.select_by_quota(ranked, table(spark, d, "category_profile"), max_articles=MAX_ARTICLES)
    return selection.deferred(ranked, picked).select("article_id")


@query
def union_sections(spark: SparkSession, d: str) -> DataFrame:
    lessons = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    news = table(spark, d, "article").select(F.col("article_id").alias("item_id"), "title")
    return editions.union_sections(news=news, lessons=lessons)


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.report_status_counts(table(spark, d, "source_report"))


@query
def enrichment_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.enrichment_counts(table(spark, d, "enrichment_record"))


@query
def origin_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.origin_counts(table(spark, d, "enrichment_record"))


@query
def enrichment_problems(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.problems(table(spark, d, "enrichment_record")).groupBy(F.lower(text.strip(F.col("status"))).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def group_sorted_list(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.sources_by_category(table(spark, d, "feed_source"))


@query
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.duplicate_keys(table(spark, d, "article").where("external_id IS NOT NULL"), "external_id")


@query
def unknown_category_anti(spark: SparkSession, d: str) -> DataFrame:
    profile = table(spark, d, "category_profile").where("weight >= 10")
    return ranking.unknown_categories(table(spark, d, "feed_source"), profile).select("id", "category")


@query
def source_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.source_violations(table(spark, d, "feed_source").withColumn("priority", F.col("priority") + 2))


@query
def reconcile_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.enrichment_checks(table(spark, d, "enrichment_record"))


@query
def report_article_mismatch(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article").select("category")
    r = table(spark, d, "source_report").select("category")
    return quality.same_rows(a, r, "category")


@query
def asof_previous(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    buys = e.where("event_type = 'purchase'")
    return history.asof_previous(e, buys, "user_id", "ts", "event_id", "previous_purchase").select("event_id", F.coalesce("previous_purchase", F.lit(-1)).alias("previous_purchase"))


@query
def history_previous_lesson(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "source_report").groupBy(F.substring("started_at", 1, 10).alias("date")).agg(F.sort_array(F.collect_set("source_id")).alias("lesson_ids"))
    rows = made.withColumn("path", F.concat(F.lit("editions/"), "date"))
    lessons = table(spark, d, "feed_source").where("enabled").select("id")
    return history.previous_lesson(rows, lessons, NOW[:10]).select("date", "lesson_id")


@query
def rotation_next(spark: SparkSession, d: str) -> DataFrame:
    lessons = table(spark, d, "feed_source").select("id", "enabled", F.col("priority").alias("order"))
    last = "willow_wire"
    return history.rotate(lessons, last, 7).select("id", F.col("pick").cast("int").alias("pick"), "cycle_reset")


@query
def edition_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("date"), "o_orderkey")
    old = o.groupBy("date").agg(F.min("o_orderkey").alias("article_count"), F.lit("old").alias("version"))
    new = o.where("date >= '1996-01-01'").groupBy("date").agg(F.max("o_orderkey").alias("article_count"), F.lit("new").alias("version"))
    return editions.upsert(old, new, "date")


@query
def redact_public(spark: SparkSession, d: str) -> DataFrame:
    return editions.redact(table(spark, d, "article")).select("article_id", "title", "content_html", "content_text", "content_status")


@query
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query
def truncate_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article").select("article_id", text.truncate(F.col("summary"), 80).alias("short"))


@query
def local_date_label(spark: SparkSession, d: str) -> DataFrame:
    t = times.iso_instant(F.col("fetched_at"))
    return table(spark, d, "article").select("article_id", times.local_date(t, "Asia/Ho_Chi_Minh").alias("local_date"), times.local_label(t, "Asia/Ho_Chi_Minh").alias("label"))


@query
def text_escapes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "article").select("article_id", text.escape_markdown(t).alias("md"), text.escape_html(t).alias("html"), text.slug(t, ascii_only=True).alias("slug"), text.collapse(t).alias("plain"))


@query
def category_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article").groupBy(text.humanise(F.col("category")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def props_json_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query
def tag_membership(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article")
    return a.select("article_id", F.array_contains("source_tags", "compiler").alias("has_compiler"), F.size(F.filter("source_tags", lambda t: t.startswith("c"))).alias("c_tags"), F.array_join("source_tags", " ").alias("tags"))


@query
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "article").where(~text.is_blank(F.col("content_html"))).select("article_id", "url", "content_html")
    x = pages.select("article_id", content.extract_content(250)(F.col("content_html"), F.when(urls.is_http_url(F.col("url")), F.col("url"))).alias("x"))
    return x.select("article_id", "x.status", "x.selector", "x.word_count")


@query
def html_visible_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "article").where(~text.is_blank(F.col("content_html")))
    return pages.select("article_id", F.length(content.clean_html(F.col("content_html"))).alias("visible_chars"))


def _lessons(spark: SparkSession, d: str) -> DataFrame:
    """The sources as a curriculum."""
    s = table(spark, d, "feed_source")
    return s.select("id", F.col("priority").alias("order"), "enabled", F.col("official").alias("curated"), (F.col("priority") * 3).alias("estimated_minutes"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    """The batches of the source reports as editions, their sources as lessons."""
    r = table(spark, d, "source_report")
    made = r.groupBy(F.substring("started_at", 1, 10).alias("date"), "batch_no").agg(F.sort_array(F.collect_set("source_id")).alias("lesson_ids"))
    return made.select("date", F.format_string("editions/%06d", F.col("batch_no")).alias("path"), "lesson_ids")


@query
def lessons_reused(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.choose_lessons(_lessons(spark, d), _history(spark, d), SAME_DAY, 5).select("id", F.col("pick").cast("int").alias("pick"), "previous", "reused", "cycle_reset")


@query
def lessons_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.choose_lessons(_lessons(spark, d), _history(spark, d), LATER_DAY, 20).select("id", F.col("pick").cast("int").alias("pick"), "previous", "reused", "cycle_reset")


@query
def lesson_ids_in_order(spark: SparkSession, d: str) -> DataFrame:
    ids = history.exploded_history(_history(spark, d)).select("path", "pos", "lesson_id")
    known = _lessons(spark, d).where("enabled")
    return ids.join(known.select(F.col("id").alias("lesson_id"), "order"), "lesson_id").select("path", F.col("pos").cast("int").alias("pos"), "lesson_id", "order")


@query
def ranked_lessons(spark: SparkSession, d: str) -> DataFrame:
    chosen = curriculum.choose_lessons(_lessons(spark, d), _history(spark, d), LATER_DAY, 20)
    s = table(spark, d, "feed_source")
    ranked = s.select(F.concat(F.lit("learning:"), "id").alias("external_id"), F.array(F.concat(F.lit("learning_lesson_id:"), "id")).alias("source_tags"), "url", (F.col("priority") * 2).alias("score"))
    return curriculum.ranked_in_order(chosen, ranked).select("external_id", "url", F.col("pick").cast("int").alias("pick"), "score")


@query
def previous_lesson_each_day(spark: SparkSession, d: str) -> DataFrame:
    days = _history(spark, d).select("date").distinct().select(F.to_timestamp("date").alias("t"), "date", F.lit("site").alias("site"))
    known = history.exploded_history(_history(spark, d)).join(_lessons(spark, d).where("enabled").select(F.col("id").alias("lesson_id")), "lesson_id", "left_semi")
    last = known.groupBy("date").agg(F.max(F.struct("path", "pos", "lesson_id"))["lesson_id"].alias("lesson_id")).select(F.to_timestamp("date").alias("t"), F.lit("site").alias("site"), "lesson_id")
    return history.asof_previous(days, last, "site", "t", "lesson_id", "previous").select("date", "previous")


@query
def uncurated_lessons(spark: SparkSession, d: str) -> DataFrame:
    return reports.uncurated(_lessons(spark, d)).select("id", "order")


@query
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.coverage(_lessons(spark, d))


@query
def report_index(spark: SparkSession, d: str) -> DataFrame:
    return reports.numbered(table(spark, d, "feed_source"), "name", "id").select("id", "index")


def _stated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Counters of the records without their repetitions, and all records."""
    records = table(spark, d, "enrichment_record")
    once = aggregates.enrichment_counts(records.distinct())
    named = dict(zip(verification.STATED, ("requested_count", "extracted_count", "fallback_count", "failed_count"), strict=True))
    return once.select(*(F.col(v).alias(k) for k, v in named.items())), records


@query
def counter_checks(spark: SparkSession, d: str) -> DataFrame:
    return verification.counter_checks(*_stated(spark, d))


@query
def lesson_content_checks(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article").select("title", F.when(F.array_contains("source_tags", "compiler"), F.array(F.lit(content.CURATED))).alias("source_tags"))
    return verification.lesson_content_checks(table(spark, d, "enrichment_record"), a)


@query
def titles_on_one_side(spark: SparkSession, d: str) -> DataFrame:
    return verification.one_sided(table(spark, d, "enrichment_record"), table(spark, d, "article"), "title")


@query
def lesson_id_checks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "feed_source")
    stated = s.select(F.col("id").alias("pos"), F.col("id").alias("lesson_id"))
    articles = s.where("enabled").select(F.concat(F.col("priority").cast("string"), "id").alias("pos"), F.col("id").alias("lesson_id"), F.when(F.col("official"), LESSON_SOURCE).otherwise(F.col("category")).alias("category"))
    return verification.lesson_id_checks(stated, articles, expected=50)


@query
def counts_as_archived(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "enrichment_record")
    per = lambda df: df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"), F.min("http_status").alias("least"))
    return verification.same_values(per(r), per(r.distinct()), "source_id")


@query
def copy_checks(spark: SparkSession, d: str) -> DataFrame:
    digests = table(spark, d, "documents").select(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"))
    return verification.copy_checks(digests, "/100", ["7", "9"])


@query
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query
def latest_report(spark: SparkSession, d: str) -> DataFrame:
    r = _history(spark, d).select(F.concat("path", F.lit("/ranked_articles.json")).alias("path"), "date")
    return latest_payload(r).select("path", "date")


@query
def nested_ids(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "duplicate_group")
    each = lambda c: F.transform("duplicate_articles", lambda m: m[c])
    return g.select("group_id", F.array_join(history.payload_ids(F.array("kept_article.external_id"), each("external_id"), each("category"), F.array("kept_article.category")), "|").alias("ids"))


@query
def ranking_summary(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranking_summary(_scored(spark, d))


@query
def public_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.public_checks(table(spark, d, "article"), 1000)


@query
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article")
    return a.select(
        "article_id", text.optional(F.col("author")).alias("author"), text.inline_spaces(F.col("summary")).alias("inline"), text.pluralise(F.length("title"), "letter").alias("letters"),
        urls.origin(F.col("url")).alias("origin"), text.slug(F.col("category")).alias("slug"), text.escape_markdown_link(F.col("url")).alias("link"), text.escape_markdown_cell(F.col("summary")).alias("cell"),
    )


@query
def media_types(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "enrichment_record")
    given = F.concat(F.initcap(F.coalesce("content_type", F.lit(""))), F.lit(" ; charset=utf-8"))
    return r.select("record_id", text.media_type(given).alias("kind"), text.media_type(F.col("content_type")).alias("plain")).distinct()


FLAGSHIP = quota_select
