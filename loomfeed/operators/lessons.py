"""Lessons as records, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .content import CURATED, extract_content

# How a lesson is named in records.
SOURCE, EXTERNAL_PREFIX, TAG_PREFIX = "technical_learning", "learning:", "learning_lesson_id:"


def lessons_to_articles(lessons: DataFrame, generated_at: str, categories: dict[str, str], *, source_priority: int = 10) -> DataFrame:
    """Lessons in the article form: no dates, ordered distinct tags, curated content sanitised.

    A track without a category is an error when its row is read, and so is
    curated content of which nothing is left.
    """
    if isinstance(source_priority, bool) or not 1 <= source_priority <= 10:
        raise ValueError("source_priority must be between 1 and 10")
    table = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv)) if categories else F.lit(None).cast("map<string,string>")
    category = F.coalesce(strip(F.try_element_at(table, F.col("track"))), F.raise_error(F.concat(F.lit("no category for track "), F.coalesce("track", F.lit("NULL")))).cast("string"))
    curated = ~is_blank(F.col("content_html"))
    named = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    fixed = F.array(F.lit(SOURCE), named(TAG_PREFIX, "id"), named("learning_track:", "track"), named("difficulty:", "difficulty"), named("estimated_minutes:", "estimated_minutes"), F.when(curated, F.lit(CURATED)))
    tags = F.array_distinct(F.array_compact(F.concat(fixed, F.coalesce("topics", F.array().cast("array<string>")))))
    said = [strip(F.col("summary")), F.lit("Why it matters:"), strip(F.col("why_it_matters")), F.lit("Estimated reading time:"), F.concat(F.col("estimated_minutes").cast("string"), F.lit(" minutes.")), F.lit("Difficulty:"), F.concat("difficulty", F.lit("."))]
    body = F.when(curated, F.concat(F.lit('<article><div itemprop="articleBody">'), "content_html", F.lit("</div></article>")))
    made = lessons.withColumn("_x", extract_content(1)(body, F.col("url")))
    empty = F.raise_error(F.concat(F.lit("nothing is left of the content of lesson "), "id")).cast("string")
    content = lambda c: F.when(~curated, "").when(F.col("_x.status") == "extracted", F.col(f"_x.{c}")).otherwise(empty)
    return made.select(
        F.lit(SOURCE).alias("source_id"), "source_name", category.alias("category"), F.lit(source_priority).alias("source_priority"), tags.alias("source_tags"), "title", "url",
        F.concat(F.lit(EXTERNAL_PREFIX), "id").alias("external_id"), F.lit(None).cast("string").alias("published_at"), F.lit(None).cast("string").alias("updated_at"), F.concat_ws(" ", *said).alias("summary"),
        F.lit(None).cast("string").alias("author"), F.lit(generated_at).alias("fetched_at"), content("content_html").alias("content_html"), content("content_text").alias("content_text"),
        F.when(curated, "extracted").otherwise("not_requested").alias("content_status"),
    )


def lesson_id(external_id: Column, tags: Column) -> Column:
    """The lesson of a record, from its external id or its tags; null if it is none; ids that disagree are an error."""
    outer = F.when(external_id.startswith(EXTERNAL_PREFIX), F.nullif(strip(F.substr(external_id, F.lit(len(EXTERNAL_PREFIX) + 1))), F.lit("")))
    named = F.filter(F.transform(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.startswith(TAG_PREFIX)), lambda t: strip(F.substr(t, F.lit(len(TAG_PREFIX) + 1)))), lambda t: t != "")
    inner = F.try_element_at(named, F.lit(1))
    clash = (F.size(F.array_distinct(named)) > 1) | (outer.isNotNull() & inner.isNotNull() & (outer != inner))
    return F.when(F.coalesce(clash, F.lit(False)), F.raise_error(F.lit("conflicting lesson ids")).cast("string")).otherwise(F.coalesce(outer, inner))


def news_capacity(max_articles: int, lessons: int, included: bool) -> int:
    """Places for news beside lessons; 0 is a capacity, not an error."""
    return max(0, max_articles - lessons) if included else max_articles
