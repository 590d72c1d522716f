"""Checks of a published edition: each a row ``check_name, passed, failing``.

``failing`` counts the offending rows, so a check of a large table is one
aggregation. Checks over files (EPUB, catalog) read them with the built-in
binary and text sources.
"""

from __future__ import annotations

from functools import reduce
from html import escape

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .aggregates import ORIGINS, STATUS_ORIGINS, origin_of
from .content import CURATED
from .lessons import SOURCE

# The marks of a catalog of books.
ATOM_CATALOG = "application/atom+xml;profile=opds-catalog;kind=acquisition"
EPUB_TYPE, ACQUISITION = "application/epub+zip", "http://opds-spec.org/acquisition"

STATED = ["requested", "extracted", "summary_fallback", "fetch_failed"]
#: The same counters in a payload's log of contents.
LOGGED = ["requested_articles", "extracted_articles", "summary_fallback_articles", "failed_articles"]


def as_checks(row: DataFrame) -> DataFrame:
    """A row of counts of offences as checks."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    each = (F.struct(F.lit(c).alias("check_name"), (count(c) == 0).alias("passed"), count(c).alias("failing")) for c in row.columns)
    return row.select(F.inline(F.array(*each)))


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def status_of(records: DataFrame) -> Column:
    return F.lower(strip(records["status"]))


def counter_checks(stated: DataFrame, records: DataFrame) -> DataFrame:
    """Stated counters (one row: requested, extracted, summary_fallback, fetch_failed) against those of the records.

    Also whether the counters add up, and whether each record's status and
    origin are known and go together. An offence of a counter is the size of
    its difference.
    """
    status, origin = status_of(records), origin_of(records)
    known = F.coalesce(status.isin(list(STATUS_ORIGINS)), F.lit(False))
    allowed = reduce(Column.__or__, ((status == s) & origin.isin(o) for s, o in STATUS_ORIGINS.items()))
    derived = records.agg(
        F.count(F.lit(1)).alias("_requested"),
        *(F.count_if(status == s).alias(f"_{s}") for s in STATUS_ORIGINS),
        F.count_if(~known).alias("_status"),
        F.count_if(~origin.isin([o for o in ORIGINS if o != "unknown"])).alias("_origin"),
        F.count_if(known & ~F.coalesce(allowed, F.lit(False))).alias("_pair"),
    )
    both = stated.select(*STATED).join(F.broadcast(derived))  # one row each
    given = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return as_checks(both.select(
        F.abs(given("requested") - F.col("extracted") - F.col("summary_fallback") - F.col("fetch_failed")).alias("counters_add_up"),
        *(F.abs(given(c) - F.col(f"_{c}")).alias(f"{c}_as_stated") for c in STATED),
        F.col("_status").alias("status_known"), F.col("_origin").alias("origin_known"), F.col("_pair").alias("origin_allowed"),
    ))


def lesson_id_checks(stated: DataFrame, articles: DataFrame, *, expected: int | None = None) -> DataFrame:
    """Lesson ids of the metadata (``pos, lesson_id``) against those of the lesson articles (``pos, lesson_id, category``): the same ids in the same order, each once."""
    a = stated.select(F.row_number().over(_by("pos")).alias("n"), F.col("lesson_id").alias("one"))
    b = articles.select(F.row_number().over(_by("pos")).alias("n"), F.col("lesson_id").alias("two"))
    order = a.join(b, "n", "full").agg(F.count_if(~F.col("one").eqNullSafe(F.col("two"))).alias("ids_as_stated"))
    own = articles.agg(
        (F.count("lesson_id") - F.count_distinct("lesson_id")).alias("ids_unique"), F.count_if(is_blank(F.col("lesson_id"))).alias("ids_given"),
        F.count_if(~F.coalesce(F.col("category") == SOURCE, F.lit(False))).alias("category_of_lessons"), F.abs(F.count(F.lit(1)) - (F.lit(expected) if expected is not None else F.count(F.lit(1)))).alias("lessons_expected"),
    )
    return as_checks(order.join(F.broadcast(own)))


def _by(column: str) -> WindowSpec:
    return Window.orderBy(column)  # the lessons of one edition: few


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, side`` of the distinct keys that only one side has; a null key is a key."""
    a = left.select(F.col(key)).distinct().withColumn("_l", F.lit(True))
    b = right.select(F.col(key).alias("_k")).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, F.col(key).eqNullSafe(F.col("_k")), "full")
    side = F.when(F.col("_r").isNull(), "left").otherwise("right")
    return both.where("_l IS NULL OR _r IS NULL").select(F.when(F.col("_l"), F.col(key)).otherwise(F.col("_k")).alias(key), side.alias("side"))


def lesson_content_checks(records: DataFrame, articles: DataFrame, key: str = "title") -> DataFrame:
    """Content records of lessons against their articles: the same titles on both sides, curated lessons extracted from curated content, others neither curated nor failed."""
    marked = articles.select(key, F.coalesce(F.array_contains("source_tags", CURATED), F.lit(False)).alias("_curated")).groupBy(key).agg(F.max("_curated").alias("_curated"))
    status, origin = status_of(records), origin_of(records)
    row = records.withColumns({"_status": status, "_origin": origin}).join(marked, key)
    content = row.agg(
        F.count_if(F.col("_curated") & ~F.coalesce(F.col("_status") == "extracted", F.lit(False))).alias("curated_extracted"),
        F.count_if(F.col("_curated") & (F.col("_origin") != "curated")).alias("curated_origin"),
        F.count_if(~F.col("_curated") & (F.col("_origin") == "curated")).alias("others_not_curated"),
        F.count_if(~F.col("_curated") & (F.col("_status") == "fetch_failed")).alias("others_not_failed"),
    )
    sides = one_sided(records, articles, key).agg(F.count_if(F.col("side") == "left").alias("records_have_articles"), F.count_if(F.col("side") == "right").alias("articles_have_records"))
    return all_checks(as_checks(content), as_checks(sides))


def same_values(current: DataFrame, archived: DataFrame, key: str) -> DataFrame:
    """``key`` of the rows that differ in any common column, or that one side lacks; keys are unique on each side."""
    columns = [c for c in current.columns if c in archived.columns and c != key]
    a, b = (df.select(key, F.struct(*columns).alias(n)) for df, n in ((current, "_a"), (archived, "_b")))
    return a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def copy_checks(digests: DataFrame, original: str, copies: list[str]) -> DataFrame:
    """Of ``path, digest`` rows: copies (ends of paths) that differ from the original, and whether one was found."""
    ends = lambda end: F.col("path").endswith(end)
    want = digests.where(ends(original)).agg(F.min("digest").alias("_want"))
    found = digests.where(reduce(Column.__or__, map(ends, copies))).join(F.broadcast(want))
    row = found.agg(F.count_if(~F.coalesce(F.col("digest") == F.col("_want"), F.lit(False))).alias("copies_equal"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("copy_found"))
    return as_checks(row)


# The link to each article's original, the mark of a full text, the text of links that a book mustn't hold, and the rules of the style sheet that keep each article on pages of its own.
ORIGINAL, FULL_TEXT, LEFTOVER = ">Original source</a>", 'class="article-content full-content', "Read the original article"
PAGE_RULES = ["article + article", "break-before: page;", "page-break-before: always;", "break-inside: auto;", "page-break-inside: auto;"]


def epub_checks(members: DataFrame, *, articles: int, full_content: int, chapter: str | None = None, titles: list[str] | None = None) -> DataFrame:
    """An EPUB's members (``member, text, error``): sound, one link to the original per article, so many full texts, page breaks, no leftover link, the titles in their chapter."""
    page = F.col("member").endswith(".xhtml") & ~F.col("member").endswith("nav.xhtml")
    many = lambda mark: F.sum(F.when(page, F.regexp_count("text", F.lit(mark))).otherwise(0))
    style = F.max(F.when(F.col("member").endswith(".css"), F.col("text")))
    lost = lambda needles, text: sum((F.when(F.coalesce(text.contains(n), F.lit(False)), 0).otherwise(1) for n in needles), F.lit(0))
    counted = members.agg(
        F.count_if(F.col("error").isNotNull()).alias("sound"),
        F.abs(many(ORIGINAL) - articles).alias("links_to_originals"),
        F.abs(many(FULL_TEXT) - full_content).alias("full_texts"),
        many(LEFTOVER).alias("no_leftover_link"),
        style.alias("_style"),
        F.max(F.when(F.col("member").endswith(f"/{chapter}.xhtml"), F.col("text"))).alias("_chapter"),
    )
    made = counted.withColumns({"page_breaks": lost(PAGE_RULES, F.col("_style")), "titles_in_chapter": lost([escape(t) for t in titles or []], F.col("_chapter"))})
    return as_checks(made.drop("_style", "_chapter"))


def catalog_checks(catalog: DataFrame, href: str, edition_id: str) -> DataFrame:
    """A catalog (``value``: the whole document): a feed with one self link of the right type, and one entry whose acquisition link is ``href``, of the right type and id."""
    kind = lambda path: F.xpath("value", F.lit(path))
    local = lambda name: f"*[local-name()='{name}']"
    feed = f"/{local('feed')}"
    entry = f"{feed}/{local('entry')}[{local('link')}[@rel='{ACQUISITION}' and @href='{href}']]"
    first = lambda path: F.coalesce(strip(F.xpath_string("value", F.lit(path))), F.lit(""))
    row = catalog.select(
        F.when(F.size(kind(f"{feed}/{local('title')}/text()")) > 0, 0).otherwise(1).alias("is_feed"),
        F.abs(F.size(kind(f"{feed}/{local('link')}[@rel='self']/@href")) - 1).alias("one_self_link"),
        F.when(first(f"{feed}/{local('link')}[@rel='self']/@type") == ATOM_CATALOG, 0).otherwise(1).alias("type_of_self_link"),
        F.when(F.size(kind(f"{feed}/{local('entry')}/{local('id')}/text()")) > 0, 0).otherwise(1).alias("has_entries"),
        F.abs(F.size(kind(f"{feed}/{local('entry')}/{local('link')}[@rel='{ACQUISITION}' and @href='{href}']/@href")) - 1).alias("one_entry"),
        F.when(first(f"{entry}/{local('link')}[@rel='{ACQUISITION}']/@type") == EPUB_TYPE, 0).otherwise(1).alias("type_of_book"),
        F.when(first(f"{entry}/{local('id')}") == edition_id, 0).otherwise(1).alias("id_of_edition"),
    )
    return as_checks(row)
