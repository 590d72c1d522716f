"""Find lines that recur within one source, and take them out of its texts.

Documents whose texts are equal collapse to one cluster with a multiplicity
first. Each line is then counted over clusters, over publication days and,
with the multiplicities, over documents. A document counts once per line.

Scale: lines travel as 64-bit hashes. The first count is by cluster, a record
for each line of each distinct text; the second, by line, is combined before
its shuffle, so a line that is in every document of a hot source costs one
record per task there. Only the list of recurring lines is joined back; it is
broadcast if its counted size is below a limit. Beyond it lines meet their
source's list with hot lines by broadcast, and texts meet it with the texts of
a hot source dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, is_blank
from ..operators.timestamps import normalise_timestamps, source_key
from ..runtime import checkpoint, join_hot, join_salted

#: Most recurring lines that are broadcast (24 bytes each).
BROADCAST_LINES = 200_000


def line_keys(text: Column) -> Column:
    """For each line of a text, in order, a hash of its letters; null for lines without letters."""
    reduced = F.split(F.regexp_replace(fold(text), "[^\\p{L}\\n]+", ""), "\n", -1)
    return F.transform(reduced, lambda x: F.when(x != "", F.xxhash64(x)))


def _documents(articles: DataFrame, day: Column | None) -> DataFrame:
    return articles.where(~is_blank(F.col("content_text"))).select(
        F.col("article_id"),
        F.coalesce(source_key(F.col("source_id")), F.lit("")).alias("_source"),
        F.xxhash64("content_text").alias("_cluster"),
        (F.lit(None).cast("date") if day is None else day).alias("_day"),
        F.col("content_text"),
    )


def recurring_lines(articles: DataFrame, *, least: int = 3, share: float = 0.1, least_clusters: int = 1, least_days: int = 0, differing: bool = False, clock: DataFrame | None = None) -> DataFrame:
    """``_source, _line`` (the hash) with ``articles, clusters, days`` of each line that recurs within its source, and the source's ``documents``.

    A line recurs if it is in at least ``least`` documents, ``least_clusters``
    clusters of equal texts, ``least_days`` publication days and a ``share``
    of the source's documents with text. With ``differing``, a cluster is the
    texts whose lines have the same letters, and the share is one of the
    source's clusters: copies add nothing, and a line in several clusters
    stands beside lines that differ.

    Days are counted, exactly, only if ``least_days`` is set; else ``days`` is
    0. A day is that of ``published_at`` in UTC, read with the sources' wall
    clocks (``clock`` as in ``normalise_timestamps``; none: UTC, month before
    day). Dates that can't be read are no days.
    """
    day = None
    if least_days:
        clock = articles.sparkSession.createDataFrame([], "source_id string, tz_name string, day_first boolean") if clock is None else clock
        articles = normalise_timestamps(articles.select("article_id", "source_id", "published_at", "content_text"), clock, ["published_at"])
        day = F.to_date("published_at_utc")
    docs = _documents(articles, day)
    keys = F.filter(F.array_distinct(line_keys(F.col("content_text"))), lambda x: x.isNotNull())
    docs = docs.select("_source", "_cluster", "_day", keys.alias("_keys"))
    if differing:
        docs = docs.withColumn("_cluster", F.xxhash64(F.array_sort("_keys")))
    lines = docs.select("_source", "_cluster", "_day", F.explode("_keys").alias("_line"))
    by_cluster = lines.groupBy("_source", "_line", "_cluster").agg(F.count(F.lit(1)).alias("_n"))
    counted = by_cluster.groupBy("_source", "_line").agg(
        F.sum("_n").alias("articles"),
        F.count(F.lit(1)).alias("clusters"),
        F.lit(0).cast("long").alias("days"),
    )
    if least_days:
        by_day = lines.where(F.col("_day").isNotNull()).select("_source", "_line", "_day").distinct()
        counted = counted.drop("days").join(by_day.groupBy("_source", "_line").agg(F.count(F.lit(1)).alias("days")), ["_source", "_line"])
    each = docs.groupBy("_source", "_cluster").agg(F.count(F.lit(1)).alias("_n"))
    sizes = each.groupBy("_source").agg((F.count(F.lit(1)) if differing else F.sum("_n")).alias("_docs"), F.sum("_n").alias("documents"))
    held = F.col("clusters" if differing else "articles")
    found = (F.col("articles") >= least) & (F.col("clusters") >= least_clusters) & (F.col("days") >= least_days)
    return counted.where(found).join(sizes, "_source").where(held >= F.round(F.col("_docs") * F.lit(share), 9)).drop("_docs")


def mark_lines(articles: DataFrame, recurring: DataFrame) -> DataFrame:
    """``article_id, line_no`` of each line of a text that is in ``recurring``."""
    lines = _documents(articles, None).select("article_id", "_source", F.posexplode(line_keys(F.col("content_text"))).alias("_pos", "_line")).where(F.col("_line").isNotNull())
    keys = checkpoint(recurring.select("_source", "_line", "articles"))
    if keys.count() <= BROADCAST_LINES:
        marked = lines.join(F.broadcast(keys), ["_source", "_line"], "left_semi")
    else:
        marked = join_hot(lines, keys, ["_source", "_line"], "articles")
    return marked.select("article_id", (F.col("_pos") + 1).alias("line_no"))


def with_listed(texts: DataFrame, recurring: DataFrame) -> DataFrame:
    """``texts`` (with ``article_id`` and ``_source``) with ``_lines``, the recurring lines of their source as an array (null: none).

    A share bounds a source's array to the lines of 1 / share texts.
    """
    lines = checkpoint(recurring.select("_source", "_line", "documents"))
    listed = lines.groupBy("_source").agg(F.collect_set("_line").alias("_lines"), F.max("documents").alias("_documents"))
    if lines.count() <= BROADCAST_LINES:
        return texts.join(F.broadcast(listed.drop("_documents")), "_source", "left")
    return join_salted(texts, listed, "_source", "article_id", "_documents").drop("_documents")


def found_lines(articles: DataFrame, **limits: float) -> DataFrame:
    """``article_id BIGINT, line_no INT``: each line that recurs within its source (numbered from 1, blank lines counted).

    Null and blank texts have no lines; a null source is a source of its own;
    rows repeated under the same id count as often as they come. An empty
    table gives an empty result. Other columns are not read.
    """
    return mark_lines(articles, recurring_lines(articles, **limits))


def without_lines(articles: DataFrame, recurring: DataFrame) -> DataFrame:
    """``articles`` with ``content_clean``: each text without its source's recurring lines (null stays null)."""
    known = F.coalesce(source_key(F.col("_row.source_id")), F.lit(""))
    keyed = articles.select(F.struct("*").alias("_row")).select("_row", F.col("_row.article_id").alias("article_id"), known.alias("_source"))
    text = F.col("_row.content_text")
    kept = F.filter(
        F.arrays_zip(F.split(text, "\n", -1).alias("t"), line_keys(text).alias("k")),
        lambda x: x["k"].isNull() | F.col("_lines").isNull() | ~F.array_contains("_lines", x["k"]),
    )
    return with_listed(keyed, recurring).select("_row.*", F.array_join(F.transform(kept, lambda x: x["t"]), "\n").alias("content_clean"))
