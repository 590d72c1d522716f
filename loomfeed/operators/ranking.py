"""Explainable keyword scoring and ranking of records."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, contains_term, fold
from ..functions.times import event_instant, freshness_seconds
from ..runtime import checkpoint, shuffle_width


@dataclass(frozen=True)
class Scoring:
    """Points of a score. Bands are (hours, points), inclusive, compared on unrounded seconds."""

    per_priority: int = 2
    per_weight: int = 2
    in_title: int = 8
    in_support: int = 4
    low: int = 6
    high_cap: int = 24
    low_cap: int = 12
    bands: tuple[tuple[int, int], ...] = ((6, 10), (12, 8), (24, 6), (36, 4), (48, 2))
    high_keywords: tuple[str, ...] = ()
    low_keywords: tuple[str, ...] = field(default=())


def keyword_list(values: list[str]) -> tuple[str, ...]:
    """Stripped, folded, first occurrences in order; blank or non-text entries are an error."""
    if any(not isinstance(v, str) or not v.strip() for v in values):
        raise ValueError("keywords must be non-empty strings")
    return tuple(dict.fromkeys(v.strip().casefold() for v in values))


def freshness_points(seconds: Column, scoring: Scoring = Scoring()) -> Column:
    chain = reduce(lambda c, b: c.when(seconds <= b[0] * 3600, b[1]), scoring.bands, F.when(seconds.isNull(), 0))
    return chain.otherwise(0)


def with_weights(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Join the category dimension (``category_id, weight``); a category without a row raises when the row is read."""
    dim = categories.select(F.col("category_id").alias("category"), F.col("weight").alias("category_weight"))
    joined = articles.join(dim, "category", "left")
    missing = F.raise_error(F.concat(F.lit("no category "), F.coalesce(F.col("category"), F.lit("NULL")))).cast("int")
    return joined.withColumn("category_weight", F.coalesce("category_weight", missing))


def unknown_categories(sources: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows whose category isn't in the dimension."""
    return sources.join(categories.select(F.col("category_id").alias("category")), "category", "left_anti")


def score(weighted: DataFrame, now: str, scoring: Scoring) -> DataFrame:
    """Append score, freshness, matched keywords and the ordered reasons (and ``event_ts`` where it isn't there yet).

    Keywords are literals, one pattern each, so overlapping hits all count;
    the folded texts are computed once per row.
    """
    support = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.array_join(F.coalesce("source_tags", F.array().cast("array<string>")), " "))
    made = {"_title": fold(F.coalesce("title", F.lit(""))), "_support": fold(support)}
    if "event_ts" not in weighted.columns:
        made["event_ts"] = event_instant(F.col("published_at"), F.col("updated_at"))
    df = bound(weighted, **made)
    df = df.withColumn("freshness_seconds", freshness_seconds(F.col("event_ts"), now))
    title, both = F.col("_title"), F.concat_ws(" ", "_title", "_support")
    high = [F.when(contains_term(title, k), F.struct(F.lit(k).alias("k"), F.lit(scoring.in_title).alias("p"))).when(contains_term(F.col("_support"), k), F.struct(F.lit(k).alias("k"), F.lit(scoring.in_support).alias("p"))) for k in scoring.high_keywords]
    low = [F.when(contains_term(both, k), F.lit(k)) for k in scoring.low_keywords]
    none = F.array().cast("array<struct<k:string,p:int>>")
    df = df.withColumns({
        "_high": F.array_compact(F.array(*high)) if high else none,
        "matched_low_priority_keywords": F.array_compact(F.array(*low)) if low else F.array().cast("array<string>"),
        "_fresh": freshness_points(F.col("freshness_seconds"), scoring),
        "_prio": F.coalesce("source_priority", F.lit(0)) * scoring.per_priority,
        "_weight": F.col("category_weight") * scoring.per_weight,
    })
    df = df.withColumns({
        "matched_high_priority_keywords": F.transform("_high", lambda x: x["k"]),
        "_hp": F.aggregate("_high", F.lit(0), lambda a, x: a + x["p"]),
        "_lp": F.size("matched_low_priority_keywords") * scoring.low,
    })
    s = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    hours = F.aggregate(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in scoring.bands)), F.lit(None).cast("int"), lambda a, x: F.coalesce(a, F.when(x["p"] == F.col("_fresh"), x["h"])))
    reasons = F.concat(
        F.array(s("Source priority ", F.coalesce("source_priority", F.lit(0)), ": +", F.col("_prio")), s("Category weight ", F.col("category_weight"), ": +", F.col("_weight"))),
        F.array_compact(F.array(F.when(F.col("_fresh") > 0, s("Published within ", hours, " hours: +", F.col("_fresh"))))),
        F.transform("_high", lambda x: F.when(x["p"] == scoring.in_title, s("High-priority keyword in title '", x["k"], "': +", x["p"])).otherwise(s("High-priority keyword in summary/tags '", x["k"], "': +", x["p"]))),
        F.array_compact(F.array(F.when(F.col("_hp") > scoring.high_cap, s("High-priority keyword bonus capped: ", F.col("_hp"), f" -> {scoring.high_cap}")))),
        F.transform("matched_low_priority_keywords", lambda x: s("Low-priority keyword '", x, f"': -{scoring.low}")),
        F.array_compact(F.array(F.when(F.col("_lp") > scoring.low_cap, s("Low-priority keyword penalty capped: ", F.col("_lp"), f" -> {scoring.low_cap}")))),
    )
    total = F.col("_prio") + F.col("_weight") + F.col("_fresh") + F.least(F.col("_hp"), F.lit(scoring.high_cap)) - F.least(F.col("_lp"), F.lit(scoring.low_cap))
    return df.withColumns({"score": F.greatest(total, F.lit(0)), "score_reasons": reasons}).drop("_title", "_support", "_high", "_fresh", "_prio", "_weight", "_hp", "_lp")


def rank_keys(ordinal: str) -> list[Column]:
    """Score, then the later event (none last), priority, folded title, URL, input order."""
    return [F.col("score").desc(), F.col("event_ts").desc_nulls_last(), F.coalesce("source_priority", F.lit(0)).desc(), fold(F.col("title")), F.col("url"), F.col(ordinal)]


def top_ranked(scored: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first ``n`` in rank order with ``rank_index`` from 1 (TakeOrderedAndProject, then a window over n rows)."""
    top = scored.orderBy(*rank_keys(ordinal)).limit(n)
    return top.withColumn("rank_index", F.row_number().over(Window.orderBy(*rank_keys(ordinal))))


def ranked(scored: DataFrame, ordinal: str) -> DataFrame:
    """All rows with their global ``rank_index``, without a one-task window.

    Rows are written once, as finding range bounds and partitioning each read
    them; give it narrow rows. They are range-partitioned by the keys and
    numbered inside their partition; the partitions' sizes, one number each,
    give the offsets.
    """
    n = shuffle_width(scored.sparkSession)
    scored = checkpoint(scored)
    keyed = scored.withColumns({f"_k{i}": c for i, c in enumerate([F.col("score"), F.col("event_ts"), F.coalesce("source_priority", F.lit(0)), fold(F.col("title")), F.col("url"), F.col(ordinal)])})
    order = [F.col("_k0").desc(), F.col("_k1").desc_nulls_last(), F.col("_k2").desc(), F.col("_k3"), F.col("_k4"), F.col("_k5")]
    parts = checkpoint(keyed.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))  # ids and rows must not move apart
    w = Window.partitionBy("_part").orderBy(*order)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))  # one row per partition
    numbered = parts.withColumn("_rn", F.row_number().over(w)).join(offsets, "_part")
    return numbered.withColumn("rank_index", F.col("_rn") + F.col("_before")).select(*scored.columns, "rank_index")


def ranking_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("ranked_count"), F.max("score").alias("top_score"))
