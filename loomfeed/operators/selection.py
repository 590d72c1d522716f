"""Soft quotas per category under a global maximum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_by_quota(ranked: DataFrame, categories: DataFrame, *, max_articles: int, fill_unused_slots: bool = True, rank: str = "rank_index") -> DataFrame:
    """The selected rows with ``within_quota``, to be ordered by rank.

    First each category takes up to its quota in rank order; then, if asked,
    what is left of the maximum is filled in rank order from the rest of the
    categories with a quota. A quota of 0 selects nothing. A maximum of 0
    selects nothing. Rows deeper in a category than the maximum can never be
    picked and go first (WindowGroupLimit), so the global window sees at most
    categories x maximum rows.
    """
    if isinstance(max_articles, bool) or max_articles < 0:
        raise ValueError("max_articles must be 0 or more")
    dim = categories.select(F.col("category_id").alias("category"), F.col("daily_quota").alias("_quota")).where("_quota > 0")
    w = Window.partitionBy("category").orderBy(rank)
    near = ranked.join(dim, "category").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_articles)
    near = near.withColumn("within_quota", F.col("_rn") <= F.col("_quota"))
    if not fill_unused_slots:
        near = near.where("within_quota")
    pick = F.row_number().over(Window.orderBy(F.col("within_quota").desc(), F.col(rank)))
    return near.withColumn("_pick", pick).where(F.col("_pick") <= max_articles).drop("_rn", "_quota", "_pick")


def deferred(ranked: DataFrame, selected: DataFrame, *, rank: str = "rank_index") -> DataFrame:
    """The ranked rows that weren't selected."""
    return ranked.join(selected.select(rank), rank, "left_anti")


def category_counts(selected: DataFrame, categories: DataFrame) -> DataFrame:
    """``category, selected_count`` of every category of the dimension, zero included."""
    counts = selected.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    dim = categories.select(F.col("category_id").alias("category"))
    return dim.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("selected_count"))


def selection_summary(ranked: DataFrame, selected: DataFrame) -> DataFrame:
    s = selected.agg(F.count(F.lit(1)).alias("selected_count"), F.count_if("within_quota").alias("within_quota_count"))
    r = ranked.agg(F.count(F.lit(1)).alias("ranked_count"))
    return r.join(s).select("selected_count", (F.col("ranked_count") - F.col("selected_count")).alias("deferred_count"), "within_quota_count", (F.col("selected_count") - F.col("within_quota_count")).alias("overflow_count"))
