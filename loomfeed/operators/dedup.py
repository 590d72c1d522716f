"""Keep the best record per canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, is_blank, strip
from ..functions.urls import canonical_url
from ..runtime import checkpoint, join_hot

QUALITY = ["_has_published", "_has_updated", "_has_summary", "_summary_length", "_has_author", "_priority"]


def quality_columns() -> dict[str, Column]:
    """The parts of a record's quality, most important first."""
    some = lambda c: (~is_blank(F.col(c))).cast("int")
    return dict(zip(QUALITY, [
        some("published_at"), some("updated_at"), some("summary"),
        F.coalesce(F.least(F.length(strip(F.col("summary"))), F.lit(4000)), F.lit(0)),
        some("author"), F.coalesce("source_priority", F.lit(0)),
    ], strict=True))


def deduplicate(articles: DataFrame, ordinal: str) -> DataFrame:
    """Append ``canonical_url``, ``dedup_status`` (kept, duplicate or invalid_url) and ``group_ordinal``.

    Per canonical URL the record of the best quality is kept, on ties the
    first by ``ordinal``. ``group_ordinal`` is the first ordinal of the group.
    Quality and ordinal are compared as one struct, so the best record of a
    group comes from a map-side combined aggregation instead of a sort of the
    group. Only the groups of more than one record are stored and joined back,
    hot ones by broadcast; records without a URL are spread evenly.
    """
    df = bound(articles, canonical_url=canonical_url(F.col("url")), **quality_columns())
    rank = F.struct(*QUALITY, (-F.col(ordinal)).alias("_first"))
    best = df.where(F.col("canonical_url").isNotNull()).groupBy("canonical_url").agg(F.max(rank).alias("_best"), F.min(ordinal).alias("_group"), F.count(F.lit(1)).alias("_members"))
    status = F.when(F.col("canonical_url").isNull(), "invalid_url").when(F.col("_members").isNull() | (F.col("_best._first") == -F.col(ordinal)), "kept").otherwise("duplicate")
    groups = checkpoint(best.where("_members > 1"))
    first = F.when(F.col("canonical_url").isNotNull(), F.coalesce("_group", F.col(ordinal)))
    joined = join_hot(df, groups, "canonical_url", "_members", how="left").withColumns({"dedup_status": status, "group_ordinal": first})
    return joined.select(*articles.columns, "canonical_url", "dedup_status", "group_ordinal")


def duplicate_groups(deduplicated: DataFrame, ordinal: str) -> DataFrame:
    """A row per duplicate: its group, the kept ordinal and its own; groups in order of ``group_ordinal``, members of ``duplicate_ordinal``.

    No group is gathered: the kept record of a group is looked up, hot groups by broadcast.
    """
    kept = deduplicated.where("dedup_status = 'kept'").select("group_ordinal", F.col(ordinal).alias("kept_ordinal"))
    rows = deduplicated.where("dedup_status = 'duplicate'").select("canonical_url", "group_ordinal", F.col(ordinal).alias("duplicate_ordinal"))
    sizes = rows.groupBy("group_ordinal").agg(F.count(F.lit(1)).alias("_members"))
    looked_up = join_hot(rows, checkpoint(kept.join(sizes, "group_ordinal")), "group_ordinal", "_members")
    return looked_up.select("canonical_url", "group_ordinal", "kept_ordinal", "duplicate_ordinal")


def dedup_summary(deduplicated: DataFrame) -> DataFrame:
    """One row: total, unique, duplicate and invalid records, and groups with duplicates."""
    per = deduplicated.groupBy("canonical_url").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("dedup_status") == "kept").alias("kept"),
        F.count_if(F.col("dedup_status") == "duplicate").alias("dup"), F.count_if(F.col("dedup_status") == "invalid_url").alias("bad"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("n").alias("total"), total("kept").alias("unique_count"), total("dup").alias("duplicate_count"), total("bad").alias("invalid_count"), F.count_if(F.col("dup") > 0).alias("duplicate_groups"))


def keep_best_windowed(articles: DataFrame, ordinal: str) -> DataFrame:
    """The kept rows only, by a ranking window (plans as WindowGroupLimit); for callers that need no other status."""
    df = bound(articles, canonical_url=canonical_url(F.col("url")), **quality_columns()).where(F.col("canonical_url").isNotNull())
    w = Window.partitionBy("canonical_url").orderBy(*(F.col(c).desc() for c in QUALITY), F.col(ordinal))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", *QUALITY)
