"""Lookups in the history of editions, and rotation through a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def payload_ids(ids: Column, nested: Column, lessons: Column, articles: Column) -> Column:
    """Ids from the four places a payload may hold them, in this order, blanks dropped, first occurrences kept."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.concat(*(F.coalesce(c, empty) for c in (ids, nested, lessons, articles))), strip), lambda x: x.isNotNull() & (x != "")))


def exploded_history(history: DataFrame) -> DataFrame:
    """``date, path, pos, lesson_id`` of a history of ``date, path, lesson_ids``."""
    return history.select("date", "path", F.posexplode("lesson_ids").alias("pos", "lesson_id"))


def _last(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("date").desc(), F.col("path").desc(), F.col("pos").desc()).limit(1)


def previous_lesson(history: DataFrame, lessons: DataFrame, date: str) -> DataFrame:
    """The last known lesson strictly before ``date``: one row, or none."""
    known = exploded_history(history).where(F.col("date") < date).join(lessons.select(F.col("id").alias("lesson_id")), "lesson_id", "left_semi")
    return _last(known)


def same_date_entry(history: DataFrame, date: str) -> DataFrame:
    """The last entry of ``date``."""
    return history.where(F.col("date") == date).orderBy(F.col("path").desc()).limit(1)


def in_order_of(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of the ids (``lesson_id, pos``, one row each) with ``pos``, in order of the ids; unknown ids are dropped."""
    return rows.join(ids.select(F.col("lesson_id").alias(key), "pos"), key).orderBy("pos")


def rotate(lessons: DataFrame, previous: str | None, count: int) -> DataFrame:
    """The next ``count`` of the ordered enabled lessons after ``previous``, wrapping, with ``pick`` from 0 and ``cycle_reset``.

    Meant for a list of bounded size (a curriculum): it is ordered as a whole.
    """
    pos = lessons.where("enabled").select("*", (F.row_number().over(Window.orderBy("order", "id")) - 1).alias("_pos"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    last = F.max(F.when(F.col("id") == F.lit(previous), F.col("_pos"))).over(Window.partitionBy())
    placed = pos.withColumn("_start", F.coalesce((last + 1) % F.col("_n"), F.lit(0))).withColumn("_seen", last.isNotNull())
    picked = placed.withColumn("pick", F.pmod(F.col("_pos") - F.col("_start"), F.col("_n"))).where(F.col("pick") < count)
    reset = F.col("_seen") & ((F.col("_start") == 0) | (F.col("_start") + F.least(F.lit(count), F.col("_n")) > F.col("_n")))
    return picked.withColumn("cycle_reset", reset).drop("_pos", "_n", "_start", "_seen")


def asof_previous(left: DataFrame, right: DataFrame, by: str, on: str, value: str, out: str, *, days: float = 7) -> DataFrame:
    """Each left row with the last ``value`` of ``right`` for the same key strictly before it, without a range join.

    Both sides are laid into one stream per key and span of ``days``, so a hot
    key is sorted span by span; what earlier spans end with is worked out from
    one row per key and span. Ties at the same instant aren't seen, as the
    window frame ends before the instant.
    """
    span = F.floor(F.col("_at") / int(days * 86_400_000_000))
    at = F.unix_micros(F.col(on).cast("timestamp"))
    both = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(True).alias("_left"), at.alias("_at")).unionByName(
        right.select(by, on, F.col(value).alias("_v"), F.lit(False).alias("_left"), at.alias("_at")), allowMissingColumns=True
    )
    both = both.withColumn("_span", span)
    ends = both.groupBy(by, "_span").agg(F.max(F.when(~F.col("_left") & F.col("_v").isNotNull(), F.struct("_at", "_v"))).alias("_end"))
    before = Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(by).alias("_by"), F.col("_span").alias("_spanned"), F.last("_end._v", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy(by, "_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_seen", F.last(F.when(~F.col("_left"), F.col("_v")), ignorenulls=True).over(w)).where("_left")
    joined = seen.join(carried, (F.col(by) == F.col("_by")) & (F.col("_span") == F.col("_spanned")), "left")
    return joined.withColumn(out, F.coalesce("_seen", "_carried")).drop("_v", "_left", "_at", "_span", "_seen", "_by", "_spanned", "_carried")
