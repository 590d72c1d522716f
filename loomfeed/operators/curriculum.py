"""Choose the lessons of an edition from a curriculum and the history of editions.

A curriculum is a list of bounded size; history grows with the editions and is
reduced to its last entries first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import exploded_history, in_order_of, previous_lesson, rotate, same_date_entry
from .lessons import lesson_id

#: The only source of history that there is.
HISTORY_SOURCES = ["site_archive"]


def check_curriculum(lessons: DataFrame, count: int, history_source: str = HISTORY_SOURCES[0]) -> None:
    """ValueError where no choice is possible."""
    if history_source not in HISTORY_SOURCES:
        raise ValueError(f"unknown source of history: {history_source}")
    enabled = lessons.where("enabled").count()
    if not enabled:
        raise ValueError("no lesson is enabled")
    if count > enabled:
        raise ValueError(f"{count} lessons a day are more than the {enabled} that are enabled")


def choose_lessons(lessons: DataFrame, history: DataFrame, date: str, count: int) -> DataFrame:
    """The ``count`` lessons of an edition of ``date``: the lessons' columns with ``pick`` (from 0), ``previous``, ``reused`` and ``cycle_reset``.

    An edition of the same date that holds enough known lessons gives its
    lessons again, in its order. Else the lessons after the last one of an
    earlier date follow, from the start again after the last. ``history`` has
    ``date, path, lesson_ids``; ids that are unknown or disabled don't count.
    """
    known = lessons.where("enabled")
    last = previous_lesson(history, known, date).select(F.col("lesson_id").alias("previous"))
    again = in_order_of(exploded_history(same_date_entry(history, date)), known, "id")
    everything = Window.partitionBy()
    again = again.withColumns({"pick": F.row_number().over(Window.orderBy("pos")) - 1, "_known": F.count(F.lit(1)).over(everything)}).where((F.col("_known") >= count) & (F.col("pick") < count))
    again = again.drop("pos", "_known").withColumns({"cycle_reset": F.lit(False), "reused": F.lit(True)})
    before = last.first()  # one id
    follow = rotate(lessons, before.previous if before else None, count).withColumn("reused", F.lit(False))
    both = again.unionByName(follow).withColumn("_reuse", F.max("reused").over(everything)).where(F.col("reused") == F.col("_reuse")).drop("_reuse")
    return both.withColumn("previous", F.lit(before.previous if before else None).cast("string"))


def ranked_in_order(chosen: DataFrame, ranked: DataFrame) -> DataFrame:
    """The ranked records of the chosen lessons (``id, pick``), in the order of choice; a lesson without a record is an error when it is read."""
    named = ranked.withColumn("_lesson", lesson_id(F.col("external_id"), F.col("source_tags")))
    joined = chosen.select(F.col("id").alias("_chosen"), "pick").join(named, F.col("_chosen") == F.col("_lesson"), "left")
    present = F.when(F.col("_lesson").isNull(), F.raise_error(F.concat(F.lit("no ranked record of lesson "), "_chosen")).cast("string")).otherwise(F.col("url"))
    return joined.withColumn("url", present).orderBy("pick").drop("_chosen", "_lesson")
