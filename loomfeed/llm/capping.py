"""Cap the records of each contributor, keeping the best by a quality score.

Reservoir sampling without replacement by exponential keys: each record gets
a key, the cap-size largest keys of each contributor stay. With a
``sharpness`` the key is ``ln(u) / weight`` for a uniform ``u`` that is hashed
from the id, so the sample is weighted and reproducible. Without one (the
limit of infinite sharpness) the key is the quality itself and the choice is
the strict order of quality.

Hot contributors: no group is ever sorted in one task. The cap-th largest key
is found by counting. A histogram over coarse keys (combined map-side) gives
the one coarse key of each group in which the cap falls; only the rows on
that key are counted again over finer keys; only what lies in the last finer
bucket is ranked. Every other row is decided by comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.timestamps import source_key
from ..runtime import checkpoint

#: Ids per bucket of the finer histogram: the most rows that one task ranks for a group.
ID_BLOCK = 1 << 13
#: Parts of a power of two that the coarse and the finer histogram over random keys tell apart.
COARSE, FINE = 1 << 10, 1 << 16


def quality_key(priority: Column, summary: Column) -> Column:
    """BIGINT that orders by priority (null as 0), then by the length of the trimmed summary (null as 0)."""
    return F.coalesce(priority.cast("long"), F.lit(0)) * F.lit(1 << 32) + F.coalesce(F.length(strip(summary)), F.lit(0))


def reservoir_key(weight: Column, record_id: Column, sharpness: float, seed: int = 0) -> Column:
    """Exponential random key ``ln(u) / weight ** sharpness``; larger is better, heavier records tend to have larger ones."""
    u = (F.xxhash64(record_id.cast("string"), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / F.lit(float((1 << 53) + 1))
    return F.log(u) / F.pow(F.greatest(weight.cast("double"), F.lit(1e-9)), F.lit(sharpness))


def _cut(rows: DataFrame, group: list[str], digit: str, room: DataFrame) -> DataFrame:
    """Per group the digit at which ``_room`` runs out, as ``_edge``, and the room left there as ``_left``.

    ``rows`` are counted by (group, digit); larger digits come first. Groups that fit wholly have no row.
    """
    count = rows.groupBy(*group, digit).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy(F.col(digit).desc())
    run = count.withColumn("_upto", F.sum("_n").over(w))
    return (
        run.join(room, group)
        .where((F.col("_upto") > F.col("_room")) & (F.col("_upto") - F.col("_n") <= F.col("_room")))
        .select(*group, F.col(digit).alias("_edge"), (F.col("_room") - (F.col("_upto") - F.col("_n"))).alias("_left"))
    )


def cap_contributors(keyed: DataFrame, group: list[str], record_id: str, key: str, room: DataFrame, *, random: bool = False) -> DataFrame:
    """The rows of ``keyed`` with ``_kept`` (boolean) appended.

    ``keyed`` has non-null ``group`` columns, a non-null ``key`` (larger is
    better) and an integral ``record_id`` (smaller wins ties; rows that share
    an id are kept or dropped in no fixed order among themselves).
    ``room`` has the group columns and ``_room``, the number that may stay; a
    group without a row there keeps nothing.
    """
    if random:
        # By powers of two and parts of them: however the weights stretch or press the keys, a level has a small part of any contributor's.
        size = F.greatest(-F.col(key), F.lit(1e-300))
        power = F.floor(F.log2(size))
        part = (size / F.pow(F.lit(2.0), power) - 1) * COARSE
        first = -(power * COARSE + F.floor(part))
        second = -F.floor((part - F.floor(part)) * FINE)
    else:
        first, second = F.col(key), -F.floor(F.col(record_id) / ID_BLOCK)
    rows = keyed.withColumns({"_d1": first, "_d2": second})
    c1 = checkpoint(_cut(rows, group, "_d1", room))  # a row per group, read three times
    at1 = rows.join(c1, group).where(F.col("_d1") == F.col("_edge")).drop("_edge")
    c2 = checkpoint(_cut(at1.drop("_left"), group, "_d2", c1.select(*group, F.col("_left").alias("_room"))))
    at2 = at1.drop("_left").join(c2, group).where(F.col("_d2") == F.col("_edge"))
    w = Window.partitionBy(*group).orderBy(F.col(key).desc(), F.col(record_id))
    last = at2.withColumn("_rank", F.row_number().over(w)).withColumn("_kept", F.col("_rank") <= F.col("_left"))
    edges = c1.withColumnRenamed("_edge", "_e1").drop("_left").join(c2.withColumnRenamed("_edge", "_e2").drop("_left"), group, "left")
    decided = (
        rows.join(edges, group, "left")
        .where(F.col("_e1").isNull() | (F.col("_d1") != F.col("_e1")) | F.col("_e2").isNull() | (F.col("_d2") != F.col("_e2")))
        .withColumn(
            "_kept",
            F.when(F.col("_e1").isNull(), True)
            .when(F.col("_d1") != F.col("_e1"), F.col("_d1") > F.col("_e1"))
            .otherwise(F.col("_e2").isNull() | (F.col("_d2") > F.col("_e2"))),
        )
    )
    columns = keyed.columns
    return decided.select(*columns, "_kept").unionAll(last.select(*columns, "_kept"))


def excess_articles(articles: DataFrame, *, parts: int = 20, sharpness: float | None = None, seed: int = 0) -> DataFrame:
    """``article_id`` of the rows over the limit of their source within their batch.

    In each batch a source may keep ``1 / parts`` of the batch's rows, rounded
    up: by strict quality (priority, length of summary, smaller id), or with a
    ``sharpness`` as a weighted sample. A null batch is a batch of its own, a
    null source a source of its own; null ids come out if their row is over the limit. An
    empty table gives an empty result; other columns are not read.
    """
    weight = F.greatest(F.coalesce(F.col("source_priority"), F.lit(0)), F.lit(0)) + 1
    key = quality_key(F.col("source_priority"), F.col("summary")) if sharpness is None else reservoir_key(weight, F.col("article_id"), sharpness, seed)
    keyed = checkpoint(articles.select(
        "article_id",
        F.coalesce(F.col("batch_no").cast("string"), F.lit("")).alias("_batch"),
        F.coalesce(F.concat(F.lit("s"), source_key(F.col("source_id"))), F.lit("")).alias("_source"),
        F.coalesce(F.col("article_id"), F.lit((1 << 63) - 1)).alias("_id"),
        key.alias("_key"),
    ))
    sizes = keyed.groupBy("_batch", "_source").agg(F.count(F.lit(1)).alias("_n"))
    caps = sizes.groupBy("_batch").agg(F.ceil(F.sum("_n") / parts).alias("_room"))
    room = sizes.join(caps, "_batch").select("_batch", "_source", "_room")
    return cap_contributors(keyed, ["_batch", "_source"], "_id", "_key", room, random=sharpness is not None).where(~F.col("_kept")).select("article_id")
