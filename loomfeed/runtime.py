"""Session-level helpers: table access, sizes, checkpoints, bucketed tables, hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than this part of all rows is hot; fewer than 1 / HOT keys can be.
HOT = 1e-4
#: Rows up to which no key is hot.
LEAST_HOT = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins. Where it is unset, a local session (tests, a
    single machine) uses a temporary folder; a cluster has none that all its
    executors can read, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")
    sc.setCheckpointDir(there or os.path.join(tempfile.gettempdir(), "loomfeed-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before costly per-row work if the scan has too few splits.

    A scan of a few small files may yield fewer partitions than there are
    cores. At scale a scan has far more splits than cores, and nothing is
    shuffled. Meant for scans and narrow plans over them: it asks for the
    files' sizes only, and runs nothing.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    total = sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)
    opening = _bytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    split = min(_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")), max(opening, (total + len(files) * opening) // cores))
    return df if total >= split * (cores // 2) else df.repartition(cores)


def _bytes(size: str) -> int:
    """A size such as 128MB, 16m or 134217728b in bytes."""
    digits = size.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:])
    return int(digits[:-1]) << unit if unit else int(digits)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for tables of one run."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Bucketed:
    """A parquet table at a path, bucketed by key columns: a join on them moves none of its rows.

    The catalog entry is the session's; the data and its layout are the
    path's. ``buckets`` must be the same each time a path is opened.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.name = "loomfeed_" + uuid.uuid5(uuid.NAMESPACE_URL, f"{path}|{buckets}|{keys}").hex

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def append(self, df: DataFrame, compression: str = "snappy") -> None:
        """One file per bucket and append: rows are dealt to the buckets first."""
        dealt = df.repartition(self.buckets, *self.keys)
        made = dealt.write.mode("append").format("parquet").option("compression", compression).option("path", self.path)
        made.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)

    def open(self, schema: str) -> None:
        """Register a path written by an earlier session."""
        at = self.path.replace("'", "\\'")
        keys = ", ".join(self.keys)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{at}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def _rows_per_task(lookup: DataFrame, count: str, total: int | None) -> float:
    """Rows of one key beyond which it is hot."""
    total = (lookup.agg(F.sum(count)).first()[0] or 0) if total is None else total
    return max(total * HOT, LEAST_HOT)


def join_hot(rows: DataFrame, lookup: DataFrame, key: str | list[str], count: str = "n", *, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined to a ``lookup`` that has one row per key and the key's number of rows in ``count``.

    Keys that hold more than ``HOT`` of all rows are fewer than 1 / ``HOT``, so
    their lookup rows are broadcast; the others meet theirs by a shuffle, in
    which no key can swamp a task: rows that are done, and rows with a null
    key, which meet nothing, are spread evenly. ``rows`` is read once;
    ``lookup`` is read several times, so it should be stored. For narrow
    lookups.
    """
    keys = [key] if isinstance(key, str) else key
    least = _rows_per_task(lookup, count, total)
    payload = [c for c in lookup.columns if c not in keys]
    absent = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    hot = lookup.where(F.col(count) > least)
    some = hot.limit(1).count() > 0
    marked, rest = rows, lookup
    if some:
        marked = rows.join(F.broadcast(hot.select(*keys, F.struct(*payload).alias("_hot"))), keys, "left")
        rest, absent = lookup.where(F.col(count) <= least), absent | F.col("_hot").isNotNull()
    spread_out = F.when(absent, F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int") + 1).otherwise(0)
    joined = marked.withColumn("_spread", spread_out).join(rest.select(*keys, F.struct(*payload).alias("_met"), F.lit(0).alias("_spread")), [*keys, "_spread"], "left")
    met = F.coalesce("_hot", "_met") if some else F.col("_met")
    joined = joined.withColumn("_met", met)
    if how == "inner":
        joined = joined.where(F.col("_met").isNotNull())
    return joined.select(*rows.columns, *(F.col("_met")[c].alias(c) for c in payload))


def join_salted(rows: DataFrame, lookup: DataFrame, key: str, by: str, count: str = "n", *, total: int | None = None) -> DataFrame:
    """``rows`` left-joined to a ``lookup`` whose rows may be wide, one per key, with the key's number of rows in ``count``.

    Rows of a hot key are dealt by a hash of the column ``by``, and its lookup
    row is repeated for each share; only the number of shares is broadcast,
    for fewer than 1 / ``HOT`` keys.
    """
    per = _rows_per_task(lookup, count, total)
    shares = lookup.withColumn("_shares", F.greatest(F.ceil(F.col(count) / per), F.lit(1)).cast("int"))
    hot = shares.where("_shares > 1").select(key, "_shares")
    if not hot.limit(1).count():
        return rows.join(lookup, key, "left")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(by), "_shares").cast("int"), F.lit(0))).drop("_shares")
    repeated = shares.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    return dealt.join(repeated, [key, "_share"], "left").drop("_share")
