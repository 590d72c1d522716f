"""Configuration and archived documents: YAML dimensions, JSON payloads, ZIP archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip
from ..functions.times import path_date
from ..operators.history import payload_ids

PAYLOAD = (
    "generated_at string, article_count int, lesson_ids array<string>, learning struct<lesson_ids:array<string>,lessons:array<struct<id:string,lesson_id:string>>>, "
    "articles array<struct<title:string,url:string,learning_lesson_id:string>>, _corrupt string"
)


def read_yaml(path: str) -> dict:
    """A mapping from a YAML file; ValueError if it is none."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("YAML files need PyYAML") from e
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if not isinstance(data, dict):
        raise ValueError(f"{path} must hold a mapping")
    return data


def source_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Sources with ``source_pos``, the order of the file; unknown keys are dropped, missing ones null."""
    names = [c.split(" ")[0] for c in schemas.SOURCE.split(", ")]
    rows = [tuple(e.get(n) for n in names) + (i,) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, f"{schemas.SOURCE}, source_pos int")


def category_table(spark: SparkSession, categories: dict[str, dict]) -> DataFrame:
    rows = [(k, v.get("label", k), v.get("weight"), v.get("daily_quota"), i) for i, (k, v) in enumerate(categories.items())]
    return spark.createDataFrame(rows, schemas.CATEGORY)


def lesson_table(spark: SparkSession, lessons: list[dict]) -> DataFrame:
    """Lessons by (order, id)."""
    names = [c.split(" ")[0] for c in schemas.LESSON.split(", ")]
    rows = [tuple(x.get(n, "" if n == "content_html" else None) for n in names) for x in lessons]
    return spark.createDataFrame(rows, schemas.LESSON).orderBy("order", "id")


def chosen_sources(sources: DataFrame, ids: list[str]) -> DataFrame:
    """The enabled sources asked for, in the order asked for; unknown or disabled ids are an error."""
    asked = list(dict.fromkeys(ids))
    have = {r.id for r in sources.where("enabled").select("id").where(F.col("id").isin(asked)).collect()}
    if missing := sorted(set(asked) - have):
        raise ValueError(f"unknown or disabled sources: {', '.join(missing)}")
    order = sources.sparkSession.createDataFrame(list(enumerate(asked)), "asked int, id string")
    return sources.join(order, "id").orderBy("asked").drop("asked")


def read_payloads(spark: SparkSession, path: str, *, strict: bool = False, name: str = "*.json") -> DataFrame:
    """Archived payloads with their path. Corrupt documents are dropped, or fail the read if ``strict``."""
    reader = spark.read.schema(PAYLOAD).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    if strict:
        return reader.option("mode", "FAILFAST").json(path).withColumns({"path": F.col("_metadata.file_path"), "changed": F.col("_metadata.file_modification_time")})
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.withColumns({"path": F.col("_metadata.file_path"), "changed": F.col("_metadata.file_modification_time")}).where("_corrupt IS NULL").drop("_corrupt")


def archived_payloads(spark: SparkSession, archive: str, *, name: str = "ranked_articles.json") -> DataFrame:
    """The payloads of an archive, with ``path`` and ``entry_date``: those that its manifest lists, else all that are found below it.

    Entries of the manifest without a file are left out, and files listed
    twice come once, with their first date. A manifest that can't be read, or
    that lists no file, is as none.
    """
    found = read_payloads(spark, archive, name=name).withColumn("_place", F.regexp_extract("path", f"^.*?/?([^/]+/[^/]+/[^/]+)/{re.escape(name)}$", 1))
    entries = "struct<editions:array<struct<date:string,path:string>>>"
    listed = (
        spark.read.text(archive, wholetext=True, recursiveFileLookup=True, pathGlobFilter="index.json")
        .select(F.from_json("value", entries)["editions"].alias("e")).select(F.posexplode("e").alias("_at", "e")).where("e.path IS NOT NULL")
        .groupBy(F.regexp_replace(strip(F.col("e.path")), "^/+|/+$", "").alias("_place")).agg(F.min_by(F.nullif(strip(F.col("e.date")), F.lit("")), "_at").alias("entry_date"))
    )
    by_manifest = found.join(listed, "_place")
    if by_manifest.first() is not None:
        return by_manifest.drop("_place")
    return found.withColumn("entry_date", F.lit(None).cast("string")).drop("_place")


def latest_payload(payloads: DataFrame) -> DataFrame:
    """The payload of the last folder by name; of several files in it, the one changed last. One row, or none."""
    when = F.col("changed") if "changed" in payloads.columns else F.lit(None).cast("timestamp")
    return payloads.orderBy(F.regexp_replace("path", "/[^/]*$", "").desc(), when.desc()).limit(1)


def edition_history(payloads: DataFrame) -> DataFrame:
    """``date, path, lesson_ids``: the date of the manifest's entry or of the path, else the own-offset date of generated_at."""
    ids = payload_ids(
        F.col("lesson_ids"), F.col("learning.lesson_ids"),
        F.transform("learning.lessons", lambda x: F.coalesce(x["id"], x["lesson_id"])),
        F.transform("articles", lambda x: x["learning_lesson_id"]),
    )
    given = F.col("entry_date").try_cast("date").cast("string") if "entry_date" in payloads.columns else F.lit(None).cast("string")
    date = F.coalesce(given, path_date(F.col("path")).cast("string"), F.substring("generated_at", 1, 10).try_cast("date").cast("string"))
    return payloads.select(date.alias("date"), "path", ids.alias("lesson_ids")).where("date IS NOT NULL")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """``path, member, size, text, error`` of the archives under a path; a broken archive is one row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    schema = "path string, member string, size long, text string, error string"
    arrow = schemas.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                p, content = row["path"], row["content"]
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        if bad := z.testzip():
                            raise zipfile.BadZipFile(bad)
                        out += [{"path": p, "member": m.filename, "size": m.file_size, "text": z.read(m).decode("utf-8", "replace")} for m in z.infolist()]
                except zipfile.BadZipFile as e:
                    out.append({"path": p, "error": str(e)})
            yield from schemas.batches(out, arrow)

    return files.mapInArrow(run, schema)
