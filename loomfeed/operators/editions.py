"""Editions: keyed upsert, redaction, union of sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``incoming`` replacing those of the same key.

    An anti-join and a union: the rows of the larger side aren't sorted, and
    the smaller side is broadcast while it is small.
    """
    return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(incoming)


def redact(articles: DataFrame) -> DataFrame:
    """Public form: no content, status reset. The scan doesn't read the dropped columns."""
    blank = {"content_html": F.lit(""), "content_text": F.lit(""), "content_status": F.lit("not_requested")}
    return articles.select(*(blank[c].alias(c) if c in blank else F.col(c) for c in articles.columns))


def union_sections(**sections: DataFrame) -> DataFrame:
    """All sections in the order given, with ``section`` (from 0) and ``section_name``; order by section, then rank."""
    tagged = [df.withColumns({"section": F.lit(i), "section_name": F.lit(n)}) for i, (n, df) in enumerate(sections.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def existing_only(manifest: DataFrame, files: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Entries whose file exists, and those whose file doesn't."""
    names = files.select(key)
    return manifest.join(names, key, "left_semi"), manifest.join(names, key, "left_anti")
