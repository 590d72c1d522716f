"""Registry of the queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import spread, table
from . import boilerplate, capping, history, leakage, residue, site_lines, stuffing, survivor, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeated_items(table(spark, sf_dir, "article"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.page_frames(table(spark, sf_dir, "article"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(table(spark, sf_dir, "duplicate_group"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_articles(table(spark, sf_dir, "article"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capping.excess_articles(table(spark, sf_dir, "article"))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same limit, but the rows that stay are drawn at random, weighted by priority."""
    return capping.excess_articles(table(spark, sf_dir, "article"), sharpness=1.0)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.found_lines(table(spark, sf_dir, "article"))


def p7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur in at least three differing texts and on at least three days: republished articles make no line recur."""
    clock = table(spark, sf_dir, "source_clock")
    return site_lines.found_lines(table(spark, sf_dir, "article"), least_clusters=3, least_days=3, clock=clock)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leakage.leaked(documents, table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p3_found, p4_found, p5_found, p6_found, p6_sample, p7_found, p7_clusters, p8_ids, p9_found, p10_found)}

_P6 = """
WITH a AS (
  SELECT article_id, batch_no, lower(trim(source_id)) AS s, coalesce(source_priority, 0) AS p,
         coalesce(length(regexp_replace(summary, '^\\s+|\\s+$', '', 'g')), 0) AS n
  FROM article
), r AS (
  SELECT article_id, row_number() OVER (PARTITION BY batch_no, s ORDER BY p DESC, n DESC, article_id) AS k,
         count(*) OVER (PARTITION BY batch_no) AS m
  FROM a
)
SELECT article_id FROM r WHERE k > ceil(m / 20.0)
"""

_P7 = """
WITH d AS (
  SELECT article_id, lower(trim(source_id)) AS s, string_split(content_text, chr(10)) AS t
  FROM article WHERE regexp_matches(content_text, '[^\\s]')
), x AS (
  SELECT article_id, s, unnest(t) AS line, generate_subscripts(t, 1) AS line_no FROM d
), l AS (
  SELECT article_id, s, line_no, regexp_replace(replace(lower(line), 'ß', 'ss'), '[^\\p{L}]+', '', 'g') AS k FROM x
), c AS (
  SELECT s, k, count(DISTINCT article_id) AS n FROM l WHERE k <> '' GROUP BY s, k
), z AS (SELECT s, count(*) AS m FROM d GROUP BY s)
SELECT l.article_id, CAST(l.line_no AS INT) AS line_no
FROM l JOIN c USING (s, k) JOIN z USING (s) WHERE c.n >= 3 AND c.n * 10 >= z.m
"""

ORACLES: dict[str, str] = {"p6_found": _P6, "p7_found": _P7}
