"""Build one surviving record per duplicate group, field by field.

The usable candidates of each group and field are ranked by a window. Its limit
is applied in each task first, so that of a group, however large, a task sends
one candidate per field. The order is trust (priority), recency (fetch time),
then the smaller record id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, letters, strip
from ..operators.timestamps import _known_zones, with_utc

# Placeholders, compared without case and outer spaces.
TITLE_PLACEHOLDERS = ["home", "untitled", "untitled document", "(no title)", "no title", "[title]", "title", "index.html", "new post", "n/a", "null", "none", "tbd"]
SUMMARY_PLACEHOLDERS = ["n/a", "null", "none", "tbd", "no summary", "summary coming soon", "coming soon", "click here to read the article", "no description", "no summary available"]
AUTHOR_PLACEHOLDERS = ["n/a", "null", "none", "unknown", "anonymous", "admin", "administrator", "editor", "editors", "author", "author name", "staff", "guest", "user", "root", "webmaster", "redaktion", "rédaction", "redacción"]

FIELDS = ["title", "summary", "author", "published_at", "updated_at"]
_CUT = f"(?i)(\\.\\.\\.|…|\\[\\s*(\\.\\.\\.|…)\\s*\\]|read more|weiterlesen|lire la suite|leer más){SPACE}*$"


def _plain(c: Column) -> Column:
    return F.lower(strip(c))


def usable_title(c: Column) -> Column:
    return c.rlike("\\p{L}") & ~_plain(c).isin(TITLE_PLACEHOLDERS) & ~c.rlike(_CUT)


def usable_summary(c: Column, *titles: Column) -> Column:
    """``titles``: reduced titles that a summary must say more than: one within such a title, or one with a few letters more, doesn't."""
    reduced = letters(c)
    says_less = [F.coalesce((t != "") & (t.contains(reduced) | (reduced.contains(t) & (F.length(reduced) <= F.length(t) + 25))), F.lit(False)) for t in titles]
    ended = c.rlike(f"[.!?。！？]['\"”’»)]*{SPACE}*$")
    good = c.rlike("\\p{L}") & ~_plain(c).isin(SUMMARY_PLACEHOLDERS) & ~c.rlike(_CUT) & ended
    return reduce(lambda x, less: x & ~less, says_less, good)


def usable_author(c: Column) -> Column:
    return c.rlike("\\p{L}") & ~_plain(c).isin(AUTHOR_PLACEHOLDERS) & ~c.rlike("@|https?:|www\\.|[\\[\\]<>{}]") & ~c.rlike(_CUT)


def survivors(groups: DataFrame) -> DataFrame:
    """``group_id, field, record_id``: the record whose value survives, per group and field.

    A null or empty member list, null members and null group ids are no
    error: absent members offer nothing, a null group is a group of its own. Repeated rows
    of a group act as one, but a summary is held against titles of its own row
    only: its record's and the leading one. Fields without a usable value have no row. Null
    priorities rank last, null or unreadable fetch times after real ones.
    """
    zones = _known_zones(groups.sparkSession)
    members = F.filter(F.concat(F.array("kept_article"), F.coalesce("duplicate_articles", F.array().cast(groups.schema["duplicate_articles"].dataType))), lambda m: m.isNotNull())
    # The title that the members' summaries are held against, beside their own: the most trusted, then the longest.
    leading = F.array_max(F.transform("_m", lambda m: F.when(usable_title(m["title"]), F.struct(m["source_priority"].alias("p"), F.length(m["title"]).alias("n"), m["title"].alias("t")))))
    each = groups.select("group_id", members.alias("_m")).select("group_id", "_m", letters(leading["t"]).alias("_leading"))
    head = ["record_id", "source_priority", "fetched_at"]
    rows = each.select("group_id", "_leading", F.explode("_m").alias("m")).select("group_id", "_leading", *(F.col("m")[c].alias(c) for c in [*head, *FIELDS]))
    rows = rows.withColumns({"_tz": F.lit("UTC"), "_day_first": F.lit(False), "_own": letters(F.col("title"))})
    rows = with_utc(rows, "fetched_at", "_fetched", zones)
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FIELDS)))
    context = ["group_id", "_leading", "_own", "record_id", "source_priority", "_fetched", "_tz", "_day_first"]
    long = rows.select(*context, values.alias("v")).select(*context, "v.*").where(F.length("value") > 0)
    is_date = F.col("field").isin("published_at", "updated_at")
    dated = with_utc(long.withColumn("_date", F.when(is_date, F.col("value"))), "_date", "_when", zones)
    field, value = F.col("field"), F.col("value")
    usable = (
        F.when(is_date, F.year("_when").between(2000, 2100))
        .when(field == "title", usable_title(value))
        .when(field == "author", usable_author(value))
        .otherwise(usable_summary(value, F.col("_own"), F.col("_leading")))
    )
    order = F.struct(F.coalesce("source_priority", F.lit(-(1 << 31))).alias("p"), F.col("_fetched").alias("f"), (-F.col("record_id")).alias("r"))
    candidates = dated.where(usable).select("group_id", "record_id", order.alias("_order"), "field")
    w = Window.partitionBy("group_id", "field").orderBy(F.col("_order").desc())
    return candidates.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select("group_id", "field", "record_id")
