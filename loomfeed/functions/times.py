"""Time expressions (JVM-side, but for the one rounding that Spark can't do).

Instants are TIMESTAMP_NTZ in UTC, so no result depends on the session zone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

_TIME = "(\\d{2})(?::?(\\d{2})(?::?(\\d{2})(?:[.,](\\d+))?)?)?"
_OFFSET = "(?:([+-])(\\d{2}):?(\\d{2})?|([Zz]))?"
#: ISO 8601 with calendar dates: extended and basic, any one character between date and time.
_ISO = f"^(\\d{{4}})(-?)(\\d{{2}})\\2(\\d{{2}})(?:.{_TIME}{_OFFSET})?$"
#: ISO 8601 with week dates.
_WEEK = f"^(\\d{{4}})(-?)W(\\d{{2}})(?:\\2(\\d))?(?:.{_TIME}{_OFFSET})?$"


def _n(c: Column) -> Column:
    return F.coalesce(F.when(c != "", c.try_cast("int")), F.lit(0))


def iso_instant(value: Column) -> Column:
    """UTC instant of an ISO 8601 text; a text without an offset is UTC; null if it isn't one."""
    return first_instant(value)


def first_instant(*values: Column) -> Column:
    """The first readable of some ISO texts. The parser is one lambda over all of them, so it is built and planned once."""
    made = F.filter(F.transform(F.array(*values), _parsed), lambda t: t.isNotNull())
    return F.try_element_at(made, F.lit(1))


def _parsed(value: Column) -> Column:
    s = strip(value)
    to = "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"
    f = F.split(F.coalesce(F.when(s.rlike(_ISO), F.concat(F.lit("d|"), F.regexp_replace(s, _ISO, to))), F.when(s.rlike(_WEEK), F.concat(F.lit("w|"), F.regexp_replace(s, _WEEK, to)))), "\\|", -1)
    return F.transform(F.array(f), _assembled)[0]


def _assembled(f: Column) -> Column:
    year, a, b = _n(f[1]), _n(f[2]), F.when(f[3] == "", 1).otherwise(_n(f[3]))
    h, mi, s = _n(f[4]), _n(f[5]), _n(f[6])
    micros = F.rpad(F.substring(f[7], 1, 6), 6, "0").try_cast("int")
    monday = F.date_sub(F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(4)), F.weekday(F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(4))))
    day_of_week = F.date_add(monday, (a - 1) * 7 + b - 1)
    week_ok = a.between(1, 53) & b.between(1, 7) & (F.weekofyear(day_of_week) == a)
    time_ok = (year >= 1) & (h <= 23) & (mi <= 59) & (s <= 59)
    calendar = F.call_function("try_make_timestamp_ntz", year, a, b, h, mi, s.cast("decimal(16,6)"))
    weekly = F.when(week_ok, day_of_week.cast("timestamp_ntz") + F.make_dt_interval(hours=h, mins=mi, secs=s.cast("decimal(18,6)")))
    local = F.when(time_ok, F.when(f[0] == "w", weekly).otherwise(calendar))
    sign = F.when(f[8] == "-", -1).otherwise(1)
    offset_ok = (_n(f[9]) <= 23) & (_n(f[10]) <= 59)
    fraction = F.make_dt_interval(secs=(F.coalesce(micros, F.lit(0)) / F.lit(1000000)).cast("decimal(18,6)"))
    return F.when(offset_ok, local + fraction - F.make_dt_interval(mins=sign * (_n(f[9]) * 60 + _n(f[10]))))


def event_instant(published: Column, updated: Column) -> Column:
    """The first readable of two ISO texts."""
    return first_instant(published, updated)


def to_iso_z(ntz: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ``, fractions cut off."""
    return F.concat(F.translate(F.substring(ntz.cast("string"), 1, 19), " ", "T"), F.lit("Z"))


def month_name_date(value: Column) -> Column:
    """DATE of the first "Mon D, YYYY" (short or long English month) in a text; null if there is none."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    found = F.regexp_replace(F.regexp_extract(value, f"(?i)\\b((?:{months})\\s+\\d{{1,2}},\\s*\\d{{4}})\\b", 1), "\\s+", " ")
    proper = F.initcap(F.nullif(found, F.lit("")))
    return F.coalesce(F.try_to_timestamp(proper, F.lit("MMMM d, yyyy")), F.try_to_timestamp(proper, F.lit("MMM d, yyyy"))).cast("date")


def local_date(ntz: Column, zone: str) -> Column:
    """``yyyy-MM-dd`` in a named zone."""
    return F.substring(F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz).cast("string"), 1, 10)


def local_label(ntz: Column, zone: str) -> Column:
    """``yyyy-MM-dd HH:mm`` and the zone in a named zone."""
    return F.concat(F.substring(F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz).cast("string"), 1, 16), F.lit(f" {zone}"))


def path_date(path: Column) -> Column:
    """DATE of a path that ends in ``/yyyy/MM/dd/<file>``; null if there is none or it isn't real."""
    return F.regexp_replace(F.nullif(F.regexp_extract(path, "/(\\d{4}/\\d{2}/\\d{2})/[^/]+$", 1), F.lit("")), "/", "-").try_cast("date")


def freshness_seconds(instant: Column, now: str) -> Column:
    """Seconds from an instant to ``now`` (UTC), not below 0; null for a null instant."""
    at = F.lit(now).cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", instant, at)
    return F.when(instant.isNotNull(), F.greatest(us / F.lit(1e6), F.lit(0.0)))


@F.pandas_udf(T.DoubleType())
def freshness_hours(seconds: pd.Series) -> pd.Series:
    """Hours to three places, rounded on the binary value."""
    return pd.Series([None if pd.isna(s) else round(s / 3600, 3) for s in seconds], dtype="float64")


def retry_timeout(seconds: Column) -> Column:
    return F.least(F.greatest(seconds * 2, seconds + 10), F.lit(60))
