"""Normalise timestamps of mixed notation, precision and zone to UTC instants.

An ordered cascade of anchored patterns rewrites each value to one canonical
field list ``y|mo|d|h|mi|s|ampm|zone``; the fields are then read strictly.
Everything stays inside Catalyst expressions: no Python worker, no shuffle but
the broadcast of the small zone table.

Policies
* an offset, zone name or zone abbreviation in the value counts;
* a value without one is read in the zone of its source, else in UTC;
* a wall time that occurs twice means its first occurrence;
* a wall time that the clock skips is read with the offset valid before the change;
* fractions of a second are cut off; a date alone is the start of that day;
* all-number dates follow the source's day/month order, month first by default;
* two-digit years: 00-49 are 2000-2049, 50-99 are 1950-1999.

Null, blank and unreadable values, and values that name no real date or time
of day, give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, bound, lit_map, strip

# Month names in English, German, French and Spanish.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr febrero",
    3: "march mar märz maerz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sept sep septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60,
    "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "brt": -180, "art": -180, "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540,
    "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
}

_SPACE = SPACE
_MONTH = "(" + "|".join(sorted((n for names in MONTHS.values() for n in names.split()), key=len, reverse=True)) + ")\\.?"
_WEEKDAY = "(?:\\p{L}{2,10}\\.?,? )?"
_OFFSET = "(?:utc|gmt)?[+-]\\d{1,2}(?::?\\d{2})?"
_ZONE = f"(?: ?({_OFFSET}|[a-z]{{1,5}}|[a-z]+(?:/[a-z0-9_+-]+){{1,2}})?(?: ?\\[([a-z0-9_+/-]+)\\]| ?\\([a-z ]+\\))?)"
_CLOCK = "(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:[.,]\\d+)?)?"
_AMPM = "(?: ?([ap])\\.?m\\.?(?![a-z]))?"

# Anchored patterns with the field list each one yields, tried in this order.
CASCADE: list[tuple[str, str, str]] = [
    ("iso", f"^(\\d{{4}})([-/.])(\\d{{1,2}})\\2(\\d{{1,2}})(?:(?:t|,? ?){_CLOCK}{_AMPM}{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("compact", f"^(\\d{{4}})(\\d{{2}})(\\d{{2}})(?:[t ]?(\\d{{2}}):?(\\d{{2}})(?::?(\\d{{2}})(?:[.,]\\d+)?)?{_ZONE})?$", "$1|$2|$3|$4|$5|$6||$7|$8"),
    ("numeric", f"^(\\d{{1,2}})([-/.])(\\d{{1,2}})\\2(\\d{{4}})(?:,? {_CLOCK}{_AMPM}{_ZONE})?$", "$4|#$1|$3|$5|$6|$7|$8|$9|$10"),
    ("day_month_name", f"^{_WEEKDAY}(\\d{{1,2}})(?:\\.|st|nd|rd|th)?[ -](?:de )?{_MONTH}(?:,? | de |-)(\\d{{4}}|\\d{{2}})(?:(?:,| à| at| um| a las)? {_CLOCK}(?: uhr)?{_AMPM}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month_name_day", f"^{_WEEKDAY}{_MONTH} (\\d{{1,2}})(?:st|nd|rd|th)?,? (\\d{{4}})(?:(?:,| at)? {_CLOCK}{_AMPM}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]


def _known_zones(spark: SparkSession) -> list[str]:
    """All zone ids of the JVM's zone database (a list of fixed size, about 600)."""
    jvm = spark.sparkContext._jvm
    names = jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(",")
    return sorted(z for z in names if "/" in z and not z.startswith("SystemV"))


def _int(c: Column) -> Column:
    return F.when(c != "", c.try_cast("int"))


def tidy(value: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(value, f"{_SPACE}+", " ")))


def local_fields(s: Column) -> Column:
    """``array(y, mo, d, h, mi, s, a|p|'', zone, [zone])`` of a tidied value, else null."""
    return F.split(F.coalesce(*(F.when(s.rlike(p), F.regexp_replace(s, p, to)) for _, p, to in CASCADE)), "\\|", -1)


def epoch_seconds(s: Column) -> Column:
    """Whole seconds of epoch notations in s, ms, us or ns (10, 13, 16, 19 digits), else null."""
    digits = F.when(s.rlike("^\\d{10}(\\.\\d+)?$|^\\d{13}$|^\\d{16}$|^\\d{19}$"), F.substring(s, 1, 10))
    return digits.try_cast("long")


def _offset_minutes(zone: Column) -> Column:
    table = lit_map(ABBREVIATIONS)
    m = F.regexp_replace(zone, "^(?:utc|gmt)?([+-])(\\d{1,2}):?(\\d{2})?$", "$1|$2|$3")
    p = F.split(m, "\\|", -1)
    h, mi = _int(p[1]), F.coalesce(_int(p[2]), F.lit(0))
    numeric = F.when((h <= 18) & (mi <= 59), F.when(p[0] == "-", -1).otherwise(1) * (h * 60 + mi))
    return F.when(zone.rlike(f"^{_OFFSET}$"), numeric).otherwise(F.try_element_at(table, zone))


def with_utc(df: DataFrame, column: str, out: str, zones: list[str], tz: str = "_tz", day_first: str = "_day_first") -> DataFrame:
    """Append ``out``: TIMESTAMP_NTZ of the instant in UTC, or null.

    Worked out in steps, each a projection of its own, so that no step's
    expression is copied into the next and the generated code stays small.
    """
    s, f = F.col("_tidy"), F.col("_f")
    names = lit_map({n: k for k, v in MONTHS.items() for n in v.split()})
    ids = lit_map({z.lower(): z for z in zones})
    number = lambda i: _int(F.get(f, F.lit(i)))
    step1 = bound(df, _tidy=tidy(F.col(column))).withColumns({"_f": local_fields(s), "_epoch": epoch_seconds(s)})
    step2 = step1.withColumns({
        "_y": number(0) + F.when(F.length(f[0]) > 2, 0).otherwise(F.when(number(0) < 50, 2000).otherwise(1900)),
        "_named": F.try_element_at(names, f[1]),
        "_first": _int(F.regexp_replace(f[1], "^#", "")),
        "_swap": f[1].startswith("#") & F.coalesce(F.col(day_first), F.lit(False)),
        "_second": number(2),
        "_h": F.coalesce(number(3), F.lit(0)),
        "_half": f[6],
        "_mi": F.coalesce(number(4), F.lit(0)),
        "_s": F.coalesce(number(5), F.lit(0)),
        "_zone": F.when(f[7] != "", f[7]).when(f[8] != "", f[8]),
    })
    half, h0 = F.col("_half"), F.col("_h")
    step3 = step2.withColumns({
        "_mo": F.when(F.col("_swap"), F.col("_second")).otherwise(F.coalesce("_first", "_named")),
        "_d": F.when(F.col("_swap"), F.col("_first")).otherwise(F.col("_second")),
        "_h": F.when(half == "", h0).when(h0.between(1, 12), h0 % 12 + F.when(half == "p", 12).otherwise(0)),
        "_off": _offset_minutes(F.col("_zone")),
        "_region": F.when(F.col("_zone").isNull(), F.coalesce(F.col(tz), F.lit("UTC"))).otherwise(F.try_element_at(ids, F.col("_zone"))),
    })
    real = (F.col("_y") >= 1) & F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    made = F.call_function("try_make_timestamp_ntz", *(F.col(c) for c in ("_y", "_mo", "_d", "_h", "_mi")), F.col("_s").cast("decimal(16,6)"))
    step4 = step3.withColumn("_local", F.when(real, made))
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = (
        F.when(F.col("_epoch").isNotNull(), start + F.make_dt_interval(secs=F.col("_epoch").cast("decimal(18,6)")))
        .when(F.col("_off").isNotNull(), F.col("_local") - F.make_dt_interval(mins=F.col("_off")))
        .otherwise(F.convert_timezone(F.col("_region"), F.lit("UTC"), F.col("_local")))
    )
    return bound(step4, **{out: instant}).drop("_tidy", "_f", "_epoch", "_y", "_named", "_first", "_swap", "_second", "_h", "_half", "_mi", "_s", "_zone", "_mo", "_d", "_off", "_region", "_local")


def iso_z(ntz: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of a UTC TIMESTAMP_NTZ within the years 1 to 9999, independent of the session zone."""
    text = ntz.cast("string")
    return F.when(text.rlike("^\\d{4}-"), F.concat(F.translate(F.substring(text, 1, 19), " ", "T"), F.lit("Z")))


def source_key(c: Column) -> Column:
    """A source id without regard to letter case and surrounding spaces."""
    return F.lower(strip(c))


def clock_table(clock: DataFrame) -> DataFrame:
    """One row per source of the zone lookup; unknown zone ids fall back to UTC.

    Repeated rows of a source collapse to the first zone in name order.
    """
    ids = lit_map({z.lower(): z for z in [*_known_zones(clock.sparkSession), "UTC"]})
    return (
        clock.groupBy(source_key(F.col("source_id")).alias("_clock_source"))
        .agg(F.min(F.struct("tz_name", "day_first")).alias("_c"))
        .select("_clock_source", F.try_element_at(ids, F.lower(F.trim("_c.tz_name"))).alias("_tz"), F.col("_c.day_first").alias("_day_first"))
        .where(F.col("_clock_source").isNotNull())
    )


def normalise_timestamps(records: DataFrame, clock: DataFrame, fields: list[str], *, source: str = "source_id", suffix: str = "_utc") -> DataFrame:
    """Append ``<field>_utc`` (TIMESTAMP_NTZ, UTC) for each of ``fields``.

    ``clock`` has source_id, tz_name and day_first. It is a dimension of one
    row per source; Catalyst broadcasts it while it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise. Null,
    blank and unreadable values give null; an empty table gives an empty
    table; other columns of ``records`` pass through, whatever their names.
    """
    zones = _known_zones(records.sparkSession)
    keyed = records.withColumn("_clock_source", source_key(F.col(source)))
    joined = keyed.join(clock_table(clock), "_clock_source", "left")
    out = reduce(lambda df, c: with_utc(df, c, c + suffix, zones), fields, joined)
    return out.drop("_clock_source", "_tz", "_day_first")


def restated_timestamps(records: DataFrame, clock: DataFrame, key: str, fields: list[str], *, source: str = "source_id") -> DataFrame:
    """One row per value that denotes an instant but isn't written as ``yyyy-MM-ddTHH:mm:ssZ``.

    Columns: ``key``, ``field`` (the name) and ``ts_utc`` (the instant in that form).
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in fields)))
    values = records.select(key, source, pairs.alias("v")).select(key, source, "v.field", "v.raw").where(F.length(F.trim("raw")) > 0)
    done = normalise_timestamps(values, clock, ["raw"], source=source)
    return (
        bound(done, ts_utc=iso_z(F.col("raw_utc")))
        .select(key, "field", "ts_utc", "raw")
        .where(F.col("ts_utc").isNotNull() & (F.col("raw") != F.col("ts_utc")))
        .drop("raw")
    )
