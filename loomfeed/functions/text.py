"""Text expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All Unicode white space and invisible blanks as a Java character class.
SPACE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


#: The same characters, for trimming.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(c, F.lit(SPACES))


def lit_map(entries: dict) -> Column:
    """A literal map in one expression (a call per entry would take seconds for long tables)."""
    show = lambda x: str(x) if isinstance(x, int) else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{show(k)}, {show(v)}" for k, v in entries.items()) + ")")


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns whose expressions stay where they are.

    Catalyst pushes a filter through projections and copies into it every
    expression that it refers to, again for each reference. It can't push one
    below the generator whose output it reads, so a one-element explode keeps
    a long chain of parsing steps from being multiplied.
    """
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_b")
    return df.select("*", made).select(*(F.col(f"`{c}`") for c in df.columns), *(F.col("_b")[n].alias(n) for n in columns))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only values."""
    return F.coalesce(~c.rlike(SPACE.replace("[", "[^", 1)), F.lit(True))


def fold(c: Column) -> Column:
    """Lower case with the foldings that ``lower`` alone misses (sharp s, final sigma)."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def letters(c: Column) -> Column:
    """A value reduced to its letters, without regard to case."""
    return F.regexp_replace(fold(c), "[^\\p{L}]+", "")


def collapse(c: Column) -> Column:
    """White space runs of any kind to one space, trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def truncate(c: Column, limit: int) -> Column:
    """At most ``limit`` code points, the last an ellipsis where something was cut; no limit if it isn't positive."""
    if limit <= 0:
        return c
    cut = F.regexp_replace(F.substring(c, 1, limit - 1), f"{SPACE}+$", "")
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("…"))).otherwise(c)


def optional(c: Column) -> Column:
    """Null for null and blank values, else the value with white space collapsed."""
    return F.nullif(collapse(c), F.lit(""))


def inline_spaces(c: Column) -> Column:
    """Runs of spaces, tabs, form feeds and vertical tabs to one space; line breaks survive."""
    return strip(F.regexp_replace(c, "[ \\t\\f\\x0B]+", " "))


def word_count(c: Column) -> Column:
    """Number of white-space separated tokens; 0 for null and blank values."""
    return F.coalesce(F.size(F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")), F.lit(0))


def contains_term(text: Column, term: str) -> Column:
    """Whether a folded text holds a folded term that no letter, digit or underscore touches.

    The cheap substring test comes first and spares most rows the pattern.
    """
    word = term.replace("\\E", "\\E\\\\E\\Q")
    return text.contains(term) & text.rlike(f"(?<![\\p{{L}}\\p{{N}}_])\\Q{word}\\E(?![\\p{{L}}\\p{{N}}_])")


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_markdown(c: Column) -> Column:
    """Backslash before backslash, brackets, asterisk, underscore, backtick and hash."""
    return _replaced(c, [(x, "\\" + x) for x in "\\[]*_`#"])


def escape_markdown_cell(c: Column) -> Column:
    """Safe in a table cell: backslash and bar escaped, line breaks to spaces."""
    return F.regexp_replace(_replaced(c, [("\\", "\\\\"), ("|", "\\|")]), "\\r\\n?|\\n", " ")


def escape_markdown_link(c: Column) -> Column:
    """Safe as a link target: closing parentheses percent-encoded."""
    return F.replace(c, F.lit(")"), F.lit("%29"))


def escape_html(c: Column) -> Column:
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])


def humanise(c: Column, default: str = "Other") -> Column:
    """A category id as a label: underscores to spaces, words capitalised; the default for null and blank."""
    return F.coalesce(F.nullif(F.initcap(collapse(F.replace(c, F.lit("_"), F.lit(" ")))), F.lit("")), F.lit(default))


def slug(c: Column, *, ascii_only: bool = False, default: str = "section") -> Column:
    """Lower case with runs of other characters to single hyphens."""
    keep = "[^a-z0-9]+" if ascii_only else "[^\\p{L}\\p{N}]+"
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), keep, "-"), "^-+|-+$", ""), F.lit("")), F.lit(default))


def pluralise(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, noun).otherwise(noun + "s"))


def without_control_characters(c: Column) -> Column:
    """Without the characters that XML 1.0 doesn't allow."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]", "")


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, stripped, without empty ones."""
    parts = F.split(F.regexp_replace(c, "\\r\\n?", "\n"), "\n[ \\t]*\n")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def media_type(c: Column) -> Column:
    """The type before any parameters in lower case; null for blank."""
    return F.nullif(F.lower(strip(F.substring_index(c, ";", 1))), F.lit(""))


def is_slug_id(c: Column) -> Column:
    """Lower case letters and digits with underscores between."""
    return F.coalesce((c == F.lower(c)) & F.regexp_replace(c, "_", "").rlike("^[\\p{L}\\p{N}]+$"), F.lit(False))


def author_of(c: Column) -> Column:
    """The name after "by", up to a date or the end; null if there is none."""
    months = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    rest = F.regexp_extract(collapse(c), "(?i)\\bby\\s+(.+)$", 1)
    name = F.regexp_replace(rest, f"(?i)(?:^|\\s)(?:(?:{months})[a-z]*\\.?\\s+\\d{{1,2}},\\s*\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}})\\b.*$", "")
    return F.nullif(F.regexp_replace(name, "^[\\s,|·–—-]+|[\\s,|·–—-]+$", ""), F.lit(""))
