"""Text expressions: token estimates, identifiers, truncation, bars and sparklines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def tokens(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("long"))


def file_tokens(text: Column) -> Column:
    """As ``tokens`` without the least of 1, and 0 for an unreadable (null) text."""
    return F.coalesce(F.floor(F.length(text) / CHARS_PER_TOKEN), F.lit(0)).cast("long")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def meaningful(text: Column, least: int = 10) -> Column:
    return F.length(stripped(text)) >= least


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n")).cast("long")


def truncated(text: Column, chars: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, max(0, chars - len(marker))), F.lit(marker))).otherwise(text)


def truncated_lines(text: Column, max_tokens: int) -> Column:
    """Whole lines within the budget, then a line that tells how many were left out.

    The lines' ends are a running sum; the cut is the number of leading lines that end within it, so
    nothing is collected or folded.
    """
    room = max_tokens * CHARS_PER_TOKEN
    lines = F.split(text, "\n")
    # Position of each line feed is the running length of what precedes it.
    ends = F.aggregate(
        lines,
        F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"), F.lit(False).alias("full")),
        lambda a, x: F.struct(
            F.when(a["full"] | (a["used"] + F.length(x) + 1 > room), a["used"]).otherwise(a["used"] + F.length(x) + 1).alias("used"),
            F.when(a["full"] | (a["used"] + F.length(x) + 1 > room), a["kept"]).otherwise(a["kept"] + 1).alias("kept"),
            (a["full"] | (a["used"] + F.length(x) + 1 > room)).alias("full"),
        ),
    )
    kept = ends["kept"].cast("int")
    left = F.concat(F.lit("... (truncated, "), (F.size(lines) - kept).cast("string"), F.lit(" lines omitted)"))
    cut = F.array_join(F.concat(F.slice(lines, 1, kept), F.array(left)), "\n")
    return F.when(F.length(text) <= room, text).otherwise(cut)


def identifiers(text: Column) -> Column:
    """Distinct alphanumeric words of two characters and more."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)\W+"), lambda w: F.length(w) > 1))


def identifier_candidates(text: Column) -> Column:
    """Whole words that are identifiers: a capital and word characters, or lower case and two characters or more."""
    return F.filter(F.split(text, r"(?U)\W+"), lambda w: w.rlike("^([A-Z][a-zA-Z0-9_]*|[a-z_][a-z0-9_]+)$"))


def path_words(text: Column) -> Column:
    """White-space words without sentence marks behind and quoting marks around."""
    words = F.split(text, r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"[,.!;:?]+$", ""), r"^[\"'`*_]+|[\"'`*_]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def bar(value: Column, most: Column, width: int = 30) -> Column:
    """A bar of ``width`` cells. Halves round to even."""
    filled = F.when(most <= 0, F.lit(0)).otherwise(F.bround(value / F.when(most > 0, most) * width)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def progress_line(label: Column, done: Column, total: Column, width: int = 24) -> Column:
    """``label: [####....] done/total ( 50.0%)``; nothing of nothing is an empty bar. Halves round to even."""
    width = max(8, width)
    of = F.greatest(total, F.lit(0))
    n = F.when(of > 0, F.least(F.greatest(done, F.lit(0)), of)).otherwise(0)
    share = F.when(of > 0, n / F.when(of > 0, of)).otherwise(0.0)
    filled = F.least(F.lit(width), F.bround(share * width).cast("int"))
    percent = F.lpad(F.format_string("%.1f", share * 100), 5, " ")
    return F.concat(label, F.lit(": ["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled), F.lit("] "), n.cast("string"), F.lit("/"), of.cast("string"), F.lit(" ("), percent, F.lit("%)"))


def duration(seconds: Column) -> Column:
    """``120ms``, ``4.5s`` or ``2m03.0s``."""
    minutes = F.floor(seconds / 60)
    rest = F.lpad(F.format_string("%.1f", seconds - minutes * 60), 4, "0")
    return F.when(seconds < 1, F.concat(F.format_string("%.0f", seconds * 1000), F.lit("ms"))).when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m"), rest, F.lit("s")))


def date_label(timestamp: Column, otherwise: Column) -> Column:
    """``2024-01-31 10:20`` of an ISO time, in its own zone; of anything else the first 15 characters of ``otherwise``."""
    iso = F.regexp_extract(timestamp, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$", 0)
    good = (iso != "") & F.try_to_timestamp(F.substring(F.replace(iso, F.lit("T"), F.lit(" ")), 1, 16), F.lit("yyyy-MM-dd HH:mm")).isNotNull()
    return F.when(good, F.concat(F.substring(iso, 1, 10), F.lit(" "), F.substring(iso, 12, 5))).otherwise(F.substring(otherwise, 1, 15))


def spark_cell(value: Column, low: Column, high: Column) -> Column:
    """One cell of a sparkline; a flat series stands in the middle."""
    cells = "▁▂▃▄▅▆▇█"
    place = F.when(high > low, F.floor((value - low) / F.when(high > low, high - low) * (len(cells) - 1))).otherwise(F.lit(4))
    return F.substring(F.lit(cells), (place + 1).cast("int"), F.lit(1))


def json_without_fence(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stripped(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
