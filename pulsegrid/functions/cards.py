"""Scalar functions of the result pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The levels of intensity and their names, highest first.
LEVELS = [(11.0, "Legendary"), (9.0, "Unhinged"), (7.0, "Popping Off")]
#: What is worth another try.
RETRYABLE = [408, 429, 500, 502, 503, 504]


def intensity_label(intensity: Column) -> Column:
    out = F.lit("Unknown")
    for level, name in reversed(LEVELS):
        out = F.when(intensity >= level, name).otherwise(out)
    return out


def intensity_threshold(intensity: Column) -> Column:
    out = F.lit(0.0)
    for level, _ in reversed(LEVELS):
        out = F.when(intensity >= level, level).otherwise(out)
    return out


def relative_time(then_ms: Column, now_ms: Column | int) -> Column:
    """How long ago, in words; from a week on, the UTC date."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    minutes = F.floor((now - then_ms) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(then_ms / 86_400_000).cast("int")).cast("string")
    words = F.when(then_ms.isNull(), "Unknown time").when(minutes < 1, "Just now").when(minutes < 60, ago(minutes, "minute"))
    return words.when(hours < 24, ago(hours, "hour")).when(days < 7, ago(days, "day")).otherwise(date)


def count_label(n: Column, level: Column, top: float = LEVELS[0][0]) -> Column:
    """N clips at L or higher; the top level has nothing above it."""
    return F.concat(
        n.cast("string"),
        F.when(n == 1, " clip at ").otherwise(" clips at "),
        level.cast("int").cast("string"),
        F.when(level < top, " or higher").otherwise(""),
    )


def embed_url(url: Column, host: str) -> Column:
    return F.concat(url, F.lit(f"&parent={host}"))


def card_login(login: Column, short: bool = False) -> Column:
    """The name a card shows; short: where the channel is named in passing."""
    return F.coalesce(login, F.lit("Unknown" if short else "Unknown Streamer"))


def card_thumbnail(url: Column, fallback: str) -> Column:
    """The picture of a card; a missing or blank address takes the fallback."""
    return F.when(F.trim(url) != "", url).otherwise(F.lit(fallback))


def escape_attribute(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def iso_utc(ms: Column) -> Column:
    """ISO 8601 in UTC, with microseconds where there is a fraction of a second; null stays null."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")).cast("string")
    rest = F.pmod(ms, F.lit(86_400_000))
    clock = F.format_string("T%02d:%02d:%02d", F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60)
    part = F.when(ms % 1000 != 0, F.format_string(".%03d000", F.pmod(ms, F.lit(1000)))).otherwise("")
    return F.when(ms.isNotNull(), F.concat(day, clock, part, F.lit("+00:00")))


def retryable(status: Column) -> Column:
    """status 0: the connection failed."""
    return (status == 0) | status.isin(RETRYABLE)


def delay_list(text: Column) -> Column:
    """Comma-separated numbers; blanks are skipped, and a text without any raises an error."""
    found = F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    return F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.lit("no delays are given")))
