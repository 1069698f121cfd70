"""Clips: filtered pages joined to their channels, counts by level, and writes that insert, flag or upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.cards import LEVELS

LEAST_INTENSITY, PAGE, MOST = 9.0, 24, 100


def page_arguments(
    min_intensity: str | float | None = None,
    limit: str | int | None = None,
    offset: str | int | None = None,
) -> tuple[float, int, int]:
    """Blank or missing values take the defaults; limits are put into 1 to 100; what is no number raises ValueError."""
    blank = lambda v: v is None or (isinstance(v, str) and not v.strip())
    least = LEAST_INTENSITY if blank(min_intensity) else float(min_intensity)
    if not least >= 0:
        raise ValueError("min_intensity must not be negative")
    return least, min(MOST, max(1, PAGE if blank(limit) else int(limit))), max(0, 0 if blank(offset) else int(offset))


def at_least(clips: DataFrame, least: float) -> DataFrame:
    return clips.filter(F.col("intensity").isNotNull() & (F.col("intensity") >= least))


def clip_page(clips: DataFrame, streamers: DataFrame, min_intensity=None, limit=None, offset=None) -> DataFrame:
    """The latest clips of that intensity with their channel's login (null if unknown). Ties go to the larger clip_id.

    The page is cut before the join, so that only its rows are looked up.
    """
    least, limit, offset = page_arguments(min_intensity, limit, offset)
    page = at_least(clips, least).orderBy(F.desc("detected_at"), F.desc("clip_id")).offset(offset).limit(limit)
    logins = streamers.select(F.col("streamer_id").alias("broadcaster_id"), "streamer_login")
    return page.join(logins, "broadcaster_id", "left")


def cursor(page: DataFrame) -> tuple[int | None, int] | None:
    """Where a page ends: (detected_at, clip_id) of its last clip; None of an empty page."""
    last = page.orderBy(F.asc_nulls_first("detected_at"), "clip_id").select("detected_at", "clip_id").first()
    return tuple(last) if last else None


def next_page(clips: DataFrame, streamers: DataFrame, after: tuple[int | None, int] | None = None, min_intensity=None, limit=None) -> DataFrame:
    """The page behind a cursor (the first one without), in the order of clip_page.

    Clips before the cursor are left out by filters that reach the scan, however far in it lies, and clips that are added
    at the front meanwhile move nothing.
    """
    least, limit, _ = page_arguments(min_intensity, limit)
    rows = at_least(clips, least)
    if after is not None:
        at, clip_id = after
        if at is None:
            rows = rows.filter(F.col("detected_at").isNull() & (F.col("clip_id") < clip_id))
        else:
            rows = rows.filter(F.col("detected_at").isNull() | (F.col("detected_at") <= at))
            rows = rows.filter(F.col("detected_at").isNull() | (F.col("detected_at") < at) | (F.col("clip_id") < clip_id))
    page = rows.orderBy(F.desc("detected_at"), F.desc("clip_id")).limit(limit)
    logins = streamers.select(F.col("streamer_id").alias("broadcaster_id"), "streamer_login")
    return page.join(logins, "broadcaster_id", "left")


def page_summary(clips: DataFrame, min_intensity=None, limit=None, offset=None) -> DataFrame:
    """count of the page, total_count, has_more, in one row."""
    least, limit, offset = page_arguments(min_intensity, limit, offset)
    total = at_least(clips, least).agg(F.count("*").alias("total_count"))
    count = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total_count") - offset))
    return total.select(count.cast("long").alias("count"), "total_count", (offset + count < F.col("total_count")).alias("has_more"))


def level_counts(clips: DataFrame) -> DataFrame:
    """level, n: clips at that level or higher, in one pass."""
    sums = clips.agg(*[F.count_if(F.col("intensity") >= level).alias(f"n{i}") for i, (level, _) in enumerate(LEVELS)])
    return sums.select(
        F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"n{i}").alias("n")) for i, (level, _) in enumerate(LEVELS)])).alias("_r")
    ).select("_r.*")


def key_counters(rows: DataFrame, *by: str) -> DataFrame:
    """Running totals by key, and by whatever else is given."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def new_clips(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """Arrived clips that are not stored yet, one for each clip_id (the earliest)."""
    columns = arrived.columns
    first = arrived.groupBy("clip_id").agg(F.min_by(F.struct(*columns), F.struct("detected_at", "broadcaster_id")).alias("_r")).select("_r.*")
    return first.join(stored.select("clip_id"), "clip_id", "left_anti").select(columns)


def insert_counts(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """inserted and conflicts of an insert of clips that are not there yet."""
    marked = arrived.groupBy("clip_id").agg(F.count("*").alias("_n")).join(
        stored.select("clip_id").distinct().withColumn("_there", F.lit(True)),
        "clip_id",
        "left",
    )
    inserted = F.count_if(F.col("_there").isNull())
    return marked.agg(inserted.alias("inserted"), (F.coalesce(F.sum("_n"), F.lit(0)) - inserted).alias("conflicts"))


def upsert_streamers(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """stored with every sighting (streamer_id, login, seen_ms): the first time stays, the last time and login are renewed."""
    old = stored.select("streamer_id", "streamer_login", "allows_clipping", "first_seen_ms", "last_seen_ms")
    new = seen.select(
        "streamer_id",
        F.col("login").alias("streamer_login"),
        F.lit(None).cast("boolean").alias("allows_clipping"),
        F.col("seen_ms").alias("first_seen_ms"),
        F.col("seen_ms").alias("last_seen_ms"),
    )
    return old.unionByName(new).groupBy("streamer_id").agg(
        F.max_by("streamer_login", F.struct("last_seen_ms", "streamer_login")).alias("streamer_login"),
        F.coalesce(F.bool_and("allows_clipping"), F.lit(True)).alias("allows_clipping"),
        F.min("first_seen_ms").alias("first_seen_ms"),
        F.max("last_seen_ms").alias("last_seen_ms"),
    )


def disable_clipping(streamers: DataFrame, disabled: DataFrame) -> DataFrame:
    """allows_clipping is false for the ids in disabled; ids that are not known do nothing."""
    off = disabled.select("streamer_id").distinct().withColumn("_off", F.lit(True))
    return streamers.join(off, "streamer_id", "left").withColumn(
        "allows_clipping",
        F.when(F.col("_off"), False).otherwise(F.col("allows_clipping")),
    ).drop("_off")
