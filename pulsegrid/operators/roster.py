"""The roster of followed channels: ranks in polls, hysteresis, presence, and online and offline events.

polls: poll_ms, streamer_id, login, viewers (a larger number stands higher; ties go to the smaller id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOIN, LEAVE, TTL_MS = 15, 30, 180_000


def eligible(polls: DataFrame, streamers: DataFrame) -> DataFrame:
    """Polls without channels that do not allow clips; unknown ones stay."""
    return polls.join(streamers.filter("allows_clipping = false").select("streamer_id"), "streamer_id", "left_anti")


def ranked(polls: DataFrame, leave: int = LEAVE) -> DataFrame:
    """rank of each channel in its poll, down to `leave`."""
    line = Window.partitionBy("poll_ms").orderBy(F.desc("viewers"), "streamer_id")
    return polls.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= leave)


def _missed(ranks: DataFrame, times: DataFrame) -> DataFrame:
    """The first poll without a rank after each run of polls with one: streamer_id and poll_ms. Later ones change nothing.

    The windows run over polls, a row each, and over the sightings of a channel.
    """
    following = F.lead("poll_ms").over(Window.orderBy("poll_ms"))
    polls = times.select("poll_ms").distinct().withColumn("_next", following)
    again = F.lead("poll_ms").over(Window.partitionBy("streamer_id").orderBy("poll_ms"))
    seen = ranks.join(polls, "poll_ms").withColumn("_again", again)
    gone = seen.filter("_next IS NOT NULL AND (_again IS NULL OR _again > _next)")
    return gone.select("streamer_id", F.col("_next").alias("poll_ms"), F.lit(None).cast("int").alias("rank"))


def roster(ranks: DataFrame, times: DataFrame, join: int = JOIN, leave: int = LEAVE) -> DataFrame:
    """streamer_id, poll_ms, rank (null: not among the first `leave`), joined: whether it is followed after the poll.

    There is a row for each rank and for the first poll that a channel misses; after that it is not followed.
    """
    signal = F.when(F.col("rank") <= join, 1).when(F.col("rank").isNull() | (F.col("rank") > leave), 0)
    line = Window.partitionBy("streamer_id").orderBy("poll_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranks.select("streamer_id", "poll_ms", "rank").unionByName(_missed(ranks, times))
    return rows.withColumn("joined", F.coalesce(F.last(signal, ignorenulls=True).over(line), F.lit(0)) == 1)


def changes(followed: DataFrame, disabled: DataFrame) -> DataFrame:
    """joins and leaves by poll: streamer_id, poll_ms, change (join, leave), reason (disabled, exited) of a leave."""
    line = Window.partitionBy("streamer_id").orderBy("poll_ms")
    was = F.coalesce(F.lag("joined").over(line), F.lit(False))
    off = disabled.select("streamer_id").distinct().withColumn("_off", F.lit(True))
    moved = followed.withColumn("_was", was).filter("joined != _was").join(off, "streamer_id", "left")
    return moved.select(
        "streamer_id",
        "poll_ms",
        F.when(F.col("joined"), "join").otherwise("leave").alias("change"),
        F.when(~F.col("joined"), F.when(F.col("_off"), "disabled").otherwise("exited")).alias("reason"),
    )


def _gap(time: Column, before: Column, ttl_ms: int) -> Column:
    return before.isNull() | (time - before >= ttl_ms)


def online_events(ranks: DataFrame, join: int = JOIN, ttl_ms: int = TTL_MS) -> DataFrame:
    """A channel at rank `join` or better that was not seen among the ranks within the time to live."""
    line = Window.partitionBy("streamer_id").orderBy("poll_ms")
    gone = _gap(F.col("poll_ms"), F.lag("poll_ms").over(line), ttl_ms)
    return ranks.withColumn("_gone", gone).filter(F.col("_gone") & (F.col("rank") <= join)).select(
        F.lit("online").alias("event_type"),
        F.col("streamer_id").alias("broadcaster_id"),
        F.col("login").alias("broadcaster_login"),
        "rank",
        F.floor(F.col("poll_ms") / 1000).alias("timestamp"),
    )


def offline_events(followed: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """A followed channel that has left the ranks and was last seen at least the time to live ago; rank 0."""
    line = Window.partitionBy("streamer_id").orderBy("poll_ms")
    seen = F.last(F.when(F.col("rank").isNotNull(), F.col("poll_ms")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    was = F.coalesce(F.lag("joined").over(line), F.lit(False))
    rows = followed.withColumn("_seen", seen).withColumn("_was", was)
    return rows.filter(F.col("_was") & F.col("rank").isNull() & (F.col("poll_ms") - F.col("_seen") >= ttl_ms)).select(
        F.lit("offline").alias("event_type"),
        F.col("streamer_id").alias("broadcaster_id"),
        F.lit(0).alias("rank"),
        F.floor(F.col("poll_ms") / 1000).alias("timestamp"),
    )


def active_gauge(followed: DataFrame) -> DataFrame:
    """poll_ms, active: how many channels are followed; a channel that is followed after a poll has a rank in it."""
    return followed.groupBy("poll_ms").agg(F.count_if("joined").alias("active"))
