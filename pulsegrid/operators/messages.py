"""Chat messages: parsing, filters, event time, slices and enrichment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.tables import written

#: Fixed value: what a command looks like.
COMMAND = "^![a-zA-Z0-9]+"
TOLERANCE_MS = 5000

MESSAGE = T.StructType(
    [
        T.StructField("broadcaster_id", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("sent_at", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_name", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("emotes", T.MapType(T.StringType(), T.StringType())),
                    T.StructField("badges", T.MapType(T.StringType(), T.StringType())),
                    T.StructField("is_subscriber", T.BooleanType()),
                    T.StructField("is_mod", T.BooleanType()),
                ]
            ),
        ),
    ]
)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, taken as UTC whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    return day * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")


def bucket(ms: Column, seconds: int = 1) -> Column:
    """floor, so that times before 1970 fall into the bucket that holds them."""
    return F.floor(ms / (1000 * seconds))


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """The message in each JSON line; lines that are no message (no object, or without a broadcaster) are dropped."""
    parsed = lines.withColumn("_message", F.from_json(line, MESSAGE))
    return parsed.filter(F.col("_message.broadcaster_id").isNotNull()).select(*[c for c in lines.columns if c != line], "_message.*")


def drop_commands(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.filter(~F.coalesce(F.col(text), F.lit("")).rlike(COMMAND))


def event_time(messages: DataFrame, record_ms: str, sent_at: str = "sent_at") -> DataFrame:
    """event_ms: the source's clock, or the record's where the source gives none."""
    return messages.withColumn("event_ms", F.coalesce(F.col(sent_at).try_cast("long"), F.col(record_ms)))


def time_slice(messages: DataFrame, start: datetime, end: datetime, sent_at: str = "sent_at") -> DataFrame:
    """Messages with start <= sent_at < end. Bounds without a UTC offset are refused."""
    if start.utcoffset() is None or end.utcoffset() is None:
        raise ValueError("bounds need a UTC offset")
    low, high = (round(x.timestamp() * 1000) for x in (start, end))
    return messages.filter((F.col(sent_at) >= low) & (F.col(sent_at) < high))


def head_slice(messages: DataFrame, arrival: str | list[str], n: int) -> DataFrame:
    """The first n messages to arrive."""
    return messages.orderBy(*([arrival] if isinstance(arrival, str) else arrival)).limit(n)


def enrich(messages: DataFrame, channels: DataFrame, login: str = "login") -> DataFrame:
    """Adds channel_id by lower-cased login; messages of unknown channels are dropped. channels: login, channel_id."""
    known = channels.select(F.lower("login").alias("_login"), "channel_id").dropDuplicates(["_login"])
    return messages.withColumn(login, F.lower(login)).join(known, F.col(login) == F.col("_login")).drop("_login")


def payload(raw: DataFrame) -> DataFrame:
    """A message record from channel_id, ingest_ms, sent_ms, text and, if there, user_id, user_name, badges, is_subscriber, is_mod."""
    has = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), default) if c in raw.columns else default
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    badges = F.coalesce("badges", none) if "badges" in raw.columns else none
    message_id = F.col("message_id") if "message_id" in raw.columns else F.expr("uuid()")
    meta = F.struct(
        none.alias("emotes"),
        badges.alias("badges"),
        has("is_subscriber", "boolean", F.lit(False)).alias("is_subscriber"),
        has("is_mod", "boolean", F.lit(False)).alias("is_mod"),
    )
    return raw.select(
        F.col("channel_id").alias("broadcaster_id"),
        F.col("ingest_ms").alias("timestamp"),
        F.col("sent_ms").alias("sent_at"),
        message_id.alias("message_id"),
        "text",
        has("user_id", "bigint", F.lit(0).cast("long")).alias("user_id"),
        has("user_name", "string", F.lit("")).alias("user_name"),
        meta.alias("metadata"),
    )


def keyed(records: DataFrame, key: str) -> DataFrame:
    """Records as a keyed sink takes them: key as text, value as JSON."""
    return records.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*records.columns)).alias("value"))


def ingest_lag(messages: DataFrame) -> DataFrame:
    return messages.withColumn("lag_ms", F.col("timestamp") - F.col("sent_at"))


def late_rows(messages: DataFrame, arrival: str | list[str], event_ms: str, tolerance_ms: int = TOLERANCE_MS, ranges: int | None = None) -> DataFrame:
    """Adds watermark_ms and late: the largest event time that came before, less the tolerance and 1 ms.

    Rows are dealt out by ranges of their arrival, which hold about as many each however arrival numbers lie, and written.
    Running maxima are taken within ranges; those of whole ranges, a row each, are taken over all.
    """
    order = [arrival] if isinstance(arrival, str) else arrival
    dealt = messages.repartitionByRange(ranges, *order) if ranges else messages.repartitionByRange(*order)
    rows = written(dealt.withColumn("_chunk", F.spark_partition_id()))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_chunk").agg(F.max(event_ms).alias("_top")).withColumn("_earlier", F.max("_top").over(before)).drop("_top")
    inside = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("_run", F.max(event_ms).over(inside)).join(tops, "_chunk")
    mark = F.greatest("_run", "_earlier") - tolerance_ms - 1
    return run.withColumn("watermark_ms", mark).withColumn(
        "late",
        F.coalesce(F.col(event_ms) <= mark, F.lit(False)),
    ).drop("_run", "_earlier", "_chunk")


def replay_lines(decided: DataFrame) -> DataFrame:
    """A line for each evaluated second: second, key, and peak_at, count, mean, std, intensity where it reports."""
    report = F.format_string(
        "%d %s SPIKE peak_at=%d count=%d mean=%.4f std=%.4f intensity=%.4f",
        "second",
        "key",
        "peak_at",
        "peak_count",
        "peak_mean",
        "peak_std",
        "peak_intensity",
    )
    return decided.withColumn("line", F.when(F.col("peak_at").isNotNull(), report).otherwise(F.format_string("%d %s no-spike", "second", "key")))
