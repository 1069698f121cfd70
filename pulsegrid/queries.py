"""The registered queries of the burst engine, over the tables as FIXTURES.md maps them, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid import oracle as o
from pulsegrid.config import DetectorConfig
from pulsegrid.functions import cards
from pulsegrid.operators import attempts, clips, episodes, messages, monitors, readings, roster, study
from pulsegrid.sources import contract, logs, versioned
from pulsegrid.sources import lines as lines_
from pulsegrid.streaming import detector, late
from pulsegrid.streaming import sources as streams

CFG = DetectorConfig(window=o.W, baseline=o.B, k=o.K, hold_cap=o.CAP, cooldown=o.COOLDOWN, fraction=o.FRACTION, bucket_seconds=o.HOUR)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages."""
    text = F.concat(F.when(F.col("event_type") == "error", "!").otherwise(""), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        messages.epoch_ms(F.col("ts")).alias("ms"),
        text.alias("text"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(
        F.col("user_id").alias("broadcaster_id"),
        (F.col("ms") + F.col("event_id") % 7).alias("timestamp"),
        F.col("ms").alias("sent_at"),
        F.col("event_id").cast("string").alias("message_id"),
        F.col("text").alias("text"),
        F.col("event_type").alias("user_name"),
    )
    return chat(spark, sf_dir).select("event_id", F.to_json(record).alias("line"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.bucket_counts(chat(spark, sf_dir), "event_type", "ms", CFG)


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.readings(counts(spark, sf_dir), CFG)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.episodes(read(spark, sf_dir), CFG)


def clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat(spark, sf_dir).select(
        F.col("event_id").alias("clip_id"),
        F.col("user_id").alias("broadcaster_id"),
        F.col("ms").alias("detected_at"),
        (F.col("value") / 10).alias("intensity"),
    )


def streamers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("streamer_id"),
        F.col("c_name").alias("streamer_login"),
        (F.col("c_acctbal") >= 0).alias("allows_clipping"),
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("ms") / 86_400_000) * 86_400_000
    daily = chat(spark, sf_dir).groupBy(day.alias("poll_ms"), F.col("user_id").alias("streamer_id")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("viewers")
    )
    return daily.join(streamers(spark, sf_dir).select("streamer_id", F.col("streamer_login").alias("login")), "streamer_id", "left")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def top_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: episodes of the event stream, strongest first."""
    return found(spark, sf_dir).orderBy(F.desc("peak_intensity"), "key", "fired_at")


# messages

_M = f"WITH {o.MESSAGES} "


@query(
    _M + "SELECT event_id, user_id AS broadcaster_id, ms + event_id % 7 AS timestamp, ms AS sent_at, event_id::VARCHAR AS message_id, text, event_type AS user_name FROM m"
)
def parse_messages(spark, sf_dir):
    return messages.parse(lines(spark, sf_dir)).drop("user_id", "metadata")


@query(_M + "SELECT event_id, text FROM m WHERE NOT regexp_matches(text, '^![a-zA-Z0-9]+')")
def drop_commands(spark, sf_dir):
    return messages.drop_commands(chat(spark, sf_dir)).select("event_id", "text")


@query(_M + "SELECT event_id, CASE WHEN event_type = 'view' THEN ms + 1000 ELSE ms END AS event_ms FROM m")
def event_time(spark, sf_dir):
    rows = chat(spark, sf_dir).select(
        "event_id",
        (F.col("ms") + 1000).alias("record_ms"),
        F.when(F.col("event_type") != "view", F.col("ms").cast("string")).otherwise("unknown").alias("sent_at"),
    )
    return messages.event_time(rows, "record_ms").select("event_id", "event_ms")


@query(_M + "SELECT event_id, ms FROM m WHERE ms >= epoch_ms(TIMESTAMP '2024-01-05 00:00:00') AND ms < epoch_ms(TIMESTAMP '2024-01-12 12:00:00')")
def time_slice(spark, sf_dir):
    return messages.time_slice(
        chat(spark, sf_dir),
        datetime(2024, 1, 5, tzinfo=UTC),
        datetime(2024, 1, 12, 12, tzinfo=UTC),
        "ms",
    ).select("event_id", "ms")


@query(_M + "SELECT event_id, text FROM m ORDER BY event_id LIMIT 500")
def head_slice(spark, sf_dir):
    return messages.head_slice(chat(spark, sf_dir), "event_id", 500).select("event_id", "text")


@query(_M + "SELECT m.event_id, lower(c_name) AS login, c_custkey AS channel_id FROM m JOIN customer ON user_id = c_custkey")
def channel_enrich(spark, sf_dir):
    rows = chat(spark, sf_dir).select("event_id", F.format_string("CUSTOMER#%09d", "user_id").alias("login"))
    channels = streamers(spark, sf_dir).select(F.col("streamer_login").alias("login"), F.col("streamer_id").alias("channel_id"))
    return messages.enrich(rows, channels)


@query(
    _M + "SELECT user_id::VARCHAR AS key, concat('{\"broadcaster_id\":', user_id, ',\"timestamp\":', ms + 1, ',\"sent_at\":', ms, ',\"message_id\":\"', event_id, '\",\"text\":\"', text, '\",\"user_id\":0,\"user_name\":\"', event_type, '\",\"metadata\":{\"emotes\":{},\"badges\":{},\"is_subscriber\":false,\"is_mod\":false}}') AS value FROM m"
)
def message_payload(spark, sf_dir):
    raw = chat(spark, sf_dir).select(
        F.col("user_id").alias("channel_id"),
        (F.col("ms") + 1).alias("ingest_ms"),
        F.col("ms").alias("sent_ms"),
        F.col("event_id").cast("string").alias("message_id"),
        "text",
        F.col("event_type").alias("user_name"),
    )
    return messages.keyed(messages.payload(raw), "broadcaster_id")


@query(_M + "SELECT event_id, event_id % 7 AS lag_ms FROM m")
def ingest_lag(spark, sf_dir):
    return messages.ingest_lag(messages.parse(lines(spark, sf_dir))).select("event_id", "lag_ms")


@query(
    _M + "SELECT count(*) AS rows_read, 0.0::DOUBLE AS unparsed_share, 0.0::DOUBLE AS no_sent_at_share, min(event_id % 7)::BIGINT AS lag_min, "
    "quantile_cont(event_id % 7, 0.5)::DOUBLE AS lag_p50, max(event_id % 7)::BIGINT AS lag_max FROM m"
)
def source_contract(spark, sf_dir):
    return contract.report(lines(spark, sf_dir), "line")


@query(
    "SELECT event_id, concat('pulse-', event_type) AS container_name, event_type AS log, 'stdout' AS stream, json_extract_string(props, '$.k')::INTEGER AS k FROM events"
)
def log_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    line = F.to_json(
        F.struct(
            F.col("event_type").alias("log"),
            F.lit("stdout").alias("stream"),
            F.struct(F.concat(F.lit("image|pulse-"), F.col("event_type"), F.lit("|1")).alias("tag")).alias("attrs"),
        )
    )
    return logs.fields(rows.withColumn("line", line), "line", r"^[^|]*\|([^|]*)\|").select(
        "event_id",
        "container_name",
        "log",
        "stream",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


# counts and readings

_R = f"WITH {o.COUNTS} "


@query(_R + "SELECT * FROM c")
def second_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@query(_R + "SELECT * FROM grid")
def dense_grid(spark, sf_dir):
    return readings.dense_grid(counts(spark, sf_dir), CFG)


@query(_R + "SELECT key, second, wc AS window_count FROM sums")
def window_total(spark, sf_dir):
    return readings.moments(counts(spark, sf_dir), CFG).select("key", "second", "window_count")


@query(
    _R + f"SELECT key, second, s1, s2, round(s1 / {o.B}.0, 6) AS mean, round(sqrt(({o.B} * s2 - s1 * s1) / {o.B * (o.B - 1)}.0), 6) AS std FROM sums"
)
def baseline_stats(spark, sf_dir):
    rows = readings.moments(counts(spark, sf_dir), CFG)
    return rounded(
        rows.select(
            "key",
            "second",
            "s1",
            "s2",
            (F.col("s1") / float(o.B)).alias("mean"),
            F.sqrt((o.B * F.col("s2") - F.col("s1") * F.col("s1")) / float(o.B * (o.B - 1))).alias("std"),
        ),
        "mean",
        "std",
    )


@query(_R + "SELECT key, second, observed FROM sums")
def observed_seconds(spark, sf_dir):
    return read(spark, sf_dir).select("key", "second", F.col("observed").cast("long").alias("observed"))


@query(
    _R + "SELECT key, second, observed, status, window_count, round(mean, 6) AS mean, round(std, 6) AS std, round(intensity, 6) AS intensity FROM readings"
)
def readings_table(spark, sf_dir):
    return rounded(read(spark, sf_dir).withColumn("observed", F.col("observed").cast("long")), "mean", "std", "intensity")


@query(_R + "SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM readings GROUP BY status")
def reading_status(spark, sf_dir):
    return rounded(readings.status_totals(read(spark, sf_dir)), "share")


@query(
    _R + f"SELECT round((max(second) - min(second)) * {o.HOUR} / 3600.0, 6) AS hours, round(count(*) * {o.HOUR} / 3600.0, 6) AS key_hours, count(DISTINCT key) AS "
    f"keys FROM readings"
)
def span_hours(spark, sf_dir):
    return rounded(
        readings.span(read(spark, sf_dir), o.HOUR).withColumns({c: F.col(c).cast("double") for c in ("hours", "key_hours")}),
        "hours",
        "key_hours",
    )


@query(
    _R + """SELECT key, min(second) AS start, max(second) AS "end" FROM (SELECT *, second - row_number() OVER (PARTITION BY key ORDER BY second) AS run FROM readings) GROUP BY key, run"""
)
def appearances(spark, sf_dir):
    return readings.appearances(read(spark, sf_dir))


@query(_R + "," + o.RUNS + """ SELECT key, start, "end", round(peak, 6) AS peak FROM runs""")
def elevated_runs(spark, sf_dir):
    return rounded(readings.elevated_runs(read(spark, sf_dir), o.K), "peak")


@query(
    _R + "," + o.RUNS + ", n AS (SELECT (\"end\" - start + 1)::DOUBLE AS x FROM runs) SELECT count(*) AS n, " + ", ".join(
        f"round(quantile_cont(x, {q}), 6) AS {name}" for name,
        q in readings.RUN_POINTS.items()
    ) + " FROM n"
)
def run_quantiles(spark, sf_dir):
    return rounded(readings.run_quantiles(readings.elevated_runs(read(spark, sf_dir), o.K)), *readings.RUN_POINTS)


_LATE_MS = "CASE WHEN event_type = 'click' THEN ms - 7200000 ELSE ms END"


_AUDIT = (
    _M + f", e AS (SELECT event_id, {_LATE_MS} AS event_ms FROM m), w AS (SELECT *, max(event_ms) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
    f"PRECEDING) - 5001 AS watermark_ms FROM e) SELECT event_id, event_ms, watermark_ms, coalesce(event_ms <= watermark_ms, false) AS late FROM w"
)


@query(_AUDIT)
def late_audit(spark, sf_dir):
    rows = chat(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_type") == "click", F.col("ms") - 7_200_000).otherwise(F.col("ms")).alias("event_ms"),
    )
    return messages.late_rows(rows, "event_id", "event_ms")


def _as_files(spark, rows: DataFrame, order: str, value: str) -> str:
    """A folder of text files that hold the rows' lines in order."""
    folder = streams.shared_folder(spark)
    rows.repartitionByRange(4, order).sortWithinPartitions(order).select(value).write.text(folder)
    return folder


@query(_AUDIT)
def late_audit_lines(spark, sf_dir):
    """The audit of lines of text files, in the order they were written."""
    rows = chat(spark, sf_dir).select("event_id", F.to_json(F.struct("event_id", "event_type", "ms")).alias("line"))
    read_ = lines_.numbered_lines(spark, _as_files(spark, rows, "event_id", "line"))
    event = F.from_json("line", "event_id long, event_type string, ms long")
    rows = read_.select("file", "line_no", event.alias("e")).select("file", "line_no", "e.*")
    rows = rows.select("file", "line_no", "event_id", F.when(F.col("event_type") == "click", F.col("ms") - 7_200_000).otherwise(F.col("ms")).alias("event_ms"))
    return messages.late_rows(rows, ["file", "line_no"], "event_ms").drop("file", "line_no")


@query(_M + "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM m ORDER BY event_id LIMIT 500")
def head_lines(spark, sf_dir):
    """The first lines of text files."""
    rows = chat(spark, sf_dir).select("event_id", F.col("event_id").cast("string").alias("line"))
    read_ = lines_.numbered_lines(spark, _as_files(spark, rows, "event_id", "line"))
    first = messages.head_slice(read_, ["file", "line_no"], 500)
    place = F.row_number().over(Window.orderBy("file", "line_no")) - 1  # of 500 rows
    return first.select(F.col("line").cast("long").alias("event_id"), place.cast("long").alias("place"))


@query(_M + """, l AS (SELECT event_id, user_id, ms + event_id % 7 AS t FROM m WHERE event_id % 50 <> 0)
SELECT min(t) AS started_ms, max(t) AS ended_ms, (max(t) - min(t)) / 1000.0::DOUBLE AS seconds, count(*) AS messages, (SELECT count(*) FROM m WHERE event_id % 50 = 0) AS errors,
round(count(*) / greatest((max(t) - min(t)) / 1000.0::DOUBLE, 1.0), 2) AS per_second, true AS has_sent_at, count(DISTINCT user_id) AS keys,
'broadcaster_id,message_id,sent_at,text,timestamp,user_name' AS sample_keys, true AS completed FROM l""")
def capture_meta(spark, sf_dir):
    """What is told of a capture in which some lines are cut off."""
    line = F.when(F.col("event_id") % 50 == 0, F.substring("line", 1, 9)).otherwise(F.col("line"))
    captured = lines(spark, sf_dir).select(F.from_json(line, messages.MESSAGE).alias("m")).select("m.*")
    return streams.capture_report(captured, 3600.0).drop("bytes").withColumn("sample_keys", F.array_join("sample_keys", ","))


# episodes and studies


def _e(**lists) -> str:
    return f"WITH RECURSIVE {o.episodes(**lists)} "


_EPISODE = (
    "key, started_at, fired_at, peak_at, round(peak_intensity, 6) AS peak_intensity, peak_count, round(peak_mean, 6) AS peak_mean, round(peak_std, 6) AS "
    "peak_std, round(start_mean, 6) AS start_mean, round(start_std, 6) AS start_std, capped"
)
_DOUBLES = ("peak_intensity", "peak_mean", "peak_std", "start_mean", "start_std")


@query(_e() + f"SELECT {_EPISODE} FROM episodes")
def episode_table(spark, sf_dir):
    return rounded(found(spark, sf_dir), *_DOUBLES)


@query(
    _e() + f"SELECT key, peak_at * {o.HOUR * 1000} AS detected_at, peak_count AS message_count, round(peak_mean, 6) AS baseline_mean, round(peak_std, 6) AS "
    f"baseline_std, round(peak_intensity, 6) AS intensity FROM episodes"
)
def anomalies(spark, sf_dir):
    return rounded(episodes.anomalies(found(spark, sf_dir), o.HOUR), "baseline_mean", "baseline_std", "intensity")


_BAND = "CASE " + " ".join(
    f"WHEN gap >= {a} AND gap < {b} THEN '{a}-{b}'" for a,
    b in zip(episodes.BANDS, episodes.BANDS[1:], strict=False)
) + " WHEN gap >= 300 THEN '300+' END"


@query(
    _e(cooldown=(0,)) + f", ga AS (SELECT lead(started_at) OVER (PARTITION BY key ORDER BY started_at) - fired_at AS gap FROM episodes) SELECT {_BAND} AS band, count(*) AS n, "
    f"min(gap) AS shortest, max(gap) AS longest, round(quantile_cont(gap::DOUBLE, 0.5), 6) AS median FROM ga WHERE gap IS NOT NULL GROUP BY band"
)
def episode_gaps(spark, sf_dir):
    none = episodes.sweep(read(spark, sf_dir), study.params(spark, CFG, cooldown=[0]))
    points = {"shortest": 0.0, "longest": 1.0, "median": 0.5}
    bands = readings.quantiles(episodes.gaps(none), F.col("gap").cast("double"), points, "band")
    return rounded(bands.withColumns({c: F.col(c).cast("long") for c in ("shortest", "longest")}), "median")


_ALONE = (
    ", nx AS (SELECT *, lead(started_at) OVER (PARTITION BY key ORDER BY started_at) AS nxt FROM episodes), alone AS (SELECT * FROM nx WHERE (nxt IS NULL "
    "OR nxt > fired_at + {h}) AND start_std > 0)"
)


@query(_e() + _ALONE.format(h=24) + " SELECT key, started_at, fired_at FROM alone")
def isolated_episodes(spark, sf_dir):
    return episodes.isolated(found(spark, sf_dir), 24).select("key", "started_at", "fired_at")


@query(
    _e(k=(o.K, 1.7)) + ", a AS (SELECT * FROM episodes WHERE k = 1.5), b AS (SELECT * FROM episodes WHERE k = 1.7) SELECT CASE WHEN b.key IS NULL THEN 'left' WHEN a.key IS "
    "NULL THEN 'right' ELSE 'both' END AS side, coalesce(a.key, b.key) AS key, coalesce(a.fired_at, b.fired_at) AS fired_at, coalesce(a.peak_at, b.peak_at) "
    "AS peak_at, round(a.peak_intensity - b.peak_intensity, 6) AS difference FROM a FULL JOIN b ON a.key = b.key AND a.fired_at = b.fired_at AND a.peak_at "
    "= b.peak_at WHERE a.key IS NULL OR b.key IS NULL OR abs(a.peak_intensity - b.peak_intensity) > 0.001"
)
def parity_diff(spark, sf_dir):
    both = episodes.sweep(read(spark, sf_dir), study.params(spark, CFG, k=[o.K, 1.7]))
    return rounded(episodes.parity(both.filter("k = 1.5"), both.filter("k = 1.7")), "difference")


_KS = (1.0, 1.5, 2.0)


@query(_e(k=_KS) + f""", t AS (SELECT max(second) - min(second) AS width, count(*) AS n, count(DISTINCT key) AS keys FROM readings),
h AS (SELECT s.k, count(*) FILTER (WHERE intensity >= s.k) AS high FROM readings, settings s GROUP BY s.k),
e AS (SELECT k, count(*) AS episodes, quantile_cont(CASE WHEN start_mean > 0 THEN peak_count / {o.W}.0::DOUBLE / start_mean END, 0.5) AS ratio FROM episodes GROUP BY k),
b AS (SELECT k, max(n) AS most, count(*) AS firing FROM (SELECT k, key, count(*) AS n FROM episodes GROUP BY k, key) GROUP BY k)
SELECT h.k, round(high / n, 6) AS share, coalesce(episodes, 0) AS episodes, round(coalesce(episodes, 0) / n::DOUBLE, 6) AS per_key_hour,
round(coalesce(episodes, 0) / width::DOUBLE * 24, 6) AS per_day, round(ratio, 6) AS median_ratio, round(coalesce(firing, 0) / keys, 6) AS
firing_share, round(most / episodes, 6) AS busiest_share FROM h CROSS JOIN t LEFT JOIN e ON e.k = h.k LEFT JOIN b ON b.k = h.k""")
def trigger_sweep(spark, sf_dir):
    return rounded(
        study.trigger_sweep(read(spark, sf_dir), CFG, list(_KS)),
        "share",
        "per_key_hour",
        "per_day",
        "median_ratio",
        "firing_share",
        "busiest_share",
    )


_CAPS = (0, 2, 4, 8)


@query(_e(cap=_CAPS) + f""", u AS (SELECT key, second, intensity, second - row_number() OVER (PARTITION BY key ORDER BY second) AS run FROM readings WHERE intensity >= {o.K}),
v AS (SELECT key, second, max(intensity) OVER (PARTITION BY key, run ORDER BY second ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_peak FROM u),
j AS (SELECT e.*, CASE WHEN capped THEN (full_peak - peak_intensity) / full_peak END AS loss FROM episodes e LEFT JOIN v ON v.key = e.key AND v.second = e.started_at)
SELECT cap::BIGINT AS cap, count(*) AS episodes, count(*) FILTER (WHERE capped) AS capped, round(count(*) FILTER (WHERE capped) / count(*), 6) AS
capped_share, round(quantile_cont(loss, 0.5), 6) AS median_loss, round(quantile_cont(loss, 0.95), 6) AS p95_loss FROM j GROUP BY cap""")
def cap_sweep(spark, sf_dir):
    return rounded(study.cap_sweep(read(spark, sf_dir), CFG, list(_CAPS)), "capped_share", "median_loss", "p95_loss")


@query(
    _e(cooldown=(0, 3, 6, 24)) + ", n AS (SELECT cooldown::BIGINT AS cooldown, count(*) AS episodes FROM episodes GROUP BY cooldown) SELECT cooldown, episodes, (SELECT episodes FROM n "
    "WHERE cooldown = 0) - episodes AS suppressed, round(((SELECT episodes FROM n WHERE cooldown = 0) - episodes) / (SELECT episodes FROM n WHERE cooldown "
    "= 0), 6) AS share FROM n"
)
def cooldown_sweep(spark, sf_dir):
    return rounded(study.cooldown_sweep(read(spark, sf_dir), CFG, [3, 6, 24]), "share")


_OFFSETS = (6, 12, 24, 48)


@query(_e() + _ALONE.format(h=max(_OFFSETS)) + f""", w AS (SELECT "offset", a.start_mean, a.start_std, r.mean, r.std FROM alone a, (VALUES {", ".join(f"({x})" for x in _OFFSETS)}) t("offset"), readings
r WHERE r.key = a.key AND r.second = a.fired_at + "offset" AND r.intensity IS NOT NULL)
SELECT "offset", count(*) AS n, round(quantile_cont(mean / nullif(start_mean, 0), 0.5), 6) AS mean_ratio, round(quantile_cont(std / start_std, 0.5),
6) AS std_ratio, round(quantile_cont((std / nullif(mean, 0)) / nullif(start_std / nullif(start_mean, 0), 0), 0.5), 6) AS spread_ratio,
round(quantile_cont(start_std / std, 0.5), 6) AS sensitivity, round(quantile_cont(start_std / std, 0.1), 6) AS sensitivity_p10 FROM w GROUP BY
"offset" """)
def recovery_curve(spark, sf_dir):
    rows = read(spark, sf_dir)
    return rounded(
        study.recovery_curve(rows, episodes.episodes(rows, CFG), CFG, list(_OFFSETS)),
        "mean_ratio",
        "std_ratio",
        "spread_ratio",
        "sensitivity",
        "sensitivity_p10",
    )


@query(_e() + _ALONE.format(h=o.RETAINED) + f""", w AS (SELECT a.key, a.fired_at, r.second, r.intensity, r.window_count / {o.W}.0::DOUBLE AS level, r.mean, a.start_mean, a.start_std FROM alone a
JOIN readings r ON r.key = a.key AND r.second > a.fired_at + {o.COOLDOWN} AND r.second <= a.fired_at + {o.RETAINED} WHERE r.intensity < {o.K}),
v AS (SELECT key, fired_at, second, 'frozen' AS variant, (level - start_mean) / start_std AS x FROM w UNION ALL SELECT key, fired_at, second,
'spread', (level - mean) / start_std FROM w UNION ALL SELECT key, fired_at, second, 'excess', CASE WHEN start_mean > 0 THEN (level - mean) /
nullif(start_std * mean / start_mean, 0) END FROM w),
i AS (SELECT *, second - row_number() OVER (PARTITION BY key, fired_at, variant ORDER BY second) AS run FROM v WHERE x >= {o.K})
SELECT variant, count(*) AS seconds, count(DISTINCT (key, fired_at, run)) AS runs FROM i GROUP BY variant""")
def swallowed(spark, sf_dir):
    rows = read(spark, sf_dir)
    return study.swallowed(rows, episodes.episodes(rows, CFG), CFG)


_FRACTIONS = (0.8, 0.9, 0.95)


@query(_e(gate=tuple(int(o.B * f) for f in _FRACTIONS)) + f""", f AS (SELECT * FROM (VALUES {", ".join(f"({x}::DOUBLE, {int(o.B * x)}::BIGINT)" for x in _FRACTIONS)}) t(fraction, gate)),
a AS (SELECT max(observed) AS most FROM (SELECT *, second - row_number() OVER (PARTITION BY key ORDER BY second) AS run FROM readings) GROUP BY key, run)
SELECT fraction, gate, (SELECT count(*) FROM readings WHERE observed < f.gate) AS blocked, round((SELECT count(*) FROM readings WHERE observed <
f.gate) / (SELECT count(*) FROM readings), 6) AS blocked_share, (SELECT count(*) FROM a WHERE most < f.gate) AS never_clear, (SELECT count(*) FROM
episodes e WHERE e.gate = f.gate) AS episodes, round((SELECT max(peak_intensity) FROM episodes e WHERE e.gate = f.gate), 6) AS max_peak FROM f""")
def gate_sweep(spark, sf_dir):
    return rounded(study.gate_sweep(read(spark, sf_dir), CFG, list(_FRACTIONS)), "blocked_share", "max_peak")


@query(
    _R + f"SELECT count(*) AS n, round(quantile_cont(intensity, 0.5), 6) AS p50, round(quantile_cont(intensity, 0.999), 6) AS p999, round(max(intensity), 6) AS "
    f"max FROM readings WHERE status = 'ok' AND observed >= {o.GATE} AND observed < 45"
)
def admitted_profile(spark, sf_dir):
    return rounded(study.admitted_profile(read(spark, sf_dir), o.GATE, 45), "p50", "p999", "max")


_CLIP = {"watermark": 5.0, "transport": 0.1, "before": 7200.0, "after": 60.0}


@query(_e() + f""", d AS (SELECT delay, peak_at * {o.HOUR} - (fired_at * {o.HOUR} + 5.1 + delay) AS away FROM episodes, (VALUES (0.0::DOUBLE), (10.0), (3600.0)) t(delay))
SELECT delay, count(*) AS episodes, round(count(*) FILTER (WHERE away BETWEEN -7200 AND 60) / count(*), 6) AS share, round(quantile_cont((away + 7200)
/ 7260.0, 0.5), 6) AS median_position FROM d GROUP BY delay""")
def clip_coverage(spark, sf_dir):
    return rounded(study.clip_coverage(found(spark, sf_dir), [0.0, 10.0, 3600.0], o.HOUR, **_CLIP), "share", "median_position")


# clips

_CLIPS = "cl AS (SELECT event_id AS clip_id, user_id AS broadcaster_id, (epoch_us(ts) // 1000) AS detected_at, value / 10 AS intensity FROM events)"
_STREAMERS = "sr AS (SELECT c_custkey AS streamer_id, c_name AS streamer_login, c_acctbal >= 0 AS allows_clipping FROM customer)"


_SECOND_PAGE = (
    f"WITH {_CLIPS}, {_STREAMERS}, p AS (SELECT * FROM cl WHERE intensity >= 9.0 ORDER BY detected_at DESC, clip_id DESC LIMIT 24 OFFSET 24) SELECT clip_id, "
    f"broadcaster_id, detected_at, round(intensity, 6) AS intensity, streamer_login FROM p LEFT JOIN sr ON broadcaster_id = streamer_id"
)


@query(_SECOND_PAGE)
def clip_page(spark, sf_dir):
    return rounded(clips.clip_page(clip_rows(spark, sf_dir), streamers(spark, sf_dir), offset=24), "intensity")


@query(_SECOND_PAGE)
def clip_next_page(spark, sf_dir):
    """The second page by the cursor of the first."""
    rows, channels = clip_rows(spark, sf_dir), streamers(spark, sf_dir)
    return rounded(clips.next_page(rows, channels, clips.cursor(clips.next_page(rows, channels))), "intensity")


@query(
    f"WITH {_CLIPS} SELECT greatest(0, least(24, count(*) - 24))::BIGINT AS count, count(*) AS total_count, 24 + greatest(0, least(24, count(*) - 24)) < "
    f"count(*) AS has_more FROM cl WHERE intensity >= 9.0"
)
def clip_page_summary(spark, sf_dir):
    return clips.page_summary(clip_rows(spark, sf_dir), offset=24)


@query(f"WITH {_CLIPS} SELECT level, (SELECT count(*) FROM cl WHERE intensity >= level) AS n FROM (VALUES (11.0::DOUBLE), (9.0), (7.0)) t(level)")
def level_counts(spark, sf_dir):
    return clips.level_counts(clip_rows(spark, sf_dir))


_NOW = 1_706_659_200_000


@query(f"""WITH {_CLIPS}, {_STREAMERS}, a AS (SELECT *, floor(({_NOW} - detected_at) / 60000.0)::BIGINT AS mi FROM cl LEFT JOIN sr ON broadcaster_id = streamer_id),
t AS (SELECT *, floor(mi / 60.0)::BIGINT AS ho, floor(mi / 1440.0)::BIGINT AS da FROM a)
SELECT clip_id, CASE WHEN intensity >= 11 THEN 'Legendary' WHEN intensity >= 9 THEN 'Unhinged' WHEN intensity >= 7 THEN 'Popping Off' ELSE 'Unknown' END AS label,
CASE WHEN intensity >= 11 THEN 11.0::DOUBLE WHEN intensity >= 9 THEN 9.0 WHEN intensity >= 7 THEN 7.0 ELSE 0.0 END AS threshold,
CASE WHEN mi < 1 THEN 'Just now' WHEN mi < 60 THEN mi || ' minute' || CASE WHEN mi = 1 THEN '' ELSE 's' END || ' ago' WHEN ho < 24 THEN ho || ' hour'
|| CASE WHEN ho = 1 THEN '' ELSE 's' END || ' ago' WHEN da < 7 THEN da || ' day' || CASE WHEN da = 1 THEN '' ELSE 's' END || ' ago' ELSE
strftime(make_timestamp(detected_at * 1000), '%Y-%m-%d') END AS age,
coalesce(streamer_login, 'Unknown Streamer') AS login, 'https://clips.example/' || clip_id || '?v=1&parent=localhost' AS embed,
'&lt;b&gt;' || clip_id || '&lt;/b&gt;' AS escaped, strftime(make_timestamp(detected_at * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN detected_at % 1000
<> 0 THEN '.' || lpad((detected_at % 1000)::VARCHAR, 3, '0') || '000' ELSE '' END || '+00:00' AS detected FROM t""")
def clip_cards(spark, sf_dir):
    rows = clip_rows(spark, sf_dir).join(streamers(spark, sf_dir).withColumnRenamed("streamer_id", "broadcaster_id"), "broadcaster_id", "left")
    text = F.col("clip_id").cast("string")
    return rows.select(
        "clip_id",
        cards.intensity_label(F.col("intensity")).alias("label"),
        cards.intensity_threshold(F.col("intensity")).alias("threshold"),
        cards.relative_time(F.col("detected_at"), _NOW).alias("age"),
        cards.card_login(F.col("streamer_login")).alias("login"),
        cards.embed_url(F.concat(F.lit("https://clips.example/"), text, F.lit("?v=1")), "localhost").alias("embed"),
        cards.escape_attribute(F.concat(F.lit("<b>"), text, F.lit("</b>"))).alias("escaped"),
        cards.iso_utc(F.col("detected_at")).alias("detected"),
    )


@query(
    f"WITH {_CLIPS} SELECT level, n, n || CASE WHEN n = 1 THEN ' clip at ' ELSE ' clips at ' END || level::INTEGER || CASE WHEN level < 11 THEN ' or higher' "
    f"ELSE '' END AS label FROM (SELECT level, (SELECT count(*) FROM cl WHERE intensity >= level) AS n FROM (VALUES (11.0::DOUBLE), (9.0), (7.0)) t(level))"
)
def count_labels(spark, sf_dir):
    return clips.level_counts(clip_rows(spark, sf_dir)).withColumn("label", cards.count_label(F.col("n"), F.col("level")))


@query(
    f"WITH {_CLIPS}, s AS (SELECT * FROM cl WHERE intensity < 5) SELECT * FROM (SELECT clip_id, broadcaster_id, detected_at FROM cl WHERE clip_id NOT IN (SELECT clip_id FROM s))"
)
def insert_absent(spark, sf_dir):
    rows = clip_rows(spark, sf_dir)
    return clips.new_clips(rows.unionByName(rows), rows.filter("intensity < 5")).select("clip_id", "broadcaster_id", "detected_at")


@query(
    f"WITH {_CLIPS} SELECT (SELECT count(*) FROM cl WHERE NOT coalesce(intensity < 5, false))::BIGINT AS inserted, 2 * (SELECT count(*) FROM cl) - (SELECT "
    f"count(*) FROM cl WHERE NOT coalesce(intensity < 5, false))::BIGINT AS conflicts"
)
def insert_report(spark, sf_dir):
    rows = clip_rows(spark, sf_dir)
    return clips.insert_counts(rows.unionByName(rows), rows.filter("intensity < 5"))


@query(
    f"WITH {_CLIPS}, {_STREAMERS} SELECT streamer_id, streamer_login, CASE WHEN streamer_id IN (SELECT broadcaster_id FROM cl WHERE intensity >= 11) THEN "
    f"false ELSE allows_clipping END AS allows_clipping FROM sr"
)
def clipping_flag(spark, sf_dir):
    high = clip_rows(spark, sf_dir).filter("intensity >= 11").select(F.col("broadcaster_id").alias("streamer_id"))
    return clips.disable_clipping(streamers(spark, sf_dir), high)


@query("SELECT count(DISTINCT event_type) AS keys FROM events")
def distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_distinct("event_type").alias("keys"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def key_counters(spark, sf_dir):
    return clips.key_counters(table(spark, sf_dir, "events"), "user_id", "event_type")


# roster

_POLLS = (
    f"{_STREAMERS}, po AS (SELECT floor((epoch_us(ts) // 1000) / 86400000.0)::BIGINT * 86400000 AS poll_ms, user_id AS streamer_id, sum(round(value * "
    f"100)::BIGINT)::BIGINT AS viewers FROM events GROUP BY ALL)"
)
_RANKS = (
    f"{_POLLS}, el AS (SELECT * FROM po WHERE streamer_id NOT IN (SELECT streamer_id FROM sr WHERE NOT allows_clipping)), rk AS (SELECT * FROM (SELECT *, "
    f"row_number() OVER (PARTITION BY poll_ms ORDER BY viewers DESC, streamer_id) AS rank FROM el) WHERE rank <= 30)"
)
_ROSTER = f"""{_RANKS}, gr AS (SELECT f.streamer_id, t.poll_ms FROM (SELECT streamer_id, min(poll_ms) AS first FROM rk GROUP BY streamer_id) f JOIN (SELECT DISTINCT
poll_ms FROM po) t ON t.poll_ms >= f.first),
sg AS (SELECT gr.*, rk.rank, CASE WHEN rank <= 15 THEN 1 WHEN rank IS NULL THEN 0 END AS signal FROM gr LEFT JOIN rk USING (streamer_id, poll_ms)),
ro AS (SELECT streamer_id, poll_ms, rank, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY streamer_id ORDER BY poll_ms), 0) = 1 AS joined FROM sg),
pr AS (SELECT *, coalesce(lag(joined) OVER (PARTITION BY streamer_id ORDER BY poll_ms), false) AS was, max(CASE WHEN rank IS NOT NULL THEN poll_ms
END) OVER (PARTITION BY streamer_id ORDER BY poll_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ro)"""


def _ranks(spark, sf_dir) -> DataFrame:
    return roster.ranked(roster.eligible(polls(spark, sf_dir), streamers(spark, sf_dir)))


def _followed(spark, sf_dir) -> DataFrame:
    return roster.roster(_ranks(spark, sf_dir), polls(spark, sf_dir))


@query(f"WITH {_RANKS} SELECT poll_ms, streamer_id, viewers FROM el")
def eligible_streams(spark, sf_dir):
    return roster.eligible(polls(spark, sf_dir), streamers(spark, sf_dir)).select("poll_ms", "streamer_id", "viewers")


@query(f"WITH {_RANKS} SELECT poll_ms, streamer_id, rank::INTEGER AS rank FROM rk")
def poll_rank(spark, sf_dir):
    return _ranks(spark, sf_dir).select("poll_ms", "streamer_id", "rank")


@query(
    f"WITH {_ROSTER} SELECT streamer_id, poll_ms, rank::INTEGER AS rank, joined FROM (SELECT *, lag(rank) OVER (PARTITION BY streamer_id ORDER BY poll_ms) "
    f"AS before FROM ro) WHERE rank IS NOT NULL OR before IS NOT NULL"
)
def roster_state(spark, sf_dir):
    return _followed(spark, sf_dir)


@query(
    f"WITH {_ROSTER} SELECT streamer_id, poll_ms, CASE WHEN joined THEN 'join' ELSE 'leave' END AS change, CASE WHEN NOT joined THEN CASE WHEN streamer_id "
    f"IN (SELECT streamer_id FROM sr WHERE NOT allows_clipping) THEN 'disabled' ELSE 'exited' END END AS reason FROM pr WHERE joined <> was"
)
def roster_changes(spark, sf_dir):
    return roster.changes(_followed(spark, sf_dir), streamers(spark, sf_dir).filter("NOT allows_clipping"))


_DAY = 86_400_000


@query(
    f"WITH {_RANKS}, g AS (SELECT *, lag(poll_ms) OVER (PARTITION BY streamer_id ORDER BY poll_ms) AS prev FROM rk) SELECT 'online' AS event_type, "
    f"g.streamer_id AS broadcaster_id, streamer_login AS broadcaster_login, rank::INTEGER AS rank, poll_ms // 1000 AS timestamp FROM g LEFT JOIN sr ON "
    f"sr.streamer_id = g.streamer_id WHERE (prev IS NULL OR poll_ms - prev >= {2 * _DAY}) AND rank <= 15"
)
def online_events(spark, sf_dir):
    return roster.online_events(_ranks(spark, sf_dir), ttl_ms=2 * _DAY)


@query(
    f"WITH {_ROSTER} SELECT 'offline' AS event_type, streamer_id AS broadcaster_id, 0 AS rank, poll_ms // 1000 AS timestamp FROM pr WHERE was AND rank IS "
    f"NULL AND poll_ms - seen >= {_DAY}"
)
def offline_events(spark, sf_dir):
    return roster.offline_events(_followed(spark, sf_dir), ttl_ms=_DAY)


@query(f"WITH {_ROSTER} SELECT poll_ms, count(*) FILTER (WHERE joined) AS active FROM ro GROUP BY poll_ms")
def active_gauge(spark, sf_dir):
    return roster.active_gauge(_followed(spark, sf_dir))


_UPSERT = (
    f"WITH {_POLLS}, s AS (SELECT streamer_id, max(poll_ms) AS hi, min(poll_ms) AS lo FROM po GROUP BY 1) SELECT coalesce(sr.streamer_id, s.streamer_id) AS "
    f"streamer_id, streamer_login, coalesce(allows_clipping, true) AS allows_clipping, least(CASE WHEN sr.streamer_id IS NULL THEN lo ELSE 1704240000000 "
    f"END, coalesce(lo, 1704240000000)) AS first_seen_ms, greatest(CASE WHEN sr.streamer_id IS NULL THEN hi ELSE 1704240000000 END, coalesce(hi, "
    f"1704240000000)) AS last_seen_ms FROM sr FULL JOIN s ON s.streamer_id = sr.streamer_id"
)


@query(_UPSERT)
def upsert_streamers(spark, sf_dir):
    stored = streamers(spark, sf_dir).withColumns({"first_seen_ms": F.lit(1_704_240_000_000), "last_seen_ms": F.lit(1_704_240_000_000)})
    return clips.upsert_streamers(stored, polls(spark, sf_dir).select("streamer_id", "login", F.col("poll_ms").alias("seen_ms")))


# monitors: time in seconds, an hour a step

_H = o.HOUR
_KINDS = ("view", "purchase", "error", "signup")
_STEP = f"(floor((epoch_us(ts) // 1000) / {_H * 1000}.0)::BIGINT + 1) * {_H}"
_COUNTED = f"""co AS (SELECT {_STEP} AS tick, {", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in _KINDS)} FROM events GROUP BY 1),
ev AS (SELECT unnest(generate_series((SELECT min(tick) FROM co), (SELECT max(tick) FROM co), {_H})) AS tick),
sp AS (SELECT ev.tick, {", ".join(f"coalesce({k}, 0) AS {k}" for k in _KINDS)} FROM ev LEFT JOIN co ON co.tick = ev.tick)"""


def _events(spark, sf_dir) -> DataFrame:
    return chat(spark, sf_dir).select(F.floor(F.col("ms") / 1000).alias("tick"), F.col("event_type").alias("kind"), F.col("user_id").alias("key"))


def _counted(spark, sf_dir) -> DataFrame:
    return monitors.tumbling(_events(spark, sf_dir), _H, *_KINDS)


def _lasting(rows: str, condition: str, lasts: int, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    more = f", {by}" if by else ""
    return f"""h AS (SELECT *, coalesce({condition}, false) AS holds FROM {rows}), ru AS (SELECT *, row_number() OVER ({part} ORDER BY tick) - row_number() OVER
(PARTITION BY holds{more} ORDER BY tick) AS run FROM h)
SELECT {by + ", " if by else ""}min(tick) AS start, max(tick) AS "end" FROM ru WHERE holds GROUP BY run{more} HAVING max(tick) - min(tick) >= {lasts}"""


@query(f"WITH {_COUNTED}, " + _lasting("sp", "view > 1", 2 * _H))
def sustained(spark, sf_dir):
    return monitors.sustained(monitors.steps(_counted(spark, sf_dir), _H, *_KINDS), F.col("view") > 1, 2 * _H)


@query(
    f"WITH {_COUNTED}, q AS (SELECT *, sum(view) OVER (ORDER BY tick RANGE BETWEEN {2 * _H - 1} PRECEDING AND CURRENT ROW) AS vv FROM sp), " + _lasting(
        "q",
        "vv = 0 AND purchase + error + signup > 0",
        0,
    )
)
def no_messages(spark, sf_dir):
    return monitors.no_messages(_counted(spark, sf_dir), _H, 2 * _H, 0, "view", F.col("purchase") + F.col("error") + F.col("signup") > 0)


@query(
    f"WITH {_COUNTED}, q AS (SELECT tick, sum(error) OVER w AS f, sum(purchase) OVER w AS ok FROM sp WINDOW w AS (ORDER BY tick RANGE BETWEEN {6 * _H - 1} "
    f"PRECEDING AND CURRENT ROW)) SELECT tick, round(f / (ok + f + 0.001::DOUBLE), 6) AS ratio FROM q"
)
def failure_ratio(spark, sf_dir):
    return rounded(monitors.failure_ratio(_counted(spark, sf_dir), _H, 6 * _H, "error", "purchase"), "ratio")


@query(
    f"WITH {_COUNTED}, q AS (SELECT tick, sum(signup) OVER w AS a, sum(view) OVER w AS m FROM sp WINDOW w AS (ORDER BY tick RANGE BETWEEN {_H - 1} PRECEDING AND CURRENT ROW)), " + _lasting("q", "a = 0 AND m > 0", 0)
)
def stalled(spark, sf_dir):
    return monitors.stalled(_counted(spark, sf_dir), _H, _H, 0, "signup", "view")


@query(
    f"WITH k AS (SELECT (floor((epoch_us(ts) // 1000) / 86400000.0)::BIGINT + 1) * 86400 AS tick, user_id, count(*) FILTER (WHERE event_type = 'signup') AS "
    f"a, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY ALL) SELECT tick, count(*) AS firing, round(count(*) FILTER (WHERE p = 0) "
    f"/ count(*), 6) AS without_success FROM k WHERE a > 0 GROUP BY tick"
)
def success_share(spark, sf_dir):
    return rounded(monitors.success_share(_events(spark, sf_dir), 86_400, "signup", "purchase"), "without_success")


@query(
    "SELECT (floor((epoch_us(ts) // 1000) / 60000.0)::BIGINT + 1) * 60 AS tick, round(count(*) FILTER (WHERE event_type = 'view') / 60.0::DOUBLE, 6) AS rate FROM events GROUP BY 1"
)
def rate_1m(spark, sf_dir):
    return rounded(monitors.rate(monitors.tumbling(_events(spark, sf_dir), 60, "view"), 60, "view"), "rate")


@query(
    "SELECT (floor((epoch_us(ts) // 1000) / 300000.0)::BIGINT + 1) * 300 AS tick, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER "
    "(WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1"
)
def series_5m(spark, sf_dir):
    return monitors.tumbling(_events(spark, sf_dir), 300, "signup", "purchase", "error")


_METRIC = f"me AS (SELECT event_type AS series, {_STEP} AS tick, count(*) AS value FROM events GROUP BY ALL)"


@query(f"WITH {_METRIC}, " + _lasting("me", "value > 3", _H, "series"))
def metric_threshold(spark, sf_dir):
    step = (F.floor(F.col("tick") / _H) + 1) * _H
    return monitors.threshold(
        _events(spark, sf_dir).groupBy(F.col("kind").alias("series"), step.alias("tick")).agg(F.count("*").alias("value")),
        F.col("value") > 3,
        _H,
    )


@query(f"""WITH RECURSIVE a AS (SELECT user_id::VARCHAR AS name, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity, {_STEP} AS tick
FROM events WHERE event_type IN ('error', 'view')),
b AS (SELECT name, severity, tick, count(*) AS n FROM a WHERE severity = 'critical' OR (name, tick) NOT IN (SELECT (name, tick) FROM a WHERE severity = 'critical') GROUP BY ALL),
sent(name, severity, tick) AS (SELECT name, severity, min(tick) FROM b GROUP BY ALL UNION ALL
  SELECT s.name, s.severity, min(b.tick) FROM sent s JOIN b ON b.name = s.name AND b.severity = s.severity AND b.tick >= s.tick + CASE WHEN s.severity
= 'critical' THEN 14400 ELSE 86400 END GROUP BY s.name, s.severity, s.tick)
SELECT b.* FROM b JOIN sent USING (name, severity, tick)""")
def alert_rollup(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("kind IN ('error', 'view')").select(
        F.col("key").cast("string").alias("name"),
        F.when(F.col("kind") == "error", "critical").otherwise("warning").alias("severity"),
        ((F.floor(F.col("tick") / _H) + 1) * _H).alias("tick"),
    )
    return monitors.roll_up(rows, {"critical": 14_400}, 86_400)


# attempts: lineitem rows as tries, the first three of an order to create, the others to look up

_LOG = """lo AS (SELECT DISTINCT l_orderkey AS anomaly_id, CASE WHEN l_linenumber <= 3 THEN 'create' ELSE 'metadata' END AS phase, l_linenumber AS attempt_no, min(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 403 WHEN l_returnflag = 'R' THEN 503 ELSE 200 END) AS status, min(CASE WHEN l_returnflag = 'A' THEN 'clip-' || l_orderkey END) AS clip_id, min(l_suppkey) AS key FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _log(spark, sf_dir) -> DataFrame:
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), 403).when(F.col("l_returnflag") == "R", 503).otherwise(200)
    clip = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("clip-"), F.col("l_orderkey").cast("string")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("anomaly_id"), F.col("l_linenumber").alias("attempt_no")).agg(
        F.min(status).alias("status"),
        F.min(clip).alias("clip_id"),
        F.min("l_suppkey").alias("key"),
    )
    return rows.withColumn("phase", F.when(F.col("attempt_no") <= 3, "create").otherwise("metadata"))


_OUTCOMES = f"""{_LOG}, x AS (SELECT *, status >= 400 OR status = 0 AS failed, NOT (status >= 400 OR status = 0) AND clip_id IS NOT NULL AS made, status IN (0, 408,
429, 500, 502, 503, 504) AS again FROM lo),
y AS (SELECT anomaly_id, min(attempt_no) FILTER (WHERE phase = 'create' AND (made OR (failed AND NOT again))) AS stop FROM x GROUP BY 1),
z AS (SELECT x.*, phase = 'create' AND (stop IS NULL OR attempt_no <= stop) AS counted FROM x JOIN y USING (anomaly_id)),
oc AS (SELECT anomaly_id, min_by(clip_id, attempt_no) FILTER (WHERE counted AND made) AS clip_id, coalesce(bool_or(counted AND failed), false) AS err,
max_by(status, attempt_no) FILTER (WHERE counted AND failed) AS lst, coalesce(bool_or(phase = 'metadata' AND made), false) AS meta FROM z GROUP BY 1),
ou AS (SELECT anomaly_id, clip_id, clip_id IS NOT NULL AND meta AS found, CASE WHEN clip_id IS NOT NULL AND NOT meta THEN 'metadata_fetch' WHEN
clip_id IS NULL THEN CASE WHEN err THEN 'api_error' ELSE 'max_retries' END END AS reason, clip_id IS NULL AND coalesce(lst = 403, false) AS disabled
FROM oc)"""


@query(f"WITH {_OUTCOMES} SELECT * FROM ou")
def attempt_outcomes(spark, sf_dir):
    return attempts.outcomes(_log(spark, sf_dir))


@query(
    _e() + ", s AS (SELECT * FROM (VALUES ('create', 1, 0), ('create', 2, 2), ('create', 3, 6), ('metadata', 1, 11), ('metadata', 2, 21), ('metadata', 3, 36), "
    "('metadata', 4, 66)) t(phase, attempt_no, after)) SELECT key || '-' || fired_at AS anomaly_id, phase, attempt_no, fired_at + after AS planned_at FROM "
    "episodes, s"
)
def attempt_schedule(spark, sf_dir):
    rows = found(spark, sf_dir).select(F.concat_ws("-", "key", F.col("fired_at").cast("string")).alias("anomaly_id"), F.col("fired_at").alias("at"))
    return attempts.schedule(rows)


@query(
    f"WITH {_OUTCOMES}, k AS (SELECT anomaly_id, min(key) AS key FROM lo GROUP BY 1) SELECT key, coalesce(reason, 'success') AS outcome, count(*) AS n FROM "
    f"ou JOIN k USING (anomaly_id) GROUP BY ALL"
)
def outcome_apply(spark, sf_dir):
    return _applied(spark, sf_dir)[2]


_KEYED = f"{_OUTCOMES}, k AS (SELECT anomaly_id, min(key) AS key FROM lo GROUP BY 1)"


@query(f"WITH {_KEYED} SELECT clip_id, key AS broadcaster_id FROM ou JOIN k USING (anomaly_id) WHERE found")
def outcome_clips(spark, sf_dir):
    return _applied(spark, sf_dir)[0]


@query(f"WITH {_KEYED} SELECT DISTINCT key AS streamer_id FROM ou JOIN k USING (anomaly_id) WHERE disabled")
def outcome_flags(spark, sf_dir):
    return _applied(spark, sf_dir)[1]


def _applied(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = _log(spark, sf_dir)
    return attempts.applied(attempts.outcomes(log), log.groupBy("anomaly_id").agg(F.min("key").alias("key")))


# streams, run over all input there is


def _stream(spark, sf_dir) -> DataFrame:
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select("event_type", F.timestamp_millis(messages.epoch_ms(F.col("ts"))).alias("at"))


_CLOSED = f"(SELECT max(second) FROM c WHERE (second + 1) * {o.HOUR * 1000} <= (SELECT max(epoch_us(ts)) // 1000 - 5000 FROM events))"


@query(_R + f"SELECT key, second, n FROM c WHERE second <= {_CLOSED}")
def stream_counts(spark, sf_dir):
    closed = detector.bucket_counts(_stream(spark, sf_dir), "event_type", "at", CFG)
    return streams.drained(closed.select("key", F.floor(F.unix_seconds("window.start") / o.HOUR).alias("second"), "n"), "stream_counts")


@query(_R + f"SELECT key, second, n FROM c WHERE key <> 'error' AND second <= {_CLOSED}")
def stream_commands(spark, sf_dir):
    """Counts of a stream in which commands are not counted but move the watermark."""
    rows = _stream(spark, sf_dir).withColumn("counted", F.col("event_type") != "error")
    closed = detector.bucket_counts(rows, "event_type", "at", CFG)
    return streams.drained(closed.select("key", F.floor(F.unix_seconds("window.start") / o.HOUR).alias("second"), "n"), "stream_commands")


@query(_M + "SELECT user_id AS broadcaster_id, ms + event_id % 7 AS timestamp, ms AS sent_at, event_id::VARCHAR AS message_id, text FROM m")
def capture_stored(spark, sf_dir):
    """Messages that a stream appends to files, in two runs."""
    rows = messages.parse(lines(spark, sf_dir).drop("event_id"))
    for stream, folder in streams.arriving(rows, F.pmod(F.xxhash64("message_id"), F.lit(2)), 2):
        streams.capture(stream, f"{folder}/captured", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(messages.MESSAGE).json(f"{folder}/captured").select("broadcaster_id", "timestamp", "sent_at", "message_id", "text")


@query(_e() + f"SELECT {_EPISODE} FROM episodes WHERE fired_at <= {_CLOSED}")
def stream_anomalies(spark, sf_dir):
    rows = detector.episodes(detector.bucket_counts(_stream(spark, sf_dir), "event_type", "at", CFG), CFG)
    with _keyed_state(spark):
        return rounded(streams.drained(rows, "stream_anomalies"), *_DOUBLES)


@contextmanager
def _keyed_state(spark):
    """The state store that keyed state needs, for as long as a stream runs."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)


_PARTS = 5


@query(
    _e() + f"SELECT count(*) AS episodes, 0::BIGINT AS only_stream, 0::BIGINT AS only_batch, 0::BIGINT AS other_peak FROM episodes WHERE fired_at <= {_CLOSED}"
)
def stream_equals_batch(spark, sf_dir):
    """Episodes of a stream of several batches against those of the batch form; differences are counted."""
    rows = table(spark, sf_dir, "events").select("event_type", F.timestamp_millis(messages.epoch_ms(F.col("ts"))).alias("at"))
    ends = rows.agg(F.min(F.unix_millis("at")), F.max(F.unix_millis("at"))).first()
    share = F.least(F.lit(_PARTS - 1), F.floor((F.unix_millis("at") - ends[0]) * _PARTS / (ends[1] - ends[0] + 1)))
    with _keyed_state(spark):
        streamed = streams.fed(rows, share, _PARTS, lambda s: detector.episodes(detector.bucket_counts(s, "event_type", "at", CFG), CFG), "stream_equals_batch")
    closed = F.floor((F.lit(ends[1]) - 5000) / (o.HOUR * 1000)) - 1
    whole = found(spark, sf_dir).filter(F.col("fired_at") <= closed)
    odd = episodes.parity(streamed, whole, 1e-9).select("side").unionByName(streamed.select(F.lit("any").alias("side")))
    count = lambda side: F.count_if(F.col("side") == side)
    return odd.agg(
        count("any").alias("episodes"),
        count("left").alias("only_stream"),
        count("right").alias("only_batch"),
        count("both").alias("other_peak"),
    )


def _thirds(by: str):
    """Deals rows to three parts of a stream."""
    return F.pmod(F.xxhash64(by), F.lit(3))


@query(_UPSERT)
def upsert_stored(spark, sf_dir):
    """Streamers as a stream of sightings in three batches upserts them in a stored table; each batch comes twice."""
    stored = streamers(spark, sf_dir).withColumns({"first_seen_ms": F.lit(1_704_240_000_000), "last_seen_ms": F.lit(1_704_240_000_000)})
    schema = "streamer_id long, streamer_login string, allows_clipping boolean, first_seen_ms long, last_seen_ms long"
    kept = versioned.VersionedTable(spark, f"{streams.shared_folder(spark)}/streamers", schema, ["streamer_id"])
    kept.merge(stored, lambda old, new: new, "load", 0)
    seen = polls(spark, sf_dir).select("streamer_id", "login", F.col("poll_ms").alias("seen_ms"))
    for k, (stream, folder) in enumerate(streams.arriving(seen, _thirds("seen_ms"), 3)):
        for again in (f"{folder}/checkpoint", f"{folder}/again-{k}"):  # a lost checkpoint makes the batches come again
            streams.merge_stream(stream, kept, clips.upsert_streamers, "sightings" if again.endswith("checkpoint") else f"again-{k}", again).awaitTermination()
    return kept.read()


@query(f"WITH {_CLIPS} SELECT clip_id, broadcaster_id, detected_at FROM cl")
def clips_stored(spark, sf_dir):
    """Clips of a stream in three batches, each twice, put into a stored table that has some of them."""
    rows = clip_rows(spark, sf_dir)
    kept = versioned.VersionedTable(spark, f"{streams.shared_folder(spark)}/clips", "clip_id long, broadcaster_id long, detected_at long", ["clip_id"])
    some = rows.filter("intensity < 5").select(*kept.schema.names)
    kept.merge(some, lambda old, new: new, "load", 0)
    twice = rows.unionByName(rows).select(F.col("clip_id").cast("long").alias("clip_id"), F.col("broadcaster_id").cast("long").alias("broadcaster_id"), "detected_at")
    for stream, folder in streams.arriving(twice, _thirds("detected_at"), 3):
        streams.merge_stream(stream, kept, lambda old, new: old.unionByName(clips.new_clips(new, old)), "clips", f"{folder}/checkpoint").awaitTermination()
    return kept.read()


@query(f"WITH {_KEYED}, {_STREAMERS} SELECT streamer_id, streamer_login, CASE WHEN streamer_id IN (SELECT key FROM ou JOIN k USING (anomaly_id) WHERE disabled) THEN false ELSE allows_clipping END AS allows_clipping FROM sr")
def flags_stored(spark, sf_dir):
    """Channels of a stored table after the flags that follow from outcomes."""
    kept = versioned.VersionedTable(spark, f"{streams.shared_folder(spark)}/streamers", "streamer_id long, streamer_login string, allows_clipping boolean", ["streamer_id"])
    kept.merge(streamers(spark, sf_dir), lambda old, new: new, "load", 0)
    kept.merge(_applied(spark, sf_dir)[1], clips.disable_clipping, "outcomes", 0)
    return kept.read()


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def key_counters_stored(spark, sf_dir):
    """Running totals of a stream in three batches, of which changed ones are put into a stored table."""
    kept = versioned.VersionedTable(spark, f"{streams.shared_folder(spark)}/counters", "user_id long, event_type string, n long", ["user_id", "event_type"])
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("user_id"), "event_type")
    for stream, folder in streams.arriving(rows, _thirds("event_id"), 3):
        counted = clips.key_counters(stream, "user_id", "event_type")
        streams.merge_stream(counted, kept, versioned.replaced(kept.key), "counters", f"{folder}/checkpoint", "update").awaitTermination()
    return kept.read()


_LATE = "event_id % 97 = 0"


@query(f"""WITH n AS (SELECT event_type AS key, floor((epoch_us(ts) // 1000) / {o.HOUR * 1000}.0)::BIGINT AS second, event_id FROM events),
w AS (SELECT floor((max(epoch_us(ts)) // 1000 - 5000) / {o.HOUR * 1000}.0)::BIGINT - 1 AS due FROM events WHERE NOT ({_LATE}))
SELECT key, second, count(*) AS n FROM n, w WHERE {_LATE} AND second <= due GROUP BY ALL""")
def late_counted(spark, sf_dir):
    """Rows that come after all others, as the detector on raw rows counts them in their buckets."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.timestamp_millis(messages.epoch_ms(F.col("ts"))).alias("at"))
    with _keyed_state(spark):
        decided = streams.fed(rows, F.when(F.expr(_LATE), 1).otherwise(0), 2, lambda s: late.decisions(s, "event_type", "at", CFG), "late_counted")
    return decided.filter("kind = 'late'").select("key", "second", "n")


# readings and reports as they are stored and told


@query(
    _R + "SELECT key, second, observed, status, window_count, round(mean, 6) AS mean, round(std, 6) AS std, round(intensity, 6) AS intensity FROM readings"
)
def readings_stored(spark, sf_dir):
    """Readings written by parts and read again."""
    path = streams.shared_folder(spark)
    streams.write_readings(read(spark, sf_dir), path)
    return rounded(
        spark.read.parquet(path).select("key", "second", "observed", "status", "window_count", "mean", "std", "intensity"),
        "mean",
        "std",
        "intensity",
    )


@query(_R + "," + o.RUNS + """ SELECT key, start, "end", round(peak, 6) AS peak FROM runs""")
def runs_of_stored(spark, sf_dir):
    """Elevated runs of readings that are stored by key, which are found without an exchange."""
    path = streams.shared_folder(spark)
    stored = streams.store_readings(read(spark, sf_dir), f"readings_{path.rsplit('-', 1)[1]}", path)
    return rounded(readings.elevated_runs(stored, CFG.k), "peak")


@query(
    _R + "SELECT key, second, observed, status, window_count, round(mean, 6) AS mean, round(std, 6) AS std, round(intensity, 6) AS intensity FROM readings"
)
def readings_text(spark, sf_dir):
    """Readings written as tab-separated text and read again."""
    path = streams.shared_folder(spark)
    streams.write_readings_text(read(spark, sf_dir), path, {"window": CFG.window, "baseline": CFG.baseline})
    return rounded(streams.read_readings_text(spark, path, "string"), "mean", "std", "intensity")


@query(_R + f"SELECT key, second, observed FROM readings WHERE observed >= {o.GATE + 5}")
def gate_again(spark, sf_dir):
    return readings.gate_again(read(spark, sf_dir), CFG, o.GATE + 5).select("key", "second", "observed")


@query(_e() + """SELECT r.second, r.key, CASE WHEN e.key IS NULL THEN r.second || ' ' || r.key || ' no-spike'
ELSE r.second || ' ' || r.key || ' SPIKE peak_at=' || e.peak_at || ' count=' || e.peak_count || printf(' mean=%.4f std=%.4f intensity=%.4f',
e.peak_mean, e.peak_std, e.peak_intensity) END AS line
FROM readings r LEFT JOIN episodes e ON e.key = r.key AND e.fired_at = r.second ORDER BY r.second, r.key""")
def replay_lines(spark, sf_dir):
    """A line for each evaluated bucket, by (second, key)."""
    own = read(spark, sf_dir)
    reports = episodes.episodes(own, CFG).select(
        "key",
        F.col("fired_at").alias("second"),
        "peak_at",
        "peak_count",
        "peak_mean",
        "peak_std",
        "peak_intensity",
    )
    decided = own.select("key", "second").join(reports, ["key", "second"], "left")
    return messages.replay_lines(decided).select("second", "key", "line").orderBy("second", "key")


@query(f"""WITH {_RANKS}, g AS (SELECT *, lag(poll_ms) OVER (PARTITION BY streamer_id ORDER BY poll_ms) AS prev FROM rk)
SELECT g.streamer_id::VARCHAR AS key,
'{{"event_type":"online","broadcaster_id":' || g.streamer_id || CASE WHEN streamer_login IS NULL THEN '' ELSE ',"broadcaster_login":"' || streamer_login || '"' END || ',"rank":' || rank || ',"timestamp":' || poll_ms // 1000 || '}}'
AS value
FROM g LEFT JOIN sr ON sr.streamer_id = g.streamer_id WHERE (prev IS NULL OR poll_ms - prev >= {2 * _DAY}) AND rank <= 15""")
def lifecycle_payload(spark, sf_dir):
    """Online events as a keyed sink takes them."""
    return messages.keyed(roster.online_events(_ranks(spark, sf_dir), ttl_ms=2 * _DAY), "broadcaster_id")


@query(
    _M + "SELECT event_id, event_id % 5 AS first, 2 + (ms % 3 = 0)::INTEGER AS n, event_id % 5 + ms % 11 + CASE WHEN ms % 3 = 0 THEN 7 ELSE 0 END AS total FROM m"
)
def delay_lists(spark, sf_dir):
    """Lists of delays with blanks, as text."""
    text = F.concat_ws(",", F.col("event_id") % 5, F.lit(" "), F.col("ms") % 11, F.when(F.col("ms") % 3 == 0, " 7 ").otherwise(""))
    delays = chat(spark, sf_dir).select("event_id", cards.delay_list(text).alias("d"))
    return delays.select(
        "event_id",
        F.col("d")[0].cast("long").alias("first"),
        F.size("d").alias("n"),
        F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
    )


@query(
    f"WITH {_CLIPS}, {_STREAMERS} SELECT clip_id, coalesce(streamer_login, 'Unknown Streamer') AS login, coalesce(streamer_login, 'Unknown') AS short_login, "
    f"CASE WHEN clip_id % 3 = 0 THEN 'https://img.example/' || clip_id ELSE '/static/none.svg' END AS thumbnail FROM cl LEFT JOIN sr ON broadcaster_id = "
    f"streamer_id AND streamer_id % 2 = 0"
)
def card_defaults(spark, sf_dir):
    known = streamers(spark, sf_dir).filter("streamer_id % 2 = 0").withColumnRenamed("streamer_id", "broadcaster_id")
    rows = clip_rows(spark, sf_dir).join(known, "broadcaster_id", "left")
    url = F.when(F.col("clip_id") % 3 == 0, F.concat(F.lit("https://img.example/"), "clip_id")).when(F.col("clip_id") % 3 == 1, F.lit(" "))
    login = F.col("streamer_login")
    return rows.select(
        "clip_id",
        cards.card_login(login).alias("login"),
        cards.card_login(login, short=True).alias("short_login"),
        cards.card_thumbnail(url, "/static/none.svg").alias("thumbnail"),
    )
