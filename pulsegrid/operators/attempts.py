"""Attempts to make clips, from a log: outcomes, schedules and what follows from an outcome.

log: anomaly_id, phase (create, metadata), attempt_no, status, clip_id (null: empty answer), key, duration_seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.cards import retryable

INITIAL, CREATE, METADATA = 0, [0, 2, 4], [5, 10, 15, 30]


def outcomes(log: DataFrame) -> DataFrame:
    """anomaly_id, clip_id, found (metadata), reason of failure, disabled (the last error forbids clips).

    Attempts after the one that decided are not counted: the first success or the first error that is not worth another.
    """
    failed = F.col("status") >= 400
    failed = failed | (F.col("status") == 0)
    made = ~failed & F.col("clip_id").isNotNull()
    create = F.col("phase") == "create"
    stop = create & (made | (failed & ~retryable(F.col("status"))))
    last = log.groupBy("anomaly_id").agg(F.min(F.when(stop, F.col("attempt_no"))).alias("_stop"))
    counted = create & (F.col("_stop").isNull() | (F.col("attempt_no") <= F.col("_stop")))
    rows = log.join(last, "anomaly_id")
    found = rows.groupBy("anomaly_id").agg(
        F.min_by(F.when(counted & made, F.col("clip_id")), F.when(counted & made, F.col("attempt_no"))).alias("clip_id"),
        F.coalesce(F.bool_or(counted & failed), F.lit(False)).alias("_error"),
        F.max_by(F.when(counted & failed, F.col("status")), F.when(counted & failed, F.col("attempt_no"))).alias("_last"),
        F.coalesce(F.bool_or((F.col("phase") == "metadata") & made), F.lit(False)).alias("found"),
    )
    clip = F.col("clip_id").isNotNull()
    reason = F.when(clip & ~F.col("found"), "metadata_fetch").when(~clip, F.when(F.col("_error"), "api_error").otherwise("max_retries"))
    return found.select(
        "anomaly_id",
        "clip_id",
        (clip & F.col("found")).alias("found"),
        reason.alias("reason"),
        (~clip & F.coalesce(F.col("_last") == 403, F.lit(False))).alias("disabled"),
    )


def schedule(anomalies: DataFrame, initial: int = INITIAL, create: list[int] = CREATE, metadata: list[int] = METADATA) -> DataFrame:
    """Planned times (seconds from `at`) of each attempt if all before it come back empty: phase, attempt_no, planned_at."""
    if not create or not metadata:
        raise ValueError("no delays are given")
    plan, now = [], initial
    for phase, waits in (("create", create), ("metadata", metadata)):
        for i, wait in enumerate(waits):
            now += wait
            plan.append(F.struct(F.lit(phase).alias("phase"), F.lit(i + 1).alias("attempt_no"), F.lit(now).alias("after")))
    return anomalies.withColumn("_p", F.explode(F.array(*plan))).select(
        "anomaly_id",
        "_p.phase",
        "_p.attempt_no",
        (F.col("at") + F.col("_p.after")).alias("planned_at"),
    )


def applied(found: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What outcomes lead to: clips to insert, channels to flag, and counters by key and reason."""
    rows = found.join(keys, "anomaly_id")
    clips = rows.filter("found").select("clip_id", F.col("key").alias("broadcaster_id"))
    flags = rows.filter("disabled").select(F.col("key").alias("streamer_id")).distinct()
    counters = rows.groupBy("key", F.coalesce("reason", F.lit("success")).alias("outcome")).agg(F.count("*").alias("n"))
    return clips, flags, counters
