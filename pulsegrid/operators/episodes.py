"""Episodes: the peak-hold state machine over readings, folded in parallel.

Only edge rows matter: measured rows of intensity k or more, and the first measured row after one, if it comes within the
hold cap. A key's edges are cut into segments wherever the gap is longer than both the hold cap and the cooldown, since any
hold is dropped and any cooldown over by then. Segments are independent, so a key of any length is folded by many tasks.
Edges and cuts look back no further than cap and cooldown, so they are found by stretches of a key with a lead-in; only
rows of segments that go on from one stretch to the next meet along the whole key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.config import DetectorConfig
from pulsegrid.operators import scans

PARAMS = ["k", "cap", "cooldown"]
_FIELDS = [
    ("started_at", T.LongType()),
    ("fired_at", T.LongType()),
    ("peak_at", T.LongType()),
    ("peak_intensity", T.DoubleType()),
    ("peak_count", T.LongType()),
    ("peak_mean", T.DoubleType()),
    ("peak_std", T.DoubleType()),
    ("start_mean", T.DoubleType()),
    ("start_std", T.DoubleType()),
    ("capped", T.BooleanType()),
]


class Hold(NamedTuple):
    started_at: int
    start_mean: float
    start_std: float
    peak_at: int
    peak_intensity: float
    peak_count: int
    peak_mean: float
    peak_std: float


class State(NamedTuple):
    """regressed: how often a bucket before the peak of its hold was given, which changes nothing else."""

    hold: Hold | None = None
    last_fire: int | None = None
    regressed: int = 0


def advance(
    state: State,
    second: int,
    count: int,
    mean: float,
    std: float,
    intensity: float | None,
    k: float,
    cap: int,
    cooldown: int,
) -> tuple[State, tuple | None]:
    """The state after one bucket, and the report it makes, if any. intensity: None if the bucket cannot be measured."""
    hold, last, regressed = state
    if hold is not None and hold.peak_at > second:
        return state._replace(regressed=regressed + 1), None
    if hold is not None and second - hold.peak_at > cap:
        hold = None
    if intensity is None:
        return State(hold, last, regressed), None
    if intensity < k:
        return (State(hold, last, regressed), None) if hold is None else (State(None, second, regressed), _report(hold, second, False))
    if hold is None:
        if last is not None and second - last <= cooldown:
            return State(None, last, regressed), None
        hold = Hold(second, mean, std, second, intensity, count, mean, std)
    elif intensity > hold.peak_intensity:
        hold = hold._replace(peak_at=second, peak_intensity=intensity, peak_count=count, peak_mean=mean, peak_std=std)
    if second - hold.started_at >= cap:
        return State(None, second, regressed), _report(hold, second, True)
    return State(hold, last, regressed), None


def _report(hold: Hold, second: int, capped: bool) -> tuple:
    return hold.started_at, second, hold.peak_at, hold.peak_intensity, hold.peak_count, hold.peak_mean, hold.peak_std, hold.start_mean, hold.start_std, capped


def sweep(read: DataFrame, params: DataFrame) -> DataFrame:
    """Episodes of every setting. params: rows of k, cap, cooldown, and gate if readings are to pass a stricter one."""
    has_gate = "gate" in params.columns
    names = [*PARAMS, *(["gate"] if has_gate else [])]
    measured = read.filter(F.col("intensity").isNotNull())
    # a few settings for each reading, not a product of two large sides
    chosen = params.select(*names).distinct().collect()
    settings = F.array(*[F.struct(*[F.lit(r[n]).cast("double" if n == "k" else "long").alias(n) for n in names]) for r in chosen])
    cap, quiet = (max([0, *(r[n] for r in chosen)]) for n in ("cap", "cooldown"))
    # the row before an edge and the edge before that
    read_back = scans.led_in(measured, "second", cap + max(cap, quiet) + 2)
    rows = read_back.withColumn("_p", F.explode(settings)).select(
        "key",
        "second",
        "observed",
        "window_count",
        "mean",
        "std",
        "intensity",
        "_part",
        "_own",
        *[F.col(f"_p.{n}").alias(n) for n in names],
    )
    if has_gate:
        rows = rows.filter(F.col("observed") >= F.col("gate"))
    line = Window.partitionBy("key", *names, "_part").orderBy("second")
    high = F.col("intensity") >= F.col("k")
    before = F.col("second") - F.lag("second").over(line)
    was = F.coalesce(F.lag("_high").over(line) & (before <= F.col("cap")), F.lit(False))
    edges = rows.withColumn("_high", high).withColumn("_was", was).filter("_high OR _was")
    far = F.coalesce(F.col("second") - F.lag("second").over(line) > F.greatest("cap", "cooldown"), F.lit(True))
    own = edges.withColumn("_cut", F.when(far, F.col("second"))).filter(F.col("_part") == F.col("_own"))
    # a segment is told by its first row; rows before the first cut of a stretch find it among the last cuts of all stretches
    whole, so_far = Window.partitionBy("key", *names, "_part"), lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = own.withColumn("_first", F.max("_cut").over(so_far(line))).withColumn("_last", F.max("_cut").over(whole))
    crossing = F.col("_first").isNull() | (F.col("_cut") == F.col("_last"))
    laned = known.withColumn("_lane", F.when(~F.coalesce(crossing, F.lit(False)), F.col("_part")))
    lane = Window.partitionBy("key", *names, "_lane").orderBy("second")
    segments = laned.withColumn("segment", F.coalesce("_first", F.max("_first").over(so_far(lane))))
    kept = segments.select("key", *names, "segment", "second", F.col("window_count").cast("long").alias("window_count"), "mean", "std", "intensity")
    schema = T.StructType([kept.schema["key"], *[kept.schema[n] for n in names], *[T.StructField(n, t) for n, t in _FIELDS]])

    by = ["key", *names, "segment"]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Segments in a row, each from a new state; one may reach over parts."""
        state, last = State(), None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r[: len(by)] != last:
                    state, last = State(), r[: len(by)]
                state, report = advance(state, r.second, r.window_count, r.mean, r.std, r.intensity, r.k, r.cap, r.cooldown)
                if report:
                    out.append((*last[:-1], *report))
            yield pd.DataFrame(out, columns=schema.names)

    # a task folds many segments: most have a few rows, and a group of its own for each would cost more than its rows
    return kept.repartition(*by).sortWithinPartitions(*by, "second").mapInPandas(fold, schema)


def one_setting(spark, cfg: DetectorConfig) -> DataFrame:
    return spark.createDataFrame([(float(cfg.k), cfg.hold_cap, cfg.cooldown)], "k double, cap long, cooldown long")


def episodes(read: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """key and what an episode holds, from opening to report."""
    return sweep(read, one_setting(read.sparkSession, cfg)).drop(*PARAMS)


def anomalies(found: DataFrame, bucket_seconds: int = 1) -> DataFrame:
    """The event of each report, at its peak, in milliseconds."""
    return found.select(
        "key",
        (F.col("peak_at") * bucket_seconds * 1000).alias("detected_at"),
        F.col("peak_count").alias("message_count"),
        F.col("peak_mean").alias("baseline_mean"),
        F.col("peak_std").alias("baseline_std"),
        F.col("peak_intensity").alias("intensity"),
    )


def next_start(found: DataFrame, *by: str) -> Column:
    return F.lead("started_at").over(Window.partitionBy("key", *by).orderBy("started_at"))


def isolated(found: DataFrame, horizon: int) -> DataFrame:
    """Episodes with a spread at their start and no other of their key starting within `horizon` after their report."""
    alone = F.coalesce(F.col("_next") > F.col("fired_at") + horizon, F.lit(True))
    return found.withColumn("_next", next_start(found)).filter(alone & (F.col("start_std") > 0)).drop("_next")


BANDS = [0, 3, 5, 10, 20, 30, 60, 300]


def gaps(found: DataFrame, by: str | None = None) -> DataFrame:
    """gap: buckets from a report to the next opening of its key, with its band."""
    rows = found.withColumn("gap", next_start(found) - F.col("fired_at")).filter("gap IS NOT NULL")
    band = F.lit(None).cast("string")
    for low, high in zip(BANDS, [*BANDS[1:], None], strict=True):
        band = F.when(F.col("gap") >= low, f"{low}-{high}" if high else f"{low}+").otherwise(band)
    return rows.withColumn("band", band)


def parity(left: DataFrame, right: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Episodes of one side only, or whose peaks differ by more than the tolerance: side, key, fired_at, peak_at, difference."""
    on = ["key", "fired_at", "peak_at"]
    a, b = (x.select(*on, F.col("peak_intensity").alias(n)) for x, n in ((left, "a"), (right, "b")))
    both = a.join(b, on, "full")
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").when(F.abs(F.col("a") - F.col("b")) > tolerance, "both")
    return both.withColumn("side", side).filter("side IS NOT NULL").select("side", *on, (F.col("a") - F.col("b")).alias("difference"))
