"""The detector on streams: per-bucket counts, then a state machine per key.

Counting is a window aggregate in the JVM, which also drops and counts what comes later than the watermark. The second
operator gets each key and bucket once, complete, and walks every bucket that the watermark has passed, by the rules of
the batch form. Its state is one value; it is cleared once the retained span after the last count has passed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.config import DetectorConfig
from pulsegrid.operators.episodes import Hold, State, advance

TOLERANCE = "5 seconds"
EPISODE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("started_at", T.LongType()),
        T.StructField("fired_at", T.LongType()),
        T.StructField("peak_at", T.LongType()),
        T.StructField("peak_intensity", T.DoubleType()),
        T.StructField("peak_count", T.LongType()),
        T.StructField("peak_mean", T.DoubleType()),
        T.StructField("peak_std", T.DoubleType()),
        T.StructField("start_mean", T.DoubleType()),
        T.StructField("start_std", T.DoubleType()),
        T.StructField("capped", T.BooleanType()),
    ]
)


def bucket_counts(messages: DataFrame, key: str, ts: str, cfg: DetectorConfig, tolerance: str = TOLERANCE) -> DataFrame:
    """key, bucket start (as a timestamp) and n of each closed bucket. messages must still hold the rows that only move the
    watermark, with a column `counted` that is false for them.

    These are left out after the aggregate: the optimizer moves a filter before it below the watermark.
    """
    counted = F.count_if("counted") if "counted" in messages.columns else F.count("*")
    by = F.window(ts, f"{cfg.bucket_seconds} seconds"), F.col(key).cast("string").alias("key")
    return messages.withWatermark(ts, tolerance).groupBy(*by).agg(counted.alias("n")).filter("n > 0")


#: What is kept of a key: the last bucket that was walked, whether any was, the last report's bucket, the counts that are
#: still retained, and an open hold.
_HOLD = T.StructType([T.StructField(n, T.LongType() if n in ("started_at", "peak_at", "peak_count") else T.DoubleType()) for n in Hold._fields])
_WALK = T.StructType(
    [
        T.StructField("cursor", T.LongType()),
        T.StructField("seen", T.BooleanType()),
        T.StructField("fire", T.LongType()),
        T.StructField("regressed", T.LongType()),
        T.StructField("seconds", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("hold", _HOLD),
    ]
)


class _Walk:
    """A key's state while it is walked."""

    def __init__(self, kept: tuple | None):
        self.cursor, self.seen, fire, regressed, seconds, counts, hold = kept or (None, False, None, 0, [], [], None)
        self.state = State(Hold(*hold) if hold else None, fire, regressed or 0)
        self.counts = dict(zip(seconds or [], counts or [], strict=True))

    def kept(self) -> tuple:
        hold = tuple(self.state.hold) if self.state.hold else None
        return self.cursor, self.seen, self.state.last_fire, self.state.regressed, list(self.counts), list(self.counts.values()), hold

    def add(self, second: int, n: int) -> None:
        self.counts[second] = n
        if self.cursor is None or (not self.seen and second <= self.cursor):
            self.cursor = second - 1

    def to(self, due: int, cfg: DetectorConfig) -> list[tuple]:
        """Walks all buckets up to `due` that have a count within the retained span; the reports."""
        out: list[tuple] = []
        seconds = sorted(self.counts)
        while self.cursor is not None and self.cursor < due and seconds:
            second = self.cursor + 1
            i = bisect_right(seconds, second) - 1
            if i < 0 or second - seconds[i] > cfg.retained:  # a silent span: nothing is evaluated until the next count
                if i + 1 == len(seconds):
                    break
                self.cursor = seconds[i + 1] - 1
                continue
            while i + 1 < len(seconds) and seconds[i + 1] - seconds[i] <= cfg.retained + 1:
                i += 1
            last = min(due, seconds[i] + cfg.retained)
            out += self._stretch(seconds, second, last, cfg)
            self.cursor, self.seen = last, True
        if self.cursor is not None:
            self.counts = {s: self.counts[s] for s in seconds if s > self.cursor - cfg.retained}
        return out

    def _stretch(self, seconds: list[int], first: int, last: int, cfg: DetectorConfig) -> list[tuple]:
        """Measures buckets first to last by running totals, and has the state machine look at those that can change it."""
        w, b = cfg.window, cfg.baseline
        low = first - w - b
        n = np.zeros(last - low + 1, dtype=np.int64)
        for s in seconds[bisect_right(seconds, low - 1) : bisect_right(seconds, last)]:
            n[s - low] = self.counts[s]
        at = np.arange(first, last + 1) - low
        total, squares = np.cumsum(n), np.cumsum(n * n)
        filled = np.minimum.accumulate(np.where(n > 0, np.arange(len(n)), len(n))[::-1])[::-1]
        window = total[at] - total[at - w]
        s1, s2 = total[at - w] - total[at - w - b], squares[at - w] - squares[at - w - b]
        oldest = filled[at - w - b + 1]
        observed = np.where(oldest <= at - w, at - w + 1 - oldest, 0)
        spread = b * s2 - s1 * s1
        ok = (observed >= cfg.gate) & (spread > 0)
        mean, std = s1 / float(b), np.sqrt(np.maximum(spread, 0) / float(b * (b - 1)))
        level = np.where(ok, (window / float(w) - mean) / np.where(ok, std, 1), -np.inf)
        high = np.flatnonzero(ok & (level >= cfg.k)).tolist()
        out, k = [], 0
        while k < len(at):
            if self.state.hold is None:  # only a high bucket opens a hold
                nth = bisect_left(high, k)
                if nth == len(high):
                    break
                k = high[nth]
            measured = (int(window[k]), float(mean[k]), float(std[k]), float(level[k])) if ok[k] else (int(window[k]), 0.0, 0.0, None)
            before = self.state.regressed
            self.state, report = advance(self.state, first + k, *measured, cfg.k, cfg.hold_cap, cfg.cooldown)
            if report:
                out.append(report)
            if self.state.regressed > before:
                self._saw(first + k)
            k += 1
        return out

    def _saw(self, second: int) -> None:
        """A bucket before the peak of the hold was evaluated."""

    def over(self, due: int, cfg: DetectorConfig) -> bool:
        """Whether nothing that is kept can matter any more."""
        last, fire = max(self.counts, default=None), self.state.last_fire
        silent = self.cursor is not None and (last is None or due > last + cfg.retained)
        return silent and self.state.hold is None and (fire is None or due - fire > cfg.cooldown)


class _Walker(StatefulProcessor):
    def __init__(self, cfg: DetectorConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("walk", _WALK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        walk = self._load()
        for part in rows:
            for second, n in zip(part["second"].tolist(), part["n"].tolist(), strict=True):
                walk.add(second, n)
        yield self._walk(key, walk, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._walk(key, self._load(), timerValues)

    def _load(self) -> _Walk:
        return _Walk(tuple(self.value.get()) if self.value.exists() else None)

    def _due(self, timerValues) -> int:
        """The last bucket that the watermark has passed."""
        return timerValues.getCurrentWatermarkInMs() // (self.cfg.bucket_seconds * 1000) - 1

    def _walk(self, key, walk: _Walk, timerValues) -> pd.DataFrame:
        cfg, width, due = self.cfg, self.cfg.bucket_seconds * 1000, self._due(timerValues)
        out = [(str(key[0]), *report) for report in walk.to(due, cfg)]
        if walk.over(due, cfg):
            self.value.clear()
        else:
            self.value.update(walk.kept())
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((max(due, walk.cursor if walk.cursor is not None else due) + 2) * width)
        return pd.DataFrame(out, columns=EPISODE.names)


def episodes(counted: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """The reports of the state machine as a stream. Needs the RocksDB state store."""
    rows = counted.select("key", F.floor(F.unix_seconds("window.start") / cfg.bucket_seconds).alias("second"), "n", F.col("window.end").alias("_end"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Walker(cfg),
        outputStructType=EPISODE,
        outputMode="Append",
        timeMode="EventTime",
    )
