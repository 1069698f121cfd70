"""The detector on raw rows, with late ones counted.

The aggregate of `detector` drops what comes behind the watermark. Here rows go to the keyed state as they are: a late row
is added to its bucket, and the buckets from there on are evaluated again, as far as they had been (or until the key's
counts lapse), on the counts that are still retained. The state machine goes on from where it is: a hold whose peak
lies behind the bucket that is evaluated again is passed through unchanged (a regressed evaluation), and a cooldown that
began later keeps it from opening. A batch's rows are counted together before anything is evaluated.

Late rows and regressed evaluations come out as rows beside the reports.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from pulsegrid.config import DetectorConfig
from pulsegrid.streaming.detector import EPISODE, TOLERANCE, _Walk, _Walker

#: kind is 'report' (of the episode's fields), 'late' (n rows of this bucket came late) or 'regressed' (the bucket was
#: evaluated while the key's hold had its peak behind it, n times).
DECISION = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("second", T.LongType()),
        T.StructField("n", T.LongType()),
        *EPISODE.fields[1:],
    ]
)
_NO_EPISODE = (None,) * (len(EPISODE) - 1)


class _LateWalk(_Walk):
    """A walk that goes back to late rows."""

    def __init__(self, kept: tuple | None):
        super().__init__(kept)
        self.again: set[int] = set()
        self.regressed: Counter[int] = Counter()

    def count(self, second: int, n: int) -> None:
        """Adds n rows to a bucket, which is evaluated again if it has been before."""
        if self.seen and second <= self.cursor:
            self.again.add(second)
            self.counts[second] = self.counts.get(second, 0) + n
        else:
            self.add(second, self.counts.get(second, 0) + n)

    def to(self, due: int, cfg: DetectorConfig) -> list[tuple]:
        """Evaluates buckets again from late rows on, then those that are due; the reports."""
        out: list[tuple] = []
        reached = None
        for start in sorted(self.again):
            if reached is None or start > reached:
                reached = self._chain(start, min(self.cursor, due), cfg, out)
        if reached == due:  # the cursor may have leapt over a silent span to counts that are not due yet
            self.cursor = due
        self.again.clear()
        return out + super().to(due, cfg)

    def _chain(self, start: int, end: int, cfg: DetectorConfig, out: list[tuple]) -> int:
        """Buckets from start to end, or until a retained span has passed since the last count; the last one evaluated.

        Within a silent span there is nothing to measure, so it is left out.
        """
        seconds = sorted(self.counts)
        last, at = min(end, seconds[-1] + cfg.retained), start
        while at <= last:
            i = bisect_right(seconds, at) - 1
            if i < 0 or at - seconds[i] > cfg.retained:
                at = seconds[i + 1]
                continue
            while i + 1 < len(seconds) and seconds[i + 1] - seconds[i] <= cfg.retained + 1:
                i += 1
            stop = min(last, seconds[i] + cfg.retained)
            out += self._stretch(seconds, at, stop, cfg)
            at = stop + 1
        return last

    def _saw(self, second: int) -> None:
        self.regressed[second] += 1


class _LateWalker(_Walker):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        walk = self._load()
        found: Counter[int] = Counter()
        for part in rows:
            found.update(part.loc[part["counted"], "second"].tolist())
        due = self._due(timerValues)
        late = [("late", str(key[0]), s, n, *_NO_EPISODE) for s, n in sorted(found.items()) if s <= due]
        for second, n in sorted(found.items()):
            walk.count(second, n)
        yield self._decided(key, walk, timerValues, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._decided(key, self._load(), timerValues, [])

    def _load(self) -> _LateWalk:
        return _LateWalk(tuple(self.value.get()) if self.value.exists() else None)

    def _decided(self, key, walk: _LateWalk, timerValues, late: list[tuple]) -> pd.DataFrame:
        reports = self._walk(key, walk, timerValues)
        told = [("report", k, fired, None, started, fired, *rest) for k, started, fired, *rest in reports.itertuples(index=False)]
        told += [("regressed", str(key[0]), s, n, *_NO_EPISODE) for s, n in sorted(walk.regressed.items())]
        return pd.DataFrame(late + told, columns=DECISION.names).astype(_KINDS)


_KINDS = {f.name: {"long": "Int64", "double": "Float64", "boolean": "boolean", "string": "object"}[f.dataType.simpleString().replace("bigint", "long")] for f in DECISION}


def decisions(messages: DataFrame, key: str, ts: str, cfg: DetectorConfig, tolerance: str = TOLERANCE) -> DataFrame:
    """Reports, late rows and regressed evaluations of a stream of messages, as `DECISION` rows. Rows whose column `counted` is
    false only move the watermark. Needs the RocksDB state store."""
    counted = F.coalesce(F.col("counted"), F.lit(False)) if "counted" in messages.columns else F.lit(True)
    # a number of its own, which is not filtered by the watermark as the event time would be
    second = F.floor(F.unix_millis(ts) / (cfg.bucket_seconds * 1000))
    rows = messages.withWatermark(ts, tolerance).select(F.col(key).cast("string").alias("key"), second.alias("second"), counted.alias("counted"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_LateWalker(cfg),
        outputStructType=DECISION,
        outputMode="Append",
        timeMode="EventTime",
    )
