"""Health monitors: conditions over windows of event rows, and conditions that last.

events: tick (integer time), kind, and key where it is needed. Counts are exact counts of rows, with zero where none is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.operators import scans
from pulsegrid.sources.tables import written


def tumbling(events: DataFrame, width: int, *kinds: str) -> DataFrame:
    """tick (a multiple of width, the end of a step) and the count of each kind in the step, for every step with rows."""
    step = (F.floor(F.col("tick") / width) + 1) * width
    return events.groupBy(step.alias("tick")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def steps(counted: DataFrame, width: int, *kinds: str) -> DataFrame:
    """counted with rows of zeros for the steps between first and last that have none.

    Steps are made a block at a time, by many tasks; counted is read once more for its ends.
    """
    many = width * scans.WIDTH
    ends = counted.agg(F.min("tick").alias("first"), F.max("tick").alias("last")).filter("first IS NOT NULL")
    blocks = ends.select("first", "last", F.explode(F.sequence("first", "last", F.lit(many))).alias("begin")).repartition("begin")
    every = blocks.select(F.explode(F.sequence("begin", F.least(F.col("begin") + many - width, F.col("last")), F.lit(width))).alias("tick"))
    return every.join(counted, "tick", "left").select("tick", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def sustained(series: DataFrame, condition: Column, lasts: int, *by: str, width: int = 60) -> DataFrame:
    """Runs of steps in which the condition holds, of a duration of `lasts` or more: by, start, end. A step where it does
    not hold ends a run; by: the columns that tell series apart; width: about how long a step is."""
    found = scans.lasting(series, condition, *by, width=width * scans.WIDTH)
    return found.filter(F.col("end") - F.col("start") >= lasts)


def _block(width: int, window: int) -> int:
    """Time that is summed in one task."""
    return max(width * scans.WIDTH, 16 * window)


def no_messages(counted: DataFrame, width: int, window: int, lasts: int, message: str, active: Column) -> DataFrame:
    """No message in the window while something is active."""
    rows = scans.rolling(steps(counted, width, *[c for c in counted.columns if c != "tick"]), window, width=_block(width, window), _n=message)
    return sustained(rows, (F.col("_n") == 0) & active, lasts, width=width)


def failure_ratio(counted: DataFrame, width: int, window: int, failed: str, ok: str) -> DataFrame:
    """tick and ratio: failures of all outcomes in the window."""
    rows = scans.rolling(steps(counted, width, failed, ok), window, width=_block(width, window), _f=failed, _o=ok)
    return rows.select("tick", (F.col("_f") / (F.col("_o") + F.col("_f") + 0.001)).alias("ratio"))


def stalled(counted: DataFrame, width: int, window: int, lasts: int, anomaly: str, message: str) -> DataFrame:
    """No anomaly in the window while messages come."""
    rows = scans.rolling(steps(counted, width, anomaly, message), window, width=_block(width, window), _a=anomaly, _m=message)
    return sustained(rows, (F.col("_a") == 0) & (F.col("_m") > 0), lasts, width=width)


def success_share(events: DataFrame, width: int, anomaly: str, ok: str) -> DataFrame:
    """For each window: keys with an anomaly, and the share of them without a success."""
    step = (F.floor(F.col("tick") / width) + 1) * width
    by_key = events.groupBy(step.alias("tick"), "key").agg(
        F.count_if(F.col("kind") == anomaly).alias("_a"),
        F.count_if(F.col("kind") == ok).alias("_o"),
    ).filter("_a > 0")
    return by_key.groupBy("tick").agg(F.count("*").alias("firing"), (F.count_if(F.col("_o") == 0) / F.count("*")).alias("without_success"))


def rate(counted: DataFrame, width: int, column: str) -> DataFrame:
    """tick and rows per unit of time."""
    return counted.select("tick", (F.col(column) / width).alias("rate"))


def threshold(metrics: DataFrame, above: Column, lasts: int) -> DataFrame:
    """Runs of a metric table (tick, series, value) for which `above` holds for `lasts`: series, start, end."""
    return sustained(metrics, above, lasts, "series")


#: Repeat intervals in a block of a group's alerts.
BLOCK = 64


def roll_up(alerts: DataFrame, repeat: dict[str, int], default: int) -> DataFrame:
    """alerts: name, severity, tick. The notices that are sent: a group's (name, severity) first alert, and then the first one
    that comes its repeat interval or more after the last notice; n: alerts at that time. A warning is left out where a
    critical alert of its name fires at that time.

    Which alerts are sent depends on all before, so a group is cut into blocks: for each alert that can be the first to be
    sent in a block, the block tells the last one that is sent then; these few rows are followed along the group, which gives
    each block its first notice; and the blocks send theirs.
    """
    critical = alerts.filter("severity = 'critical'").select("name", "tick").distinct().withColumn("_critical", F.lit(True))
    left = alerts.join(critical, ["name", "tick"], "left").filter("severity = 'critical' OR _critical IS NULL").select("name", "severity", "tick")
    wait = F.lit(default)
    for severity, seconds in repeat.items():
        wait = F.when(F.col("severity") == severity, seconds).otherwise(wait)
    each = left.groupBy("name", "severity", "tick").agg(F.count("*").alias("n")).withColumn("_wait", wait.cast("long"))
    each = written(each.withColumn("_block", F.floor(F.col("tick") / (F.col("_wait") * BLOCK))))

    key = ["name", "severity", "_block"]
    kinds = {f.name: f.dataType.simpleString() for f in each.schema}
    group = f"name {kinds['name']}, severity {kinds['severity']}, _block long"
    in_order = lambda df, by, *then: df.repartition(*by).sortWithinPartitions(*by, *then)

    def exits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block, alerts that can be its first notice, and the last one that is sent then."""
        out: list[tuple] = []
        for block, rows in _groups(batches, 3):
            wait, ticks = rows[0][0], [t for _, t in rows]
            last = list(ticks)
            for i in range(len(ticks) - 1, -1, -1):
                after = bisect_left(ticks, ticks[i] + wait, i)
                if after < len(ticks):
                    last[i] = last[after]
            # a notice before the block bars no more than the first interval of it
            many = bisect_left(ticks, (block[2] * BLOCK + 1) * wait) + 1
            out += [(*block, wait, t, x) for t, x in zip(ticks[:many], last, strict=False)]
            if len(out) > 10_000:
                yield _batch(out, exits_schema)
                out = []
        yield _batch(out, exits_schema)

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first notice of each block, along each group."""
        of, block, free = None, None, None
        for batch in batches:
            out = []
            for name, severity, at, wait, tick, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != (name, severity):
                    of, block, free = (name, severity), None, None
                if at != block and (free is None or tick >= free):
                    out.append((name, severity, at, tick))
                    block, free = at, last + wait
            yield _batch(out, entries_schema)

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Alerts of each block from its first notice on; n is null in the row that tells of that."""
        of, free = None, None
        for batch in batches:
            out = []
            for name, severity, block, n, wait, tick in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n is None:
                    of, free = (name, severity, block), tick
                elif of == (name, severity, block) and tick >= free:
                    out.append((name, severity, tick, n))
                    free = tick + wait
            yield _batch(out, sent_schema)

    arrow = {f.name: f.type for f in to_arrow_schema(each.schema)}
    fixed = [arrow["name"], arrow["severity"]]
    exits_schema = pa.schema(list(zip(["name", "severity", "_block", "_wait", "tick", "last"], [*fixed, *[pa.int64()] * 4], strict=True)))
    entries_schema = pa.schema(list(zip(["name", "severity", "_block", "tick"], [*fixed, *[pa.int64()] * 2], strict=True)))
    sent_schema = pa.schema(list(zip(["name", "severity", "tick", "n"], [*fixed, *[pa.int64()] * 2], strict=True)))
    candidates = in_order(each.select(*key, "_wait", "tick"), key, "tick").mapInArrow(exits, f"{group}, _wait long, tick long, last long")
    firsts = in_order(candidates, ["name", "severity"], "_block", "tick").mapInArrow(entries, f"{group}, tick long")
    told = firsts.select(*key, F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("_wait"), "tick")
    rows = each.select(*key, "n", "_wait", F.col("tick").cast("long").alias("tick")).unionByName(told)
    marked = in_order(rows.withColumn("_first", F.col("n").isNotNull()), key, "_first", "tick").drop("_first")
    return marked.mapInArrow(sent, f"name {kinds['name']}, severity {kinds['severity']}, tick long, n long")


def _groups(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows in a row that agree in their first `width` columns, and what else they hold; over batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
