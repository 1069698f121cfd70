"""Scans along ordered lines of rows, such that no task holds a whole line.

A window over all rows of a key is one task, however long the key is. Here a line is cut into stretches of its order,
which are looked at in parallel, and then only what crosses from one stretch to the next meets along the whole line, in a
lane of its own: the first and last piece of each stretch. Everything is one pass over the rows.

Rows of a line have different places in the order, as the buckets of a key have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in the order that a stretch holds.
WIDTH = 1 << 14


def _stretch(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width)


def runs(rows: DataFrame, *by: str, order: str = "second", largest: dict[str, str] | None = None, width: int = WIDTH) -> DataFrame:
    """by, start and end of each run of neighbouring places, and the largest of some columns in it (name: column)."""
    largest = largest or {}
    inside = Window.partitionBy(*by, "_stretch").orderBy(order)
    local = rows.withColumn("_stretch", _stretch(order, width)).withColumn("_run", F.col(order) - F.row_number().over(inside))
    pieces = local.groupBy(*by, "_stretch", "_run").agg(
        F.min(order).alias("start"),
        F.max(order).alias("end"),
        *[F.max(column).alias(name) for name, column in largest.items()],
    )
    edge = (F.pmod("start", F.lit(width)) == 0) | (F.pmod(F.col("end") + 1, F.lit(width)) == 0)
    line = Window.partitionBy(*by, "_lane").orderBy("start")
    joined = pieces.withColumn("_lane", F.when(~edge, F.col("_stretch"))).withColumn("_new", F.coalesce(F.lag("end").over(line) != F.col("start") - 1, F.lit(True)))
    numbered = joined.withColumn("_n", F.sum(F.col("_new").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = numbered.groupBy(*by, "_lane", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.max(n).alias(n) for n in largest])
    return whole.drop("_lane", "_n")


def islands(rows: DataFrame, *by: str, order: str = "second", width: int = WIDTH) -> DataFrame:
    """Adds _lane and _run, which together with by are the same for the rows of a run of neighbouring places only.

    A run that reaches an edge of a stretch is told by the rows of all such runs; the others stay within their stretch.
    """
    inside = Window.partitionBy(*by, "_stretch").orderBy(order)
    local = rows.withColumn("_stretch", _stretch(order, width)).withColumn("_run", F.col(order) - F.row_number().over(inside))
    run = Window.partitionBy(*by, "_stretch", "_run")
    edge = (F.pmod(F.min(order).over(run), F.lit(width)) == 0) | (F.pmod(F.max(order).over(run) + 1, F.lit(width)) == 0)
    laned = local.withColumn("_lane", F.when(~edge, F.col("_stretch")))
    return laned.withColumn("_run", F.col(order) - F.row_number().over(Window.partitionBy(*by, "_lane").orderBy(order))).drop("_stretch")


def lasting(rows: DataFrame, holds: Column, *by: str, order: str = "tick", width: int = WIDTH) -> DataFrame:
    """by, start and end of each run of rows for which `holds`; rows for which it does not hold, or is null, end runs.

    Places without a row do not end one.
    """
    inside = Window.partitionBy(*by, "_stretch")
    marked = rows.withColumn("_stretch", _stretch(order, width)).withColumn("_break", F.when(~F.coalesce(holds, F.lit(False)), F.col(order)))
    # the last break in the stretch up to each row: none for the rows that go on from the stretches before
    broken = marked.withColumn("_from", F.max("_break").over(inside.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = F.when(F.col("_break").isNull(), F.col(order))
    last = F.max("_break").over(inside)
    pieces = broken.withColumn("_last", last).groupBy(*by, "_stretch", "_from", "_last").agg(F.min(kept).alias("start"), F.max(kept).alias("end"))
    crossing = F.col("_from").isNull() | (F.col("_from") == F.col("_last"))
    line = Window.partitionBy(*by, "_lane").orderBy("_stretch", F.asc_nulls_first("_from")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laned = pieces.withColumn("_lane", F.when(~crossing, F.col("_stretch")))
    numbered = laned.withColumn("_n", F.count("_from").over(line))
    return numbered.groupBy(*by, "_lane", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end")).filter("start IS NOT NULL").drop("_lane", "_n")


def led_in(rows: DataFrame, order: str, lead: int, width: int | None = None) -> DataFrame:
    """Adds _part and _own: each row in its stretch, and those within `lead` of the next stretch there as well, so that windows
    by _part see that far back. Results are the rows with _part = _own."""
    width = width or max(WIDTH, 16 * lead)
    own, next_ = _stretch(order, width), F.floor((F.col(order) + lead) / width)
    parts = F.when(own == next_, F.array(own)).otherwise(F.array(own, next_))
    return rows.withColumn("_part", F.explode(parts)).withColumn("_own", own)


def rolling(rows: DataFrame, window: int, *by: str, order: str = "tick", width: int | None = None, **sums: str) -> DataFrame:
    """rows with the sum of columns (name=column) over the last `window` places up to each row."""
    line = Window.partitionBy(*by, "_part").orderBy(order).rangeBetween(-(window - 1), 0)
    spread = led_in(rows, order, window - 1, width)
    summed = spread.withColumns({name: F.sum(column).over(line) for name, column in sums.items()})
    return summed.filter(F.col("_part") == F.col("_own")).drop("_part", "_own")
