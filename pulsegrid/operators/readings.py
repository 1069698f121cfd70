"""Per-bucket readings: how far a short window stands above a trailing baseline that it never overlaps.

Counts are integers, and so are the sums of counts and of their squares over a baseline; mean, spread and the test for no
spread at all follow from them exactly. Sums come from running totals along the dense grid, so their cost depends neither
on the width of the baseline nor on the length of a stretch. The grid is cut into stretches that carry a lead-in of one
retained span, so that a key that is never silent is spread over tasks as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import DetectorConfig
from pulsegrid.operators import scans
from pulsegrid.operators.messages import bucket
from pulsegrid.sources.tables import written

#: Length of a stretch in retained spans; the lead-in adds one.
STRETCH = 64


def bucket_counts(messages: DataFrame, key: str, event_ms: str, cfg: DetectorConfig) -> DataFrame:
    """key, second (the bucket's number) and n. Rows without key or time are left out."""
    return messages.filter(F.col(key).isNotNull() & F.col(event_ms).isNotNull()).groupBy(
        F.col(key).alias("key"),
        bucket(F.col(event_ms), cfg.bucket_seconds).alias("second"),
    ).agg(F.count("*").alias("n"))


def dense_grid(counts: DataFrame, cfg: DetectorConfig, last: int | Column | None = None) -> DataFrame:
    """Every bucket from a populated one until the retained span after it has passed, with n = 0 where there are none.

    last: no bucket after it is evaluated.
    """
    # within a stretch the next bucket follows by a window; after its last one comes the first of the next stretch
    rows = counts.withColumn("_stretch", F.floor(F.col("second") / (STRETCH * cfg.retained)))
    firsts = rows.groupBy("key", "_stretch").agg(F.min("second").alias("_first"))
    onward = F.lead("_first").over(Window.partitionBy("key").orderBy("_stretch"))
    inside = F.lead("second").over(Window.partitionBy("key", "_stretch").orderBy("second"))
    rows = rows.withColumn("_inside", inside).join(firsts.select("key", "_stretch", onward.alias("_onward")), ["key", "_stretch"])
    latest = F.col("second") + cfg.retained
    until = F.least(F.coalesce(F.coalesce("_inside", "_onward") - 1, latest), latest)
    filled = rows.withColumn("_until", until).select("key", F.explode(F.sequence("second", "_until")).alias("_at"), "second", "n")
    grid = filled.select("key", F.col("_at").alias("second"), F.when(F.col("_at") == F.col("second"), F.col("n")).otherwise(F.lit(0)).alias("n"))
    return grid if last is None else grid.filter(F.col("second") <= last)


def readings(counts: DataFrame, cfg: DetectorConfig, last: int | Column | None = None) -> DataFrame:
    """key, second, observed, status (warmup, flat or ok), window_count, mean, std, intensity (null unless ok)."""
    return scored(moments(counts, cfg, last), cfg)


def moments(counts: DataFrame, cfg: DetectorConfig, last: int | Column | None = None) -> DataFrame:
    """key, second, window_count, observed, and the integer moments s1, s2 of the baseline, by running totals."""
    w, b, retained = cfg.window, cfg.baseline, cfg.retained
    length = STRETCH * retained
    grid = dense_grid(counts, cfg, last)
    # a bucket also belongs to the lead-in of the next stretch if that begins within the retained span
    own = F.floor(F.col("second") / length)
    next_ = F.floor((F.col("second") + retained) / length)
    spread = grid.withColumn("_part", F.explode(F.when(own == next_, F.array(own)).otherwise(F.array(own, next_)))).withColumn("_own", own)
    line = Window.partitionBy("key", "_part").orderBy("second")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # from the last bucket back: a frame that ends at the partition's end would be gone through anew for each row
    to_come = Window.partitionBy("key", "_part").orderBy(F.desc("second")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = spread.withColumn("_c", F.sum("n").over(so_far)).withColumn("_q", F.sum(F.col("n") * F.col("n")).over(so_far))
    base = base.withColumn("_filled", F.min(F.when(F.col("n") > 0, F.col("second"))).over(to_come))

    def total(column: str, back: int) -> Column:
        """The running total `back` buckets ago. Buckets are rows within an appearance; between appearances nothing that is
        still retained lies further back, so a row that is not that bucket stands before a silent span."""
        at = F.lag("second", back).over(line)
        value = F.lag(column, back).over(line)
        return F.struct(at.alias("at"), value.alias("value"))

    base = base.withColumns(
        {"_w": total("_c", w), "_b": total("_c", w + b), "_bq": total("_q", w + b), "_wq": total("_q", w), "_f": total("_filled", w + b - 1)}
    )
    appearance_start = F.max(F.when(F.coalesce(F.col("second") - F.lag("second").over(line) > 1, F.lit(True)), F.col("second"))).over(so_far)
    base = base.withColumn("_start", appearance_start)
    before = F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1))
    base = base.withColumn("_c0", F.max(F.when(F.col("second") == F.col("_start"), F.coalesce(before, F.lit(0)))).over(so_far))
    squares = F.sum(F.col("n") * F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    base = base.withColumn("_q0", F.max(F.when(F.col("second") == F.col("_start"), F.coalesce(squares, F.lit(0)))).over(so_far))

    def then(pair: str, back: int, start: str) -> Column:
        return F.when(F.col(f"{pair}.at") == F.col("second") - back, F.col(f"{pair}.value")).otherwise(F.col(start))

    window_count = F.col("_c") - then("_w", w, "_c0")
    s1 = then("_w", w, "_c0") - then("_b", w + b, "_c0")
    s2 = then("_wq", w, "_q0") - then("_bq", w + b, "_q0")
    first_of_baseline = F.col("second") - (w + b - 1)
    oldest = F.when(F.col("_f.at") == first_of_baseline, F.col("_f.value")).otherwise(F.col("_start"))
    observed = F.when(oldest <= F.col("second") - w, F.col("second") - w + 1 - oldest).otherwise(F.lit(0))
    out = base.filter(F.col("_part") == F.col("_own"))
    return out.select("key", "second", window_count.alias("window_count"), s1.alias("s1"), s2.alias("s2"), observed.alias("observed"))


def scored(sums: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Status and scores from window_count, observed and the integer moments s1, s2 of the baseline."""
    b = cfg.baseline
    spread = F.lit(b) * F.col("s2") - F.col("s1") * F.col("s1")
    status = F.when(F.col("observed") < cfg.gate, "warmup").when(spread <= 0, "flat").otherwise("ok")
    ok = status == "ok"
    mean, std = F.col("s1") / F.lit(float(b)), F.sqrt(spread / F.lit(float(b * (b - 1))))
    return sums.select(
        "key",
        "second",
        "observed",
        status.alias("status"),
        F.when(ok, F.col("window_count")).alias("window_count"),
        F.when(ok, mean).alias("mean"),
        F.when(ok, std).alias("std"),
        F.when(ok, (F.col("window_count") / F.lit(float(cfg.window)) - mean) / std).alias("intensity"),
    )


def window_sums(counts: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """The same sums by range frames: simple, and slower the wider the baseline is. s1, s2, oldest, window_count."""
    w, b = cfg.window, cfg.baseline
    line = Window.partitionBy("key").orderBy("second")
    near, far = line.rangeBetween(-(w - 1), 0), line.rangeBetween(-(w + b - 1), -w)
    filled = F.when(F.col("n") > 0, F.col("second"))
    grid = dense_grid(counts, cfg)
    found = grid.select(
        "key",
        "second",
        F.sum("n").over(near).alias("window_count"),
        F.coalesce(F.sum("n").over(far), F.lit(0)).alias("s1"),
        F.coalesce(F.sum(F.col("n") * F.col("n")).over(far), F.lit(0)).alias("s2"),
        F.min(filled).over(far).alias("oldest"),
    )
    return found.withColumn("observed", F.coalesce(F.col("second") - w + 1 - F.col("oldest"), F.lit(0)))


def status_totals(read: DataFrame) -> DataFrame:
    """status, n and share of all."""
    return read.groupBy("status").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def gate_again(read: DataFrame, cfg: DetectorConfig, gate: int) -> DataFrame:
    """Readings under a stricter gate; a looser one than theirs is refused, as what it would admit was not measured."""
    if gate < cfg.gate:
        raise ValueError("the gate is below the one the readings were taken with")
    return read.filter(F.col("observed") >= gate)


def span(read: DataFrame, bucket_seconds: int = 1) -> DataFrame:
    """hours from first to last bucket, hours of all keys together, and the number of keys."""
    return read.agg(
        ((F.max("second") - F.min("second")) * bucket_seconds / 3600.0).alias("hours"),
        (F.count("*") * bucket_seconds / 3600.0).alias("key_hours"),
        F.count_distinct("key").alias("keys"),
    )


def islands(rows: DataFrame, *extra: str) -> DataFrame:
    """Adds _run, the same for the rows of an unbroken run of seconds (of key and extra columns), where such a group of rows
    is short; `scans` has forms for long ones."""
    place = F.row_number().over(Window.partitionBy("key", *extra).orderBy("second"))
    return rows.withColumn("_run", F.col("second") - place)


def appearances(read: DataFrame) -> DataFrame:
    """key, start, end of each run of evaluated buckets."""
    return scans.runs(read.select("key", "second"), "key")


def elevated_runs(read: DataFrame, k: float) -> DataFrame:
    """key, start, end, peak of each run of measured buckets of intensity k or more; an unmeasured bucket ends a run."""
    high = read.filter(F.col("intensity") >= k).select("key", "second", "intensity")
    return scans.runs(high, "key", largest={"peak": "intensity"})


def quantiles(rows: DataFrame, value: Column, points: dict[str, float], *by: str) -> DataFrame:
    """by, n (rows) and exact quantiles of the values that are not null, with linear interpolation, a column each.

    Distinct values are counted, dealt out by ranges and written; ranks follow from the counts of the ranges, and the two
    neighbours of each quantile are looked up. So no task holds the values of a group, however few groups there are.
    """
    keys = by or ("_one",)
    rows = rows if by else rows.withColumn("_one", F.lit(0))
    counted = rows.groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_n"))
    dealt = written(counted.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()))
    some = dealt.filter("_v IS NOT NULL")
    so_far = lambda *c: Window.partitionBy(*keys, *c[:-1]).orderBy(c[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = some.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m")).select(
        *keys,
        "_range",
        "_m",
        (F.sum("_m").over(so_far("_range")) - F.col("_m")).alias("_before"),
        F.sum("_m").over(Window.partitionBy(*keys)).alias("_all"),
    )
    at = F.col("_all") - 1
    rank = lambda p, side: (F.floor if side == "low" else F.ceil)(F.lit(float(p)) * at)
    wanted = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(s).alias("_side"), rank(p, s).alias("rank")) for n, p in points.items() for s in ("low", "high")])
    asked = ranges.withColumn("_w", F.explode(wanted)).select(*keys, "_range", "_m", "_all", "_w._name", "_w._side", (F.col("_w.rank") - F.col("_before")).alias("_place"))
    asked = asked.filter((F.col("_place") >= 0) & (F.col("_place") < F.col("_m")))
    renamed = [F.col(c).alias(f"_b{i}") for i, c in enumerate(keys)]
    ends = some.select(*renamed, F.col("_range").alias("_r"), "_v", "_n", F.sum("_n").over(so_far("_range", "_v")).alias("_end"))
    hit = (F.col("_place") >= F.col("_end") - F.col("_n")) & (F.col("_place") < F.col("_end"))
    picked = asked.join(ends, _same(keys) & (F.col("_range") == F.col("_r")) & hit)
    pick = lambda name, side: F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col("_v")))
    sides = picked.groupBy(*keys).agg(F.max("_all").alias("_all"), *[pick(n, s).alias(f"{n}_{s}") for n in points for s in ("low", "high")])

    def between(name: str, p: float) -> Column:
        low, high, exact = rank(p, "low"), rank(p, "high"), F.lit(float(p)) * at
        return F.when(low == high, F.col(f"{name}_low")).otherwise((high - exact) * F.col(f"{name}_low") + (exact - low) * F.col(f"{name}_high"))

    found = sides.select(*renamed, *[between(n, p).alias(n) for n, p in points.items()])
    # without groups there is one row, whatever there is
    totals = (dealt.groupBy(*by) if by else dealt).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    return (totals if by else totals.withColumn("_one", F.lit(0))).join(found, _same(keys), "left").select(*by, "n", *points)


def _same(by: tuple[str, ...]) -> Column:
    """That columns are equal to those of the same place called _b0, _b1 and so on; nulls are equal."""
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return same


RUN_POINTS = {"min": 0.0, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}


def run_quantiles(runs: DataFrame) -> DataFrame:
    """Quantiles of the length of runs in buckets."""
    return quantiles(runs, (F.col("end") - F.col("start") + 1).cast("double"), RUN_POINTS)
