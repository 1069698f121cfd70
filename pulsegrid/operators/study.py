"""Studies of recorded readings: what a setting of the detector would have done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import DetectorConfig
from pulsegrid.operators import scans
from pulsegrid.operators.episodes import isolated, sweep
from pulsegrid.operators.readings import islands, quantiles
from pulsegrid.sources.tables import written


def params(spark, cfg: DetectorConfig, **lists: list) -> DataFrame:
    """Settings that take the values of one or more lists (k, cap, cooldown, gate) and cfg's for the rest."""
    rows = [{"k": float(cfg.k), "cap": cfg.hold_cap, "cooldown": cfg.cooldown} | ({"gate": cfg.gate} if "gate" in lists else {})]
    for name, values in lists.items():
        rows = [r | {name: float(v) if name == "k" else v} for r in rows for v in values]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{n} {'double' if n == 'k' else 'long'}" for n in rows[0]))


def trigger_sweep(read: DataFrame, cfg: DetectorConfig, ks: list[float]) -> DataFrame:
    """For each k: the share of evaluated buckets at or above it, episodes (also by key-hour and by day), the median burst
    over the resting level, the share of keys that fire, and the busiest key's share of the episodes."""
    spark = read.sparkSession
    found = written(sweep(read, params(spark, cfg, k=ks)))
    hours = F.lit(cfg.bucket_seconds / 3600.0)
    whole = read.agg(
        F.count("*").alias("_rows"),
        (F.max("second") - F.min("second")).alias("_width"),
        F.count_distinct("key").alias("_keys"),
        *[F.count_if(F.col("intensity") >= k).alias(f"_at{i}") for i, k in enumerate(ks)],
    )
    by_k = whole.select("*", F.posexplode(F.array(*[F.lit(float(k)) for k in ks])).alias("_i", "k")).withColumn(
        "_high",
        F.element_at(F.array(*[f"_at{i}" for i in range(len(ks))]), F.col("_i") + 1),
    )
    busiest = found.groupBy("k", "key").agg(F.count("*").alias("_n")).groupBy("k").agg(F.max("_n").alias("_most"), F.count("*").alias("firing_keys"))
    ratio = F.when(F.col("start_mean") > 0, (F.col("peak_count") / cfg.window) / F.col("start_mean"))
    totals = quantiles(found, ratio, {"median_ratio": 0.5}, "k").withColumnRenamed("n", "episodes")
    out = by_k.join(totals, "k", "left").join(busiest, "k", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    span = F.col("_width") * hours
    return out.select(
        "k",
        F.try_divide("_high", "_rows").alias("share"),
        "episodes",
        F.try_divide("episodes", F.col("_rows") * hours).alias("per_key_hour"),
        (F.try_divide("episodes", span) * 24).alias("per_day"),
        "median_ratio",
        F.try_divide(F.coalesce("firing_keys", F.lit(0)), "_keys").alias("firing_share"),
        F.try_divide("_most", "episodes").alias("busiest_share"),
    )


def cap_sweep(read: DataFrame, cfg: DetectorConfig, caps: list[int]) -> DataFrame:
    """For each cap: episodes, those that it ended, their share, and what their report missed of the peak of the elevated
    run they lie in, as median and 95th percentile of (run's peak - reported peak) / run's peak."""
    found = sweep(read, params(read.sparkSession, cfg, cap=caps))
    runs = scans.islands(read.filter(F.col("intensity") >= cfg.k).select("key", "second", "intensity"), "key")
    later = Window.partitionBy("key", "_lane", "_run").orderBy(F.desc("second")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = runs.select("key", F.col("second").alias("started_at"), F.max("intensity").over(later).alias("full_peak"))
    joined = written(found.join(onward, ["key", "started_at"], "left"))
    loss = F.when(F.col("capped"), (F.col("full_peak") - F.col("peak_intensity")) / F.col("full_peak"))
    counted = joined.groupBy("cap").agg(F.count("*").alias("episodes"), F.count_if("capped").alias("capped"))
    return counted.join(quantiles(joined, loss, {"median_loss": 0.5, "p95_loss": 0.95}, "cap"), "cap").select(
        "cap",
        "episodes",
        "capped",
        (F.col("capped") / F.col("episodes")).alias("capped_share"),
        "median_loss",
        "p95_loss",
    )


def cooldown_sweep(read: DataFrame, cfg: DetectorConfig, cooldowns: list[int]) -> DataFrame:
    """For each cooldown: episodes, how many fewer than without one, and that as a share."""
    found = sweep(read, params(read.sparkSession, cfg, cooldown=sorted({0, *cooldowns}))).groupBy("cooldown").agg(F.count("*").alias("episodes"))
    none = F.max(F.when(F.col("cooldown") == 0, F.col("episodes"))).over(Window.partitionBy())
    return found.withColumn("suppressed", none - F.col("episodes")).withColumn("share", F.try_divide("suppressed", none))


def recovery_curve(read: DataFrame, found: DataFrame, cfg: DetectorConfig, offsets: list[int]) -> DataFrame:
    """For each offset after the report of an isolated episode, medians of baseline mean, deviation and relative spread
    against those at its start, and of sensitivity (start deviation / deviation now), with its 10th percentile."""
    alone = isolated(found, max(offsets))
    wanted = alone.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("second", F.col("fired_at") + F.col("offset")).select(
        "key",
        "second",
        "offset",
        "start_mean",
        "start_std",
    )
    rows = wanted.join(read.filter("intensity IS NOT NULL").select("key", "second", "mean", "std"), ["key", "second"])
    rows = rows.select(
        "offset",
        (F.col("mean") / F.nullif("start_mean", F.lit(0.0))).alias("m"),
        (F.col("std") / F.col("start_std")).alias("s"),
        ((F.col("std") / F.nullif("mean", F.lit(0.0))) / F.nullif(F.col("start_std") / F.nullif("start_mean", F.lit(0.0)), F.lit(0.0))).alias("r"),
        (F.col("start_std") / F.col("std")).alias("t"),
    )
    named = {"m": "mean_ratio", "s": "std_ratio", "r": "spread_ratio", "t": "sensitivity"}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for c, n in named.items()]))
    found_ = quantiles(rows.select("offset", each.alias("_e")).select("offset", "_e.*"), F.col("value"), {"p50": 0.5, "p10": 0.1}, "offset", "name")
    of = lambda name, point: F.max(F.when(F.col("name") == name, F.col(point)))
    return found_.groupBy("offset").agg(F.max("n").alias("n"), *[of(n, "p50").alias(n) for n in named.values()], of("sensitivity", "p10").alias("sensitivity_p10"))


def swallowed(read: DataFrame, found: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """For three ways to judge a bucket after an isolated episode's cooldown by what its baseline was at the start, the
    buckets and runs of buckets that would have been elevated but were not: variant, seconds, runs."""
    horizon = cfg.retained
    alone = isolated(found, horizon)
    near = alone.withColumn(
        "second",
        F.explode(F.sequence(F.col("fired_at") + cfg.cooldown + 1, F.col("fired_at") + horizon)),
    ).select("key", "fired_at", "start_mean", "start_std", "second")
    rows = near.join(read.filter("intensity IS NOT NULL"), ["key", "second"])
    level = F.col("window_count") / F.lit(float(cfg.window))
    variants = {
        "frozen": (level - F.col("start_mean")) / F.col("start_std"),
        "spread": (level - F.col("mean")) / F.col("start_std"),
        "excess": F.when(
            F.col("start_mean") > 0,
            (level - F.col("mean")) / F.nullif(F.col("start_std") * F.col("mean") / F.nullif("start_mean", F.lit(0.0)), F.lit(0.0)),
        ),
    }
    split = rows.select(
        "key",
        "fired_at",
        "second",
        "intensity",
        F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), e.alias("value")) for n, e in variants.items()])).alias("_v"),
    ).select("key", "fired_at", "second", "intensity", "_v.*")
    hits = islands(split.filter((F.col("intensity") < cfg.k) & (F.col("value") >= cfg.k)), "fired_at", "variant")
    return hits.groupBy("variant", "key", "fired_at", "_run").agg(F.count("*").alias("n")).groupBy("variant").agg(
        F.sum("n").alias("seconds"),
        F.count("*").alias("runs"),
    )


def gate_sweep(read: DataFrame, cfg: DetectorConfig, fractions: list[float]) -> DataFrame:
    """For each fraction: its gate, evaluated buckets that it blocks and their share, appearances that never pass it,
    episodes, and the largest peak."""
    gates = {f: int(cfg.baseline * f) for f in fractions}
    long = scans.runs(read.select("key", "second", "observed"), "key", largest={"most": "observed"})
    low = read.agg(F.count("*").alias("n"), *[F.count_if(F.col("observed") < g).alias(f"b{i}") for i, g in enumerate(gates.values())])
    never = long.agg(*[F.count_if(F.col("most") < g).alias(f"a{i}") for i, g in enumerate(gates.values())])
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("fraction"), F.lit(g).cast("long").alias("gate"), F.col(f"b{i}").alias("blocked"), F.lit(i).alias("i")) for i,
                (f, g) in enumerate(gates.items())
            ]
        )
    )
    blocked = low.select("n", rows.alias("_r")).select("n", "_r.*")
    missed = never.select(F.posexplode(F.array(*never.columns)).alias("i", "never"))
    found = sweep(read, params(read.sparkSession, cfg, gate=sorted({*gates.values()}))).groupBy("gate").agg(
        F.count("*").alias("episodes"),
        F.max("peak_intensity").alias("max_peak"),
    )
    return blocked.join(missed, "i").join(found, "gate", "left").select(
        "fraction",
        "gate",
        "blocked",
        F.try_divide("blocked", "n").alias("blocked_share"),
        F.col("never").alias("never_clear"),
        F.coalesce("episodes", F.lit(0)).alias("episodes"),
        "max_peak",
    )


def admitted_profile(read: DataFrame, gate: int, reference_gate: int) -> DataFrame:
    """Readings that a gate lets in and the reference gate does not: n, median, 99.9th percentile and largest intensity."""
    some = read.filter((F.col("status") == "ok") & (F.col("observed") >= gate) & (F.col("observed") < reference_gate))
    return quantiles(some, F.col("intensity"), {"p50": 0.5, "p999": 0.999, "max": 1.0})


def contained(
    peak_at: Column,
    fired_at: Column,
    delay: Column,
    watermark: float = 5.0,
    transport: float = 0.1,
    before: float = 25.0,
    after: float = 5.0,
) -> Column:
    """Whether a clip asked for `delay` seconds after a report shows the peak."""
    call = fired_at + F.lit(watermark + transport) + delay
    return (peak_at >= call - before) & (peak_at <= call + after)


def clip_coverage(found: DataFrame, delays: list[float], bucket_seconds: int = 1, **clip: float) -> DataFrame:
    """For each delay: episodes, the share whose peak the clip shows, and where in it (0 to 1) the median peak is."""
    before, after = clip.get("before", 25.0), clip.get("after", 5.0)
    call = F.col("fired_at") * bucket_seconds + clip.get("watermark", 5.0) + clip.get("transport", 0.1) + F.col("delay")
    rows = found.withColumn("delay", F.explode(F.array(*[F.lit(float(d)) for d in delays])))
    peak = F.col("peak_at") * bucket_seconds
    inside = contained(peak, F.col("fired_at") * bucket_seconds, F.col("delay"), **clip)
    rows = written(rows.select("delay", inside.alias("inside"), ((peak - (call - before)) / (before + after)).alias("position")))
    counted = rows.groupBy("delay").agg(F.count("*").alias("episodes"), (F.count_if("inside") / F.count("*")).alias("share"))
    return counted.join(quantiles(rows, F.col("position"), {"median_position": 0.5}, "delay").drop("n"), "delay")
