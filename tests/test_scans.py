"""Scans by stretches against plain loops, with stretches so short that runs cross them."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.config import DetectorConfig
from pulsegrid.operators import episodes, monitors, readings, scans


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def line(seed, keys=3, n=150):
    draw = random.Random(seed)
    return [(k, s - 40, draw.randint(0, 3)) for k in range(keys) for s in range(n) if draw.random() < 0.8]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, second long, v long")


def brute_runs(rows, of=lambda r: True):
    out, last = [], None
    for k, s, v in sorted(r for r in rows if of(r)):
        if last and last == (k, s - 1):
            out[-1][2], out[-1][3] = s, max(out[-1][3], v)
        else:
            out.append([k, s, s, v])
        last = k, s
    return sorted(map(tuple, out))


@pytest.mark.parametrize("width", [1, 2, 7, 1000])
def test_runs_and_islands(spark, width):
    rows = line(1)
    found = scans.runs(frame(spark, rows), "key", largest={"peak": "v"}, width=width)
    assert sorted(map(tuple, found.collect())) == brute_runs(rows)
    by_run = scans.islands(frame(spark, rows), "key", width=width).groupBy("key", "_lane", "_run").agg(F.min("second"), F.max("second"), F.max("v"))
    assert sorted((r[0], *r[3:]) for r in by_run.collect()) == brute_runs(rows)


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_lasting(spark, width):
    rows = line(2)
    want = []
    for k in range(3):
        run = None
        for _, s, v in sorted(r for r in rows if r[0] == k):
            if v > 0:
                run = [k, s, s] if run is None else [k, run[1], s]
            if v == 0 and run:
                want.append(tuple(run))
                run = None
        want += [tuple(run)] if run else []
    found = scans.lasting(frame(spark, rows), F.col("v") > 0, "key", order="second", width=width)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    one = scans.lasting(frame(spark, rows).filter("key = 1"), F.when(F.col("v") > 0, True), order="second", width=width)
    assert sorted(map(tuple, one.collect())) == sorted(w[1:] for w in want if w[0] == 1)


@pytest.mark.parametrize(("window", "width"), [(1, 5), (4, 5), (9, 9), (30, 40)])
def test_rolling(spark, window, width):
    rows = line(3)
    got = scans.rolling(frame(spark, rows), window, "key", order="second", width=width, total="v").collect()
    assert sorted(map(tuple, got)) == sorted((k, s, v, sum(w for j, t, w in rows if j == k and s - window < t <= s)) for k, s, v in rows)


def test_steps_fill_what_is_missing(spark, monkeypatch):
    monkeypatch.setattr(scans, "WIDTH", 4)
    counted = spark.createDataFrame([(10, 1), (70, 2), (75, 3)], "tick long, a long")
    assert sorted(map(tuple, monitors.steps(counted, 5, "a").collect())) == [(t, {10: 1, 70: 2, 75: 3}.get(t, 0)) for t in range(10, 76, 5)]
    assert monitors.steps(counted.limit(0), 5, "a").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_sweep_equals_a_fold_over_whole_keys(spark, monkeypatch, seed):
    """Segments that lie in several stretches, long gaps, and unmeasured buckets between."""
    monkeypatch.setattr(scans, "WIDTH", 16)
    cfg, draw = DetectorConfig(window=1, baseline=30, k=2.0, hold_cap=3, cooldown=4), random.Random(seed)
    rows, second = [], 0
    for k in ("a", "b"):
        for _ in range(400):
            second += draw.choice([1, 1, 1, 1, 2, 3, 6, 40])
            level = draw.choice([None, 0.0, 1.0, 2.0, 3.0, 4.0]) if draw.random() < 0.9 else 5.0
            rows.append((k, second, 30, 5, 1.0, 1.0, level))
    read = spark.createDataFrame(rows, "key string, second long, observed long, window_count long, mean double, std double, intensity double")
    params = [(2.0, 3, 4), (1.0, 0, 0), (4.0, 9, 1), (1.0, 2, 20)]
    want = []
    for p in params:
        for key in ("a", "b"):
            state = episodes.State()
            for k, s, _, n, m, d, x in rows:
                if k == key and x is not None:
                    state, report = episodes.advance(state, s, n, m, d, x, *p)
                    want += [(key, *p, *report[:4])] if report else []
    found = episodes.sweep(read, spark.createDataFrame(params, "k double, cap long, cooldown long"))
    assert sorted(tuple(r)[:8] for r in found.collect()) == sorted(want) and len(want) > 100


def test_no_window_over_a_whole_key(spark):
    """Every window of these plans is over a stretch, a lane or a run, not over a key alone."""
    import re

    counts = spark.createDataFrame([("a", 1, 1)], "key string, second long, n long")
    cfg = DetectorConfig(window=3, baseline=48, k=1.5, hold_cap=4, cooldown=6)
    read = readings.readings(counts, cfg)
    counted = spark.createDataFrame([(1, 1, 1)], "tick long, a long, b long")
    plans = [readings.appearances(read), readings.elevated_runs(read, 1.5), episodes.episodes(read, cfg)]
    plans += [monitors.no_messages(counted, 1, 3, 0, "a", F.col("b") > 0), monitors.failure_ratio(counted, 1, 3, "a", "b"), monitors.stalled(counted, 1, 3, 0, "a", "b")]
    for df in plans:
        windows = [x for x in plan(df).splitlines() if re.search(r"\+- Window |^Window ", x)]
        assert windows
        for w in windows:
            groups = re.findall(r"\[([^\[\]]*)\]", w)
            keys = groups[-2] if re.search("ASC|DESC", groups[-1]) else groups[-1]
            # a bucket's next one in the grid is looked up among one row a stretch
            assert re.search("_stretch|_lane|_part|_run", keys) or "_first" in w, w


def test_readings_grow_in_proportion(spark):
    """Twice the seconds of one key take about twice the time, not four times."""
    import time

    cfg = DetectorConfig()

    def took(n):
        counts = spark.range(n).select(F.lit("a").alias("key"), F.col("id").alias("second"), (1 + F.col("id") % 7).alias("n"))
        began = time.time()
        assert readings.readings(counts, cfg).agg(F.count("*"), F.sum("intensity")).first()[0] == n + cfg.retained
        return time.time() - began

    took(1000)
    short, long = took(50_000), took(200_000)
    assert long < 8 * short + 2


@pytest.mark.parametrize("by", [(), ("key",)])
def test_quantiles_equal_the_exact_function(spark, by):
    draw = random.Random(5)
    rows = [(draw.choice(["a", None, "b"]), draw.choice([None, 1.0, 2.5, draw.random()]), 0) for _ in range(500)] + [("none", None, 1), ("one", 7.0, 2)]
    rows += [("ties", 3.0, 3)] * 400 + [("ties", float(i), 3) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, v double, i long").repartition(5)
    points = {"low": 0.0, "q": 0.123, "half": 0.5, "p99": 0.99, "high": 1.0}
    got = readings.quantiles(df, F.col("v"), points, *by)
    want = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile("v", F.lit(p)).alias(n) for n, p in points.items()]).select(*by, "n", *points)
    near = lambda r: tuple(round(x, 12) if isinstance(x, float) else x for x in r)
    assert got.columns == want.columns and sorted(map(repr, map(near, got.collect()))) == sorted(map(repr, map(near, want.collect())))
    none = readings.quantiles(df.limit(0), F.col("v"), points, *by).collect()
    assert none == [] if by else tuple(none[0]) == (0, None, None, None, None, None)
