"""Pinned vectors of the detector, and the parallel fold against a plain one."""

import math
import random

import pytest

from pulsegrid.config import DetectorConfig
from pulsegrid.operators import episodes, readings

SMALL = DetectorConfig(window=5, baseline=20, k=3.0, hold_cap=10, cooldown=30, fraction=0.8)
STEADY = {s: 10 + (1 if s % 2 else -1) for s in range(976, 996)}


def at(spark, counts, second, cfg=SMALL):
    df = spark.createDataFrame([(1, s, n) for s, n in counts.items() if n], "key long, second long, n long")
    return readings.readings(df, cfg).filter(f"second = {second}").first()


def window(n):
    return {s: n for s in range(996, 1001)}


def test_steady_levels(spark):
    std = math.sqrt(20 / 19)
    for n in (10, 25, 500):
        r = at(spark, STEADY | window(n), 1000)
        assert r["mean"] == 10 and r["std"] == pytest.approx(std) and r["intensity"] == pytest.approx((n - 10) / std)
    assert at(spark, STEADY, 1000)["intensity"] == pytest.approx(-10 / std)


def test_window_count_and_old_buckets(spark):
    assert at(spark, STEADY | window(10) | {996: 60}, 1000)["window_count"] == 100
    assert at(spark, {970: 9, 975: 9} | STEADY | window(10), 1000)["mean"] == 10


def test_gate_and_spread(spark):
    late = {s: n for s, n in STEADY.items() if s >= 981}
    assert (at(spark, late | window(40), 1000)["observed"], at(spark, late | window(40), 1000)["status"]) == (15, "warmup")
    assert at(spark, {980: 9} | late | window(40), 1000)["status"] == "ok"
    assert at(spark, {s: 5 for s in range(976, 996)} | window(40), 1000)["status"] == "flat"


def fold(levels, cap=10, cooldown=30, k=3.0, last=None, start=1000):
    state, out = episodes.State(None, last), []
    for i, x in enumerate(levels):
        state, report = episodes.advance(state, start + i, int(x or 0), 0.0, 1.0, x, k, cap, cooldown)
        if report:
            out.append(report)
    return out, state


def test_peak_hold():
    (r,), _ = fold([0, 4, 8, 4, 0])
    assert r[:4] == (1001, 1004, 1002, 8)
    (r,), _ = fold([0, 8, 8, 8, 0])
    assert r[2] == 1001  # a tie keeps the earlier
    (r,), _ = fold([0] + [8] * 11)
    assert r[1] == r[0] + 10 and r[-1]
    (r,), _ = fold([5], cap=0)
    assert r[:2] == (1000, 1000)


def test_cooldown_and_stale_holds():
    for before, opens in ((5, False), (30, False), (31, True), (35, True)):
        assert (fold([8], last=1000 - before)[1].hold is not None) == opens
    assert fold([8] + [None] * 11 + [0])[0] == []  # dropped without a report
    assert len(fold([8, None, None, 0])[0]) == 1


@pytest.mark.parametrize("wrong", [{"window": 0}, {"baseline": 1}, {"hold_cap": -1}, {"cooldown": -1}, {"fraction": 0}, {"fraction": 1}, {"hold_cap": 305}])
def test_settings_that_cannot_work(wrong):
    with pytest.raises(ValueError):
        DetectorConfig(**wrong)


def test_settings_from_environment():
    assert DetectorConfig.from_environment({"DETECTION_K": "5", "DETECTION_COOLDOWN_SECONDS": ""}) == DetectorConfig(k=5.0)


def test_prefix_sums_equal_range_frames(spark):
    draw = random.Random(3)
    rows = [(k, s, draw.randint(1, 9)) for k in range(6) for s in sorted(draw.sample(range(6000), 400 if k else 3000))]
    counts = spark.createDataFrame(rows, "key long, second long, n long")
    cfg = DetectorConfig(window=3, baseline=12, hold_cap=4, cooldown=6)
    direct = readings.scored(readings.window_sums(counts, cfg), cfg)
    assert readings.readings(counts, cfg).exceptAll(direct).count() == 0 and direct.exceptAll(readings.readings(counts, cfg)).count() == 0


def test_segments_equal_one_fold(spark):
    draw = random.Random(4)
    rows, want = [], []
    for key in range(30):
        state, second = episodes.State(), 0
        for _ in range(200):
            second += draw.choice([1, 1, 1, 2, 9])
            x = draw.choice([None, 0.0, 1.0, 3.5, 4.0, 5.0])
            rows.append((key, second, 50, 1 if x is not None else None, 1.0, 1.0, x))
            state, report = episodes.advance(state, second, 1, 1.0, 1.0, x, 3.0, 4, 6)
            if report:
                want.append((key, *report))
    read = spark.createDataFrame(rows, "key long, second long, observed int, window_count long, mean double, std double, intensity double")
    got = episodes.episodes(read, DetectorConfig(window=3, baseline=12, k=3.0, hold_cap=4, cooldown=6)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
