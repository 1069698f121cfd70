"""Late rows: the stream against a plain replay that counts them and evaluates their seconds again."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.config import DetectorConfig
from pulsegrid.operators import episodes
from pulsegrid.streaming import late

from .test_streams import arriving, run

CFG = DetectorConfig(window=1, baseline=4, k=2.0, hold_cap=3, cooldown=2, fraction=0.5)
TOLERANCE = 5


def reading(counts, now, cfg):
    """What a plain evaluation of one second measures."""
    low, high = now - cfg.window + 1 - cfg.baseline, now - cfg.window
    values = [counts.get(s, 0) for s in range(low, high + 1)]
    there = [s for s in counts if low <= s <= high]
    observed = now - cfg.window + 1 - min(there) if there else 0
    window = sum(counts.get(s, 0) for s in range(now - cfg.window + 1, now + 1))
    spread = len(values) * sum(v * v for v in values) - sum(values) ** 2
    ok = observed >= cfg.gate and spread > 0
    mean, std = sum(values) / len(values), math.sqrt(max(0, spread) / (len(values) * (len(values) - 1)))
    return window, mean, std, (window / cfg.window - mean) / std if ok else None


def replay(batches, cfg):
    """A timer for each second of each row, fired in order once the watermark has passed it, and one for the next second as
    long as counts are left."""
    counts, states, timers, top, out = {}, {}, set(), None, []
    for batch in [*batches, []]:
        due = None if top is None else (top * 1000 - TOLERANCE * 1000) // 1000 - 1
        here = {}
        for k, s, counted in batch:
            if counted:
                counts.setdefault(k, {}).setdefault(s, 0)
                counts[k][s] += 1
                timers.add((s, k))
                here[k, s] = here.get((k, s), 0) + 1
        out += [("late", k, s, n) for (k, s), n in here.items() if due is not None and s <= due]
        while due is not None and timers and min(timers)[0] <= due:
            second, k = min(timers)
            timers.discard((second, k))
            known = {s: n for s, n in counts[k].items() if s <= second}
            before = states.get(k, episodes.State())
            states[k], report = episodes.advance(before, second, *reading(known, second, cfg), cfg.k, cfg.hold_cap, cfg.cooldown)
            if report:
                out.append(("report", k, second, report[0], report[2], round(report[3], 9)))
            if states[k].regressed > before.regressed:
                out.append(("regressed", k, second, 1))
            counts[k] = {s: n for s, n in counts[k].items() if s > second - cfg.retained}
            if counts[k]:
                timers.add((second + 1, k))
        top = max([x for x in [top, *(s for _, s, _ in batch)] if x is not None], default=None)
    return sorted(out)


def streamed(spark, folder, batches, name):
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run(late.decisions(arriving(spark, f"{folder}/in", batches), "key", "at", CFG), f"{folder}/c", name)
    finally:
        spark.conf.unset(store)
    out = []
    for r in spark.table(name).collect():
        out.append((r["kind"], r["key"], r["second"], r["started_at"], r["peak_at"], round(r["peak_intensity"], 9)) if r["kind"] == "report" else (r["kind"], r["key"], r["second"], r["n"]))
    return sorted(out)


def test_late_rows_are_counted_and_evaluated_again(spark, tmp_path):
    """Late rows make a burst that the rows in time did not; a late row behind an open hold's peak leaves it as it is."""
    calm = [("a", 100 + i, True) for i in range(8) for _ in range(1 + i % 2)]
    batches = [calm, [("a", 113, False)], [("a", 106, True)] * 9, [("a", 121, True)] * 3, [("a", 119, True)] * 2 + [("b", 90, True)], [("a", 140, False)], [("a", 141, False)]]
    got = streamed(spark, str(tmp_path), batches, "late_again")
    assert got == replay(batches, CFG)
    assert ("late", "a", 106, 9) in got and any(g[0] == "report" and g[4] == 106 for g in got)


@pytest.mark.parametrize("seed", range(2))
def test_stream_equals_replay_with_late_rows(spark, tmp_path, seed):
    draw = random.Random(seed)
    batches, now = [], 100
    for _ in range(14):
        rows = []
        for _ in range(draw.randint(1, 6)):
            second = now + draw.randint(0, 3) - draw.choice([0, 0, 0, 2, 8, 11, 14])
            rows += [(draw.choice("ab"), second, draw.random() < 0.9)] * draw.choice([1, 1, 2, 9])
        batches.append(rows)
        now += draw.choice([1, 2, 3, 4, 4, 20])
    batches.append([("c", now + 60, False)])
    got, want = streamed(spark, str(tmp_path), batches, f"late_random_{seed}"), replay(batches, CFG)
    assert got == want
    assert {g[0] for g in got} >= {"late", "report"}


def walks(batches, cfg):
    """The keyed state alone, fed as the stream feeds it."""
    kept, top, out = {}, None, []
    for batch in [*batches, []]:
        due = None if top is None else top - TOLERANCE - 1
        here = {}
        for k, s, counted in batch:
            if counted:
                here.setdefault(k, {}).setdefault(s, 0)
                here[k][s] += 1
        for k in sorted({*kept, *here}):
            walk = late._LateWalk(kept.get(k))
            for s, n in sorted(here.get(k, {}).items()):
                walk.count(s, n)
            if due is not None:
                out += [("late", k, s, n) for s, n in here.get(k, {}).items() if s <= due]
                out += [("report", k, r[1], r[0], r[2], round(r[3 + 0], 9)) for r in walk.to(due, cfg)]
                out += [("regressed", k, s, n) for s, n in walk.regressed.items()]
            kept[k] = walk.kept()
        top = max([x for x in [top, *(s for _, s, _ in batch)] if x is not None], default=None)
    return sorted(out)


def test_walk_with_late_rows_equals_replay():
    """Many random streams, without Spark; regressed evaluations among them."""
    kinds = {}
    for seed in range(300):
        draw = random.Random(seed)
        batches, now = [], 100
        for _ in range(25):
            rows = []
            for _ in range(draw.randint(0, 5)):
                second = now + draw.randint(0, 3) - draw.choice([0, 0, 0, 0, 3, 7, 9, 12])
                rows += [(draw.choice("ab"), second, draw.random() < 0.95)] * draw.choice([1, 1, 1, 2, 3, 12])
            batches.append(rows)
            now += draw.choice([0, 1, 1, 2, 3, 4, 20])
        want = replay(batches, CFG)
        assert merged(walks(batches, CFG)) == merged(want), seed
        for w in want:
            kinds[w[0]] = kinds.get(w[0], 0) + 1
    assert kinds["regressed"] > 20 and kinds["report"] > 200 and kinds["late"] > 500


def merged(rows):
    """Regressed evaluations of a second are added up, as a stream does that evaluates it several times in a batch."""
    out = {}
    for r in rows:
        if r[0] == "regressed":
            out[r[:3]] = out.get(r[:3], 0) + r[3]
        else:
            out[r] = out.get(r, 0) + 1
    return sorted(out.items())
