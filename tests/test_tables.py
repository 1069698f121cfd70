"""Stored tables, numbered lines, cursors and notices, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.config import DetectorConfig
from pulsegrid.operators import clips, messages, monitors, readings
from pulsegrid.sources import lines, versioned
from pulsegrid.streaming import sources

STREAMERS = "streamer_id long, streamer_login string, allows_clipping boolean, first_seen_ms long, last_seen_ms long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, path, buckets=4):
    return versioned.VersionedTable(spark, str(path), STREAMERS, ["streamer_id"], buckets)


def seen(spark, *what):
    return spark.createDataFrame([(i, f"s{i}-{t}", t) for i, t in what], "streamer_id long, login string, seen_ms long")


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    kept = table(spark, tmp_path)
    assert kept.read().count() == 0
    assert kept.merge(seen(spark, (1, 5), (2, 6), (1, 9)), clips.upsert_streamers, "w", 0)
    before, number = rows(kept.read()), kept.version()[0]
    assert before == [(1, "s1-9", True, 5, 9), (2, "s2-6", True, 6, 6)]
    assert not kept.merge(seen(spark, (1, 50)), clips.upsert_streamers, "w", 0) and rows(kept.read()) == before and kept.version()[0] == number
    assert kept.merge(seen(spark, (1, 50), (7, 1)), clips.upsert_streamers, "w", 1) and kept.merge(seen(spark, (2, 8)), clips.upsert_streamers, "other", 0)
    assert rows(kept.read()) == [(1, "s1-50", True, 5, 50), (2, "s2-8", True, 6, 8), (7, "s7-1", True, 1, 1)]
    assert kept.merge(seen(spark).limit(0), clips.upsert_streamers, "w", 2) and kept.read().count() == 3


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A failure before the version is put down leaves the old one; another change at once is refused; the batch can come again."""
    kept = table(spark, tmp_path)
    kept.merge(seen(spark, *((i, 1) for i in range(20))), clips.upsert_streamers, "w", 0)
    before = rows(kept.read())
    with monkeypatch.context() as m:
        m.setattr(kept, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.merge(seen(spark, *((i, 9) for i in range(20))), clips.upsert_streamers, "w", 1)
    assert rows(kept.read()) == before
    now = kept.version()
    with monkeypatch.context() as m:  # a change that began before the last one was put down
        m.setattr(kept, "version", lambda: (now[0] - 1, now[1]))
        with pytest.raises(versioned.VersionConflictError):
            kept.merge(seen(spark, (3, 7)), clips.upsert_streamers, "x", 0)
    assert rows(kept.read()) == before
    kept.merge(seen(spark, *((i, 9) for i in range(20))), clips.upsert_streamers, "w", 1)
    assert {r[4] for r in rows(kept.read())} == {9}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    kept = table(spark, tmp_path, 8)
    kept.merge(seen(spark, *((i, 1) for i in range(40))), clips.upsert_streamers, "w", 0)
    before = kept.version()[1]["buckets"]
    kept.merge(seen(spark, (5, 2)), clips.upsert_streamers, "w", 1)
    after = kept.version()[1]["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    off = spark.createDataFrame([(5,), (99,)], "streamer_id long")
    kept.merge(off, clips.disable_clipping, "flags", 0)
    assert [r[0] for r in rows(kept.read()) if not r[2]] == [5]


def test_stream_of_upserts_equals_the_batch_form(spark, tmp_path):
    draw, kept, every = random.Random(3), table(spark, tmp_path / "table"), []
    for k in range(4):
        part = [(draw.randint(0, 15), 10 * k + draw.randint(0, 20)) for _ in range(12)]
        every += part
        seen(spark, *part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("streamer_id long, login string, seen_ms long").parquet(f"{tmp_path}/in")
        sources.merge_stream(stream, kept, clips.upsert_streamers, "w", f"{tmp_path}/c").awaitTermination()
    empty = spark.createDataFrame([], STREAMERS)
    assert rows(kept.read()) == rows(clips.upsert_streamers(empty, seen(spark, *every)))


@pytest.mark.parametrize("size", ["64b", "1000b", "128m"])
def test_lines_are_numbered_however_files_are_split(spark, tmp_path, size):
    draw, want = random.Random(1), []
    for f in range(3):
        text = [f"{f}:{i}:" + "x" * draw.choice([0, 1, 5, 90, 400]) for i in range(draw.choice([0, 1, 70]) if f else 120)]
        (tmp_path / f"{f}.txt").write_text("\n".join(text) + ("\n" if f == 1 and text else ""))
        want += [(f"{f}.txt", i, t) for i, t in enumerate(text)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = [(r["file"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in lines.numbered_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted(want)


def test_audit_of_uneven_arrival_numbers(spark):
    """All but a few rows lie in a hundredth of the range of numbers; ranges still hold about as many rows each."""
    draw = random.Random(2)
    arrival = sorted({draw.randint(0, 10_000) if i % 100 else draw.randint(0, 10**9) for i in range(3000)})
    times = [1000 * i + draw.choice([0, 0, 0, -9000, -100_000, 20_000]) for i in range(len(arrival))]
    df = spark.createDataFrame([(a, t if t % 7 else None) for a, t in zip(arrival, times, strict=True)], "n long, ms long").repartition(8)
    got = {r["n"]: (r["watermark_ms"], r["late"]) for r in messages.late_rows(df, "n", "ms", ranges=8).collect()}
    top, want = None, {}
    for a, t in zip(arrival, times, strict=True):
        mark, t = None if top is None else top - 5001, t if t % 7 else None
        want[a] = (mark, mark is not None and t is not None and t <= mark)
        top = t if top is None else max(top, t if t is not None else top)
    assert got == want
    sizes = df.repartitionByRange(8, "n").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 0.4 * df.count()


def test_all_pages_by_cursor_while_clips_come(spark, tmp_path):
    draw = random.Random(4)
    known = [(i, i % 3, None if i % 17 == 0 else 100 + draw.randint(0, 20), draw.choice([3.0, 9.0, 12.0, None])) for i in range(90)]
    schema = "clip_id long, broadcaster_id long, detected_at long, intensity double"
    channels = spark.createDataFrame([(0, "a"), (1, "b")], "streamer_id long, streamer_login string")
    spark.createDataFrame(known, schema).write.parquet(f"{tmp_path}/clips")
    cursor, pages, new = None, [], 1000
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    while True:
        stored = spark.read.parquet(f"{tmp_path}/clips")
        page = clips.next_page(stored, channels, cursor, limit=7)
        found = [r["clip_id"] for r in page.collect()]
        if cursor is not None and cursor[0] is not None:
            plan = page._jdf.queryExecution().executedPlan().toString()
            assert f"LessThanOrEqual(detected_at,{cursor[0]})" in plan
        if not found:
            break
        pages += found
        cursor = clips.cursor(page)
        spark.createDataFrame([(new, 1, 500 + new, 20.0)], schema).write.mode("append").parquet(f"{tmp_path}/clips")  # at the front
        new += 1
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert sorted(pages) == sorted(i for i, _, _, x in known if x is not None and x >= 9.0) and len(pages) == len(set(pages))


def test_notices_come_the_interval_after_the_last_one_sent(spark, monkeypatch):
    monkeypatch.setattr(monitors, "BLOCK", 2)
    draw, alerts = random.Random(6), []
    for name in ("a", "b", None):
        for severity in ("critical", "warning"):
            t = draw.randint(-50, 50)
            for _ in range(120):
                t += draw.choice([1, 1, 2, 3, 5, 9, 60])
                alerts += [(name, severity, t)] * draw.choice([1, 1, 2])
    wait = {"critical": 10, "warning": 25}
    fired = {(n, t) for n, s, t in alerts if s == "critical" and n is not None}
    left = [a for a in alerts if a[1] == "critical" or (a[0], a[2]) not in fired]
    want, on_grid = [], 0
    for group in sorted({a[:2] for a in left}, key=repr):
        last = None
        ticks = sorted({t for *g, t in left if tuple(g) == group})
        for t in ticks:
            if last is None or t >= last + wait[group[1]]:
                want.append((*group, t, left.count((*group, t))))
                last = t
        on_grid += len({(t - ticks[0]) // wait[group[1]] for t in ticks})
    got = monitors.roll_up(spark.createDataFrame(alerts, "name string, severity string, tick long"), {"critical": 10}, 25)
    assert rows(got) == sorted(want, key=repr)
    assert len(want) != on_grid  # a grid of intervals would tell otherwise


def test_runs_of_stored_readings_need_no_exchange(spark, tmp_path):
    counts = spark.createDataFrame([(k, s, 1 + (s * k) % 5 + 20 * (s % 40 == 0)) for k in (1, 2, 3) for s in range(200)], "key long, second long, n long")
    cfg = DetectorConfig(window=1, baseline=10, k=1.5, hold_cap=3, cooldown=2)
    read = readings.readings(counts, cfg)
    found = readings.elevated_runs(sources.store_readings(read, "stored_readings_test", f"{tmp_path}/readings", 4), cfg.k)
    assert rows(found) == rows(readings.elevated_runs(read, cfg.k)) and found.count() > 5
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE stored_readings_test")


def test_capture_report(spark, tmp_path):
    line = {"broadcaster_id": 1, "timestamp": 2000, "sent_at": 1000, "message_id": "m", "text": "hi"}
    (tmp_path / "c.json").write_text("\n".join([json.dumps(line), json.dumps(line | {"timestamp": 12_000, "broadcaster_id": 2, "user_id": 5}), "{cut"]))
    got = sources.capture_report(spark.read.schema(messages.MESSAGE).json(str(tmp_path)), 10.0, str(tmp_path)).first()
    assert tuple(got)[:8] == (2000, 12_000, 10.0, 2, 1, 0.2, True, 2)
    assert (got["sample_keys"], got["completed"], got["bytes"]) == (["broadcaster_id", "message_id", "sent_at", "text", "timestamp"], True, (tmp_path / "c.json").stat().st_size)
    none = sources.capture_report(spark.createDataFrame([], messages.MESSAGE), 10.0).first()
    assert (none["messages"], none["errors"], none["completed"], none["has_sent_at"]) == (0, 0, None, False)
