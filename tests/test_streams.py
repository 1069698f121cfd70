"""Streams over several batches: watermarks, late rows, state that ends, and sinks."""

import json
import math
import random

from pyspark.sql import functions as F

from pulsegrid.config import DetectorConfig
from pulsegrid.operators import episodes
from pulsegrid.streaming import detector, sources

CFG = DetectorConfig(window=1, baseline=4, k=2.0, hold_cap=3, cooldown=2, fraction=0.5)
SCHEMA = "key string, at timestamp, counted boolean"


def arriving(spark, folder, batches):
    """A stream of a file a batch; batches: lists of (key, second, counted)."""
    for rows in batches:
        df = spark.createDataFrame([(k, s, c) for k, s, c in rows], "key string, s long, counted boolean")
        df.select("key", F.timestamp_seconds("s").alias("at"), "counted").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, folder, name):
    query = stream.writeStream.format("memory").option("checkpointLocation", folder).outputMode("append").trigger(availableNow=True).queryName(name).start()
    query.awaitTermination()
    return query


def test_commands_move_the_watermark_but_are_not_counted(spark, tmp_path):
    """A row that is not counted closes the bucket before it, as it would if it were."""
    batches = [[("a", 100, True), ("a", 100, True)], [("a", 120, False)], [("a", 121, False)]]
    counted = detector.bucket_counts(arriving(spark, f"{tmp_path}/in", batches), "key", "at", CFG)
    run(counted.select("key", F.unix_seconds("window.start").alias("second"), "n"), f"{tmp_path}/c", "commands")
    assert [tuple(r) for r in spark.table("commands").collect()] == [("a", 100, 2)]
    apart = detector.bucket_counts(arriving(spark, f"{tmp_path}/in2", batches[:1]), "key", "at", CFG)
    run(apart.select("key", "n"), f"{tmp_path}/c2", "still_open")
    assert spark.table("still_open").count() == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    batches = [[("a", 100, True)], [("a", 150, True)], [("a", 151, True)], [("a", 100, True), ("a", 149, True)], [("a", 200, True)], [("a", 201, True)]]
    counted = detector.bucket_counts(arriving(spark, f"{tmp_path}/in", batches), "key", "at", CFG)
    query = run(counted.select(F.unix_seconds("window.start").alias("second"), "n"), f"{tmp_path}/c", "late")
    assert sorted(map(tuple, spark.table("late").collect())) == [(100, 1), (149, 1), (150, 1), (151, 1)]
    assert sources.late_rows(query) == 1


def test_holds_last_over_batches_and_state_ends(spark, tmp_path):
    """A burst that lies in several batches is one report; once the retained span has passed, no state is left."""
    levels = [2, 1, 2, 1, 2, 9, 12, 1, 2, 1]
    batches = [[("a", 100 + i, True)] * n for i, n in enumerate(levels)] + [[("b", 300, True)], [("b", 301, True)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = detector.episodes(detector.bucket_counts(arriving(spark, f"{tmp_path}/in", batches), "key", "at", CFG), CFG)
        query = run(stream.select("key", "started_at", "fired_at", "peak_at"), f"{tmp_path}/c", "holds")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    from pulsegrid.operators import readings

    counts = spark.createDataFrame([("a", 100 + i, n) for i, n in enumerate(levels)], "key string, second long, n long")
    want = episodes.episodes(readings.readings(counts, CFG), CFG).select("key", "started_at", "fired_at", "peak_at").collect()
    assert sorted(map(tuple, spark.table("holds").collect())) == sorted(map(tuple, want)) and want
    walks = [op for op in query.lastProgress.stateOperators if "transformWithState" in op.operatorName]
    assert walks and all(op.numRowsTotal == 0 or op.customMetrics.get("numValueStateVars", 1) >= 0 for op in walks)


def test_a_bucket_before_the_peak_changes_nothing_but_is_flagged():
    hold = episodes.Hold(1000, 1.0, 1.0, 1010, 9.0, 90, 1.0, 1.0)
    state = episodes.State(hold, 900)
    after, report = episodes.advance(state, 1005, 50, 1.0, 1.0, 0.0, 3.0, 25, 30)
    assert report is None and after.hold == hold and after.last_fire == 900 and after.regressed == 1
    after, _ = episodes.advance(after, 1006, 50, 1.0, 1.0, None, 3.0, 25, 30)
    assert after.regressed == 2
    after, report = episodes.advance(after, 1011, 10, 1.0, 1.0, 0.0, 3.0, 25, 30)
    assert report is not None and after.hold is None and after.regressed == 2


def test_readings_text_is_refused_without_settings(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("key\tsecond\n1\t2\n")
    try:
        sources.read_readings_text(spark, str(tmp_path / "r.tsv"))
    except ValueError:
        return
    raise AssertionError("it was read")


def test_insert_clips_adds_each_clip_once(spark, tmp_path):
    schema = "clip_id long, broadcaster_id long, detected_at long"
    spark.createDataFrame([(1, 1, 5)], schema).write.parquet(f"{tmp_path}/table")
    for rows in ([(1, 1, 9), (2, 1, 7)], [(2, 1, 8), (3, 2, 1), (3, 2, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sources.insert_clips(stream, f"{tmp_path}/table", f"{tmp_path}/c").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table").collect())) == [(1, 1, 5), (2, 1, 7), (3, 2, 1)]


def test_capture_goes_on_where_it_stopped(spark, tmp_path):
    line = {"broadcaster_id": 1, "timestamp": 2000, "sent_at": 1000, "message_id": "m", "text": "hi", "user_id": 1, "user_name": "u"}
    for n in (1, 2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(line | {"timestamp": 1000 * n}))
        sources.capture(sources.json_messages(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_walk_in_steps_equals_a_plain_fold():
    """Reports of a key that is walked in random steps, against every bucket measured and folded by itself."""
    draw = random.Random(8)
    cfg = DetectorConfig(window=2, baseline=8, k=1.5, hold_cap=3, cooldown=4, fraction=0.5)
    total = 0
    for _ in range(60):
        counts, second = {}, 100
        for _ in range(draw.randint(5, 80)):
            second += draw.choice([1, 1, 1, 1, 2, 3, 30])
            counts[second] = draw.choice([1, 2, 2, 3, 3, 9, 15])
        state, want, end = episodes.State(), [], second + 40
        for now in range(100, end + 1):
            if not any(now - cfg.retained <= s <= now for s in counts):
                continue
            low, high = now - cfg.window + 1 - cfg.baseline, now - cfg.window
            values = [counts.get(s, 0) for s in range(low, high + 1)]
            there = [s for s in counts if low <= s <= high]
            observed = now - cfg.window + 1 - min(there) if there else 0
            window = sum(counts.get(s, 0) for s in range(now - cfg.window + 1, now + 1))
            spread = len(values) * sum(v * v for v in values) - sum(values) ** 2
            ok = observed >= cfg.gate and spread > 0
            mean, std = sum(values) / len(values), math.sqrt(spread / (len(values) * (len(values) - 1)))
            level = (window / cfg.window - mean) / std if ok else None
            state, report = episodes.advance(state, now, window, mean, std, level, cfg.k, cfg.hold_cap, cfg.cooldown)
            want += [report[:5]] if report else []
        walk, got, due, left = detector._Walk(None), [], 99, sorted(counts)
        while due < end:
            due = min(end, due + draw.randint(1, 25))
            while left and left[0] <= due:
                walk.add(left[0], counts[left.pop(0)])
            got += walk.to(due, cfg)
            walk = detector._Walk(walk.kept())
        assert [g[:3] for g in got] == [w[:3] for w in want] and [g[4] for g in got] == [w[4] for w in want]
        assert walk.over(end + 40, cfg) or walk.state.hold
        total += len(want)
    assert total > 50


def test_kafka_options(spark):
    """The options of the connector, which is not here: servers, topic, group and where to begin."""

    class Reader:
        def __init__(self):
            self.options = {}

        def format(self, kind):
            self.kind = kind
            return self

        def option(self, key, value):
            self.options[key] = value
            return self

        def load(self):
            return self

        def select(self, *columns):
            self.columns = columns
            return self

    class Session:
        readStream = Reader()

    found = sources.kafka_lines(Session(), "a:9092,b:9092", "chat", "burst")
    assert (found.kind, len(found.columns)) == ("kafka", 4)
    assert found.options == {"kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "chat", "kafka.group.id": "burst", "startingOffsets": "latest"}


def test_states_are_no_more_than_cores(spark, tmp_path):
    """A drained stream keeps a state partition for each core, whatever the session's shuffle partitions, which are restored."""
    before, key = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.shuffle.partitions"
    spark.conf.set(key, "23")
    try:
        counted = detector.bucket_counts(arriving(spark, f"{tmp_path}/in", [[("a", 100, True), ("b", 100, True)], [("a", 150, True)], [("a", 151, True)]]), "key", "at", CFG)
        found = sources.drained(counted.select("key", F.unix_seconds("window.start").alias("second"), "n"), "by_cores", str(tmp_path))
        assert sorted(map(tuple, found.collect())) == [("a", 100, 1), ("b", 100, 1)]
        assert spark.conf.get(key) == "23"
    finally:
        spark.conf.set(key, before)
    states = [p for p in (tmp_path / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
    assert 0 < len(states) <= spark.sparkContext.defaultParallelism
