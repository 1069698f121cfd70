"""Messages, pages, roster, monitors and attempts on small inputs."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import cards
from pulsegrid.operators import attempts, clips, messages, monitors, roster
from pulsegrid.sources import contract
from pulsegrid.streaming import sources


def test_parse_drops_what_is_no_message(spark):
    lines = spark.createDataFrame([('{"broadcaster_id": 1, "text": "hi"}',), ("{bad",), ("[]",), ("",), (None,), ('{"text": "x"}',)], "line string")
    assert [r["text"] for r in messages.parse(lines).collect()] == ["hi"]


def test_commands(spark):
    texts = ["!clip", "!8ball magic", "! hi", "!!", " !x", "hello", None]
    kept = messages.drop_commands(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r["text"] for r in kept] == ["! hi", "!!", " !x", "hello", None]


def test_event_time_falls_back(spark):
    rows = spark.createDataFrame([("5", 9), ("x", 9), (None, 9)], "sent_at string, record_ms long")
    assert [r["event_ms"] for r in messages.event_time(rows, "record_ms").collect()] == [5, 9, 9]


def test_slices_need_an_offset(spark):
    rows = spark.createDataFrame([(-1,), (0,), (999,), (1000,), (None,)], "sent_at long")
    got = messages.time_slice(rows, datetime(1970, 1, 1, tzinfo=UTC), datetime(1970, 1, 1, 0, 0, 1, tzinfo=UTC))
    assert [r["sent_at"] for r in got.collect()] == [0, 999]
    with pytest.raises(ValueError):
        messages.time_slice(rows, datetime(1970, 1, 1), datetime(1970, 1, 2, tzinfo=UTC))


def test_buckets_round_down(spark):
    assert [r[0] for r in spark.createDataFrame([(-1,), (0,), (1999,)], "ms long").select(messages.bucket(F.col("ms"))).collect()] == [-1, 0, 1]


def test_page_arguments():
    assert clips.page_arguments() == (9.0, 24, 0) and clips.page_arguments(" ", "0", "-3") == (9.0, 1, 0) and clips.page_arguments("0", 500, "2") == (0.0, 100, 2)
    for wrong in ("-1", "x", float("nan")):
        with pytest.raises(ValueError):
            clips.page_arguments(wrong)


def test_page_with_unknown_channel(spark):
    rows = spark.createDataFrame([(1, 7, 10, 9.5), (2, 8, 11, None), (3, 9, 12, 12.0)], "clip_id long, broadcaster_id long, detected_at long, intensity double")
    page = clips.clip_page(rows, spark.createDataFrame([(7, "a")], "streamer_id long, streamer_login string"))
    assert sorted((r["clip_id"], r["streamer_login"]) for r in page.collect()) == [(1, "a"), (3, None)]
    assert tuple(clips.page_summary(rows, limit=1).first()) == (1, 2, True)


def test_cards(spark):
    now = 1_000_000_000_000
    ages = {0: "Just now", 60_000: "1 minute ago", 7_200_000: "2 hours ago", 86_400_000: "1 day ago", 7 * 86_400_000: "2001-09-02"}
    for ago, said in ages.items():
        assert spark.range(1).select(cards.relative_time(F.lit(now - ago), now)).first()[0] == said
    text = spark.range(1).select(cards.escape_attribute(F.lit("<a href=\"x\">&'")), cards.delay_list(F.lit("0, 2,,4"))).first()
    assert tuple(text) == ("&lt;a href=&quot;x&quot;&gt;&amp;&#39;", [0, 2, 4])
    with pytest.raises(Exception, match="no delays"):
        spark.range(1).select(cards.delay_list(F.concat(F.col("id").cast("string"), F.lit(" ")).substr(2, 1))).collect()


def test_roster_equals_set_algebra(spark):
    import random

    draw = random.Random(1)
    polls = [(p * 120_000, s, f"s{s}", draw.randint(0, 9)) for p in range(25) for s in range(8) if draw.random() < 0.8]
    df = spark.createDataFrame(polls, "poll_ms long, streamer_id long, login string, viewers long")
    ranks = roster.ranked(df, leave=5)
    got = {(r["poll_ms"], r["streamer_id"]) for r in roster.roster(ranks, df, 2, 5).filter("joined").collect()}
    joined, want = set(), set()
    for p in sorted({r[0] for r in polls}):
        order = [s for _, s in sorted((-v, s) for q, s, _, v in polls if q == p)][:5]
        joined = (joined | set(order[:2])) & set(order)
        want |= {(p, s) for s in joined}
    assert got == want


def test_online_events(spark):
    ranks = spark.createDataFrame([(0, 1, "a", 20), (120_000, 1, "a", 3), (400_000, 1, "a", 3)], "poll_ms long, streamer_id long, login string, rank int")
    assert [r["timestamp"] for r in roster.online_events(ranks).collect()] == [400]


def test_insert_and_flags(spark):
    stored = spark.createDataFrame([("a", 1, 5)], "clip_id string, broadcaster_id long, detected_at long")
    arrived = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), ("b", 2, 7)], stored.schema)
    assert [tuple(r) for r in clips.new_clips(arrived, stored).collect()] == [("b", 1, 6)]
    assert tuple(clips.insert_counts(arrived, stored).first()) == (1, 2)
    who = spark.createDataFrame([(1, True), (2, None)], "streamer_id long, allows_clipping boolean")
    assert sorted(map(tuple, clips.disable_clipping(who, spark.createDataFrame([(1,), (1,), (9,)], "streamer_id long")).collect())) == [(1, False), (2, None)]


def test_sustained(spark):
    rows = spark.createDataFrame([("x", t, v) for t, v in zip(range(0, 90, 15), (1, 1, 1, 0, 1, 1), strict=True)], "series string, tick long, value int")
    assert [tuple(r) for r in monitors.threshold(rows, F.col("value") > 0, 30).collect()] == [("x", 0, 30)]


def test_attempt_outcomes(spark):
    log = [(1, "create", 1, 500, None), (1, "create", 2, 200, "c1"), (1, "metadata", 3, 200, "c1"), (2, "create", 1, 200, None), (2, "create", 2, 200, None), (3, "create", 1, 403, None), (3, "create", 2, 200, "c3"), (4, "create", 1, 200, "c4"), (4, "metadata", 2, 200, None)]
    df = spark.createDataFrame(log, "anomaly_id long, phase string, attempt_no int, status int, clip_id string")
    got = {r["anomaly_id"]: (r["clip_id"], r["found"], r["reason"], r["disabled"]) for r in attempts.outcomes(df).collect()}
    assert got == {1: ("c1", True, None, False), 2: (None, False, "max_retries", False), 3: (None, False, "api_error", True), 4: ("c4", False, "metadata_fetch", False)}


def test_source_contract(spark):
    good = spark.createDataFrame([('{"broadcaster_id":1,"sent_at":5,"timestamp":9}',)], "line string")
    assert contract.check(good) == []
    with pytest.raises(contract.ContractError):
        contract.check(good.union(spark.createDataFrame([("{bad",)], "line string")))
    assert contract.check(good.limit(0), warn_only=True) == ["there are no messages"]


def test_capture_and_insert_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.json").write_text('{"broadcaster_id":1,"sent_at":5,"timestamp":9,"text":"x"}\n')
    for n in (1, 2):
        sources.capture(sources.json_messages(spark, str(source)), str(out), str(tmp_path / "ck")).awaitTermination()
        (source / f"b{n}.json").write_text('{"broadcaster_id":2,"sent_at":6,"timestamp":9,"text":"y"}\n')
    captured = spark.read.schema(messages.MESSAGE).json(str(out))
    report = sources.capture_report(captured).first()
    assert (report["messages"], report["keys"], report["has_sent_at"]) == (2, 2, True)
