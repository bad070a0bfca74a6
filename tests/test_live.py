"""Numbered live sessions and the activity mart against batch results, over several micro-batches."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import T
from pyspark.sql import functions as F

from retentia.operators import events, sessions
from retentia.streaming.activity import activity, activity_at, activity_windows
from retentia.streaming.live_sessions import current_sessions, merge_runs, session_updates

CONVS = "id string, user_id string, influencer_id string, conversation_type string"
MESSAGES = "id bigint, conversation_id string, role string, created_at timestamp"
EVENTS = "ts timestamp, event_name string, event_id string, u string"


def deliver(spark, base, schema, batches, flow, *partitions):
    """Each batch in a run of its own, all with one checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(f"{base}/in")
        out = flow(spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")).writeStream.format("parquet")
        out = out.option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
        (out.partitionBy(*partitions) if partitions else out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@pytest.fixture()
def few(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_merge_runs_is_a_gap_rule_over_reach():
    rows = np.array([[50, 60, 1], [0, 40, 1], [5, 9, 1], [51, 52, 1], [71, 71, 1]])
    assert merge_runs(rows, 10).tolist() == [[0, 60, 4], [71, 71, 1]]
    assert merge_runs(rows, 11).tolist() == [[0, 71, 5]]
    assert merge_runs(rows[:0], 10).tolist() == []


def test_updates_join_close_and_number(spark, few, tmp_path):
    convs = spark.createDataFrame([("c1", "u1", None, "ai_chat"), ("c2", "u2", "i2", "human")], CONVS)
    at = lambda i, s, c="c1", r="user": (i, c, r, T(f"2024-01-01 {s}"))
    batches = [
        [at(1, "10:00:00"), at(2, "10:30:00", r="assistant"), at(3, "10:00:00", c="c2"), at(4, "10:01:00", c=None), (5, "c1", "user", None)],
        [at(6, "10:20:00"), at(7, "10:50:00.000001", r="system")],  # exactly 20 minutes and 10: one session of three; one microsecond past: a new one
        [at(8, "14:00:00")],
        [at(9, "10:40:00"), at(10, "14:10:00")],  # the first lies behind the watermark
    ]
    out = deliver(spark, str(tmp_path), MESSAGES, batches, lambda m: session_updates(m, convs))
    assert {r.status for r in out.collect()} == {"open", "closed"}
    got = current_sessions(out, convs).orderBy("session_index").collect()
    cut = [(r.session_index, r.started_at, r.ended_at, r.user_turns, r.bot_turns, r.system_turns, r.status, r.user_id) for r in got]
    assert cut == [
        (1, T("2024-01-01 10:00:00"), T("2024-01-01 10:30:00"), 2, 1, 0, "closed", "u1"),
        (2, T("2024-01-01 10:50:00.000001"), T("2024-01-01 10:50:00.000001"), 0, 0, 1, "closed", "u1"),
        (3, T("2024-01-01 14:00:00"), T("2024-01-01 14:10:00"), 2, 0, 0, "open", "u1"),
    ]


def test_updates_in_any_order_equal_the_batch(spark, few, tmp_path):
    """A hot conversation and small ones; each message comes up to an hour after it was sent."""
    rnd, rows = random.Random(5), []
    for i in range(900):
        conv = "hot" if i % 3 == 0 else f"c{rnd.randrange(40)}"
        t = T("2024-01-01 00:00:00") + dt.timedelta(seconds=rnd.randrange(12 * 3600), microseconds=i)
        rows.append((i, conv, rnd.choice(["user", "assistant", "system"]), t))
    came = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rnd.randrange(3600)))
    convs = spark.createDataFrame([(c, f"u-{c}", "i", "ai_chat") for c in sorted({r[1] for r in rows})], CONVS)
    out = deliver(spark, str(tmp_path), MESSAGES, [came[n : n + 225] for n in range(0, 900, 225)], lambda m: session_updates(m, convs, gap_minutes=5, delay="2 hours"))
    assert out.where("status = 'closed'").count() > 0
    assert out.count() == out.select("conversation_id", "session_index", "version").distinct().count()
    want = sessions.sessionize(spark.createDataFrame(rows, MESSAGES), convs, gap_minutes=5, tie_break="id")
    got = current_sessions(out, convs).drop("status").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_joined_session_gives_its_number_back(spark, few, tmp_path):
    convs = spark.createDataFrame([("c1", "u1", None, "ai_chat")], CONVS)
    batches = [[(1, "c1", "user", T("2024-01-01 10:00:00")), (2, "c1", "user", T("2024-01-01 10:30:00"))], [(3, "c1", "user", T("2024-01-01 10:15:00"))]]
    out = deliver(spark, str(tmp_path), MESSAGES, batches, lambda m: session_updates(m, convs))
    told = out.orderBy("version", "session_index").select("session_index", "user_turns", "status").collect()
    assert list(map(tuple, told)) == [(1, 1, "open"), (2, 1, "open"), (1, 3, "open"), (2, 1, "gone")]
    assert [tuple(r) for r in current_sessions(out, convs).select("session_index", "user_turns").collect()] == [(1, 3)]


def test_empty_stream_writes_nothing(spark, few, tmp_path):
    convs = spark.createDataFrame([("c1", "u1", None, "ai_chat")], CONVS)
    out = deliver(spark, str(tmp_path), MESSAGES, [[(1, "unknown", "user", T("2024-01-01 00:00:00"))]], lambda m: session_updates(m, convs))
    assert current_sessions(out, convs).count() == 0


def test_activity_equals_the_card_at_every_minute(spark, few, tmp_path):
    rnd = random.Random(3)
    rows = [(T("2024-01-01 00:00:00") + dt.timedelta(seconds=rnd.randrange(4 * 3600) if i % 4 else 7200, milliseconds=i), "event", str(i), rnd.choice(["", None, "a", "b", "c"])) for i in range(160)]
    rows.append((T("2024-01-01 05:00:00"), "event", "edge", "d"))
    rows.sort(key=lambda r: r[0])
    half = [r for r in rows if r[0] < T("2024-01-01 02:30:00")]
    again = [r for r in half if r[0] >= T("2024-01-01 02:25:00")]  # copies inside the watermark
    old = [r for r in half if r[0] < T("2024-01-01 01:00:00")]  # copies behind it
    late = [(T("2024-01-01 00:10:00"), "event", "late", "z"), (None, "event", "never", "a")]
    rest = rows[len(half) :]
    mart = deliver(spark, str(tmp_path), EVENTS, [half, again + old + late + rest + rest], lambda ev: activity_windows(ev, "10 minutes"), "day")
    got = {r.minute: tuple(r)[1:] for r in activity(mart).collect()}
    assert mart.count() == mart.select("minute").distinct().count()

    def card(m):
        quarter = [r for r in rows if m - dt.timedelta(minutes=15) <= r[0] < m]
        return len(quarter), sum(m - dt.timedelta(minutes=60) <= r[0] < m for r in rows), len({r[3] or "" for r in quarter})

    newest = mart.agg(F.max("minute")).first()[0]
    assert newest <= T("2024-01-01 04:50:00")
    minutes = [T("2024-01-01 00:01:00") + dt.timedelta(minutes=n) for n in range(400)]
    assert got == {m: card(m) for m in minutes if m <= newest and card(m)[1]}

    ev = spark.createDataFrame(rows, EVENTS).withColumn("u", F.coalesce("u", F.lit("")))
    for m in (T("2024-01-01 01:00:00"), T("2024-01-01 02:07:00"), T("2024-01-02 12:00:00")):
        batch = events.recent_activity(ev.where(F.col("ts") < F.lit(m)), str(m)).first()
        assert tuple(activity_at(mart, str(m)).first()) == tuple(batch)


def test_conversations_share_rows_of_the_state(spark, few, tmp_path):
    """Sixty conversations in four buckets: four state rows, each conversation numbered and closed by itself."""
    convs = spark.createDataFrame([(f"c{i}", f"u{i}", None, "ai_chat") for i in range(60)], CONVS)
    early = [(i, f"c{i}", "user", T("2024-01-01 10:00:00") + dt.timedelta(seconds=i)) for i in range(60)]
    apart = [(100 + i, f"c{i}", "assistant", T("2024-01-01 10:40:00")) for i in range(0, 60, 2)]
    joins = [(200 + i, f"c{i}", "system", T("2024-01-01 10:20:00") + dt.timedelta(seconds=i)) for i in range(0, 60, 4)]
    later = [(300, "c1", "user", T("2024-01-01 23:00:00"))]
    out = deliver(spark, str(tmp_path), MESSAGES, [early + apart, joins, later], lambda m: session_updates(m, convs, buckets=4))
    got = current_sessions(out, convs)
    want = sessions.sessionize(spark.createDataFrame(early + apart + joins + later, MESSAGES), convs, tie_break="id")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert [tuple(r) for r in got.where("status = 'open'").select("conversation_id", "session_index").collect()] == [("c1", 2)]
    state = spark.read.format("statestore").load(f"{tmp_path}/ckpt")
    assert state.count() <= 4
