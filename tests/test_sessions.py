import random

from pyspark.sql import functions as F

from conftest import T
from retentia.model import CONVERSATIONS_SCHEMA, MESSAGES_SCHEMA
from retentia.operators import sessions as S
from retentia.plans.refresh import refresh_sessions, sessions_table


def frames(spark, msgs, convs=None):
    m = spark.createDataFrame([(i, c, r, T(t)) for i, c, r, t in msgs], MESSAGES_SCHEMA)
    convs = convs or [(c, "u" + c, "i" + c, "ai_chat") for c in sorted({x[1] for x in msgs})]
    return m, spark.createDataFrame(convs, CONVERSATIONS_SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.select("session_index", "started_at", "ended_at", "user_turns", "bot_turns", "system_turns").collect())


def test_exact_gap_stays_in_session(spark):
    m, c = frames(spark, [(1, "a", "user", "2024-01-01 00:00:00"), (2, "a", "user", "2024-01-01 00:20:00"), (3, "a", "user", "2024-01-01 00:40:00.000001")])
    out = rows(S.sessionize(m, c))
    assert [(r[0], r[3]) for r in out] == [(1, 2), (2, 1)]


def test_timestamp_tie_gives_index_zero(spark):
    m, c = frames(spark, [(1, "a", "user", "2024-01-01 00:00:00"), (2, "a", "assistant", "2024-01-01 00:00:00"), (3, "a", "user", "2024-01-01 00:01:00")])
    out = rows(S.sessionize(m, c))
    assert [(r[0], r[3], r[4]) for r in out] == [(0, 0, 1), (1, 2, 0)]
    clean = rows(S.sessionize(m, c, tie_break="id"))
    assert [(r[0], r[3], r[4]) for r in clean] == [(1, 2, 1)]


def test_single_message_and_other_role(spark):
    m, c = frames(spark, [(1, "a", "user", "2024-01-01 00:00:00"), (5, "b", "tool", "2024-01-01 00:00:00"), (6, "b", "user", "2024-01-01 00:05:00")])
    out = {r.conversation_id: r for r in S.sessionize(m, c).collect()}
    assert out["a"].started_at == out["a"].ended_at and out["a"].session_index == 1
    b = out["b"]
    assert (b.user_turns, b.bot_turns, b.system_turns) == (1, 0, 0) and b.started_at == T("2024-01-01 00:00:00")


def test_non_chat_conversation_dropped(spark):
    m, c = frames(spark, [(1, "a", "user", "2024-01-01 00:00:00")], [("a", "u", None, "human")])
    assert S.sessionize(m, c).count() == 0


def random_messages(seed, n=600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        conv = f"c{rnd.randint(0, 4)}"
        sec = rnd.choice([rnd.randint(0, 3 * 86400), rnd.randint(0, 4000)])
        us = rnd.choice([0, 0, rnd.randint(0, 999999)])
        t = f"2024-01-0{1 + sec // 86400} {(sec % 86400) // 3600:02d}:{(sec % 3600) // 60:02d}:{sec % 60:02d}.{us:06d}"
        out.append((i, conv, rnd.choice(["user", "assistant", "system", "tool"]), t))
    return out


def test_sliced_equals_whole_conversation_windows(spark):
    for seed in range(2):
        m, c = frames(spark, random_messages(seed))
        for gap in (1, 20, 600):
            whole = sorted(map(tuple, S.sessionize(m, c, gap_minutes=gap, slice_seconds=None).collect()))
            for sl in (60, 3600):
                assert sorted(map(tuple, S.sessionize(m, c, gap_minutes=gap, slice_seconds=sl).collect())) == whole


def test_refresh_job_incremental_equals_full(spark, tmp_path):
    base = [(1, "a", "user", "2024-01-01 00:00:00"), (2, "a", "user", "2024-01-01 00:10:00"), (3, "b", "user", "2024-01-01 00:30:00")]
    m, c = frames(spark, base)
    table = sessions_table(spark, str(tmp_path / "sessions"))
    assert refresh_sessions(table, m, c) == 2
    assert refresh_sessions(table, m, c) == 1  # lookback re-processes the newest conversation only
    later = base + [(4, "a", "user", "2024-01-01 00:35:00"), (5, "b", "assistant", "2024-01-01 02:00:00")]
    m2, c2 = frames(spark, later)
    assert refresh_sessions(table, m2, c2) > 0
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, S.sessionize(m2, c2).collect()))
    assert table.versions() == [1, 2, 3]


def test_too_late_message_is_not_picked_up(spark, tmp_path):
    base = [(1, "a", "user", "2024-01-01 00:00:00"), (2, "b", "user", "2024-01-01 10:00:00")]
    m, c = frames(spark, base)
    table = sessions_table(spark, str(tmp_path / "s"))
    refresh_sessions(table, m, c)
    m2, c2 = frames(spark, base + [(3, "a", "user", "2024-01-01 09:00:00")])
    assert refresh_sessions(table, m2, c2, lookback_minutes=5) == 1  # only b, inside the lookback
    a = table.read().where(F.col("conversation_id") == "a").collect()
    assert len(a) == 1 and a[0].user_turns == 1


def test_changed_conversations_strict_cutoff(spark):
    m, c = frames(spark, [(1, "a", "user", "2024-01-01 00:00:00"), (2, "b", "user", "2024-01-01 00:05:00")])
    wm = spark.createDataFrame([(T("2024-01-01 00:05:00"),)], "watermark timestamp")
    assert sorted(r[0] for r in S.changed_conversations(m, wm, 5).collect()) == ["b"]


def test_sliced_equals_whole_with_many_ties(spark):
    rnd = random.Random(11)
    instants = [f"2024-01-01 {h:02d}:{m:02d}:00" for h in range(3) for m in (0, 10, 19, 20, 40, 59)]
    msgs = [(i, f"c{rnd.randint(0, 2)}", rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(instants)) for i in range(300)]
    m, c = frames(spark, msgs)
    for tie in ("role", "id"):
        for gap in (10, 20, 45):
            whole = sorted(map(tuple, S.sessionize(m, c, gap_minutes=gap, slice_seconds=None, tie_break=tie).collect()))
            for sl in (300, 3600):
                got = sorted(map(tuple, S.sessionize(m, c, gap_minutes=gap, slice_seconds=sl, tie_break=tie).collect()))
                assert got == whole, (tie, gap, sl)


def test_refresh_without_broadcast_matches(spark, tmp_path):
    base = [(1, "a", "user", "2024-01-01 00:00:00"), (2, "b", "user", "2024-01-01 00:30:00")]
    later = base + [(3, "a", "user", "2024-01-01 00:35:00"), (4, "b", "system", "2024-01-01 00:40:00")]
    m, c = frames(spark, base)
    m2, c2 = frames(spark, later)
    table = sessions_table(spark, str(tmp_path / "nb"))
    refresh_sessions(table, m, c, broadcast_scope_max=0)
    refresh_sessions(table, m2, c2, broadcast_scope_max=0)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, S.sessionize(m2, c2).collect()))
