import json


from conftest import T
from retentia.model import RAW_EVENTS_SCHEMA, SESSIONS_SCHEMA
from retentia.operators import cohorts, events, headline
from retentia.sources import raw_events as rawv

CTX = "contexts_com_snowplowanalytics_mobile_client_session_1"


def sessions_df(spark, rows):
    """rows: (user, started_at, user_turns[, session_index])"""
    data = []
    for i, r in enumerate(rows):
        idx = r[3] if len(r) > 3 else 1
        data.append((f"c{i}", idx, r[0], None, T(r[1]), T(r[1]), r[2], 0, 0))
    return spark.createDataFrame(data, SESSIONS_SCHEMA)


def raw_df(spark, rows):
    """rows: (event_id, ts, payload dict or raw string)"""
    data = [
        (str(i), "event", T(ts), None, "app", "p", "", "", p if isinstance(p, str) else json.dumps(p)) for i, ts, p in rows
    ]
    return spark.createDataFrame(data, RAW_EVENTS_SCHEMA)


def test_w1_return_boundaries(spark):
    as_of = "2024-01-31 00:00:00"
    s = sessions_df(
        spark,
        [
            ("a", "2024-01-15 00:00:00", 4), ("a", "2024-01-22 00:00:00", 4),            # exactly +7 d: counted
            ("b", "2024-01-15 00:00:00", 4), ("b", "2024-01-22 00:00:00.000001", 4),     # +7 d 1 µs: not
            ("c", "2024-01-15 00:00:00", 4), ("c", "2024-01-16 00:00:00", 1),            # not engaged: not
        ],
    )
    r = headline.w1_return_rate(s, as_of).first()
    assert (r.returned, r.n) == (1, 3) and abs(r.rate - 1 / 3) < 1e-12 and r.trusted is False


def test_zero_denominators(spark):
    s = sessions_df(spark, [])
    assert tuple(headline.w1_return_rate(s, "2024-01-31").first()) == (None, 0, 0, False)
    assert tuple(headline.second_message_rate(s, "2024-01-31").first()) == (None, 0, 0, False)
    assert headline.engaged_sessions_today(s, "2024-01-31").first()["count"] == 0
    ev = rawv.event_view(raw_df(spark, []), as_of="2024-01-31")
    assert tuple(events.active_users(ev, "2024-01-31").first()) == (0, 0, 0, None)
    assert tuple(events.data_span_days(ev, "2024-01-31").first()) == (0.0, True)


def test_identity_and_json_rules(spark):
    raw = raw_df(
        spark,
        [
            (1, "2024-01-30 00:00:00", {"se_action": "x"}),                                   # anonymous
            (2, "2024-01-30 00:00:01", {"user_id": "", "se_action": "x"}),                    # blank -> ''
            (3, "2024-01-30 00:00:02", {"user_id": 5, "se_action": "x"}),                     # numeric -> ''
            (4, "2024-01-30 00:00:03", "not json"),                                           # bad JSON -> ''
            (5, "2024-01-30 00:00:04", {CTX: [{"userId": "k"}], "se_action": "x"}),           # context
            (6, "2024-01-30 00:00:05", {"user_id": "j", CTX: [{"userId": "k"}]}),             # top level wins
            (7, "2024-01-30 00:00:06", {"se_property": json.dumps({"influencer_id": "i9"})}),  # nested blob
        ],
    )
    got = {r.event_id: r for r in rawv.event_view(raw, as_of="2024-01-31").collect()}
    assert [got[str(i)].u for i in range(1, 8)] == ["", "", "", "", "k", "j", ""]
    assert got["7"].influencer == "i9" and got["4"].se_action == ""
    fast = {r.event_id: r.u for r in rawv.facts(raw, strict_json=False).collect()}
    assert fast["3"] == "5"  # documented difference of the fast path


def test_hour_boundary_span(spark):
    raw = raw_df(spark, [(1, "2024-01-01 00:59:00", {})])
    r = events.data_span_days(rawv.event_view(raw, as_of="2024-01-01 01:01:00"), "2024-01-01 01:01:00").first()
    assert r.span_days == 1 / 24 and r.filling_in


def test_depth_buckets(spark):
    rows, i = [], 0
    for user, n in [("a", 1), ("b", 5), ("c", 6), ("d", 20), ("e", 21)]:
        for _ in range(n):
            i += 1
            rows.append((i, "2024-01-20 00:00:00", {"user_id": user, "se_action": "user_message_sent"}))
    ev = rawv.event_view(raw_df(spark, rows), as_of="2024-01-31")
    assert [tuple(r) for r in events.message_depth(ev).collect()] == [("1", 1), ("2-5", 1), ("6-20", 2), ("21+", 1)]


def test_half_even_percent_and_grid(spark):
    # 8 engaged users in one cohort week, 1 of them active the week after: 12.5 % -> 12
    rows = [(f"u{i}", "2024-01-08 10:00:00", 4) for i in range(8)] + [("u0", "2024-01-16 10:00:00", 1)]
    long = cohorts.cohort_retention(sessions_df(spark, rows), as_of="2024-01-31", min_turns=4)
    g = cohorts.session_grid(long, as_of="2024-01-31").first()
    assert (g.w0, g.n0, g.w1, g.n1, g.w2, g.n2, g.w3) == (100, 8, 12, 1, 0, 0, 0)
    assert g.w4 is None  # cohort is 3 weeks old: later columns are future


def test_dedup_and_ttl(spark):
    base = [(1, "2024-01-01 00:00:00", {"user_id": "a"}), (1, "2024-01-01 00:00:00", {"user_id": "a"}), (1, "2024-01-01 00:00:01", {"user_id": "a"})]
    assert rawv.dedup(raw_df(spark, base)).count() == 2
    raw = raw_df(spark, [(1, "2024-01-01 00:00:00.500", {}), (2, "2024-01-01 00:00:01", {})])
    kept = [r.event_id for r in rawv.retained(raw, as_of="2024-03-31 00:00:00").collect()]  # exactly 90 days after 1
    assert kept == ["2"]
