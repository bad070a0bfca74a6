import itertools
import random

from conftest import T
from retentia.operators import funnel

STEPS = ["s1", "s2", "s3", "s4"]


def ev_df(spark, rows):
    return spark.createDataFrame([(u, T(t), a) for u, t, a in rows], "u string, ts timestamp, se_action string")


def levels(spark, rows, window_seconds, bucket_seconds=3600, as_of="2024-01-08 00:00:00"):
    df = funnel.funnel_levels(ev_df(spark, rows), STEPS, as_of, 7, bucket_seconds, window_seconds)
    return {r.u: r.level for r in df.collect()}


def test_same_second_in_step_order(spark):
    rows = [("a", "2024-01-05 00:00:00.100", "s2"), ("a", "2024-01-05 00:00:00.900", "s1")]
    assert levels(spark, rows, 100) == {"a": 2}


def test_restart_keeps_the_older_chain(spark):
    rows = [("a", "2024-01-05 00:00:00", "s1"), ("a", "2024-01-05 00:00:05", "s2"), ("a", "2024-01-05 00:00:08", "s1"), ("a", "2024-01-05 00:00:09", "s3")]
    for b in (None, 3600, 4):
        assert levels(spark, rows, 10, b) == {"a": 3}


def test_window_edge_and_missing_first_step(spark):
    rows = [
        ("a", "2024-01-05 00:00:00", "s1"), ("a", "2024-01-05 00:00:10", "s2"),
        ("b", "2024-01-05 00:00:00", "s1"), ("b", "2024-01-05 00:00:11", "s2"),
        ("c", "2024-01-05 00:00:00", "s2"),
    ]
    assert levels(spark, rows, 10) == {"a": 2, "b": 1, "c": 0}
    steps = funnel.funnel_steps(funnel.funnel_levels(ev_df(spark, rows), STEPS, "2024-01-08", 7, 3600, 10), STEPS)
    got = [(r.step, r.users, r.conversion, r.dropoff) for r in steps.orderBy("step_no").collect()]
    assert got == [("s1", 2, 1.0, None), ("s2", 1, 0.5, 0.5), ("s3", 0, 0.0, 1.0), ("s4", 0, 0.0, None)]


def brute(events, window, nsteps=4):
    by = {}
    for u, sec, k in events:
        by.setdefault(u, []).append((sec, k))
    out = {}
    for u, evs in by.items():
        best = 0
        for n in range(1, nsteps + 1):
            cands = [sorted(s for s, k in evs if k == j) for j in range(1, n + 1)]
            if any(not c for c in cands):
                break
            ok = any(
                all(ch[i] <= ch[i + 1] for i in range(n - 1)) and ch[-1] - ch[0] <= window
                for ch in itertools.product(*cands)
            )
            if ok:
                best = n
            else:
                break
        out[u] = best
    return out


def test_bucketed_matches_brute_force(spark):
    rnd = random.Random(7)
    rows, evs = [], []
    for _ in range(500):
        u = f"u{rnd.randint(0, 24)}"
        sec = rnd.randint(0, 200)
        k = rnd.randint(1, 4)
        rows.append((u, f"2024-01-05 00:{sec // 60:02d}:{sec % 60:02d}.{rnd.randint(0, 999):03d}", f"s{k}"))
        evs.append((u, sec, k))
    want = brute(evs, 30)
    for b in (None, 7, 60, 3600):
        assert levels(spark, rows, 30, b) == want


def test_fewer_steps_and_wide_window_match_brute_force(spark):
    rnd = random.Random(3)
    for nsteps, window in ((2, 5), (3, 90), (4, 100000)):
        steps = STEPS[:nsteps]
        rows, evs = [], []
        for _ in range(400):
            u = f"u{rnd.randint(0, 15)}"
            sec = rnd.randint(0, 7200)
            k = rnd.randint(1, 4)
            rows.append((u, f"2024-01-05 {sec // 3600:02d}:{sec % 3600 // 60:02d}:{sec % 60:02d}", f"s{k}"))
            if k <= nsteps:
                evs.append((u, sec, k))
        want = brute(evs, window, nsteps)
        for b in (None, 60, 1800):
            got = funnel.funnel_levels(ev_df(spark, rows), steps, "2024-01-08", 7, b, window)
            assert {r.u: r.level for r in got.collect()} == want, (nsteps, window, b)


def test_anonymous_user_can_be_left_out(spark):
    rows = [("", "2024-01-05 00:00:00", "s1"), ("", "2024-01-05 00:00:01", "s2"), ("a", "2024-01-05 00:00:00", "s1")]
    ev = ev_df(spark, rows)
    both = {r.u: r.level for r in funnel.funnel_levels(ev, STEPS, "2024-01-08", 7).collect()}
    named = {r.u: r.level for r in funnel.funnel_levels(ev, STEPS, "2024-01-08", 7, include_anonymous=False).collect()}
    assert both == {"": 2, "a": 1} and named == {"a": 1}
