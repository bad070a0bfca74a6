import datetime as dt
import random
from collections import defaultdict

import pytest
from conftest import T

from retentia.operators import cohorts

MON = dt.date(2024, 1, 1)


def monday(d):
    return d - dt.timedelta(days=d.weekday())


def brute(rows, floor, engaged):
    """rows: (user, day, counts for the first time)."""
    first, weeks = {}, defaultdict(set)
    for user, day, counts in rows:
        weeks[user].add(monday(day))
        if counts or not engaged:
            first[user] = min(first.get(user, day), day)
    members = defaultdict(set)
    for user, day in first.items():
        if monday(day) >= floor:
            members[monday(day)].add(user)
    return sorted(
        (c, len(us), k, n) for c, us in members.items() for k in range(400)
        if (n := sum(c + dt.timedelta(weeks=k) in weeks[u] for u in us)))


def days(seed, span):
    rng = random.Random(seed)
    out = []
    for u in range(200):
        start = rng.randrange(-40, 90)
        out += [(f"u{u}", MON + dt.timedelta(days=start + d), rng.random() < 0.4) for d in rng.sample(range(span), rng.randrange(1, 9))]
    return out


@pytest.mark.parametrize("as_of, span", [("2024-03-27", 60), (dt.date(2024, 3, 30), 900), (T("2024-04-02 05:00:00.7"), 300)])
def test_many_cohorts_and_long_activity(spark, as_of, span):
    rows = days(span, span)
    at = dt.date.fromisoformat(str(as_of)[:10])
    ev = spark.createDataFrame([(u, dt.datetime.combine(d, dt.time(23, 59, 59))) for u, d, _ in rows], "u string, ts timestamp")
    got = sorted(map(tuple, cohorts.event_retention(ev, as_of).collect()))
    want = brute(rows, monday(at) - dt.timedelta(weeks=8), False)
    assert got == want and len({r[0] for r in want}) >= 8 and max(r[2] for r in want) >= (8 if span < 100 else 40)
    ss = spark.createDataFrame([(u, dt.datetime.combine(d, dt.time(0, 0)), 4 if e else 1) for u, d, e in rows], "user_id string, started_at timestamp, user_turns int")
    got = sorted(map(tuple, cohorts.cohort_retention(ss, as_of, min_turns=4).collect()))
    want = brute(rows, monday(at - dt.timedelta(weeks=12)), True)
    assert got == want and len({r[0] for r in want}) >= 8


def test_one_pass(spark):
    ev = spark.createDataFrame([("a", T("2024-01-09 00:00:00"))], "u string, ts timestamp")
    plan = cohorts.event_retention(ev, "2024-01-31")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan") == 1
    assert cohorts.event_retention(ev.limit(0), "2024-01-31").count() == 0
