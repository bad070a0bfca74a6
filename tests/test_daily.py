import random

import pytest
from conftest import T
from test_event_store import batch

from retentia.model import MESSAGE_ACTION
from retentia.operators import cohorts, events
from retentia.plans.daily import DailyUsers
from retentia.sources import raw_events as rawv
from retentia.sources.event_store import EventStore


def make(spark, tmp_path):
    store = EventStore(spark, f"{tmp_path}/in", f"{tmp_path}/days")
    return store, DailyUsers(spark, f"{tmp_path}/state", store)


def some(seed, n, first=1, last=28):
    rng = random.Random(seed)
    act = lambda: f'u{rng.randrange(40)}","se_action":"{rng.choice([MESSAGE_ACTION, "other"])}'
    return [(f"{seed}-{i}", T(f"2024-01-{rng.randrange(first, last + 1):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"), act()) for i in range(n)]


def test_only_changed_days_are_rebuilt(spark, tmp_path):
    store, state = make(spark, tmp_path)
    assert state.update() == []
    batch(spark, f"{tmp_path}/in", "1", 0, some(1, 300, 1, 20))
    store.compact()
    assert len(state.update()) == 20 and state.update() == []
    before = state.table.manifest()["folders"]
    batch(spark, f"{tmp_path}/in", "1", 1, some(2, 30, 21, 22) + [("late", T("2024-01-03 12:00:00"), "late")])
    store.compact()
    assert state.update() == ["2024-01-03", "2024-01-21", "2024-01-22"]
    after = state.table.manifest()["folders"]
    assert {d for d in after if after[d] != before.get(d)} == {"2024-01-03", "2024-01-21", "2024-01-22"}
    store.expire("2024-01-31", ttl_days=25)
    assert state.update() == [] and "2024-01-05" not in state.table.manifest()["folders"]


@pytest.mark.parametrize("as_of, ttl", [("2024-01-29 00:00:00", 90), ("2024-01-25 13:37:11", 90), ("2024-01-25 13:37:11.9", 20), ("2024-01-16 00:00:01", 9)])
def test_cards_equal_those_of_the_events(spark, tmp_path, as_of, ttl):
    store, state = make(spark, tmp_path)
    rows = some(3, 1500)
    cut = T("2024-01-18 13:37:11")  # on the edge of a window, and a second before
    rows += [("edge", cut, "u1"), ("before", T("2024-01-18 13:37:10"), "edge-user"), ("edge2", T("2024-01-05 13:37:12"), "x"), ("edge3", T("2024-01-05 13:37:11"), "y")]
    batch(spark, f"{tmp_path}/in", "1", 0, rows)
    store.compact()
    state.update()
    ev = rawv.event_view(store.read(), as_of=as_of, ttl_days=ttl)
    want = {
        "active_users": events.active_users(ev, as_of), "dau_trend": events.dau_trend(ev, as_of), "event_volume": events.event_volume(ev, as_of),
        "returning_user_rate": events.returning_user_rate(ev), "message_depth": events.message_depth(ev), "wow": events.wow(ev, as_of),
        "event_retention": cohorts.event_retention(ev, as_of),
    }
    cards = state.cards(as_of, ttl)
    assert cards.keys() == want.keys()
    for name, df in want.items():
        assert cards[name]().collect() == df.collect(), name
