"""Whole-table properties on the sf0.01 test tables."""

from pyspark.sql import functions as F

from retentia.plans import catalog
from retentia.sources import testviews as tv

SF = "/root/testdata/sf0.01"


def test_session_turns_add_up_to_messages(spark):
    for gap in (20, 24 * 60):
        s = catalog._sessions(spark, SF, gap)
        got = s.agg(F.sum("user_turns"), F.sum("bot_turns"), F.sum("system_turns"), F.count(F.lit(1))).first()
        chats = tv.conversations(spark, SF).where("conversation_type = 'ai_chat'").select(F.col("id").alias("conversation_id"))
        m = tv.messages(spark, SF).join(chats, "conversation_id", "left_semi")
        want = m.agg(*[F.count_if(F.col("role") == r) for r in ("user", "assistant", "system")]).first()
        assert tuple(got)[:3] == tuple(want)
        # sessions of one conversation never overlap and are numbered without gaps
        assert got[3] == s.select("conversation_id", "session_index").distinct().count()


def test_active_user_windows_nest(spark):
    r = catalog.q_active_users(spark, SF).first()
    assert 0 < r.dau <= r.wau <= r.mau


def test_funnel_users_never_increase(spark):
    users = [r.users for r in catalog.q_funnel_steps(spark, SF).orderBy("step_no").collect()]
    assert users == sorted(users, reverse=True) and users[0] > 0


def test_first_week_is_the_whole_cohort(spark):
    for name in ("cohort_retention", "event_retention"):
        w0 = catalog.QUERIES[name](spark, SF).where("week_offset = 0").collect()
        assert w0 and all(r.active_users == r.cohort_size for r in w0)


def test_marts_cards_equal_registered_queries(spark, tmp_path):
    from retentia.plans import marts

    out = str(tmp_path / "m")
    marts.run_event_marts(
        spark, tv.raw_events(spark, SF), out, as_of=catalog.AS_OF, steps=catalog.FUNNEL,
        start_action=catalog.START_ACTION, message_action=catalog.MESSAGE_ACTION,
    )
    for card in ("dau_trend", "top_events", "message_depth", "wow", "event_retention"):
        got = sorted(map(tuple, spark.read.parquet(f"{out}/{card}").collect()))
        want = sorted(map(tuple, catalog.QUERIES[card](spark, SF).collect()))
        assert got == want, card


def test_cards_ignore_replayed_copies(spark):
    from retentia.operators import cohorts, events
    from retentia.sources import raw_events as rawv

    raw = tv.raw_events(spark, SF)
    twice = raw.unionByName(raw)  # every event delivered twice
    clean = rawv.event_view(raw, catalog.AS_OF)
    copies = rawv.event_view(twice, catalog.AS_OF)
    for card in (
        lambda ev: events.active_users(ev, catalog.AS_OF),
        lambda ev: events.dau_trend(ev, catalog.AS_OF),
        events.returning_user_rate,
        lambda ev: cohorts.event_retention(ev, catalog.AS_OF),
    ):
        assert sorted(map(tuple, card(copies).collect())) == sorted(map(tuple, card(clean).collect()))


def test_one_rule_resolves_differing_copies(spark):
    from pyspark.sql import functions as F

    from retentia.sources import raw_events as rawv

    raw = tv.raw_events(spark, SF)
    stored = raw.withColumn("ingest_run", F.lit("1")).withColumn("ingest_batch", F.lit(0).cast("long"))
    twin = stored.withColumn("platform", F.lit("zz"))  # same batch: the larger row wins, in either order
    newer = stored.withColumn("ingest_batch", F.lit(1).cast("long")).withColumn("platform", F.lit("aa"))
    for parts in ((stored, twin), (twin, stored)):
        both = parts[0].unionByName(parts[1])
        assert {r.platform for r in rawv.dedup(both).select("platform").distinct().collect()} == {"zz"}
        assert {r.platform for r in rawv.event_view(both, catalog.AS_OF).select("platform").distinct().collect()} == {"zz"}
    last = rawv.event_view(newer.unionByName(twin), catalog.AS_OF)
    assert {r.platform for r in last.select("platform").distinct().collect()} == {"aa"}
