from pyspark.sql import functions as F

from retentia.model import SESSIONS_SCHEMA
from retentia.plans import catalog, marts
from retentia.sources import raw_events as rawv
from retentia.sources import testviews as tv
from retentia.sources.snapshots import SnapshotTable
from retentia.streaming.catalog import run_ingest

SF = "/root/testdata/sf0.001"


def test_event_marts_job_writes_every_card(spark, tmp_path):
    out = str(tmp_path / "marts")
    st = marts.run_event_marts(
        spark, tv.raw_events(spark, SF), out, as_of=catalog.AS_OF, steps=catalog.FUNNEL,
        start_action=catalog.START_ACTION, message_action=catalog.MESSAGE_ACTION,
    )
    rows = {r.card: r for r in st.collect()}
    assert all(r.ok for r in rows.values()), [r.error for r in rows.values() if not r.ok]
    assert rows["active_users"].rows == 1 and rows["funnel"].rows == 4
    got = marts.Board(spark, out).read("active_users").first()
    want = catalog.q_active_users(spark, SF).first()
    assert tuple(got) == tuple(want)


def test_failing_card_is_isolated(spark, tmp_path):
    ev = spark.createDataFrame([], "u string, ts timestamp")
    cards = {"good": lambda: ev.groupBy().count(), "bad": lambda: ev.select("no_such_column")}
    st = {r.card: r for r in marts.run_cards(spark, cards, str(tmp_path / "m")).collect()}
    assert st["good"].ok and not st["bad"].ok and "no_such_column" in st["bad"].error
    assert marts.Board(spark, str(tmp_path / "m")).read("good").count() == 1


def test_failed_card_keeps_its_last_good_version(spark, tmp_path):
    import pytest

    out, n = str(tmp_path / "m"), spark.range(5)
    cards = {"a": lambda: n, "b": lambda: n.where("id > 2"), "sum": marts.Derived(lambda read: read("b").agg(F.sum("id").alias("s")))}
    marts.run_cards(spark, cards, out)
    first = marts.Board(spark, out)
    broken = {"a": lambda: n.limit(1), "b": lambda: n.select(F.raise_error(F.lit("boom")).alias("id")), "sum": cards["sum"]}
    st = {r.card: r for r in marts.run_cards(spark, broken, out).collect()}
    now = marts.Board(spark, out)
    assert not st["b"].ok and "boom" in st["b"].error and st["a"].ok and st["sum"].ok
    assert now.read("a").count() == 1 and now.read("b").count() == 2 and now.read("sum").first().s == 7
    assert st["b"].served_run != st["a"].served_run and {r.card: r.ok for r in now.status().collect()} == {"a": True, "b": False, "sum": True}
    assert first.read("a").count() == 5  # a reader of the older commit still sees that run
    # a run that dies before its commit changes nothing for readers
    with pytest.MonkeyPatch.context() as m:
        m.setattr(marts.CommitLog, "commit", lambda self, v, c: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            marts.run_cards(spark, {"a": lambda: n.limit(3)}, out)
    assert marts.Board(spark, out).read("a").count() == 1
    assert marts.Board(spark, out).vacuum(keep=1) == 2 and marts.Board(spark, out).read("b").count() == 2
    # a card that fails on its first run is empty when it can be planned, absent when not
    st = marts.run_cards(spark, {"x": broken["b"], "y": lambda: n.select("no")}, str(tmp_path / "new")).collect()
    assert [r.ok for r in st] == [False, False] and marts.Board(spark, str(tmp_path / "new")).read("x").count() == 0
    assert "y" not in marts.Board(spark, str(tmp_path / "new")).manifest["cards"]


def test_snapshot_versions_and_vacuum(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "s"), SESSIONS_SCHEMA)
    assert t.read().count() == 0 and t.latest_version() is None
    one = catalog.q_sessionize_24h(spark, SF)
    for _ in range(4):
        t.publish(one)
    assert t.versions() == [1, 2, 3, 4]
    assert t.vacuum(keep=2) == [1, 2] and t.versions() == [3, 4]
    assert t.read().count() == one.count()


def test_month_expiry(spark):
    paths = run_ingest(spark, SF)
    store = paths["raw_events"]
    before = rawv.read_store(spark, store).count()
    assert rawv.expire_months(spark, store, "2024-04-30 00:00:00") == []  # January + 90 days not over yet
    removed = rawv.expire_months(spark, store, "2024-05-01 00:00:00")
    assert removed and all("yyyymm=202401" in p for p in removed)
    assert before > 0 and rawv.read_store(spark, store).where(F.col("yyyymm") == 202401).count() == 0


def test_session_marts_job(spark, tmp_path):
    sessions = catalog.q_sessionize_24h(spark, SF)
    st = marts.run_session_marts(spark, sessions, str(tmp_path / "sm"), as_of=catalog.AS_OF, today=catalog.TODAY_AS_OF, min_turns=2)
    assert all(r.ok for r in st.collect())
    grid = marts.Board(spark, str(tmp_path / "sm")).read("cohort_grid")
    assert grid.count() == catalog.q_cohort_grid(spark, SF).count()


def test_ensure_then_first_refresh_is_a_full_build(spark, tmp_path):
    from retentia.plans.refresh import refresh_sessions, sessions_table

    t = sessions_table(spark, str(tmp_path / "e"))
    assert t.ensure() == 1 and t.ensure() == 1 and t.read().count() == 0
    n = refresh_sessions(t, tv.messages(spark, SF), tv.conversations(spark, SF), gap_minutes=24 * 60)
    assert n == catalog.q_sessionize_24h(spark, SF).count() and t.versions() == [1, 2]


def test_cli_jobs(spark, tmp_path):
    from retentia.plans import cli

    msgs, convs = str(tmp_path / "messages"), str(tmp_path / "conversations")
    tv.messages(spark, SF).write.parquet(msgs)
    tv.conversations(spark, SF).write.parquet(convs)
    sess = str(tmp_path / "sessions")
    out = cli.run(["refresh", "--messages", msgs, "--conversations", convs, "--sessions", sess, "--gap-minutes", "1440"], spark)
    assert out["rows"] == catalog.q_sessionize_24h(spark, SF).count() and out["version"] == 1
    again = cli.run(["refresh", "--messages", msgs, "--conversations", convs, "--sessions", sess, "--gap-minutes", "1440"], spark)
    assert again["version"] == 2
    sm = cli.run(["session-marts", "--sessions", sess, "--out", str(tmp_path / "sm"), "--as-of", catalog.AS_OF, "--min-turns", "2"], spark)
    assert sm["failed"] == []
    store = run_ingest(spark, SF)["raw_events"]
    em = cli.run(["event-marts", "--store", store, "--out", str(tmp_path / "em"), "--as-of", catalog.AS_OF], spark)
    assert em["failed"] == []
    assert cli.run(["expire", "--store", store, "--as-of", "2024-02-01 00:00:00"], spark)["removed"] == 0


def test_recent_logins_and_missing_tables(spark, tmp_path):
    import datetime as dt

    from retentia.model import LOGIN_AUDIT_SCHEMA, MESSAGES_SCHEMA
    from retentia.sources import tables

    rows = [
        (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i % 50), f"u{i}@x.org", "x.org", i % 3 != 0, None, "ua")
        for i in range(300)
    ]
    audit = spark.createDataFrame(rows, LOGIN_AUDIT_SCHEMA)
    got = marts.recent_logins(audit, k=100).collect()
    assert len(got) == 100 and "id" not in marts.recent_logins(audit).columns
    assert [r.attempted_at for r in got] == sorted((r.attempted_at for r in got), reverse=True)
    assert got[0].attempted_at == dt.datetime(2024, 1, 1, 0, 49)
    missing = str(tmp_path / "nothing-here")
    assert tables.messages(spark, missing).schema == MESSAGES_SCHEMA and tables.messages(spark, missing).count() == 0
    assert rawv.read_store(spark, missing).count() == 0


def test_losing_publisher_leaves_the_table_alone(spark, tmp_path):
    import pytest
    from conftest import T

    one = spark.createDataFrame([("c", 1, "u", "i", T("2024-01-01 00:00:00"), T("2024-01-01 00:00:00"), 1, 0, 0)], SESSIONS_SCHEMA)
    base = str(tmp_path / "t")
    a, b = SnapshotTable(spark, base, SESSIONS_SCHEMA), SnapshotTable(spark, base, SESSIONS_SCHEMA)
    a.publish(one)
    seen = a.latest_version()
    b.latest_version = lambda: seen - 1 or None  # b took its version before a's commit
    with pytest.raises(RuntimeError):
        b.publish(one.limit(0))
    assert a.read().count() == 1 and a.versions() == [1]
    assert len(list((tmp_path / "t").glob("v=*"))) == 1
    a.publish(one.union(one))
    assert a.read().count() == 2 and a.vacuum(keep=1) == [1] and a.read().count() == 2


def test_cli_stream_refresh_and_compaction(spark, tmp_path):
    from retentia.plans import cli

    msgs, convs, table, k = (str(tmp_path / n) for n in ("messages", "conversations", "table", "k"))
    tv.messages(spark, SF).write.parquet(msgs)
    tv.conversations(spark, SF).write.parquet(convs)
    job = ["refresh-stream", "--messages", msgs, "--conversations", convs, "--table", table, "--checkpoint", k, "--gap-minutes", "1440", "--buckets", "8"]
    out = cli.run(job, spark)
    assert out["rows"] == catalog.q_sessionize_24h(spark, SF).count() and out["version"] == 1
    assert cli.run(job, spark) == {"job": "refresh-stream", "rows": 0, "version": 1}
    sm = cli.run(["session-marts", "--table", table, "--out", str(tmp_path / "sm"), "--as-of", catalog.AS_OF, "--min-turns", "2"], spark)
    assert sm["failed"] == []
    store, days = run_ingest(spark, SF)["raw_events"], str(tmp_path / "days")
    job = ["compact", "--store", store, "--days", days, "--as-of", catalog.AS_OF]
    assert cli.run(job, spark) == {"job": "compact", "merged": 1, "expired": 0}
    assert cli.run(job, spark) == {"job": "compact", "merged": 0, "expired": 0}
    em = cli.run(["event-marts", "--store", store, "--days", days, "--out", str(tmp_path / "em"), "--as-of", catalog.AS_OF], spark)
    assert em["failed"] == []
    assert tuple(marts.Board(spark, str(tmp_path / "em")).read("active_users").first()) == tuple(catalog.q_active_users(spark, SF).first())
    job = ["daily-cards", "--store", store, "--days", days, "--state", str(tmp_path / "st"), "--out", str(tmp_path / "dc"), "--as-of", catalog.AS_OF]
    first = cli.run(job, spark)
    assert first["days"] > 0 and first["failed"] == [] and cli.run(job, spark)["days"] == 0
    args = cli._parser().parse_args("ingest --bootstrap b --topic t --fields f --store s --dead-letter d --metrics m --checkpoint c --starting-offsets earliest --allow-data-loss".split())
    assert args.starting_offsets == "earliest" and args.allow_data_loss and args.max_per_trigger == cli.MAX_PER_TRIGGER


def test_whole_second_now(spark):
    """A sub-second instant counts as its second: an event exactly a day before that second is inside the day."""
    import datetime as dt

    from retentia.operators import events

    at = dt.datetime(2024, 1, 31, 12, 0, 0)
    ev = spark.createDataFrame([("a", at - dt.timedelta(days=1)), ("b", at - dt.timedelta(minutes=15)), ("c", at - dt.timedelta(days=7))], "u string, ts timestamp")
    now = at + dt.timedelta(microseconds=700_000)
    assert events.active_users(ev, now).first()[:3] == events.active_users(ev, at).first()[:3] == (2, 3, 3)
    assert events.recent_activity(ev, now).first() == events.recent_activity(ev, at).first()
    assert events.recent_activity(ev, now).first().events_15m == 1
    assert events.wow(ev, now).first().users_this == 3
