import datetime as dt

import pytest
from conftest import T
from pyspark.sql import functions as F

from retentia.model import RAW_EVENTS_SCHEMA
from retentia.sources import raw_events as rawv
from retentia.sources.event_store import EventStore
from retentia.streaming.catalog import run_compaction

SF = "/root/testdata/sf0.001"


def batch(spark, store, run, number, rows):
    """A finished ingest batch of (event id, time, user)."""
    data = [(i, "e", t, t, "a", "web", "", "", f'{{"user_id":"{u}"}}', int(t.strftime("%Y%m"))) for i, t, u in rows]
    df = spark.createDataFrame(data, rawv.T.StructType([*RAW_EVENTS_SCHEMA.fields, rawv.T.StructField("yyyymm", rawv.T.IntegerType())]))
    df.coalesce(1).write.partitionBy("yyyymm").parquet(f"{store}/ingest_run={run}/ingest_batch={number}")


def users(df):
    return {r.event_id: r.u for r in rawv.event_view(df, as_of="2024-02-01").collect()}


def test_compaction_keeps_the_view(spark, tmp_path):
    at = f"{tmp_path}/in"
    store = EventStore(spark, at, f"{tmp_path}/days")
    assert store.compact() is None and store.read().count() == 0
    day = [T(f"2024-01-{d:02d} 10:00:00") for d in range(1, 29)]
    batch(spark, at, "0001", 0, [(f"e{i}", day[i % 20], "old") for i in range(40)])
    batch(spark, at, "0001", 1, [(f"e{i}", day[i % 20], "new") for i in range(5)])
    want = users(rawv.read_store(spark, at))
    assert want["e0"] == "new" and want["e9"] == "old" and len(want) == 40
    assert store.compact()["days"] == 20
    assert users(store.read()) == want and store.days.read().count() == 40
    before = store.days.manifest()["folders"]
    # a late event and copies: of the same key from an older batch number under a newer run, and from an older run
    batch(spark, at, "0002", 0, [("e7", day[7], "newest"), ("late", day[3], "x")])
    batch(spark, at, "0000", 9, [("e8", day[8], "oldest")])
    want = users(rawv.read_store(spark, at))
    assert want["e7"] == "newest" and want["e8"] == "old"
    assert users(store.read()) == want  # pending batches count at once
    assert store.compact()["days"] == 3 and users(store.read()) == want
    after = store.days.manifest()["folders"]
    assert {d for d in after if after[d] != before[d]} == {"2024-01-04", "2024-01-08", "2024-01-09"}
    assert all(len(f) == 1 for f in after.values())
    # batches go once every kept commit holds them
    store.vacuum(keep=2)
    assert len(store.batches()) == 2
    store.vacuum(keep=1)
    assert store.batches() == [] and users(store.read()) == want


def test_unfinished_batch_is_left_to_later(spark, tmp_path):
    at = f"{tmp_path}/in"
    store = EventStore(spark, at, f"{tmp_path}/days")
    batch(spark, at, "1", 0, [("a", T("2024-01-05 00:00:00"), "u")])
    batch(spark, at, "1", 1, [("b", T("2024-01-05 00:00:00"), "u")])
    (tmp_path / "in/ingest_run=1/ingest_batch=1/_SUCCESS").unlink()
    store.compact()
    assert set(users(store.read())) == {"a"}
    (tmp_path / "in/ingest_run=1/ingest_batch=1/_SUCCESS").touch()
    assert set(users(store.read())) == {"a", "b"}


def test_crash_while_compacting_changes_nothing(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/in"
    store = EventStore(spark, at, f"{tmp_path}/days")
    batch(spark, at, "1", 0, [("a", T("2024-01-05 00:00:00"), "u")])
    with monkeypatch.context() as m:
        m.setattr(type(store.days.log), "commit", lambda self, v, c: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.compact()
    assert set(users(store.read())) == {"a"} and store.compact()["merged"] == 1 and set(users(store.read())) == {"a"}


def test_expiry_by_days(spark, tmp_path):
    at = f"{tmp_path}/in"
    store = EventStore(spark, at, f"{tmp_path}/days")
    times = [T("2024-01-01 23:59:59"), T("2024-01-02 00:00:00"), T("2024-01-02 12:00:00"), T("2024-01-09 00:00:00")]
    batch(spark, at, "1", 0, [(f"e{i}", t, "u") for i, t in enumerate(times)])
    store.compact()
    as_of = T("2024-01-12 00:00:00")
    kept = lambda: {r.event_id for r in rawv.retained(store.read(as_of, 10), as_of, 10).collect()}
    want = {r.event_id for r in rawv.retained(rawv.read_store(spark, at), as_of, 10).collect()}
    assert kept() == want == {"e2", "e3"}
    assert store.expire(as_of, 10) == ["2024-01-01"] and kept() == want
    assert store.expire(as_of + dt.timedelta(days=1), 10) == ["2024-01-02"]
    assert store.days.read().count() == 1


def test_one_rule_for_rows_and_facts(spark):
    t = T("2024-01-05 00:00:00")
    for users_ in (("a", "z"), ("z", "a"), ("m", "b"), ("q", "r")):
        raw = spark.createDataFrame([("1", "e", t, t, "x", "web", "", "", f'{{"user_id":"{u}"}}') for u in users_], RAW_EVENTS_SCHEMA)
        stored = rawv.facts(rawv.dedup(raw)).first().u
        assert rawv.event_view(raw, as_of="2024-02-01").first().u == stored


def test_store_of_many_checkpoints_is_bounded(spark):
    store = run_compaction(spark, SF)
    store.compact()
    folders = store.days.manifest()["folders"]
    assert 0 < len(folders) <= 31 and all(len(f) == 1 for f in folders.values())
    assert store.days.read().count() == store.days.read().select("event_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert store.days.read().agg(F.countDistinct("ingest_run")).first()[0] > 1


def test_dedup_moves_a_row_once_and_keeps_its_rule(spark):
    t = T("2024-01-05 10:00:00")
    rows = [("k", "e", t, t, "a", p, "", "", f'{{"n":{n}}}', run, b) for n, (p, run, b) in enumerate(
        [("web", "1", 2), ("app", "1", 10), ("web", "1", 10), (None, "1", 10), ("zzz", "0", 99), ("zzz", None, 99)])]
    rows += [(None, "e", t, None, None, None, None, None, "x", None, None)] * 2
    fields = [*RAW_EVENTS_SCHEMA.fields, rawv.T.StructField("ingest_run", rawv.T.StringType()), rawv.T.StructField("ingest_batch", rawv.T.LongType())]
    schema = rawv.T.StructType([rawv.T.StructField(f.name, f.dataType) for f in fields])
    raw = spark.createDataFrame(rows, schema)
    for origin in (False, True):
        out = rawv.dedup(raw, origin=origin)
        assert "max_by" not in out._jdf.queryExecution().optimizedPlan().toString()  # it would hold each row twice
        got = {r.event_id: r for r in out.collect()}
        assert len(got) == 2 and got["k"].event == '{"n":2}' and got["k"].platform == "web" and got[None].event == "x"
        assert ("ingest_batch" in out.columns) == origin and "_rank" not in out.columns
