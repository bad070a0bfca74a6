import pytest
from conftest import T
from pyspark.sql import functions as F

from retentia.model import MESSAGES_SCHEMA, SESSIONS_SCHEMA
from retentia.operators import sessions as S
from retentia.plans.bucketed import BucketedSessions
from retentia.sources import commits
from retentia.sources.keyed import KeyedTable
from retentia.sources.snapshots import SnapshotTable

CONVS = [(f"c{i}", f"u{i % 5}", "i", "ai_chat" if i % 9 else "human") for i in range(60)]


def messages(spark, lo, hi, day, convs=60):
    start = T(f"2024-01-{day:02d} 00:00:00").timestamp()
    df = spark.range(lo, hi).selectExpr(
        "id", f"concat('c', id % {convs}) AS conversation_id", "elt(id % 3 + 1, 'user', 'assistant', 'system') AS role",
        f"timestamp_seconds({int(start)} + id * 61) AS created_at")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGES_SCHEMA])


class Feed:
    def __init__(self, spark, base):
        self.spark, self.at = spark, f"{base}/in"
        self.convs = spark.createDataFrame(CONVS, "id string, user_id string, influencer_id string, conversation_type string")

    def bring(self, df):
        df.coalesce(2).write.mode("append").parquet(self.at)

    def source(self, files=None):
        r = self.spark.readStream.schema(MESSAGES_SCHEMA)
        return (r.option("maxFilesPerTrigger", files) if files else r).parquet(self.at)

    def every(self):
        return self.spark.read.schema(MESSAGES_SCHEMA).parquet(self.at)


def same(table, feed):
    want = S.sessionize(feed.every(), feed.convs, gap_minutes=20)
    a, b = (sorted(map(tuple, df.select(*SESSIONS_SCHEMA.fieldNames()).collect())) for df in (table.read(), want))
    assert a == b and a


def test_refresh_follows_the_change(spark, tmp_path):
    feed, table = Feed(spark, tmp_path), BucketedSessions(spark, f"{tmp_path}/t", buckets=32, gap_minutes=20)
    feed.bring(messages(spark, 0, 3000, 10))
    first = table.refresh(feed.source(files=1), feed.convs, f"{tmp_path}/k")
    assert len(first) == 2  # one commit a micro-batch
    same(table, feed)
    before = table.sessions.manifest()["folders"]

    old = messages(spark, 50_000, 50_004, 2, convs=3)  # days older than anything stored, three conversations
    feed.bring(old)
    (entry,) = table.refresh(feed.source(), feed.convs, f"{tmp_path}/k")
    same(table, feed)
    after = table.sessions.manifest()["folders"]
    assert entry["conversations"] == 3 and entry["touched"] <= 3
    changed = {k for k in after if after[k] != before.get(k)}
    assert 1 <= len(changed) <= entry["touched"] < len(before)  # all other buckets keep their folders (c0 is no chat)
    assert entry["rows"] == table.read().where(F.col("conversation_id").isin("c0", "c1", "c2")).count()

    version = table.sessions.latest_version()
    assert table.refresh(feed.source(), feed.convs, f"{tmp_path}/k") == [] and table.sessions.latest_version() == version
    assert table.sessions.vacuum(keep=1) > 0
    same(table, feed)


def test_batch_run_again_and_lost_checkpoint(spark, tmp_path):
    feed, table = Feed(spark, tmp_path), BucketedSessions(spark, f"{tmp_path}/t", buckets=4, gap_minutes=20)
    feed.bring(messages(spark, 0, 600, 10))
    # The job dies between the two commits: messages stored, sessions not.
    run, table.sessions.replace = table.sessions.replace, lambda *a, **k: 1 / 0
    with pytest.raises(Exception, match="ZeroDivisionError"):
        table.refresh(feed.source(), feed.convs, f"{tmp_path}/k")
    table.sessions.replace = run
    assert table.messages.read().count() == 600 and table.read().count() == 0
    assert len(table.refresh(feed.source(), feed.convs, f"{tmp_path}/k")) == 1
    assert table.messages.read().count() == 600
    same(table, feed)
    # A checkpoint elsewhere: the source brings everything again, and more.
    feed.bring(messages(spark, 600, 700, 10))
    again = BucketedSessions(spark, f"{tmp_path}/t", buckets=999, gap_minutes=20)
    assert again.buckets == 4
    again.refresh(feed.source(), feed.convs, f"{tmp_path}/k2")
    assert again.messages.read().count() == 700
    same(again, feed)


def test_bucket_folders_are_merged(spark, tmp_path, monkeypatch):
    from retentia.plans import bucketed

    monkeypatch.setattr(bucketed, "MERGE_AT", 2)
    feed, table = Feed(spark, tmp_path), BucketedSessions(spark, f"{tmp_path}/t", buckets=2, gap_minutes=20)
    for k in range(4):
        feed.bring(messages(spark, k * 100, k * 100 + 100, 10))
        table.refresh(feed.source(), feed.convs, f"{tmp_path}/k")
    assert max(len(f) for f in table.messages.manifest()["folders"].values()) <= 2
    same(table, feed)


def rows(spark, n):
    return spark.createDataFrame(
        [(f"c{i}", 1, "u", "i", T("2024-01-01 00:00:00"), T("2024-01-01 00:00:00"), 1, 0, 0) for i in range(n)], SESSIONS_SCHEMA)


def test_a_read_error_after_the_rename_takes_nothing_back(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, str(tmp_path / "s"), SESSIONS_SCHEMA)
    t.publish(rows(spark, 1))
    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "read", lambda self, v: 1 / 0)
        assert t.publish(rows(spark, 2)) == 2
    assert t.versions() == [1, 2] and t.read().count() == 2


def test_crashed_writes_are_swept(spark, tmp_path, monkeypatch):
    t, k = SnapshotTable(spark, str(tmp_path / "s"), SESSIONS_SCHEMA), KeyedTable(spark, str(tmp_path / "k"), SESSIONS_SCHEMA, "b")
    t.publish(rows(spark, 1))
    k.append(rows(spark, 1).withColumn("b", F.lit(1)), {})
    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "commit", lambda self, v, c: 1 / 0)
        for write in (lambda: t.publish(rows(spark, 2)), lambda: k.append(rows(spark, 2).withColumn("b", F.lit(1)), {})):
            with pytest.raises(ZeroDivisionError):
                write()
    assert t.sweep() == [] and k.sweep() == 0  # too young: a publisher may still be at it
    assert len(t.sweep(older_than_hours=0)) == 1 and k.sweep(older_than_hours=0) == 1
    assert t.read().count() == 1 and k.read().count() == 1


def test_losing_writer_of_a_keyed_table(spark, tmp_path, monkeypatch):
    a = KeyedTable(spark, str(tmp_path / "k"), SESSIONS_SCHEMA, "b")
    a.append(rows(spark, 3).withColumn("b", F.expr("cast(substring(conversation_id, 2) AS int)")), {"n": 1})
    b = KeyedTable(spark, str(tmp_path / "k"), SESSIONS_SCHEMA, "b")
    monkeypatch.setattr(b, "latest_version", lambda: None)
    with pytest.raises(commits.CommitConflict):
        b.append(rows(spark, 1).withColumn("b", F.lit(7)), {})
    assert a.read().count() == 3 and a.read([1]).count() == 1 and a.read([9]).count() == 0 and a.state() == {"n": 1}
    assert len(list((tmp_path / "k" / "data").iterdir())) == 1
    a.drop([1], {"n": 2})
    assert sorted(r.conversation_id for r in a.read().collect()) == ["c0", "c2"]
