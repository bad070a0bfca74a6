"""Streaming queries registered for the driver.

Each runs a real Structured Streaming job to completion (``availableNow``)
over input derived from the ``events`` table, then returns the sink read back
as a batch DataFrame. Scratch folders live under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import ensure_checkpoint_dir, ensure_utc
from ..model import MESSAGES_SCHEMA, RAW_EVENTS_SCHEMA, TEST_TSV_FIELDS
from ..plans import marts
from ..plans.bucketed import BucketedSessions
from ..operators import sessions
from ..plans.catalog import AS_OF, DAY_GAP, MESSAGE_ACTION, REFRESH_CUT, TTL_AS_OF
from ..plans.daily import DailyUsers
from ..plans.refresh import sessions_table
from ..sources import raw_events as rawv
from ..sources import tables
from ..sources import testviews as tv
from ..sources.commits import CommitLog
from ..sources.event_store import EventStore
from . import ingest
from .activity import activity, activity_windows
from .live_sessions import current_sessions, live_sessions, session_updates

LIVE_CUT = "2024-01-20 12:00:00"  # where the second delivery of the live queries starts


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/retentia-{tag}-{uuid.uuid4().hex[:12]}"


def run_ingest(spark: SparkSession, sf: str) -> dict:
    """Write the tracker lines as text files, ingest them with the streaming
    job, and return the output locations."""
    ensure_utc(spark)
    paths = _paths(scratch(spark, "ingest"))
    _deliver(spark, tv.tracker_lines(spark, sf), paths, "0")
    return paths


def _paths(base: str) -> dict:
    return {k: f"{base}/{k}" for k in ("in", "raw_events", "dead_letter", "metrics", "checkpoint")}


def _deliver(spark: SparkSession, lines, paths: dict, run: str, batches: int | None = None, **how) -> None:
    """Ingest ``lines`` into the store of ``paths`` under the checkpoint of ``run``, in about as many
    micro-batches as ``batches`` says: of several files each, which all cores write and read."""
    if batches and spark.sparkContext.defaultParallelism < batches:
        lines = lines.repartition(batches)
    folder = CommitLog(spark, f"{paths['in']}/{run}")
    before = folder.files()
    lines.write.mode("append").text(folder.base)
    _run(spark, paths, run, batches and -(-(folder.files() - before) // batches), **how)


def _run(spark: SparkSession, paths: dict, run: str, max_files: int | None = None, fields: list[str] = TEST_TSV_FIELDS, **how) -> None:
    q = ingest.start_ingest(
        ingest.file_source(spark, f"{paths['in']}/{run}", max_files_per_trigger=max_files),
        fields,
        paths["raw_events"],
        paths["dead_letter"],
        paths["metrics"],
        f"{paths['checkpoint']}/{run}",
        available_now=True,
        **how,
    )
    q.awaitTermination()


def _stored_events(spark: SparkSession, paths: dict):
    ev = rawv.event_view(rawv.read_store(spark, paths["raw_events"]), as_of=AS_OF)
    return ev.select("event_id", "ts", "u", "se_category", "se_action", "platform", "app_version", "influencer", "itype")


def q_ingest_stream(spark: SparkSession, sf: str):
    return _stored_events(spark, run_ingest(spark, sf))


def _with_id(spark: SparkSession, sf: str):
    """Tracker lines with their text and event id."""
    return tv.tracker_text(spark, sf).withColumn("value", tv.encoded("line"))


def q_ingest_replay(spark: SparkSession, sf: str):
    """Two deliveries into one store, the second under a new checkpoint, in
    several micro-batches each: it brings late events of its own (every third)
    and copies of events that the first has stored (every second)."""
    ensure_utc(spark)
    paths, lines = _paths(scratch(spark, "replay")), _with_id(spark, sf)
    first = lines.where("id % 3 <> 0").select("value")
    again = lines.where("id % 3 = 0 OR id % 2 = 0").select("value")
    _deliver(spark, first, paths, "0", batches=3)
    _deliver(spark, again, paths, "1", batches=3, dedup_batch=True)
    return _stored_events(spark, paths)


def q_ingest_lost_checkpoint(spark: SparkSession, sf: str):
    """A delivery, then the checkpoint folder is lost, then a second delivery
    from the same folders and the same checkpoint path: nothing stored goes."""
    ensure_utc(spark)
    paths, lines = _paths(scratch(spark, "lost")), _with_id(spark, sf)
    _deliver(spark, lines.where("id % 3 <> 0").select("value"), paths, "0")
    checkpoint = spark._jvm.org.apache.hadoop.fs.Path(f"{paths['checkpoint']}/0")
    checkpoint.getFileSystem(spark._jsc.hadoopConfiguration()).delete(checkpoint, True)
    again = lines.where("id % 3 = 0 OR id % 5 = 0").select("value")
    again.write.mode("overwrite").text(f"{paths['in']}/0")
    _run(spark, paths, "0")
    return _stored_events(spark, paths)


def q_ingest_dedup_stream(spark: SparkSession, sf: str):
    """What the store itself holds, without the dedup view, after two deliveries
    to one checkpoint in several micro-batches each: the second brings copies of
    stored events, each twice, and late events of its own. Stored rows and
    distinct events a day."""
    ensure_utc(spark)
    paths, lines = _paths(scratch(spark, "dedup")), _with_id(spark, sf)
    again = lines.where("id % 3 = 0 OR id % 2 = 0").select("value")
    _deliver(spark, lines.where("id % 3 <> 0").select("value"), paths, "0", batches=2, remember="2 days")
    _deliver(spark, again.unionAll(again), paths, "0", batches=4, remember="2 days")
    stored = rawv.read_store(spark, paths["raw_events"])
    return stored.groupBy(F.to_date("collector_tstamp").alias("day")).agg(
        F.count("*").alias("stored_rows"), F.countDistinct("collector_tstamp", "event_name", "event_id").alias("n_events"))


def q_ingest_payload(spark: SparkSession, sf: str):
    """Numbers, flags, a self-describing event and contexts of two fields, read from the stored payloads with their types."""
    ensure_utc(spark)
    paths, lines = _paths(scratch(spark, "payload")), _with_id(spark, sf)
    item = "named_struct('schema', 'iglu:com.acme/{0}/jsonschema/2-0-1', 'data', named_struct('n', id))"
    more = lines.select(F.concat_ws(
        "\t", "line", F.expr("CAST(id % 8 / 4.0D AS string)"), F.expr("CASE WHEN id % 5 > 0 THEN CAST(id AS string) ELSE '' END"), F.expr("CAST(id % 2 AS string)"),
        F.expr(f"to_json(named_struct('data', {item.format('itemBought')}))"),
        F.expr(f"to_json(named_struct('data', array({item.format('geo-hint')}, {item.format('geo-hint')})))")).alias("line"))
    value = F.regexp_replace(F.base64(F.encode("line", "UTF-8")), "\\s", "").alias("value")
    fields = [*TEST_TSV_FIELDS, "se_value", "domain_sessionidx", "br_cookies", "unstruct_event", "derived_contexts"]
    _deliver(spark, more.select(value), paths, "0", fields=fields)
    v = F.try_parse_json("event")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    shape = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return rawv.read_store(spark, paths["raw_events"]).select(
        "event_id", get("$.se_value", "double").alias("se_value"), get("$.domain_sessionidx", "bigint").alias("session_no"),
        get("$.br_cookies", "boolean").alias("cookies"), (shape("$.br_cookies") == "BOOLEAN").alias("is_flag"),
        (shape("$.domain_sessionidx") == "BIGINT").alias("is_number"), get("$.unstruct_event_com_acme_item_bought_2.n", "bigint").alias("bought"),
        get("$.contexts_com_acme_geo_hint_2[1].n", "bigint").alias("hint"),
        get("$.contexts_com_snowplowanalytics_mobile_application_1[0].version", "string").alias("app_version"))


def q_ingest_dead_letter(spark: SparkSession, sf: str):
    """Rejected rows by reason, of a stream in which four lines in ten are broken."""
    rejected = spark.read.schema("value string, reason string").parquet(_run_broken(spark, sf)["dead_letter"])
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def q_ingest_metrics(spark: SparkSession, sf: str):
    """The metrics rows of the same stream, summed over its batches."""
    rows = spark.read.parquet(_run_broken(spark, sf)["metrics"])
    return rows.agg(*[F.sum(c).alias(c) for c in ("input_rows", "inserted", "parse_errors")])


def _run_broken(spark: SparkSession, sf: str) -> dict:
    ensure_utc(spark)
    paths, lines = _paths(scratch(spark, "dead")), _with_id(spark, sf)
    text = lambda c: F.base64(c.cast("binary"))
    broken = (
        F.when(F.expr("id % 10 = 1"), F.lit("%%%"))
        .when(F.expr("id % 10 = 2"), text(F.concat("line", F.lit("\textra"))))
        .when(F.expr("id % 10 = 3"), text(F.regexp_replace("line", "^[^\t]*", "")))
        .when(F.expr("id % 10 = 4"), text(F.regexp_replace("line", "^([^\t]*\t[^\t]*\t)[^\t]*", "$1never")))
        .otherwise(F.col("value"))
    )
    _deliver(spark, lines.select(F.regexp_replace(broken, "\\s", "").alias("value")), paths, "0", batches=3)
    return paths


def q_live_sessions(spark: SparkSession, sf: str):
    ensure_utc(spark)
    base = scratch(spark, "live")
    src = (
        spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )
    ev = src.withColumn("ts", F.col("ts").cast("timestamp"))
    msgs = ev.select(
        ev.event_id.alias("id"),
        (ev.user_id * 2 + ev.event_id % 2).cast("string").alias("conversation_id"),
        F.when(ev.event_type.isin("click", "view"), "user").when(ev.event_type == "error", "system").otherwise("assistant").alias("role"),
        ev.ts.alias("created_at"),
    )
    assert [f.name for f in MESSAGES_SCHEMA] == msgs.columns
    out = live_sessions(msgs, tv.conversations(spark, sf), gap_minutes=24 * 60)
    q = (
        out.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _append(rows: DataFrame, base: str, *partitions: str) -> None:
    """Run a streaming result into parquet until its source is read."""
    out = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    if partitions:
        out = out.partitionBy(*partitions)
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def q_open_sessions(spark: SparkSession, sf: str):
    """Numbered sessions, open ones too, after two deliveries; the second brings
    every fifth message of the day and a half before the cut, which joins
    sessions that the first had told apart."""
    ensure_utc(spark)
    base, msgs, convs = scratch(spark, "open"), tv.messages(spark, sf), tv.conversations(spark, sf)
    late = F.expr(f"created_at >= TIMESTAMP '{LIVE_CUT}' OR (id % 5 = 0 AND created_at >= TIMESTAMP '{LIVE_CUT}' - INTERVAL 36 HOURS)")
    for delivery in (msgs.where(~late), msgs.where(late)):
        delivery.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(MESSAGES_SCHEMA).parquet(f"{base}/in")
        _append(session_updates(source, convs, gap_minutes=DAY_GAP, delay="2 days"), base)
    return current_sessions(spark.read.parquet(f"{base}/out"), convs)


def q_activity_mart(spark: SparkSession, sf: str):
    """The recent-activity card at every minute, from a stream in two deliveries;
    the second repeats the five minutes before the cut and old events."""
    ensure_utc(spark)
    base, raw = scratch(spark, "activity"), tv.raw_events(spark, sf)
    cut = f"TIMESTAMP '{LIVE_CUT}'"
    for rule in (f"collector_tstamp < {cut}", f"collector_tstamp >= {cut} - INTERVAL 5 MINUTES OR CAST(event_id AS long) % 50 = 0"):
        raw.where(rule).write.mode("append").parquet(f"{base}/in")
        source = rawv.facts(spark.readStream.schema(RAW_EVENTS_SCHEMA).parquet(f"{base}/in"))
        _append(activity_windows(source, delay="10 minutes"), base, "day")
    return activity(spark.read.parquet(f"{base}/out"))


def run_compaction(spark: SparkSession, sf: str) -> EventStore:
    """Deliveries with copies of one another under three checkpoints, two of
    them compacted (the older batches are deleted), the third still pending."""
    ensure_utc(spark)
    paths, lines = _paths(base := scratch(spark, "compact")), _with_id(spark, sf)
    store = EventStore(spark, paths["raw_events"], f"{base}/days")
    for n, rule in enumerate(("id % 3 <> 0", "id % 4 = 0", "id % 3 = 0 OR id % 5 = 0")):
        _deliver(spark, lines.where(rule).select("value"), paths, str(n), batches=2)
        if n < 2:
            store.compact()
            store.vacuum(keep=1)
    return store


def q_compacted_events(spark: SparkSession, sf: str):
    """The event view over the compacted store."""
    ev = rawv.event_view(run_compaction(spark, sf).read(AS_OF), as_of=AS_OF)
    return ev.select("event_id", "ts", "u", "se_category", "se_action", "platform", "app_version", "influencer", "itype")


def q_compacted_days(spark: SparkSession, sf: str):
    """Rows a day that the store itself holds once all is compacted and old days have expired."""
    store = run_compaction(spark, sf)
    store.compact()
    store.expire(TTL_AS_OF)
    return store.days.read().groupBy(F.to_date("collector_tstamp").alias("day")).agg(F.count("*").alias("n_events"))


def run_refresh(spark: SparkSession, sf: str, buckets: int = 16):
    """Three hours of the bucketed refresh: most messages before the cut; later
    ones together with old ones that came late; nothing. Returns the table and
    the runs' logs."""
    ensure_utc(spark)
    base = scratch(spark, "refresh")
    msgs, late = tv.messages(spark, sf), F.expr(f"created_at >= TIMESTAMP '{REFRESH_CUT}' OR id % 50 = 7")
    table, logs = BucketedSessions(spark, f"{base}/table", buckets, gap_minutes=DAY_GAP), []
    for delivery in (msgs.where(~late), msgs.where(late), None):
        if delivery is not None:
            delivery.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(MESSAGES_SCHEMA).parquet(f"{base}/in")
        logs.append(table.refresh(source, lambda: tv.conversations(spark, sf), f"{base}/checkpoint"))
    return table, logs


def q_refresh_job(spark: SparkSession, sf: str):
    """The sessions table after the three runs."""
    return run_refresh(spark, sf)[0].read()


def q_refresh_log(spark: SparkSession, sf: str):
    """What each run published: conversations touched and session rows recomputed."""
    rows = [(n, len(log), sum(e["conversations"] for e in log), sum(e["rows"] for e in log)) for n, log in enumerate(run_refresh(spark, sf)[1], 1)]
    return spark.createDataFrame(rows, "run int, commits int, conversations long, session_rows long")


def q_marts_board(spark: SparkSession, sf: str):
    """Two runs of four cards, one of which fails in the second: what each card
    says, and how many rows are served."""
    ensure_utc(spark)
    out, ev = scratch(spark, "board"), rawv.event_view(tv.raw_events(spark, sf), as_of=AS_OF)
    cards = {c: f for c, f in marts.event_cards(ev, AS_OF).items() if c in ("active_users", "dau_trend", "event_volume", "total_events")}
    marts.run_cards(spark, cards, out)
    cards["event_volume"] = lambda: ev.select(F.raise_error(F.lit("card down")).alias("x"))
    marts.run_cards(spark, cards, out)
    board = marts.Board(spark, out)
    parts = [board.read(c).select(F.lit(c).alias("card")) for c in sorted(cards)]
    served = reduce(DataFrame.unionAll, parts).groupBy("card").agg(F.count("*").alias("served_rows"))
    return board.status().join(served, "card").select("card", "ok", "rows", "served_rows")


def q_snapshot_sessions(spark: SparkSession, sf: str):
    """The snapshot table from its empty first version on: an early and a full
    publish, a read of the older version in between, old versions vacuumed."""
    ensure_utc(spark)
    table = sessions_table(spark, scratch(spark, "snapshots"))
    full = sessions.sessionize(tv.messages(spark, sf), tv.conversations(spark, sf), gap_minutes=DAY_GAP)
    assert table.ensure() == 1 and table.ensure() == 1
    table.publish(full.where("session_index = 1"))
    table.publish(table.read().unionByName(full.where("session_index <> 1")))
    table.vacuum(keep=1)
    return table.read()


def q_recent_logins(spark: SparkSession, sf: str):
    """The newest login attempts of an audit table written from the events."""
    ensure_utc(spark)
    path = scratch(spark, "audit")
    tv.logins(spark, sf).write.parquet(path)
    return marts.recent_logins(tables.login_audit(spark, path))


def q_daily_cards(spark: SparkSession, sf: str):
    """Cards from the daily state, which took in two deliveries, the second with
    late events; stacked as (card, what, value)."""
    ensure_utc(spark)
    base, raw = scratch(spark, "daily"), tv.raw_events(spark, sf).withColumn("yyyymm", F.date_format("collector_tstamp", "yyyyMM").cast("int"))
    store = EventStore(spark, f"{base}/raw", f"{base}/days")
    state = DailyUsers(spark, f"{base}/state", store, MESSAGE_ACTION)
    for n, rule in enumerate(("collector_tstamp < TIMESTAMP '2024-01-20' AND CAST(event_id AS long) % 9 <> 0", "collector_tstamp >= TIMESTAMP '2024-01-20' OR CAST(event_id AS long) % 9 = 0")):
        raw.where(rule).write.partitionBy("yyyymm").parquet(f"{base}/raw/ingest_run=0/ingest_batch={n}")
        store.compact()
        state.update()
    cards = state.cards(AS_OF)
    number = lambda card, what, value: cards[card]().select(F.lit(card).alias("card"), what.cast("string").alias("what"), F.col(value).cast("long").alias("value"))
    parts = [number("active_users", F.lit(c), c) for c in ("dau", "wau", "mau")]
    parts += [number("dau_trend", F.col("d"), "dau"), number("event_volume", F.col("d"), "events"), number("message_depth", F.col("bucket"), "users")]
    parts += [number("returning_user_rate", F.lit("returning"), "returning_users"), number("returning_user_rate", F.lit("n"), "n")]
    parts += [number("wow", F.lit(c), c) for c in ("users_this", "users_last", "events_this", "events_last")]
    parts.append(number("event_retention", F.concat_ws("/", "cohort_week", "week_offset"), "active_users"))
    return reduce(DataFrame.unionAll, parts)


QUERIES = {
    "ingest_stream": q_ingest_stream,
    "ingest_replay": q_ingest_replay,
    "ingest_lost_checkpoint": q_ingest_lost_checkpoint,
    "ingest_dedup_stream": q_ingest_dedup_stream,
    "ingest_payload": q_ingest_payload,
    "ingest_dead_letter": q_ingest_dead_letter,
    "ingest_metrics": q_ingest_metrics,
    "snapshot_sessions": q_snapshot_sessions,
    "recent_logins": q_recent_logins,
    "live_sessions": q_live_sessions,
    "open_sessions": q_open_sessions,
    "activity_mart": q_activity_mart,
    "compacted_events": q_compacted_events,
    "compacted_days": q_compacted_days,
    "daily_cards": q_daily_cards,
    "marts_board": q_marts_board,
    "refresh_job": q_refresh_job,
    "refresh_log": q_refresh_log,
}
