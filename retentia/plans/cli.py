"""Job entry points (``spark-submit run_job.py <job> ...`` or
``python -m retentia.plans.cli <job> ...``):

    refresh --messages M --conversations C --sessions S
    refresh-stream --messages M --conversations C --table B --checkpoint K
    session-marts --sessions S --out O [--as-of T]
    event-marts --store R [--days D] --out O [--as-of T]
    ingest --bootstrap B --topic T --fields F --store R --dead-letter D --metrics M --checkpoint K
    compact --store R --days D [--as-of T]
    daily-cards --store R --days D --state S --out O [--as-of T]
    expire --store R [--as-of T]

Cluster settings (executors, shuffle partitions, ``spark.checkpoint.dir``)
come from spark-submit; nothing here overrides them except pinning the
session time zone to UTC.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from ..context import ensure_utc
from ..model import (
    BATCH_SECONDS,
    ENGAGED_MIN_USER_TURNS,
    EVENT_TTL_DAYS,
    MESSAGES_SCHEMA,
    REFRESH_LOOKBACK_MINUTES,
    SESSION_GAP_MINUTES,
)
from ..sources import raw_events as rawv
from ..sources import tables
from ..sources.event_store import EventStore
from . import marts
from .bucketed import BUCKETS, BucketedSessions
from .daily import DailyUsers
from .refresh import refresh_sessions, sessions_table

#: Rows that a micro-batch of the deployed ingest takes at most. A cap on memory
#: alone: a batch is spread over the executors, so it may be far larger than the
#: 20,000 rows that one consumer process could buffer.
MAX_PER_TRIGGER = 5_000_000


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="retentia")
    sub = p.add_subparsers(dest="job", required=True)

    r = sub.add_parser("refresh", help="sessions refresh (full build when empty, else incremental)")
    r.add_argument("--messages", required=True)
    r.add_argument("--conversations", required=True)
    r.add_argument("--sessions", required=True, help="snapshot table folder")
    r.add_argument("--gap-minutes", type=float, default=SESSION_GAP_MINUTES)
    r.add_argument("--lookback-minutes", type=float, default=REFRESH_LOOKBACK_MINUTES)
    r.add_argument("--keep-versions", type=int, default=3)

    b = sub.add_parser("refresh-stream", help="bucketed sessions refresh over new message files")
    b.add_argument("--messages", required=True, help="folder that message files arrive in")
    b.add_argument("--conversations", required=True)
    b.add_argument("--table", required=True, help="folder of the bucketed tables")
    b.add_argument("--checkpoint", required=True)
    b.add_argument("--buckets", type=int, default=BUCKETS)
    b.add_argument("--gap-minutes", type=float, default=SESSION_GAP_MINUTES)
    b.add_argument("--keep-versions", type=int, default=3)

    s = sub.add_parser("session-marts", help="headline numbers and cohort grid")
    s.add_argument("--sessions", help="snapshot table folder")
    s.add_argument("--table", help="folder of the bucketed tables, instead of --sessions")
    s.add_argument("--out", required=True)
    s.add_argument("--as-of", default=None)
    s.add_argument("--min-turns", type=int, default=ENGAGED_MIN_USER_TURNS)

    e = sub.add_parser("event-marts", help="every event card as a table")
    e.add_argument("--store", required=True, help="raw_events store written by the ingest job")
    e.add_argument("--days", default=None, help="folder of the compacted store, if the compact job runs")
    e.add_argument("--out", required=True)
    e.add_argument("--as-of", default=None)

    i = sub.add_parser("ingest", help="streaming ingest from Kafka")
    i.add_argument("--bootstrap", required=True)
    i.add_argument("--topic", required=True)
    i.add_argument("--fields", required=True, help="comma-separated TSV field order")
    i.add_argument("--store", required=True)
    i.add_argument("--dead-letter", required=True)
    i.add_argument("--metrics", required=True)
    i.add_argument("--checkpoint", required=True)
    i.add_argument("--encoding", choices=["base64", "raw"], default="base64")
    i.add_argument("--trigger-seconds", type=int, default=BATCH_SECONDS)
    i.add_argument("--max-per-trigger", type=int, default=MAX_PER_TRIGGER)
    i.add_argument("--starting-offsets", default="latest", help="earliest, latest or a JSON of offsets; first start only")
    i.add_argument("--allow-data-loss", action="store_true", help="go on when the topic no longer holds the next offsets")
    i.add_argument("--dedup-batch", action="store_true")
    i.add_argument("--remember", default=None, help="drop copies that arrive up to this long after the first, such as '2 days'")

    c = sub.add_parser("compact", help="merge finished ingest batches into deduplicated days, drop days past the TTL")
    c.add_argument("--store", required=True)
    c.add_argument("--days", required=True)
    c.add_argument("--as-of", default=None)
    c.add_argument("--ttl-days", type=int, default=EVENT_TTL_DAYS)
    c.add_argument("--keep-versions", type=int, default=2)

    d = sub.add_parser("daily-cards", help="take new days into the daily user state and write its cards")
    for name in ("store", "days", "state", "out"):
        d.add_argument(f"--{name}", required=True)
    d.add_argument("--as-of", default=None)

    x = sub.add_parser("expire", help="delete month partitions past the TTL")
    x.add_argument("--store", required=True)
    x.add_argument("--as-of", default=None)
    x.add_argument("--ttl-days", type=int, default=EVENT_TTL_DAYS)
    return p


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = _parser().parse_args(argv)
    spark = ensure_utc(spark or SparkSession.builder.appName(f"retentia-{args.job}").getOrCreate())
    if args.job == "refresh":
        table = sessions_table(spark, args.sessions)
        rows = refresh_sessions(
            table,
            tables.messages(spark, args.messages),
            tables.conversations(spark, args.conversations),
            lookback_minutes=args.lookback_minutes,
            gap_minutes=args.gap_minutes,
        )
        table.vacuum(args.keep_versions)
        return {"job": "refresh", "rows": rows, "version": table.latest_version()}
    if args.job == "refresh-stream":
        table = BucketedSessions(spark, args.table, args.buckets, gap_minutes=args.gap_minutes)
        source = spark.readStream.schema(MESSAGES_SCHEMA).parquet(args.messages)
        log = table.refresh(source, lambda: tables.conversations(spark, args.conversations), args.checkpoint)
        for t in (table.sessions, table.messages):
            t.vacuum(args.keep_versions)
            t.sweep()
        return {"job": "refresh-stream", "rows": sum(e["rows"] for e in log), "version": table.sessions.latest_version()}
    if args.job == "session-marts":
        sessions = BucketedSessions(spark, args.table).read() if args.table else sessions_table(spark, args.sessions).read()
        st = marts.run_session_marts(
            spark, sessions, args.out, as_of=args.as_of, min_turns=args.min_turns
        )
        return {"job": "session-marts", "failed": [r.card for r in st.collect() if not r.ok]}
    if args.job == "event-marts":
        raw = EventStore(spark, args.store, args.days).read(args.as_of) if args.days else rawv.read_store(spark, args.store)
        st = marts.run_event_marts(spark, raw, args.out, as_of=args.as_of)
        return {"job": "event-marts", "failed": [r.card for r in st.collect() if not r.ok]}
    if args.job == "ingest":
        from ..streaming import ingest

        values = ingest.kafka_source(spark, args.bootstrap, args.topic, max_per_trigger=args.max_per_trigger,
                                     starting_offsets=args.starting_offsets, fail_on_data_loss=not args.allow_data_loss)
        q = ingest.start_ingest(
            values,
            args.fields.split(","),
            args.store,
            args.dead_letter,
            args.metrics,
            args.checkpoint,
            encoding=args.encoding,
            trigger_seconds=args.trigger_seconds,
            dedup_batch=args.dedup_batch,
            remember=args.remember,
        )
        q.awaitTermination()
        return {"job": "ingest"}
    as_of = getattr(args, "as_of", None) or spark.range(1).selectExpr("CAST(current_timestamp() AS STRING) AS t").first()["t"]
    if args.job == "compact":
        store = EventStore(spark, args.store, args.days)
        merged, expired = store.compact(), store.expire(as_of, args.ttl_days)
        store.vacuum(args.keep_versions)
        store.days.sweep()
        return {"job": "compact", "merged": merged["merged"] if merged else 0, "expired": len(expired)}
    if args.job == "daily-cards":
        state = DailyUsers(spark, args.state, EventStore(spark, args.store, args.days))
        days = state.update()
        state.table.vacuum()
        st = marts.run_cards(spark, state.cards(as_of), args.out)
        return {"job": "daily-cards", "days": len(days), "failed": [r.card for r in st.collect() if not r.ok]}
    if args.job == "expire":
        removed = rawv.expire_months(spark, args.store, as_of, args.ttl_days)
        return {"job": "expire", "removed": len(removed)}
    raise ValueError(args.job)


if __name__ == "__main__":
    print(json.dumps(run()))
