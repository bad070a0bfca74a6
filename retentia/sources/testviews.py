"""Adapters from the shared test tables to the application's input shapes.

The driver's ``events`` table (event_id, ts, user_id, event_type, value, props)
is mapped to chat ``messages`` / ``conversations`` and to ``raw_events`` rows
with a tracker-style JSON payload. The mapping rules are plain column
expressions, so the views scale with the table and every downstream operator
reads real data. The same rules are restated in the DuckDB oracle SQL.

Mapping (fixed values):
  conversation = user_id * 2 + event_id % 2
  role         = click, view -> user; error -> system; signup, purchase -> assistant
  chat type    = human when conversation % 10 = 0, else ai_chat
  influencer   = conversation % 7 (sessions), user_id % 7 (events)
  se_action    = event_type, but view -> item_viewed
  se_category  = 'cat_' || event_id % 4
  platform     = event_id % 3, app version = event_id % 5
  influencer_type = '' when event_id % 11 = 0, else persona (even influencer) / assistant (odd)
  user id      = absent when user_id % 10 = 0; only in the client-session context
                 when user_id % 10 = 1; top-level field otherwise
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import ensure_utc, spread


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a lazy DataFrame. The resolved scan (file listing and
    footer schema) is kept per session and path, so the several views built
    over one table do not list and resolve it again; no data is cached."""
    ensure_utc(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    memo = spark.__dict__.setdefault("_retentia_scans", {})
    if path not in memo:
        memo[path] = spark.read.parquet(path)
    return memo[path]


def events(spark: SparkSession, sf_dir: str, spread_scan: bool = False) -> DataFrame:
    """The ``events`` table with ``ts`` as a TIMESTAMP (parquet gives TIMESTAMP_NTZ,
    which watermarks and timezone-aware functions reject). ``spread_scan``
    when heavy per-row work (JSON) runs before the first shuffle."""
    df = read_table(spark, sf_dir, "events")
    return (spread(df) if spread_scan else df).withColumn("ts", F.col("ts").cast("timestamp"))


CONV = "(user_id * 2 + event_id % 2)"
ROLE = "CASE WHEN event_type IN ('click', 'view') THEN 'user' WHEN event_type = 'error' THEN 'system' ELSE 'assistant' END"
ACTION = "CASE WHEN event_type = 'view' THEN 'item_viewed' ELSE event_type END"
ITYPE = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 7 % 2 = 0 THEN 'persona' ELSE 'assistant' END"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "event_id AS id",
        f"CAST({CONV} AS STRING) AS conversation_id",
        f"{ROLE} AS role",
        "ts AS created_at",
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .selectExpr(
            f"CAST({CONV} AS STRING) AS id",
            "CAST(user_id AS STRING) AS user_id",
            f"CAST({CONV} % 7 AS STRING) AS influencer_id",
            f"CASE WHEN {CONV} % 10 = 0 THEN 'human' ELSE 'ai_chat' END AS conversation_type",
        )
        .distinct()
    )


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login attempts: one per event, an error is a refusal."""
    return events(spark, sf_dir).selectExpr(
        "event_id AS id", "ts AS attempted_at", "concat('u', user_id, '@d', user_id % 3, '.org') AS email",
        "concat('d', user_id % 3, '.org') AS domain", "event_type <> 'error' AS allowed",
        "CASE WHEN event_id % 4 <> 0 THEN concat('10.0.', user_id % 256, '.', event_id % 256) END AS ip", "event_type AS user_agent",
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_events`` rows as the ingest job writes them (ms timestamps, JSON payload)."""
    ts = "date_trunc('MILLISECOND', ts)"
    uid = "CAST(user_id AS STRING)"
    payload = f"""to_json(named_struct(
        'event_id', CAST(event_id AS STRING),
        'event_name', 'event',
        'collector_tstamp', date_format({ts}, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        'user_id', CASE WHEN user_id % 10 NOT IN (0, 1) THEN {uid} END,
        'se_category', 'cat_' || CAST(event_id % 4 AS STRING),
        'se_action', {ACTION},
        'se_property', to_json(named_struct('influencer_id', CAST(user_id % 7 AS STRING), 'influencer_type', {ITYPE})),
        'contexts_com_snowplowanalytics_mobile_client_session_1',
            CASE WHEN user_id % 10 = 1 THEN array(named_struct('userId', {uid})) END,
        'contexts_com_snowplowanalytics_mobile_application_1',
            array(named_struct('version', CAST(event_id % 5 AS STRING)))))"""
    return events(spark, sf_dir, spread_scan=True).selectExpr(
        "CAST(event_id AS STRING) AS event_id",
        "'event' AS event_name",
        f"{ts} AS collector_tstamp",
        f"{ts} AS derived_tstamp",
        "'app' AS app_id",
        "CAST(event_id % 3 AS STRING) AS platform",
        "'' AS domain_userid",
        "'' AS domain_sessionid",
        f"{payload} AS event",
    )


def tracker_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as enriched tab-separated tracker lines, one per
    event, beside the event's id: a filter on ``id`` reaches the scan and builds no line.

    Field order is ``model.TEST_TSV_FIELDS``; the user id travels top-level or
    in the client-session context by the same rule as :func:`raw_events`, and
    the application context carries the app version.
    """
    ev = events(spark, sf_dir, spread_scan=True)
    ts = F.date_format(F.date_trunc("MILLISECOND", ev.ts), "yyyy-MM-dd HH:mm:ss.SSS")
    uid = ev.user_id.cast("string")
    itype = (
        F.when(ev.event_id % 11 == 0, F.lit(None).cast("string"))
        .when(ev.user_id % 7 % 2 == 0, "persona")
        .otherwise("assistant")
    )
    se_property = F.to_json(F.struct((ev.user_id % 7).cast("string").alias("influencer_id"), itype.alias("influencer_type")))
    ctx = lambda schema, data: F.struct(F.lit(schema).alias("schema"), data.alias("data"))
    none = F.lit(None).cast("string")
    # one struct type for both contexts; null members are left out of the JSON
    session_ctx = ctx(
        "iglu:com.snowplowanalytics.mobile/client_session/jsonschema/1-0-2",
        F.struct(uid.alias("userId"), none.alias("version")),
    )
    app_ctx = ctx(
        "iglu:com.snowplowanalytics.mobile/application/jsonschema/1-0-0",
        F.struct(none.alias("userId"), (ev.event_id % 5).cast("string").alias("version")),
    )
    contexts = F.to_json(
        F.struct(
            F.lit("iglu:com.snowplowanalytics.snowplow/contexts/jsonschema/1-0-0").alias("schema"),
            F.when(ev.user_id % 10 == 1, F.array(session_ctx, app_ctx)).otherwise(F.array(app_ctx)).alias("data"),
        )
    )
    line = F.concat_ws(
        "\t",
        ev.event_id.cast("string"),
        F.lit("event"),
        ts,
        ts,
        F.lit("app"),
        (ev.event_id % 3).cast("string"),
        F.lit(""),
        F.lit(""),
        F.when(~(ev.user_id % 10).isin(0, 1), uid).otherwise(F.lit("")),
        F.concat(F.lit("cat_"), (ev.event_id % 4).cast("string")),
        F.when(ev.event_type == "view", "item_viewed").otherwise(ev.event_type),
        se_property,
        contexts,
    )
    return ev.select(ev.event_id.alias("id"), line.alias("line"))


def encoded(line) -> Column:
    """Lines as the stream's records. base64 may be MIME-chunked with line breaks; one record must stay one line."""
    return F.regexp_replace(F.base64(F.encode(line, "UTF-8")), r"[\r\n]", "")


def tracker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`tracker_text` base64 encoded: the stream the ingest job consumes in tests."""
    return tracker_text(spark, sf_dir).select(encoded("line").alias("value"))
