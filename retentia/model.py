"""Schemas and default thresholds.

Defaults are the values the dashboards were built around; every operator takes
them as keyword arguments, so none is baked into a table.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (must equal the source application's for equal results) ----
SESSION_GAP_MINUTES = 20
ENGAGED_MIN_USER_TURNS = 4
SMALL_SAMPLE_THRESHOLD = 30
REFRESH_LOOKBACK_MINUTES = 5
SECOND_MESSAGE_DAYS = 7
SESSION_COHORT_WEEKS = 12
EVENT_COHORT_WEEKS = 8
GRID_MAX_COLUMN = 8
EVENT_TTL_DAYS = 90
FUNNEL_WINDOW_DAYS = 7
FUNNEL_STEPS = ["home_page_viewed", "influencer_cards_viewed", "chat_session_started", "user_message_sent"]
CHAT_START_ACTION = "chat_session_started"
MESSAGE_ACTION = "user_message_sent"
DEPTH_BUCKETS = ["1", "2-5", "6-20", "21+"]
DATA_SPAN_BANNER_DAYS = 3
TOP_EVENTS_K = 20
TOP_VIEWS_K = 20
PLATFORM_K = 30
INFLUENCER_K = 30
ACTIONS_K = 20
AUDIT_K = 100
BATCH_SECONDS = 5
BUFFER_CAP = 20000
USER_ID_PATH = "$.user_id"
SESSION_CONTEXT_USER_PATH = "$.contexts_com_snowplowanalytics_mobile_client_session_1[0].userId"
APP_VERSION_PATH = "$.contexts_com_snowplowanalytics_mobile_application_1[0].version"
# ------------------------------------------------------------------------------

MESSAGES_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

CONVERSATIONS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("influencer_id", T.StringType(), True),
        T.StructField("conversation_type", T.StringType(), False),
    ]
)

SESSIONS_SCHEMA = T.StructType(
    [
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("session_index", T.IntegerType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("influencer_id", T.StringType(), True),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("ended_at", T.TimestampType(), False),
        T.StructField("user_turns", T.IntegerType(), False),
        T.StructField("bot_turns", T.IntegerType(), False),
        T.StructField("system_turns", T.IntegerType(), False),
    ]
)

RAW_EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_name", T.StringType(), False),
        T.StructField("collector_tstamp", T.TimestampType(), False),
        T.StructField("derived_tstamp", T.TimestampType(), True),
        T.StructField("app_id", T.StringType(), False),
        T.StructField("platform", T.StringType(), False),
        T.StructField("domain_userid", T.StringType(), False),
        T.StructField("domain_sessionid", T.StringType(), False),
        T.StructField("event", T.StringType(), False),
    ]
)

# Extra columns the streaming sink adds: the micro-batch that wrote the row
# (replay key, newest wins on dedup) and the month partition.
INGEST_RUN_COL = "ingest_run"  # names the stream's checkpoint, ascending with its start
INGEST_BATCH_COL = "ingest_batch"
MONTH_COL = "yyyymm"

LOGIN_AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("attempted_at", T.TimestampType(), False),
        T.StructField("email", T.StringType(), True),
        T.StructField("domain", T.StringType(), True),
        T.StructField("allowed", T.BooleanType(), False),
        T.StructField("ip", T.StringType(), True),
        T.StructField("user_agent", T.StringType(), True),
    ]
)

# Test-stream field list (the canonical 131-field order belongs to the
# tracker's SDK, so the order is an operator parameter).
TEST_TSV_FIELDS = [
    "event_id",
    "event_name",
    "collector_tstamp",
    "derived_tstamp",
    "app_id",
    "platform",
    "domain_userid",
    "domain_sessionid",
    "user_id",
    "se_category",
    "se_action",
    "se_property",
    "contexts",
]

# fixed values: tracker fields that are not text, by the public tracker protocol
INT_FIELDS = (
    "br_viewheight", "br_viewwidth", "doc_height", "doc_width", "domain_sessionidx", "dvce_screenheight", "dvce_screenwidth",
    "page_urlport", "pp_xoffset_max", "pp_xoffset_min", "pp_yoffset_max", "pp_yoffset_min", "refr_urlport", "ti_quantity", "txn_id",
)
DOUBLE_FIELDS = (
    "geo_latitude", "geo_longitude", "se_value", "ti_price", "ti_price_base", "tr_shipping", "tr_shipping_base", "tr_tax",
    "tr_tax_base", "tr_total", "tr_total_base",
)
BOOLEAN_FIELDS = (
    "br_cookies", "br_features_director", "br_features_flash", "br_features_gears", "br_features_java", "br_features_pdf",
    "br_features_quicktime", "br_features_realplayer", "br_features_silverlight", "br_features_windowsmedia", "dvce_ismobile",
)
FIELD_TYPES = {**dict.fromkeys(INT_FIELDS, "bigint"), **dict.fromkeys(DOUBLE_FIELDS, "double"), **dict.fromkeys(BOOLEAN_FIELDS, "boolean")}
