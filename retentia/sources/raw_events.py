"""Batch views over ``raw_events``: deduplication, retention TTL and the
projected event facts every card reads.

The store is append-only (at-least-once delivery writes copies). The
deduplicated view collapses rows equal on (collector_tstamp, event_name,
event_id) — the newest ingest batch wins — which equals the fully merged state
of the original table. Retention drops an event once its second-truncated
timestamp plus ``ttl_days`` is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import ensure_utc, ts_lit
from ..functions import jsonx
from ..model import (
    APP_VERSION_PATH,
    EVENT_TTL_DAYS,
    INGEST_BATCH_COL,
    INGEST_RUN_COL,
    MONTH_COL,
    RAW_EVENTS_SCHEMA,
    SESSION_CONTEXT_USER_PATH,
    USER_ID_PATH,
)

DEDUP_KEY = ["collector_tstamp", "event_name", "event_id"]


STORE_SCHEMA = T.StructType(
    list(RAW_EVENTS_SCHEMA.fields)
    + [T.StructField(INGEST_RUN_COL, T.StringType()), T.StructField(INGEST_BATCH_COL, T.LongType()), T.StructField(MONTH_COL, T.IntegerType())]
)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Read the ingest sink (partitioned by ingest batch and month) with its
    declared schema. A missing store reads as an empty table."""
    ensure_utc(spark)
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(path)
    except Exception as exc:  # noqa: BLE001 - only "path does not exist" is expected
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], STORE_SCHEMA)


#: Orders the copies of an event that one batch holds: by platform, then by a hash of the raw row,
#: the same for whoever reads it, so raw rows and projected facts agree on the copy that stays.
RANK = "_rank"


def _ranked(raw: DataFrame) -> F.Column:
    return F.struct("platform", F.xxhash64(*[c for c in RAW_EVENTS_SCHEMA.fieldNames() if c in raw.columns])).alias(RANK)


def _newest(df: DataFrame, keys: list[str], origin: bool = False) -> DataFrame:
    """One row per key: that of the latest run and batch; copies within a
    batch are ordered by ``RANK``. Copies combine map-side before the shuffle."""
    when = [c for c in (INGEST_RUN_COL, INGEST_BATCH_COL, RANK) if c in df.columns]
    others = [c for c in df.columns if c not in keys and c not in when]
    stay = others + [c for c in when if origin and c != RANK]
    # The order's struct holds all that stays, so its maximum is the row, sorted and shuffled once and not beside a copy of itself.
    newest = F.max(F.struct(*when, *others)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col("_row").getField(c).alias(c) for c in stay])


def dedup(raw: DataFrame, origin: bool = False) -> DataFrame:
    """One row per dedup key, chosen by the rule of ``_newest``; ``origin`` keeps
    the run and batch that it came with."""
    keys = list(DEDUP_KEY)
    if MONTH_COL in raw.columns:
        keys.append(MONTH_COL)  # implied by the timestamp; keeps month pruning below the aggregate
    return _newest(raw.select("*", _ranked(raw)), keys, origin)


def retained(raw: DataFrame, as_of=None, ttl_days: int = EVENT_TTL_DAYS) -> DataFrame:
    """Rows still inside the TTL at ``as_of``: trunc_second(ts) + ttl > as_of."""
    # cutoff is a whole second, so trunc_second(ts) > cutoff <=> ts >= cutoff + 1 s,
    # a plain bound on the column that reaches the parquet scan
    cutoff = F.timestamp_seconds(F.unix_seconds(ts_lit(as_of)) - ttl_days * 86400)
    out = raw.where(F.col("collector_tstamp") >= F.timestamp_seconds(F.unix_seconds(ts_lit(as_of)) - ttl_days * 86400 + 1))
    return _month_floor(out, cutoff)


def _month_floor(df: DataFrame, lower: F.Column) -> DataFrame:
    if MONTH_COL in df.columns:
        df = df.where(F.col(MONTH_COL) >= F.date_format(lower, "yyyyMM").cast(df.schema[MONTH_COL].dataType))
    return df


def since(df: DataFrame, as_of, seconds: int, ts_col: str = "ts") -> DataFrame:
    """``ts >= as_of - seconds`` with no upper bound, plus month pruning."""
    lower = F.timestamp_seconds(F.unix_seconds(ts_lit(as_of)) - seconds)
    return _month_floor(df.where(F.col(ts_col) >= lower), lower)


def facts(raw: DataFrame, strict_json: bool = True) -> DataFrame:
    """Project the JSON payload once into the columns the cards use.

    ``u`` is the user identity (top-level ``user_id`` unless blank, else the
    client-session context's ``userId``, else ''); ``''`` is one user.
    """
    raw = raw.select("*", _ranked(raw))
    extra = [c for c in (MONTH_COL, INGEST_RUN_COL, INGEST_BATCH_COL, RANK) if c in raw.columns]
    if strict_json:
        v = "try_parse_json(event)"
        s = lambda p: jsonx.variant_str_sql(v, p)
        prop = f"try_parse_json({s('$.se_property')})"
        return raw.selectExpr(
            "event_id",
            "event_name",
            "collector_tstamp AS ts",
            "platform",
            f"{jsonx.identity_sql(v, USER_ID_PATH, SESSION_CONTEXT_USER_PATH)} AS u",
            f"{s('$.se_category')} AS se_category",
            f"{s('$.se_action')} AS se_action",
            f"{s(APP_VERSION_PATH)} AS app_version",
            f"{jsonx.variant_str_sql(prop, '$.influencer_id')} AS influencer",
            f"{jsonx.variant_str_sql(prop, '$.influencer_type')} AS itype",
            *extra,
        )
    s = lambda p: jsonx.json_str("event", p, strict=False)
    user = F.coalesce(F.nullif(s(USER_ID_PATH), F.lit("")), s(SESSION_CONTEXT_USER_PATH))
    infl = jsonx.json_str(s("$.se_property"), "$.influencer_id", strict=False)
    itype = jsonx.json_str(s("$.se_property"), "$.influencer_type", strict=False)
    return raw.select(
        "event_id",
        "event_name",
        F.col("collector_tstamp").alias("ts"),
        "platform",
        user.alias("u"),
        s("$.se_category").alias("se_category"),
        s("$.se_action").alias("se_action"),
        s(APP_VERSION_PATH).alias("app_version"),
        infl.alias("influencer"),
        itype.alias("itype"),
        *extra,
    )


def event_view(raw: DataFrame, as_of=None, ttl_days: int = EVENT_TTL_DAYS, strict_json: bool = True) -> DataFrame:
    """Retained, deduplicated, projected events: the input of every card.

    Retention filters first (pushed to the scan), the payload is parsed once,
    and copies of an event are resolved by the rule of ``dedup`` on the narrow
    projected rows.
    """
    f = facts(retained(raw, as_of, ttl_days), strict_json)
    return _newest(f, ["ts", "event_name", "event_id"] + ([MONTH_COL] if MONTH_COL in f.columns else []))


def expire_months(spark: SparkSession, store: str, as_of, ttl_days: int = EVENT_TTL_DAYS) -> list[str]:
    """Delete whole month partitions of the ingest store whose every event is
    past the TTL at ``as_of`` (the month's end + ttl_days <= as_of). Rows of
    younger months are filtered at read time by :func:`retained`."""
    import datetime as dt

    now = spark.range(1).select(F.date_format(ts_lit(as_of), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).first()["t"]
    now = dt.datetime.fromisoformat(now)
    jvm = spark._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    statuses = fs.globStatus(Path(f"{store.rstrip('/')}/{INGEST_RUN_COL}=*/{INGEST_BATCH_COL}=*/{MONTH_COL}=*")) or []
    removed = []
    for st in statuses:
        month = st.getPath().getName().split("=", 1)[1]
        year, mon = int(month[:4]), int(month[4:6])
        nxt = dt.datetime(year + (mon == 12), mon % 12 + 1, 1)
        if nxt + dt.timedelta(days=ttl_days) <= now:
            fs.delete(st.getPath(), True)
            removed.append(str(st.getPath()))
    return removed
