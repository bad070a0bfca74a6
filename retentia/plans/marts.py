"""Dashboard marts: the one-row glance, the latest-k list, and the marts job
that materialises every card as a table."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import (
    AUDIT_K,
    CHAT_START_ACTION,
    ENGAGED_MIN_USER_TURNS,
    FUNNEL_STEPS,
    FUNNEL_WINDOW_DAYS,
    MESSAGE_ACTION,
    MONTH_COL,
)
from ..operators import cohorts, events, funnel, headline
from ..sources import raw_events as rawv
from ..sources.commits import CommitLog
from ..sources.snapshots import count_on_write


def kpi_glance(funnel_steps: DataFrame, active: DataFrame, returning: DataFrame) -> DataFrame:
    """One row: overall funnel conversion (last step vs first), stickiness and
    returning-user rate. The three one-row inputs are stacked as
    (metric, value) rows and pivoted back, so no join is needed."""
    names = ["funnel_conversion", "stickiness", "returning_rate"]
    last = funnel_steps.agg(F.max_by("conversion", "step_no").alias("v"))
    parts = [
        last.select(F.lit(names[0]).alias("metric"), F.col("v").alias("value")),
        active.select(F.lit(names[1]).alias("metric"), F.col("stickiness").alias("value")),
        returning.select(F.lit(names[2]).alias("metric"), F.col("rate").alias("value")),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.groupBy().pivot("metric", names).agg(F.first("value")).select(*names)


def latest(df: DataFrame, ts_col: str, k: int = AUDIT_K, columns: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """The ``k`` newest rows by ``ts_col`` (top-k, planned as a bounded
    per-partition heap + merge)."""
    order = [F.col(ts_col).desc()] + ([F.col(tie).desc()] if tie else [])
    out = df.orderBy(*order).limit(k)
    return out.select(*columns) if columns else out


def recent_logins(audit: DataFrame, k: int = AUDIT_K) -> DataFrame:
    """Latest login attempts without the surrogate id."""
    return latest(audit, "attempted_at", k, ["attempted_at", "email", "domain", "allowed", "ip", "user_agent"], tie="id")


# ---- marts job --------------------------------------------------------------
#
# A run writes each card into a folder of its own and then commits one manifest
# for the whole dashboard. A reader of a version sees the cards of one run; a
# card that failed is served from its last good run, and the status says so.
# After the commit, ``out/<card>`` gets a plain copy of what is served, for
# readers that take one card by its path and need no common version.

STATUS_SCHEMA = T.StructType(
    [
        T.StructField("card", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("served_run", T.StringType()),  # the run whose rows are served: an older one, or none, if not ok
    ]
)


class Derived:
    """A card made from cards already written: ``build`` gets a function that reads one by name."""

    def __init__(self, build):
        self.build = build


class Board:
    """The cards below ``out`` as of one commit (the latest by default)."""

    def __init__(self, spark: SparkSession, out: str, version: int | None = None):
        self.spark, self.out, self.log = spark, out.rstrip("/"), CommitLog(spark, out)
        self.version = self.log.latest() if version is None else version
        self.manifest = json.loads(self.log.read(self.version)) if self.version else {"cards": {}, "status": []}

    def read(self, card: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{self.manifest['cards'][card]}")

    def status(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r) for r in self.manifest["status"]], STATUS_SCHEMA)

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` commits and delete the card folders that only they named."""
        versions = self.log.versions()
        old, new = (versions[:-keep], versions[-keep:]) if keep > 0 else ([], versions)
        cards = lambda vs: {f for v in vs for f in Board(self.spark, self.out, v).manifest["cards"].values()}
        gone = cards(old) - cards(new)
        for v in old:
            self.log.forget(v)
        for f in gone:
            self.log.delete(f)
        return len(gone)


def _folder(name: str, run: str) -> str:
    return f"_runs/{name}/run={run}"


def _run_card(name: str, build, out: str, run: str) -> tuple:
    t0 = time.time()
    try:
        df, obs = count_on_write(build())
        df.write.parquet(f"{out}/{_folder(name, run)}")
        return (name, True, None, int(obs.get["rows"]), time.time() - t0)
    except Exception as exc:  # noqa: BLE001 - per-card isolation is the point
        return (name, False, f"{type(exc).__name__}: {str(exc)[:500]}", 0, time.time() - t0)


def _copy_cards(spark: SparkSession, out: str, names: list[str], parallel: int) -> None:
    """Plain copies of the cards just committed. Folders of the older layout, ``<card>/run=…``, stay while a commit names them."""
    board = Board(spark, out)
    named = {f.split("/")[0] for v in board.log.versions() for f in Board(spark, out, v).manifest["cards"].values()}

    def copy(name: str) -> None:
        board.read(name).write.mode("overwrite").parquet(f"{out}/{name}")

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        list(pool.map(copy, [n for n in names if n not in named]))


def run_cards(spark: SparkSession, cards: dict, out: str, parallel: int = 4) -> DataFrame:
    """Write the cards of one run and commit them together; returns the status.

    A failing card does not stop the others and never takes its last good
    version away; without one it is served as an empty table when its schema
    can still be planned. Cards are independent Spark jobs and are submitted
    from ``parallel`` threads, so small cards do not wait on each other's job
    latency; ``Derived`` cards follow and read the written ones.
    """
    out, run, before = out.rstrip("/"), uuid.uuid4().hex, Board(spark, out)
    served = {c: f for c, f in before.manifest["cards"].items() if c in cards}
    status = []

    def read(card: str) -> DataFrame:
        return spark.read.parquet(f"{out}/{served[card]}")

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        for derived in (False, True):
            group = {n: (lambda c=c: c.build(read)) if derived else c for n, c in cards.items() if isinstance(c, Derived) == derived}
            done = list(pool.map(lambda item: _run_card(item[0], item[1], out, run), group.items()))
            for name, ok, *_ in done:
                if not ok and name not in served:
                    try:
                        spark.createDataFrame([], group[name]().schema).write.mode("overwrite").parquet(f"{out}/{_folder(name, run)}")
                        ok = True
                    except Exception:  # noqa: BLE001 - it cannot even be planned: no such card yet
                        pass
                if ok:
                    served[name] = _folder(name, run)
            status += done
    status = [(*s, served[s[0]].rsplit("=", 1)[1] if s[0] in served else None) for s in status]
    before.log.commit((before.version or 0) + 1, json.dumps({"cards": served, "status": status}))
    _copy_cards(spark, out, [n for n, f in served.items() if f == _folder(n, run)], parallel)
    return spark.createDataFrame(status, STATUS_SCHEMA)


def materialize_event_view(raw: DataFrame, path: str, as_of=None, strict_json: bool = True) -> DataFrame:
    """Parse, deduplicate and retain once; written by month and sorted by time
    so every card prunes months and row groups. Re-reading it also cuts the
    lineage, so a lost executor only re-runs card stages."""
    view = rawv.event_view(raw, as_of=as_of, strict_json=strict_json)
    if MONTH_COL not in view.columns:
        view = view.withColumn(MONTH_COL, F.date_format("ts", "yyyyMM").cast("int"))
    # no repartition by month (one month would be one task): each task sorts
    # its own rows by (month, ts) and writes one file per month it holds
    view.sortWithinPartitions(MONTH_COL, "ts").write.mode("overwrite").partitionBy(MONTH_COL).parquet(path)
    return raw.sparkSession.read.parquet(path)


def event_cards(
    ev: DataFrame,
    as_of=None,
    steps: list[str] = FUNNEL_STEPS,
    window_days: int = FUNNEL_WINDOW_DAYS,
    start_action: str = CHAT_START_ACTION,
    message_action: str = MESSAGE_ACTION,
) -> dict:
    fun = lambda: funnel.window_funnel(ev, steps, as_of, window_days)
    vol = lambda: events.event_volume(ev, as_of)
    ret = lambda: cohorts.event_retention(ev, as_of)
    return {
        "active_users": lambda: events.active_users(ev, as_of),
        "dau_trend": lambda: events.dau_trend(ev, as_of),
        "event_volume": vol,
        "total_events": Derived(lambda read: events.total_events(read("event_volume"))),
        "top_events": lambda: events.top_events(ev, as_of),
        "top_views": lambda: events.top_views(ev, as_of),
        "platform_breakdown": lambda: events.platform_breakdown(ev, as_of),
        "data_span_days": lambda: events.data_span_days(ev, as_of),
        "funnel": fun,
        "influencer_engagement": lambda: events.influencer_engagement(
            ev, as_of, start_action=start_action, message_action=message_action
        ),
        "message_depth": lambda: events.message_depth(ev, message_action=message_action),
        "returning_user_rate": lambda: events.returning_user_rate(ev),
        "event_retention": ret,
        "event_retention_grid": Derived(lambda read: cohorts.event_grid(read("event_retention"), as_of)),
        "wow": lambda: events.wow(ev, as_of),
        "events_by_action": lambda: events.events_by_action(ev, as_of),
        "recent_activity": lambda: events.recent_activity(ev, as_of),
        "kpi_glance": Derived(lambda read: kpi_glance(read("funnel"), read("active_users"), read("returning_user_rate"))),
    }


def run_event_marts(spark: SparkSession, raw: DataFrame, out: str, as_of=None, **card_args) -> DataFrame:
    ev = materialize_event_view(raw, f"{out.rstrip('/')}/_event_view", as_of=as_of)
    return run_cards(spark, event_cards(ev, as_of, **card_args), out)


def session_cards(sessions: DataFrame, as_of=None, today=None, min_turns: int = ENGAGED_MIN_USER_TURNS, second_days: int = 7) -> dict:
    ret = lambda: cohorts.cohort_retention(sessions, as_of, min_turns=min_turns)
    return {
        "engaged_sessions_today": lambda: headline.engaged_sessions_today(sessions, today if today is not None else as_of, min_turns),
        "second_message_rate": lambda: headline.second_message_rate(sessions, as_of, second_days),
        "w1_return_rate": lambda: headline.w1_return_rate(sessions, as_of, min_turns),
        "cohort_retention": ret,
        "cohort_grid": Derived(lambda read: cohorts.session_grid(read("cohort_retention"), as_of)),
    }


def run_session_marts(spark: SparkSession, sessions: DataFrame, out: str, as_of=None, **card_args) -> DataFrame:
    return run_cards(spark, session_cards(sessions, as_of, **card_args), out)
