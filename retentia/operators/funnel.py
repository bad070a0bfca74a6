"""Ordered conversion funnel with a per-user time window.

Level of a user = the longest prefix of ``steps`` for which events
t1 <= t2 <= ... <= tk exist (one per step, in order, other events in between
allowed) with tk - t1 <= window. Times are truncated to whole seconds; events
in the same second are taken in step order.

Plan (aggregation only). Only step rows are kept. Events in one second are
ordered by step alone, so each (user, second) reduces to a bitmask of the
steps seen: a hash aggregate, combined map-side, so even a user holding a
third of all events is collapsed before the shuffle. Each second becomes a
summary of a time span:

  L     best level reached by chains inside the span
  c_j   latest start of a chain inside the span that reaches level j
  e_i_j earliest completion inside the span of steps i+1..j in order

Summaries compose associatively (X earlier, Y later):
  L     = max(X.L, Y.L, j for every i < j with Y.e_i_j - X.c_i <= window)
  c_j   = max(X.c_j, Y.c_j, X.c_i for every i < j with Y.e_i_j present)
  e_i_j = X.e_i_j, else Y.e_m_j for the largest m with X.e_i_m present
          (as much as possible done in X; m = i when nothing is)
and are folded in time order with ``aggregate`` per (user, minute), per
(user, bucket) and per user: lists of at most 60, bucket/60 and
range/bucket entries. The chain with the latest start is always the best
one to extend, which is why the latest starts and earliest completions are
enough. ``bucket_seconds=None`` runs the direct per-user window scan instead
(reference path, used in tests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import floor_div, ratio
from ..model import FUNNEL_STEPS, FUNNEL_WINDOW_DAYS
from ..sources.raw_events import since


def _step_rows(ev: DataFrame, steps: list[str], as_of, window_days: int) -> DataFrame:
    k = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(steps, start=1))):
        k = F.when(F.col("se_action") == s, F.lit(i)).otherwise(k)
    return (
        since(ev, as_of, window_days * 86400)
        .where(F.col("se_action").isin(*steps))
        .select("u", F.unix_seconds(F.date_trunc("SECOND", F.col("ts"))).alias("sec"), k.alias("k"))
    )


def _bucket_summary(rows: DataFrame, part: list[str], n: int, window: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy("sec", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k, sec = F.col("k"), F.col("sec")
    df = rows.withColumn("A1", F.when(k == 1, sec))
    # latest chain start reaching level j, as seen at each row
    for j in range(2, n + 1):
        df = df.withColumn(f"a{j - 1}", F.max(f"A{j - 1}").over(w))
        df = df.withColumn(f"A{j}", F.when(k == j, F.col(f"a{j - 1}")))
    ok = [F.when(k == 1, F.lit(1))] + [
        F.when((k == j) & (sec - F.col(f"A{j}") <= window), F.lit(j)) for j in range(2, n + 1)
    ]
    df = df.withColumn("_lvl", F.greatest(*ok, F.lit(0)) if len(ok) > 1 else F.coalesce(ok[0], F.lit(0)))
    # earliest in-bucket completion of steps i+1..j (greedy: earliest each step)
    for i in range(1, n):
        df = df.withColumn(f"G{i}_{i + 1}", F.when(k == i + 1, sec))
        for j in range(i + 2, n + 1):
            df = df.withColumn(f"g{i}_{j - 1}", F.min(f"G{i}_{j - 1}").over(w))
            df = df.withColumn(f"G{i}_{j}", F.when((k == j) & F.col(f"g{i}_{j - 1}").isNotNull(), sec))
    aggs = [F.max("_lvl").cast("int").alias("L")]
    aggs += [F.max(f"A{j}").alias(f"c{j}") for j in range(1, n)]
    aggs += [F.min(f"G{i}_{j}").alias(f"e{i}_{j}") for i in range(1, n) for j in range(i + 1, n + 1)]
    return df.groupBy(*part).agg(*aggs)


def _fields(n: int) -> list[str]:
    return ["L"] + [f"c{j}" for j in range(1, n)] + [f"e{i}_{j}" for i in range(1, n) for j in range(i + 1, n + 1)]


def _second_summary(n: int) -> list[str]:
    """Summary of one second from the bitmask of steps seen in it (events in
    one second are taken in step order, so only the set matters)."""

    def has(lo: int, hi: int) -> str:  # steps lo..hi all present
        bits = sum(1 << (s - 1) for s in range(lo, hi + 1))
        return f"(_mask & {bits}) = {bits}"

    cols = ["greatest(" + ", ".join(f"CASE WHEN {has(1, j)} THEN {j} END" for j in range(1, n + 1)) + ", 0) AS L"]
    cols += [f"CASE WHEN {has(1, j)} THEN sec END AS c{j}" for j in range(1, n)]
    cols += [f"CASE WHEN {has(i + 1, j)} THEN sec END AS e{i}_{j}" for i in range(1, n) for j in range(i + 1, n + 1)]
    return cols


def _compose_sql(n: int, window: int) -> str:
    """SQL lambda body composing summary ``acc`` (earlier) with ``x`` (later)."""
    lvl = ["acc.L", "x.L"] + [
        f"CASE WHEN x.e{i}_{j} - acc.c{i} <= {window} THEN {j} END" for i in range(1, n) for j in range(i + 1, n + 1)
    ]
    parts = [f"'L', greatest({', '.join(lvl)})"]
    for j in range(1, n):
        terms = [f"acc.c{j}", f"x.c{j}"] + [f"CASE WHEN x.e{i}_{j} IS NOT NULL THEN acc.c{i} END" for i in range(1, j)]
        parts.append(f"'c{j}', greatest({', '.join(terms)})")
    for i in range(1, n):
        for j in range(i + 1, n + 1):
            # done in acc if possible; else do as much as acc can (steps i+1..m) and finish m+1..j in x
            whens = " ".join(f"WHEN acc.e{i}_{m} IS NOT NULL THEN x.e{m}_{j}" for m in range(j - 1, i, -1))
            parts.append(f"'e{i}_{j}', coalesce(acc.e{i}_{j}, CASE {whens} ELSE x.e{i}_{j} END)" if whens else f"'e{i}_{j}', coalesce(acc.e{i}_{j}, x.e{i}_{j})")
    return "named_struct(" + ", ".join(parts) + ")"


def _fold(n: int, window: int) -> F.Column:
    fields = _fields(n)
    items = ", ".join(f"'{f}', {f}" for f in ["_k"] + fields)
    zero = "named_struct(" + ", ".join(["'L', 0"] + [f"'{f}', CAST(NULL AS BIGINT)" for f in fields[1:]]) + ")"
    body = _compose_sql(n, window)
    return F.expr(f"aggregate(array_sort(collect_list(named_struct({items}))), {zero}, (acc, x) -> {body})")


def funnel_levels(
    ev: DataFrame,
    steps: list[str] = FUNNEL_STEPS,
    as_of=None,
    window_days: int = FUNNEL_WINDOW_DAYS,
    bucket_seconds: int | None = 3600,
    window_seconds: int | None = None,
    include_anonymous: bool = True,
) -> DataFrame:
    """(u, level) for every user with at least one step event in the last
    ``window_days`` days. The chain window is ``window_days`` days unless
    ``window_seconds`` is given. Events without a user id belong to the one
    user ''; ``include_anonymous=False`` leaves them out.

    Default plan (aggregation only): per (user, second) a bitmask of the steps
    seen (hash aggregate, map-side combined), turned into a one-second summary;
    summaries are composed in time order per (user, minute), per (user,
    ``bucket_seconds``) and per user. Each list holds at most 60, then
    bucket/60, then range/bucket entries. ``bucket_seconds=None`` instead
    scans each user's rows whole with window functions (reference path).
    """
    if len(set(steps)) != len(steps):
        raise ValueError("funnel steps must be distinct")
    n = len(steps)
    if n > 62:
        raise ValueError("at most 62 funnel steps")
    window = window_days * 86400 if window_seconds is None else int(window_seconds)
    rows = _step_rows(ev, steps, as_of, window_days)
    if not include_anonymous:
        rows = rows.where(F.col("u") != "")
    if not bucket_seconds:
        return _bucket_summary(rows, ["u"], n, window).select("u", F.col("L").alias("level"))
    seconds = rows.groupBy("u", "sec").agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), k - 1)")).alias("_mask"))
    # _k = start second of the (sub)bucket; buckets keep time order, so any
    # nesting of bucket sizes composes correctly
    summary = seconds.selectExpr("u", "sec AS _k", *_second_summary(n))
    fields = _fields(n)
    for size in sorted({min(60, bucket_seconds), bucket_seconds}):
        summary = (
            summary.groupBy("u", (floor_div(F.col("_k"), size) * F.lit(size)).alias("_b"))
            .agg(_fold(n, window).alias("_s"))
            .select("u", F.col("_b").alias("_k"), *[F.col(f"_s.{f}").alias(f) for f in fields])
        )
    return summary.groupBy("u").agg(_fold(n, window).alias("_s")).select("u", F.col("_s.L").cast("int").alias("level"))


def funnel_steps(levels: DataFrame, steps: list[str] = FUNNEL_STEPS) -> DataFrame:
    """One row per step: users who reached it (level >= step_no), conversion
    against step 1 (NULL when nobody reached step 1) and drop-off from the
    previous step ((prev - cur) / prev; NULL for step 1 or prev = 0)."""
    if not steps:
        return levels.sparkSession.createDataFrame([], "step_no int, step string, users bigint, conversion double, dropoff double")
    n = len(steps)
    counts = levels.agg(*[F.expr(f"count_if(level >= {i}) AS s{i}") for i in range(1, n + 1)])

    def ratio_sql(num: str, den: str) -> str:
        return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"

    rows = []
    for i, name in enumerate(steps, start=1):
        drop = "CAST(NULL AS DOUBLE)" if i == 1 else ratio_sql(f"s{i - 1} - s{i}", f"s{i - 1}")
        quoted = name.replace("'", "\\'")
        rows.append(
            f"named_struct('step_no', {i}, 'step', '{quoted}', 'users', s{i}, "
            f"'conversion', {ratio_sql(f's{i}', 's1')}, 'dropoff', {drop})"
        )
    return counts.selectExpr(f"explode(array({', '.join(rows)})) AS r").selectExpr("r.*")


def window_funnel(
    ev: DataFrame,
    steps: list[str] = FUNNEL_STEPS,
    as_of=None,
    window_days: int = FUNNEL_WINDOW_DAYS,
    bucket_seconds: int | None = 3600,
    window_seconds: int | None = None,
    include_anonymous: bool = True,
) -> DataFrame:
    return funnel_steps(
        funnel_levels(ev, steps, as_of, window_days, bucket_seconds, window_seconds, include_anonymous), steps
    )

