"""Coverage, gaps and readiness as set differences between the calendar and stored data.

A session is closed for a group when it has a filled observation or a successful run of one of the
group's sources. The first covers range sources, which journal a single day for a whole period; the
second covers "the exchange answered, there was nothing".

Fact tables are reduced to distinct ``(group, session)`` pairs by partial aggregation before
anything else happens, and everything after that is as small as the calendar.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeaxis.config import GROUPS, QUOTES_SOURCE, Settings, SourceGroup
from tradeaxis.functions import money
from tradeaxis.operators import calendar as cal
from tradeaxis.operators import journal as jr
from tradeaxis.operators.calendar import SessionWindow
from tradeaxis.operators.store import filled
from tradeaxis.session import local_frame

Tables = Mapping[str, DataFrame]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def observed_sessions(
    df: DataFrame, value_columns: Sequence[str], window: SessionWindow | None
) -> DataFrame:
    """Sessions with at least one filled row. An empty window holds nothing."""
    return _filled_days(df, value_columns, window).distinct()


def _filled_days(
    df: DataFrame, value_columns: Sequence[str], window: SessionWindow | None
) -> DataFrame:
    rows = df.filter(filled(value_columns))
    if window is not None:
        rows = rows.filter(window.contains())
    return rows.select("session_date")


def sessions_with_bars(bars: DataFrame, window: SessionWindow) -> DataFrame:
    return bars.filter(window.contains()).select("session_date").distinct()


def group_windows(
    groups: Sequence[SourceGroup], calendar: DataFrame, settings: Settings, asof: dt.date
) -> dict[str, SessionWindow]:
    """The window of each group with history, all ending on one date."""
    depths = {g.group_id: settings.window_of(g) for g in groups if g.has_history}
    return cal.windows(calendar, asof, depths)


def missing_sessions(
    group: SourceGroup, table: DataFrame, journal: DataFrame, window: SessionWindow
) -> DataFrame:
    """Sessions of the window the group is not closed for; a reference group has none."""
    axis = window.axis(journal.sparkSession).select("session_date")
    if not group.has_history or not len(window):
        return axis.limit(0)
    covered = _filled_days(table, group.value_columns, window).unionByName(
        jr.ok_days(journal, window, group.source_ids)
    )
    return axis.join(covered.distinct(), "session_date", "left_anti")


def missing_by_group(
    groups: Sequence[SourceGroup],
    tables: Tables,
    journal: DataFrame,
    windows: Mapping[str, SessionWindow],
) -> DataFrame:
    """``(group_id, session_date)`` still to be collected, each group within its own window."""
    parts = [
        missing_sessions(g, tables[g.table], journal, windows[g.group_id]).select(
            F.lit(g.group_id).alias("group_id"), "session_date"
        )
        for g in groups
        if g.has_history and len(windows[g.group_id])
    ]
    if not parts:
        nothing = journal.limit(0).select("session_date")
        return nothing.select(F.lit("").alias("group_id"), "session_date")
    return _union(parts)


def incomplete_groups(missing: DataFrame) -> DataFrame:
    """Groups with something missing and their sessions, at most one window each."""
    return missing.groupBy("group_id").agg(
        F.count("*").alias("missing_count"),
        F.array_sort(F.collect_list("session_date")).alias("missing_sessions"),
    )


def group_coverage(
    table: DataFrame,
    value_columns: Sequence[str],
    session_column: str | None,
    window: SessionWindow | None,
) -> DataFrame:
    """Covered sessions, period, rows and filled rows; no window means the whole table.

    Counts per session come first, so the distinct count costs no second pass over the rows.
    """
    has_value = filled(value_columns)
    if session_column is None:
        return table.agg(
            F.lit(None).cast("bigint").alias("sessions_covered"),
            F.lit(None).cast("date").alias("period_from"),
            F.lit(None).cast("date").alias("period_till"),
            F.count("*").alias("rows_total"),
            F.count_if(has_value).alias("rows_with_values"),
        )
    scope = (
        window.contains(session_column)
        if window is not None and len(window)
        else F.col(session_column).isNotNull()
    )
    daily = (
        table.filter(scope)
        .groupBy(session_column)
        .agg(F.count("*").alias("n"), F.count_if(has_value).alias("v"))
    )
    return daily.agg(
        F.count(session_column).alias("sessions_covered"),
        F.min(session_column).alias("period_from"),
        F.max(session_column).alias("period_till"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("rows_with_values"),
    )


def coverage_report(
    tables: Tables, calendar: DataFrame, settings: Settings, asof: dt.date
) -> DataFrame:
    """One row per group: coverage in sessions beside the part of rows that hold a value."""
    parts = []
    windows = group_windows(GROUPS, calendar, settings, asof)
    for group in GROUPS:
        window = windows.get(group.group_id)
        raw = group_coverage(
            tables[group.table], group.value_columns, group.session_column, window
        )
        size = len(window) if window is not None else None
        parts.append(
            raw.select(
                F.lit(group.group_id).alias("group_id"),
                F.lit(group.title).alias("title"),
                F.lit(group.has_history).alias("has_history"),
                F.lit(size).cast("bigint").alias("window_sessions"),
                "*",
            )
        )
    report = _union(parts)
    return (
        report.withColumn("gaps", F.col("window_sessions") - F.col("sessions_covered"))
        .withColumn("coverage_ratio", money.ratio4("sessions_covered", "window_sessions"))
        .withColumn("value_ratio", money.ratio4("rows_with_values", "rows_total"))
        .withColumn(
            "looks_collected_but_empty",
            money.collected_but_empty("coverage_ratio", "value_ratio"),
        )
    )


def gap_report(
    calendar: DataFrame,
    bars: DataFrame,
    journal: DataFrame,
    asof: dt.date,
    settings: Settings,
    window: SessionWindow | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Missing sessions, unfinished sources and the ``needs_backfill`` flag of the window.

    Without any bars at all no session counts as missing and the flag is set.
    """
    window = window or cal.window(calendar, asof, settings.catchup_depth)
    axis = window.axis(calendar.sparkSession).select("session_date")
    empty = bars.limit(1).agg((F.count("*") == 0).alias("needs_backfill"))
    is_empty = empty.scalar()
    covered = (
        bars.filter(window.contains())
        .select("session_date")
        .unionByName(jr.ok_days(journal, window, [QUOTES_SOURCE]))
    )
    missing = axis.filter(~is_empty).join(covered.distinct(), "session_date", "left_anti")
    unfinished = jr.unfinished(journal, window).filter(~is_empty)
    return missing, unfinished, empty


def incomplete_by_session(missing: DataFrame, unfinished: DataFrame) -> DataFrame:
    """Session to its sorted unfinished sources: one source missing does not spoil the session."""
    pairs = missing.select("session_date", F.lit(QUOTES_SOURCE).alias("source_id")).unionByName(
        unfinished.select("session_date", "source_id")
    )
    return pairs.groupBy("session_date").agg(
        F.array_sort(F.collect_set("source_id")).alias("sources")
    )


def closed_sessions(
    groups: Sequence[SourceGroup],
    tables: Tables,
    journal: DataFrame,
    window: SessionWindow | None = None,
) -> DataFrame:
    """Distinct ``(group_id, session_date)`` closed for each group, in a window or ever."""
    observed = [
        _filled_days(tables[g.table], g.value_columns, window).select(
            F.lit(g.group_id).alias("group_id"), "session_date"
        )
        for g in groups
        if g.has_history
    ]
    owner = F.create_map(
        *[F.lit(x) for g in groups for source in g.source_ids for x in (source, g.group_id)]
    )
    dated = F.col("session_date").isNotNull() if window is None else window.contains()
    ran = (
        journal.filter((F.col("status") == jr.OK) & dated)
        .select(F.try_element_at(owner, F.col("source_id")).alias("group_id"), "session_date")
        .filter(F.col("group_id").isNotNull())
    )
    return _union([*observed, ran]).distinct()


def readiness(
    calendar: DataFrame,
    closed: DataFrame,
    groups: Sequence[SourceGroup],
    settings: Settings,
) -> DataFrame:
    """For every session taken as decision date: is each required window whole and closed.

    A window shorter than required is incomplete input as well. One rolling count over the calendar
    replaces a walk over the dates; the rows are sessions times groups.
    """
    depths = [(g.group_id, settings.window_of(g)) for g in groups if g.has_history]
    if not depths:
        return calendar.select(
            "session_date",
            F.lit(True).alias("ready"),
            F.array().cast("array<string>").alias("missing_groups"),
        )
    ids = F.array(*[F.lit(g) for g, _ in depths])
    grid = calendar.select("session_date", F.explode(ids).alias("group_id"))
    marked = grid.join(
        closed.withColumn("closed", F.lit(1)), ["group_id", "session_date"], "left"
    ).withColumn("closed", F.coalesce("closed", F.lit(0)))
    ordered = Window.partitionBy("group_id").orderBy("session_date")
    whole = F.lit(False)
    for group_id, depth in depths:
        frame = ordered.rowsBetween(-(depth - 1), 0)
        whole = F.when(
            F.col("group_id") == group_id, F.sum("closed").over(frame) == depth
        ).otherwise(whole)
    per_group = marked.withColumn("whole", whole)
    return per_group.groupBy("session_date").agg(
        F.every("whole").alias("ready"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("group_id")))).alias(
            "missing_groups"
        ),
    )


def recent_readiness(
    calendar: DataFrame,
    tables: Tables,
    journal: DataFrame,
    groups: Sequence[SourceGroup],
    settings: Settings,
    not_after: dt.date,
) -> DataFrame:
    """Readiness of the sessions of the catch-up window, reading no more history than they need.

    The oldest of them looks back over the deepest group window, so that is where reading starts.
    """
    deepest = max((settings.window_of(g) for g in groups if g.has_history), default=1)
    reach = cal.window(calendar, not_after, settings.catchup_depth + deepest - 1)
    axis = reach.axis(calendar.sparkSession).select("session_date")
    closed = closed_sessions(groups, tables, journal, reach)
    asked = SessionWindow(reach.dates[-settings.catchup_depth :])
    return readiness(axis, closed, groups, settings).filter(asked.contains())


def readiness_of(states: DataFrame, asof: dt.date) -> DataFrame:
    """Readiness of one date; a day that is not a session is never ready."""
    spark = states.sparkSession
    asked = local_frame(spark, [(asof,)], session_date=pa.date32())
    none = F.array().cast("array<string>")
    return asked.join(states, "session_date", "left").select(
        F.col("session_date").alias("asof_date"),
        F.coalesce("ready", F.lit(False)).alias("ready"),
        F.col("ready").isNotNull().alias("is_session"),
        F.coalesce("missing_groups", none).alias("missing_groups"),
    )


def latest_ready(
    calendar: DataFrame, states: DataFrame, not_after: dt.date, settings: Settings
) -> DataFrame:
    """The newest ready session no deeper than the catch-up window."""
    window = cal.window(calendar, not_after, settings.catchup_depth)
    ready = states.filter(window.contains() & F.col("ready"))
    return ready.agg(F.max("session_date").alias("latest_ready"))


def blocking_groups(
    spark: SparkSession, states: DataFrame, calendar: DataFrame, not_after: dt.date, settings: Settings
) -> DataFrame:
    """What the last session lacks, with titles, when it is not the latest ready one."""
    ready = latest_ready(calendar, states, not_after, settings).scalar()
    last = cal.latest_session(calendar, not_after).scalar()
    titles = [(g.group_id, g.title) for g in GROUPS]
    registry = local_frame(spark, titles, group_id=pa.string(), title=pa.string())
    behind = states.filter(
        (F.col("session_date") == last) & (ready.isNull() | (ready != last))
    )
    names = behind.select(F.explode("missing_groups").alias("group_id"))
    return names.join(F.broadcast(registry), "group_id", "left").select(
        "group_id", F.coalesce("title", "group_id").alias("title")
    )


def dataset_is_complete(
    declarations: DataFrame, settings: Settings, key: Sequence[str] = ("asof_date",)
) -> DataFrame:
    """The declaration's own word: no required source among the unfinished ones.

    ``declarations`` carries ``incomplete``, an array of ``{session_date, sources}``.
    """
    required = F.array(*[F.lit(s) for g in settings.required() for s in g.source_ids])
    hit = F.exists("incomplete", lambda row: F.arrays_overlap(row["sources"], required))
    return declarations.select(*key, (~F.coalesce(hit, F.lit(False))).alias("complete"))


def incomplete_closed_sessions(
    tables: Tables,
    journal: DataFrame,
    calendar: DataFrame,
    settings: Settings,
    now_utc: Column,
    today: dt.date,
) -> tuple[DataFrame, SessionWindow]:
    """Closed sessions some required group is not closed for, each within its own depth."""
    known = cal.window(calendar, today, settings.catchup_depth)
    closed = cal.withhold_open(
        known.axis(calendar.sparkSession), now_utc, settings.ingest_after_close
    )
    days = sorted(r.session_date for r in closed.select("session_date").collect())
    allowed = SessionWindow(tuple(days))
    if not days:
        return closed.select("session_date"), allowed
    inside = group_windows(settings.required(), calendar, settings, days[-1])
    windows = {
        name: SessionWindow(tuple(d for d in w.dates if d in set(days)))
        for name, w in inside.items()
    }
    missing = missing_by_group(settings.required(), tables, journal, windows)
    return missing.select("session_date").distinct(), allowed


def pending_sessions(
    missing: DataFrame,
    window: SessionWindow,
    journal: DataFrame,
    settings: Settings,
    now_utc: Column,
) -> DataFrame:
    """Incomplete sessions that may be tried now: attempts left, and not tried too recently."""
    attempts = jr.attempts_by_session(journal, window)
    tried = jr.last_attempt_by_session(journal, window, QUOTES_SOURCE)
    delay = settings.retry_after_minutes * 60 * 1_000_000
    since = F.unix_micros(now_utc.cast("timestamp")) - F.unix_micros("last_attempt")
    rested = F.lit(True) if delay <= 0 else F.coalesce(since >= delay, F.lit(True))
    left = F.coalesce("attempts", F.lit(0)) < settings.session_max_attempts
    return (
        missing.join(attempts, "session_date", "left")
        .join(tried, "session_date", "left")
        .filter(left & rested)
        .select("session_date")
    )


def catchup_plan(
    missing: DataFrame,
    groups: Sequence[SourceGroup],
    date_from: dt.date | None,
    date_till: dt.date | None,
) -> DataFrame:
    """Missing sessions inside the asked range with the sources to ask, oldest first."""
    sources = sorted({s for g in groups for s in g.source_ids})
    planned = cal.clamp(missing, date_from, date_till)
    wanted = F.array(*[F.lit(s) for s in sources]).cast("array<string>")
    return planned.withColumn("sources", wanted).orderBy("session_date")
