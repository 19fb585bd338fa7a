"""Questions to the ingest journal."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.config import QUOTES_SOURCE, Settings
from tradeaxis.operators import calendar as cal
from tradeaxis.operators import journal as jr
from tradeaxis.plans.q_store import sql_window
from tradeaxis.plans.registry import ASOF, register
from tradeaxis.views import Views

DEPTH = Settings().price_window


def _window(v: Views) -> cal.SessionWindow:
    return cal.window(v.session, ASOF, DEPTH)


@register(
    "c05_collected_since",
    """select count(*) > 0 as collected from v_ingest_run where status = 'ok' and source_id not in ('trading_calendar')
      and (finished_at is null or (finished_at > timestamp '2001-07-20 00:00:00' and rows_written > 0))""",
)
def collected_since(v: Views) -> DataFrame:
    moment = F.lit("2001-07-20 00:00:00").cast("timestamp")
    return jr.collected_since(v.ingest_run, moment, ["trading_calendar"])


@register(
    "e07_sessions_with_ok_run",
    f"""select distinct session_date from v_ingest_run where status = 'ok' and source_id = 'equity_d1'
      and session_date in {sql_window()}""",
)
def sessions_with_ok_run(v: Views) -> DataFrame:
    return jr.sessions_with_ok_run(v.ingest_run, _window(v), [QUOTES_SOURCE])


@register(
    "e10_attempts_by_session",
    f"""select session_date, count(distinct run_id) as attempts from v_ingest_run
      where session_date in {sql_window()} group by session_date""",
)
def attempts_by_session(v: Views) -> DataFrame:
    return jr.attempts_by_session(v.ingest_run, _window(v))


@register(
    "e11_last_attempt_by_session",
    f"""select session_date, max(started_at) as last_attempt from v_ingest_run
      where session_date in {sql_window()} and source_id = 'equity_d1' group by session_date""",
)
def last_attempt_by_session(v: Views) -> DataFrame:
    return jr.last_attempt_by_session(v.ingest_run, _window(v), QUOTES_SOURCE)


@register("e12_latest_mark", "select max(started_at) as latest_ingest_at from v_ingest_run")
def latest_mark(v: Views) -> DataFrame:
    return jr.latest_mark(v.ingest_run)


@register(
    "e13_last_success",
    "select source_id, max(started_at) as last_success_at from v_ingest_run where status = 'ok' group by source_id",
)
def last_success(v: Views) -> DataFrame:
    return jr.last_success(v.ingest_run)


@register(
    "e22_run_rollup",
    """select run_id, count(*) filter (where status = 'failed') = 0 as succeeded, coalesce(string_agg(distinct
      case when status = 'failed' then source_id end, ',' order by case when status = 'failed' then source_id end), '')
      as unfinished_sources from v_ingest_run group by run_id""",
)
def run_rollup(v: Views) -> DataFrame:
    return jr.run_rollup(v.ingest_run)


@register(
    "f15_upsert_outcome",
    """select a.run_id, a.source_id, a.id, a.session_date, a.started_at, d.status, d."trigger", d.failure_reason,
        d.rows_written, d.finished_at from
      (select *, row_number() over (partition by run_id, source_id order by started_at, id) as rn from v_ingest_run) a
      join (select *, row_number() over (partition by run_id, source_id order by started_at desc, id desc) as rn from v_ingest_run) d
        on a.run_id = d.run_id and a.source_id = d.source_id and a.rn = 1 and d.rn = 1""",
)
def upsert_outcome(v: Views) -> DataFrame:
    return jr.upsert_outcome(v.ingest_run, ["started_at", "id"])


@register(
    "g02_latest_failed_runs",
    f"""select session_date, source_id, failure_reason as reason from (select *, row_number() over
      (partition by session_date, source_id order by started_at desc, id desc) as rn from v_ingest_run
      where session_date in {sql_window()}) r where rn = 1 and status = 'failed'""",
)
def latest_failed_runs(v: Views) -> DataFrame:
    return jr.unfinished(v.ingest_run, _window(v))


@register(
    "g03_runs_of_session",
    """select id, run_id, source_id, status, "trigger", failure_reason, rows_written, started_at, finished_at
      from v_ingest_run where session_date = date '2001-07-15'""",
)
def runs_of_session(v: Views) -> DataFrame:
    return jr.runs_in_order(v.ingest_run, dt.date(2001, 7, 15)).drop("session_date")


@register(
    "g15_failure_streak",
    """with m as (select source_id, max(case when status = 'ok' then (started_at, id) end) as last_ok from v_ingest_run group by source_id)
      select j.source_id, count(*) filter (where j.status = 'failed' and (m.last_ok is null or (j.started_at, j.id) > m.last_ok)) as consecutive_failures,
        count(*) as attempts, count(*) filter (where j.status = 'failed' and (m.last_ok is null or (j.started_at, j.id) > m.last_ok)) < 3 as is_open
      from v_ingest_run j join m using (source_id) group by j.source_id""",
)
def failure_streak(v: Views) -> DataFrame:
    return jr.source_health(v.ingest_run, Settings().source_failure_streak)


@register(
    "g15_failure_streak_by_run",
    """select run_id, source_id, count(*) filter (where status = 'failed' and ok_after = 0) as consecutive_failures, count(*) as attempts,
        count(*) filter (where status = 'failed' and ok_after = 0) < 3 as is_open
      from (select run_id, source_id, status, count(*) filter (where status = 'ok') over (partition by run_id, source_id order by started_at, id
        rows between current row and unbounded following) as ok_after from v_ingest_run) t group by run_id, source_id""",
)
def failure_streak_by_run(v: Views) -> DataFrame:
    limit = Settings().source_failure_streak
    return jr.source_health(v.ingest_run, limit, ["run_id", "source_id"])


@register(
    "g15_streak_segments",
    """select source_id, cast(started_at as date) as slice, count(*) as attempts, count(*) filter (where status = 'failed' and ok_after = 0) as failures_at_end,
        bool_or(status = 'ok') as had_success
      from (select *, count(*) filter (where status = 'ok') over (partition by source_id, cast(started_at as date) order by started_at, id
        rows between current row and unbounded following) as ok_after from v_ingest_run) t group by 1, 2""",
)
def streak_segments(v: Views) -> DataFrame:
    """What each day says about each source; streaks are put together from these."""
    ok, bad = F.col("status") == jr.OK, F.col("status") == jr.FAILED
    return jr.streak_segments(v.ingest_run, ["source_id"], ["started_at", "id"], ok, bad).drop("first_at", "last_at")


@register(
    "m02_session_gate",
    """select session_date, 'equity_d1' as source_id, 'skipped' as status, 'не торговая сессия' as failure_reason
      from (select distinct cast(l_shipdate as date) as session_date from lineitem) d
      where session_date not in (select session_date from v_session)""",
)
def session_gate(v: Views) -> DataFrame:
    landed = v.lineitem.select(F.to_date("l_shipdate").alias("session_date"))
    return jr.gate(landed, v.session)[1]


_PROGRESS_SQL = """with r as (select distinct run_id, session_date from v_ingest_run),
      o as (select run_id, session_date, status from (select *, row_number() over (partition by run_id, session_date
        order by started_at desc, id desc) as rn from v_ingest_run where source_id = 'equity_d1') t where rn = 1)
      select r.run_id, count(*) as requested, count(*) filter (where o.status is not null and o.status <> 'failed') as closed,
        count(*) filter (where o.status = 'failed') as failed, count(*) filter (where o.status is null) as remaining
      from r left join o using (run_id, session_date) group by r.run_id"""


@register("m07_run_progress", _PROGRESS_SQL)
def run_progress(v: Views) -> DataFrame:
    requested = v.ingest_run.select("run_id", "session_date").distinct()
    return jr.progress(requested, v.ingest_run)
