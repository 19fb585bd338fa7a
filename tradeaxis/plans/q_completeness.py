"""Coverage, gaps, readiness and pending work."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.config import GROUPS, Settings
from tradeaxis.operators import calendar as cal
from tradeaxis.operators import completeness as comp
from tradeaxis.operators import maintained as mt
from tradeaxis.plans.q_store import sql_window
from tradeaxis.plans.registry import ASOF, register
from tradeaxis.schema import POSITION_VALUES
from tradeaxis.session import scratch_path
from tradeaxis.views import Views

SETTINGS = Settings()
# Depths at which some dates are ready and some are not on the driver's tables.
SHALLOW = Settings(price_window=12, global_window=12, positions_window=6)
DEPTH, DEPTH_POSITIONS = SETTINGS.price_window, SETTINGS.positions_window
BY_ID = {g.group_id: g for g in GROUPS}

_SQL_TABLE = {
    "quotes": "v_bar",
    "aggregates": "v_aggregate",
    "global": "v_global",
    "positions": "v_position",
    "reference": "v_sector",
}
HISTORY = [g for g in GROUPS if g.has_history]


def _filled_sql(group_id: str) -> str:
    return f"coalesce({', '.join(BY_ID[group_id].value_columns)}, null) is not null"


def _depth(group_id: str, settings: Settings = SETTINGS) -> int:
    return settings.window_of(BY_ID[group_id]) or 0


def _missing_sql(group_id: str, depth: int, asof: dt.date = ASOF) -> str:
    sources = ", ".join(f"'{s}'" for s in BY_ID[group_id].source_ids)
    return f"""select session_date from {sql_window(depth, asof)} w where session_date not in
        (select session_date from {_SQL_TABLE[group_id]} where {_filled_sql(group_id)})
      and session_date not in (select session_date from v_ingest_run where status = 'ok' and source_id in ({sources}))"""


_CLOSED_SQL = " union ".join(
    f"""select '{g.group_id}' as group_id, session_date from {_SQL_TABLE[g.group_id]} where {_filled_sql(g.group_id)}
      union select '{g.group_id}', session_date from v_ingest_run where status = 'ok'
        and source_id in ({', '.join(f"'{s}'" for s in g.source_ids)})"""
    for g in HISTORY
)


@register(
    "e05_sessions_with_observations",
    f"""select distinct session_date from v_position where {_filled_sql("positions")}
      and session_date in {sql_window(DEPTH_POSITIONS)}""",
)
def sessions_with_observations(v: Views) -> DataFrame:
    window = cal.window(v.session, ASOF, DEPTH_POSITIONS)
    return comp.observed_sessions(v.position, POSITION_VALUES, window)


@register(
    "e06_sessions_with_bars",
    f"select distinct session_date from v_bar where session_date in {sql_window()}",
)
def sessions_with_bars(v: Views) -> DataFrame:
    return comp.sessions_with_bars(v.bar, cal.window(v.session, ASOF, DEPTH))


def _coverage_sql(group_id: str, scope: str) -> str:
    return f"""select count(distinct session_date) as sessions_covered, min(session_date) as period_from, max(session_date) as period_till,
      count(*) as rows_total, count(*) filter (where {_filled_sql(group_id)}) as rows_with_values from {_SQL_TABLE[group_id]} where {scope}"""


@register(
    "e08_group_coverage_raw",
    _coverage_sql("positions", f"session_date in {sql_window(DEPTH_POSITIONS)}"),
)
def group_coverage_raw(v: Views) -> DataFrame:
    window = cal.window(v.session, ASOF, DEPTH_POSITIONS)
    return comp.group_coverage(v.position, POSITION_VALUES, "session_date", window)


@register("e08_whole_table_coverage", _coverage_sql("quotes", "session_date is not null"))
def whole_table_coverage(v: Views) -> DataFrame:
    return comp.group_coverage(v.bar, ("close",), "session_date", None)


def _report_sql() -> str:
    parts = []
    for g in GROUPS:
        head = f"select '{g.group_id}' as group_id, '{g.title}' as title, {str(g.has_history).lower()} as has_history"
        if g.has_history:
            depth = _depth(g.group_id)
            size = f"(select count(*) from {sql_window(depth)} w)"
            parts.append(
                f"{head}, {size} as window_sessions, c.* from ({_coverage_sql(g.group_id, f'session_date in {sql_window(depth)}')}) c"
            )
        else:
            parts.append(
                f"{head}, null as window_sessions, null as sessions_covered, null as period_from, null as period_till, "
                f"count(*) as rows_total, count(*) filter (where {_filled_sql(g.group_id)}) as rows_with_values from {_SQL_TABLE[g.group_id]}"
            )
    ratios = """cast(round_even(sessions_covered / cast(window_sessions as double), 4) as decimal(18,4)) as coverage_ratio,
      case when rows_total > 0 then cast(round_even(rows_with_values / cast(rows_total as double), 4) as decimal(18,4)) end as value_ratio"""
    return f"""select *, coalesce(coverage_ratio > 0 and value_ratio < 0.01, false) as looks_collected_but_empty from (
      select *, window_sessions - sessions_covered as gaps, {ratios} from ({" union all ".join(parts)}) r) q"""


@register("e09_coverage_report", _report_sql())
def coverage_report(v: Views) -> DataFrame:
    return comp.coverage_report(v.tables, v.session, SETTINGS, ASOF)


def _missing(v: Views, group_id: str, depth: int) -> DataFrame:
    group = BY_ID[group_id]
    window = cal.window(v.session, ASOF, depth)
    return comp.missing_sessions(group, v.tables[group.table], v.ingest_run, window)


@register("h01_missing_positions", _missing_sql("positions", DEPTH_POSITIONS))
def missing_positions(v: Views) -> DataFrame:
    return _missing(v, "positions", DEPTH_POSITIONS)


@register("h01_missing_aggregates", _missing_sql("aggregates", 1800))
def missing_aggregates(v: Views) -> DataFrame:
    return _missing(v, "aggregates", 1800)


_BY_GROUP_SQL = " union all ".join(
    f"select '{g.group_id}' as group_id, session_date from ({_missing_sql(g.group_id, _depth(g.group_id))}) m"
    for g in HISTORY
)


@register(
    "h02_incomplete_groups",
    f"""select group_id, count(*) as missing_count, string_agg(cast(session_date as varchar), ',' order by session_date) as missing_sessions
      from ({_BY_GROUP_SQL}) g group by group_id""",
)
def incomplete_groups(v: Views) -> DataFrame:
    windows = comp.group_windows(GROUPS, v.session, SETTINGS, ASOF)
    return comp.incomplete_groups(comp.missing_by_group(GROUPS, v.tables, v.ingest_run, windows))


# Quotes as if nothing had been stored for one weekday, so that the gap report has gaps.
_HOLED = "(select * from v_bar where dayofweek(session_date) <> 3)"
_GAP_SQL = f"""select session_date from {sql_window()} w where session_date not in (select session_date from {_HOLED} b)
      and session_date not in (select session_date from v_ingest_run where status = 'ok' and source_id = 'equity_d1')"""
_UNFINISHED_SQL = f"""select session_date, source_id, failure_reason as reason from (select *, row_number() over (partition by session_date, source_id
      order by started_at desc, id desc) as rn from v_ingest_run where session_date in {sql_window()}) r where rn = 1 and status = 'failed'"""


def _holed(v: Views) -> DataFrame:
    return v.bar.filter(F.dayofweek("session_date") != 4)


def _gaps(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    return comp.gap_report(v.session, _holed(v), v.ingest_run, ASOF, SETTINGS)


@register("h03_gap_report", f"select session_date, (select count(*) = 0 from v_bar) as needs_backfill from ({_GAP_SQL}) g")
def gap_report(v: Views) -> DataFrame:
    missing, _, empty = _gaps(v)
    return missing.withColumn("needs_backfill", empty.scalar())


@register("h04_unfinished_sources", _UNFINISHED_SQL)
def unfinished_sources(v: Views) -> DataFrame:
    return _gaps(v)[1]


_INCOMPLETE_SQL = f"""select session_date, string_agg(distinct source_id, ',' order by source_id) as sources from (
      select session_date, 'equity_d1' as source_id from ({_GAP_SQL}) g union all select session_date, source_id from ({_UNFINISHED_SQL}) u) p group by 1"""


@register("h05_incomplete_by_session", _INCOMPLETE_SQL)
def incomplete_by_session(v: Views) -> DataFrame:
    missing, unfinished, _ = _gaps(v)
    return comp.incomplete_by_session(missing, unfinished)


def _ready_sql(settings: Settings) -> str:
    depths = ", ".join(f"('{g.group_id}', {settings.window_of(g)})" for g in HISTORY)
    return f"""with d as (select * from (values {depths}) x(group_id, depth)),
        c as ({_CLOSED_SQL}),
        s as (select session_date, row_number() over (order by session_date) as idx from v_session),
        g as (select s.session_date, s.idx, d.group_id, d.depth,
            sum(case when c.session_date is null then 0 else 1 end) over (partition by d.group_id order by s.idx) as run
          from s cross join d left join c on c.group_id = d.group_id and c.session_date = s.session_date),
        w as (select a.session_date, a.group_id, a.idx >= a.depth and a.run - coalesce(b.run, 0) = a.depth as whole
          from g a left join g b on b.group_id = a.group_id and b.idx = a.idx - a.depth)
      select session_date, bool_and(whole) as ready, coalesce(string_agg(case when not whole then group_id end, ',' order by group_id), '') as missing_groups
      from w group by session_date"""


def _states(v: Views, settings: Settings) -> DataFrame:
    required = settings.required()
    closed = comp.closed_sessions(required, v.tables, v.ingest_run)
    return comp.readiness(v.session, closed, required, settings)


def _recent(v: Views, settings: Settings) -> DataFrame:
    required = settings.required()
    return comp.recent_readiness(v.session, v.tables, v.ingest_run, required, settings, ASOF)


@register("h06_readiness", _ready_sql(SHALLOW))
def readiness(v: Views) -> DataFrame:
    return _states(v, SHALLOW)


@register(
    "h06_readiness_of_date",
    f"""select date '2001-07-29' as asof_date, ready, true as is_session, missing_groups from ({_ready_sql(SHALLOW)}) r
      where session_date = date '2001-07-29'
      union all select date '2001-07-29', false, false, '' where not exists (select 1 from v_session where session_date = date '2001-07-29')""",
)
def readiness_of_date(v: Views) -> DataFrame:
    return comp.readiness_of(_states(v, SHALLOW), dt.date(2001, 7, 29))


@register(
    "g14_latest_ready",
    f"""select max(session_date) as latest_ready from ({_ready_sql(SHALLOW)}) r where ready
      and session_date in {sql_window(SHALLOW.catchup_depth)}""",
)
def latest_ready(v: Views) -> DataFrame:
    return comp.latest_ready(v.session, _recent(v, SHALLOW), ASOF, SHALLOW)


_TITLES = ", ".join(f"('{g.group_id}', '{g.title}')" for g in GROUPS)


@register(
    "h12_blocking_groups",
    f"""with r as ({_ready_sql(SETTINGS)}), l as (select max(session_date) as d from v_session where session_date <= date '{ASOF}'),
        x as (select max(session_date) as d from r where ready and session_date in {sql_window(SETTINGS.catchup_depth)})
      select group_id, title from r join l on r.session_date = l.d join x on x.d is null or x.d <> l.d,
        unnest(string_split(missing_groups, ',')) u(group_id) join (values {_TITLES}) t(group_id, title) using (group_id)""",
)
def blocking_groups(v: Views) -> DataFrame:
    return comp.blocking_groups(v.spark, _recent(v, SETTINGS), v.session, ASOF, SETTINGS)


@register(
    "h07_declared_complete",
    """select session_date as asof_date, count(*) filter (where status = 'failed' and source_id not in ('dividends')) = 0 as complete
      from v_ingest_run group by session_date""",
)
def declared_complete(v: Views) -> DataFrame:
    """Each day's declaration lists the sources that failed on it: a handful of names."""
    failed = F.when(F.col("status") == "failed", F.col("source_id"))
    daily = v.ingest_run.groupBy("session_date").agg(F.collect_set(failed).alias("sources"))
    declared = daily.select(
        F.col("session_date").alias("asof_date"),
        F.array(F.struct("session_date", "sources")).alias("incomplete"),
    )
    return comp.dataset_is_complete(declared, SETTINGS)


_CLOSED_DAYS = f"""(select session_date from {sql_window(DEPTH, dt.date(2001, 7, 29))} w where session_date < date '2001-07-29')"""


def _pending_sql() -> str:
    parts = [
        f"""select session_date from (select session_date from v_session where session_date <= (select max(session_date) from {_CLOSED_DAYS} c)
          order by session_date desc limit {_depth(g.group_id)}) w where session_date in {_CLOSED_DAYS}
          and session_date not in (select session_date from ({_CLOSED_SQL}) c where c.group_id = '{g.group_id}')"""
        for g in HISTORY
    ]
    return " union ".join(parts)


_TODAY = dt.date(2001, 7, 29)


def _now():
    return F.lit("2001-07-29 13:00:00").cast("timestamp")


@register("h08_incomplete_closed_sessions", _pending_sql())
def incomplete_closed_sessions(v: Views) -> DataFrame:
    return comp.incomplete_closed_sessions(
        v.tables, v.ingest_run, v.session, SETTINGS, _now(), _TODAY
    )[0]


@register(
    "h09_pending_sessions",
    f"""select session_date from ({_pending_sql()}) m
      left join (select session_date, count(distinct run_id) as attempts from v_ingest_run group by 1) a using (session_date)
      left join (select session_date, max(started_at) as tried from v_ingest_run where source_id = 'equity_d1' group by 1) t using (session_date)
      where coalesce(attempts, 0) < 5 and (tried is null or timestamp '2001-07-29 13:00:00' - tried >= interval 15 minute)""",
)
def pending_sessions(v: Views) -> DataFrame:
    missing, window = comp.incomplete_closed_sessions(
        v.tables, v.ingest_run, v.session, SETTINGS, _now(), _TODAY
    )
    return comp.pending_sessions(missing, window, v.ingest_run, SETTINGS, _now())


_RANGE_JOURNAL = "(select * from v_ingest_run where session_date = (select max(session_date) from v_ingest_run))"


@register(
    "h10_range_journal_rule",
    f"""select session_date from {sql_window()} w where session_date not in (select session_date from v_global where value is not null)
      and session_date not in (select session_date from {_RANGE_JOURNAL} j where status = 'ok' and source_id in ('global_series', 'cbr', 'brent', 'index_constituents'))""",
)
def range_journal_rule(v: Views) -> DataFrame:
    """A range load leaves one journal day; observations must close the other sessions."""
    last = v.ingest_run.agg(F.max("session_date").alias("d")).scalar()
    journal = v.ingest_run.filter(F.col("session_date") == last)
    window = cal.window(v.session, ASOF, DEPTH)
    return comp.missing_sessions(BY_ID["global"], v.global_series, journal, window)


@register(
    "h13_catchup_plan",
    f"""select session_date, date '2001-01-01' < (select min(session_date) from ({_GAP_SQL}) a)
        or date '2001-06-30' > (select max(session_date) from ({_GAP_SQL}) b) as clamped, 'equity_agg,equity_d1' as sources
      from ({_GAP_SQL}) g where session_date between date '2001-01-01' and date '2001-06-30'""",
)
def catchup_plan(v: Views) -> DataFrame:
    groups = [BY_ID["quotes"], BY_ID["aggregates"]]
    missing, _, _ = _gaps(v)
    return comp.catchup_plan(missing, groups, dt.date(2001, 1, 1), dt.date(2001, 6, 30))


_CUBE_SQL = """with r as (select sector, strftime(session_date, '%Y-%m') as month, asset_id, close from v_bar left join v_sector using (asset_id)),
      c as (select case when grouping(sector) = 0 and grouping(month) = 0 then 'sector+month' when grouping(sector) = 0 then 'sector'
          when grouping(month) = 0 then 'month' else '' end as level, sector, month, count(*) as rows_total, count(close) as rows_with_values, count(distinct asset_id) as assets
        from r group by cube (sector, month))
      select *, true as estimate_within from c"""


@register("e08_coverage_rollup", _CUBE_SQL)
def coverage_rollup(v: Views) -> DataFrame:
    """Quotes by sector and month, each alone, and in all; two halves of the months are rolled up apart and united."""
    rows = v.bar.join(v.sector, "asset_id", "left").withColumn("month", F.date_format("session_date", "yyyy-MM")).select("sector", "month", "asset_id", "close")
    by = ["sector", "month"]
    odd = F.substring("month", 7, 1).cast("int") % 2 == 1
    base = mt.rollup_base(rows.filter(odd), by, ["close"]).unionByName(mt.rollup_base(rows.filter(~odd), by, ["close"]))
    about, exact = mt.rolled_up(base, by), mt.exact_assets(rows, by).withColumnsRenamed({"sector": "s", "month": "m", "level": "l"})
    same = (F.col("level") == F.col("l")) & F.col("sector").eqNullSafe(F.col("s")) & F.col("month").eqNullSafe(F.col("m"))
    within = F.abs(F.col("assets_about") - F.col("assets")) <= F.greatest(F.lit(1.0), F.col("assets") * mt.SKETCH_ERROR)
    return about.join(exact, same).select("level", *by, "rows_total", "rows_with_values", "assets", within.alias("estimate_within"))


@register(
    "e08_coverage_maintained",
    f"""with b as (select session_date, case when {{late}} then null else close end as close from v_bar where session_date in {sql_window()})
      select 'quotes' as group_id, (select count(*) from {sql_window()} w) as window_sessions, count(distinct session_date) as sessions_covered, min(session_date) as period_from,
        max(session_date) as period_till, count(*) as rows_total, count(close) as rows_with_values,
        (select count(*) from {sql_window()} w) - count(distinct session_date) as gaps,
        cast(round_even(count(distinct session_date) / cast((select count(*) from {sql_window()} w) as double), 4) as decimal(18,4)) as coverage_ratio from b""".replace("{late}", "dayofmonth(session_date) <= 3"),
)
def coverage_maintained(v: Views) -> DataFrame:
    """All quotes are merged and counted; then the first days of each month come again without closes."""
    root = scratch_path(v.spark, "kept")
    group = next(g for g in GROUPS if g.group_id == "quotes")
    bars = v.bar.withColumn("_seq", F.lit(1))
    mt.merge_counted(v.spark, root, group, bars, ["_seq"], "month", folded=True)
    again = bars.filter(F.dayofmonth("session_date") <= 3).withColumn("close", F.lit(None).cast("decimal(28,9)"))
    mt.merge_counted(v.spark, root, group, again, ["_seq"], "month", folded=True)
    window = cal.window(v.session, ASOF, Settings().price_window)
    return mt.coverage_from_counts(mt.kept_counts(v.spark, root), group, window)
