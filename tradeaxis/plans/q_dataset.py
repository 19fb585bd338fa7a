"""The input of a decision date: dense arrays, digest, manifest, retention and staleness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.config import Settings
from tradeaxis.operators import calendar as cal
from tradeaxis.operators import dataset as ds
from tradeaxis.operators import digests as dg
from tradeaxis.operators.calendar import SessionWindow
from tradeaxis.plans import q_completeness as qc
from tradeaxis.plans.q_store import sql_window
from tradeaxis.plans.registry import ASOF, register
from tradeaxis.schema import AGGREGATE_VALUES, BAR_VALUES, POSITION_VALUES
from tradeaxis.session import scratch_path
from tradeaxis.views import Views

SETTINGS = Settings()
DEPTH, DEPTH_POSITIONS = SETTINGS.price_window, SETTINGS.positions_window


def _window(v: Views, depth: int = DEPTH) -> SessionWindow:
    return cal.window(v.session, ASOF, depth)


def _dense_sql(table: str, keys: str, values: tuple[str, ...], depth: int) -> str:
    texts = ", ".join(f"cast(t.{c} as varchar)" for c in values)
    cell = f"[{texts}]" if len(values) > 1 else texts
    return f"""select {keys}, cast(to_json(list({cell} order by w.session_date)) as varchar) as rows
      from (select distinct {keys} from {table} where session_date in {sql_window(depth)}) k cross join {sql_window(depth)} w
      left join {table} t using ({keys}, session_date) group by {keys}"""


_PRICES_SQL = _dense_sql("v_bar", "asset_id, price_series_id", BAR_VALUES, DEPTH)
_AGGREGATES_SQL = _dense_sql("v_aggregate", "asset_id, price_series_id", AGGREGATE_VALUES, DEPTH)
_POSITIONS_SQL = _dense_sql("v_position", "asset_id", POSITION_VALUES, DEPTH_POSITIONS)
_GLOBAL_SQL = _dense_sql("v_global", "series_id", ("value",), DEPTH)


@register("j01_dense_prices", _PRICES_SQL)
def dense_prices(v: Views) -> DataFrame:
    return ds.prices(v.bar, _window(v))


@register("j02_dense_aggregates", _AGGREGATES_SQL)
def dense_aggregates(v: Views) -> DataFrame:
    return ds.aggregates(v.aggregate, _window(v))


@register("j03_dense_positions", _POSITIONS_SQL)
def dense_positions(v: Views) -> DataFrame:
    return ds.positions(v.position, _window(v, DEPTH_POSITIONS))


@register("j04_dense_globals", _GLOBAL_SQL)
def dense_globals(v: Views) -> DataFrame:
    # A scalar axis is an array of texts with holes; JSON keeps the holes visible.
    dense = ds.global_series(v.global_series, _window(v))
    return dense.withColumn("rows", F.to_json("rows", {"ignoreNullFields": "false"}))


@register(
    "j05_asset_list",
    f"select distinct asset_id, price_series_id from v_bar where session_date in {sql_window()}",
)
def asset_list(v: Views) -> DataFrame:
    return ds.asset_list(v.bar, _window(v))


_DEPTHS_SQL = " union all ".join(
    f"""select '{part}' as part, count(*) as sessions, min(session_date) as window_from, max(session_date) as window_till
      from {sql_window(depth)} w"""
    for part, depth in (
        ("prices", DEPTH),
        ("aggregates", DEPTH),
        ("global", DEPTH),
        ("positions", DEPTH_POSITIONS),
    )
)


@register("j06_window_depths", _DEPTHS_SQL)
def window_depths(v: Views) -> DataFrame:
    return ds.window_depths(v.spark, ds.windows_of(v.session, ASOF, SETTINGS))


def _declared_sql(gap_sql: str) -> str:
    return f"""select session_date, string_agg(distinct source_id, ',' order by source_id) as sources from (
      select session_date, 'equity_d1' as source_id from ({gap_sql}) g
      union all select session_date, source_id from ({qc._UNFINISHED_SQL}) u) p
      where session_date in {sql_window()} group by 1"""


@register("j07_incomplete_declaration", _declared_sql(qc._GAP_SQL))
def incomplete_declaration(v: Views) -> DataFrame:
    missing, unfinished, _ = qc._gaps(v)
    return ds.incomplete_declaration(missing, unfinished, _window(v)).orderBy("session_date")


_FULL_GAP_SQL = f"""select session_date from {sql_window()} w where session_date not in (select session_date from v_bar)
      and session_date not in (select session_date from v_ingest_run where status = 'ok' and source_id = 'equity_d1')"""


def _digest_sql() -> str:
    axes = "".join(
        f""" || chr(10) || '{part}:' || (select string_agg(cast(session_date as varchar), ',' order by session_date) from {sql_window(depth)} w)"""
        for part, depth in (
            ("aggregates", DEPTH),
            ("global", DEPTH),
            ("positions", DEPTH_POSITIONS),
            ("prices", DEPTH),
        )
    )
    return f"""with h as (
        select 'prices' as part, asset_id || '|' || price_series_id as key, sha256('{{"rows":' || rows || '}}') as hash from ({_PRICES_SQL}) a
        union all select 'aggregates', asset_id || '|' || price_series_id, sha256('{{"rows":' || rows || '}}') from ({_AGGREGATES_SQL}) b
        union all select 'global', series_id, sha256('{{"rows":' || rows || '}}') from ({_GLOBAL_SQL}) c
        union all select 'positions', asset_id, sha256('{{"rows":' || rows || '}}') from ({_POSITIONS_SQL}) d
        union all select 'sectors', asset_id, sha256('{{"sector":' || coalesce('"' || sector || '"', 'null') || '}}') from v_sector
        union all select 'incomplete', cast(session_date as varchar), sha256('{{"sources":["' || replace(sources, ',', '","') || '"]}}')
          from ({_declared_sql(_FULL_GAP_SQL)}) i),
      leaf as (select substr(sha256(part || '/' || key), 1, 4) as node, part || '/' || key || '=' || hash as line from h),
      branch as (select node, sha256(string_agg(line, chr(10) order by line)) as hash from leaf group by node),
      stem as (select substr(node, 1, 2) as node, sha256(string_agg(node || '=' || hash, chr(10) order by node || '=' || hash)) as hash from branch group by 1),
      root as (select sha256(string_agg(node || '=' || hash, chr(10) order by node || '=' || hash)) as hash from stem)
      select sha256('{ASOF}'{axes} || chr(10) || hash) as digest from root"""


_DIGEST_SQL = _digest_sql()


def _parts(v: Views) -> tuple[dict[str, DataFrame], dict[str, SessionWindow]]:
    return ds.build_parts(v.tables, v.session, v.ingest_run, ASOF, SETTINGS)


@register("j08_content_digest", _DIGEST_SQL)
def content_digest(v: Views) -> DataFrame:
    parts, windows = _parts(v)
    return ds.digest(ds.series_hashes(parts), ds.header(ASOF, windows))


@register(
    "j09_not_yet_built",
    """select distinct dataset_digest as digest from v_ranking_run where status in ('queued', 'running')
      and dataset_digest not in (select dataset_digest from v_ranking_run where status = 'success')""",
)
def not_yet_built(v: Views) -> DataFrame:
    runs = v.ranking_run.withColumnRenamed("dataset_digest", "digest")
    waiting = runs.filter(F.col("status").isin("queued", "running")).select("digest").distinct()
    return ds.not_yet_built(waiting, runs.filter("status = 'success'"))


@register(
    "j10_build_preconditions",
    f"""select date '{ASOF}' as asof_date, case when not exists (select 1 from v_session where session_date = date '{ASOF}') then 'not_a_session'
      when not exists (select 1 from v_bar where session_date in {sql_window()}) then 'no_bars' end as reason""",
)
def build_preconditions(v: Views) -> DataFrame:
    return ds.preconditions(v.session, v.bar, ASOF, _window(v))


_MANIFEST_SQL = f"""select date '{ASOF}' as asof_date, 'sha256:' || digest as digest, a as aggregates_sessions, a as global_sessions,
        p as positions_sessions, a as prices_sessions, a as session_count,
        (select count(*) from (select distinct asset_id, price_series_id from v_bar where session_date in {sql_window()}) x) as asset_count,
        coalesce((select '[' || string_agg('{{"session_date":"' || cast(session_date as varchar) || '","sources":["' || replace(sources, ',', '","') || '"]}}', ',' order by session_date) || ']'
          from ({_declared_sql(_FULL_GAP_SQL)}) i), '[]') as incomplete
      from ({_DIGEST_SQL}) d, (select count(*) as a from {sql_window()} w) n, (select count(*) as p from {sql_window(DEPTH_POSITIONS)} w) m"""


@register("j11_manifest", _MANIFEST_SQL)
def manifest(v: Views) -> DataFrame:
    parts, windows = _parts(v)
    digest = ds.digest(ds.series_hashes(parts), ds.header(ASOF, windows))
    assets = ds.asset_list(v.bar, windows["prices"])
    return ds.manifest(ASOF, digest, windows, parts["incomplete"], assets)


# A dataset is built for a session only: the last one up to the decision date.
_LAST_SQL = f"(select max(session_date) from v_session where session_date <= date '{ASOF}')"
_SINK_SQL = _MANIFEST_SQL.replace(f"date '{ASOF}' as asof_date", f"{_LAST_SQL} as asof_date").replace(
    f"sha256('{ASOF}'", f"sha256(cast({_LAST_SQL} as varchar)"
)


@register("a17_dataset_sink", _SINK_SQL)
def dataset_sink(v: Views) -> DataFrame:
    """Writes the dataset, writes it again to no effect, and reads the manifest back."""
    root = scratch_path(v.spark, "datasets")
    asof = v.session.filter(F.col("session_date") <= F.lit(ASOF)).agg(F.max("session_date")).first()[0]
    args = (v.spark, root, v.tables, v.session, v.ingest_run, asof, SETTINGS)
    path, value, written = ds.materialise(*args)
    if not written or ds.materialise(*args) != (path, value, False):
        raise AssertionError("equal content is written once")
    return v.spark.read.parquet(f"{path}/manifest").drop("materialized_at")


_NAME_SQL = """case when o_orderstatus = 'P' then concat('tmp-', cast(o_orderkey as varchar))
    else concat(strftime(o_orderdate, '%Y-%m-%d'), '-', substr(md5(cast(o_custkey as varchar)), 1, 16)) end"""


@register(
    "a18_dataset_retention",
    f"""select name, cast(try_strptime(substr(name, 1, 10), '%Y-%m-%d') as date) as asof_date from (select distinct {_NAME_SQL} as name from orders) n
      where cast(try_strptime(substr(name, 1, 10), '%Y-%m-%d') as date) < date '{ASOF}' - 30""",
)
def dataset_retention(v: Views) -> DataFrame:
    hexed = F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 16)
    name = F.when(
        F.col("o_orderstatus") == "P", F.concat(F.lit("tmp-"), F.col("o_orderkey").cast("string"))
    ).otherwise(F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), hexed))
    registry = v.orders.select(name.alias("name")).distinct()
    return ds.expired(registry, F.lit(ASOF), SETTINGS.dataset_retention_days)


@register(
    "a19_dataset_availability",
    """select id, dataset_digest in (select dataset_digest from v_ranking_run where status = 'success') as dataset_available from v_ranking_run""",
)
def dataset_availability(v: Views) -> DataFrame:
    runs = v.ranking_run.withColumn("dataset_ref", F.col("dataset_digest"))
    kept = runs.filter("status = 'success'").select(F.col("dataset_ref").alias("ref"))
    return ds.availability(runs, kept).select("id", "dataset_available")


def _cell_sql(part: str, table: str, columns: tuple[str, ...]) -> str:
    texts = ", ".join(f"coalesce(cast({c} as varchar), '{dg.UNSEEN}')" for c in ("session_date", *columns))
    return f"select '{part}' as part, session_date, md5(concat_ws('|', '{part}', {texts})) as h from {table} where session_date in (select session_date from v_session)"


_UNDONE_SQL = """(select session_date, 'equity_d1' as source_id from v_session where session_date not in (select session_date from v_bar)
        and session_date not in (select session_date from v_ingest_run where status = 'ok' and source_id = 'equity_d1' and session_date is not null)
      union select session_date, source_id from (select *, row_number() over (partition by session_date, source_id order by started_at desc, id desc) as rn
        from v_ingest_run where session_date is not null) t where rn = 1 and status = 'failed')"""


def _window_digests_sql() -> str:
    facts = " union all ".join(
        _cell_sql(*x)
        for x in (
            ("prices", "v_bar", ("asset_id", "price_series_id", *BAR_VALUES)),
            ("aggregates", "v_aggregate", ("asset_id", "price_series_id", *AGGREGATE_VALUES)),
            ("global", "v_global", ("series_id", "value")),
            ("positions", "v_position", ("asset_id", *POSITION_VALUES)),
            ("incomplete", _UNDONE_SQL, ("source_id",)),
        )
    )
    limb = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::bigint"
    sums = ", ".join(f"sum({limb(k)}) as h{k}" for k in range(4))
    total = " || ':' || ".join(f"cast(sum(m.h{k} + a.h{k}) % 4294967296 as varchar)" for k in range(4))
    depth = " union all ".join(f"select '{part}' as part, {n} as depth" for part, n in dg.depths(SETTINGS).items())
    sector = " || ':' || ".join(f"cast(coalesce(sum({limb(k)}), 0) % 4294967296 as varchar)" for k in range(4))
    return f"""with s as (select session_date, row_number() over (order by session_date) as idx from v_session),
      d as ({depth}),
      f as (select part, session_date, count(*) as cells, {sums} from ({facts}) c group by 1, 2),
      a as (select session_date, {", ".join(f"{limb(k)} as h{k}" for k in range(4))} from (select session_date, md5('axis|' || cast(session_date as varchar)) as h from v_session) x),
      m as (select d.part, d.depth, s.session_date, s.idx, coalesce(f.cells, 0) as cells, {", ".join(f"coalesce(f.h{k}, 0) as h{k}" for k in range(4))}
        from s cross join d left join f on f.part = d.part and f.session_date = s.session_date),
      w as (select t.session_date as asof_date, m.part, min(m.session_date) as first, sum(m.cells) as cells,
          m.part || ':' || cast(count(*) as varchar) || ':' || cast(min(m.session_date) as varchar) || ':' || cast(sum(m.cells) as varchar) || ':' || {total} as line
        from s t join m on m.idx between t.idx - m.depth + 1 and t.idx join a on a.session_date = m.session_date group by 1, 2),
      x as (select 'sectors:' || cast(count(*) as varchar) || ':' || {sector} as line
        from (select md5(concat_ws('|', 'sectors', asset_id, coalesce(sector, '{dg.UNSEEN}'))) as h from v_sector) y)
      select asof_date, max(first) filter (where part = 'prices') as window_from, max(cells) filter (where part = 'prices') as bars,
        sha256(cast(asof_date as varchar) || chr(10) || string_agg(w.line, chr(10) order by w.line) || chr(10) || any_value(x.line)) as digest
      from w cross join x group by asof_date"""


@register("j08_window_digests", _window_digests_sql())
def window_digests(v: Views) -> DataFrame:
    """The digest of every session as decision date, all from one pass over each table."""
    return dg.window_digests(v.tables, v.session, v.ingest_run, SETTINGS)


_LATE_FROM, _LATE_TILL = "1996-03-01", "1996-03-12"
_LATE_SQL = f"session_date between date '{_LATE_FROM}' and date '{_LATE_TILL}' and cast(substr(asset_id, 8) as bigint) % 5 = 2"
_STALE_SQL = f"""with ok as (select finished_at, rows_written from v_ingest_run where status = 'ok' and finished_at is not null),
      b as (select session_date, min(session_date) over w as window_from from v_session
        window w as (order by session_date rows between {DEPTH - 1} preceding and current row)),
      n as (select b.session_date, b.window_from, exists (select 1 from v_bar k where k.session_date between b.window_from and b.session_date
          and k.session_date in (select session_date from v_session)) as built,
        exists (select 1 from v_bar k where k.session_date between b.window_from and b.session_date
          and k.session_date in (select session_date from v_session) and {_LATE_SQL}) as changed from b)
      select id, case when n.session_date is null then false
        when model_id < '4' and not exists (select 1 from ok where ok.rows_written > 0 and ok.finished_at > r.finished_at) then false
        else built and changed end as stale
      from v_ranking_run r left join n on n.session_date = r.asof_date where status = 'success'"""


def input_stale(v: Views) -> DataFrame:
    """``(id, stale)`` of all successful runs, by the digests of today.

    The runs saw the store before some bars of March 1996 landed; from the fourth model on they recorded a window
    that began a day earlier. Bars that landed in no window of a run leave it fresh.
    """
    before = {**v.tables, "bar": v.bar.filter(~F.expr(_LATE_SQL))}
    journal = v.ingest_run.filter("finished_at is not null")
    found = dg.marks(v.tables, v.session, v.ingest_run)
    then = dg.window_digests(before, v.session, v.ingest_run, SETTINGS, dg.marks(before, v.session, v.ingest_run, found))
    seen = then.select("asof_date", "window_from", F.col("digest").alias("dataset_digest"))
    runs = v.ranking_run.filter("status = 'success'").select("id", "asof_date", "model_id", "finished_at")
    recorded = F.when(F.col("model_id") < "4", F.col("window_from")).otherwise(F.date_sub("window_from", 1))
    stored = runs.join(seen, "asof_date", "left").select("id", "asof_date", "finished_at", "dataset_digest", recorded.alias("window_from"), F.col("asof_date").alias("window_till"))
    now = dg.window_digests(v.tables, v.session, v.ingest_run, SETTINGS, found)
    return dg.staleness(stored, now, journal)


@register("h11_input_staleness", _STALE_SQL)
def input_staleness(v: Views) -> DataFrame:
    return input_stale(v)


_DIFF_DAY = dt.date(1996, 6, 28)
_DIFF_WINDOW = sql_window(DEPTH, _DIFF_DAY)
_DIFF_SQL = " union all ".join(
    f"""select '{part}' as part, asset_id || '|' || price_series_id as key, case when bool_and({_LATE_SQL}) then 'added' else 'changed' end as change
      from {table} where session_date in {_DIFF_WINDOW} group by asset_id, price_series_id having bool_or({_LATE_SQL})"""
    for part, table in (("prices", "v_bar"), ("aggregates", "v_aggregate"))
)


@register("j08_changed_series", _DIFF_SQL)
def changed_series(v: Views) -> DataFrame:
    """What the late rows of March 1996 changed in the dataset of June: only differing branches are read."""
    windows = ds.windows_of(v.session, _DIFF_DAY, SETTINGS)

    def tree(bars: DataFrame, aggregates: DataFrame) -> str:
        parts = {
            "prices": ds.prices(bars, windows["prices"]),
            "aggregates": ds.aggregates(aggregates, windows["aggregates"]),
            "global": ds.global_series(v.global_series, windows["global"]),
            "positions": ds.positions(v.position, windows["positions"]),
            "sectors": v.sector.select("asset_id", "sector"),
        }
        path = scratch_path(v.spark, "tree")
        ds.store_tree(ds.series_hashes(parts), path)
        return path

    early = ~F.expr(_LATE_SQL)
    before = tree(v.bar.filter(early), v.aggregate.filter(early))
    return ds.changed_series(v.spark, before, tree(v.bar, v.aggregate))
