"""Ranking requests, answers and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.operators import dataset as ds
from tradeaxis.operators import pages
from tradeaxis.operators import ranking as rk
from tradeaxis.plans import q_dataset as qd
from tradeaxis.plans.q_store import sql_window
from tradeaxis.plans.registry import ASOF, register
from tradeaxis.session import scratch_path, staged
from tradeaxis.views import Views


def _answers(v: Views) -> DataFrame:
    """An answer per order, as the JSON body it arrives in."""
    status = F.col("o_orderstatus")
    cust, key = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    score = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("high")).otherwise(price)

    def item(rank: str, asset, text):
        return F.struct(
            F.lit(rank).alias("rank"),
            F.concat(F.lit("EQ_AST_"), asset).alias("asset_id"),
            F.concat(F.lit("EQ_PRS_"), asset).alias("price_series_id"),
            text.alias("score"),
        )

    left_out = F.array(F.struct(key.alias("asset_id"), F.lit("short history").alias("reason")))
    body = F.struct(
        F.when(status != "P", F.md5(cust)).alias("input_digest"),
        F.lit("model").alias("model_id"),
        (status == "F").alias("emulated"),
        F.array(item("1", cust, score), item("2", key, F.lit("0.5"))).alias("items"),
        F.when(status == "F", left_out).alias("excluded"),
    )
    return v.orders.select(F.col("o_orderkey").alias("request_id"), F.to_json(body).alias("body"))


def _requests(v: Views) -> DataFrame:
    return v.orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.md5(F.col("o_custkey").cast("string")).alias("digest"),
    )


@register(
    "k01_digest_mismatch",
    """select o_orderkey as request_id, cast(null as varchar) as input_digest, md5(cast(o_custkey as varchar)) as sent_digest
      from orders where o_orderstatus = 'P'""",
)
def digest_mismatch(v: Views) -> DataFrame:
    wrong = rk.digest_mismatches(rk.parse_answers(_answers(v)), _requests(v))
    return wrong.select("request_id", "input_digest", "sent_digest")


_ITEMS_SQL = """select o_orderkey as request_id, 1 as rank, concat('EQ_AST_', cast(o_custkey as varchar)) as asset_id,
    concat('EQ_PRS_', cast(o_custkey as varchar)) as price_series_id,
    case when o_orderpriority <> '5-LOW' then cast(cast(o_totalprice as decimal(18,2)) as decimal(28,9)) end as score from orders
  union all select o_orderkey, 2, concat('EQ_AST_', cast(o_orderkey as varchar)), concat('EQ_PRS_', cast(o_orderkey as varchar)),
    cast(0.5 as decimal(28,9)) from orders"""


@register("k02_items", _ITEMS_SQL)
def items(v: Views) -> DataFrame:
    return rk.items(rk.parse_answers(_answers(v)))


@register(
    "k03_exclusions",
    "select o_orderkey as request_id, cast(o_orderkey as varchar) as asset_id, 'short history' as reason from orders where o_orderstatus = 'F'",
)
def exclusions(v: Views) -> DataFrame:
    return rk.exclusions(rk.parse_answers(_answers(v)))


@register(
    "d10_unknown_assets",
    f"""select i.* from ({_ITEMS_SQL}) i join orders on o_orderkey = request_id where rank = 2 and o_orderstatus = 'O' and o_orderkey <> o_custkey""",
)
def unknown_assets(v: Views) -> DataFrame:
    asset = F.explode(
        F.when(F.col("o_orderstatus") == "O", F.array("o_custkey")).otherwise(
            F.array("o_custkey", "o_orderkey")
        )
    )
    asked = v.orders.select(F.col("o_orderkey").alias("request_id"), asset.alias("a")).select(
        "request_id", F.concat(F.lit("EQ_AST_"), F.col("a").cast("string")).alias("asset_id")
    )
    return rk.unknown_assets(rk.items(rk.parse_answers(_answers(v))), asked)


# Requests by year for finished orders and by day for the others; days with shipments only are empty.
_REQUEST_SQL = "case o_orderstatus when 'F' then strftime(o_orderdate, '%Y') else strftime(o_orderdate, '%Y-%m-%d') end"
_REQUEST_ROWS_SQL = f"""select {_REQUEST_SQL} as request_id, case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then ' '
    else cast(o_custkey as varchar) end as asset_id, cast(o_orderkey as varchar) as price_series_id from orders"""


@register(
    "c13_request_violations",
    f"""with a as ({_REQUEST_ROWS_SQL}), r as (select distinct request_id from a
        union select distinct strftime(l_shipdate, '%Y-%m-%d') from lineitem),
        n as (select request_id, count(*) as n from a group by 1)
      select distinct request_id, 'blank_asset_id' as rule, '' as subject from a where trim(asset_id) = ''
      union all select request_id, 'empty', '' from r where request_id not in (select request_id from a)
      union all select request_id, 'too_many', '' from n where n > 1000
      union all select request_id, 'duplicate_asset_id', asset_id from a group by 1, 3 having count(*) > 1
      union all select request_id, 'duplicate_price_series_id', price_series_id from a group by 1, 3 having count(*) > 1""",
)
def request_violations(v: Views) -> DataFrame:
    status = F.col("o_orderstatus")
    name = F.when(status == "F", F.date_format("o_orderdate", "yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    blank = (F.col("o_orderpriority") == "5-LOW") & (status == "P")
    assets = v.orders.select(
        name.alias("request_id"),
        F.when(blank, F.lit(" ")).otherwise(F.col("o_custkey").cast("string")).alias("asset_id"),
        F.col("o_orderkey").cast("string").alias("price_series_id"),
    )
    shipped = v.lineitem.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("request_id"))
    requests = assets.select("request_id").union(shipped).distinct()
    return rk.request_violations(requests, assets)


# --- run registry --------------------------------------------------------------------------------


def _runs(v: Views) -> DataFrame:
    """Runs whose inputs repeat: the digest is that of the model."""
    return v.ranking_run.withColumn("dataset_digest", F.concat(F.lit("sha256:"), "model_id"))


_RUNS_SQL = "(select * replace (concat('sha256:', model_id) as dataset_digest) from v_ranking_run)"
_KEY_SQL = "asof_date, dataset_digest, model_id, model_version"


@register(
    "f16_enqueue",
    f"""with o as (select distinct {_KEY_SQL} from {_RUNS_SQL} r where status in ('success', 'failed'))
      select n.id, {_KEY_SQL}, (asof_date, dataset_digest, model_id, model_version) not in (select (asof_date, dataset_digest, model_id, model_version) from o) as created
      from (select min(id) as id, {_KEY_SQL} from {_RUNS_SQL} r where status in ('queued', 'running') group by all) n""",
)
def enqueue(v: Views) -> DataFrame:
    runs = _runs(v)
    stored = runs.filter(F.col("status").isin("success", "failed"))
    incoming = runs.filter(F.col("status").isin("queued", "running")).select("id", *rk.RUN_KEY)
    return rk.enqueue(stored, incoming, ["id"])


@register(
    "k05_find_by_input",
    f"""select id, status from {_RUNS_SQL} r where ({_KEY_SQL}) in (select ({_KEY_SQL}) from {_RUNS_SQL} q where status = 'queued')""",
)
def find_by_input(v: Views) -> DataFrame:
    runs = _runs(v)
    found = rk.find_by_input(runs, runs.filter("status = 'queued'"))
    return found.select("id", "status")


@register(
    "k04_result_store",
    """select asof_date as run_id, asset_id, rank, score from v_ranking
      where extract(day from asof_date) <= 15""",
)
def result_store(v: Views) -> DataFrame:
    """Results of all days are written, items first; of late days half the items are lost.

    The first attempt ends before its run rows, the second is read.
    """
    ranked = v.ranking.select(F.col("asof_date").alias("run_id"), "asset_id", "rank", "score")
    ranked = staged(ranked, "ranked")
    root, at = scratch_path(v.spark, "results"), F.lit(ASOF).cast("timestamp")
    rk.store_items(ranked, root, "1")
    arrived = (F.dayofmonth("run_id") <= 15) | (F.col("rank") % 2 == 0)
    rk.store_items(ranked.filter(arrived), root, "2")
    rk.store_results(rk.result_rows(ranked), root, "2", at)
    return rk.stored_items(v.spark, root)


_LOG_SQL = """select user_id as run_id, event_id as seq, case event_type when 'click' then 'running' when 'view' then 'success'
    when 'purchase' then 'requeued' when 'signup' then 'queued' else 'failed' end as kind, ts as at, case when event_type = 'error' then 'model_error' end as code,
    case when event_type = 'error' then concat('event ', cast(event_id as varchar)) end as message, event_id % 100 as items from v_event"""


@register(
    "k06_run_states",
    f"""with l as ({_LOG_SQL}), q as (select run_id, max(case when kind = 'requeued' then seq end) as rs,
          max(case when kind = 'running' then seq end) as ss, count(*) filter (where kind = 'requeued') as n, max(seq) as last from l group by 1)
      select q.run_id, case when l.kind = 'requeued' then 'queued' else l.kind end as status, n + 1 as attempt,
        case when ss > coalesce(rs, -1) then s.at end as started_at, case when l.kind in ('success', 'failed') then l.at end as finished_at,
        case when l.kind = 'failed' then l.code end as error_code, case when l.kind = 'failed' then l.message end as error_message,
        case when l.kind = 'success' then l.items end as included_asset_count
      from q join l on l.run_id = q.run_id and l.seq = q.last left join l s on s.run_id = q.run_id and s.seq = q.ss""",
)
def run_states(v: Views) -> DataFrame:
    kind, eid = F.col("event_type"), F.col("event_id")
    failed = kind == "error"
    log = v.event.select(
        F.col("user_id").alias("run_id"),
        eid.alias("seq"),
        F.when(kind == "click", "running")
        .when(kind == "view", "success")
        .when(kind == "purchase", "requeued")
        .when(kind == "signup", "queued")
        .otherwise("failed")
        .alias("kind"),
        F.col("ts").alias("at"),
        F.when(failed, "model_error").alias("code"),
        F.when(failed, F.concat(F.lit("event "), eid.cast("string"))).alias("message"),
        (eid % 100).alias("items"),
    )
    return rk.run_states(log)


@register(
    "e19_queue_progress",
    """with r as (select * from v_ranking_run where asof_date >= date '1999-01-01' or status not in ('queued', 'running')),
        p as (select count(*) as n, min(asof_date) as oldest from r where status in ('queued', 'running'))
      select count(*) as completed, count(*) + any_value(p.n) as total from r, p where status = 'success' and asof_date >= p.oldest""",
)
def queue_progress(v: Views) -> DataFrame:
    """Waiting runs of the early years are taken as done with, so that the queue has a start."""
    waiting = F.col("status").isin("queued", "running")
    late = F.col("asof_date") >= F.lit("1999-01-01").cast("date")
    return rk.queue_progress(v.ranking_run.filter(late | ~waiting))


@register("e21_history_total", "select count(*) as total from v_ranking_run where status = 'success'")
def history_total(v: Views) -> DataFrame:
    return rk.history_total(v.ranking_run, "success")


_LAST_DAY_SQL = "(select max(asof_date) from v_ranking)"


def _last_ranking(v: Views) -> DataFrame:
    last = v.aggregate.agg(F.max("session_date").alias("d")).scalar()
    return v.ranking.filter(F.col("asof_date") == last).select("rank", "asset_id", "score")


@register(
    "g04_top_items",
    f"select rank, asset_id, score from v_ranking where asof_date = {_LAST_DAY_SQL} order by rank limit 5",
)
def top_items(v: Views) -> DataFrame:
    return rk.top_items(_last_ranking(v), 5)


@register(
    "g05_item_page",
    f"select rank, asset_id, score from v_ranking where asof_date = {_LAST_DAY_SQL} order by rank limit 5 offset 2",
)
def item_page(v: Views) -> DataFrame:
    return rk.item_page(_last_ranking(v), 2, 5)


@register(
    "g06_history_page",
    "select id, asof_date, status from v_ranking_run where status = 'failed' order by asof_date desc, id desc limit 25 offset 50",
)
def history_page(v: Views) -> DataFrame:
    runs = v.ranking_run.select("id", "asof_date", "status")
    return rk.history_page(runs, "failed", 50, 25)


@register(
    "g06_history_deep_pages",
    """with o as (select id, asof_date, status, row_number() over (order by asof_date desc, id desc) as rn, count(*) over () as n from v_ranking_run)
      select cast((rn - 1 - n // 2) // 25 as int) as page, id, asof_date, status from o where rn > n // 2 and rn <= n // 2 + 50""",
)
def history_deep_pages(v: Views) -> DataFrame:
    """Two pages from the middle of the history of all runs, the second by the cursor of the first."""
    runs = v.ranking_run.select("id", "asof_date", "status")
    held = pages.arrange(runs, [F.desc("asof_date"), F.desc("id")], rows=1000)
    first, cursor = held.page(runs.count() // 2, 25)
    second, _ = held.page(cursor, 25)
    return first.withColumn("page", F.lit(0)).unionByName(second.withColumn("page", F.lit(1)))


@register(
    "g05_item_deep_page",
    """with o as (select asof_date, rank, asset_id, score, row_number() over (order by asof_date, rank) as rn, count(*) over () as n from v_ranking)
      select asof_date, rank, asset_id, score from o where rn > n * 9 // 10 and rn <= n * 9 // 10 + 100""",
)
def item_deep_page(v: Views) -> DataFrame:
    """A page of the items of all rankings, nine tenths down."""
    items = v.ranking.select("asof_date", "rank", "asset_id", "score")
    held = pages.arrange(items, [F.asc("asof_date"), F.asc("rank")], rows=2000)
    return held.page(items.count() * 9 // 10, 100)[0]


_RUN_COLUMNS = ("id", "asof_date", "model_id", "status", "finished_at")
_RUN_SQL = ", ".join(_RUN_COLUMNS)


@register(
    "g07_latest_success",
    f"select {_RUN_SQL} from v_ranking_run where status = 'success' order by asof_date desc, finished_at desc, id desc limit 1",
)
def latest_success(v: Views) -> DataFrame:
    return rk.latest_success(v.ranking_run.select(*_RUN_COLUMNS))


@register(
    "g08_latest_success_per_date",
    f"""select {_RUN_SQL} from (select *, row_number() over (partition by asof_date order by finished_at desc, id desc) as rn
      from v_ranking_run where status = 'success') r where rn = 1""",
)
def latest_success_per_date(v: Views) -> DataFrame:
    return rk.latest_success_per_date(v.ranking_run.select(*_RUN_COLUMNS))


@register(
    "g09_last_failure",
    f"select {_RUN_SQL} from v_ranking_run where status = 'failed' order by finished_at desc, id desc limit 1",
)
def last_failure(v: Views) -> DataFrame:
    return rk.last_failure(v.ranking_run.select(*_RUN_COLUMNS))


@register(
    "g10_pending_runs",
    "select id, asof_date, status from v_ranking_run where status in ('queued', 'running')",
)
def pending_runs(v: Views) -> DataFrame:
    return rk.pending_runs(v.ranking_run.select("id", "asof_date", "status"))


@register(
    "k07_run_detail",
    f"""with r as (select id, asof_date, status, dataset_digest from v_ranking_run where status = 'success' order by asof_date desc, finished_at desc, id desc limit 1),
        l as (select max(asof_date) as d from v_ranking), t as ({qd._STALE_SQL})
      select r.id, r.asof_date, r.status, r.dataset_digest in (select dataset_digest from v_ranking_run where status = 'success') as dataset_available,
        t.stale, i.rank, i.asset_id, i.score
      from r cross join l left join t using (id) left join v_ranking i on i.asof_date = l.d and i.rank between 3 and 12""",
)
def run_detail(v: Views) -> DataFrame:
    """The latest success with the third to twelfth item, its staleness (H11) and availability (A19)."""
    run = staged(rk.latest_success(v.ranking_run.select(*_RUN_COLUMNS)).select("id", "asof_date", "status"), "run")
    page = rk.item_page(_last_ranking(v), 2, 10).withColumn("run_id", run.select("id").scalar())
    return rk.run_detail(run, page, qd.input_stale(v), qd.dataset_availability(v))


_RUN_DAY_SQL = "(select max(asof_date) from v_ranking_run where status = 'success')"
_RUN_DIGEST_SQL = qd._DIGEST_SQL.replace(f"date '{ASOF}'", _RUN_DAY_SQL).replace(
    f"sha256('{ASOF}'", f"sha256(cast({_RUN_DAY_SQL} as varchar)"
)
_RUN_WINDOW_SQL = sql_window().replace(f"date '{ASOF}'", _RUN_DAY_SQL)


def stale_by_content(v: Views, run: DataFrame) -> DataFrame:
    """``(id, stale)`` of one run: it recorded no window, so the digests decide.

    A run whose dataset cannot be built any more is not stale.
    """
    first = run.first()
    if first is None:
        return run.select("id", F.lit(None).cast("boolean").alias("stale"))
    asof = first.asof_date
    parts, windows = ds.build_parts(v.tables, v.session, v.ingest_run, asof, qd.SETTINGS)
    now = ds.digest(ds.series_hashes(parts), ds.header(asof, windows))
    reason = ds.preconditions(v.session, v.bar, asof, windows["prices"]).select("reason").scalar()
    current = F.when(reason.isNull(), F.concat(F.lit("sha256:"), now.select("digest").scalar()))
    unknown = F.lit(None).cast("date")
    bounds = F.lit(windows["prices"].first), F.lit(windows["prices"].last)
    stale = ds.is_stale(F.lit(True), (unknown, unknown), bounds, F.col("dataset_digest"), current)
    return run.select("id", stale.alias("stale"))


@register(
    "k07_run_detail_computed",
    f"""with r as (select id, asof_date, status, dataset_digest from v_ranking_run where status = 'success' order by asof_date desc, finished_at desc, id desc limit 1),
        l as (select max(asof_date) as d from v_ranking), n as ({_RUN_DIGEST_SQL})
      select r.id, r.asof_date, r.status, r.dataset_digest in (select dataset_digest from v_ranking_run where status = 'success') as dataset_available,
        case when r.asof_date not in (select session_date from v_session) or not exists (select 1 from v_bar where session_date in {_RUN_WINDOW_SQL}) then false
          else 'sha256:' || n.digest <> r.dataset_digest end as stale, i.rank, i.asset_id, i.score
      from r cross join l left join n on true left join v_ranking i on i.asof_date = l.d and i.rank between 3 and 12""",
)
def run_detail_computed(v: Views) -> DataFrame:
    """The latest success with the third to twelfth item, its staleness (J8) and availability (A19)."""
    run = rk.latest_success(v.ranking_run.select("id", "asof_date", "status", "finished_at", "dataset_digest"))
    run = staged(run, "run")
    page = rk.item_page(_last_ranking(v), 2, 10).withColumn("run_id", run.select("id").scalar())
    there = qd.dataset_availability(v)
    return rk.run_detail(run.select("id", "asof_date", "status"), page, stale_by_content(v, run), there)
