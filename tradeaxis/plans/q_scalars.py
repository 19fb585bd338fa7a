"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.functions import money, parse
from tradeaxis.operators import portfolio
from tradeaxis.plans.registry import register, sql_ratio
from tradeaxis.schema import PRICE
from tradeaxis.views import Views

_SQL_PRICE = "cast(cast(o_totalprice as decimal(18,2)) as varchar)"


def _price_text():
    return F.col("o_totalprice").cast("decimal(18,2)").cast("string")


def _day():
    return F.to_date("o_orderdate")


def _orders(v: Views, text) -> DataFrame:
    return v.orders.select("o_orderkey", "o_orderstatus", text.alias("raw"))


@register(
    "b01_decimal_parse",
    f"""select o_orderkey, try_cast(trim(raw) as decimal(28,9)) as value from (
      select o_orderkey, case o_orderstatus when 'F' then concat('  ', {_SQL_PRICE}, ' ')
        when 'O' then {_SQL_PRICE} when 'P' then '' end as raw from orders) t""",
)
def decimal_parse(v: Views) -> DataFrame:
    status = F.col("o_orderstatus")
    raw = (
        F.when(status == "F", F.concat(F.lit("  "), _price_text(), F.lit(" ")))
        .when(status == "O", _price_text())
        .when(status == "P", F.lit(""))
    )
    return _orders(v, raw).select("o_orderkey", parse.decimal_or_null("raw").alias("value"))


_LOCAL_SQL = f"concat(substr({_SQL_PRICE}, 1, 1), chr(160), replace(substr({_SQL_PRICE}, 2), '.', ','), ' ')"


def _local_text():
    tail = F.replace(F.expr("substr(t, 2)"), F.lit("."), F.lit(","))
    return F.concat(F.expr("substr(t, 1, 1)"), F.lit(" "), tail, F.lit(" "))


@register(
    "b02_local_number",
    f"""select o_orderkey, try_cast(replace(replace(replace(raw, chr(160), ''), ' ', ''), ',', '.')
      as decimal(28,9)) as value from (select o_orderkey, {_LOCAL_SQL} as raw from orders) t""",
)
def local_number(v: Views) -> DataFrame:
    text = v.orders.select("o_orderkey", _price_text().alias("t")).select(
        "o_orderkey", _local_text().alias("raw")
    )
    return text.select("o_orderkey", parse.local_decimal("raw").alias("value"))


@register(
    "b03_local_number_minus",
    f"""select o_orderkey, try_cast(replace(replace(replace(replace(raw, chr(160), ''), ' ', ''), ',', '.'),
      chr(8722), '-') as decimal(28,9)) as value
      from (select o_orderkey, concat(case when o_orderstatus = 'F' then chr(8722) else '' end,
        {_LOCAL_SQL}) as raw from orders) t""",
)
def local_number_minus(v: Views) -> DataFrame:
    sign = F.when(F.col("o_orderstatus") == "F", F.lit("−")).otherwise(F.lit(""))
    text = v.orders.select("o_orderkey", sign.alias("sign"), _price_text().alias("t")).select(
        "o_orderkey", F.concat("sign", _local_text()).alias("raw")
    )
    return text.select("o_orderkey", parse.local_decimal("raw", minus=True).alias("value"))


@register(
    "b04_iso_date",
    """select o_orderkey, cast(try_strptime(substr(trim(raw), 1, 10), '%Y-%m-%d') as date) as day from (
      select o_orderkey, case o_orderstatus when 'F' then concat(strftime(o_orderdate, '%Y-%m-%d'), 'T10:00:00')
        when 'O' then concat(' ', strftime(o_orderdate, '%Y-%m-%d'), ' ')
        else concat(strftime(o_orderdate, '%Y-%m'), '-31') end as raw from orders) t""",
)
def iso_date(v: Views) -> DataFrame:
    status = F.col("o_orderstatus")
    day = F.date_format(_day(), "yyyy-MM-dd")
    raw = (
        F.when(status == "F", F.concat(day, F.lit("T10:00:00")))
        .when(status == "O", F.concat(F.lit(" "), day, F.lit(" ")))
        .otherwise(F.concat(F.date_format(_day(), "yyyy-MM"), F.lit("-31")))
    )
    return _orders(v, raw).select("o_orderkey", parse.iso_date("raw").alias("day"))


@register(
    "b05_dotted_date",
    """select o_orderkey, cast(try_strptime(raw, '%d.%m.%Y') as date) as day from (
      select o_orderkey, case o_orderstatus when 'F' then strftime(o_orderdate, '%d.%m.%Y')
        when 'O' then strftime(o_orderdate, '30.%m.%Y') else strftime(o_orderdate, '%Y-%m-%d') end as raw
      from orders) t""",
)
def dotted_date(v: Views) -> DataFrame:
    status = F.col("o_orderstatus")
    raw = (
        F.when(status == "F", F.date_format(_day(), "dd.MM.yyyy"))
        .when(status == "O", F.concat(F.lit("30."), F.date_format(_day(), "MM.yyyy")))
        .otherwise(F.date_format(_day(), "yyyy-MM-dd"))
    )
    return _orders(v, raw).select("o_orderkey", parse.dotted_date("raw").alias("day"))


_MONTH_NAMES = list(parse.RUSSIAN_MONTHS)
_MONTH_CASE = " ".join(f"when {i + 1} then '{name}'" for i, name in enumerate(_MONTH_NAMES))


@register(
    "b06_date_in_text",
    """select o_orderkey, cast(o_orderdate as date) as day from orders where o_orderpriority <> '5-LOW'
      union all select o_orderkey, null from orders where o_orderpriority = '5-LOW'""",
)
def date_in_text(v: Views) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _MONTH_NAMES])
    status = F.col("o_orderstatus")
    worded = F.concat_ws(" ", F.dayofmonth(_day()), F.get(names, F.month(_day()) - 1), F.year(_day()))
    form = (
        F.when(status == "F", F.date_format(_day(), "yyyy-MM-dd"))
        .when(status == "O", F.date_format(_day(), "dd.MM.yyyy"))
        .otherwise(worded)
    )
    caption = F.when(
        F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("Данные на "), form, F.lit(" г."))
    ).otherwise(F.lit("Данных нет"))
    return _orders(v, caption).select("o_orderkey", parse.date_in_text("raw").alias("day"))


@register(
    "b07_ticker",
    """select c_custkey, upper(trim(raw)) as ticker from (select c_custkey,
      case when c_nationkey = 0 then '  ' else concat(' ', lower(c_mktsegment), ' ') end as raw from customer) t
      where trim(raw) <> ''""",
)
def ticker(v: Views) -> DataFrame:
    raw = F.when(F.col("c_nationkey") == 0, F.lit("  ")).otherwise(
        F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))
    )
    rows = v.raw("customer").select("c_custkey", parse.ticker(raw).alias("ticker"))
    return rows.filter("ticker IS NOT NULL")


@register(
    "b08_identifiers",
    """select p_partkey, concat('EQ_AST_', upper(trim(p_brand))) as asset_id,
      concat('EQ_PRS_', upper(trim(p_brand))) as price_series_id from part""",
)
def identifiers(v: Views) -> DataFrame:
    return v.raw("part").select(
        "p_partkey",
        parse.asset_id("p_brand").alias("asset_id"),
        parse.price_series_id("p_brand").alias("price_series_id"),
    )


@register(
    "b09_fingerprint",
    """select price_series_id, session_date, substr(sha256(concat_ws('|', coalesce(cast(open as varchar), ''),
      coalesce(cast(high as varchar), ''), coalesce(cast(low as varchar), ''), coalesce(cast(close as varchar), ''),
      coalesce(cast(volume as varchar), ''))), 1, 32) as source_revision from v_bar""",
)
def fingerprint(v: Views) -> DataFrame:
    return v.bar.select(
        "price_series_id", "session_date", parse.fingerprint().alias("source_revision")
    )


@register(
    "b10_contract_expiry",
    """select o_orderkey, case when m between 1 and 12 then last_day(make_date(2000 + y, m, 1)) end as expiry
      from (select o_orderkey, cast(strftime(o_orderdate, '%y') as int) as y,
        case when o_orderstatus = 'P' then 13 else cast(month(o_orderdate) as int) end as m from orders) t""",
)
def contract_expiry(v: Views) -> DataFrame:
    month = F.when(F.col("o_orderstatus") == "P", F.lit(13)).otherwise(F.month(_day()))
    name = F.concat(F.lit("BR-"), month, F.lit("."), F.date_format(_day(), "yy"))
    return _orders(v, name).select("o_orderkey", parse.contract_expiry("raw").alias("expiry"))


@register(
    "b11_units_nano",
    """select c_custkey, case when u is not null or n is not null then
      cast(coalesce(u, 0) as decimal(28,9)) + cast(coalesce(n, 0) as decimal(18,0)) * cast('0.000000001' as decimal(9,9)) end as amount
      from (select c_custkey, case when c_nationkey < 20 then cast(trunc(c_acctbal) as bigint) end as u,
        case when c_nationkey between 3 and 21 then c_nationkey * 10000001 end as n from customer) t""",
)
def units_nano(v: Views) -> DataFrame:
    nation = F.col("c_nationkey")
    whole = F.col("c_acctbal").cast("bigint")
    rows = v.raw("customer").select(
        "c_custkey",
        F.when(nation < 20, whole).alias("u"),
        F.when(nation.between(3, 21), nation * 10000001).alias("n"),
    )
    return rows.select("c_custkey", parse.units_nano("u", "n").alias("amount"))


@register(
    "b12_index_weight_series",
    """select c_custkey, concat('IDX_WEIGHT_', cast(c_nationkey as varchar), '_', upper(c_mktsegment)) as series_id
      from customer""",
)
def index_weight_series(v: Views) -> DataFrame:
    series = parse.index_weight_series_id("c_nationkey", "c_mktsegment")
    return v.raw("customer").select("c_custkey", series.alias("series_id"))


@register(
    "b13_curve_series",
    "select p_partkey, concat('CBR_ZCYC_', 'yield_', cast(p_size as varchar), 'y') as series_id from part",
)
def curve_series(v: Views) -> DataFrame:
    term = F.concat(F.lit("yield_"), F.col("p_size").cast("string"), F.lit("y"))
    return v.raw("part").select("p_partkey", parse.curve_series_id(term).alias("series_id"))


@register(
    "b14_session_closed",
    """select event_id, session_date < cast(ts + interval 4 hour as date)
      or (session_date = cast(ts + interval 4 hour as date) and strftime(ts + interval 4 hour, '%H:%M') >= '19:30') as closed
      from v_event""",
)
def session_closed(v: Views) -> DataFrame:
    closed = parse.session_closed("session_date", F.col("ts"), "19:30")
    return v.event.select("event_id", closed.alias("closed"))


@register(
    "b15_safe_share",
    f"""select account_id, ticker, case when total = 0 then 0 else {sql_ratio("quantity", "total")} end as share
      from (select account_id, ticker, quantity, quantity - 1 as total from v_account_position) t""".replace(
        "then 0 else", "then cast(0 as decimal(38,10)) else"
    ),
)
def safe_share(v: Views) -> DataFrame:
    return v.account_position.select(
        "account_id",
        "ticker",
        money.share("quantity", F.col("quantity") - 1).alias("share"),
    )


@register(
    "b16_safe_percent",
    f"""select account_id, ticker, case when average_price is not null and base <> 0
      then {sql_ratio("average_price", "base")} end as percent
      from (select account_id, ticker, average_price, quantity - 1 as base from v_account_position) t""",
)
def safe_percent(v: Views) -> DataFrame:
    return v.account_position.select(
        "account_id",
        "ticker",
        money.percent("average_price", F.col("quantity") - 1).alias("percent"),
    )


@register(
    "b17_position_value",
    """select account_id, ticker, cast(cast(quantity as decimal(18,4)) * cast(current_price + accrued_interest as decimal(18,4))
      as decimal(28,9)) as value from v_account_position""",
)
def position_value(v: Views) -> DataFrame:
    value = money.position_value("quantity", "current_price", "accrued_interest")
    return v.account_position.select("account_id", "ticker", value.alias("value"))


@register(
    "b17_large_position_value",
    """select l_orderkey, l_linenumber, cast(cast(l_orderkey as hugeint) * 120000000 * l_linenumber as decimal(28,9)) as value from lineitem""",
)
def large_position_value(v: Views) -> DataFrame:
    """Quantities of twelve billion and more at a few hundredths: the product fits, its factors are wide."""
    quantity = (F.col("l_orderkey").cast("decimal(18,0)") * F.lit("12000000000").cast("decimal(11,0)")).cast(PRICE)
    price = (F.col("l_linenumber").cast("decimal(10,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(PRICE)
    value = money.position_value(quantity, price, F.lit(None).cast(PRICE))
    return v.raw("lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))


@register(
    "b18_cost_and_result",
    """select account_id, ticker, cast(basis as decimal(28,9)) as cost_basis, cast(value - basis as decimal(28,9)) as unrealized_pnl
      from (select account_id, ticker, cast(quantity as decimal(18,4)) * cast(average_price as decimal(18,4)) as basis,
        cast(quantity as decimal(18,4)) * cast(current_price + accrued_interest as decimal(18,4)) as value
        from v_account_position) t""",
)
def cost_and_result(v: Views) -> DataFrame:
    states = portfolio.position_states(v.account_position)
    return states.select("account_id", "ticker", "cost_basis", "unrealized_pnl")


_SNAPSHOT_NOW = "2001-07-15 12:00:00"


@register(
    "b19_age_seconds",
    f"""select event_id, case when event_type <> 'error' then greatest(0, cast(trunc(
      (epoch_us(timestamp '{_SNAPSHOT_NOW}') - epoch_us(ts)) / 1000000.0) as bigint)) end as age from v_event""",
)
def age_seconds(v: Views) -> DataFrame:
    captured = F.when(F.col("event_type") != "error", F.col("ts"))
    age = money.age_seconds(captured, F.lit(_SNAPSHOT_NOW).cast("timestamp"))
    return v.event.select("event_id", age.alias("age"))


@register(
    "b20_staleness",
    f"""select event_id, event_type <> 'error' and greatest(0, trunc(
      (epoch_us(timestamp '{_SNAPSHOT_NOW}') - epoch_us(ts)) / 1000000.0)) > greatest(3 * user_id * 600, 180) as stale from v_event""",
)
def staleness(v: Views) -> DataFrame:
    captured = F.when(F.col("event_type") != "error", F.col("ts"))
    now = F.lit(_SNAPSHOT_NOW).cast("timestamp")
    stale = money.is_stale(captured, now, F.col("user_id") * 600)
    return v.event.select("event_id", stale.alias("stale"))


@register(
    "b21_run_seconds",
    """select id, case when finished_at is not null then cast(trunc((epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0) as bigint) end as seconds
      from v_ranking_run""",
)
def run_seconds(v: Views) -> DataFrame:
    return v.ranking_run.select("id", money.run_seconds("started_at", "finished_at").alias("seconds"))


_USER_SQL = """select user_id, count(*) as n, count(*) filter (where event_type = 'error') as bad,
      count(*) filter (where event_type = 'click') as clicks from v_event group by user_id"""


def _users(v: Views) -> DataFrame:
    return v.event.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "error").alias("bad"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
    )


@register(
    "b22_ratio_rounding",
    f"""select user_id, cast(round_even(cast(bad as double) / n, 4) as decimal(18,4)) as ratio,
      case when bad > 0 then cast(round_even(cast(clicks as double) / bad, 4) as decimal(18,4)) end as per_error
      from ({_USER_SQL}) u""",
)
def ratio_rounding(v: Views) -> DataFrame:
    return _users(v).select(
        "user_id",
        money.ratio4("bad", "n").alias("ratio"),
        money.ratio4("clicks", "bad").alias("per_error"),
    )


@register(
    "b23_collected_but_empty",
    """select asset_id, cov > 0 and val < 0.01 as empty_looking from (select asset_id,
      cast(round_even(count(distinct session_date) / 30.0, 4) as decimal(18,4)) as cov,
      cast(round_even(count(jur_long) / cast(count(*) as double), 4) as decimal(18,4)) as val
      from v_position group by asset_id) t""",
)
def collected_but_empty(v: Views) -> DataFrame:
    per_asset = v.position.groupBy("asset_id").agg(
        F.countDistinct("session_date").alias("days"),
        F.count("jur_long").alias("v"),
        F.count("*").alias("n"),
    )
    return per_asset.select(
        "asset_id",
        money.collected_but_empty(
            money.ratio4("days", F.lit(30)), money.ratio4("v", "n")
        ).alias("empty_looking"),
    )


@register(
    "b24_decimal_text",
    "select price_series_id, session_date, cast(close as varchar) as close_text from v_bar",
)
def decimal_text(v: Views) -> DataFrame:
    return v.bar.select(
        "price_series_id", "session_date", money.decimal_text("close").alias("close_text")
    )


@register(
    "b25_plan_action",
    """select account_id, ticker, case when d > 0 then 'buy' when d < 0 then 'sell' else 'keep' end as action
      from (select account_id, ticker, quantity - 25 as d from v_account_position) t""",
)
def plan_action(v: Views) -> DataFrame:
    action = money.plan_action(F.col("quantity") - 25)
    return v.account_position.select("account_id", "ticker", action.alias("action"))


@register(
    "b26_account_mask",
    """select c_custkey, case when c_nationkey = 0 then '••' else concat('•• ', right(concat('20000', cast(c_custkey as varchar)), 4)) end as masked
      from customer""",
)
def account_mask(v: Views) -> DataFrame:
    number = F.when(F.col("c_nationkey") == 0, F.lit("")).otherwise(
        F.concat(F.lit("20000"), F.col("c_custkey").cast("string"))
    )
    return v.raw("customer").select("c_custkey", money.mask_account(number).alias("masked"))


@register(
    "b27_section_status",
    """select asof_date, case when running > 0 then 'running' when gap > 0 then 'data_gap' when paused then 'paused'
      when failed then 'failed' when queued > 0 then 'lagging' when ready = done then 'up_to_date' else 'waiting' end as status
      from (select asof_date, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'queued') as queued,
        case when count(*) > 12 then 1 else 0 end as gap, min(id) < 100 as paused,
        max(case when status = 'failed' then finished_at end) > max(case when status = 'success' then finished_at end) as failed,
        asof_date as ready, max(case when status = 'success' then asof_date end) as done
        from v_ranking_run group by asof_date) t""",
)
def section_status(v: Views) -> DataFrame:
    def last(status: str, c: str):
        return F.max(F.when(F.col("status") == status, F.col(c)))

    daily = v.ranking_run.groupBy("asof_date").agg(
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count("*").alias("n"),
        F.min("id").alias("first_id"),
        last("failed", "finished_at").alias("failed_at"),
        last("success", "finished_at").alias("succeeded_at"),
        last("success", "asof_date").alias("done"),
    )
    status = money.section_status(
        running=F.col("running") > 0,
        gap=F.when(F.col("n") > 12, 1).otherwise(0),
        paused=F.col("first_id") < 100,
        failed=F.col("failed_at") > F.col("succeeded_at"),
        queued=F.col("queued"),
        data_ready=F.col("asof_date"),
        last_success=F.col("done"),
    )
    return daily.select("asof_date", status.alias("status"))


@register(
    "b28_display_round",
    """select c_custkey, cast(round(x * 100, 1) as decimal(38,1)) as shown_percent, cast(round(x, 2) as decimal(38,2)) as shown
      from (select c_custkey, cast(cast(c_acctbal as decimal(18,2)) * cast('0.0125' as decimal(5,4)) as decimal(28,9)) as x from customer) t""",
)
def display_round(v: Views) -> DataFrame:
    x = (F.col("c_acctbal").cast("decimal(18,2)") * F.lit("0.0125").cast("decimal(5,4)")).cast(PRICE)
    rows = v.raw("customer").select("c_custkey", x.alias("x"))
    return rows.select(
        "c_custkey",
        money.display_round(money.shift_percent("x"), 1).alias("shown_percent"),
        money.display_round("x", 2).alias("shown"),
    )
