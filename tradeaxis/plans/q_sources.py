"""Landed input to domain rows.

Landed pages and answers are rendered from the driver's tables by Spark, a page per order, month or
position, and read back; the SQL twin starts from the values they were rendered from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.functions import parse
from tradeaxis.operators import store
from tradeaxis.plans.registry import register
from tradeaxis.sources import dividends as dv
from tradeaxis.sources import equity, landed, pages, positions, reference, series
from tradeaxis.views import TRADE_ORDER, Views

_SQL_PRICE = "cast(cast(o_totalprice as decimal(18,2)) as varchar)"


def _price_text():
    return F.col("o_totalprice").cast("decimal(18,2)").cast("string")


def _order_pages(v: Views) -> DataFrame:
    """One page per order: a whole row, a row that is too short, and one that is too long."""
    cust, day = F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    names = F.array(F.lit("SECID"), F.lit("TRADEDATE"), F.lit("CLOSE"))
    data = F.array(
        F.array(cust, day, _price_text()),
        F.array(cust, day),
        F.array(cust, day, F.lit(None).cast("string"), F.lit("extra")),
    )
    body = F.to_json(F.struct(names.alias("columns"), data.alias("data")), {"ignoreNullFields": "false"})
    return v.orders.select(
        day.alias("request"), F.col("o_orderkey").alias("page"), body.alias("body")
    )


@register(
    "a01_block_unpack",
    f"""select o_orderkey as page, pos, cast(o_custkey as varchar) as "SECID", strftime(o_orderdate, '%Y-%m-%d') as "TRADEDATE",
      case when pos = 0 then {_SQL_PRICE} end as "CLOSE" from orders, (select unnest([0, 1, 2]) as pos) p""",
)
def block_unpack(v: Views) -> DataFrame:
    blocks = landed.parse_pages(_order_pages(v), "body")
    return landed.unpack(blocks, ["SECID", "TRADEDATE", "CLOSE"]).drop("request")


@register(
    "a02_page_concatenation",
    """select strftime(o_orderdate, '%Y-%m-%d') as request, 3 * count(*) as rows,
        cast(arg_min(o_custkey, o_orderkey) as varchar) as first_row, cast(arg_max(o_custkey, o_orderkey) as varchar) as last_row
      from orders group by 1""",
)
def page_concatenation(v: Views) -> DataFrame:
    rows = landed.unpack(landed.parse_pages(_order_pages(v), "body"), ["SECID"])
    order = F.struct("page", "pos")
    return rows.groupBy("request").agg(
        F.count("*").alias("rows"),
        F.min_by("SECID", order).alias("first_row"),
        F.max_by("SECID", order).alias("last_row"),
    )


_SECID_SQL = """case o_orderpriority when '1-URGENT' then ' imoex ' when '2-HIGH' then 'RTSI' when '3-MEDIUM' then 'usd000utstom'
      when '5-LOW' then 'RVI' else 'GAZP' end"""


def _series_rows(v: Views) -> DataFrame:
    p = F.col("o_orderpriority")
    secid = (
        F.when(p == "1-URGENT", " imoex ")
        .when(p == "2-HIGH", "RTSI")
        .when(p == "3-MEDIUM", "usd000utstom")
        .when(p == "5-LOW", "RVI")
        .otherwise("GAZP")
    )
    value = F.when(F.col("o_orderstatus") != "P", _price_text()).otherwise(F.lit(""))
    day = F.when(F.col("o_orderstatus") != "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-31")
    )
    return v.orders.select(
        "o_orderkey", secid.alias("SECID"), day.alias("TRADEDATE"), value.alias("CLOSE")
    )


_SERIES_SQL = f"""select o_orderkey, case upper(trim(secid)) when 'USD000UTSTOM' then 'USD_ISS' else upper(trim(secid)) end as series_id,
      day, value from (select o_orderkey, {_SECID_SQL} as secid,
        cast(try_strptime(case when o_orderstatus <> 'F' then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%m-31') end, '%Y-%m-%d') as date) as day,
        case when o_orderstatus <> 'P' then cast(cast(o_totalprice as decimal(18,2)) as decimal(28,9)) end as value from orders) t
      where upper(trim(secid)) <> 'GAZP'"""


@register("a03_declared_series", f"select o_orderkey, series_id from ({_SERIES_SQL}) s")
def declared_series(v: Views) -> DataFrame:
    rows = series.declared(_series_rows(v), series.specs(v.spark))
    return rows.select("o_orderkey", "series_id")


@register(
    "f04_values_by_date",
    f"""select series_id, day as session_date, arg_max(coalesce(cast(value as varchar), 'none'), o_orderkey) as value
      from ({_SERIES_SQL}) s where day is not null group by 1, 2""",
)
def values_by_date(v: Views) -> DataFrame:
    rows = series.declared(_series_rows(v), series.specs(v.spark))
    values = series.values_by_date(rows, "TRADEDATE", "CLOSE", ["o_orderkey"])
    return values.withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit("none")))


@register(
    "a04_open_interest",
    """select upper(trim(p_type)) as asset_code, sum(case when p_size >= 10 then p_size else 0 end) as open_interest
      from part group by 1""",
)
def open_interest(v: Views) -> DataFrame:
    rows = v.raw("part").select(
        F.concat(F.lit(" "), F.lower("p_type")).alias("ASSETCODE"),
        F.when(F.col("p_size") >= 10, F.col("p_size").cast("string")).alias("PREVOPENPOSITION"),
    )
    return landed.open_interest(rows)


_LOT_TEXT_SQL = "case when p_size < 10 then null when p_size < 20 then 'abc' when p_size < 25 then '0' else cast(p_size as varchar) end"


@register(
    "a05_lot_sizes",
    f"""select concat('EQ_AST_', upper(trim(p_type))) as asset_id, upper(trim(p_type)) as ticker, arg_max(try_cast(lot as int), p_partkey) as lot_size
      from (select p_partkey, p_type, {_LOT_TEXT_SQL} as lot from part) t where try_cast(lot as int) > 0 group by 1, 2""",
)
def lot_sizes(v: Views) -> DataFrame:
    size = F.col("p_size")
    lot = (
        F.when(size < 10, F.lit(None).cast("string"))
        .when(size < 20, "abc")
        .when(size < 25, "0")
        .otherwise(size.cast("string"))
    )
    rows = v.raw("part").select(
        "p_partkey", F.concat(F.lower("p_type"), F.lit(" ")).alias("SECID"), lot.alias("LOTSIZE")
    )
    return landed.lot_sizes(rows, ["p_partkey"])


@register(
    "a06_index_titles",
    """select upper(trim(p_brand)) as index_id, arg_max(case when p_size < 10 then '' else trim(p_type) end, p_partkey) as title
      from part group by 1""",
)
def index_titles(v: Views) -> DataFrame:
    title = F.when(F.col("p_size") < 10, F.lit("  ")).otherwise(F.col("p_type"))
    rows = v.raw("part").select(
        "p_partkey", F.lower("p_brand").alias("indexid"), title.alias("shortname")
    )
    return landed.index_titles(rows, ["p_partkey"])


# --- pages ---------------------------------------------------------------------------------------


def _local(c):
    """A decimal the way the pages print it: no-break space after the first digit, comma."""
    text = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.concat(
        F.substring(text, 1, 1), F.lit(" "), F.replace(F.expr("substr(_t, 2)"), F.lit("."), F.lit(","))
    )


def _rendered(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("_t", F.col(value).cast("string")).withColumn("cell", _local("_t")).drop("_t")


def _rate_pages(v: Views) -> DataFrame:
    """A page per series and month; the pages of one series carry no rate table."""
    row = F.concat(
        F.lit("<tr><td> "),
        F.date_format("session_date", "dd.MM.yyyy"),
        F.lit("</td><td><b>"),
        F.col("cell"),
        F.lit("</b></td></tr><tr><td>a</td><td>b</td><td>c</td></tr>"),
    )
    monthly = (
        _rendered(v.global_series, "value")
        .withColumn("month", F.date_format("session_date", "yyyy-MM"))
        .groupBy("series_id", "month")
        .agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    )
    css = F.when(F.col("series_id") == "IDX_5", "other").otherwise("wide data")
    html = F.concat(
        F.lit("<html><body><table><tr><td>01.01.2000</td><td>1</td></tr></table><table class='"),
        css,
        F.lit("'><tr><th>Дата</th><th>Ставка</th></tr>"),
        F.col("rows"),
        F.lit("</table></body></html>"),
    )
    return monthly.select(
        F.concat_ws("/", "series_id", "month").alias("page_id"), html.alias("html")
    )


@register(
    "a07_rate_pages",
    """select concat(series_id, '/', strftime(session_date, '%Y-%m')) as page_id, 'CBR_KEY_RATE' as series_id, session_date, value
      from v_global where series_id <> 'IDX_5'""",
)
def rate_pages(v: Views) -> DataFrame:
    return pages.rate_values(_rate_pages(v)).drop("row")


@register(
    "a07_failed_rate_pages",
    """select distinct concat(series_id, '/', strftime(session_date, '%Y-%m')) as page_id from v_global where series_id = 'IDX_5'""",
)
def failed_rate_pages(v: Views) -> DataFrame:
    rendered = _rate_pages(v)
    return pages.failed_rate_pages(rendered)


@register(
    "a08_curve_pages",
    f"""select strftime(session_date, '%Y-%m') as page_id, concat('CBR_ZCYC_', term) as series_id, session_date,
        cast(value + i as decimal(28,9)) as value
      from (select session_date, max(value) as value from v_global group by 1) d,
        (select unnest({list(pages.CURVE_TERMS)}) as term, unnest(range(12)) as i) t""",
)
def curve_pages(v: Views) -> DataFrame:
    return pages.curve_values(_curve_pages(v)).drop("row")


def _curve_pages(v: Views) -> DataFrame:
    daily = v.global_series.groupBy("session_date").agg(F.max("value").alias("value"))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda i: F.concat(
            F.lit("<td>"),
            F.replace((F.col("value") + i).cast("decimal(28,9)").cast("string"), F.lit("."), F.lit(",")),
            F.lit("</td>"),
        ),
    )
    row = F.concat(
        F.lit("<tr><td>"),
        F.date_format("session_date", "dd.MM.yyyy"),
        F.lit("</td>"),
        F.array_join(cells, ""),
        F.lit("</tr>"),
    )
    html = F.concat(
        F.lit("<table><tr><td>01.01.2000</td></tr></table><div class='table-wrapper'><table><tr><th>Дата</th></tr>"),
        F.col("rows"),
        F.lit("</table></div>"),
    )
    return (
        daily.groupBy(F.date_format("session_date", "yyyy-MM").alias("page_id"))
        .agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
        .select("page_id", html.alias("html"))
    )


def _position_pages(v: Views) -> DataFrame:
    """A page per stored position; without a long leg the page is about the day before."""

    def cell(c: str):
        text = F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
        return F.concat(F.lit("<td>"), F.coalesce(text, F.lit("")), F.lit("</td>"))

    shown = F.when(F.col("fiz_long").isNotNull(), F.col("session_date")).otherwise(
        F.date_sub("session_date", 1)
    )
    html = F.concat(
        F.lit("<span class='text-center'>Данные на "),
        F.date_format(shown, "dd.MM.yyyy"),
        F.lit("</span><table class='table1 _full-width table1'><tr><td>Количество лиц</td>"),
        F.lit("<td>1</td><td>1</td><td>1</td><td>1</td><td>4</td></tr><tr><td>Количество  <br/>договоров, шт</td>"),
        cell("fiz_long"),
        cell("fiz_short"),
        cell("jur_long"),
        cell("jur_short"),
        F.lit("<td>0</td></tr></table>"),
    )
    return v.position.select(
        F.concat_ws("/", "asset_id", "session_date").alias("page_id"),
        "asset_id",
        "session_date",
        html.alias("html"),
    )


@register(
    "a09_position_pages",
    """select concat(asset_id, '/', cast(session_date as varchar)) as page_id,
        case when fiz_long is null then session_date - 1 else session_date end as trade_date,
        fiz_long, fiz_short, jur_long, jur_short from v_position""",
)
def position_pages(v: Views) -> DataFrame:
    return pages.position_values(_position_pages(v))


@register(
    "a10_snapshot_date",
    "select asset_id, session_date, fiz_long, fiz_short, jur_long, jur_short from v_position where fiz_long is not null",
)
def snapshot_date(v: Views) -> DataFrame:
    rendered = _position_pages(v)
    asked = rendered.select("page_id", "asset_id", "session_date")
    snapshots = pages.position_values(rendered).join(asked, "page_id")
    kept = pages.of_requested_date(snapshots)
    return kept.select("asset_id", "session_date", "fiz_long", "fiz_short", "jur_long", "jur_short")


# --- quotes, aggregates, history -----------------------------------------------------------------

_FIRST = ", ".join(TRADE_ORDER)
_LAST = ", ".join(f"{c} desc" for c in TRADE_ORDER)


def _quote_rows(v: Views) -> DataFrame:
    """Line items as quote rows: blank tickers for one flag, prices missing for returns."""
    px = F.col("px").cast("string")
    return v.trade.select(
        "session_date",
        F.date_format("session_date", "yyyy-MM-dd").alias("TRADEDATE"),
        F.when(F.col("l_discount") == 0, F.lit(" ")).otherwise(F.lower("ticker")).alias("SECID"),
        px.alias("OPEN"),
        px.alias("HIGH"),
        F.when(F.col("l_linestatus") == "F", px).otherwise(F.lit("-")).alias("LOW"),
        F.when(F.col("l_returnflag") != "R", px).otherwise(F.lit("")).alias("CLOSE"),
        F.col("qty").cast("string").alias("VOLUME"),
        px.alias("VALUE"),
        F.col("l_linenumber").cast("string").alias("NUMTRADES"),
        F.lit(None).cast("string").alias("WAPRICE"),
        *TRADE_ORDER,
    )


_QUOTE_SQL = """select concat('EQ_PRS_', ticker) as price_series_id, concat('EQ_AST_', ticker) as asset_id, session_date, px as open, px as high,
    case when l_linestatus = 'F' then px end as low, case when l_returnflag <> 'R' then px end as close, cast(qty as decimal(28,9)) as volume
  from (select *, row_number() over (partition by ticker, session_date order by {order}) as rn from v_trade where l_discount <> 0) t where rn = 1"""


@register("f01_first_quote_wins", _QUOTE_SQL.format(order=_FIRST))
def first_quote_wins(v: Views) -> DataFrame:
    return equity.bars(_quote_rows(v), list(TRADE_ORDER)).drop("source_revision")


_AGGREGATE_SQL = f"""select concat('EQ_PRS_', ticker) as price_series_id, concat('EQ_AST_', ticker) as asset_id, session_date, px as value,
        cast(l_linenumber as decimal(28,9)) as num_trades, cast(null as decimal(28,9)) as waprice
      from (select *, row_number() over (partition by ticker, session_date order by {_FIRST}) as rn from v_trade where l_discount <> 0) t where rn = 1"""


@register("f02_first_aggregate_wins", _AGGREGATE_SQL)
def first_aggregate_wins(v: Views) -> DataFrame:
    return equity.aggregates(_quote_rows(v), list(TRADE_ORDER))


@register("f03_last_history_row_wins", _QUOTE_SQL.format(order=_LAST))
def last_history_row_wins(v: Views) -> DataFrame:
    rows = _quote_rows(v).drop("session_date")
    return equity.history_bars(rows, list(TRADE_ORDER)).drop("source_revision")


# --- oil, sectors, weights -----------------------------------------------------------------------


@register(
    "e04_front_contract",
    """select session_date, secid, expiry, close from (select *, row_number() over (partition by session_date order by expiry, secid, o_orderkey) as rn from (
        select o_orderkey, cast(o_orderdate as date) as session_date, concat('BR', cast(o_custkey as varchar)) as secid,
          last_day(make_date(2000 + cast(strftime(o_orderdate, '%y') as int), m, 1)) as expiry, cast(cast(o_totalprice as decimal(18,2)) as decimal(28,9)) as close
        from (select *, cast(month(o_orderdate) + cast(substr(o_orderpriority, 1, 1) as int) - 2 as int) as m from orders) o
        where m between 1 and 12) c where expiry >= session_date) r where rn = 1""",
)
def front_contract(v: Views) -> DataFrame:
    return series.front_contract(_oil_rows(v), ["o_orderkey"])


def _oil_rows(v: Views) -> DataFrame:
    month = F.month("o_orderdate") + F.substring("o_orderpriority", 1, 1).cast("int") - 2
    return v.orders.select(
        F.to_date("o_orderdate").alias("session_date"),
        F.concat(F.lit("br"), F.col("o_custkey").cast("string")).alias("SECID"),
        F.concat(F.lit("BR-"), month, F.date_format("o_orderdate", ".yy")).alias("SHORTNAME"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("CLOSE"),
        "o_orderkey",
    )


def _analytics(v: Views) -> DataFrame:
    weight = F.when(F.col("l_tax") == 0, F.lit("")).otherwise(F.col("qty").cast("string"))
    return v.trade.select(
        F.lower("ticker").alias("ticker"),
        weight.alias("weight"),
        F.date_format("session_date", "yyyy-MM-dd").alias("tradedate"),
        F.concat(F.lit("MOEX"), "l_returnflag", "l_linestatus").alias("index_id"),
        "session_date",
        *TRADE_ORDER,
    )


_HEAVIEST_SQL = """select ticker, index_id from (select ticker, concat('MOEX', l_returnflag, l_linestatus) as index_id,
    row_number() over (partition by ticker order by qty desc, session_date desc, concat('MOEX', l_returnflag, l_linestatus) desc) as rn
  from v_trade where l_tax <> 0) t where rn = 1"""


@register("e02_heaviest_index", _HEAVIEST_SQL)
def heaviest_index(v: Views) -> DataFrame:
    return reference.heaviest_index(_analytics(v))


@register(
    "d08_sector_titles",
    f"""select concat('EQ_AST_', ticker) as asset_id, case when index_id like 'MOEXR%' then index_id else concat('Index ', lower(index_id)) end as sector
      from ({_HEAVIEST_SQL}) h""",
)
def sector_titles(v: Views) -> DataFrame:
    return reference.sectors(_analytics(v), _titles(v))


def _titles(v: Views) -> DataFrame:
    rows = _analytics(v)
    title = F.when(F.col("index_id").startswith("MOEXR"), F.lit("")).otherwise(
        F.concat(F.lit("Index "), F.lower("index_id"))
    )
    return rows.select("index_id").distinct().select("index_id", title.alias("title"))


@register("e02_sectors_outcome", "select case when count(*) = 0 then 'failed_empty' else 'ok' end as outcome from v_trade where l_tax <> 0")
def sectors_outcome(v: Views) -> DataFrame:
    return reference.sectors_outcome(reference.heaviest_index(_analytics(v)))


@register(
    "f05_index_weights",
    f"""select series_id, session_date, value from (select concat('IDX_WEIGHT_MOEX', l_returnflag, l_linestatus, '_', ticker) as series_id,
        session_date, cast(qty as decimal(28,9)) as value, row_number() over (partition by l_returnflag, l_linestatus, ticker, session_date order by {_LAST}) as rn
      from v_trade where l_tax <> 0 and l_returnflag <> 'A') t where rn = 1""",
)
def index_weights(v: Views) -> DataFrame:
    return reference.index_weights(_weight_rows(v), list(TRADE_ORDER))


def _weight_rows(v: Views) -> DataFrame:
    """Rows of one flag are dated a day off, of another have a date that cannot be read."""
    flag = F.substring("index_id", 5, 1)
    shifted = F.date_format(F.date_add("session_date", 1), "yyyy-MM-dd")
    dated = F.when(flag == "A", shifted).when(flag == "N", F.lit("soon")).otherwise(F.col("tradedate"))
    return _analytics(v).withColumn("tradedate", dated)


# --- positions -----------------------------------------------------------------------------------


@register(
    "d07_contract_choice",
    """with oi as (select p_type as code, sum(p_size) as oi from part where p_size >= 40 group by 1),
        pairs as (select distinct upper(p_brand) as ticker, upper(p_type) as code from part)
      select ticker, concat(arg_min(code, (-coalesce(oi, 0), code)), '_F') as contract
      from pairs left join (select upper(code) as code, oi from oi) o using (code) group by ticker""",
)
def contract_choice(v: Views) -> DataFrame:
    part = v.raw("part")
    rows = part.select(F.lower("p_brand").alias("underlying_asset"), F.col("p_type").alias("asset_code"))
    held = part.filter("p_size >= 40").select(
        F.col("p_type").alias("ASSETCODE"), F.col("p_size").cast("string").alias("PREVOPENPOSITION")
    )
    return positions.contract_map(rows, landed.open_interest(held))


@register(
    "e03_contract_by_interest",
    """with oi as (select upper(p_type) as code, sum(p_size) as oi from part group by 1),
        pairs as (select distinct upper(p_brand) as ticker, upper(p_type) as code from part),
        r as (select ticker, code, row_number() over (partition by ticker order by oi desc, code) as rn from pairs join oi using (code))
      select ticker, concat(code, '_F') as contract from r where rn = 1""",
)
def contract_by_interest(v: Views) -> DataFrame:
    part = v.raw("part")
    rows = part.select(F.col("p_brand").alias("underlying_asset"), F.lower("p_type").alias("asset_code"))
    held = part.select(
        F.col("p_type").alias("ASSETCODE"), F.col("p_size").cast("string").alias("PREVOPENPOSITION")
    )
    return positions.contract_map(rows, landed.open_interest(held))


def _tickers(v: Views) -> DataFrame:
    return v.asset.select(F.expr("substr(asset_id, 8)").alias("ticker"), "lot_size")


def _contracts(v: Views) -> DataFrame:
    """Every asset with a lot has a contract."""
    known = _tickers(v).filter("lot_size IS NOT NULL")
    return known.select("ticker", F.concat("ticker", F.lit("_F")).alias("contract"))


def _discovered(v: Views) -> DataFrame:
    """Contracts were searched where the lot is above one; only lots of ten were found."""
    lot = F.col("lot_size")
    found = F.when(lot == 10, F.lit("2001-07-12").cast("date"))
    return _tickers(v).filter("lot_size IS NOT NULL").select(
        F.concat("ticker", F.lit("_F")).alias("contract"),
        (lot > 1).alias("searched"),
        found.alias("first_available"),
    )


def _july(v: Views) -> DataFrame:
    return v.position.select("session_date").distinct()


_PAIRS_SQL = """select a.asset_id, substr(a.asset_id, 8) as ticker, concat(substr(a.asset_id, 8), '_F') as contract, d.session_date,
    case when d.session_date >= f.first_date then true when a.lot_size = 10 then d.session_date >= date '2001-07-12'
      else a.lot_size = 1 end as existed
  from v_asset a cross join (select distinct session_date from v_position) d
  left join (select asset_id, min(session_date) as first_date from v_position
    where coalesce(fiz_long, fiz_short, jur_long, jur_short) is not null and session_date >= date '2001-07-05' group by 1) f on f.asset_id = a.asset_id
  where a.lot_size is not null"""


def _later(v: Views) -> DataFrame:
    """Positions as if collection had begun on the fifth."""
    return v.position.filter(F.col("session_date") >= F.lit("2001-07-05").cast("date"))


@register("d06_existed_then", f"select asset_id, session_date, existed from ({_PAIRS_SQL}) p")
def existed_then(v: Views) -> DataFrame:
    july = _july(v).agg(F.array_sort(F.collect_set("session_date"))).scalar()
    pairs = _contracts(v).select(
        parse.asset_id("ticker").alias("asset_id"), "contract", F.explode(july).alias("session_date")
    )
    judged = positions.existed_then(pairs, store.first_filled_dates(_later(v)), _discovered(v))
    return judged.select("asset_id", "session_date", "existed")


@register(
    "d05_work_list",
    f"""select asset_id, ticker, contract, session_date from ({_PAIRS_SQL}) p where existed
      and (asset_id, session_date) not in (select (asset_id, session_date) from v_position
        where coalesce(fiz_long, fiz_short, jur_long, jur_short) is not null and session_date >= date '2001-07-05')""",
)
def work_list(v: Views) -> DataFrame:
    return positions.work_list(
        _july(v), _tickers(v), _contracts(v), _later(v), _discovered(v)
    )


@register(
    "d05_work_list_all",
    """select a.asset_id, substr(a.asset_id, 8) as ticker, concat(substr(a.asset_id, 8), '_F') as contract, d.session_date
      from v_asset a cross join v_session d
      left join (select asset_id, min(session_date) as first_date from v_position
        where coalesce(fiz_long, fiz_short, jur_long, jur_short) is not null group by 1) f on f.asset_id = a.asset_id
      where a.lot_size is not null and (d.session_date >= f.first_date or (a.lot_size = 10 and d.session_date >= date '2001-07-12') or a.lot_size = 1)
        and (a.asset_id, d.session_date) not in (select (asset_id, session_date) from v_position
          where coalesce(fiz_long, fiz_short, jur_long, jur_short) is not null)""",
)
def work_list_all(v: Views) -> DataFrame:
    """All that is to be asked over the whole calendar."""
    return positions.work_list(v.session, _tickers(v), _contracts(v), v.position, _discovered(v))


@register(
    "f06_positions_outcome",
    """select session_date, count(*) as requested, count(coalesce(jur_long, jur_short)) as filled,
        case when count(coalesce(jur_long, jur_short)) = 0 then 'failed_empty' else 'ok' end as outcome from v_position group by 1""",
)
def positions_outcome(v: Views) -> DataFrame:
    nothing = F.lit(None).cast("decimal(28,9)")
    rows = v.position.withColumn("fiz_long", nothing).withColumn("fiz_short", nothing)
    return positions.session_outcome(v.position.select("asset_id", "session_date"), rows)


# --- dividends -----------------------------------------------------------------------------------


def _instruments(v: Views) -> DataFrame:
    currency = (
        F.when(F.col("c_nationkey") < 8, "RUB").when(F.col("c_nationkey") < 16, " ").otherwise("usd")
    )
    figi = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(
        F.concat(F.lit("BBG"), F.col("c_custkey").cast("string"))
    )
    number = F.lpad(F.col("c_nationkey").cast("string"), 9, "0")
    return v.raw("customer").select(
        "c_custkey",
        F.concat(F.lit(" s"), number).alias("ticker"),
        figi.alias("figi"),
        currency.alias("currency"),
    )


_MATCH_SQL = """select concat('S', lpad(cast(c_nationkey as varchar), 9, '0')) as ticker, concat('BBG', cast(max(c_custkey) as varchar)) as figi
  from customer where c_nationkey < 16 and c_mktsegment <> 'MACHINERY' and concat('S', lpad(cast(c_nationkey as varchar), 9, '0')) in
    (select ticker from v_asset) group by c_nationkey"""


@register("c08_instrument_match", _MATCH_SQL)
def instrument_match(v: Views) -> DataFrame:
    return dv.match_instruments(_instruments(v), v.asset, ["c_custkey"])


def _responses(v: Views) -> DataFrame:
    """Broker answers keyed by instrument: no record date for open orders, no amount for partial."""
    status = F.col("o_orderstatus")
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    return v.orders.select(
        "o_orderkey",
        F.concat(F.lit("BBG"), F.col("o_custkey").cast("string")).alias("figi"),
        F.when(status != "O", F.col("o_orderdate")).alias("record_date"),
        F.lit(None).cast("timestamp").alias("declared_date"),
        F.col("o_orderdate").alias("last_buy_date"),
        F.date_add("o_orderdate", 9).alias("payment_date"),
        F.when(status == "F", F.floor(cents)).alias("units"),
        F.when(status == "F", ((cents - F.floor(cents)) * 1000000000).cast("bigint")).alias("nano"),
    )


_EVENT_SQL = """select {head}, cast(o_orderdate as date) as record_date, cast(null as date) as declared_date,
    cast(o_orderdate as date) as last_buy_date, cast(o_orderdate as date) + 9 as payment_date,
    case when o_orderstatus = 'F' then cast(cast(o_totalprice as decimal(18,2)) as decimal(28,9)) end as value
  from orders {join} where o_orderstatus <> 'O'"""


@register(
    "f21_dividend_events",
    _EVENT_SQL.format(head="concat('EQ_AST_BBG', cast(o_custkey as varchar)) as asset_id", join=""),
)
def dividend_events(v: Views) -> DataFrame:
    return dv.events(_responses(v).withColumnRenamed("figi", "ticker"))


@register(
    "d14_instrument_join",
    _EVENT_SQL.format(
        head="concat('EQ_AST_', ticker) as asset_id",
        join=f"join ({_MATCH_SQL}) m on m.figi = concat('BBG', cast(o_custkey as varchar))",
    ),
)
def instrument_join(v: Views) -> DataFrame:
    matched = dv.match_instruments(_instruments(v), v.asset, ["c_custkey"])
    return dv.events(dv.for_known_assets(_responses(v), matched))
