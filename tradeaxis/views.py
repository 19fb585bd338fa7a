"""Domain tables over the driver's tables, once for Spark and once as SQL for the oracle.

Each Spark view is written for Spark: first and last trades of a day are ``min_by``/``max_by`` in one
aggregate. The SQL text says the same with plain window functions and is what results are checked
against. Event days are shifted to July 2001 so that the journal overlaps bars and calendar.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeaxis.schema import PRICE

# Days between 2001-07-01 and 2024-01-01, where the events begin.
EVENT_SHIFT_DAYS = 8219

TRADE_ORDER = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
)


def _id(prefix: str, c: Column | str) -> Column:
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, 9, "0"))


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


class Views:
    """Lazily defined frames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.raw("lineitem")

    @cached_property
    def session(self) -> DataFrame:
        urgent = self.orders.filter(F.col("o_orderpriority") == "1-URGENT")
        return urgent.select(F.to_date("o_orderdate").alias("session_date")).distinct()

    @cached_property
    def asset(self) -> DataFrame:
        key = F.col("s_suppkey")
        lot = F.when(key % 7 == 0, None).otherwise(1 + (key % 3) * 9).cast("int")
        return self.raw("supplier").select(
            _id("EQ_AST_", key).alias("asset_id"), _id("S", key).alias("ticker"), lot.alias("lot_size")
        )

    @cached_property
    def trade(self) -> DataFrame:
        """Line items as trades of a session, every order column kept."""
        return self.lineitem.select(
            _id("EQ_PRS_", "l_suppkey").alias("price_series_id"),
            _id("EQ_AST_", "l_suppkey").alias("asset_id"),
            _id("S", "l_suppkey").alias("ticker"),
            F.to_date("l_shipdate").alias("session_date"),
            _exact("l_extendedprice").cast(PRICE).alias("px"),
            _exact("l_quantity").alias("qty"),
            "l_returnflag",
            "l_linestatus",
            *TRADE_ORDER,
        )

    @cached_property
    def bar(self) -> DataFrame:
        order = F.struct(*TRADE_ORDER)
        last = F.max_by(F.struct("px", "l_returnflag"), order)
        daily = (
            self.lineitem.select(
                "l_suppkey",
                F.to_date("l_shipdate").alias("session_date"),
                _exact("l_extendedprice").cast(PRICE).alias("px"),
                _exact("l_quantity").alias("qty"),
                "l_returnflag",
                *TRADE_ORDER,
            )
            .groupBy("l_suppkey", "session_date")
            .agg(
                F.min_by("px", order).alias("open"),
                F.max("px").alias("high"),
                F.min("px").alias("low"),
                last.alias("last"),
                F.sum("qty").cast(PRICE).alias("volume"),
            )
        )
        close = F.when(F.col("last.l_returnflag") != "R", F.col("last.px"))
        return daily.select(
            _id("EQ_PRS_", "l_suppkey").alias("price_series_id"),
            _id("EQ_AST_", "l_suppkey").alias("asset_id"),
            "session_date",
            "open",
            "high",
            "low",
            close.alias("close"),
            "volume",
        )

    @cached_property
    def aggregate(self) -> DataFrame:
        daily = (
            self.lineitem.select(
                "l_suppkey",
                F.to_date("l_shipdate").alias("session_date"),
                _exact("l_extendedprice").alias("px"),
                "l_returnflag",
            )
            .groupBy("l_suppkey", "session_date")
            .agg(
                F.sum("px").cast(PRICE).alias("value"),
                F.count("*").cast(PRICE).alias("num_trades"),
                F.max(F.when(F.col("l_returnflag") != "R", F.col("px"))).cast(PRICE).alias("waprice"),
            )
        )
        return daily.select(
            _id("EQ_PRS_", "l_suppkey").alias("price_series_id"),
            _id("EQ_AST_", "l_suppkey").alias("asset_id"),
            "session_date",
            "value",
            "num_trades",
            "waprice",
        )

    @cached_property
    def global_series(self) -> DataFrame:
        series = F.concat(F.lit("IDX_"), F.substring("o_orderpriority", 1, 1))
        return (
            self.orders.filter(F.col("o_orderstatus") != "P")
            .select(
                series.alias("series_id"),
                F.to_date("o_orderdate").alias("session_date"),
                _exact("o_totalprice").alias("v"),
            )
            .groupBy("series_id", "session_date")
            .agg(F.sum("v").cast(PRICE).alias("value"))
        )

    @cached_property
    def event(self) -> DataFrame:
        at = F.col("ts").cast("timestamp") - F.expr(f"INTERVAL {EVENT_SHIFT_DAYS} DAYS")
        return self.raw("events").select(
            "event_id",
            "user_id",
            "event_type",
            F.to_date(at).alias("session_date"),
            at.alias("ts"),
            "value",
        )

    @cached_property
    def position(self) -> DataFrame:
        v, kind, eid = _exact("value"), F.col("event_type"), F.col("event_id")

        def leg(cond: Column, name: str) -> Column:
            return F.sum(F.when(cond, v)).cast(PRICE).alias(name)

        return (
            self.event.filter(kind != "error")
            .withColumn("u", F.col("user_id") % 100)
            .groupBy("u", "session_date")
            .agg(
                leg(kind == "click", "fiz_long"),
                leg((kind == "view") & (eid % 5 == 0), "fiz_short"),
                leg((kind == "purchase") & (eid % 3 == 0), "jur_long"),
                leg(kind == "signup", "jur_short"),
            )
            .withColumn("asset_id", _id("EQ_AST_", "u"))
            .select("asset_id", "session_date", "fiz_long", "fiz_short", "jur_long", "jur_short")
        )

    @cached_property
    def ingest_run(self) -> DataFrame:
        kind, eid, uid = F.col("event_type"), F.col("event_id"), F.col("user_id")
        source = (
            F.when(kind == "click", "equity_d1")
            .when(kind == "view", "equity_agg")
            .when(kind == "purchase", "futures_positions")
            .when(kind == "signup", "cbr")
            .when(uid % 2 == 0, "equity_d1")
            .otherwise("brent")
        )
        status = F.when(kind == "error", "failed").when(eid % 11 == 0, "skipped").otherwise("ok")
        return self.event.select(
            eid.alias("id"),
            F.concat(F.lit("run-"), (eid % 500).cast("string")).alias("run_id"),
            "session_date",
            source.alias("source_id"),
            status.alias("status"),
            F.when(eid % 4 == 3, "catchup").otherwise("daily").alias("trigger"),
            F.when(kind == "error", F.concat(F.lit("user "), uid.cast("string"))).alias(
                "failure_reason"
            ),
            (eid % 4).cast("int").alias("rows_written"),
            F.col("ts").alias("started_at"),
            F.when(eid % 13 != 0, F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("finished_at"),
        )

    @cached_property
    def ranking(self) -> DataFrame:
        from pyspark.sql import Window

        scored = self.aggregate.select(
            F.col("session_date").alias("asof_date"), "asset_id", "price_series_id", F.col("value").alias("score")
        )
        # A day's partition is one row per asset: the universe of one decision date.
        by_day = Window.partitionBy("asof_date").orderBy(F.desc("score"), "asset_id")
        return scored.withColumn("rank", F.row_number().over(by_day).cast("int"))

    @cached_property
    def account(self) -> DataFrame:
        cash = F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(18,2)").cast(PRICE)
        return self.raw("customer").select(F.col("c_custkey").alias("account_id"), cash.alias("cash"))

    @cached_property
    def account_position(self) -> DataFrame:
        key, k = F.col("c_custkey"), F.col("k")
        four = self.raw("customer").select(
            "c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
        )
        average = F.when((key + k) % 9 != 0, (100 + (key * 7 + k) % 300).cast(PRICE))
        return four.select(
            key.alias("account_id"),
            _id("S", 1 + (key + k) % 100).alias("ticker"),
            F.when(k == 3, "bond").otherwise("share").alias("asset_type"),
            (1 + (key * k) % 50).cast(PRICE).alias("quantity"),
            average.alias("average_price"),
            (100 + (key * 11 + k * 13) % 300).cast(PRICE).alias("current_price"),
            F.when(k == 3, 2).otherwise(0).cast(PRICE).alias("accrued_interest"),
        )

    @cached_property
    def sector(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", "n_name")
        joined = self.raw("supplier").join(
            nation, F.col("s_nationkey") == F.col("n_nationkey"), "left"
        )
        sector = F.when(F.col("s_acctbal") >= 0, F.col("n_name"))
        return joined.select(_id("EQ_AST_", "s_suppkey").alias("asset_id"), sector.alias("sector"))

    @cached_property
    def dividend(self) -> DataFrame:
        """Payments per asset and ship month; the amount is unknown where no item was taxed."""
        day = F.to_date("l_shipdate")
        monthly = self.lineitem.groupBy("l_suppkey", F.last_day(day).alias("record_date")).agg(
            F.min(day).alias("declared_date"),
            F.max(day).alias("last_buy_date"),
            F.sum(_exact("l_tax")).alias("tax"),
        )
        value = F.nullif(F.col("tax"), F.lit(0).cast("decimal(28,2)")).cast(PRICE)
        return monthly.select(
            _id("EQ_AST_", "l_suppkey").alias("asset_id"),
            "record_date",
            "declared_date",
            "last_buy_date",
            F.date_add("record_date", 10).alias("payment_date"),
            value.alias("value"),
        )

    @cached_property
    def ranking_run(self) -> DataFrame:
        kind, at = F.col("o_orderstatus"), F.col("o_orderdate").cast("timestamp")
        status = (
            F.when(kind == "F", "failed")
            .when(kind == "O", "success")
            .when(F.col("o_orderpriority") < "3", "queued")
            .otherwise("running")
        )
        ended = at + F.make_dt_interval(secs=F.col("o_custkey").cast("decimal(18,6)"))
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.to_date("o_orderdate").alias("asof_date"),
            F.concat(F.lit("sha256:"), F.md5(F.col("o_custkey").cast("string"))).alias(
                "dataset_digest"
            ),
            F.substring("o_orderpriority", 1, 1).alias("model_id"),
            F.lit("1").alias("model_version"),
            status.alias("status"),
            at.alias("started_at"),
            F.when(kind.isin("F", "O"), ended).alias("finished_at"),
            F.when(kind == "F", "model_error").alias("error_code"),
        )

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The stored tables as the group registry names them."""
        return {
            "bar": self.bar,
            "aggregate": self.aggregate,
            "global_series": self.global_series,
            "position": self.position,
            "sector": self.sector,
        }


_TRADES = ", ".join(TRADE_ORDER)
_LATEST_TRADES = ", ".join(f"{c} desc" for c in TRADE_ORDER)


def _sql_id(prefix: str, c: str) -> str:
    return f"concat('{prefix}', lpad(cast({c} as varchar), 9, '0'))"


# The same views as SQL, in the order they build on each other.
VIEW_SQL: dict[str, str] = {
    "v_session": """
select distinct cast(o_orderdate as date) as session_date
from orders where o_orderpriority = '1-URGENT'""",
    "v_asset": f"""
select {_sql_id("EQ_AST_", "s_suppkey")} as asset_id, {_sql_id("S", "s_suppkey")} as ticker,
  case when s_suppkey % 7 = 0 then null else cast(1 + (s_suppkey % 3) * 9 as int) end as lot_size
from supplier""",
    "v_trade": f"""
select {_sql_id("EQ_PRS_", "l_suppkey")} as price_series_id,
  {_sql_id("EQ_AST_", "l_suppkey")} as asset_id, {_sql_id("S", "l_suppkey")} as ticker,
  cast(l_shipdate as date) as session_date,
  cast(cast(l_extendedprice as decimal(18,2)) as decimal(28,9)) as px,
  cast(l_quantity as decimal(18,2)) as qty, l_returnflag, l_linestatus, {_TRADES}
from lineitem""",
    "v_bar": f"""
select price_series_id, asset_id, session_date, max(case when rn_a = 1 then px end) as open,
  max(px) as high, min(px) as low,
  case when max(case when rn_d = 1 then l_returnflag end) = 'R' then null
       else max(case when rn_d = 1 then px end) end as close,
  cast(sum(qty) as decimal(28,9)) as volume
from (select *, row_number() over (partition by price_series_id, session_date order by {_TRADES}) as rn_a,
        row_number() over (partition by price_series_id, session_date order by {_LATEST_TRADES}) as rn_d
      from v_trade) t
group by price_series_id, asset_id, session_date""",
    "v_aggregate": """
select price_series_id, asset_id, session_date,
  cast(sum(cast(px as decimal(18,2))) as decimal(28,9)) as value,
  cast(count(*) as decimal(28,9)) as num_trades,
  max(case when l_returnflag <> 'R' then px end) as waprice
from v_trade group by price_series_id, asset_id, session_date""",
    "v_global": """
select concat('IDX_', substr(o_orderpriority, 1, 1)) as series_id,
  cast(o_orderdate as date) as session_date,
  cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,9)) as value
from orders where o_orderstatus <> 'P'
group by substr(o_orderpriority, 1, 1), cast(o_orderdate as date)""",
    "v_event": f"""
select event_id, user_id, event_type, cast(ts - interval {EVENT_SHIFT_DAYS} day as date) as session_date,
  ts - interval {EVENT_SHIFT_DAYS} day as ts, value from events""",
    "v_position": f"""
select {_sql_id("EQ_AST_", "user_id % 100")} as asset_id, session_date,
  cast(sum(case when event_type = 'click' then cast(value as decimal(18,2)) end) as decimal(28,9)) as fiz_long,
  cast(sum(case when event_type = 'view' and event_id % 5 = 0 then cast(value as decimal(18,2)) end) as decimal(28,9)) as fiz_short,
  cast(sum(case when event_type = 'purchase' and event_id % 3 = 0 then cast(value as decimal(18,2)) end) as decimal(28,9)) as jur_long,
  cast(sum(case when event_type = 'signup' then cast(value as decimal(18,2)) end) as decimal(28,9)) as jur_short
from v_event where event_type <> 'error' group by user_id % 100, session_date""",
    "v_ingest_run": """
select event_id as id, concat('run-', cast(event_id % 500 as varchar)) as run_id, session_date,
  case event_type when 'click' then 'equity_d1' when 'view' then 'equity_agg'
    when 'purchase' then 'futures_positions' when 'signup' then 'cbr'
    else (case when user_id % 2 = 0 then 'equity_d1' else 'brent' end) end as source_id,
  case when event_type = 'error' then 'failed' when event_id % 11 = 0 then 'skipped' else 'ok' end as status,
  case when event_id % 4 = 3 then 'catchup' else 'daily' end as "trigger",
  case when event_type = 'error' then concat('user ', cast(user_id as varchar)) end as failure_reason,
  cast(event_id % 4 as int) as rows_written, ts as started_at,
  case when event_id % 13 <> 0 then ts + interval 90 second end as finished_at
from v_event""",
    "v_ranking": """
select asof_date, cast(row_number() over (partition by asof_date order by score desc, asset_id) as int) as rank,
  asset_id, price_series_id, score
from (select asset_id, price_series_id, session_date as asof_date, value as score from v_aggregate) r""",
    "v_account": """
select c_custkey as account_id,
  cast(cast(greatest(c_acctbal, 0) as decimal(18,2)) as decimal(28,9)) as cash from customer""",
    "v_account_position": f"""
select c_custkey as account_id, {_sql_id("S", "1 + (c_custkey + k) % 100")} as ticker,
  case when k = 3 then 'bond' else 'share' end as asset_type,
  cast(1 + (c_custkey * k) % 50 as decimal(28,9)) as quantity,
  case when (c_custkey + k) % 9 = 0 then null else cast(100 + (c_custkey * 7 + k) % 300 as decimal(28,9)) end as average_price,
  cast(100 + (c_custkey * 11 + k * 13) % 300 as decimal(28,9)) as current_price,
  cast(case when k = 3 then 2 else 0 end as decimal(28,9)) as accrued_interest
from customer cross join (select 0 as k union all select 1 union all select 2 union all select 3) n""",
    "v_sector": f"""
select {_sql_id("EQ_AST_", "s_suppkey")} as asset_id,
  case when s_acctbal >= 0 then n_name end as sector
from supplier left join nation on s_nationkey = n_nationkey""",
    "v_dividend": f"""
select {_sql_id("EQ_AST_", "l_suppkey")} as asset_id, last_day(cast(l_shipdate as date)) as record_date,
  min(cast(l_shipdate as date)) as declared_date, max(cast(l_shipdate as date)) as last_buy_date,
  last_day(cast(l_shipdate as date)) + 10 as payment_date,
  cast(nullif(sum(cast(l_tax as decimal(18,2))), 0) as decimal(28,9)) as value
from lineitem group by l_suppkey, last_day(cast(l_shipdate as date))""",
    "v_ranking_run": """
select o_orderkey as id, cast(o_orderdate as date) as asof_date,
  concat('sha256:', md5(cast(o_custkey as varchar))) as dataset_digest,
  substr(o_orderpriority, 1, 1) as model_id, '1' as model_version,
  case o_orderstatus when 'F' then 'failed' when 'O' then 'success'
    else (case when o_orderpriority < '3' then 'queued' else 'running' end) end as status,
  o_orderdate as started_at,
  case when o_orderstatus in ('F', 'O') then o_orderdate + to_seconds(o_custkey) end as finished_at,
  case when o_orderstatus = 'F' then 'model_error' end as error_code
from orders""",
}


def with_views(sql: str) -> str:
    """The query with the views it names, directly or through other views, put before it.

    Every column is given as text, so that equal values look equal whatever engine printed them.
    """
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEW_SQL[name])

    visit(sql)
    parts = [f"{name} as ({VIEW_SQL[name].strip()})" for name in VIEW_SQL if name in needed]
    parts.append(f"answer as ({sql.strip()})")
    return "with " + ",\n".join(parts) + "\nselect cast(columns(*) as varchar) from answer"
