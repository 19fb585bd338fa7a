"""Account snapshots and rebalancing plans for every account at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.operators import allocation as al
from tradeaxis.operators import asof, pages
from tradeaxis.operators import portfolio as pf
from tradeaxis.plans.q_store import sql_window
from tradeaxis.plans.registry import ASOF, NOW, register, sql_ratio
from tradeaxis.schema import PRICE
from tradeaxis.session import scratch_path
from tradeaxis.views import Views


def _now():
    return F.lit(NOW).cast("timestamp")


# --- snapshots -----------------------------------------------------------------------------------

_STATES_SQL = """select p.*, cast(cast(quantity as decimal(18,4)) * cast(current_price + accrued_interest as decimal(18,4)) as decimal(28,9)) as value,
    cast(cast(quantity as decimal(18,4)) * cast(average_price as decimal(18,4)) as decimal(28,9)) as cost_basis from v_account_position p"""
_TOTALS_SQL = f"""select account_id, a.cash, coalesce(t.total, 0) + a.cash as total_value, coalesce(basis, 0) as positions_cost_basis,
    coalesce(pnl, 0) as unrealized_pnl, coalesce(n, 0) as positions_count from v_account a left join (select account_id, cast(sum(value) as decimal(28,9)) as total,
      cast(sum(cost_basis) as decimal(28,9)) as basis, cast(sum(value - cost_basis) as decimal(28,9)) as pnl, count(*) as n from ({_STATES_SQL}) s group by 1) t using (account_id)"""


def _states(v: Views) -> DataFrame:
    return pf.position_states(v.account_position)


def _totals(v: Views) -> DataFrame:
    return pf.totals(v.account, _states(v))


@register(
    "l01_position_states",
    f"""select account_id, ticker, quantity, value, cost_basis, cast(value - cost_basis as decimal(28,9)) as unrealized_pnl from ({_STATES_SQL}) s""",
)
def position_states(v: Views) -> DataFrame:
    return _states(v).select(
        "account_id", "ticker", "quantity", "value", "cost_basis", "unrealized_pnl"
    )


@register(
    "e17_account_totals",
    f"""select account_id, cash, cast(total_value as decimal(28,9)) as total_value, cast(positions_cost_basis as decimal(28,9)) as positions_cost_basis,
      cast(unrealized_pnl as decimal(28,9)) as unrealized_pnl, positions_count, cast(null as varchar) as reason from ({_TOTALS_SQL}) t""",
)
def account_totals(v: Views) -> DataFrame:
    return _totals(v)


_MANY = 10**17
_TOO_MUCH = 10**19


@register(
    "l02_overflow",
    f"""with p as (select account_id, cast(quantity as hugeint) * case when account_id % 7 = 0 and asset_type = 'bond' then {_MANY} else 1 end as q,
          cast(current_price + accrued_interest as hugeint) as price, cast(average_price as hugeint) as average from v_account_position),
        f as (select account_id, q * price as value, q * average as basis from p),
        m as (select *, case when value >= {_TOO_MUCH} then 'value_too_large' when basis >= {_TOO_MUCH} then 'cost_too_large'
          when abs(value - basis) >= {_TOO_MUCH} then 'result_too_large' end as reason from f),
        t as (select account_id, min(reason) as reason, sum(value) as value, sum(basis) as basis, sum(value - basis) as result, count(*) as n from m group by 1),
        r as (select account_id, a.cash, n, t.basis, t.result, t.value, coalesce(t.reason, case when t.value + cast(floor(a.cash) as hugeint) >= {_TOO_MUCH} or t.basis >= {_TOO_MUCH}
          or abs(t.result) >= {_TOO_MUCH} then 'total_too_large' end) as reason from v_account a join t using (account_id))
      select account_id, case when reason is null then cast(value as decimal(28,9)) + cash end as total_value,
        case when reason is null then cast(coalesce(basis, 0) as decimal(28,9)) end as positions_cost_basis,
        case when reason is null then cast(coalesce(result, 0) as decimal(28,9)) end as unrealized_pnl, n as positions_count, reason from r""",
)
def overflow(v: Views) -> DataFrame:
    """Some accounts hold more than a total can say: they get a reason, the others their totals."""
    many = (F.col("account_id") % 7 == 0) & (F.col("asset_type") == "bond")
    factor = F.when(many, F.lit(str(_MANY)).cast("decimal(18,0)")).otherwise(F.lit(1).cast("decimal(18,0)"))
    held = v.account_position.withColumn("quantity", (F.col("quantity").cast("decimal(9,0)") * factor).cast(PRICE))
    return pf.totals(v.account, pf.position_states(held)).drop("cash")


@register(
    "l02_account_view",
    f"""select account_id, case when total_value = 0 then cast(0 as decimal(38,10)) else {sql_ratio("cash", "total_value")} end as cash_share,
      case when positions_cost_basis <> 0 then {sql_ratio("unrealized_pnl", "positions_cost_basis")} end as unrealized_pnl_percent from ({_TOTALS_SQL}) t""",
)
def account_view(v: Views) -> DataFrame:
    view = pf.account_view(_totals(v))
    return view.select("account_id", "cash_share", "unrealized_pnl_percent")


_VIEW_SQL = f"""select s.account_id, ticker, value, {sql_ratio("value", "total_value")} as share,
    case when cost_basis <> 0 then {sql_ratio("(value - cost_basis)", "cost_basis")} end as unrealized_pnl_percent
  from ({_STATES_SQL}) s join ({_TOTALS_SQL}) t on t.account_id = s.account_id"""


def _position_view(v: Views) -> DataFrame:
    view = pf.position_view(_states(v), _totals(v))
    return view.select("account_id", "ticker", "value", "share", "unrealized_pnl_percent")


@register("l02_position_view", _VIEW_SQL)
def position_view(v: Views) -> DataFrame:
    return _position_view(v)


@register(
    "g12_position_order",
    f"select * from ({_VIEW_SQL}) p order by unrealized_pnl_percent desc nulls last, account_id, ticker limit 50 offset 25",
)
def position_order(v: Views) -> DataFrame:
    return pf.ordered_page(_position_view(v), "unrealized_pnl_percent", 25, 50, ["account_id", "ticker"])


@register(
    "g12_position_order_ascending",
    f"select * from ({_VIEW_SQL}) p order by unrealized_pnl_percent nulls last, account_id, ticker limit 50",
)
def position_order_ascending(v: Views) -> DataFrame:
    return pf.ordered_page(
        _position_view(v), "unrealized_pnl_percent", 0, 50, ["account_id", "ticker"], ascending=True
    )


_BROKER_SQL = """select p.*, case when current_price < 110 then '' else ticker end as instrument_uid,
    case when average_price < 103 then null when average_price > 395 then '' else 'RUB' end as currency,
    case when quantity > 45 then 'currency' else asset_type end as kind, current_price - 105 as shown_price, average_price - 101 as shown_average
  from v_account_position p"""


def _broker_positions(v: Views) -> DataFrame:
    """Positions as a broker might send them, with everything that can be wrong."""
    price, average = F.col("current_price"), F.col("average_price")
    currency = F.when(average < 103, None).when(average > 395, "").otherwise("RUB")
    return (
        v.account_position.withColumn(
            "instrument_uid", F.when(price < 110, "").otherwise(F.col("ticker"))
        )
        .withColumn("currency", currency)
        .withColumn(
            "asset_type", F.when(F.col("quantity") > 45, "currency").otherwise(F.col("asset_type"))
        )
        .withColumn("current_price", price - 105)
        .withColumn("average_price", average - 101)
    )


@register("c09_without_currency", f"select account_id, ticker, kind as asset_type from ({_BROKER_SQL}) b where kind <> 'currency'")
def without_currency(v: Views) -> DataFrame:
    return pf.without_currency(_broker_positions(v)).select("account_id", "ticker", "asset_type")


_REPEATED_SQL = f"""select * from ({_BROKER_SQL}) b union all select * from ({_BROKER_SQL}) b where asset_type = 'bond' and instrument_uid <> ''
      and currency = 'RUB' and shown_price > 150 and shown_average > 150"""


@register(
    "c11_snapshot_violations",
    f"""with p as ({_REPEATED_SQL}), a as (select account_id, case when cash = 0 then '' else 'RUB' end as currency from v_account)
      select account_id, 'blank_account_currency' as rule, '' as subject from a where currency = ''
      union all select account_id, 'blank_instrument', instrument_uid from p where instrument_uid = ''
      union all select account_id, 'blank_currency', instrument_uid from p where coalesce(currency, '') = ''
      union all select account_id, 'negative_price', instrument_uid from p where shown_price < 0
      union all select account_id, 'negative_average', instrument_uid from p where shown_average < 0
      union all select account_id, 'duplicate_instrument', instrument_uid from p where instrument_uid <> '' group by 1, 3 having count(*) > 1""",
)
def snapshot_violations(v: Views) -> DataFrame:
    sent = _broker_positions(v)
    clean = (
        (F.col("instrument_uid") != "")
        & (F.col("currency") == "RUB")
        & (F.col("current_price") > 150)
        & (F.col("average_price") > 150)
    )
    bond = v.account_position.filter("asset_type = 'bond'").select("account_id", "ticker")
    again = sent.filter(clean).join(bond, ["account_id", "ticker"], "left_semi")
    accounts = v.account.select(
        "account_id", F.when(F.col("cash") == 0, "").otherwise("RUB").alias("currency")
    )
    return pf.snapshot_violations(accounts, sent.unionByName(again))


@register(
    "c12_total_reconciliation",
    f"""select account_id, total_value, broker_total_value, abs(total_value - broker_total_value) as difference,
        greatest(cast(1 as decimal(28,9)), cast(abs(broker_total_value) * cast('0.005' as decimal(4,3)) as decimal(28,9))) as tolerance
      from (select account_id, cast(total_value as decimal(28,9)) as total_value, case when c_nationkey < 3 then null
          else cast(total_value + c_nationkey * 40 - 400 as decimal(28,9)) end as broker_total_value
        from ({_TOTALS_SQL}) t join customer on c_custkey = account_id) b where abs(total_value - broker_total_value) >
        greatest(cast(1 as decimal(28,9)), cast(abs(broker_total_value) * cast('0.005' as decimal(4,3)) as decimal(28,9)))""",
)
def total_reconciliation(v: Views) -> DataFrame:
    ours = _totals(v)
    off = F.col("c_nationkey") * 40 - 400
    theirs = (
        v.raw("customer")
        .select(F.col("c_custkey").alias("account_id"), "c_nationkey")
        .join(ours.select("account_id", "total_value"), "account_id")
        .select(
            "account_id",
            F.when(F.col("c_nationkey") >= 3, (F.col("total_value") + off).cast(PRICE)).alias(
                "broker_total_value"
            ),
        )
    )
    return pf.reconciliation_violations(ours, theirs)


@register(
    "a20_account_snapshot",
    f"""select account_id, cash, cast(k as int) as sort_order, {"concat('S', lpad(cast(1 + (account_id + k) % 100 as varchar), 9, '0'))"} as ticker,
        cast(1 + (account_id * k) % 50 as decimal(28,9)) as quantity from v_account, (select unnest([0, 1, 2, 3]) as k) n""",
)
def account_snapshot(v: Views) -> DataFrame:
    """Snapshots are written as whole accounts, written again in part, and read back."""

    def entry(k):
        key = F.col("c_custkey")
        return F.struct(
            F.concat(F.lit("S"), F.lpad((1 + (key + k) % 100).cast("string"), 9, "0")).alias("ticker"),
            (1 + (key * k) % 50).cast(PRICE).alias("quantity"),
        )

    listed = v.raw("customer").select(
        F.col("c_custkey").alias("account_id"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), entry).alias("positions"),
    )
    rows = pf.stored_snapshot(v.account, listed)
    path = scratch_path(v.spark, "snapshot")
    pf.write_snapshot(rows, path, buckets=8)
    pf.write_snapshot(rows.filter(F.pmod(F.xxhash64("account_id"), F.lit(8)) == 3), path)
    return pf.read_snapshot(v.spark, path, rows.schema)


_HELD_SQL = f"""select account_id, cash, cast(k as int) as sort_order, {"concat('S', lpad(cast(1 + (account_id + k) % 100 as varchar), 9, '0'))"} as ticker,
        cast(1 + (account_id * k) % 50 as decimal(28,9)) as quantity from v_account, (select unnest([0, 1, 2, 3]) as k) n"""


@register(
    "a20_one_account_replaced",
    f"""select * from ({_HELD_SQL}) h where account_id not in (7, 8)
      union all select account_id, cash, 0, 'SNEW', cast(5 as decimal(28,9)) from v_account where account_id = 7
      union all select account_id, cash, null, null, null from v_account where account_id = 8""",
)
def one_account_replaced(v: Views) -> DataFrame:
    """One account gets another portfolio and one is emptied; all others stay as they were."""
    key = F.col("c_custkey")

    def entry(k):
        return F.struct(
            F.concat(F.lit("S"), F.lpad((1 + (key + k) % 100).cast("string"), 9, "0")).alias("ticker"),
            (1 + (key * k) % 50).cast(PRICE).alias("quantity"),
        )

    listed = v.raw("customer").select(
        key.alias("account_id"), F.transform(F.sequence(F.lit(0), F.lit(3)), entry).alias("positions")
    )
    path = scratch_path(v.spark, "snapshot")
    pf.write_snapshot(pf.stored_snapshot(v.account, listed), path, buckets=8)
    new = F.array(F.struct(F.lit("SNEW").alias("ticker"), F.lit(5).cast(PRICE).alias("quantity")))
    changed = listed.filter("account_id in (7, 8)").withColumn(
        "positions", F.when(F.col("account_id") == 7, new).otherwise(F.slice("positions", 1, 0))
    )
    some = v.account.filter("account_id in (7, 8)")
    replaced = pf.stored_snapshot(some, changed)
    pf.write_snapshot(replaced, path)
    return pf.read_snapshot(v.spark, path, replaced.schema)


_SYNC_SQL = """select event_id as id, user_id as account_id, ts as attempted_at, case when event_type = 'error' then 'failed' else 'ok' end as status,
    case when event_type = 'error' then (case when value > 50 then 'token_missing' when value > 20 then 'broker_rejected_token' else 'rate_limited' end) end as reason from v_event"""


def _sync_journal(v: Views) -> DataFrame:
    failed, value = F.col("event_type") == "error", F.col("value")
    reason = (
        F.when(value > 50, "token_missing")
        .when(value > 20, "broker_rejected_token")
        .otherwise("rate_limited")
    )
    return v.event.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").alias("attempted_at"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(failed, reason).alias("reason"),
    )


@register(
    "l03_sync_view",
    f"""with j as ({_SYNC_SQL}), r as (select *, row_number() over (partition by account_id order by attempted_at desc, id desc) as rn from j),
        s as (select account_id, max(case when status = 'ok' then attempted_at end) as last_success_at, max(attempted_at) as last_attempt_at,
          max(case when status = 'ok' and id >= 5000 then attempted_at end) as captured_at from j group by 1)
      select account_id, status, reason as failure_reason_code, last_attempt_at, last_success_at, captured_at,
        coalesce(timestamp '{NOW}' - captured_at > interval 172800 second, false) as is_stale, 172800 as stale_after_seconds, 57600 as refresh_interval_seconds
      from r join s using (account_id) where rn = 1""",
)
def sync_view(v: Views) -> DataFrame:
    journal = _sync_journal(v)
    captured = F.when((F.col("status") == "ok") & (F.col("id") >= 5000), F.col("attempted_at"))
    accounts = journal.groupBy("account_id").agg(F.max(captured).alias("captured_at"))
    return pf.sync_view(journal, accounts, _now(), 57600)


@register(
    "l04_sync_failures",
    f"""with j as ({_SYNC_SQL}) select account_id, count(*) filter (where status = 'failed' and later_ok = 0) as consecutive_failures, count(*) as attempts
      from (select *, count(*) filter (where status = 'ok') over (partition by account_id order by attempted_at, id rows between current row and unbounded following) as later_ok from j) t group by 1""",
)
def sync_failures(v: Views) -> DataFrame:
    return pf.sync_failures(_sync_journal(v))


@register(
    "l04_broker_status",
    f"""select id, case reason when 'token_missing' then 'not_configured' when 'broker_rejected_token' then 'rejected' end as broker_status from ({_SYNC_SQL}) j""",
)
def broker_status(v: Views) -> DataFrame:
    return _sync_journal(v).select("id", pf.broker_status("reason").alias("broker_status"))


# --- plans ---------------------------------------------------------------------------------------
#
# Every customer asks for a plan. The ranking is the supplier list in key order; prices are the
# closes of the last session with bars; some requests, accounts and assets have something wrong.

_POLICIES = ("equal_top20", "equal_top30", "equal_top50", "equal_top100", "equal_top150", "rank_zones_100")

_CTES = f"""pr as (select * from (select asset_id, close as price from v_bar where session_date =
      (select max(session_date) from v_bar where session_date in {sql_window(al.PRICE_DEPTH)}) and close is not null) x),
  rank as (select {"concat('EQ_AST_', lpad(cast(s_suppkey as varchar), 9, '0'))"} as asset_id, cast(s_suppkey as int) as rank from supplier),
  asset as (select * from v_asset where asset_id <> 'EQ_AST_000000005'),
  place as (select asset_id, rank, row_number() over (order by rank) as place from rank order by rank limit 150),
  size as (select * from (values ('equal_top20', 20), ('equal_top30', 30), ('equal_top50', 50), ('equal_top100', 100), ('equal_top150', 150), ('rank_zones_100', 100)) s(policy, required)),
  weight as (select policy, unnest(range(1, required + 1)) as place, 1 as num, required as den from size where policy <> 'rank_zones_100'
    union all select 'rank_zones_100', unnest(range(lo, hi + 1)), num, 10000 * (hi - lo + 1) from (values (1, 20, 2403), (21, 30, 1063), (31, 50, 2039), (51, 100, 4495)) z(lo, hi, num)),
  req as (select c_custkey as request_id, case when c_mktsegment = 'BUILDING' then c_custkey + 1000000000 else c_custkey end as account_id,
      case when c_nationkey < 20 then ['equal_top20', 'equal_top30', 'equal_top50', 'equal_top100', 'equal_top150', 'rank_zones_100'][c_nationkey % 6 + 1] else 'top_secret' end as policy,
      case when c_acctbal < 0 then cast(0 as decimal(28,9)) when c_acctbal > 5000 then cast(20000 as decimal(28,9)) end as capital_limit,
      cast(case when c_acctbal > 9500 then 6 else 0.04 end as decimal(7,4)) as fee_percent from customer),
  acct as (select account_id, cash, timestamp '{NOW}' - to_seconds(case when cash < 1000 then 7200 else 60 end) as captured_at from v_account),
  status as (select r.*, a.cash, case when s.required is null then 'unknown_policy' when fee_percent < 0 or fee_percent > 5 then 'invalid_fee' when capital_limit <= 0 then 'invalid_limit'
      when (select count(*) from place) = 0 then 'no_successful_ranking' when (select count(*) from place) < s.required then 'insufficient_assets'
      when a.account_id is null then 'broker_not_connected' when timestamp '{NOW}' - a.captured_at > interval 1800 second then 'portfolio_stale'
      when (select count(*) from pr) = 0 then 'no_prices' else 'ok' end as status
    from req r left join size s using (policy) left join acct a on a.account_id = r.account_id),
  pos as ({_STATES_SQL}),
  own as (select ticker, max(asset_id) as asset_id from rank join asset using (asset_id) group by ticker),
  hold as (select account_id, o.asset_id, cast(sum(quantity) as decimal(28,9)) as current_quantity, cast(sum(value) as decimal(28,9)) as current_value
    from pos join own o using (ticker) where asset_type = 'share' group by 1, 2),
  rest as (select account_id, ticker, quantity, value from pos left join own o using (ticker) where not (asset_type = 'share' and o.asset_id is not null)),
  fund as (select s.*, cast(cash + coalesce(held, 0) as decimal(28,9)) as eligible, cast(least(cash + coalesce(held, 0), coalesce(capital_limit, cash + coalesce(held, 0))) as decimal(28,9)) as limit_value
    from status s left join (select account_id, sum(current_value) as held from hold group by 1) h using (account_id) where status = 'ok'),
  choice as (select policy, place, num, den, asset_id, rank, ticker, lot_size, price, case when ticker is null then '{al.NO_ASSET}' when lot_size is null or lot_size <= 0 then '{al.NO_LOT}'
      when price is null or price <= 0 then '{al.NO_PRICE}' end as reason from weight join place using (place) left join asset using (asset_id) left join pr using (asset_id)),
  target as (select f.request_id, c.asset_id, c.ticker, c.rank, c.num, c.den, c.price, c.lot_size, c.reason, coalesce(h.current_quantity, 0) as current_quantity,
      case when c.reason is null then (cast(f.limit_value * 1000000000 as hugeint) * c.num) // (cast(c.price * 1000000000 as hugeint) * c.den * c.lot_size) end as target_lots
    from fund f join choice c using (policy) left join hold h on h.account_id = f.account_id and h.asset_id = c.asset_id),
  closed as (select f.request_id, h.asset_id, a.ticker, r.rank, 0 as num, 1 as den, p.price, a.lot_size, case when p.price is null or p.price <= 0 then '{al.NO_PRICE}' end as reason,
      h.current_quantity, cast(0 as hugeint) as target_lots
    from fund f join hold h on h.account_id = f.account_id and h.current_quantity <> 0 left join asset a using (asset_id) left join pr p using (asset_id) left join rank r using (asset_id)
    where (f.policy, h.asset_id) not in (select (policy, asset_id) from choice)),
  rows as (select *, cast(case when target_lots = 0 then 0 else target_lots * lot_size end as decimal(18,0)) as tq from (select * from target union all select * from closed) u),
  plan as (select request_id, asset_id, ticker, rank, {sql_ratio("cast(num as decimal(28,9))", "cast(den as decimal(28,9))")} as target_weight, price, lot_size, cast(target_lots as bigint) as target_lots,
      cast(tq as decimal(28,9)) as target_quantity, cast(tq * cast(price as decimal(18,2)) as decimal(28,9)) as target_value, cast(current_quantity as decimal(28,9)) as current_quantity,
      cast(tq - current_quantity as decimal(28,9)) as delta_quantity, cast(cast(tq - current_quantity as decimal(18,0)) * cast(price as decimal(18,2)) as decimal(28,9)) as delta_value
    from rows where reason is null),
  total as (select f.request_id, f.account_id, f.policy, eligible, limit_value, cast(coalesce(t.a, 0) as decimal(28,9)) as allocated, cast(coalesce(t.d, 0) as decimal(28,9)) as turnover,
      cast(limit_value - coalesce(t.a, 0) as decimal(28,9)) as cash_after, cast(limit_value + coalesce(u.v, 0) as decimal(28,9)) as account_total,
      cast(cast(coalesce(t.d, 0) * 100 as hugeint) * cast(fee_percent * 10000 as hugeint) as hugeint) as fee_parts
    from fund f left join (select request_id, sum(target_value) as a, sum(abs(delta_value)) as d from plan group by 1) t using (request_id)
      left join (select account_id, sum(value) as v from rest group by 1) u on u.account_id = f.account_id)"""


def _plan_sql(select: str) -> str:
    return f"with {_CTES}\n{select}"


def _market(v: Views) -> al.Market:
    prices, _ = al.closing_prices(v.session, v.bar, ASOF)
    key = F.col("s_suppkey")
    ranking = v.raw("supplier").select(
        F.concat(F.lit("EQ_AST_"), F.lpad(key.cast("string"), 9, "0")).alias("asset_id"),
        key.cast("int").alias("rank"),
    )
    known = v.asset.filter(F.col("asset_id") != "EQ_AST_000000005")
    return al.Market(ranking=ranking, assets=known, prices=prices)


def _requests(v: Views) -> DataFrame:
    nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
    policies = F.array(*[F.lit(p) for p in _POLICIES])
    return v.raw("customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey") + 1000000000)
        .otherwise(F.col("c_custkey"))
        .alias("account_id"),
        F.when(nation < 20, F.get(policies, nation % 6)).otherwise("top_secret").alias("policy"),
        F.when(balance < 0, F.lit(0).cast(PRICE))
        .when(balance > 5000, F.lit(20000).cast(PRICE))
        .alias("capital_limit"),
        F.when(balance > 9500, F.lit("6")).otherwise("0.04").cast("decimal(7,4)").alias("fee_percent"),
    )


def _accounts(v: Views) -> DataFrame:
    age = F.when(F.col("cash") < 1000, F.expr("INTERVAL 7200 SECONDS")).otherwise(
        F.expr("INTERVAL 60 SECONDS")
    )
    return v.account.select(
        "account_id", "cash", (_now() - age).alias("captured_at"), F.lit(600).alias("interval_seconds")
    )


def _plan(v: Views) -> al.Planner:
    return al.Planner(_requests(v), _accounts(v), _states(v), _market(v), _now())


@register(
    "c14_request_checks",
    _plan_sql("select request_id, status from status where status in ('unknown_policy', 'invalid_fee', 'invalid_limit')"),
)
def request_checks(v: Views) -> DataFrame:
    early = ["unknown_policy", "invalid_fee", "invalid_limit"]
    return _plan(v).status.filter(F.col("status").isin(early)).select("request_id", "status")


@register("l15_refusals", _plan_sql("select request_id, status from status"))
def refusals(v: Views) -> DataFrame:
    return _plan(v).status.select("request_id", "status")


@register("d03_price_asof", _plan_sql("select asset_id, price from pr"))
def price_asof(v: Views) -> DataFrame:
    return al.closing_prices(v.session, v.bar, ASOF)[0]


@register(
    "d03_price_asof_many",
    """with c as (select asset_id, session_date, arg_min(close, price_series_id) as price from v_bar where close is not null group by 1, 2),
      r as (select distinct 'EQ_AST_' || lpad(cast(l_suppkey as varchar), 9, '0') as asset_id, cast(l_shipdate as date) + 3 as session_date from lineitem)
      select r.asset_id, r.session_date, c.session_date as observed_session_date, c.price
      from r asof left join c on r.asset_id = c.asset_id and r.session_date >= c.session_date""",
)
def price_asof_many(v: Views) -> DataFrame:
    """For every asset and day somebody asks about: the last close known then, with its own day."""
    closes = v.bar.filter("close is not null").groupBy("asset_id", "session_date").agg(F.min_by("close", "price_series_id").alias("price"))
    asset = F.concat(F.lit("EQ_AST_"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    asked = v.lineitem.select(asset.alias("asset_id"), F.date_add(F.to_date("l_shipdate"), 3).alias("session_date")).distinct()
    return asof.last_known(closes, asked, "asset_id", "session_date", ["price"], rows=10_000)


@register(
    "g12_position_deep_page",
    """with o as (select account_id, ticker, current_price, row_number() over (order by current_price desc nulls last, account_id, ticker) as rn, count(*) over () as n from v_account_position)
      select account_id, ticker, current_price from o where rn > n // 3 and rn <= n // 3 + 40""",
)
def position_deep_page(v: Views) -> DataFrame:
    """A page of the positions of all accounts by price, a third down."""
    rows = v.account_position.select("account_id", "ticker", "current_price")
    order = [F.col("current_price").desc_nulls_last(), F.asc("account_id"), F.asc("ticker")]
    return pages.arrange(rows, order, rows=1000).page(rows.count() // 3, 40)[0]


@register(
    "l05_equal_weights",
    _plan_sql(
        f"""select policy, place, asset_id, rank, {sql_ratio("cast(num as decimal(28,9))", "cast(den as decimal(28,9))")} as weight
        from weight join place using (place) where policy <> 'rank_zones_100'"""
    ),
)
def equal_weights(v: Views) -> DataFrame:
    chosen = al.selection(v.spark, _market(v).ranking).filter(F.col("policy") != al.ZONES_POLICY)
    return _with_weight(chosen)


@register(
    "l06_zone_weights",
    _plan_sql(
        f"""select policy, place, asset_id, rank, {sql_ratio("cast(num as decimal(28,9))", "cast(den as decimal(28,9))")} as weight
        from weight join place using (place) where policy = 'rank_zones_100'"""
    ),
)
def zone_weights(v: Views) -> DataFrame:
    chosen = al.selection(v.spark, _market(v).ranking).filter(F.col("policy") == al.ZONES_POLICY)
    return _with_weight(chosen)


def _with_weight(chosen: DataFrame) -> DataFrame:
    weight = F.col("num").cast("decimal(12,0)") / F.col("den").cast("decimal(12,0)")
    return chosen.select(
        "policy", "place", "asset_id", "rank", weight.cast("decimal(38,10)").alias("weight")
    )


@register(
    "d12_rank_weight_zip",
    _plan_sql(
        """select policy, count(*) as places, min(place) as first_place, max(place) as last_place, sum(num * (1500000 // den)) as weight_parts
        from weight join place using (place) group by policy"""
    ),
)
def rank_weight_zip(v: Views) -> DataFrame:
    chosen = al.selection(v.spark, _market(v).ranking)
    return chosen.groupBy("policy").agg(
        F.count("*").alias("places"),
        F.min("place").alias("first_place"),
        F.max("place").alias("last_place"),
        F.sum(F.col("num") * F.floor(F.lit(1500000) / F.col("den"))).alias("weight_parts"),
    )


@register("l16_universe", _plan_sql("select asset_id, rank, ticker from rank left join asset using (asset_id)"))
def universe(v: Views) -> DataFrame:
    return al.universe(_market(v)).select("asset_id", "rank", "ticker")


@register("c10_universe_split", _plan_sql("select account_id, asset_id, current_quantity, current_value from hold"))
def universe_split(v: Views) -> DataFrame:
    return al.split_positions(_states(v), al.universe(_market(v)))[0]


@register("l07_capital", _plan_sql("select request_id, eligible, limit_value from fund"))
def plan_capital(v: Views) -> DataFrame:
    return _plan(v).totals.select("request_id", "eligible", "limit_value")


@register(
    "d11_plan_enrichment",
    _plan_sql("select policy, place, asset_id, rank, ticker, lot_size, price, reason from choice"),
)
def plan_enrichment(v: Views) -> DataFrame:
    return al.chosen(al.universe(_market(v))).drop("num", "den")


_LOT_COLUMNS = ("request_id", "asset_id", "lot_size", "price", "target_lots", "target_quantity", "target_value")


@register("l08_whole_lots", _plan_sql(f"select {', '.join(_LOT_COLUMNS)} from plan"))
def whole_lots(v: Views) -> DataFrame:
    return _plan(v).positions.select(*_LOT_COLUMNS)


_DELTA_COLUMNS = ("request_id", "asset_id", "current_quantity", "delta_quantity", "delta_value")


@register("l09_deltas", _plan_sql(f"select {', '.join(_DELTA_COLUMNS)} from plan"))
def deltas(v: Views) -> DataFrame:
    return _plan(v).positions.select(*_DELTA_COLUMNS)


@register("l10_exclusions", _plan_sql("select request_id, asset_id, rank, reason from rows where reason is not null"))
def plan_exclusions(v: Views) -> DataFrame:
    return _plan(v).excluded


@register(
    "l11_no_redistribution",
    _plan_sql("select request_id, limit_value, allocated, cash_after from total"),
)
def no_redistribution(v: Views) -> DataFrame:
    return _plan(v).totals.select("request_id", "limit_value", "allocated", "cash_after")


_CLOSE_COLUMNS = ("request_id", "asset_id", "ticker", "rank", "target_lots", "current_quantity", "delta_quantity", "delta_value", "reason")


@register(
    "l12_close_out",
    _plan_sql(
        """select request_id, asset_id, ticker, rank, cast(0 as bigint) as target_lots, current_quantity, cast(-current_quantity as decimal(28,9)) as delta_quantity,
        cast(cast(-current_quantity as decimal(18,0)) * cast(price as decimal(18,2)) as decimal(28,9)) as delta_value, reason from closed"""
    ),
)
def close_out(v: Views) -> DataFrame:
    return _plan(v).closing.select(*_CLOSE_COLUMNS)


@register(
    "d13_close_out_pairs",
    _plan_sql("select request_id, asset_id from closed"),
)
def close_out_pairs(v: Views) -> DataFrame:
    return _plan(v).closing.select("request_id", "asset_id")


@register(
    "l13_untouched",
    _plan_sql(
        f"""select request_id, account_id, ticker, quantity, value, '{al.OUTSIDE}' as reason,
        case when account_total > 0 then {sql_ratio("value", "account_total")} else cast(0 as decimal(38,10)) end as weight_after
        from (select t.request_id, t.account_id, ticker, quantity, value, account_total from total t join rest r on r.account_id = t.account_id) q"""
    ),
)
def untouched(v: Views) -> DataFrame:
    return _plan(v).untouched


_WEIGHT_SQL = f"""select p.request_id, asset_id, target_value, case when account_total > 0 then {sql_ratio("target_value", "account_total")}
    else cast(0 as decimal(38,10)) end as weight_after from plan p join total t using (request_id)"""


@register("l14_weight_after", _plan_sql(_WEIGHT_SQL))
def weight_after(v: Views) -> DataFrame:
    return _plan(v).positions.select("request_id", "asset_id", "target_value", "weight_after")


@register(
    "e18_plan_totals",
    _plan_sql(
        """select request_id, account_id, policy, eligible, limit_value, allocated, turnover, cash_after, account_total,
        cast(cast((fee_parts // 1000000) + case when fee_parts % 1000000 > 500000 or (fee_parts % 1000000 = 500000 and (fee_parts // 1000000) % 2 = 1) then 1 else 0 end as decimal(26,0))
          * cast('0.01' as decimal(2,2)) as decimal(28,2)) as fee_total from total"""
    ),
)
def plan_totals(v: Views) -> DataFrame:
    return _plan(v).totals


@register(
    "g11_plan_order",
    _plan_sql("select request_id, asset_id, rank, delta_value from plan"),
)
def plan_order(v: Views) -> DataFrame:
    return al.in_order(_plan(v).positions).select("request_id", "asset_id", "rank", "delta_value")


@register(
    "g13_plan_page",
    _plan_sql(
        "select request_id, asset_id, delta_quantity, 'sell' as action from plan where delta_quantity < 0 order by request_id, delta_value, rank, asset_id limit 25 offset 50"
    ),
)
def plan_page(v: Views) -> DataFrame:
    page = al.action_page(_plan(v).positions, "sell", 50, 25)
    return page.select("request_id", "asset_id", "delta_quantity", "action")
