from decimal import Decimal

from conftest import d, dec, rows, ts
from pyspark.sql import functions as F

from tradeaxis.operators import allocation as al
from tradeaxis.operators import portfolio as pf

P = "DECIMAL(28,9)"


def now():
    return F.lit("2025-04-15 09:30:00").cast("timestamp")


def positions(spark, data):
    full = [(a, t, t, kind, "RUB", dec(q), dec(avg), dec(p), dec(acc)) for a, t, kind, q, avg, p, acc in data]
    return spark.createDataFrame(
        full,
        f"account_id STRING, instrument_uid STRING, ticker STRING, asset_type STRING, currency STRING, quantity {P}, average_price {P}, current_price {P}, accrued_interest {P}",
    )


def accounts(spark, data, captured="2025-04-15 09:29:30"):
    return spark.createDataFrame(
        [(a, dec(c), ts(captured), 60) for a, c in data],
        f"account_id STRING, cash {P}, captured_at TIMESTAMP, interval_seconds INT",
    )


def test_totals_reconcile_and_shares_sum_to_one(spark):
    held = positions(
        spark,
        [("a", "ALFA", "share", 850, "41.2", "40.05", 0), ("a", "BND", "bond", 12, None, "1015.4", "8.6"), ("a", "GAMA", "share", -7, "390", "410", 0)],
    )
    states = pf.position_states(held)
    got = pf.totals(accounts(spark, [("a", 500), ("b", 0)]), states)
    one = {r.account_id: r for r in got.collect()}
    assert one["a"].total_value == dec("34042.5") + dec(12288) - dec(2870) + dec(500)
    assert one["a"].positions_cost_basis == dec(35020 - 2730)
    assert one["a"].unrealized_pnl == dec("-1117.5")
    assert (one["b"].total_value, one["b"].positions_count) == (0, 0)
    view = pf.account_view(got).filter("account_id = 'a'").first()
    shares = pf.position_view(states, got).agg(F.sum("share")).first()[0] + view.cash_share
    assert abs(shares - 1) < Decimal("0.000000001")
    empty = pf.account_view(got).filter("account_id = 'b'").first()
    assert empty.cash_share == 0 and empty.unrealized_pnl_percent is None


def test_each_violation_is_named(spark):
    bad = positions(
        spark,
        [("a", "", "share", 1, 1, 1, 0), ("a", "X", "share", 1, 1, -1, 0), ("a", "Y", "share", 1, -1, 1, 0), ("b", "Z", "share", 1, 1, 1, 0), ("b", "Z", "bond", 1, 1, 1, 0), ("c", "Q", "share", -1, None, 1, 0)],
    ).withColumn("currency", F.when(F.col("ticker") == "Y", "").otherwise("RUB"))
    who = spark.createDataFrame([("a", "RUB"), ("b", None), ("c", "RUB"), ("", "RUB")], "account_id STRING, currency STRING")
    assert rows(pf.snapshot_violations(who, bad)) == [
        ("", "blank_account_id", ""),
        ("a", "blank_currency", "Y"),
        ("a", "blank_instrument", ""),
        ("a", "negative_average", "Y"),
        ("a", "negative_price", "X"),
        ("b", "blank_account_currency", ""),
        ("b", "duplicate_instrument", "Z"),
    ]


def test_reconciliation_tolerance(spark):
    ours = spark.createDataFrame([(x, dec(v)) for x, v in (("a", 40000), ("b", 40000), ("c", 20), ("d", 20), ("e", 8))], f"account_id STRING, total_value {P}")
    theirs = spark.createDataFrame([(x, dec(v)) for x, v in (("a", 40200), ("b", 40250), ("c", 21), ("d", "21.02"), ("e", None))], f"account_id STRING, broker_total_value {P}")
    assert rows(pf.reconciliation_violations(ours, theirs), "account_id") == [("b",), ("d",)]


def test_unknown_values_sort_last_both_ways(spark):
    df = spark.createDataFrame([("p", dec("1234567890123456")), ("q", None), ("r", dec("1234567890123456.25")), ("s", dec(-17))], f"ticker STRING, pnl {P}")

    def order(**kw):
        return [r.ticker for r in pf.ordered_page(df, "pnl", 0, 10, ["ticker"], **kw).collect()]

    assert order() == ["r", "p", "s", "q"]
    assert order(ascending=True) == ["s", "p", "r", "q"]


def test_sync_journal(spark):
    log = spark.createDataFrame(
        [(1, "a", ts("2025-04-15 07:30:00"), "failed", "x"), (2, "a", ts("2025-04-15 08:30:00"), "ok", None), (3, "a", ts("2025-04-15 09:00:00"), "failed", "token_missing"), (4, "b", ts("2025-04-15 09:00:00"), "failed", "x")],
        "id INT, account_id STRING, attempted_at TIMESTAMP, status STRING, reason STRING",
    )
    assert rows(pf.sync_failures(log)) == [("a", 1, 3), ("b", 1, 1)]
    view = {r.account_id: r for r in pf.sync_view(log, accounts(spark, [("a", 0), ("n", 0)], "2025-04-15 08:30:00"), now(), 60).collect()}
    assert (view["a"].status, view["a"].failure_reason_code, view["a"].is_stale, view["a"].stale_after_seconds) == ("failed", "token_missing", True, 180)
    assert view["n"].status is None
    assert rows(log.select("id", pf.broker_status("reason")))[2] == (3, "not_configured")


# --- plans: a market of 22 assets ----------------------------------------------------------------

NAMED = {"ALFA": (100, "12.5"), "BETA": (1, 7300), "GAMA": (5, 410)}
ASSETS = {**NAMED, **{f"N{i:02d}": (1, 64) for i in range(19)}}


def market(spark, lots=None, prices=None, ranked=None, stale=False):
    names = list(ranked if ranked is not None else ASSETS)
    lot = {t: v[0] for t, v in ASSETS.items()} | (lots or {})
    price = {t: v[1] for t, v in ASSETS.items()} | (prices or {})
    return al.Market(
        ranking=spark.createDataFrame([(f"EQ_AST_{t}", i) for i, t in enumerate(names, 1)], "asset_id STRING, rank INT"),
        assets=spark.createDataFrame([(f"EQ_AST_{t}", t, lot[t]) for t in ASSETS], "asset_id STRING, ticker STRING, lot_size INT"),
        prices=spark.createDataFrame([(f"EQ_AST_{t}", dec(p)) for t, p in price.items() if p is not None], f"asset_id STRING, price {P}"),
        ranking_stale=stale,
    )


def requests(spark, *data):
    full = [(i, a, p, None if c is None else dec(c), Decimal(fee)) for i, (a, p, c, fee) in enumerate(data)]
    return spark.createDataFrame(full, f"request_id INT, account_id STRING, policy STRING, capital_limit {P}, fee_percent DECIMAL(7,4)")


def plan(spark, held=(), cash=250000, m=None, asked=(("a", "equity", None, "0.3"),), captured="2025-04-15 09:29:30"):
    asked = [(a, "equal_top20" if p == "equity" else p, c, f) for a, p, c, f in asked]
    return al.Planner(
        requests(spark, *asked),
        accounts(spark, [("a", cash)], captured),
        pf.position_states(positions(spark, list(held))),
        m or market(spark),
        now(),
    )


def test_whole_lots_and_cash_left(spark):
    p = plan(spark)
    t = p.totals.first()
    assert (t.eligible, t.allocated, t.cash_after, t.turnover) == (dec(250000), dec(244260), dec(5740), dec(244260))
    assert t.fee_total == Decimal("732.78")
    by = {r.ticker: r for r in p.positions.collect()}
    assert len(by) == 20 and p.excluded.count() == 0
    assert (by["ALFA"].target_lots, by["ALFA"].target_quantity) == (10, dec(1000))
    assert (by["BETA"].target_lots, by["GAMA"].target_lots, by["N00"].target_quantity) == (1, 6, dec(195))
    assert by["BETA"].target_weight == Decimal("0.05") and by["BETA"].weight_after == Decimal("0.0292")


def test_weight_of_an_unavailable_asset_stays_cash(spark):
    p = plan(spark, m=market(spark, lots={"BETA": None}))
    t = p.totals.first()
    assert (t.allocated, t.cash_after) == (dec(236960), dec(13040))
    assert rows(p.excluded, "asset_id", "reason") == [("EQ_AST_BETA", al.NO_LOT)]
    assert all(r.target_value <= dec(12500) for r in p.positions.collect())
    q = plan(spark, m=market(spark, prices={"BETA": None, "GAMA": 0}))
    assert rows(q.excluded, "asset_id", "reason") == [("EQ_AST_BETA", al.NO_PRICE), ("EQ_AST_GAMA", al.NO_PRICE)]


def test_outside_positions_are_listed_and_not_counted(spark):
    held = [("a", "BND", "bond", 40, 990, 1010, 7), ("a", "ALFA", "bond", 3, 1, 2, 0), ("a", "FOREIGN", "share", 2, 10, 750, 0)]
    p = plan(spark, held)
    t = p.totals.first()
    assert t.eligible == dec(250000) and t.account_total == dec(250000 + 40680 + 6 + 1500)
    assert {r.ticker for r in p.untouched.collect()} == {"BND", "ALFA", "FOREIGN"}
    whole = p.positions.agg(F.sum("target_value")).first()[0]
    assert whole == t.allocated


def test_ranked_but_not_selected_is_sold_first(spark):
    held = [("a", "N18", "share", 11, 50, 64, 0), ("a", "GAMA", "share", 70, 400, 410, 0)]
    p = plan(spark, held)
    ordered = al.in_order(p.positions).collect()
    assert ordered[0].ticker == "GAMA" and ordered[0].delta_quantity == dec(-40)
    last = next(r for r in ordered if r.ticker == "N18")
    assert (last.rank, last.target_quantity, last.delta_quantity, last.delta_value) == (22, dec(0), dec(-11), dec(-704))
    assert ordered.index(last) == 1
    assert p.totals.first().eligible == dec(250000 + 704 + 28700)
    sells = al.action_page(p.positions, "sell", 0, 10).collect()
    assert [r.ticker for r in sells] == ["GAMA", "N18"]


def test_close_out_without_a_price_is_named(spark):
    held = [("a", "N18", "share", 11, 50, 64, 0)]
    p = plan(spark, held, m=market(spark, prices={"N18": None}))
    assert rows(p.excluded, "asset_id", "rank", "reason") == [("EQ_AST_N18", 22, al.NO_PRICE)]


def test_capital_limit(spark):
    p = plan(spark, asked=[("a", "equity", 60000, "0.3"), ("a", "equity", 10**9, "0")])
    got = {r.request_id: r for r in p.totals.collect()}
    assert got[0].limit_value == dec(60000) and got[1].limit_value == dec(250000)
    assert got[1].fee_total == 0
    assert all(t.allocated <= t.limit_value for t in got.values())


def test_exact_multiple_never_loses_a_lot(spark):
    df = spark.createDataFrame([(dec(7000), 2, 35, dec(40), 10), (dec(6999), 2, 35, dec(40), 10), (dec("4000000000000000000"), 1, 20, dec("0.5"), 1)], f"l {P}, n INT, d INT, p {P}, lot INT")
    lots = al.whole_lots(*[F.col(c) for c in ("l", "n", "d", "p", "lot")])
    assert [r[0] for r in df.select(lots).collect()] == [1, 0, 400_000_000_000_000_000]


def test_weights_sum_to_one(spark):
    w = al.policy_weights(spark)
    assert w.count() == 20 + 30 + 50 + 100 + 150 + 100 <= 450
    sums = {}
    for r in w.collect():
        sums[r.policy] = sums.get(r.policy, 0) + r.num * (3_000_000 // r.den)
    assert set(sums.values()) == {3_000_000}


def test_refusals_in_order_and_no_plan_rows(spark):
    asked = [("a", "nonsense", -1, "9"), ("a", "equity", -1, "9"), ("a", "equity", -1, "1"), ("a", "equal_top30", None, "1"), ("zz", "equity", None, "1"), ("a", "equity", None, "5")]

    def statuses(**kw):
        p = plan(spark, asked=asked, **kw)
        assert p.positions.select("request_id").distinct().count() == p.status.filter("status = 'ok'").count()
        return [r.status for r in p.status.orderBy("request_id").collect()]

    first = ["unknown_policy", "invalid_fee", "invalid_limit"]
    assert statuses() == [*first, "insufficient_assets", "broker_not_connected", "ok"]
    assert statuses(captured="2025-04-15 09:26:59") == [*first, "insufficient_assets", "broker_not_connected", "portfolio_stale"]
    assert statuses(m=market(spark, stale=True)) == [*first, *["ranking_stale"] * 3]
    none = market(spark, prices={t: None for t in ASSETS})
    assert statuses(m=none) == [*first, "insufficient_assets", "broker_not_connected", "no_prices"]
    nothing = market(spark)
    empty = al.Market(nothing.ranking.limit(0), nothing.assets, nothing.prices)
    assert statuses(m=empty) == [*first, *["no_successful_ranking"] * 3]


def test_prices_come_from_the_last_session_with_bars(spark):
    days = spark.createDataFrame([(d(f"2025-05-{i:02d}"),) for i in range(10, 29)], "session_date DATE")
    bars = spark.createDataFrame(
        [("P1", "A", d("2025-05-26"), dec(1)), ("P2", "A", d("2025-05-27"), dec(9)), ("P1", "A", d("2025-05-27"), dec(2)), ("P3", "B", d("2025-05-27"), None)],
        f"price_series_id STRING, asset_id STRING, session_date DATE, close {P}",
    )
    prices, session = al.closing_prices(days, bars, d("2025-05-28"))
    assert rows(prices) == [("A", dec(2))] and session.first()[0] == d("2025-05-27")
    old, _ = al.closing_prices(days, bars.withColumn("session_date", F.lit("2025-05-11").cast("date")), d("2025-05-28"))
    assert old.count() == 0


def test_snapshot_keeps_the_broker_order(spark, tmp_path):
    listed = spark.createDataFrame([("a", [("Z",), ("B",)]), ("b", [("C",)]), ("e", [])], "account_id STRING, positions ARRAY<STRUCT<ticker: STRING>>")
    who = spark.createDataFrame([("a", 1), ("b", 2), ("e", 3), ("u", 4)], "account_id STRING, cash INT")
    got = pf.stored_snapshot(who, listed)
    kept = [("a", 0, "Z"), ("a", 1, "B"), ("b", 0, "C"), ("e", None, None), ("u", None, None)]
    assert rows(got, "account_id", "sort_order", "ticker") == kept
    path = str(tmp_path / "s")
    for _ in range(2):
        pf.write_snapshot(got, path, buckets=4)
    assert rows(spark.read.parquet(path), "account_id", "sort_order", "ticker") == kept


def test_a_lost_snapshot_write_is_finished_or_thrown_away(spark, tmp_path, monkeypatch):
    names = [f"acc{i}" for i in range(12)]
    who = spark.createDataFrame([(n, 1) for n in names], "account_id STRING, cash INT")
    kind = "account_id STRING, positions ARRAY<STRUCT<ticker: STRING>>"
    first = pf.stored_snapshot(who, spark.createDataFrame([(n, [("A",)]) for n in names], kind))
    change = pf.stored_snapshot(who.filter("account_id = 'acc7'"), spark.createDataFrame([("acc7", [("N",)])], kind))
    path, put = str(tmp_path / "s"), pf._put_in_place
    seen = lambda: rows(pf.read_snapshot(spark, path, first.schema), "account_id", "ticker")
    old = sorted((n, "A") for n in names)
    new = sorted((n, "N" if n == "acc7" else "A") for n in names)
    assert seen() == []
    pf.write_snapshot(first, path, buckets=3)
    assert seen() == old

    def lost(whole, target):
        for bucket in {r.bucket for r in whole.select("bucket").distinct().collect()}:  # deleted, not yet written
            pf.discard(spark, f"{target}/bucket={bucket}")
        raise RuntimeError("lost")

    monkeypatch.setattr(pf, "_put_in_place", lost)
    try:
        pf.write_snapshot(change, path, buckets=99)
    except RuntimeError:
        pass
    monkeypatch.setattr(pf, "_put_in_place", put)
    assert seen() == new
    pf.write_snapshot(first.filter("account_id = 'acc1'"), path)
    assert seen() == new and rows(spark.read.parquet(path), "account_id", "ticker") == new
    # half a copy, without its mark, is thrown away
    (tmp_path / "s.pending" / "bucket=0").mkdir(parents=True)
    pf.write_snapshot(first, path)
    assert seen() == old and not (tmp_path / "s.pending").exists()


def test_one_account_is_replaced_and_no_other_lost(spark, tmp_path):
    names = [f"acc{i}" for i in range(40)]
    who = spark.createDataFrame([(n, 1) for n in names], "account_id STRING, cash INT")
    kind = "account_id STRING, positions ARRAY<STRUCT<ticker: STRING>>"
    path = str(tmp_path / "s")
    pf.write_snapshot(pf.stored_snapshot(who, spark.createDataFrame([(n, [("A",), ("B",)]) for n in names], kind)), path, buckets=3)
    change = spark.createDataFrame([("acc7", [("N",)]), ("acc8", [])], kind)
    pf.write_snapshot(pf.stored_snapshot(who.filter("account_id in ('acc7', 'acc8')"), change), path, buckets=3)
    got = rows(spark.read.parquet(path), "account_id", "ticker")
    assert got == sorted([(n, t) for n in names for t in "AB" if n not in ("acc7", "acc8")] + [("acc7", "N"), ("acc8", None)], key=lambda r: tuple(map(str, r)))
