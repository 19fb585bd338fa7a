from decimal import ROUND_HALF_UP, Decimal, localcontext

from conftest import dec, rows, ts
from pyspark.sql import functions as F

from tradeaxis.functions import money


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def lit(x):
    return F.lit(None if x is None else str(x)).cast("decimal(28,9)")


def test_value_includes_accrued_interest(spark):
    assert one(spark, money.position_value(lit(730), lit("41.35"), lit(0))) == dec("30185.5")
    assert one(spark, money.position_value(lit(20), lit("507.25"), lit("3.5"))) == dec("10215")


def test_short_positions_and_unknown_average(spark):
    assert one(spark, money.cost_basis(lit(-10), lit(100))) == dec("-1000")
    assert one(spark, money.cost_basis(lit(10), lit(None))) is None
    assert one(spark, money.pnl(lit(10), lit(None))) is None


def test_products_keep_nine_digits(spark):
    assert one(spark, money.times(lit("1.000000001"), lit(3))) == dec("3.000000003")


def test_share_and_percent_never_divide_by_zero(spark):
    assert one(spark, money.share(lit(5), lit(0))) == 0
    assert one(spark, money.share(lit(1), lit(4))) == Decimal("0.25")
    assert one(spark, money.percent(lit(5), lit(0))) is None
    assert one(spark, money.percent(lit(None), lit(5))) is None


def test_ratio_is_half_even_and_null_without_rows(spark):
    assert one(spark, money.ratio4(F.lit(1), F.lit(32))) == Decimal("0.0312")
    assert one(spark, money.ratio4(F.lit(3), F.lit(32))) == Decimal("0.0938")
    assert one(spark, money.ratio4(F.lit(0), F.lit(0))) is None


def test_collected_but_empty(spark):
    def flag(c, v):
        return one(spark, money.collected_but_empty(F.lit(c).cast("decimal(18,4)"), F.lit(v).cast("decimal(18,4)")))

    assert flag("1", "0.0001") is True
    assert flag("1", "0.01") is False
    assert flag("0", "0") is False
    assert flag("1", None) is False
    assert flag(None, "0") is False


def test_age_and_staleness(spark):
    now = F.lit("2026-08-28 12:00:00").cast("timestamp")
    df = spark.createDataFrame(
        [(1, ts("2026-08-28 11:56:59.5")), (2, ts("2026-08-28 11:57:00")), (3, ts("2026-08-28 12:00:05")), (4, None)],
        "i INT, at TIMESTAMP",
    )
    got = df.orderBy("i").select(
        money.age_seconds("at", now), money.is_stale("at", now, F.lit(30))
    )
    assert [tuple(r) for r in got.collect()] == [(180, False), (180, False), (0, False), (None, False)]
    late = df.select(money.is_stale("at", now, F.lit(30)).alias("s"), "i").filter("i = 1")
    assert late.first().s is False
    assert one(spark, money.is_stale(F.lit("2026-08-28 11:56:00").cast("timestamp"), now, F.lit(30))) is True
    assert one(spark, money.is_stale(F.lit("2026-08-28 11:56:00").cast("timestamp"), now, F.lit(120))) is False


def test_mask_action_rounding(spark):
    assert one(spark, money.mask_account(F.lit("2000000001"))) == "•• 0001"
    assert one(spark, money.mask_account(F.lit(""))) == "••"
    assert [one(spark, money.plan_action(lit(x))) for x in (1, -1, 0)] == ["buy", "sell", "keep"]
    assert one(spark, money.display_round(lit("-2.345"), 2)) == Decimal("-2.35")
    assert one(spark, money.display_round(lit("9000000000000000.005"), 2)) == Decimal("9000000000000000.01")
    assert one(spark, money.shift_percent(lit("0.12345"))) == dec("12.345")


def test_section_status_order(spark):
    def status(**kw):
        base = dict(
            running=F.lit(False),
            gap=F.lit(0),
            paused=F.lit(False),
            failed=F.lit(False),
            queued=F.lit(0),
            data_ready=F.lit(None).cast("date"),
            last_success=F.lit(None).cast("date"),
        )
        return one(spark, money.section_status(**{**base, **kw}))

    day = F.lit("2026-08-28").cast("date")
    assert status(running=F.lit(True), gap=F.lit(2)) == "running"
    assert status(gap=F.lit(2), paused=F.lit(True)) == "data_gap"
    assert status(paused=F.lit(True), failed=F.lit(True)) == "paused"
    assert status(failed=F.lit(True), queued=F.lit(1)) == "failed"
    assert status(queued=F.lit(1)) == "lagging"
    assert status(data_ready=day, last_success=day) == "up_to_date"
    assert status(data_ready=day) == "waiting"
    assert status() == "waiting"


def test_run_seconds(spark):
    df = spark.createDataFrame(
        [(1, ts("2026-08-28 10:00:00"), ts("2026-08-28 10:01:30.9")), (2, ts("2026-08-28 10:00:00"), None)],
        "i INT, s TIMESTAMP, f TIMESTAMP",
    )
    assert rows(df.select("i", money.run_seconds("s", "f"))) == [(1, 90), (2, None)]


def test_products_of_any_size_are_exact_or_unknown(spark):
    cases = [
        ("12000000000", "0.02", "240000000"),
        ("-12000000000.000000001", "0.02", "-240000000.000000000"),
        ("3999999999.123456789", "2500000000.5", None),
        ("1234567890.987654321", "1234567890.123456789", None),
        ("9999999999999999999.999999999", "1", "9999999999999999999.999999999"),
        ("9999999999999999999.999999999", "2", "unknown"),
        ("-0.000000001", "0.5", "-0.000000001"),
        ("0.000000001", "0.4", "0"),
    ]
    kind = "DECIMAL(28,9)"
    df = spark.createDataFrame([(i, dec(a), dec(b)) for i, (a, b, _) in enumerate(cases)], f"i INT, a {kind}, b {kind}")
    got = {r.i: r.p for r in df.select("i", money.times("a", "b").alias("p")).collect()}
    with localcontext() as exact:
        exact.prec = 80
        for i, (a, b, want) in enumerate(cases):
            product = (Decimal(a) * Decimal(b)).quantize(Decimal("1e-9"), ROUND_HALF_UP)
            assert got[i] == (None if want == "unknown" else product)
