import pytest
from conftest import d, dec, rows
from pyspark.sql import functions as F

from tradeaxis.functions import parse


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, raw STRING")
    return [r.v for r in df.orderBy("i").select(expression(F.col("raw")).alias("v")).collect()]


def test_decimals_are_exact_or_null_never_zero(spark):
    got = values(spark, ["58.71", " 1.123456789 ", "", None, "abc", "23,40", "1e2", "0"], parse.decimal_or_null)
    assert got == [dec("58.71"), dec("1.123456789"), None, None, None, None, dec("100"), dec("0")]


def test_local_numbers_lose_spaces_and_gain_a_point(spark):
    got = values(spark, ["9,75", "4 321,5", "2 000", "−3,25", "x"], lambda c: parse.local_decimal(c, minus=True))
    assert got == [dec("9.75"), dec("4321.5"), dec("2000"), dec("-3.25"), None]


def test_iso_dates_take_the_first_ten_characters(spark):
    got = values(
        spark, ["2026-08-28", "2026-08-28T10:00:00", " 2026-08-28 ", "2026-13-01", "28.08.2026", "", "20260828", None], parse.iso_date
    )
    day = d("2026-08-28")
    assert got == [day, day, day, None, None, None, day, None]


def test_dotted_dates(spark):
    got = values(spark, ["28.08.2026", "1.8.2026", "31.02.2026", "2026-08-28"], parse.dotted_date)
    assert got == [d("2026-08-28"), d("2026-08-01"), None, None]


def test_dates_inside_captions(spark):
    texts = ["на 2026-08-28 г.", "на 28.08.2026", "Данные на 28 августа 2026", "28 Augusta 2026", "нет даты", "3 Мая 2025"]
    day = d("2026-08-28")
    assert values(spark, texts, parse.date_in_text) == [day, day, day, None, None, d("2025-05-03")]


def test_tickers_and_identifiers(spark):
    assert values(spark, [" sber ", "", "  ", None], parse.ticker) == ["SBER", None, None, None]
    assert values(spark, ["sber"], parse.asset_id) == ["EQ_AST_SBER"]
    assert values(spark, ["sber"], parse.price_series_id) == ["EQ_PRS_SBER"]
    weight = values(spark, ["sber"], lambda c: parse.index_weight_series_id(F.lit("IMOEX"), c))
    assert weight == ["IDX_WEIGHT_IMOEX_SBER"]
    assert values(spark, ["yield_1y"], parse.curve_series_id) == ["CBR_ZCYC_yield_1y"]


def test_fingerprint_tells_null_from_zero_but_not_formatting(spark):
    data = [(1, "314.2", None), (2, "314.20", None), (3, "314.2", "0")]
    df = spark.createDataFrame(data, "i INT, open STRING, high STRING").select(
        "i", F.col("open").cast("decimal(28,9)"), F.col("high").cast("decimal(28,9)")
    )
    got = [r.v for r in df.orderBy("i").select(parse.fingerprint(("open", "high")).alias("v")).collect()]
    assert got[0] == got[1] != got[2]
    assert len(got[0]) == 32


def test_contract_expiry_is_the_last_day_of_the_month(spark):
    got = values(spark, ["BR-9.26", "BR-12.26", "BR-02.28", "BR-13.26", "BR-0.26", "SI-9.26", None], parse.contract_expiry)
    assert got == [d("2026-09-30"), d("2026-12-31"), d("2028-02-29"), None, None, None, None]


def test_units_and_nano(spark):
    data = [(1, 114, 250000000), (2, -2, -500000000), (3, None, 5), (4, 7, None), (5, None, None)]
    df = spark.createDataFrame(data, "i INT, u BIGINT, n BIGINT")
    got = [r.v for r in df.orderBy("i").select(parse.units_nano("u", "n").alias("v")).collect()]
    assert got == [dec("114.25"), dec("-2.5"), dec("0.000000005"), dec("7"), None]


@pytest.mark.parametrize(
    ("now", "cutoff", "closed"),
    [
        ("2026-08-28 16:31:00", "19:30", True),  # 19:31 in Moscow
        ("2026-08-28 16:29:00", "19:30", False),
        ("2026-08-28 21:30:00", "19:30", True),  # already the 29th there
        ("2026-08-27 16:31:00", "19:30", False),
        ("2026-08-28 16:31:00", "late", True),  # unreadable: 19:30
        ("2026-08-28 16:31:00", "19:40", False),
    ],
)
def test_session_closes_by_exchange_time(spark, now, cutoff, closed):
    df = spark.createDataFrame([(d("2026-08-28"),)], "session_date DATE")
    expression = parse.session_closed("session_date", F.lit(now).cast("timestamp"), cutoff)
    assert rows(df.select(expression)) == [(closed,)]
