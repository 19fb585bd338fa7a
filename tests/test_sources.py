import json

from conftest import d, dec, rows
from pyspark.sql import functions as F

from tradeaxis.sources import dividends as dv
from tradeaxis.sources import equity, landed, pages, positions, reference, series

COLUMNS = ["SECID", "TRADEDATE", "OPEN", "HIGH", "LOW", "CLOSE", "VOLUME"]


def page(request, number, data, columns=COLUMNS):
    return request, number, json.dumps({"columns": columns, "data": data})


def unpacked(spark, pages_, columns=COLUMNS):
    df = spark.createDataFrame(pages_, "request STRING, page INT, body STRING")
    return landed.unpack(landed.parse_pages(df, "body"), columns)


def test_block_rows_are_matched_by_position(spark):
    got = unpacked(
        spark,
        [
            page("r", 1, [["TORN", "2024-05-28", "87.15", "88.4", "86.05", "87.9", "2600"], ["GRIV"]]),
            page("r", 2, [["LUMA", "2024-05-28", 1, 2, 3, 4, 5, "beyond"]]),
        ],
    )
    assert rows(got, "page", "pos", "SECID", "CLOSE", "VOLUME") == [
        (1, 0, "TORN", "87.9", "2600"),
        (1, 1, "GRIV", None, None),
        (2, 0, "LUMA", "4", "5"),
    ]


def test_landed_page_files(spark, tmp_path):
    line = {"request": "r", "page": 1, "block": {"columns": ["SECID"], "data": [["TORN"], ["GRIV"]]}}
    (tmp_path / "p.json").write_text(json.dumps(line))
    got = landed.unpack(landed.read_pages(spark, str(tmp_path)), ["SECID"])
    assert rows(got, "pos", "SECID") == [(0, "TORN"), (1, "GRIV")]


def test_first_quote_of_a_session_wins_and_holes_stay(spark):
    got = unpacked(
        spark,
        [
            page("2024-05-28", 1, [["TORN", None, None, "2", "1", "1.5", "10"], ["", None, "1", "1", "1", "1", "1"]]),
            page("2024-05-28", 2, [[" torn ", None, "9", "9", "9", "9", "9"], [None, None, "1", "1", "1", "1", "1"]]),
        ],
    ).withColumn("session_date", F.col("request").cast("date"))
    bars = equity.bars(got, landed.ARRIVAL)
    assert rows(bars, "asset_id", "price_series_id", "open", "high", "close") == [
        ("EQ_AST_TORN", "EQ_PRS_TORN", None, dec(2), dec("1.5"))
    ]


def test_last_history_row_of_a_date_wins(spark):
    got = unpacked(
        spark,
        [
            page("TORN", 1, [["TORN", "2024-05-28", "1", "1", "1", "1", "1"], ["TORN", "soon", "7", "7", "7", "7", "7"]]),
            page("TORN", 2, [["TORN", "2024-05-28", "2", "2", "2", "2", "2"]]),
        ],
    )
    bars = equity.history_bars(got, landed.ARRIVAL)
    assert rows(bars, "session_date", "close") == [(d("2024-05-28"), dec(2))]


def test_open_interest_and_lots_and_titles(spark):
    oi = spark.createDataFrame(
        [("trnf", "10"), (" TRNF ", "5"), ("GRIR", None), ("", "3")], "ASSETCODE STRING, PREVOPENPOSITION STRING"
    )
    assert rows(landed.open_interest(oi)) == [("GRIR", 0), ("TRNF", 15)]
    lots = spark.createDataFrame(
        [("TORN", "10", 1), ("torn", "100", 2), ("GRIV", None, 3), ("LUMA", "x", 4), ("X", "0", 5), ("", "5", 6)],
        "SECID STRING, LOTSIZE STRING, n INT",
    )
    assert rows(landed.lot_sizes(lots, ["n"]), "ticker", "lot_size") == [("TORN", 100)]
    titles = spark.createDataFrame(
        [("moexog", "Нефть", 1), ("MOEXMM", None, 2), (" ", "x", 3)], "indexid STRING, shortname STRING, n INT"
    )
    assert rows(landed.index_titles(titles, ["n"])) == [("MOEXMM", ""), ("MOEXOG", "Нефть")]


def test_front_contract(spark):
    data = [
        ("2024-05-28", "BRU6", "BR-6.24", "55.1"),
        ("2024-05-28", "BRV6", "BR-7.24", "56.3"),
        ("2024-05-28", "BRQ6", "BR-5.24", "54.7"),
        ("2024-05-28", "BRF6", "BR-1.24", "60"),
        ("2024-05-29", "BRF6", "BR-1.24", "60"),
        ("2024-06-01", "b", "BR-6.24", "1"),
        ("2024-06-01", "a", "BR-6.24", None),
    ]
    df = spark.createDataFrame(data, "session_date STRING, SECID STRING, SHORTNAME STRING, CLOSE STRING")
    got = series.front_contract(df.withColumn("session_date", F.col("session_date").cast("date")))
    assert rows(got, "session_date", "secid", "close") == [
        (d("2024-05-28"), "BRQ6", dec("54.7")),
        (d("2024-06-01"), "A", None),
    ]
    twice = spark.createDataFrame(
        [("2024-05-28", "BRQ4", "BR-6.24", c, n) for n, c in ((2, "52.8"), (1, "51.9"), (3, None))],
        "session_date STRING, SECID STRING, SHORTNAME STRING, CLOSE STRING, n INT",
    ).withColumn("session_date", F.col("session_date").cast("date"))
    assert series.front_contract(twice, ["n"]).first().close == dec("51.9")


def test_series_values_last_wins_and_null_stays(spark):
    data = [("IMOEX", "2024-05-27", "1", 1), ("imoex", "2024-05-27", "", 2), ("IMOEX", "bad", "3", 3), ("OTHER", "2024-05-27", "9", 4)]
    df = spark.createDataFrame(data, "SECID STRING, TRADEDATE STRING, CLOSE STRING, n INT")
    declared = series.declared(df, series.specs(spark))
    assert rows(series.values_by_date(declared, "TRADEDATE", "CLOSE", ["n"])) == [("IMOEX", d("2024-05-27"), None)]


def test_sector_is_the_heaviest_index(spark):
    data = [
        ("torn", "10", "2024-05-28", "MOEXFN"),
        ("TORN", "12", "2024-05-27", "MOEXINN"),
        ("griv", "5", "2024-05-28", "MOEXOG"),
        ("griv", "5", "2024-05-28", "MOEXMM"),
        ("luma", None, "2024-05-28", "MOEXOG"),
        ("x", "1", None, "MOEXIT"),
    ]
    df = spark.createDataFrame(data, "ticker STRING, weight STRING, tradedate STRING, index_id STRING")
    titles = spark.createDataFrame([("MOEXINN", "Инновации"), ("MOEXOG", "")], "index_id STRING, title STRING")
    assert rows(reference.sectors(df, titles)) == [
        ("EQ_AST_GRIV", "MOEXOG"),
        ("EQ_AST_TORN", "Инновации"),
        ("EQ_AST_X", "MOEXIT"),
    ]
    assert reference.sectors_outcome(reference.heaviest_index(df.filter("weight IS NULL"))).first().outcome == "failed_empty"


def test_index_weights_of_another_date_are_dropped(spark):
    data = [("torn", "6.35", "2024-05-28", 1), ("griv", "9", "2024-05-27", 2), ("luma", "", "2024-05-28", 3), ("rosn", "3", "soon", 4)]
    df = spark.createDataFrame(data, "ticker STRING, weight STRING, tradedate STRING, n INT").select(
        "*", F.lit("2024-05-28").cast("date").alias("session_date"), F.lit("IMOEX").alias("index_id")
    )
    assert rows(reference.index_weights(df, ["n"]), "series_id", "value") == [
        ("IDX_WEIGHT_IMOEX_ROSN", dec(3)),
        ("IDX_WEIGHT_IMOEX_TORN", dec("6.35")),
    ]


RATE = """<html><table><tr><td>1.1.2000</td><td>9</td></tr></table>
<table class="data"><tr><th>Дата</th><th>Ставка</th></tr><tr><td>28.05.2024</td><td>11,75</td></tr>
<tr><td>28.05.2024</td><td>11,80</td></tr><tr><td>x</td><td>1</td></tr><tr><td>29.05.2024</td><td>-</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table></html>"""
TERMS = "".join(f"<td>{n},5</td>" for n in range(1, 13))
CURVE = f"""<table><tr><td>28.05.2024</td>{TERMS}</tr></table>
<div class="x table-wrapper"><table><tr><th>Дата</th></tr><tr><td>31.05.2024</td>{TERMS}</tr></table></div>"""
POSITION = """<span class="text-center">Данные на 28 мая 2024</span>
<table class="table1 _full-width table1"><tr><td>Количество лиц</td><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr>
<tr><td>Количество
 договоров (контрактов)</td><td>2 340</td><td>50</td><td></td><td>−18,25</td><td>9</td></tr></table>"""


def page_frame(spark, **html):
    return spark.createDataFrame(list(html.items()), "page_id STRING, html STRING")


def test_rate_pages(spark):
    df = page_frame(spark, good=RATE, bare="<p>nothing</p>", silent='<table class="data"><tr><th>Дата</th></tr></table>')
    got = pages.rate_values(df)
    assert rows(got, "page_id", "session_date", "value") == [
        ("good", d("2024-05-28"), dec("11.8")),
        ("good", d("2024-05-29"), None),
    ]
    assert rows(pages.failed_rate_pages(df)) == [("bare",)]


def test_curve_pages_by_position_inside_the_wrapper(spark):
    df = page_frame(spark, good=CURVE, outside=CURVE.replace("table-wrapper", "other"), empty=None)
    got = pages.curve_values(df)
    assert got.count() == 12
    assert rows(got.filter("series_id = 'CBR_ZCYC_yield_10y'"), "session_date", "value") == [(d("2024-05-31"), dec("9.5"))]
    assert rows(pages.failed_pages(df, got)) == [("empty",), ("outside",)]


def test_position_pages_find_the_row_by_title(spark):
    got = pages.position_values(page_frame(spark, p=POSITION, q=POSITION.replace("28 мая 2024", "вчера")))
    assert rows(got) == [("p", d("2024-05-28"), dec(2340), dec(50), None, dec("-18.25"))]
    asked = got.withColumn("session_date", F.lit("2024-05-29").cast("date"))
    assert pages.of_requested_date(asked).count() == 0


def test_contract_with_most_interest_then_smaller_code(spark):
    pairs = spark.createDataFrame(
        [("TORN", "TRNF"), ("torn", "TORNF"), ("GRIV", "GB"), ("GRIV", "GA"), ("X", " ")],
        "underlying_asset STRING, asset_code STRING",
    )
    oi = spark.createDataFrame([("TRNF", 100), ("TORNF", 7)], "asset_code STRING, open_interest BIGINT")
    assert rows(positions.contract_map(pairs, oi)) == [("GRIV", "GA_F"), ("TORN", "TRNF_F")]


def stored_positions(spark, data):
    schema = "asset_id STRING, session_date DATE, fiz_long DECIMAL(28,9), fiz_short DECIMAL(28,9), jur_long DECIMAL(28,9), jur_short DECIMAL(28,9)"
    return spark.createDataFrame([(a, d(day), dec(v), None, None, None) for a, day, v in data], schema)


def test_positions_work_list(spark):
    days = spark.createDataFrame([(d(f"2024-05-2{i}"),) for i in (5, 6, 7, 8)], "session_date DATE")
    tickers = spark.createDataFrame([("TORN",), ("GRIV",), ("LUMA",), ("NONE",)], "ticker STRING")
    contracts = spark.createDataFrame([("TORN", "S_F"), ("GRIV", "G_F"), ("LUMA", "L_F")], "ticker STRING, contract STRING")
    have = stored_positions(spark, [("EQ_AST_TORN", "2024-05-27", 1), ("EQ_AST_TORN", "2024-05-28", None)])
    found = spark.createDataFrame(
        [("S_F", True, d("2024-05-26")), ("G_F", True, None)], "contract STRING, searched BOOLEAN, first_available DATE"
    )
    got = positions.work_list(days, tickers, contracts, have, found)
    # TORN: the 27th is filled, the 28th is empty and asked again, the 25th is before its time.
    # GRIV was searched and never found; LUMA was never searched and is asked about every day.
    assert rows(got, "ticker", "session_date") == [
        ("LUMA", d("2024-05-25")),
        ("LUMA", d("2024-05-26")),
        ("LUMA", d("2024-05-27")),
        ("LUMA", d("2024-05-28")),
        ("TORN", d("2024-05-26")),
        ("TORN", d("2024-05-28")),
    ]


def test_no_value_at_all_is_a_failure(spark):
    got = stored_positions(spark, [("A", "2024-05-27", None), ("B", "2024-05-27", None), ("A", "2024-05-28", 1), ("B", "2024-05-28", None)])
    asked = got.select("asset_id", "session_date")
    assert rows(positions.session_outcome(asked, got)) == [
        (d("2024-05-27"), 2, 0, "failed_empty"),
        (d("2024-05-28"), 2, 1, "ok"),
    ]


def test_instruments_and_dividends(spark):
    shares = spark.createDataFrame(
        [("torn", "F1", "rub", 1), ("TORN", "F2", "", 2), ("TORN", "F3", "usd", 3), ("GRIV", "", "rub", 4), ("ZZZ", "F5", "rub", 5)],
        "ticker STRING, figi STRING, currency STRING, n INT",
    )
    known = spark.createDataFrame([("TORN",), ("GRIV",)], "ticker STRING")
    matched = dv.match_instruments(shares, known, ["n"])
    assert rows(matched) == [("TORN", "F2")]
    answers = spark.createDataFrame(
        [("F2", "2024-04-03 00:00:00", 12, 70000000), ("F2", None, 1, 0), ("F2", "2023-04-05 00:00:00", None, None)],
        "figi STRING, record_date STRING, units BIGINT, nano BIGINT",
    ).select("*", *[F.lit(None).cast("date").alias(c) for c in ("declared_date", "last_buy_date", "payment_date")])
    got = dv.events(dv.for_known_assets(answers, matched))
    assert rows(got, "asset_id", "record_date", "value") == [
        ("EQ_AST_TORN", d("2023-04-05"), None),
        ("EQ_AST_TORN", d("2024-04-03"), dec("12.07")),
    ]
