"""What lands is read once, folded and stored without work that grows beside it."""

import pandas as pd
from conftest import d, dec, rows
from pyspark.sql import functions as F
from test_jobs import DAYS, landed

from tradeaxis.functions import parse
from tradeaxis.operators import dedup, ingest, store
from tradeaxis.schema import PRICE
from tradeaxis.sources import equity, pages, reference

QUOTE = "SECID string, CLOSE string, n int, OPEN string, HIGH string, LOW string, VOLUME string"
ODD = ['{"SECID":"SBER","CLOSE":"1","n":1}', '{"SECID":" ","n":2}', "{", "{}", "", "  ", "[]", "null", "5", None, '[{"SECID":"GAZP","n":3}]', ' {"SECID":"LKOH","n":4}']


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _odd(spark):
    return spark.createDataFrame([("equity_d1", d(f"2026-01-{i + 1:02}"), text) for i, text in enumerate(ODD)], ingest.LANDED)


def test_the_text_of_a_record_is_read_once(spark):
    route = ingest.Route("equity_d1", "bar", QUOTE, lambda r: equity.bars(r, ["n"]))
    path = ingest.by_source(_odd(spark))
    assert _plan(route.build(ingest.records(spark, path, route))).count("from_json(") == 1
    was = _odd(spark).select("session_date", F.from_json("record", QUOTE, {"mode": "PERMISSIVE"}).alias("r")).filter("r is not null").select("session_date", "r.*")
    assert rows(ingest.records(spark, path, route)) == rows(was)
    assert [r[0] for r in rows(route.build(ingest.records(spark, path, route)), "asset_id")] == ["EQ_AST_LKOH", "EQ_AST_SBER"]


def test_days_that_landed_are_those_of_records(spark):
    route = ingest.Route("equity_d1", "bar", QUOTE, lambda r: equity.bars(r, ["n"]))
    path = ingest.by_source(_odd(spark))
    assert rows(ingest.landed_days(spark, path, route)) == rows(ingest.records(spark, path, route).select("session_date").distinct())


def test_a_decimal_is_tried_without_being_stripped_and_is_what_it_was(spark):
    texts = ["58.71", " 1.5 ", "", "-", " ", None, "abc", "1e2", "\t2\n", "\xa03\xa0", " 4", "\x005", "6\x00", "٣", "+7", "--", "1 2", "\x85-8\x85", "9" * 40, "9" * 19, "0.1234567895"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    now, was = parse.decimal_or_null("t"), parse._stripped("t").try_cast(PRICE)
    both = {r.i: (r.now, r.was) for r in frame.select("i", now.alias("now"), was.alias("was")).collect()}
    assert all(a == b for a, b in both.values())
    assert both[0][0] == dec("58.71") and both[9][0] == dec(3) and both[3][0] is None
    assert "octet_length" in _plan(frame.select(now))


def test_rows_that_are_sorted_by_key_are_led_by_a_number(spark):
    data = [("SBER", DAYS[0], 2, "b"), ("SBER", DAYS[0], 1, "a"), ("GAZP", DAYS[1], 1, None), (None, None, 3, "c"), (None, None, 2, "d"), ("SBER", None, 1, "e")]
    frame = spark.createDataFrame([(k, d(x) if x else None, n, t) for k, x, n, t in data], "k STRING, day DATE, n INT, t STRING")
    first, last = dedup.earliest_by(frame, ["k", "day"], ["n", "t"]), dedup.latest_by(frame, ["k", "day"], ["n", "t"])
    assert "xxhash64" in _plan(first) and first.columns == frame.columns
    assert rows(first, "k", "n", "t") == [("GAZP", 1, None), (None, 2, "d"), ("SBER", 1, "a"), ("SBER", 1, "e")]
    assert rows(last, "k", "n", "t") == [("GAZP", 1, None), (None, 3, "c"), ("SBER", 1, "e"), ("SBER", 2, "b")]
    assert "xxhash64" not in _plan(dedup.latest_by(frame.withColumn("k", F.array("k")), ["k"], ["n", "t"]))
    weights = spark.createDataFrame([("sber", "1", DAYS[0], "A"), ("SBER", "2", DAYS[0], "B"), ("SBER", "2", DAYS[0], "C")], "ticker STRING, weight STRING, tradedate STRING, index_id STRING")
    assert "xxhash64" in _plan(reference.heaviest_index(weights))
    assert rows(reference.heaviest_index(weights)) == [("SBER", "C")]


def test_sessions_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(ingest, "_BATCH_ROWS", 100)
    many = spark.sql("select date_add(date '2026-01-01', cast(id / 60 as int)) as session_date from range(200)")
    dealt = ingest.batches(many, "day")
    assert [b.of(many).count() for b in dealt] == [120, 80]  # the last twenty rows are no batch of their own


def test_quotes_are_read_once_for_the_registries(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    def bars(*quotes):
        made = equity.bars(landed(spark, list(quotes)), ["n"]).select("price_series_id", "asset_id", F.col("session_date"))
        return made.mapInPandas(counted, made.schema)

    ingest._register(spark, str(tmp_path), bars(("SBER", DAYS[0], "1", 1), ("SBER", DAYS[1], "2", 2), ("GAZP", DAYS[1], "3", 3)))
    assert seen.value == 3
    ingest._register(spark, str(tmp_path), bars(("SBER", "2026-01-05", "1", 1), ("LKOH", DAYS[0], "2", 2)))
    assert rows(store.read_table(spark, f"{tmp_path}/asset"), "asset_id", "ticker", "first_seen", "last_seen", "lot_size") == [
        ("EQ_AST_GAZP", "GAZP", d(DAYS[1]), d(DAYS[1]), None),
        ("EQ_AST_LKOH", "LKOH", d(DAYS[0]), d(DAYS[0]), None),
        ("EQ_AST_SBER", "SBER", d(DAYS[0]), d("2026-01-05"), None),  # what arrived last, as before
    ]
    assert rows(store.read_table(spark, f"{tmp_path}/price_series"), "price_series_id", "asset_id") == [(f"EQ_PRS_{t}", f"EQ_AST_{t}") for t in ("GAZP", "LKOH", "SBER")]


def test_a_merge_of_folded_rows_copies_what_stays_alone(spark, tmp_path, monkeypatch):
    def values(*data):
        return spark.createDataFrame([(k, d(x), v, 1) for k, x, v in data], "series_id STRING, session_date DATE, value INT, n INT")

    copied, path, keys, gone = [], str(tmp_path / "t"), ["series_id", "session_date"], store.discard
    monkeypatch.setattr(store, "discard", lambda s, at: (copied.append(rows(s.read.parquet(at), "series_id", "value")), gone(s, at)))
    store.merge_into(spark, path, values(("A", DAYS[0], 1), ("B", DAYS[0], 2), ("C", DAYS[1], 3)), keys, ["n"], folded=True)
    store.merge_into(spark, path, values(("A", DAYS[0], 9), ("D", DAYS[0], 8)), keys, ["n"], folded=True)
    assert copied == [[("B", 2)]]
    assert rows(store.read_table(spark, path), "series_id", "value") == [("A", 9), ("B", 2), ("C", 3), ("D", 8)]


def test_pages_are_handed_on_together(spark, monkeypatch):
    frame = pd.DataFrame
    row = "<tr><td>05.01.2026</td><td>1,5</td></tr>"
    html = spark.createDataFrame([(f"p{i:02}", f"<table class='data'>{row * (i % 3)}</table>") for i in range(30)], "page_id STRING, html STRING").coalesce(1)
    taken = {}

    class Pages:
        def select(self, *columns):
            return self

        def mapInPandas(self, read, schema):
            taken["read"] = read
            return html.mapInPandas(read, schema)

    cells = pages._cells(Pages(), pages.RATE_TABLE, None)
    local = html.toPandas()
    parts = list(taken["read"](iter([local])))
    assert len(parts) == 1 and len(parts[0]) == 10 * (1 + 1 + 2)  # a page without rows gives one without cells
    monkeypatch.setattr(pages, "_HELD_ROWS", 5)
    pages._cells(Pages(), pages.RATE_TABLE, None)
    assert 1 < len(list(taken["read"](iter([local])))) < 30
    assert cells.filter("cells is null").count() == 10
    assert list(taken["read"](iter([frame({"page_id": [], "html": []})]))) == []
