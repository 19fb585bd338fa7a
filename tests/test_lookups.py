"""Pages by order statistics, as-of lookups cut by range, and session bitmaps."""

import random

from conftest import d, rows
from pyspark.sql import functions as F

from tradeaxis.operators import asof, pages
from tradeaxis.sources import positions


def test_pages_by_number_and_by_cursor(spark):
    data = [(i, (i * 37) % 50 if i % 11 else None) for i in range(500)]
    frame = spark.createDataFrame(data, "id INT, score INT").repartition(6)
    order = [F.col("score").desc_nulls_last(), F.asc("id")]
    listed = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    held = pages.arrange(frame, order, rows=60)
    assert held.starts.count() > 4
    for offset in (0, 59, 60, 61, 250, 495, 499):
        assert [tuple(r) for r in held.page(offset, 25)[0].collect()] == listed[offset : offset + 25]
    assert held.page(500, 25) [0].count() == 0 and held.page(500, 25)[1] is None
    got, cursor = [], held.at(0)
    while cursor is not None:
        page, cursor = held.page(cursor, 70)
        got += [tuple(r) for r in page.collect()]
    assert got == listed


def test_a_deep_page_reads_the_ranges_it_lies_in(spark):
    frame = spark.range(20_000).withColumn("x", F.xxhash64("id"))
    held = pages.arrange(frame, [F.asc("x")], rows=1000)
    page, _ = held.page(15_000, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert pages.PART in pruned and pruned.count(",") <= 2  # one range or two, by partition
    assert held.starts.count() >= 15 and page.count() == 10
    assert page.columns == frame.columns


def test_the_number_of_ranges_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANGES", 8)
    held = pages.arrange(spark.range(5000), [F.desc("id")], rows=100)
    assert 4 <= held.starts.count() <= 8
    for offset in (0, 2499, 4995):
        assert [r.id for r in held.page(offset, 10)[0].collect()] == list(range(4999 - offset, max(4989 - offset, -1), -1))
    monkeypatch.setattr(pages, "ROWS", 250)
    assert pages.arrange(spark.range(5000), [F.desc("id")], rows=100).starts.count() > 8


def test_pages_of_nothing(spark):
    held = pages.arrange(spark.range(0), [F.asc("id")])
    assert held.at(0) is None and held.page(0, 5)[0].count() == 0


def test_last_known_value_over_cuts(spark):
    rng = random.Random(4)
    days = [d(f"2026-{m:02d}-{k:02d}") for m in (1, 2, 3, 4) for k in range(1, 29)]
    keys = ["hot"] * 6 + ["a", "b", "c"]
    seen = {(rng.choice(keys), rng.choice(days)): i for i in range(300)}
    asked = [(rng.choice([*keys, "unknown", None]), rng.choice([*days, None]), i) for i in range(400)]
    observed = spark.createDataFrame([(k, x, v) for (k, x), v in seen.items()], "asset_id STRING, day DATE, price INT")
    requests = spark.createDataFrame(asked, "asset_id STRING, day DATE, price_id INT")

    def expected(key, day):
        known = [(x, v) for (k, x), v in seen.items() if k == key and day and x <= day]
        return max(known) if key and known else (None, None)

    wanted = sorted(((*r, *expected(r[0], r[1])) for r in asked), key=lambda r: r[2])
    for size in (20, 10_000):
        found = asof.last_known(observed, requests, "asset_id", "day", ["price"], rows=size)
        assert found.columns == ["asset_id", "day", "price_id", "observed_day", "price"]
        assert [tuple(r) for r in found.orderBy("price_id").collect()] == wanted
    empty = asof.last_known(observed.limit(0), requests, "asset_id", "day", ["price"])
    assert empty.filter("price is null").count() == 400 and asof.last_known(observed, requests.limit(0), "asset_id", "day", ["price"]).count() == 0


def test_work_list_makes_only_the_pairs_to_ask(spark):
    days = [d(f"2026-{m:02d}-{k:02d}") for m in range(1, 8) for k in range(1, 29)]  # several words of bits
    calendar = spark.createDataFrame([(x,) for x in days], "session_date DATE")
    tickers = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("E",), ("E",)], "ticker STRING")
    contracts = spark.createDataFrame([(t, f"{t}_F") for t in "ABCDZ"], "ticker STRING, contract STRING")
    discovered = spark.createDataFrame([("A_F", True, days[100]), ("B_F", True, None), ("C_F", False, None)], "contract STRING, searched BOOLEAN, first_available DATE")
    filled = [("EQ_AST_A", x, 1) for x in days[120:130]] + [("EQ_AST_B", days[62], 1), ("EQ_AST_B", days[63], 1), ("EQ_AST_C", days[0], 1), ("EQ_AST_B", days[20], None)]
    filled += [("EQ_AST_D", d("2025-12-31"), 1)]
    held = spark.createDataFrame(filled, "asset_id STRING, session_date DATE, fiz_long INT").selectExpr("*", *[f"cast(null as int) as {c}" for c in ("fiz_short", "jur_long", "jur_short")])
    wanted = [("A", x) for i, x in enumerate(days) if i >= 100 and not 120 <= i < 130]
    wanted += [("B", x) for i, x in enumerate(days) if i > 63] + [("C", x) for x in days[1:]] + [("D", x) for x in days]
    found = positions.work_list(calendar, tickers, contracts, held, discovered)
    assert rows(found, "ticker", "session_date") == sorted(wanted, key=lambda r: (r[0], str(r[1])))
    assert positions.work_list(calendar.limit(0), tickers, contracts, held, discovered).count() == 0
