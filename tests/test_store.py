import datetime as dt

from conftest import d, dec, rows
from pyspark.sql import functions as F

from tradeaxis.operators import calendar as cal
from tradeaxis.operators import store
from tradeaxis.operators.dedup import earliest_by, insert_if_absent, latest_by, upsert
from tradeaxis.plans import q_store
from tradeaxis.views import Views

WEEK = ["2024-05-15", "2024-05-16", "2024-05-17", "2024-05-20", "2024-05-21"]


def sessions(spark, days=WEEK):
    return spark.createDataFrame([(d(x),) for x in days], "session_date DATE")


def test_window_counts_sessions_not_days(spark):
    c = sessions(spark)
    assert cal.window(c, d("2024-05-20"), 3).dates == (d("2024-05-16"), d("2024-05-17"), d("2024-05-20"))
    assert cal.window(c, d("2024-05-19"), 2).last == d("2024-05-17")
    assert len(cal.window(c, d("2024-05-16"), 10)) == 2
    assert len(cal.window(c, d("2020-01-01"), 10)) == 0
    assert cal.window(c, d("2020-01-01"), 10).contains("session_date") is not None


def test_several_windows_from_one_read(spark):
    got = cal.windows(sessions(spark), d("2024-05-21"), {"a": 4, "b": 1})
    assert len(got["a"]) == 4 and got["b"].dates == (d("2024-05-21"),)


def test_as_of_in_both_directions(spark):
    days = spark.createDataFrame(
        [(d(x),) for x in ("2024-05-14", "2024-05-15", "2024-05-18", "2024-05-20", "2024-05-21", "2024-05-25")],
        "day DATE",
    )
    assert rows(cal.as_of(days, "day", sessions(spark))) == [
        (d("2024-05-14"), None, d("2024-05-15")),
        (d("2024-05-15"), d("2024-05-15"), d("2024-05-16")),
        (d("2024-05-18"), d("2024-05-17"), d("2024-05-20")),
        (d("2024-05-20"), d("2024-05-20"), d("2024-05-21")),
        (d("2024-05-21"), d("2024-05-21"), None),
        (d("2024-05-25"), d("2024-05-21"), None),
    ]
    assert cal.latest_session(sessions(spark), d("2024-05-19")).first()[0] == d("2024-05-17")
    assert cal.next_session(sessions(spark), d("2024-05-17")).first()[0] == d("2024-05-20")


def test_calendar_from_proxy_adds_only_new_days(spark):
    history = spark.createDataFrame([("2024-05-21",), ("2024-05-21",), ("2024-05-22",), ("bad",), (None,)], "TRADEDATE STRING")
    found = cal.sessions_from_proxy(history, "TRADEDATE")
    assert rows(cal.new_sessions(found, sessions(spark))) == [(d("2024-05-22"),)]


def test_clamp_reports_a_range_reaching_outside(spark):
    c = sessions(spark)
    got = cal.clamp(c, d("2024-04-20"), d("2024-05-16"))
    assert rows(got) == [(d("2024-05-15"), True), (d("2024-05-16"), True)]
    assert rows(cal.clamp(c, d("2024-05-15"), d("2024-05-16")))[0][1] is False
    assert cal.clamp(c, None, None).count() == 5


def test_open_session_is_withheld(spark):
    now = F.lit("2024-05-21 10:00:00").cast("timestamp")
    assert cal.withhold_open(sessions(spark), now, "19:30").count() == 4
    later = F.lit("2024-05-21 16:30:00").cast("timestamp")
    assert cal.withhold_open(sessions(spark), later, "19:30").count() == 5


def test_window_bounds(spark):
    got = rows(cal.window_bounds(sessions(spark), 3))
    assert got[0] == (d("2024-05-15"), d("2024-05-15"), 1)
    assert got[4] == (d("2024-05-21"), d("2024-05-17"), 3)


def series(spark, data):
    return spark.createDataFrame([(s, d(x), dec(v), n) for s, x, v, n in data], "series_id STRING, session_date DATE, value DECIMAL(28,9), n INT")


def test_upsert_replaces_also_with_null_and_is_idempotent(spark):
    old = series(spark, [("A", "2024-05-16", 1, 0), ("A", "2024-05-17", 2, 0), ("B", "2024-05-17", 3, 0)]).drop("n")
    new = series(spark, [("A", "2024-05-17", 5, 1), ("A", "2024-05-17", None, 2), ("C", "2024-05-17", 7, 1)])
    keys = store.KEYS["global_series"]
    once = upsert(old, new, keys, ["n"])
    expected = [("A", d("2024-05-16"), dec(1)), ("A", d("2024-05-17"), None), ("B", d("2024-05-17"), dec(3)), ("C", d("2024-05-17"), dec(7))]
    assert rows(once) == expected
    assert rows(upsert(once, new, keys, ["n"])) == expected


def test_one_key_holding_most_rows_is_folded_before_the_shuffle(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        F.col("id").alias("n"),
    )
    last = latest_by(df.withColumn("v", F.col("n")), ["k"], ["n"])
    assert last.filter("k = 'hot'").first().v == 199_998
    assert earliest_by(df.withColumn("v", F.col("n")), ["k"], ["n"]).filter("k = 'hot'").first().v == 0
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by(" in plan and "Window" not in plan and "Sort" not in plan


def test_insert_if_absent_takes_the_first(spark):
    stored = spark.createDataFrame([("a",)], "k STRING")
    incoming = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k STRING, n INT")
    assert rows(insert_if_absent(stored, incoming, ["k"], ["n"])) == [("a", 1, False), ("b", 2, True)]


def test_assets_follow_arrival_and_keep_the_extremes_beside_it(spark):
    stored = spark.createDataFrame([("A", "OLD", d("2024-05-16"), d("2024-05-17"))], "asset_id STRING, ticker STRING, first_seen DATE, last_seen DATE")
    incoming = spark.createDataFrame(
        [("A", "NEW", d("2020-01-01"), 1), ("B", "B", d("2024-05-17"), 1), ("B", "B2", d("2024-05-16"), 2)],
        "asset_id STRING, ticker STRING, session_date DATE, n INT",
    )
    assert rows(store.upsert_seen(stored, incoming, "asset_id", ["n"], ["ticker"])) == [
        ("A", "NEW", d("2024-05-16"), d("2020-01-01"), d("2020-01-01"), d("2024-05-17")),
        ("B", "B2", d("2024-05-17"), d("2024-05-16"), d("2024-05-16"), d("2024-05-17")),
    ]


def test_lots_update_known_assets_only(spark):
    assets = spark.createDataFrame([("A", 1), ("B", None)], "asset_id STRING, lot_size INT")
    lots = spark.createDataFrame([("A", 10), ("C", 5)], "asset_id STRING, lot_size INT")
    assert rows(store.update_lots(assets, lots)) == [("A", 10), ("B", None)]


def test_clean_up_takes_prefixes_literally(spark):
    got = series(
        spark,
        [("IDX_WEIGHT_A", "2024-05-17", None, 0), ("IDX-WEIGHT-A", "2024-05-17", None, 0), ("CBR_ZCYC_B1", "2024-05-17", 1, 0), ("CBR_ZCYC_yield_1y", "2024-05-17", 1, 0)],
    )
    assert store.drop_empty_weights(got).count() == 3
    assert store.drop_foreign_curve(got).filter("series_id LIKE 'CBR%'").count() == 1


def test_merge_touches_only_incoming_partitions(spark, tmp_path):
    path, keys = str(tmp_path / "t"), store.KEYS["global_series"]
    store.merge_into(spark, path, series(spark, [("A", "2024-05-16", 1, 0), ("A", "2024-05-17", 2, 0)]), keys, ["n"])
    untouched = next((tmp_path / "t" / "part=2024-05-16").glob("*.parquet"))
    stamp = untouched.stat().st_mtime_ns
    late = series(spark, [("A", "2024-05-17", 9, 1), ("B", "2024-05-17", None, 1)])
    for _ in range(2):
        store.merge_into(spark, path, late, keys, ["n"])
    spark.catalog.refreshByPath(path)
    assert rows(store.read_table(spark, path), "series_id", "session_date", "value") == [
        ("A", d("2024-05-16"), dec(1)),
        ("A", d("2024-05-17"), dec(9)),
        ("B", d("2024-05-17"), None),
    ]
    assert untouched.stat().st_mtime_ns == stamp


def test_window_becomes_a_pushed_filter(spark, tmp_path):
    path = str(tmp_path / "t")
    series(spark, [("A", x, 1, 0) for x in WEEK]).write.parquet(path)
    window = cal.window(sessions(spark), d("2024-05-20"), 2)
    df = spark.read.parquet(path).filter(window.contains()).select("series_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(session_date,2024-05-17)" in plan and "Join" not in plan
    assert df.count() == 2


def test_data_gap(spark):
    bars = sessions(spark, WEEK[:3])
    assert cal.data_gap(sessions(spark), bars, dt.date(2026, 9, 5)).first().gap_sessions == 2
    assert cal.data_gap(sessions(spark), bars.limit(0), dt.date(2026, 9, 5)).first().gap_sessions == 0


def test_folded_rows_replace_stored_ones_as_a_fold_does(spark, tmp_path):
    keys = ["series_id", "session_date"]
    first = [("A", "2024-05-16", 1, 0), ("B", "2024-05-16", 2, 0), (None, "2024-05-16", 3, 0), ("A", "2024-05-17", 4, 0)]
    late = [("A", "2024-05-16", None, 0), (None, "2024-05-16", 5, 0), ("C", "2024-05-16", 6, 0), ("C", "2024-05-18", 7, 0)]
    found = []
    for folded in (True, False):
        path = f"{tmp_path}/{folded}"
        store.merge_into(spark, path, series(spark, first), keys, ["n"], folded=folded)
        store.merge_into(spark, path, series(spark, late), keys, ["n"], folded=folded)
        found.append(rows(store.read_table(spark, path), "series_id", "session_date", "value"))
    assert found[0] == found[1] and len(found[0]) == 6


def test_upsert_of_aggregates_deals_its_rows_by_their_number(spark, tmp_path, monkeypatch):
    data = [(1, "2024-05-16", 2.5, "N", "F"), (1, "2024-05-16", 3.25, "R", "F"), (1, "2024-05-17", 1.0, "R", "F"), (1, "2024-05-16", 7.0, "A", "O"), (None, "2024-05-16", 4.0, "N", "O"), (2, "2024-05-18", 6.0, "N", None)]
    items = spark.createDataFrame(data, "l_suppkey LONG, day STRING, l_extendedprice DOUBLE, l_returnflag STRING, l_linestatus STRING")
    rest = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    items.withColumn("l_shipdate", F.col("day").cast("timestamp")).withColumns({c: F.lit(1) for c in rest}).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(q_store, "_LAID_ROWS", 3)
    laid = q_store.upsert_aggregates(Views(spark, str(tmp_path)))
    assert laid._jdf.queryExecution().executedPlan().toString().count(", 3), REPARTITION_BY_NUM") == 2
    assert dict(laid.dtypes)["value"] == dict(laid.dtypes)["num_trades"] == dict(laid.dtypes)["waprice"] == "decimal(28,9)"
    assert rows(laid) == [
        ("EQ_PRS_000000001", "EQ_AST_000000001", d("2024-05-16"), dec(7), dec(1), dec(7)),
        ("EQ_PRS_000000001", "EQ_AST_000000001", d("2024-05-17"), dec(1), dec(1), None),
        (None, None, d("2024-05-16"), dec(4), dec(1), dec(4)),
    ]
