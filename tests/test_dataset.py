from conftest import d, dec, rows
from pyspark.sql import functions as F

from tradeaxis.config import Settings
from tradeaxis.operators import calendar as cal
from tradeaxis.operators import dataset as ds
from test_completeness import bars, journal, positions, sessions

ASOF = d("2026-08-28")
SETTINGS = Settings(price_window=3, global_window=3, positions_window=2)
DAYS = ["2026-08-26", "2026-08-27", "2026-08-28"]


def full_bars(spark, data):
    df = spark.createDataFrame(
        [(f"EQ_PRS_{t}", f"EQ_AST_{t}", d(x), dec(c)) for t, x, c in data],
        "price_series_id STRING, asset_id STRING, session_date DATE, close DECIMAL(28,9)",
    )
    none = F.lit(None).cast("decimal(28,9)")
    return df.select("price_series_id", "asset_id", "session_date", none.alias("open"), none.alias("high"), none.alias("low"), "close", none.alias("volume"))


def tables(spark, closes=(("SBER", DAYS[0], 300), ("SBER", DAYS[2], "314.22"), ("GAZP", DAYS[1], 0))):
    none = F.lit(None).cast("decimal(28,9)")
    b = full_bars(spark, closes)
    return {
        "bar": b,
        "aggregate": b.select("price_series_id", "asset_id", "session_date", F.col("close").alias("value"), none.alias("num_trades"), none.alias("waprice")),
        "global_series": spark.createDataFrame([("IMOEX", d(DAYS[2]), dec("3200.5"))], "series_id STRING, session_date DATE, value DECIMAL(28,9)"),
        "position": positions(spark, [(DAYS[2], None)]),
        "sector": spark.createDataFrame([("EQ_AST_SBER", "Финансы"), ("EQ_AST_GAZP", None)], "asset_id STRING, sector STRING"),
    }


def value_of(spark, t, runs=(), shuffle=False):
    parts, windows = ds.build_parts(t, sessions(spark, DAYS), journal(spark, list(runs)), ASOF, SETTINGS)
    if shuffle:
        parts = {k: df.repartition(7, F.rand(3)) for k, df in parts.items()}
    return ds.digest(ds.series_hashes(parts), ds.header(ASOF, windows)).first().digest


def test_a_hole_stays_a_hole_and_zero_stays_zero(spark):
    window = cal.window(sessions(spark, DAYS), ASOF, 3)
    got = {r.asset_id: r.rows for r in ds.prices(tables(spark)["bar"], window).collect()}
    hole = [None] * 5
    assert got["EQ_AST_SBER"] == [[None, None, None, "300.000000000", None], hole, [None, None, None, "314.220000000", None]]
    assert got["EQ_AST_GAZP"] == [hole, [None, None, None, "0.000000000", None], hole]
    scalar = ds.global_series(tables(spark)["global_series"], window).first()
    assert scalar.rows == [None, None, "3200.500000000"]
    empty_row = ds.positions(tables(spark)["position"], window).first()
    assert empty_row.rows == [[None] * 4] * 3


def test_nothing_is_generated_for_the_axis(spark):
    window = cal.window(sessions(spark, DAYS), ASOF, 3)
    plan = ds.prices(tables(spark)["bar"], window)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_same_content_same_digest_in_any_order(spark):
    t = tables(spark)
    assert value_of(spark, t) == value_of(spark, t, shuffle=True)
    reordered = tables(spark, (("GAZP", DAYS[1], 0), ("SBER", DAYS[2], "314.220"), ("SBER", DAYS[0], 300)))
    assert value_of(spark, t) == value_of(spark, reordered)


def test_any_difference_changes_the_digest(spark):
    base = value_of(spark, tables(spark))
    assert base != value_of(spark, tables(spark, (("SBER", DAYS[0], 300), ("SBER", DAYS[2], "314.23"), ("GAZP", DAYS[1], 0))))
    assert base != value_of(spark, tables(spark, (("SBER", DAYS[0], 300), ("SBER", DAYS[2], "314.22"), ("GAZP", DAYS[1], None))))
    failed = [(DAYS[0], "cbr", "failed", 0, "2026-08-26 20:00:00")]
    assert base != value_of(spark, tables(spark), failed)
    no_sector = tables(spark)
    no_sector["sector"] = no_sector["sector"].filter("sector IS NOT NULL")
    assert base != value_of(spark, no_sector)


def test_sink_writes_once(spark, tmp_path):
    args = (spark, str(tmp_path), tables(spark), sessions(spark, DAYS), journal(spark, [(DAYS[1], "cbr", "failed", 0, "2026-08-27 20:00:00")]), ASOF, SETTINGS)
    path, digest, written = ds.materialise(*args)
    assert written and path.endswith(f"2026-08-28-{digest[:16]}")
    stamp = [p.stat().st_mtime_ns for p in sorted((tmp_path).rglob("*.parquet"))]
    assert ds.materialise(*args) == (path, digest, False)
    assert stamp == [p.stat().st_mtime_ns for p in sorted((tmp_path).rglob("*.parquet"))]
    manifest = spark.read.parquet(f"{path}/manifest").first()
    assert (manifest.session_count, manifest.asset_count, manifest.positions_sessions) == (3, 2, 2)
    assert [(r.session_date, r.sources) for r in manifest.incomplete] == [(d(DAYS[1]), ["cbr"])]
    assert spark.read.parquet(f"{path}/prices").count() == 2


def test_full_window_is_declared_by_an_empty_list(spark, tmp_path):
    t = tables(spark, [("SBER", x, 1) for x in DAYS])
    path, _, _ = ds.materialise(spark, str(tmp_path), t, sessions(spark, DAYS), journal(spark, []), ASOF, SETTINGS)
    assert spark.read.parquet(f"{path}/manifest").first().incomplete == []


def test_preconditions(spark):
    c = sessions(spark, DAYS)

    def reason(asof, b):
        return ds.preconditions(c, b, asof, cal.window(c, asof, 3)).first().reason

    assert reason(ASOF, bars(spark, DAYS)) is None
    assert reason(d("2026-08-29"), bars(spark, DAYS)) == "not_a_session"
    assert reason(ASOF, bars(spark, ["2026-08-31"])) == "no_bars"


def test_retention_and_availability(spark):
    names = spark.createDataFrame([("2026-07-01-aa",), ("2026-08-20-bb",), ("tmp",), ("2026-07-29-cc",)], "name STRING")
    old = ds.expired(names, F.lit("2026-08-28 10:00:00").cast("timestamp"), 30)
    assert rows(old, "name") == [("2026-07-01-aa",)]
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, dataset_ref STRING")
    kept = spark.createDataFrame([("a",)], "ref STRING")
    assert rows(ds.availability(runs, kept), "id", "dataset_available") == [(1, True), (2, False)]


def test_staleness(spark):
    schema = "i INT, collected BOOLEAN, f1 STRING, f2 STRING, stored STRING, now STRING"
    data = [
        (1, False, "a", "a", "x", "y"),  # nothing collected, same window: proven
        (2, False, "a", "b", "x", "x"),
        (3, False, "a", "b", "x", "y"),
        (4, True, "a", "a", "x", "y"),
        (5, True, "a", "a", "x", None),  # cannot be built any more
        (6, False, None, "b", "x", "y"),
    ]
    df = spark.createDataFrame(data, schema)
    stale = ds.is_stale(F.col("collected"), (F.col("f1"), F.col("f1")), (F.col("f2"), F.col("f2")), F.col("stored"), F.col("now"))
    assert [r[0] for r in df.orderBy("i").select(stale).collect()] == [False, False, True, True, False, True]
