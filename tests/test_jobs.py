import json

from conftest import d, dec, rows
from pyspark.sql import functions as F
from test_completeness import journal, sessions

from tradeaxis.operators import jobs, store
from tradeaxis.operators import journal as jr
from tradeaxis.operators.dedup import upsert
from tradeaxis.sources import equity
from tradeaxis.streaming import late

DAYS = ["2026-08-27", "2026-08-28"]


def landed(spark, data):
    df = spark.createDataFrame(
        [(t, d(x), c, n) for t, x, c, n in data], "SECID STRING, session_date DATE, CLOSE STRING, n INT"
    )
    for c in ("OPEN", "HIGH", "LOW", "VOLUME", "VALUE", "NUMTRADES", "WAPRICE"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def test_one_failing_source_stops_nobody(spark, tmp_path):
    data = landed(spark, [("SBER", DAYS[0], "1", 1), ("SBER", DAYS[1], "2", 2), ("SBER", "2026-08-29", "3", 3)])

    def broken(_):
        raise RuntimeError("site is down\nstack")

    calendar = sessions(spark, DAYS)
    sources = [
        (jobs.Source("futures_positions", "position", broken), data),
        (jobs.Source("equity_d1", "bar", lambda x: equity.bars(x, ["n"])), data),
        (jobs.Source("equity_agg", "aggregate", lambda x: equity.aggregates(x, ["n"])), data),
    ]
    log = jobs.ingest(spark, str(tmp_path), sources, calendar, run_id="r")
    assert rows(log, "source_id", "session_date", "status", "rows_written") == [
        ("equity_agg", d(DAYS[0]), "ok", 1),
        ("equity_agg", d(DAYS[1]), "ok", 1),
        ("equity_d1", d(DAYS[0]), "ok", 1),
        ("equity_d1", d(DAYS[1]), "ok", 1),
        ("equity_d1", d("2026-08-29"), "skipped", 0),
        ("futures_positions", d(DAYS[0]), "failed", 0),
        ("futures_positions", d(DAYS[1]), "failed", 0),
    ]
    assert log.filter("status = 'failed'").first().failure_reason == "site is down\nstack"
    stored = jobs.stored_tables(spark, str(tmp_path), ["bar"])["bar"]
    assert rows(stored, "session_date", "close") == [(d(DAYS[0]), dec(1)), (d(DAYS[1]), dec(2))]
    log2 = jobs.ingest(spark, str(tmp_path), sources[1:2], calendar, run_id="r2")
    assert log2.count() == 3
    spark.catalog.refreshByPath(str(tmp_path / "bar"))
    assert jobs.stored_tables(spark, str(tmp_path), ["bar"])["bar"].count() == 2


def test_catch_up_closes_by_quotes(spark):
    plan = sessions(spark, ["2026-08-26", *DAYS])
    data = landed(spark, [("SBER", DAYS[0], "1", 1), ("SBER", DAYS[1], "2", 2), ("SBER", "2026-09-30", "2", 3)])
    fetch = journal(spark, [(DAYS[1], "equity_d1", "failed", 0, "2026-08-28 10:00:00"), (DAYS[0], "brent", "failed", 0, "2026-08-28 10:00:00")])
    bars, outcome = jobs.catch_up(plan, data, fetch, ["n"])
    assert [tuple(r) for r in outcome.collect()] == [(d("2026-08-26"), "closed", 0), (d(DAYS[0]), "closed", 1), (d(DAYS[1]), "failed", 0)]
    assert rows(bars, "session_date") == [(d(DAYS[0]),)]


def test_history_load_skips_what_is_stored(spark):
    data = landed(spark, [("SBER", DAYS[0], "1", 1), ("gazp", DAYS[0], "2", 2)]).withColumn("TRADEDATE", F.col("session_date").cast("string")).drop("session_date")
    known = spark.createDataFrame([("SBER",)], "ticker STRING")
    assert rows(jobs.load_history(data, known, ["n"]), "asset_id", "close") == [("EQ_AST_GAZP", dec(2))]


def write(folder, name, *records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


SCHEMA = "series_id STRING, session_date DATE, value DECIMAL(28,9), n INT"
KEYS = store.KEYS["global_series"]


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def test_late_rows_keep_their_own_date(spark, tmp_path):
    src, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    write(src, "1.json", {"series_id": "A", "session_date": DAYS[1], "value": 1, "n": 1}, {"series_id": "A", "session_date": DAYS[1], "value": 2, "n": 2})
    late.start_upserts(stream(spark, src), log, check).awaitTermination()
    write(src, "2.json", {"series_id": "A", "session_date": "2020-01-03", "value": 7, "n": 1}, {"series_id": "A", "session_date": DAYS[1], "value": None, "n": 1})
    late.start_upserts(stream(spark, src), log, check).awaitTermination()
    late.start_upserts(stream(spark, src), log, check).awaitTermination()  # nothing new, nothing changes
    shape = stream(spark, src).schema
    got = late.read_upserts(spark, log, shape, KEYS, ["n"])
    assert rows(got, "session_date", "value") == [(d("2020-01-03"), dec(7)), (d(DAYS[1]), None)]
    batches = spark.read.schema(SCHEMA).json(str(src))
    stored = batches.limit(0).drop("n")
    first, second = (spark.read.schema(SCHEMA).json(str(src / f"{i}.json")) for i in (1, 2))
    batch = upsert(upsert(stored, first, KEYS, ["n"]), second, KEYS, ["n"])
    assert rows(batch) == rows(got, *batch.columns)
    target = str(tmp_path / "compact")
    late.compact(spark, log, target, shape, KEYS, ["n"])
    assert spark.read.parquet(target).count() == 2
    late.compact(spark, log, target, shape, KEYS, ["n"])  # an empty log changes nothing
    assert spark.read.parquet(target).count() == 2
    write(src, "3.json", {"series_id": "A", "session_date": DAYS[1], "value": 5, "n": 1}, {"series_id": "B", "session_date": DAYS[0], "value": 6, "n": 1})
    late.start_upserts(stream(spark, src), log, check).awaitTermination()
    wanted = [("A", d("2020-01-03"), dec(7)), ("A", d(DAYS[1]), dec(5)), ("B", d(DAYS[0]), dec(6))]
    assert rows(late.read_current(spark, log, target, shape, KEYS, ["n"]), "series_id", "session_date", "value") == wanted
    late.compact(spark, log, target, shape, KEYS, ["n"])
    assert rows(spark.read.schema(shape).parquet(target), "series_id", "session_date", "value") == wanted


def test_tables_without_sessions_are_ingested_and_a_second_load_reads_touched_days_only(spark, tmp_path):
    from tradeaxis.operators import jobs

    data = spark.createDataFrame([(d(x), "a") for x in DAYS], "session_date DATE, who STRING")
    sector = jobs.Source("sectors", "sector", lambda x: x.select(F.col("who").alias("asset_id"), F.lit("S").alias("sector")).distinct(), None)
    days = spark.createDataFrame([(d(x),) for x in DAYS], "session_date DATE")
    out = jobs.run_source(spark, str(tmp_path), sector, data, days, "r", "daily")
    assert {r.status for r in out.collect()} == {"ok"}
    assert rows(store.read_table(spark, f"{tmp_path}/sector")) == [("a", "S")]
    path = str(tmp_path / "g")
    one = spark.createDataFrame([("A", d(x), dec(1), 1) for x in DAYS], SCHEMA)
    store.merge_into(spark, path, one, KEYS, ["n"])
    store.merge_into(spark, path, one.filter(F.col("session_date") == F.lit(d(DAYS[0]))).withColumn("value", F.lit(2).cast("decimal(28,9)")), KEYS, ["n"])
    got = rows(store.read_table(spark, path), "session_date", "value")
    assert got == sorted([(d(x), dec(2 if x == DAYS[0] else 1)) for x in DAYS])


def test_a_replayed_batch_overwrites_itself(spark, tmp_path):
    src, log = tmp_path / "in", str(tmp_path / "log")
    write(src, "1.json", {"series_id": "A", "session_date": DAYS[1], "value": 1, "n": 1})
    for name in ("c1", "c2"):  # a lost checkpoint replays batch zero
        late.start_upserts(stream(spark, src), log, str(tmp_path / name)).awaitTermination()
    assert spark.read.parquet(log).count() == 1


def test_progress_stream_equals_the_batch(spark, tmp_path):
    log = journal(
        spark,
        [(DAYS[0], "equity_d1", "failed", 0, "2026-08-28 10:00:00"), (DAYS[0], "equity_d1", "ok", 0, "2026-08-28 11:00:00"), (DAYS[1], "equity_d1", "failed", 0, "2026-08-28 12:00:00"), (DAYS[1], "brent", "ok", 0, "2026-08-28 13:00:00")],
    ).withColumn("run_id", F.lit("r"))
    for i, part in enumerate(("id < 1", "id >= 1")):
        log.filter(part).coalesce(1).write.json(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    outcomes = late.session_outcomes(source)
    late.start_upserts(outcomes, str(tmp_path / "log"), str(tmp_path / "check"), mode="update").awaitTermination()
    folded = late.read_upserts(spark, str(tmp_path / "log"), outcomes.schema, ["run_id", "session_date"], [])
    asked = sessions(spark, ["2026-08-26", *DAYS]).withColumn("run_id", F.lit("r"))
    assert rows(late.progress_of(folded, asked)) == rows(jr.progress(asked, log)) == [("r", 3, 1, 1, 1)]


def test_a_compaction_that_is_lost_anywhere_loses_nothing(spark, tmp_path, monkeypatch):
    log, target = str(tmp_path / "log"), str(tmp_path / "t")
    shape = spark.createDataFrame([], SCHEMA).schema

    def batch(number, *data):
        spark.createDataFrame([(k, d(x), dec(v), 1) for k, x, v in data], SCHEMA).write.mode("overwrite").parquet(f"{log}/batch_id={number}")

    def current():
        return rows(late.read_current(spark, log, target, shape, KEYS, ["n"]), "series_id", "session_date", "value")

    batch(0, ("A", DAYS[0], 1), ("A", DAYS[1], 2), ("A", "2020-01-03", 3))
    late.compact(spark, log, target, shape, KEYS, ["n"])
    batch(1, ("A", DAYS[1], 5), ("B", DAYS[1], 6))
    wanted = [("A", d("2020-01-03"), dec(3)), ("A", d(DAYS[0]), dec(1)), ("A", d(DAYS[1]), dec(5)), ("B", d(DAYS[1]), dec(6))]
    place, drop = late._put_in_place, late.discard

    def lost(*_):
        raise RuntimeError("lost")

    for name in ("_put_in_place", "discard"):
        monkeypatch.setattr(late, name, lost)
        if name == "discard":  # lost after the copy is in place, before the log is emptied
            monkeypatch.setattr(late, "_put_in_place", place)
        try:
            late.compact(spark, log, target, shape, KEYS, ["n"])
            raise AssertionError("the run was to be lost")
        except RuntimeError:
            pass
        spark.catalog.refreshByPath(target)
        assert current() == wanted
        monkeypatch.setattr(late, "discard", drop)
    monkeypatch.setattr(late, "_put_in_place", place)
    untouched = {f: (tmp_path / "t" / f).stat().st_mtime for f in ("session_date=2020-01-03", f"session_date={DAYS[0]}")}
    late.compact(spark, log, target, shape, KEYS, ["n"])
    assert rows(spark.read.schema(shape).parquet(target), "series_id", "session_date", "value") == wanted
    assert {f: (tmp_path / "t" / f).stat().st_mtime for f in untouched} == untouched
    assert not store.exists(spark, f"{target}.pending") and not store.exists(spark, f"{log}/batch_id=1")
