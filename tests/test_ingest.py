"""One routed pass over all sources, catch-up over the same routes, and history that is resumed."""

from dataclasses import replace
from pathlib import Path

from conftest import d, dec, rows
from pyspark.sql import functions as F
from test_completeness import sessions
from test_jobs import DAYS, landed

from tradeaxis.operators import ingest, store
from tradeaxis.session import shared_folder, staged_at
from tradeaxis.sources import equity

QUOTE = "SECID string, CLOSE string, n int, OPEN string, HIGH string, LOW string, VOLUME string"


def _broken(_):
    raise RuntimeError("site is down")


def _routes():
    return [
        ingest.Route("brent", "global_series", "value string", lambda r: r.select(F.lit("OIL").alias("series_id"), "session_date", F.col("value").cast("decimal(28,9)").alias("value"))),
        ingest.Route("equity_lot_sizes", "asset", "SECID string, lot int", lambda r: r.select(F.concat(F.lit("EQ_AST_"), "SECID").alias("asset_id"), F.col("lot").alias("lot_size")), gated=False, day=None),
        ingest.Route("futures_positions", "position", "x int", _broken),
        ingest.Route("equity_d1", "bar", QUOTE, lambda r: equity.bars(r, ["n"])),
    ]


def _landed(spark, quotes, oil=(), lots=()):
    parts = [ingest.landed("equity_d1", landed(spark, quotes).drop("VALUE", "NUMTRADES", "WAPRICE"))]
    parts.append(ingest.landed("brent", spark.createDataFrame([(d(x), str(v)) for x, v in oil], "session_date DATE, value STRING")))
    parts.append(ingest.landed("equity_lot_sizes", spark.createDataFrame(list(lots), "SECID STRING, lot INT"), None))
    parts.append(ingest.landed("futures_positions", spark.createDataFrame([(d(DAYS[0]), 1)], "session_date DATE, x INT")))
    junk = spark.createDataFrame([("brent", d(DAYS[0]), "no json"), ("unknown", d(DAYS[0]), "{}")], ingest.LANDED)
    out = junk.filter("source_id = 'unknown'")
    for part in parts:
        out = out.unionByName(part)
    return out


def _journal(frame):
    return rows(frame, "source_id", "session_date", "status", "rows_written", "failure_reason")


def test_nothing_of_a_run_stays_in_the_shared_folder_but_its_journal(spark, tmp_path):
    shared = Path(shared_folder(spark))
    before = set(shared.iterdir())
    first = _landed(spark, [("SBER", DAYS[0], "1", 1), ("SBER", DAYS[0], "2", 2)], [(DAYS[0], 80)])
    routes = [replace(r, folded=r.source_id == "equity_d1") for r in _routes()]
    log = ingest.ingest_all(spark, str(tmp_path), first, routes, sessions(spark, DAYS), "r1")
    made = {p.name.split("-")[0] for p in set(shared.iterdir()) - before}
    assert not made & {"landed", "ingest", "merge"}
    assert ("equity_d1", d(DAYS[0]), "ok", 1, None) in _journal(log)
    assert ("futures_positions", d(DAYS[0]), "failed", 0, "site is down") in _journal(log)
    assert rows(store.read_table(spark, f"{tmp_path}/bar"), "asset_id", "close") == [("EQ_AST_SBER", dec(1))]


def test_landing_neither_shuffles_nor_changes_the_session(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(name)
    many = spark.range(40).repartition(5).selectExpr("concat('s', id % 3) as source_id", "date '2026-01-05' as session_date", "cast(id as string) as record")
    path = ingest.by_source(many)
    assert spark.conf.get(name) == was
    assert len(list(Path(path).glob("source_id=s0/*.parquet"))) > 1  # as the tasks had it
    assert rows(spark.read.parquet(path), "source_id", "session_date", "record") == rows(many)


def test_all_sources_in_one_pass(spark, tmp_path):
    root, calendar = str(tmp_path), sessions(spark, DAYS)
    first = _landed(spark, [("SBER", DAYS[0], "1", 1), ("SBER", "2026-08-29", "3", 3)], [(DAYS[0], 80)], [("SBER", 10), ("GAZP", 100)])
    log = ingest.ingest_all(spark, root, first, _routes(), calendar, "r1")
    assert _journal(log) == [
        ("brent", d(DAYS[0]), "ok", 1, None),
        ("equity_d1", d(DAYS[0]), "ok", 1, None),
        ("equity_d1", d("2026-08-29"), "skipped", 0, "не торговая сессия"),
        ("equity_lot_sizes", d(DAYS[1]), "ok", 1, None),
        ("futures_positions", d(DAYS[0]), "failed", 0, "site is down"),
    ]
    assert rows(store.read_table(spark, f"{root}/asset"), "asset_id", "first_seen", "last_seen", "lot_size") == [("EQ_AST_SBER", d(DAYS[0]), d(DAYS[0]), 10)]
    second = _landed(spark, [("SBER", DAYS[1], "2", 1), ("GAZP", DAYS[1], "5", 2)], lots=[("GAZP", 100)])
    ingest.ingest_all(spark, root, second, _routes(), calendar, "r2")
    got = rows(store.read_table(spark, f"{root}/asset"), "asset_id", "first_seen", "last_seen", "lot_size")
    assert got == [("EQ_AST_GAZP", d(DAYS[1]), d(DAYS[1]), 100), ("EQ_AST_SBER", d(DAYS[0]), d(DAYS[1]), 10)]
    assert rows(store.read_table(spark, f"{root}/price_series"), "price_series_id", "asset_id") == [("EQ_PRS_GAZP", "EQ_AST_GAZP"), ("EQ_PRS_SBER", "EQ_AST_SBER")]
    ingest.ingest_all(spark, root, second, _routes(), calendar, "r2")  # a run that is repeated replaces its own journal
    assert ingest.stored_journal(spark, root).groupBy("run_id").count().count() == 2
    assert ingest.stored_journal(spark, root).count() == 5 + 3
    assert store.read_table(spark, f"{root}/bar").count() == 3


def test_catch_up_stores_and_journals_what_was_planned(spark, tmp_path):
    root, plan = str(tmp_path), sessions(spark, ["2026-08-26", *DAYS])
    rows_ = _landed(spark, [("SBER", DAYS[0], "1", 1), ("SBER", DAYS[1], "2", 2), ("SBER", "2026-09-30", "2", 3)], [(DAYS[0], 80), (DAYS[1], 81), ("2026-09-30", 1)])
    down = spark.createDataFrame([("equity_d1", d(DAYS[1]), "timeout")], "source_id STRING, session_date DATE, reason STRING")
    gated = [r for r in _routes() if r.gated and r.source_id != "futures_positions"]
    outcome = ingest.catch_up(spark, root, plan, rows_, gated, "r", down)
    assert rows(outcome, "session_date", "outcome", "rows_written") == [(d("2026-08-26"), "closed", 0), (d(DAYS[0]), "closed", 1), (d(DAYS[1]), "failed", 0)]
    assert _journal(ingest.stored_journal(spark, root)) == [
        ("brent", d(DAYS[0]), "ok", 1, None),
        ("brent", d(DAYS[1]), "ok", 1, None),
        ("equity_d1", d(DAYS[0]), "ok", 1, None),
        ("equity_d1", d(DAYS[1]), "failed", 0, "timeout"),
    ]
    assert rows(store.read_table(spark, f"{root}/bar"), "session_date", "close") == [(d(DAYS[0]), dec(1))]
    assert rows(store.read_table(spark, f"{root}/global_series"), "session_date", "value") == [(d(DAYS[0]), dec(80)), (d(DAYS[1]), dec(81))]


def test_history_is_resumed_where_it_was_lost(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    data = landed(spark, [("SBER", DAYS[0], "1", 1), ("GAZP", DAYS[0], "2", 2), ("GAZP", DAYS[1], "3", 3)])
    history = data.withColumn("TRADEDATE", F.col("session_date").cast("string")).drop("session_date")
    register = ingest._register

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, "_register", lost)  # bars are stored, nothing is marked
    try:
        ingest.load_history(spark, root, history, ["n"])
        raise AssertionError("the run was to be lost")
    except RuntimeError:
        pass
    monkeypatch.setattr(ingest, "_register", register)
    assert rows(ingest.load_history(spark, root, history.filter("SECID = 'SBER'"), ["n"])) == [("SBER",)]
    assert rows(ingest.load_history(spark, root, history, ["n"])) == [("GAZP",)]
    assert ingest.load_history(spark, root, history, ["n"]).count() == 0
    assert rows(store.read_table(spark, f"{root}/bar"), "asset_id", "session_date", "close") == [
        ("EQ_AST_GAZP", d(DAYS[0]), dec(2)),
        ("EQ_AST_GAZP", d(DAYS[1]), dec(3)),
        ("EQ_AST_SBER", d(DAYS[0]), dec(1)),
    ]


def test_an_answer_that_serves_two_sources_lands_once(spark, tmp_path):
    root, calendar = str(tmp_path), sessions(spark, DAYS)
    fields = "SECID string, VALUE string, NUMTRADES string, WAPRICE string, n int"
    routes = [
        ingest.Route("equity_d1", "bar", QUOTE, lambda r: equity.bars(r, ["n"]), folded=True),
        ingest.Route("equity_agg", "aggregate", fields, lambda r: equity.aggregates(r, ["n"]), folded=True, reads="equity_d1"),
    ]
    quotes = landed(spark, [("SBER", DAYS[0], "1", 1), ("SBER", DAYS[1], "2", 2)]).withColumn("VALUE", F.lit("7"))
    down = spark.createDataFrame([("equity_d1", d(DAYS[1]), "timeout")], "source_id STRING, session_date DATE, reason STRING")
    log = ingest.ingest_all(spark, root, ingest.landed("equity_d1", quotes), routes, calendar, "r1", unreachable=down)
    assert _journal(log) == [
        ("equity_agg", d(DAYS[0]), "ok", 1, None),
        ("equity_agg", d(DAYS[1]), "ok", 1, None),
        ("equity_d1", d(DAYS[0]), "ok", 1, None),
        ("equity_d1", d(DAYS[1]), "failed", 0, "timeout"),
    ]
    assert rows(store.read_table(spark, f"{root}/aggregate"), "session_date", "value") == [(d(DAYS[0]), dec(7)), (d(DAYS[1]), dec(7))]
    assert rows(store.read_table(spark, f"{root}/bar"), "session_date", "close") == [(d(DAYS[0]), dec(1))]


def test_a_new_table_is_written_without_a_copy_beside_it(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(store, "staged_at", lambda df, path: made.append(path) or staged_at(df, path))
    root = str(tmp_path)

    def put(*data):
        bars = equity.bars(landed(spark, list(data)), ["n"])
        return store.put(spark, root, "bar", bars, store.KEYS["bar"], "month", "session_date", True, f"{root}/copy{len(made)}")

    first = put(("SBER", DAYS[0], "1", 1), ("SBER", DAYS[0], "2", 2), ("GAZP", DAYS[0], "", 3))
    want = rows(equity.bars(landed(spark, [("SBER", DAYS[0], "1", 1), ("GAZP", DAYS[0], "", 3)]), ["n"]))
    assert made == [] and first.columns == list(equity.bars(landed(spark, []), ["n"]).columns)
    assert rows(first) == want  # with the fingerprint, which is made where the rows are written
    put(("SBER", DAYS[0], "5", 1))
    assert len(made) == 1
    assert rows(store.read_table(spark, f"{root}/bar"), "asset_id", "close") == [("EQ_AST_GAZP", None), ("EQ_AST_SBER", dec(5))]
    nothing = store.put(spark, f"{root}/none", "bar", equity.bars(landed(spark, []), ["n"]), store.KEYS["bar"], "month", "session_date", True, f"{root}/x")
    assert nothing.count() == 0


def test_sources_land_one_after_the_other_and_leave_no_shuffle(spark, tmp_path, monkeypatch):
    shared, calendar = Path(shared_folder(spark)), sessions(spark, DAYS)
    before, held, files = set(shared.iterdir()), [], []
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    was = {p.name for p in local.rglob("shuffle_*.data")}

    def looked(source_id, made):
        def run(rows):
            held.append((source_id, sorted(p.name for f in set(shared.iterdir()) - before if f.name.startswith("landed") for p in f.glob("source_id=*"))))
            files.append([p.name for p in local.rglob("shuffle_*.data") if p.name not in was])
            return made(rows)

        return run

    whole = _landed(spark, [("SBER", DAYS[0], "1", 1), ("SBER", DAYS[0], "2", 2)], [(DAYS[0], 80)], [("SBER", 10)])
    routes = [replace(r, build=looked(r.source_id, r.build)) for r in _routes() if r.source_id != "futures_positions"]
    by_source = {r.source_id: whole.filter(F.col("source_id") == r.source_id) for r in routes}
    log = ingest.ingest_all(spark, str(tmp_path / "a"), by_source, routes, calendar, "r1")
    assert held == [(name, [f"source_id={name}"]) for name in ("equity_d1", "brent", "equity_lot_sizes")]
    assert files[1] == files[2] == []
    assert not {p.name.split("-")[0] for p in set(shared.iterdir()) - before} & {"landed", "ingest", "merge"}
    plain = [r for r in _routes() if r.source_id != "futures_positions"]
    assert _journal(log) == _journal(ingest.ingest_all(spark, str(tmp_path / "b"), whole, plain, calendar, "r1"))
    nothing = ingest.ingest_all(spark, str(tmp_path / "c"), {"equity_d1": by_source["equity_d1"]}, plain, calendar, "r1")
    assert [r for r in _journal(nothing) if r[0] == "brent"] == []
    assert rows(store.read_table(spark, f"{tmp_path}/c/bar"), "asset_id", "close") == [("EQ_AST_SBER", dec(1))]


def test_sessions_land_in_batches_and_end_as_one(spark, tmp_path, monkeypatch):
    shared, days = Path(shared_folder(spark)), ["2026-06-29", "2026-06-30", "2026-07-01"]
    calendar = sessions(spark, days)
    quotes = [("SBER", days[0], "1", 1), ("SBER", days[0], "2", 2), ("SBER", days[1], "3", 3), ("GAZP", days[1], "4", 4), ("SBER", days[2], "5", 5), ("SBER", "2026-07-02", "6", 6)]
    typed = landed(spark, quotes).withColumn("VALUE", F.lit("7"))
    typed = typed.unionByName(typed.limit(1).withColumn("session_date", F.lit(None).cast("date")))
    arrived = {"equity_d1": ingest.landed("equity_d1", typed)}
    held, made, before = [], [], set(shared.iterdir())

    def looked(rows):
        held.append(len([f for f in set(shared.iterdir()) - before if f.name.startswith("landed")]))
        return equity.bars(rows, ["n"])

    fields = "SECID string, VALUE string, NUMTRADES string, WAPRICE string, n int"
    routes = [
        ingest.Route("equity_d1", "bar", QUOTE, looked, folded=True, by_session=True),
        ingest.Route("equity_agg", "aggregate", fields, lambda r: equity.aggregates(r, ["n"]), folded=True, reads="equity_d1", by_session=True),
    ]
    monkeypatch.setattr(store, "staged_at", lambda df, path: made.append(path) or staged_at(df, path))

    def ran(name, served, down=None):
        log = ingest.ingest_all(spark, str(tmp_path / name), arrived, served, calendar, "r1", grain="month", unreachable=down)
        return _journal(log), [rows(store.read_table(spark, f"{tmp_path}/{name}/{t}")) for t in ("bar", "aggregate", "asset", "price_series")]

    whole = ran("whole", routes)
    assert held == [1]
    monkeypatch.setattr(ingest, "_BATCH_ROWS", 1)
    held.clear()
    assert ran("dealt", routes) == whole
    assert held == [1, 1] and made == []  # a month at a time, and no partition that is new is copied
    down = spark.createDataFrame([("equity_d1", d(days[1]), "timeout")], "source_id STRING, session_date DATE, reason STRING")
    log, stored = ran("dealt", routes[:1], down)  # laid over itself
    assert stored[:2] == whole[1][:2] and made
    assert [r[1] for r in log if r[2] == "failed"] == [d(days[1])] and len(log) == 3 + 2
    assert not {p.name.split("-")[0] for p in set(shared.iterdir()) - before} & {"landed", "ingest", "merge", "registry"}


def test_batches_hold_whole_partitions_and_their_number_is_bounded(spark, monkeypatch):
    many = spark.sql("select date_add(date '2024-01-01', cast(id % 366 as int)) as session_date from range(3660)").unionByName(spark.sql("select cast(null as date) as session_date"))
    assert [b.parts for b in ingest.batches(many.limit(0), "day")] == [()]
    assert len(ingest.batches(many, "month")) == 1
    monkeypatch.setattr(ingest, "_BATCH_ROWS", 10)
    dealt = ingest.batches(many, "day")
    assert 8 <= len(dealt) <= 9 and sum(len(b.parts) for b in dealt) == 366
    monkeypatch.setattr(ingest, "_BATCHES", 1000)
    dealt = ingest.batches(many, "month")
    assert [b.parts for b in dealt] == [(f"2024-{m:02}",) for m in range(1, 13)]
    assert [b.of(many).count() for b in dealt] == [311, 290, 310, 300, 310, 300, 310, 310, 300, 310, 300, 310]  # a row without a day is in the first
