from conftest import d, dec, rows, ts
from pyspark.sql import functions as F

from tradeaxis.config import GROUPS, Settings
from tradeaxis.operators import calendar as cal
from tradeaxis.operators import completeness as comp
from tradeaxis.operators import journal as jr

WEEK = ["2023-03-06", "2023-03-07", "2023-03-09", "2023-03-10", "2023-03-14"]
BY_ID = {g.group_id: g for g in GROUPS}
SMALL = Settings(price_window=5, global_window=5, positions_window=2, required_groups=("quotes", "positions"))
ASOF = d("2023-03-14")


def sessions(spark, days=WEEK):
    return spark.createDataFrame([(d(x),) for x in days], "session_date DATE")


def bars(spark, days, close=57):
    data = [("EQ_PRS_TORN", "EQ_AST_TORN", d(x), dec(close)) for x in days]
    return spark.createDataFrame(data, "price_series_id STRING, asset_id STRING, session_date DATE, close DECIMAL(28,9)")


def positions(spark, data):
    schema = "asset_id STRING, session_date DATE, fiz_long DECIMAL(28,9), fiz_short DECIMAL(28,9), jur_long DECIMAL(28,9), jur_short DECIMAL(28,9)"
    return spark.createDataFrame([("A", d(x), dec(v), None, None, None) for x, v in data], schema)


def journal(spark, data):
    full = [
        (i, f"run-{i}", None if x is None else d(x), source, status, "daily", "why" if status == "failed" else None, n, ts(at), ts(at))
        for i, (x, source, status, n, at) in enumerate(data)
    ]
    return spark.createDataFrame(
        full,
        "id BIGINT, run_id STRING, session_date DATE, source_id STRING, status STRING, trigger STRING, failure_reason STRING, rows_written INT, started_at TIMESTAMP, finished_at TIMESTAMP",
    )


def gaps(spark, bar_days, runs):
    missing, unfinished, empty = comp.gap_report(
        sessions(spark), bars(spark, bar_days), journal(spark, runs), ASOF, SMALL
    )
    return missing, unfinished, empty.first().needs_backfill


def test_days_off_are_never_gaps(spark):
    missing, _, backfill = gaps(spark, WEEK, [])
    assert rows(missing) == [] and backfill is False


def test_a_missing_session_is_a_gap_unless_a_run_answered(spark):
    runs = [("2023-03-07", "equity_d1", "ok", 0, "2023-03-07 20:00:00"), ("2023-03-09", "equity_d1", "failed", 0, "2023-03-09 20:00:00"), ("2023-03-10", "brent", "ok", 1, "2023-03-10 20:00:00")]
    missing, _, _ = gaps(spark, ["2023-03-06", "2023-03-14"], runs)
    assert rows(missing) == [(d("2023-03-09"),), (d("2023-03-10"),)]


def test_an_empty_store_needs_backfill_and_has_no_gaps(spark):
    missing, unfinished, backfill = gaps(spark, [], [("2023-03-07", "brent", "failed", 0, "2023-03-07 20:00:00")])
    assert backfill is True and rows(missing) == [] and rows(unfinished) == []


def test_a_successful_retry_clears_the_failure(spark):
    runs = [
        ("2023-03-07", "brent", "failed", 0, "2023-03-07 20:00:00"),
        ("2023-03-07", "brent", "ok", 1, "2023-03-07 21:00:00"),
        ("2023-03-09", "cbr", "ok", 1, "2023-03-09 20:00:00"),
        ("2023-03-09", "cbr", "failed", 0, "2023-03-09 21:00:00"),
    ]
    missing, unfinished, _ = gaps(spark, [x for x in WEEK if x != "2023-03-09"], runs)
    assert rows(unfinished) == [(d("2023-03-09"), "cbr", "why")]
    assert rows(comp.incomplete_by_session(missing, unfinished)) == [(d("2023-03-09"), ["cbr", "equity_d1"])]


def test_a_range_source_is_closed_by_its_observations(spark):
    series = spark.createDataFrame([("IMOEX", d(x), dec(1)) for x in WEEK[:4]], "series_id STRING, session_date DATE, value DECIMAL(28,9)")
    runs = [("2023-03-14", "global_series", "ok", 5, "2023-03-14 20:00:00")]
    window = cal.window(sessions(spark), ASOF, 5)
    assert comp.missing_sessions(BY_ID["global"], series, journal(spark, runs), window).count() == 0
    assert comp.missing_sessions(BY_ID["global"], series, journal(spark, []), window).count() == 1
    empty = cal.window(sessions(spark), d("2000-01-01"), 5)
    assert comp.missing_sessions(BY_ID["global"], series, journal(spark, runs), empty).count() == 0


def test_covered_is_not_the_same_as_filled(spark):
    held = positions(spark, [("2023-03-10", None), ("2023-03-14", None)])
    window = cal.window(sessions(spark), ASOF, 2)
    raw = comp.group_coverage(held, BY_ID["positions"].value_columns, "session_date", window).first()
    assert (raw.sessions_covered, raw.rows_total, raw.rows_with_values) == (2, 2, 0)
    assert comp.observed_sessions(held, BY_ID["positions"].value_columns, window).count() == 0


def tables(spark, bar_days, position_data):
    return {
        "bar": bars(spark, bar_days),
        "aggregate": bars(spark, []).withColumn("value", F.col("close")).withColumn("num_trades", F.col("close")).withColumn("waprice", F.col("close")),
        "global_series": bars(spark, []).withColumn("value", F.col("close")),
        "position": positions(spark, position_data),
        "sector": spark.createDataFrame([("A", None), ("B", "x")], "asset_id STRING, sector STRING"),
    }


def test_coverage_report(spark):
    got = comp.coverage_report(
        tables(spark, WEEK[:4], [("2023-03-10", None), ("2023-03-14", None)]), sessions(spark), SMALL, ASOF
    )
    by = {r.group_id: r for r in got.collect()}
    assert (by["quotes"].sessions_covered, by["quotes"].gaps, str(by["quotes"].coverage_ratio)) == (4, 1, "0.8000")
    assert by["positions"].looks_collected_but_empty and by["positions"].gaps == 0
    assert by["aggregates"].value_ratio is None and by["aggregates"].rows_total == 0
    assert by["reference"].window_sessions is None and str(by["reference"].value_ratio) == "0.5000"


def walk(calendar, closed, depths):
    """Readiness of each day the slow way, one window at a time."""
    out = {}
    for i, day in enumerate(calendar):
        missing = []
        for group, depth in depths.items():
            window = calendar[max(0, i - depth + 1) : i + 1]
            if len(window) < depth or any((group, x) not in closed for x in window):
                missing.append(group)
        out[day] = (not missing, sorted(missing))
    return out


def test_readiness_equals_a_walk_over_days(spark):
    days = [f"2026-08-{i:02d}" for i in range(1, 29)]
    have = [x for x in days if x not in ("2026-08-05", "2026-08-17")]
    held = [(x, 1) for x in days if x not in ("2026-08-10",)]
    runs = [("2026-08-17", "equity_d1", "ok", 0, "2026-08-17 20:00:00"), (None, "equity_d1", "ok", 0, "2026-08-17 20:00:00")]
    required = SMALL.required()
    closed = comp.closed_sessions(required, tables(spark, have, held), journal(spark, runs))
    states = comp.readiness(sessions(spark, days), closed, required, SMALL)
    pairs = {(r.group_id, r.session_date) for r in closed.collect()}
    expected = walk([d(x) for x in days], pairs, {"quotes": 5, "positions": 2})
    got = {r.session_date: (r.ready, r.missing_groups) for r in states.collect()}
    assert got == expected
    latest = comp.latest_ready(sessions(spark, days), states, d("2026-08-30"), SMALL).first().latest_ready
    assert latest == max(x for x, (ok, _) in expected.items() if ok)
    recent = comp.recent_readiness(
        sessions(spark, days), tables(spark, have, held), journal(spark, runs), required, SMALL, d("2026-08-20")
    )
    asked = [x for x in got if d("2026-08-16") <= x <= d("2026-08-20")]
    assert {r.session_date: (r.ready, r.missing_groups) for r in recent.collect()} == {x: got[x] for x in asked}
    assert rows(comp.readiness_of(states, d("2026-09-15"))) == [(d("2026-09-15"), False, False, [])]
    blocked = comp.blocking_groups(spark, states, sessions(spark, days), d("2026-08-10"), SMALL)
    assert {r.group_id for r in blocked.collect()} == set(expected[d("2026-08-10")][1])


def test_pending_respects_attempts_and_delay(spark):
    now = F.lit("2023-03-14 17:00:00").cast("timestamp")
    runs = (
        [("2023-03-07", "brent", "failed", 0, "2023-03-07 20:00:00")] * 5
        + [("2023-03-09", "equity_d1", "failed", 0, "2023-03-14 16:50:00")]
        + [("2023-03-10", "equity_d1", "failed", 0, "2023-03-14 16:45:00")]
    )
    table = tables(spark, ["2023-03-06"], [(x, 1) for x in WEEK])
    log = journal(spark, runs)
    missing, window = comp.incomplete_closed_sessions(table, log, sessions(spark), SMALL, now, ASOF)
    assert missing.count() == 4
    # The 27th is out of attempts and the 28th was tried ten minutes ago.
    assert rows(comp.pending_sessions(missing, window, log, SMALL, now)) == [(d("2023-03-10"),), (d("2023-03-14"),)]


def test_open_day_is_not_missing(spark):
    now = F.lit("2023-03-14 10:00:00").cast("timestamp")
    table = tables(spark, WEEK[:4], [(x, 1) for x in WEEK[:4]])
    missing, window = comp.incomplete_closed_sessions(table, journal(spark, []), sessions(spark), SMALL, now, ASOF)
    assert window.last == d("2023-03-10") and missing.count() == 0


def test_dataset_declaration(spark):
    schema = "asof_date DATE, incomplete ARRAY<STRUCT<session_date: DATE, sources: ARRAY<STRING>>>"
    data = [
        (d("2023-03-06"), []),
        (d("2023-03-07"), [(d("2023-03-07"), ["dividends"])]),
        (d("2023-03-09"), [(d("2023-03-07"), ["cbr"]), (d("2023-03-09"), ["equity_d1"])]),
    ]
    got = comp.dataset_is_complete(spark.createDataFrame(data, schema), SMALL)
    assert [r.complete for r in got.orderBy("asof_date").collect()] == [True, True, False]


def test_catchup_plan_keeps_only_chosen_sources(spark):
    plan = comp.catchup_plan(sessions(spark), [BY_ID["quotes"]], d("2023-03-07"), None)
    assert [(r.session_date, r.sources, r.clamped) for r in plan.collect()][0] == (d("2023-03-07"), ["equity_d1"], False)
    assert plan.count() == 4


def test_journal_questions(spark):
    runs = [
        ("2023-03-07", "equity_d1", "ok", 5, "2023-03-07 20:00:00"),
        ("2023-03-07", "trading_calendar", "ok", 5, "2023-03-09 20:00:00"),
        ("2023-03-07", "brent", "failed", 0, "2023-03-09 21:00:00"),
        ("2023-03-07", "cbr", "ok", 0, "2023-03-09 22:00:00"),
    ]
    log = journal(spark, runs)

    def collected(at, exclude=()):
        return jr.collected_since(log, F.lit(at).cast("timestamp"), exclude).first().collected

    assert collected("2023-03-07 19:00:00") is True
    assert collected("2023-03-07 20:00:00", ["trading_calendar"]) is False
    assert collected("2023-03-07 20:00:00") is True
    unfinished = log.withColumn("finished_at", F.lit(None).cast("timestamp"))
    assert jr.collected_since(unfinished, F.lit("2030-01-01").cast("timestamp")).first().collected is True
    window = cal.window(sessions(spark), ASOF, 5)
    assert rows(jr.attempts_by_session(log, window)) == [(d("2023-03-07"), 4)]
    rolled = {r.run_id: (r.succeeded, r.unfinished_sources) for r in jr.run_rollup(log).collect()}
    assert rolled["run-0"] == (True, []) and rolled["run-2"] == (False, ["brent"])


def test_failure_streak_is_reset_by_success(spark):
    at = "2023-03-07 20:0{}:00"
    outcomes = {"a": "ffof", "b": "fff", "c": "offf", "d": "o", "e": "fso" }
    names = {"f": "failed", "o": "ok", "s": "skipped"}
    data = [("2023-03-07", source, names[x], 0, at.format(i)) for source, seq in outcomes.items() for i, x in enumerate(seq)]
    got = {r.source_id: (r.consecutive_failures, r.is_open) for r in jr.source_health(journal(spark, data), 3).collect()}
    assert got == {"a": (1, True), "b": (3, False), "c": (3, False), "d": (0, True), "e": (0, True)}


def test_gate_and_progress(spark):
    landed = sessions(spark, ["2023-03-09", "2026-08-29"])
    open_days, skipped = jr.gate(landed, sessions(spark))
    assert rows(open_days) == [(d("2023-03-09"),)]
    assert rows(skipped, "session_date", "status") == [(d("2026-08-29"), "skipped")]
    log = journal(spark, [("2023-03-06", "equity_d1", "failed", 0, "2023-03-07 20:00:00"), ("2023-03-06", "equity_d1", "ok", 0, "2023-03-07 21:00:00"), ("2023-03-07", "equity_d1", "failed", 0, "2023-03-07 21:00:00"), ("2023-03-09", "brent", "ok", 0, "2023-03-07 21:00:00")]).withColumn("run_id", F.lit("r"))
    asked = sessions(spark).withColumn("run_id", F.lit("r"))
    assert rows(jr.progress(asked, log)) == [("r", 5, 1, 1, 3)]


def test_outcome_upsert_keeps_the_first_start(spark):
    log = journal(spark, [("2023-03-06", "brent", "failed", 0, "2023-03-07 20:00:00"), ("2023-03-06", "brent", "ok", 3, "2023-03-07 21:00:00")]).withColumn("run_id", F.lit("r"))
    got = jr.upsert_outcome(log, ["started_at", "id"]).first()
    assert (got.started_at, got.status, got.rows_written, got.failure_reason) == (ts("2023-03-07 20:00:00"), "ok", 3, None)
