"""Digests of all decision dates, staleness, and failure streaks from segments."""

import itertools

from conftest import d, dec, rows, ts
from pyspark.sql import functions as F
from test_completeness import journal, sessions
from test_dataset import DAYS, SETTINGS, full_bars, tables

from tradeaxis.operators import digests as dg
from tradeaxis.operators import journal as jr

LONG = ["2026-08-20", "2026-08-21", "2026-08-24", "2026-08-25", *DAYS]
CLOSES = [("SBER", x, 300 + i) for i, x in enumerate(LONG)]


def _digests(spark, closes=CLOSES, days=LONG, runs=(), shuffle=False, **changed):
    t = {**tables(spark, closes), **changed}
    if shuffle:
        t = {k: df.repartition(5, F.rand(1)) for k, df in t.items()}
    got = dg.window_digests(t, sessions(spark, days), journal(spark, list(runs)), SETTINGS)
    return {str(r.asof_date): r for r in got.collect()}


def _changed(a, b):
    return [x for x in sorted(a) if a[x].digest != b[x].digest]


def test_a_late_row_changes_only_the_windows_that_hold_it(spark):
    before = _digests(spark)
    assert [(str(before[x].window_from), before[x].bars) for x in LONG[:4]] == [(LONG[0], 1), (LONG[0], 2), (LONG[0], 3), (LONG[1], 3)]
    assert _changed(before, _digests(spark, [*CLOSES, ("GAZP", LONG[2], 7)])) == LONG[2:5]
    assert _changed(before, _digests(spark, [*CLOSES, ("GAZP", "2026-08-22", 7)])) == []  # no session
    assert _changed(before, _digests(spark, shuffle=True)) == []


def test_what_belongs_to_the_content(spark):
    before = _digests(spark)
    other = [("SBER", x, 300 + i if i != 1 else None) for i, x in enumerate(LONG)]
    assert _changed(before, _digests(spark, other)) == LONG[1:4]
    swapped = [("SBER", x, 300 + (i if i > 1 else 1 - i)) for i, x in enumerate(LONG)]
    assert _changed(before, _digests(spark, swapped)) == LONG[:4]  # the same values on other days
    failed = [(LONG[5], "brent", "failed", 0, "2026-08-28 10:00:00")]
    assert _changed(before, _digests(spark, runs=failed)) == LONG[5:]
    sector = spark.createDataFrame([("EQ_AST_SBER", None), ("EQ_AST_GAZP", None)], "asset_id STRING, sector STRING")
    assert _changed(before, _digests(spark, sector=sector)) == LONG
    shorter = {x: r for x, r in _digests(spark, days=LONG[1:]).items()}
    assert [x for x in LONG[1:] if shorter[x].digest != before[x].digest] == LONG[1:3]  # another axis


def test_staleness_by_content(spark):
    stored = _digests(spark)
    now = dg.window_digests(tables(spark, [*CLOSES, ("GAZP", LONG[2], 7)]), sessions(spark, LONG), journal(spark, []), SETTINGS)
    runs = [
        (1, LONG[2], stored[LONG[2]].digest, LONG[0], "2026-09-01 00:00:00"),  # changed, same window, nothing collected since
        (2, LONG[2], stored[LONG[2]].digest, LONG[0], "2026-08-01 00:00:00"),  # changed, collected since
        (3, LONG[5], stored[LONG[5]].digest, LONG[3], "2026-08-01 00:00:00"),  # late row outside its window
        (4, LONG[3], stored[LONG[3]].digest, "2026-08-19", "2026-09-01 00:00:00"),  # another window recorded
        (5, "2026-08-22", "x", None, "2026-08-01 00:00:00"),  # no session: cannot be built
        (6, LONG[3], stored[LONG[3]].digest, None, "2026-09-01 00:00:00"),  # no window recorded
    ]
    frame = spark.createDataFrame([(i, d(a), g, d(w) if w else None, d(a), ts(f)) for i, a, g, w, f in runs], "id LONG, asof_date DATE, dataset_digest STRING, window_from DATE, window_till DATE, finished_at TIMESTAMP")
    log = journal(spark, [(LONG[2], "equity_d1", "ok", 1, "2026-08-30 10:00:00")])
    got = {r.id: r.stale for r in dg.staleness(frame, now, log).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_no_facts_and_no_bars(spark):
    empty = {k: df.limit(0) for k, df in tables(spark, CLOSES).items()}
    got = dg.window_digests(empty, sessions(spark, LONG), journal(spark, []), SETTINGS).collect()
    assert len(got) == len(LONG) and all(r.bars == 0 for r in got) and len({r.digest for r in got}) == len(LONG)


def test_streak_segments_merge_in_any_cut_and_without_a_join(spark):
    codes, names = "fosff", {"f": "failed", "o": "ok", "s": "skipped"}
    outcomes = ["".join(x) for x in itertools.product("fos", repeat=4)] + [codes * 5, "f" * 12, "of" * 9]
    data = [(f"s{k}", 10 * i, i, names[x]) for k, seq in enumerate(outcomes) for i, x in enumerate(seq)]
    frame = spark.createDataFrame(data, "source_id STRING, at LONG, id LONG, status STRING")

    def expected(seq):
        tail = seq[seq.rfind("o") + 1 :]
        return tail.count("f"), len(seq)

    wanted = {f"s{k}": expected(seq) for k, seq in enumerate(outcomes)}
    for width in (10, 25, 30, 1000):
        part = F.floor(F.col("at") / width)
        found = jr.failure_streaks(frame, ["source_id"], ["at", "id"], F.col("status") == "ok", F.col("status") == "failed", part)
        assert {r.source_id: (r.consecutive_failures, r.attempts) for r in found.collect()} == wanted
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
    hot = jr.streak_segments(frame.withColumn("source_id", F.lit("one")), ["source_id"], ["at", "id"], F.col("status") == "ok", F.col("status") == "failed", F.floor(F.col("at") / 10))
    assert hot.count() == max(map(len, outcomes))  # one hot source, a task for each slice


def test_streaks_with_unknown_moments(spark):
    data = [("a", None, 1, "failed"), ("a", ts("2026-08-01 10:00:00"), 2, "failed"), ("b", None, 1, "ok"), ("b", None, 2, "failed"), ("c", ts("2026-08-02 10:00:00"), 1, "ok"), ("c", None, 9, "failed")]
    frame = spark.createDataFrame(data, "source_id STRING, started_at TIMESTAMP, id LONG, status STRING")
    got = rows(jr.source_health(frame, 2), "source_id", "consecutive_failures", "attempts", "is_open")
    assert got == [("a", 2, 2, False), ("b", 1, 2, True), ("c", 0, 2, True)]
    assert dec("1") == dec(1)


def test_digests_read_the_bars_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    t = tables(spark, CLOSES)
    counted = {**t, "bar": t["bar"].mapInPandas(passed, t["bar"].schema)}
    log = journal(spark, [(LONG[1], "brent", "failed", 1, "2026-08-30 10:00:00")])
    got = dg.window_digests(counted, sessions(spark, LONG), log, SETTINGS).collect()
    assert seen.value == t["bar"].count()
    assert sorted(got) == sorted(dg.window_digests(t, sessions(spark, LONG), log, SETTINGS).collect())
    late = {**t, "bar": tables(spark, [*CLOSES, ("GAZP", LONG[2], 7)])["bar"]}
    reused = dg.marks(late, sessions(spark, LONG), log, dg.marks(t, sessions(spark, LONG), log))
    unread = {"bar": late["bar"], "sector": late["sector"]}
    assert sorted(dg.window_digests(unread, sessions(spark, LONG), log, SETTINGS, reused).collect()) == sorted(dg.window_digests(late, sessions(spark, LONG), log, SETTINGS).collect())
