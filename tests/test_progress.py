"""Run totals from the journal stream: equal to the batch totals, with state that ends."""

from conftest import d, rows, ts

from tradeaxis.streaming import late, progress

SCHEMA = "run_id STRING, session_date DATE, source_id STRING, status STRING, started_at TIMESTAMP, id LONG, declared INT"


def _row(run, day, source, status, at, number, declared=None):
    return run, d(day), source, status, ts(at), number, declared


def test_state_ends_by_closing_and_by_silence(spark, tmp_path):
    landed, log, check = (str(tmp_path / x) for x in ("landed", "log", "check"))
    slices = [
        [
            _row("a", "2026-08-03", "equity_d1", "failed", "2026-08-10 10:00:00", 1, 2),
            _row("a", "2026-08-04", "equity_d1", "ok", "2026-08-10 10:01:00", 2, 2),
            _row("b", "2026-08-03", "equity_d1", "failed", "2026-08-10 10:02:00", 3),
            _row("b", "2026-08-04", "brent", "ok", "2026-08-10 10:03:00", 4),
            _row("c", "2026-08-03", "equity_d1", "ok", "2026-08-10 10:04:00", 5),
        ],
        [_row("a", "2026-08-03", "equity_d1", "ok", "2026-08-10 10:30:00", 6, 2), _row("c", "2026-08-04", "equity_d1", "skipped", "2026-08-10 10:31:00", 7)],
        [_row("c", "2026-08-05", "equity_d1", "failed", "2026-08-10 11:20:00", 8)],
        [_row("d", "2026-08-05", "equity_d1", "ok", "2026-08-10 13:00:00", 9, 1)],
    ]
    for part in slices:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(SCHEMA).parquet(landed)
        late.start_upserts(progress.run_totals(stream, "1 hour"), log, check, mode="update").awaitTermination()
    schema = spark.createDataFrame([], progress.TOTALS).schema
    last = late.read_upserts(spark, log, schema, ["run_id"], [])
    got = rows(last, "run_id", "requested", "closed", "failed", "remaining", "ended")
    assert got == [("a", 2, 2, 0, 0, True), ("b", 2, 0, 1, 1, True), ("c", 3, 2, 1, 0, True), ("d", 1, 1, 0, 0, True)]
    kept = spark.read.format("statestore").load(check)
    assert kept.count() == 0
