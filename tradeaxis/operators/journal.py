"""Questions answered from the ingest journal: one row per run and source.

Nearly all of them are partial aggregates. The only window, of failure streaks, runs over a source and a slice of
time, so a source that wrote a third of the journal does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeaxis.config import QUOTES_SOURCE
from tradeaxis.operators.calendar import SessionWindow, only_sessions
from tradeaxis.operators.dedup import latest_by

OK, FAILED, SKIPPED = "ok", "failed", "skipped"

# Fixed value: the reason written when a landed day was not traded.
NOT_A_SESSION = "не торговая сессия"


def upsert_outcome(journal: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """One row per run and source: the last outcome, with the start of the first record."""
    order = F.struct(*[F.col(a) for a in arrival])
    last = F.struct("status", "trigger", "failure_reason", "rows_written", "finished_at")
    first = F.struct("id", "session_date", "started_at")
    folded = journal.groupBy("run_id", "source_id").agg(
        F.min_by(first, order).alias("f"), F.max_by(last, order).alias("l")
    )
    return folded.select("run_id", "source_id", "f.*", "l.*")


def collected_since(
    journal: DataFrame, moment: Column, exclude_sources: Sequence[str] = ()
) -> DataFrame:
    """Whether anything was written after ``moment``.

    A run that wrote nothing changed nothing; a run that has not finished may be writing now.
    """
    wrote = (F.col("finished_at") > moment) & (F.col("rows_written") > 0)
    hit = (F.col("status") == OK) & (F.col("finished_at").isNull() | wrote)
    if exclude_sources:
        hit = hit & ~F.col("source_id").isin(list(exclude_sources))
    return journal.filter(hit).limit(1).agg((F.count("*") > 0).alias("collected"))


def sessions_with_ok_run(journal: DataFrame, window: SessionWindow, sources) -> DataFrame:
    """Sessions a source answered for, even with no rows: the exchange had none."""
    return ok_days(journal, window, sources).distinct()


def ok_days(journal: DataFrame, window: SessionWindow, sources) -> DataFrame:
    ok = (F.col("status") == OK) & F.col("source_id").isin(list(sources)) & window.contains()
    return journal.filter(ok).select("session_date")


def attempts_by_session(journal: DataFrame, window: SessionWindow) -> DataFrame:
    """Runs, not sources: one pass over a session writes a row per source."""
    runs = journal.filter(window.contains()).select("session_date", "run_id").distinct()
    return runs.groupBy("session_date").agg(F.count("run_id").alias("attempts"))


def last_attempt_by_session(journal: DataFrame, window: SessionWindow, source: str) -> DataFrame:
    """A success is an attempt too: the question is how long ago the source was asked."""
    rows = journal.filter(window.contains() & (F.col("source_id") == source))
    return rows.groupBy("session_date").agg(F.max("started_at").alias("last_attempt"))


def latest_mark(journal: DataFrame) -> DataFrame:
    return journal.agg(F.max("started_at").alias("latest_ingest_at"))


def last_success(journal: DataFrame) -> DataFrame:
    """Start of the last successful run, per source."""
    return (
        journal.filter(F.col("status") == OK)
        .groupBy("source_id")
        .agg(F.max("started_at").alias("last_success_at"))
    )


def run_rollup(journal: DataFrame) -> DataFrame:
    """A run succeeded when none of its sources failed; the failed ones are listed."""
    failed = F.when(F.col("status") == FAILED, F.col("source_id"))
    return journal.groupBy("run_id").agg(
        (F.count_if(F.col("status") == FAILED) == 0).alias("succeeded"),
        F.array_sort(F.collect_set(failed)).alias("unfinished_sources"),
    )


def latest_runs(journal: DataFrame) -> DataFrame:
    """The latest run of each session and source; equal starts are told apart by ``id``."""
    dated = journal.filter(F.col("session_date").isNotNull())
    return latest_by(dated, ["session_date", "source_id"], ["started_at", "id"])


def unfinished(journal: DataFrame, window: SessionWindow) -> DataFrame:
    """Sources whose *latest* run of a session failed: a successful retry clears the mark."""
    latest = latest_runs(journal.filter(window.contains()))
    return latest.filter(F.col("status") == FAILED).select(
        "session_date", "source_id", F.col("failure_reason").alias("reason")
    )


def runs_in_order(journal: DataFrame, session_date) -> DataFrame:
    at = journal.filter(F.col("session_date") == F.lit(session_date))
    return at.orderBy("started_at", "id")


def streak_segments(
    attempts: DataFrame,
    scope: Sequence[str],
    order: Sequence[str],
    succeeded: Column,
    failed: Column,
    part: Column | None = None,
) -> DataFrame:
    """What a slice of time says about each scope: attempts, failures at its end, whether it had a success.

    ``part`` names the slice of a row and must not fall as the order rises; by default it is the day of the
    first order column. A scope with a third of the journal is spread over as many tasks as it has slices.
    Segments of neighbouring slices can be put together in any grouping (:func:`merged_streaks`), so those of
    past days can be kept.
    """
    at = F.struct(*[F.col(o) for o in order])
    slice_ = F.to_date(order[0]) if part is None else part
    marked = attempts.select(*scope, slice_.alias("slice"), at.alias("_at"), succeeded.alias("_ok"), failed.alias("_bad"))
    own = Window.partitionBy(*scope, "slice")
    last_ok = F.max(F.when(F.col("_ok"), F.col("_at"))).over(own)
    after = F.col("_bad") & F.coalesce(F.col("_at") > F.col("_last_ok"), F.lit(True))
    return (
        marked.withColumn("_last_ok", last_ok)
        .groupBy(*scope, "slice")
        .agg(
            F.count("*").alias("attempts"),
            F.count_if(after).alias("failures_at_end"),
            F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("had_success"),
            F.min("_at").alias("first_at"),
            F.max("_at").alias("last_at"),
        )
    )


def merged_streaks(segments: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Failures since the last success, and attempts, of each scope: its slices folded from the last one back."""
    listed = F.array_sort(F.collect_list(F.struct("first_at", "attempts", "failures_at_end", "had_success")))
    per = segments.groupBy(*scope).agg(listed.alias("parts"), F.sum("attempts").alias("attempts"))
    start = F.struct(F.lit(0).cast("long").alias("failures"), F.lit(False).alias("done"))
    folded = F.aggregate(
        F.reverse("parts"),
        start,
        lambda acc, x: F.when(acc["done"], acc).otherwise(
            F.struct((acc["failures"] + x["failures_at_end"]).alias("failures"), x["had_success"].alias("done"))
        ),
        lambda acc: acc["failures"],
    )
    return per.select(*scope, folded.alias("consecutive_failures"), "attempts")


def failure_streaks(
    attempts: DataFrame,
    scope: Sequence[str],
    order: Sequence[str],
    succeeded: Column,
    failed: Column,
    part: Column | None = None,
) -> DataFrame:
    """Failures since the last success of each scope, and how many attempts there were, without a join."""
    return merged_streaks(streak_segments(attempts, scope, order, succeeded, failed, part), scope)


def source_health(journal: DataFrame, limit: int, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """Whether a source is still asked: it is not after ``limit`` failures in a row."""
    streaks = failure_streaks(
        journal,
        scope,
        ["started_at", "id"],
        F.col("status") == OK,
        F.col("status") == FAILED,
    )
    return streaks.withColumn("is_open", F.col("consecutive_failures") < limit)


def gate(landed: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landed days that were sessions, and journal rows for those that were not."""
    days = landed.select("session_date").distinct()
    keys = F.broadcast(calendar.select("session_date"))
    open_days = only_sessions(days, calendar)
    skipped = days.join(keys, "session_date", "left_anti").select(
        "session_date",
        F.lit(QUOTES_SOURCE).alias("source_id"),
        F.lit(SKIPPED).alias("status"),
        F.lit(NOT_A_SESSION).alias("failure_reason"),
    )
    return open_days, skipped


def progress(requested: DataFrame, journal: DataFrame, run_key: str = "run_id") -> DataFrame:
    """Requested, closed, failed and remaining sessions of each run.

    A session is judged by its quotes: the last quotes outcome closes it or fails it.
    """
    quotes = journal.filter(F.col("source_id") == QUOTES_SOURCE)
    outcome = latest_by(
        quotes.select(run_key, "session_date", "status", "started_at", "id"),
        [run_key, "session_date"],
        ["started_at", "id"],
    )
    state = requested.join(outcome, [run_key, "session_date"], "left")
    counted = state.groupBy(run_key).agg(
        F.count("*").alias("requested"),
        F.count_if(F.col("status").isNotNull() & (F.col("status") != FAILED)).alias("closed"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
    )
    left = F.col("requested") - F.col("closed") - F.col("failed")
    return counted.withColumn("remaining", F.greatest(left, F.lit(0)))
