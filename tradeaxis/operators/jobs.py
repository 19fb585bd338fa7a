"""Batch jobs over landed files: daily ingest, range load, catch-up and resumable history load.

A job is one Spark read, one transform and one keyed write per source, whatever number of sessions
it covers; sessions are rows, not loop turns. Sources are isolated: one that fails is journalled and
the others go on.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeaxis.config import QUOTES_SOURCE
from tradeaxis.functions import parse
from tradeaxis.operators import journal as jr
from tradeaxis.operators import store
from tradeaxis.session import discard, scratch_path, settings, staged
from tradeaxis.sources import equity, series

@dataclass(frozen=True)
class Source:
    """How the landed rows of one source become rows of one stored table."""

    source_id: str
    table: str
    build: Callable[[DataFrame], DataFrame]
    day: str | None = "session_date"  # the stored table's own day column, if it has one
    folded: bool = False  # ``build`` leaves one row per key


def _written(
    rows: DataFrame, days: DataFrame, run_id: str, source_id: str, trigger: str
) -> DataFrame:
    """A journal row per session asked for; a session without rows is answered, not failed."""
    if "session_date" in rows.columns:
        counts = rows.groupBy("session_date").agg(F.count("*").alias("rows_written"))
    else:  # a table without sessions is journalled on the last day asked for
        last = days.agg(F.max("session_date").alias("session_date"))
        counts = rows.agg(F.count("*").alias("rows_written")).join(F.broadcast(last))
    return days.join(counts, "session_date", "left").select(
        F.lit(run_id).alias("run_id"),
        F.lit(source_id).alias("source_id"),
        "session_date",
        F.lit(jr.OK).alias("status"),
        F.lit(trigger).alias("trigger"),
        F.lit(None).cast("string").alias("failure_reason"),
        F.coalesce("rows_written", F.lit(0)).cast("bigint").alias("rows_written"),
    )


def _failed(days: DataFrame, run_id: str, source_id: str, trigger: str, reason: str) -> DataFrame:
    return days.select(
        F.lit(run_id).alias("run_id"),
        F.lit(source_id).alias("source_id"),
        "session_date",
        F.lit(jr.FAILED).alias("status"),
        F.lit(trigger).alias("trigger"),
        F.lit(reason).alias("failure_reason"),
        F.lit(0).cast("bigint").alias("rows_written"),
    )


def run_source(
    spark: SparkSession,
    root: str,
    source: Source,
    landed: DataFrame,
    days: DataFrame,
    run_id: str,
    trigger: str,
    grain: str = "day",
) -> DataFrame:
    """Builds, stages and upserts one source; returns its journal rows.

    Whatever goes wrong inside is the outcome of this source alone.
    """
    path = scratch_path(spark, f"ingest-{source.source_id}")
    try:
        with settings(spark, store.SMALL_READS):
            rows = store.put(spark, root, source.table, source.build(landed), store.KEYS[source.table], grain, source.day, source.folded, path)
            return staged(_written(rows, days, run_id, source.source_id, trigger), "outcome")
    except Exception as error:  # noqa: BLE001 - the outcome is journalled, others go on
        text = str(error) or type(error).__name__
        return _failed(days, run_id, source.source_id, trigger, text)
    finally:
        discard(spark, path)


def ingest(
    spark: SparkSession,
    root: str,
    sources: Sequence[tuple[Source, DataFrame]],
    calendar: DataFrame,
    run_id: str | None = None,
    trigger: str = "daily",
    grain: str = "day",
) -> DataFrame:
    """Landed sessions of all sources into the store; one journal row per source and session.

    Days that were not traded are skipped by the gate and journalled once, for the quotes.
    """
    run_id = run_id or str(uuid.uuid4())
    outcomes = []
    for source, landed in sources:
        days, skipped = jr.gate(landed, calendar)
        inside = landed.join(F.broadcast(calendar), "session_date", "left_semi")
        outcomes.append(run_source(spark, root, source, inside, days, run_id, trigger, grain))
        if source.source_id == QUOTES_SOURCE:
            outcomes.append(
                skipped.select(
                    F.lit(run_id).alias("run_id"),
                    "source_id",
                    "session_date",
                    "status",
                    F.lit(trigger).alias("trigger"),
                    "failure_reason",
                    F.lit(0).cast("bigint").alias("rows_written"),
                )
            )
    return reduce(DataFrame.unionByName, outcomes)


def load_range(
    rows: DataFrame,
    date_from: dt.date,
    date_till: dt.date,
    specs: DataFrame,
    date_text: str,
    value_text: str,
    arrival: Sequence[str],
) -> DataFrame:
    """Period sources in one pass: the length of the period changes nothing but the row count."""
    declared = series.declared(rows, specs)
    values = series.values_by_date(declared, date_text, value_text, arrival)
    return values.filter(F.col("session_date").between(F.lit(date_from), F.lit(date_till)))


def range_outcome(values: DataFrame, date_till: dt.date, run_id: str, source_id: str) -> DataFrame:
    """A range load is journalled once, on the last day of the period."""
    return values.agg(F.count("*").alias("rows_written")).select(
        F.lit(run_id).alias("run_id"),
        F.lit(source_id).alias("source_id"),
        F.lit(date_till).alias("session_date"),
        F.lit(jr.OK).alias("status"),
        F.lit("catchup").alias("trigger"),
        F.lit(None).cast("string").alias("failure_reason"),
        "rows_written",
    )


def catch_up(
    plan: DataFrame, landed: DataFrame, fetch_log: DataFrame, arrival: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Bars of the planned sessions, and the outcome of each session.

    ``fetch_log`` says which landed sessions could not be fetched. A session is judged by its
    quotes: it is closed unless they failed, also when the exchange had nothing to say. ``plan`` is
    a list of calendar days.
    """
    failed = fetch_log.filter(
        (F.col("status") == jr.FAILED) & (F.col("source_id") == QUOTES_SOURCE)
    ).select("session_date", F.lit(True).alias("_failed"))
    planned = plan.select("session_date").join(failed.distinct(), "session_date", "left")
    usable = F.broadcast(planned.filter("_failed IS NULL").select("session_date"))
    bars = equity.bars(landed.join(usable, "session_date", "left_semi"), arrival)
    counts = bars.groupBy("session_date").agg(F.count("*").alias("rows_written"))
    outcome = planned.join(counts, "session_date", "left").select(
        "session_date",
        F.when(F.col("_failed"), F.lit("failed")).otherwise(F.lit("closed")).alias("outcome"),
        F.coalesce("rows_written", F.lit(0)).alias("rows_written"),
    )
    return bars, outcome.orderBy("session_date")


def load_history(history: DataFrame, known: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Full histories of securities not stored yet; what is stored marks what is done."""
    named = history.withColumn("_ticker", parse.ticker("SECID"))
    done = known.select(F.col("ticker").alias("_ticker")).distinct()
    fresh = named.join(done, "_ticker", "left_anti").drop("_ticker")
    return equity.history_bars(fresh, arrival)


def stored_tables(spark: SparkSession, root: str, names: Sequence[str]) -> Mapping[str, DataFrame]:
    return {name: store.read_table(spark, f"{root}/{name}") for name in names}
