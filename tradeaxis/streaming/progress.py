"""Progress of runs from the journal stream, with state that ends.

A run is kept as the latest quotes outcome of each of its sessions. Its state is dropped when the number of
sessions it declared are closed, or when event time has passed its last row by a given silence: the watermark is
the timer. So the state holds the runs that are under way, not all there ever were. Every change of a run gives a
row with its totals; the last one says that it ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tradeaxis.config import QUOTES_SOURCE
from tradeaxis.operators.journal import FAILED

TOTALS = "run_id string, requested long, closed long, failed long, remaining long, last_at timestamp, ended boolean"
_STATE = "sessions string, last_ms long, declared long"


def _totals(run: str, sessions: dict, last_ms: int, ended: bool) -> pd.DataFrame:
    outcomes = [x[2] for x in sessions.values() if x]
    failed = sum(o == FAILED for o in outcomes)
    row = (run, len(sessions), len(outcomes) - failed, failed, len(sessions) - len(outcomes), pd.Timestamp(last_ms, unit="ms"), ended)
    return pd.DataFrame([row], columns=["run_id", "requested", "closed", "failed", "remaining", "last_at", "ended"])


def run_totals(journal_stream: DataFrame, silence: str, delay: str = "0 seconds", run_key: str = "run_id") -> DataFrame:
    """Totals of each run as its journal rows stream in (update mode).

    Rows are ``run_id, session_date, source_id, status, started_at, id`` and perhaps ``declared``, the number of
    sessions the run was asked for. Every row's session counts as requested; quotes rows close or fail it, the
    later one wins. A row that comes after its run has ended begins the run anew.
    """
    silence_ms = int(pd.Timedelta(silence).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored, last_ms, declared = state.get if state.exists else ("{}", 0, 0)
        sessions = json.loads(stored)
        if state.hasTimedOut:
            state.remove()
            yield _totals(key[0], sessions, last_ms, True)
            return
        for frame in frames:
            for day, source, status, at, number, asked in zip(frame["day"], frame["source_id"], frame["status"], frame["ms"], frame["id"], frame["declared"], strict=True):
                last_ms, declared = max(last_ms, int(at)), max(declared, int(asked))
                known = sessions.setdefault(day, None)
                if source == QUOTES_SOURCE and (known is None or [int(at), int(number)] > known[:2]):
                    sessions[day] = [int(at), int(number), status]
        closed = sum(1 for x in sessions.values() if x and x[2] != FAILED)
        if declared and closed >= declared:
            if state.exists:
                state.remove()
            yield _totals(key[0], sessions, last_ms, True)
            return
        state.update((json.dumps(sessions), last_ms, declared))
        state.setTimeoutTimestamp(max(last_ms + silence_ms, state.getCurrentWatermarkMs() + 1))
        yield _totals(key[0], sessions, last_ms, False)

    declared = F.col("declared") if "declared" in journal_stream.columns else F.lit(0)
    rows = journal_stream.withWatermark("started_at", delay).select(
        F.col(run_key).alias("run_id"),
        F.col("session_date").cast("string").alias("day"),
        "source_id",
        "status",
        F.unix_millis("started_at").alias("ms"),
        F.col("id").cast("long").alias("id"),
        F.coalesce(declared.cast("long"), F.lit(0)).alias("declared"),
        "started_at",
    )
    return rows.groupBy("run_id").applyInPandasWithState(step, TOTALS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
