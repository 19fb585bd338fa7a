"""The session axis: which days were traded, and windows counted in sessions.

A calendar is one row per traded day, so it is bounded by the days since the exchange opened
(some 13 000 since 1990). That is the only table here that is ordered in a single task or broadcast
as a whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeaxis.functions import parse
from tradeaxis.session import local_frame


@dataclass(frozen=True)
class SessionWindow:
    """The last sessions up to a decision date, ascending; never more than the depth asked for.

    A window is resolved once and then sits in the plan as literals, so it prunes partitions and
    row groups and no fact table is joined or shuffled to be cut to it.
    """

    dates: tuple[dt.date, ...]

    def __len__(self) -> int:
        return len(self.dates)

    @property
    def first(self) -> dt.date | None:
        return self.dates[0] if self.dates else None

    @property
    def last(self) -> dt.date | None:
        return self.dates[-1] if self.dates else None

    def contains(self, c: str = "session_date") -> Column:
        if not self.dates:
            return F.lit(False)
        listed = ", ".join(f"DATE'{d}'" for d in self.dates)
        return F.expr(
            f"{c} BETWEEN DATE'{self.first}' AND DATE'{self.last}' AND {c} IN ({listed})"
        )

    def axis(self, spark: SparkSession) -> DataFrame:
        """The window as rows ``(session_date, idx)``, ``idx`` from zero."""
        rows = [(day, i) for i, day in enumerate(self.dates)]
        return local_frame(spark, rows, session_date=pa.date32(), idx=pa.int32())


def sessions_from_proxy(history: DataFrame, date_text: str) -> DataFrame:
    """Traded days of a proxy security; a date that cannot be read is dropped."""
    day = parse.iso_date(date_text)
    return history.select(day.alias("session_date")).filter("session_date IS NOT NULL").distinct()


def new_sessions(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Days to append to the stored calendar."""
    return found.join(F.broadcast(stored), "session_date", "left_anti")


def window(calendar: DataFrame, asof: dt.date, depth: int) -> SessionWindow:
    """The last ``depth`` sessions not after ``asof``; shorter where history is short."""
    rows = (
        calendar.filter(F.col("session_date") <= F.lit(asof))
        .orderBy(F.desc("session_date"))
        .limit(depth)
        .collect()
    )
    return SessionWindow(tuple(sorted(r.session_date for r in rows)))


def windows(
    calendar: DataFrame, asof: dt.date, depths: Mapping[str, int]
) -> dict[str, SessionWindow]:
    """Several windows ending on one date, resolved by the deepest of them."""
    deepest = window(calendar, asof, max(depths.values())).dates if depths else ()
    return {name: SessionWindow(deepest[-depth:]) for name, depth in depths.items()}


def latest_session(calendar: DataFrame, not_after: dt.date | None = None) -> DataFrame:
    df = calendar if not_after is None else calendar.filter(F.col("session_date") <= not_after)
    return df.agg(F.max("session_date").alias("session_date"))


def next_session(calendar: DataFrame, after: dt.date) -> DataFrame:
    """The session a trade decided on ``after`` is executed in: strictly later."""
    return calendar.filter(F.col("session_date") > after).agg(
        F.min("session_date").alias("session_date")
    )


def day_map(calendar: DataFrame) -> DataFrame:
    """Every day from the first to the last session with the session at or before and after it.

    Turns both as-of lookups into an equi-join on the day.
    """
    following = F.lead("session_date").over(Window.orderBy("session_date"))
    spans = calendar.select("session_date", following.alias("following"))
    last_day = F.coalesce(F.date_sub("following", 1), F.col("session_date"))
    days = spans.withColumn("day", F.explode(F.sequence("session_date", last_day)))
    return days.select("day", F.col("session_date").alias("session_asof"), "following")


def as_of(df: DataFrame, day: str, calendar: DataFrame) -> DataFrame:
    """Adds ``session_asof`` (latest at or before) and ``session_next`` (first strictly after)."""
    ends = calendar.agg(
        F.min("session_date").alias("first"), F.max("session_date").alias("last")
    )
    first, last = ends.select("first").scalar(), ends.select("last").scalar()
    keyed = day_map(calendar).withColumnRenamed("day", "_day")
    joined = df.join(F.broadcast(keyed), F.col(day) == F.col("_day"), "left")
    return joined.select(
        *df.columns,
        F.when(F.col(day) > last, last).otherwise(F.col("session_asof")).alias("session_asof"),
        F.when(F.col(day) < first, first).otherwise(F.col("following")).alias("session_next"),
    )


def with_session_flag(df: DataFrame, calendar: DataFrame, day: str = "session_date") -> DataFrame:
    """Adds ``is_session``: whether the day was traded. The calendar has a row per traded day."""
    keys = F.broadcast(calendar.select(F.col("session_date").alias("_day"), F.lit(True).alias("_open")))
    joined = df.join(keys, F.col(day) == F.col("_day"), "left")
    return joined.withColumn("is_session", F.col("_open").isNotNull()).drop("_day", "_open")


def only_sessions(df: DataFrame, calendar: DataFrame, day: str = "session_date") -> DataFrame:
    """Rows whose day was traded."""
    keys = F.broadcast(calendar.select(F.col("session_date").alias(day)))
    return df.join(keys, day, "left_semi")


def window_bounds(calendar: DataFrame, depth: int) -> DataFrame:
    """For every session taken as decision date: where its window starts and how long it is."""
    frame = Window.orderBy("session_date").rowsBetween(-(depth - 1), 0)
    return calendar.select(
        "session_date",
        F.min("session_date").over(frame).alias("window_from"),
        F.count("session_date").over(frame).alias("window_sessions"),
    )


def data_gap(calendar: DataFrame, bars: DataFrame, today: dt.date, depth: int = 400) -> DataFrame:
    """Sessions after the last one with bars, within the last ``depth`` known sessions."""
    known = window(calendar, today, depth)
    latest = bars.filter(known.contains()).agg(F.max("session_date").alias("d")).scalar()
    axis = known.axis(calendar.sparkSession)
    behind = F.count_if(F.col("session_date") > latest)
    return axis.agg(behind.alias("gap_sessions"))


def clamp(sessions: DataFrame, date_from: dt.date | None, date_till: dt.date | None) -> DataFrame:
    """Sessions inside the asked range, each with a flag that the range reached outside them.

    ``sessions`` is a list of calendar days.
    """
    ends = sessions.agg(
        F.min("session_date").alias("lo"), F.max("session_date").alias("hi")
    )
    outside, inside = F.lit(False), F.lit(True)
    if date_from is not None:
        outside = outside | (F.lit(date_from) < ends.select("lo").scalar())
        inside = inside & (F.col("session_date") >= F.lit(date_from))
    if date_till is not None:
        outside = outside | (F.lit(date_till) > ends.select("hi").scalar())
        inside = inside & (F.col("session_date") <= F.lit(date_till))
    return sessions.filter(inside).withColumn("clamped", outside)


def withhold_open(sessions: DataFrame, now_utc: Column, cutoff: str) -> DataFrame:
    """The sessions whose cut-off time has passed at ``now_utc``."""
    return sessions.filter(parse.session_closed("session_date", now_utc, cutoff))
