"""Ingest of all sources in one routed pass, catch-up over the same routes, and resumable history.

What landed lies in one table: the source, the session it was asked for, and the record as JSON. It is read once
and written by source, so that each source then reads its own rows, whatever the number of sources and sessions.
Where every source has a table of its own, each lands when its turn comes and is gone when its routes are through;
one whose sessions stand for themselves does so a batch of sessions after the other, so that what lies beside the
store is as long as a batch, not as the source.
A route says how the records of a source are typed and become rows of a stored table. Sources are isolated: one
that fails is journalled and the others go on. Assets and price series are registered with the quotes, before
anything is laid over them.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.config import QUOTES_SOURCE
from tradeaxis.operators import jobs, store
from tradeaxis.operators import journal as jr
from tradeaxis.operators.calendar import only_sessions
from tradeaxis.session import SHORT_SHUFFLES, discard, scratch_path, settings, staged, staged_at

JOURNAL = "ingest_run"
#: Registries that quotes fill: key and the column carried beside it.
REGISTRIES = {"asset": ("asset_id", "ticker"), "price_series": ("price_series_id", "asset_id")}
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
#: Bytes of a row group of what landed, as long as what a task reads of it.
_GROUP = 16 << 20
#: Landed rows of a batch of sessions. A source that has more in so many batches has longer ones: each reads it again.
_BATCH_ROWS, _BATCHES = 3_000_000, 8
LANDED = "source_id string, session_date date, record string"


@dataclass(frozen=True)
class Route:
    """How the landed records of a source become rows of a stored table.

    ``fields`` is the schema of a record. ``build`` gets typed rows with their ``session_date``; it may join
    what is stored already, read from ``root``. ``gated`` sources are asked for sessions only; the others bring
    tables or responses of their own and are journalled on the last day asked for. ``day`` is the stored table's
    own day column, if it has one. ``folded`` says that ``build`` leaves one row per key of the table.
    ``reads`` names the source whose answers these are, if another's answers hold this one's values too.
    ``by_session`` says that ``build`` makes the rows of a session, its own day, from what landed for that session
    alone, so that sessions may come in batches.
    """

    source_id: str
    table: str
    fields: str | T.StructType
    build: Callable[[DataFrame], DataFrame]
    gated: bool = True
    day: str | None = "session_date"
    folded: bool = False
    reads: str | None = None
    by_session: bool = False

    @property
    def landed_as(self) -> str:
        return self.reads or self.source_id


@dataclass(frozen=True)
class Batch:
    """Days after the one and up to the other, as numbers; an open end has none. Rows without a day are in the first.

    ``parts`` are the partitions of a stored table that the landed days belong to, if they were looked up.
    """

    after: int | None = None
    upto: int | None = None
    parts: tuple[str, ...] | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        day = F.unix_date("session_date")
        if self.after is not None:
            rows = rows.filter(day > self.after)
        return rows if self.upto is None else rows.filter((day <= self.upto) | day.isNull() if self.after is None else day <= self.upto)


def batches(landed_rows: DataFrame, grain: str) -> list[Batch]:
    """Sessions of one source in ascending batches of whole partitions, dealt evenly by the rows that landed for them.

    A partition is in one batch, however many rows it has. Only counts by partition reach the driver.
    """
    last = F.last_day("session_date") if grain == "month" else F.col("session_date")
    found = landed_rows.filter("session_date is not null").groupBy(F.unix_date(last).alias("upto"), store.part_of("session_date", grain).alias("part"))
    counted = found.count().orderBy("upto").collect()
    total = sum(r["count"] for r in counted)
    number = max(1, min(_BATCHES, -(-total // _BATCH_ROWS)))
    dealt, held, last = [[]], 0, 0
    for row in counted:
        if (at := held * number // total) > last:
            dealt.append([])
            last = at
        dealt[-1].append(row)
        held += row["count"]
    ends = [None, *[rows[-1]["upto"] for rows in dealt[:-1]], None]
    return [Batch(ends[i], ends[i + 1], tuple(r["part"] for r in rows)) for i, rows in enumerate(dealt)]


def landed(source_id: str, rows: DataFrame, day: str | None = "session_date") -> DataFrame:
    """Typed rows as they land: every other column goes into the record."""
    at = F.lit(None).cast("date") if day is None else F.col(day)
    record = F.to_json(F.struct(*[c for c in rows.columns if c != day]))
    return rows.select(F.lit(source_id).alias("source_id"), at.alias("session_date"), record.alias("record"))


def by_source(landed_rows: DataFrame) -> str:
    """Writes what landed once, by source; returns the folder.

    Nothing is shuffled or sorted: a task has a file open for each source that it meets.
    """
    spark = landed_rows.sparkSession
    path = scratch_path(spark, "landed")
    with settings(spark, {_OPEN_FILES: "64"}):
        landed_rows.write.option("compression", "zstd").option("parquet.block.size", _GROUP).partitionBy("source_id").parquet(path)
    return path


def _arrived(spark: SparkSession, path: str, route: Route) -> DataFrame:
    return spark.read.schema(LANDED).parquet(path).filter(F.col("source_id") == route.landed_as)


def _parsed(route: Route) -> Column:
    return F.from_json("record", route.fields, {"mode": "PERMISSIVE"})


def records(spark: SparkSession, path: str, route: Route) -> DataFrame:
    """The typed rows of one source; a record that cannot be read is none.

    The text is read where it is exploded, once: filters are not carried below that, where each would read it again.
    """
    found = _arrived(spark, path, route).select("session_date", F.explode(F.array_compact(F.array(_parsed(route)))).alias("r"))
    return found.select("session_date", "r.*")


def landed_days(spark: SparkSession, path: str, route: Route) -> DataFrame:
    """The days that records came for. What begins as an object is a record, also a broken one; other texts are read."""
    some = F.col("record").startswith("{") | _parsed(route).isNotNull()
    return _arrived(spark, path, route).filter(some).select("session_date").distinct()


def _register(spark: SparkSession, root: str, bars: DataFrame) -> None:
    """Assets and price series of new quotes, with the days they were first and last seen.

    Of the quotes of a series only the first and the last day say anything, so the quotes are read once.
    """
    copy = scratch_path(spark, "registry")
    ends = bars.groupBy("price_series_id", "asset_id").agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    ends = staged_at(ends, copy).withColumn("session_date", F.explode(F.array("a", "b")))
    seen = {
        "asset": ends.select("asset_id", F.expr("substr(asset_id, 8)").alias("ticker"), "session_date"),
        "price_series": ends.select("price_series_id", "asset_id", "session_date"),
    }
    for name, (key, carried) in REGISTRIES.items():
        path = f"{root}/{name}"
        incoming = seen[name].withColumn("seq", F.col("session_date"))
        if store.exists(spark, path):
            stored = store.read_table(spark, path)
        else:
            stored = incoming.limit(0).select(key, carried, F.col("session_date").alias("first_seen"), F.col("session_date").alias("last_seen"))
        merged = store.upsert_seen(stored, incoming, key, ["seq"], [carried])
        rows = merged.select(key, carried, "first_seen", "last_seen")
        if name == "asset":  # lots are another source's and stay
            lots = stored.select(key, "lot_size") if "lot_size" in stored.columns else stored.select(key, F.lit(None).cast("int").alias("lot_size"))
            rows = rows.join(lots, key, "left")
        _replace(spark, path, rows, [key])
    discard(spark, copy)


def _replace(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> None:
    """Rows of a table without days, all that it is to hold; staged first, as they are made from what is stored."""
    copy = scratch_path(spark, "registry")
    store.merge_into(spark, path, staged_at(rows, copy).withColumn("_seq", F.lit(1)), keys, ["_seq"], day=None, fresh=True)
    discard(spark, copy)


def _lots(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """New lots of known assets, as whole rows of the asset table."""
    assets = store.read_table(spark, f"{root}/asset")
    return store.update_lots(assets, found).join(found.select("asset_id"), "asset_id", "left_semi")


KEYS = {**store.KEYS, "asset": ("asset_id",)}


def _run(spark: SparkSession, root: str, route: Route, rows: DataFrame, days: DataFrame, run_id: str, trigger: str, grain: str, parts: Sequence[str] | None) -> DataFrame:
    path = scratch_path(spark, f"ingest-{route.source_id}")
    try:
        built = route.build(rows)
        if route.table == "asset":
            built = _lots(spark, root, built)
        built = store.put(spark, root, route.table, built, KEYS[route.table], grain, route.day, route.folded, path, parts)
        if route.source_id == QUOTES_SOURCE:
            _register(spark, root, built)
        counted = built if route.gated else built.drop("session_date")
        return staged(jobs._written(counted, days if route.gated else days.agg(F.max("session_date").alias("session_date")), run_id, route.source_id, trigger), "outcome")
    except Exception as error:  # noqa: BLE001 - the outcome is journalled, others go on
        text = str(error) or type(error).__name__
        return jobs._failed(days, run_id, route.source_id, trigger, text)
    finally:
        discard(spark, path)


def ingest_all(
    spark: SparkSession,
    root: str,
    landed_rows: DataFrame | Mapping[str, DataFrame],
    routes: Sequence[Route],
    calendar: DataFrame,
    run_id: str | None = None,
    trigger: str = "daily",
    grain: str = "day",
    unreachable: DataFrame | None = None,
) -> DataFrame:
    """All landed records into the store, and the journal of the run beside it; returns the journal rows.

    Days that were not traded are skipped by the gate and journalled once, for the quotes. ``unreachable`` lists
    ``(source_id, session_date, reason)`` that could not be fetched: they are journalled as failed and bring
    nothing. Routes run in the order given, quotes first, as their registry is what the others refer to.
    ``landed_rows`` that are given by source land one source after the other, and a source whose routes are all by
    session one batch of sessions after the other; one that is not among them has landed nothing. A batch that fails
    is journalled by itself.
    """
    run_id = run_id or str(uuid.uuid4())
    routes = sorted(routes, key=lambda r: r.source_id != QUOTES_SOURCE)
    with settings(spark, {**store.SMALL_READS, **SHORT_SHUFFLES}):
        calendar = staged(calendar.select("session_date"), "calendar")
        whole = isinstance(landed_rows, DataFrame)
        served = _in_one(spark, landed_rows, routes) if whole else _by_turns(spark, landed_rows, routes, grain)
        outcomes, came = [], {}
        for route, batch, path in served:
            if route.gated and (path, route.landed_as) not in came:
                came[path, route.landed_as] = staged(landed_days(spark, path, route), "came")
            outcomes += _routed(spark, root, path, route, batch, came.get((path, route.landed_as)), calendar, run_id, trigger, grain, unreachable)
        journal = staged(reduce(DataFrame.unionByName, outcomes), "journal")
    journal.withColumn("run", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{root}/{JOURNAL}")
    return journal


Served = Iterator[tuple[Route, Batch, str]]


def _in_one(spark: SparkSession, landed_rows: DataFrame, routes: Sequence[Route]) -> Served:
    """Routes over one folder; what a source landed goes when its last route is through."""
    left = Counter(r.landed_as for r in routes)
    path = by_source(landed_rows.filter(F.col("source_id").isin(sorted(left))))
    for route in routes:
        yield route, Batch(), path
        left[route.landed_as] -= 1
        if not left[route.landed_as]:
            discard(spark, f"{path}/source_id={route.landed_as}")
    discard(spark, path)


def _by_turns(spark: SparkSession, landed_rows: Mapping[str, DataFrame], routes: Sequence[Route], grain: str) -> Served:
    """Routes over folders of their own, each of which goes before the next lands."""
    for source_id, group in groupby(routes, key=lambda r: r.landed_as):
        sharing = list(group)
        rows = landed_rows[source_id] if source_id in landed_rows else spark.createDataFrame([], LANDED)
        rows = rows.filter(F.col("source_id") == source_id)
        for batch in batches(rows, grain) if all(r.gated and r.by_session for r in sharing) else [Batch()]:
            path = by_source(batch.of(rows))
            for route in sharing:
                yield route, batch, path
            discard(spark, path)


def _routed(
    spark: SparkSession,
    root: str,
    path: str,
    route: Route,
    batch: Batch,
    came: DataFrame | None,
    calendar: DataFrame,
    run_id: str,
    trigger: str,
    grain: str,
    unreachable: DataFrame | None,
) -> list[DataFrame]:
    """Journal rows of a route that has read what landed for it; ``came`` are the days of a gated one."""
    outcomes = []
    rows = records(spark, path, route)
    down = None if unreachable is None else batch.of(unreachable.filter(F.col("source_id") == route.source_id)).select("session_date", "reason").distinct()
    if route.gated:
        days, skipped = jr.gate(came, calendar)
        rows = only_sessions(rows, calendar)
        if down is not None:
            open_down = only_sessions(down, calendar)
            days = days.join(F.broadcast(open_down.select("session_date")), "session_date", "left_anti")
            rows = rows.join(F.broadcast(open_down.select("session_date")), "session_date", "left_anti")
            failed = jobs._failed(open_down, run_id, route.source_id, trigger, "").drop("failure_reason")
            outcomes.append(failed.join(open_down, "session_date").withColumnRenamed("reason", "failure_reason").select(*_COLUMNS))
        if route.source_id == QUOTES_SOURCE:
            counted = skipped.withColumns({"run_id": F.lit(run_id), "trigger": F.lit(trigger), "rows_written": F.lit(0).cast("bigint")})
            outcomes.append(counted.select(*_COLUMNS))
    else:
        days = calendar.select("session_date")
    outcomes.append(_run(spark, root, route, rows, days, run_id, trigger, grain, batch.parts).select(*_COLUMNS))
    return outcomes


_COLUMNS = ("run_id", "source_id", "session_date", "status", "trigger", "failure_reason", "rows_written")


def stored_journal(spark: SparkSession, root: str) -> DataFrame:
    """Journal rows of all runs; a run that is repeated replaces its own."""
    return spark.read.parquet(f"{root}/{JOURNAL}").drop("run")


def catch_up(
    spark: SparkSession,
    root: str,
    plan: DataFrame,
    landed_rows: DataFrame | Mapping[str, DataFrame],
    routes: Sequence[Route],
    run_id: str,
    unreachable: DataFrame | None = None,
    grain: str = "day",
) -> DataFrame:
    """Stores and journals every source for the planned sessions; returns the outcome per session.

    A session is judged by its quotes: closed unless they failed, also when the exchange had nothing to say.
    Records of other sessions are left alone.
    """
    gated = {r.landed_as for r in routes if r.gated}

    def asked(rows: DataFrame) -> DataFrame:
        planned = rows.join(F.broadcast(plan.select("session_date")), "session_date", "left_semi")
        free = rows.filter(~F.col("source_id").isin(sorted(gated)))
        return planned.filter(F.col("source_id").isin(sorted(gated))).unionByName(free)

    both = asked(landed_rows) if isinstance(landed_rows, DataFrame) else {name: asked(rows) for name, rows in landed_rows.items()}
    journal = ingest_all(spark, root, both, routes, plan, run_id, "catchup", grain, unreachable)
    quotes = journal.filter(F.col("source_id") == QUOTES_SOURCE).select("session_date", "status", "rows_written")
    judged = plan.select("session_date").join(quotes, "session_date", "left")
    return judged.select(
        "session_date",
        F.when(F.col("status") == jr.FAILED, F.lit("failed")).otherwise(F.lit("closed")).alias("outcome"),
        F.coalesce("rows_written", F.lit(0)).cast("bigint").alias("rows_written"),
    )


DONE = "history_done"


def load_history(spark: SparkSession, root: str, history: DataFrame, arrival: Sequence[str], grain: str = "month") -> DataFrame:
    """Full histories of the securities that have none yet, written to the store; returns the tickers loaded now.

    A ticker is marked as done after its bars are stored. A run that is lost in between is simply repeated:
    the same bars are laid over themselves, and what is marked is not loaded again.
    """
    marks = f"{root}/{DONE}"
    known = spark.read.parquet(marks) if store.exists(spark, marks) else spark.createDataFrame([], "ticker string")
    path = scratch_path(spark, "history")
    with settings(spark, store.SMALL_READS):
        bars = store.put(spark, root, "bar", jobs.load_history(history, known, arrival), store.KEYS["bar"], grain, "session_date", True, path)
    _register(spark, root, bars)
    now = staged(bars.select(F.expr("substr(asset_id, 8)").alias("ticker")).distinct(), "loaded")
    discard(spark, path)
    now.write.mode("append").parquet(marks)
    return now

