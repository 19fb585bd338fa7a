"""Digests of the input of every decision date at once, by adding hashes.

Every stored cell (an observation of a series at a session) is hashed where it lies into four 32-bit numbers.
The numbers of a session are added, modulo 2^32, by partial aggregation, so what leaves the facts is a row per
part and session. A window's number is then the difference of two running sums over the calendar, and the
digests of all decision dates come from one pass over the facts. Rows may come in any order and partitioning.

A sum detects change; it does not resist somebody who chooses rows to make two sums equal. The digest of
:func:`tradeaxis.operators.dataset.digest` names a dataset, this one only says whether its content is the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeaxis.config import QUOTES_SOURCE, Settings
from tradeaxis.operators import dataset as ds
from tradeaxis.operators import journal as jr
from tradeaxis.schema import AGGREGATE_VALUES, BAR_VALUES, POSITION_VALUES
from tradeaxis.session import staged

LIMBS = ("h0", "h1", "h2", "h3")
_ROOM = 1 << 32
#: How a value that was not observed is written into a cell.
UNSEEN = "~"


def limbs(text: Column) -> list[Column]:
    """Four 32-bit numbers of a cell's text."""
    hexed = F.md5(text)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long").alias(c) for k, c in enumerate(LIMBS)]


def cell(part: str, *columns: str | Column) -> Column:
    """The text of a cell: its part, then its columns, with a sign for what is unknown."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("|", F.lit(part), *[F.coalesce(c.cast("string"), F.lit(UNSEEN)) for c in named])


def session_marks(part: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(part, session_date, cells, h0..h3)``: the sums of a part's cells per session; a row is a cell."""
    hashed = df.filter(F.col("session_date").isNotNull()).select("session_date", *limbs(cell(part, "session_date", *columns)))
    sums = [F.pmod(F.sum(c), F.lit(_ROOM)).alias(c) for c in LIMBS]
    return hashed.groupBy("session_date").agg(F.count("*").alias("cells"), *sums).select(F.lit(part).alias("part"), "session_date", "cells", *LIMBS)


def undone(calendar: DataFrame, bars: DataFrame, journal: DataFrame) -> DataFrame:
    """``(session_date, source_id)`` of every session: quotes nobody collected, and sources whose latest run failed."""
    covered = bars.select("session_date").unionByName(journal.filter((F.col("status") == jr.OK) & (F.col("source_id") == QUOTES_SOURCE)).select("session_date"))
    missing = calendar.select("session_date").join(covered.distinct(), "session_date", "left_anti").withColumn("source_id", F.lit(QUOTES_SOURCE))
    failed = jr.latest_runs(journal).filter(F.col("status") == jr.FAILED).select("session_date", "source_id")
    return missing.unionByName(failed).distinct()


def depths(settings: Settings) -> dict[str, int]:
    price = settings.price_window
    return {"aggregates": price, "global": settings.global_window, "incomplete": price, "positions": settings.positions_window, "prices": price}


def marks(tables: Mapping[str, DataFrame], calendar: DataFrame, journal: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row per part and session: what the digests of all windows are added up from.

    ``known`` are the marks of a store that differs in bars or journal alone: the other parts are taken from them.
    """
    # bars are read once: their marks tell which sessions have any
    prices = staged(session_marks("prices", tables["bar"], ["asset_id", "price_series_id", *BAR_VALUES]), "marks")
    found = [prices, session_marks("incomplete", undone(calendar, prices, journal), ["source_id"])]
    if known is None:
        found += [
            session_marks("aggregates", tables["aggregate"], ["asset_id", "price_series_id", *AGGREGATE_VALUES]),
            session_marks("global", tables["global_series"], ["series_id", "value"]),
            session_marks("positions", tables["position"], ["asset_id", *POSITION_VALUES]),
        ]
    else:
        found.append(known.filter(~F.col("part").isin("prices", "incomplete")))
    return staged(reduce(DataFrame.unionByName, found), "marks")


def window_digests(
    tables: Mapping[str, DataFrame], calendar: DataFrame, journal: DataFrame, settings: Settings, found: DataFrame | None = None
) -> DataFrame:
    """``(asof_date, window_from, bars, digest)`` for every session taken as decision date.

    ``bars`` counts the bars of the price window: with none, no dataset can be built. ``found`` are the marks of
    these tables, if they were made before.
    """
    found = marks(tables, calendar, journal) if found is None else found
    # the axis belongs to the content: each session is a cell of its own
    axis = calendar.select("session_date", *limbs(cell("axis", "session_date")))
    place = Window.orderBy("session_date")  # the calendar: a row per traded day
    numbered = calendar.select("session_date", F.row_number().over(place).alias("idx"))
    parts = []
    for part, depth in depths(settings).items():
        own = found.filter(F.col("part") == part).drop("part").withColumnsRenamed({c: f"{c}_of" for c in LIMBS})
        joined = axis.join(own, "session_date", "left")
        whole = joined.select("session_date", F.coalesce("cells", F.lit(0)).alias("cells"), *[(F.col(c) + F.coalesce(f"{c}_of", F.lit(0))).alias(c) for c in LIMBS])
        upto = place.rowsBetween(Window.unboundedPreceding, 0)
        sums = whole.select("session_date", *[F.sum(c).over(upto).alias(c) for c in ("cells", *LIMBS)])
        back = lambda c, k=depth: F.coalesce(F.lag(c, k).over(place), F.lit(0))
        first = F.min("session_date").over(place.rowsBetween(-(depth - 1), 0))
        within = sums.select(
            "session_date",
            F.lit(part).alias("part"),
            first.alias("first"),
            (F.col("cells") - back("cells")).alias("cells"),
            *[F.pmod(F.col(c) - back(c), F.lit(_ROOM)).alias(c) for c in LIMBS],
        )
        parts.append(within)
    lines = reduce(DataFrame.unionByName, parts).join(numbered, "session_date")
    line = F.concat_ws(":", "part", F.least("idx", _depth(settings)).cast("string"), F.col("first").cast("string"), *[F.col(c).cast("string") for c in ("cells", *LIMBS)])
    sectors = tables["sector"].select(*limbs(cell("sectors", "asset_id", "sector")))
    fixed = sectors.agg(F.concat_ws(":", F.lit("sectors"), F.count("*").cast("string"), *[F.coalesce(F.pmod(F.sum(c), F.lit(_ROOM)), F.lit(0)).cast("string") for c in LIMBS]).alias("x")).scalar()
    prices = F.col("part") == "prices"
    per = lines.groupBy(F.col("session_date").alias("asof_date")).agg(
        F.max(F.when(prices, F.col("first"))).alias("window_from"),
        F.max(F.when(prices, F.col("cells"))).alias("bars"),
        F.array_sort(F.collect_list(line)).alias("lines"),
    )
    text = F.concat_ws("\n", F.col("asof_date").cast("string"), F.col("lines"), fixed)
    return per.select("asof_date", "window_from", "bars", F.sha2(text, 256).alias("digest"))


def _depth(settings: Settings) -> Column:
    known = depths(settings)
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col("part")]


def staleness(runs: DataFrame, digests: DataFrame, journal: DataFrame, exclude_sources: Sequence[str] = ()) -> DataFrame:
    """``(id, stale)`` of successful runs by what they recorded: date, window, digest and when they finished.

    ``digests`` are those of today. Without a session or bars at the date nothing can be built, and the run stays
    a fact: not stale. A run is proven fresh without its digest if nothing was collected since and its window is
    the same.
    """
    now = digests.select("asof_date", F.col("window_from").alias("now_from"), F.when(F.col("bars") > 0, F.col("digest")).alias("now_digest"))
    joined = runs.join(now, "asof_date", "left")
    stale = ds.is_stale(
        ds.collected_after(journal, F.col("finished_at"), exclude_sources),
        (F.col("window_from"), F.col("window_till")),
        (F.col("now_from"), F.when(F.col("now_from").isNotNull(), F.col("asof_date"))),
        F.col("dataset_digest"),
        F.col("now_digest"),
    )
    return joined.select("id", stale.alias("stale"))
