"""Sectors and index weights from index analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.functions import parse
from tradeaxis.operators.dedup import latest_by, led

# Sector indices of the exchange.
SECTOR_INDEX_IDS = (
    "MOEXOG",
    "MOEXMM",
    "MOEXFN",
    "MOEXTN",
    "MOEXEU",
    "MOEXTL",
    "MOEXCH",
    "MOEXIT",
    "MOEXCN",
    "MOEXRE",
    "MOEXINN",
)


def heaviest_index(rows: DataFrame) -> DataFrame:
    """Per ticker the index it weighs most in; then the later date, then the greater index id."""
    parsed = rows.select(
        parse.ticker("ticker").alias("ticker"),
        parse.decimal_or_null("weight").alias("weight"),
        F.coalesce(F.col("tradedate").cast("string"), F.lit("")).alias("trade_date"),
        "index_id",
    ).filter("ticker IS NOT NULL AND weight IS NOT NULL")
    return parsed.groupBy(*led(parsed, ["ticker"])).agg(
        F.max(F.struct("weight", "trade_date", "index_id")).getField("index_id").alias("index_id")
    ).select("ticker", "index_id")


def sectors(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Asset to the title of its heaviest index; a blank title gives way to the index id."""
    best = heaviest_index(rows)
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("index_id"))
    return best.join(titles, "index_id", "left").select(
        parse.asset_id("ticker").alias("asset_id"), title.alias("sector")
    )


def sectors_outcome(found: DataFrame) -> DataFrame:
    """Nothing at all from the sector indices is a failure of the source, not an empty answer."""
    return found.limit(1).agg(
        F.when(F.count("*") == 0, F.lit("failed_empty")).otherwise(F.lit("ok")).alias("outcome")
    )


def index_weights(rows: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Weights as one series per index and ticker.

    A row without a weight or of another date is no observation of the session; an unreadable date
    counts as the session asked for.
    """
    day = F.coalesce(parse.iso_date("tradedate"), F.col("session_date"))
    parsed = rows.select(
        parse.index_weight_series_id("index_id", "ticker").alias("series_id"),
        "session_date",
        day.alias("_day"),
        parse.decimal_or_null("weight").alias("value"),
        *arrival,
    ).filter("series_id IS NOT NULL AND value IS NOT NULL AND _day = session_date")
    return latest_by(parsed.drop("_day"), ["series_id", "session_date"], arrival).select(
        "series_id", "session_date", "value"
    )
