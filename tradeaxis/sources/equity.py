"""Daily quotes and trade aggregates of shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tradeaxis.functions import parse
from tradeaxis.operators.dedup import earliest_by, latest_by
from tradeaxis.operators.store import with_fingerprint

# Columns asked from the exchange, and the stored names they become.
BAR_COLUMNS = {"OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close", "VOLUME": "volume"}
AGGREGATE_COLUMNS = {"VALUE": "value", "NUMTRADES": "num_trades", "WAPRICE": "waprice"}
QUOTE_REQUEST = ("SECID", "TRADEDATE", *BAR_COLUMNS)
AGGREGATE_REQUEST = ("SECID", "TRADEDATE", *AGGREGATE_COLUMNS)


def _typed(rows: DataFrame, names: dict[str, str], arrival: Sequence[str]) -> DataFrame:
    return rows.select(
        "session_date",
        parse.ticker("SECID").alias("ticker"),
        *[parse.decimal_or_null(raw).alias(name) for raw, name in names.items()],
        *arrival,
    ).filter("ticker IS NOT NULL")


def _identified(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    return rows.select(
        parse.price_series_id("ticker").alias("price_series_id"),
        parse.asset_id("ticker").alias("asset_id"),
        "session_date",
        *values,
    )


def bars(rows: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Quotes of a session: the first row of a ticker wins, a row without prices stays."""
    first = earliest_by(_typed(rows, BAR_COLUMNS, arrival), ["session_date", "ticker"], arrival)
    return with_fingerprint(_identified(first, list(BAR_COLUMNS.values())))


def aggregates(rows: DataFrame, arrival: Sequence[str]) -> DataFrame:
    first = earliest_by(
        _typed(rows, AGGREGATE_COLUMNS, arrival), ["session_date", "ticker"], arrival
    )
    return _identified(first, list(AGGREGATE_COLUMNS.values()))


def history_bars(rows: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """History of single securities: the last row of a date wins, undated rows are dropped."""
    dated = rows.withColumn("session_date", parse.iso_date("TRADEDATE"))
    typed = _typed(dated, BAR_COLUMNS, arrival).filter("session_date IS NOT NULL")
    last = latest_by(typed, ["ticker", "session_date"], arrival)
    return with_fingerprint(_identified(last, list(BAR_COLUMNS.values())))
