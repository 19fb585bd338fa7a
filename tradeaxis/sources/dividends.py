"""Dividend events and the match of broker instruments to own tickers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.functions import parse
from tradeaxis.operators.dedup import latest_by

# Fixed value: the currency of the market covered.
MARKET_CURRENCY = "rub"


def match_instruments(
    instruments: DataFrame, tickers: DataFrame, arrival: Sequence[str]
) -> DataFrame:
    """Instruments of known tickers in the market's currency; the last of a ticker wins.

    A blank currency is allowed; a foreign one could match a stranger's ticker and is dropped.
    """
    currency = F.lower(F.trim(F.coalesce("currency", F.lit(""))))
    rows = instruments.select(
        parse.ticker("ticker").alias("ticker"),
        F.trim(F.coalesce("figi", F.lit(""))).alias("figi"),
        currency.alias("_currency"),
        *arrival,
    ).filter(
        F.col("ticker").isNotNull()
        & (F.col("figi") != "")
        & F.col("_currency").isin("", MARKET_CURRENCY)
    )
    known = rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    return latest_by(known.drop("_currency"), ["ticker"], arrival).select("ticker", "figi")


def events(responses: DataFrame) -> DataFrame:
    """Payments from broker answers: no record date, no event; no amount stays NULL."""
    return responses.filter(F.col("record_date").isNotNull()).select(
        parse.asset_id("ticker").alias("asset_id"),
        F.to_date("record_date").alias("record_date"),
        F.to_date("declared_date").alias("declared_date"),
        F.to_date("last_buy_date").alias("last_buy_date"),
        F.to_date("payment_date").alias("payment_date"),
        parse.units_nano("units", "nano").alias("value"),
    )


def for_known_assets(responses: DataFrame, matched: DataFrame) -> DataFrame:
    """Answers keyed by broker instrument, carried over to own tickers."""
    return responses.join(matched, "figi")
