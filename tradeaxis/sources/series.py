"""Global daily series in long form: indices, currency, key rate, curve points, oil."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeaxis.functions import parse
from tradeaxis.operators.dedup import latest_by
from tradeaxis.session import local_frame

# Declared series and the security, section and column each is read from.
SERIES_SPECS = (
    ("IMOEX", "IMOEX", "stock", "index", None, "CLOSE"),
    ("RTSI", "RTSI", "stock", "index", None, "CLOSE"),
    ("RGBI", "RGBI", "stock", "index", None, "CLOSE"),
    ("RVI", "RVI", "stock", "index", None, "CLOSE"),
    ("USD_ISS", "USD000UTSTOM", "currency", "selt", "CETS", "CLOSE"),
)
OIL_SERIES_ID = "BRENT_FRONT"
KEY_RATE_SERIES_ID = "CBR_KEY_RATE"


def specs(spark: SparkSession) -> DataFrame:
    names = ("series_id", "secid", "engine", "market", "board", "value_column")
    return local_frame(spark, SERIES_SPECS, **{name: pa.string() for name in names})


def declared(rows: DataFrame, specs_df: DataFrame) -> DataFrame:
    """Rows of declared securities only, named by their series. The registry has a row per spec."""
    keyed = F.broadcast(specs_df.select("series_id", F.col("secid").alias("_security")))
    return rows.join(keyed, parse.ticker("SECID") == F.col("_security")).drop("_security")


def values_by_date(
    rows: DataFrame, date_text: str, value_text: str, arrival: Sequence[str]
) -> DataFrame:
    """Value per series and date; the last row of a date wins, an unreadable date is dropped."""
    parsed = rows.select(
        "series_id",
        parse.iso_date(date_text).alias("session_date"),
        parse.decimal_or_null(value_text).alias("value"),
        *arrival,
    ).filter("session_date IS NOT NULL")
    return latest_by(parsed, ["series_id", "session_date"], arrival).select(
        "series_id", "session_date", "value"
    )


def front_contract(rows: DataFrame, arrival: Sequence[str] = ()) -> DataFrame:
    """The unexpired contract nearest to each session; equal terms go to the smaller code.

    Of several rows of that contract the first by ``arrival`` counts.
    """
    contracts = rows.select(
        "session_date",
        F.upper(F.trim("SECID")).alias("secid"),
        parse.contract_expiry("SHORTNAME").alias("expiry"),
        parse.decimal_or_null("CLOSE").alias("close"),
        *arrival,
    ).filter("secid IS NOT NULL AND expiry >= session_date")
    front = contracts.groupBy("session_date").agg(
        F.min_by(F.struct("secid", "expiry", "close"), F.struct("expiry", "secid", *arrival)).alias("c")
    )
    return front.select("session_date", "c.secid", "c.expiry", "c.close")
