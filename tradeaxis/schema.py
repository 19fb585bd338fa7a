"""Types and schemas of the domain tables.

NULL always means "not observed". It is never replaced by zero or by a neighbouring session.
"""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(28, 9)

BAR_VALUES = ("open", "high", "low", "close", "volume")
AGGREGATE_VALUES = ("value", "num_trades", "waprice")
POSITION_VALUES = ("fiz_long", "fiz_short", "jur_long", "jur_short")


_TYPES = {
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "PRICE": PRICE,
}


def _schema(text: str) -> T.StructType:
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SESSION = _schema("session_date DATE")
ASSET = _schema(
    "asset_id STRING, ticker STRING, first_seen_date DATE, last_seen_date DATE, lot_size INT"
)
PRICE_SERIES = _schema("price_series_id STRING, asset_id STRING, first_date DATE, last_date DATE")
BAR = _schema(
    "price_series_id STRING, asset_id STRING, session_date DATE, "
    "open PRICE, high PRICE, low PRICE, close PRICE, volume PRICE, source_revision STRING"
)
AGGREGATE = _schema(
    "price_series_id STRING, asset_id STRING, session_date DATE, "
    "value PRICE, num_trades PRICE, waprice PRICE"
)
GLOBAL_SERIES = _schema("series_id STRING, session_date DATE, value PRICE")
POSITION = _schema(
    "asset_id STRING, session_date DATE, "
    "fiz_long PRICE, fiz_short PRICE, jur_long PRICE, jur_short PRICE"
)
SECTOR = _schema("asset_id STRING, sector STRING")
DIVIDEND = _schema(
    "asset_id STRING, record_date DATE, declared_date DATE, last_buy_date DATE, "
    "payment_date DATE, value PRICE"
)
INGEST_RUN = _schema(
    "id BIGINT, run_id STRING, session_date DATE, source_id STRING, status STRING, "
    "trigger STRING, failure_reason STRING, rows_written INT, "
    "started_at TIMESTAMP, finished_at TIMESTAMP"
)
RANKING_RUN = _schema(
    "id BIGINT, asof_date DATE, dataset_digest STRING, dataset_ref STRING, model_id STRING, "
    "model_version STRING, status STRING, attempt INT, window_from DATE, window_till DATE, "
    "input_complete BOOLEAN, emulated BOOLEAN, started_at TIMESTAMP, finished_at TIMESTAMP, "
    "error_code STRING, error_message STRING, included_asset_count INT"
)
RANKING_ITEM = _schema(
    "run_id BIGINT, rank INT, asset_id STRING, price_series_id STRING, score PRICE"
)
ACCOUNT_POSITION = _schema(
    "account_id STRING, instrument_uid STRING, ticker STRING, name STRING, asset_type STRING, "
    "currency STRING, quantity PRICE, average_price PRICE, current_price PRICE, "
    "accrued_interest PRICE"
)
