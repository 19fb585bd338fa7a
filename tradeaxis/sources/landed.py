"""Landed exchange pages: one JSON block per page, unpacked into rows that keep arrival order.

A page is ``{"columns": [...], "data": [[...], ...]}``. Every row carries ``(request, page, pos)``,
because Spark keeps no row order and several rules say which of two rows wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.functions import parse
from tradeaxis.operators.dedup import latest_by

ARRIVAL = ("request", "page", "pos")

_BLOCK = T.StructType(
    [
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("data", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files, one JSON document per line: ``request, page, block``."""
    schema = T.StructType(
        [
            T.StructField("request", T.StringType()),
            T.StructField("page", T.IntegerType()),
            T.StructField("block", _BLOCK),
        ]
    )
    return spark.read.schema(schema).json(path)


def parse_pages(pages: DataFrame, body: str) -> DataFrame:
    """Pages held as text: the named column becomes ``block``."""
    rest = [c for c in pages.columns if c != body]
    return pages.select(*rest, F.from_json(F.col(body), _BLOCK).alias("block"))


def unpack(pages: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pages of all requests as rows with the declared columns, all text.

    Values are matched to names by position. A row shorter than the header has NULL for the rest,
    and values beyond the header are dropped. Concatenating pages is keeping their order columns.
    """
    keep = [c for c in pages.columns if c != "block"]
    rows = pages.select(
        *keep, F.col("block.columns").alias("_names"), F.posexplode("block.data").alias("pos", "_row")
    )

    def value(name: str):
        at = F.array_position("_names", F.lit(name)).cast("int")
        return F.when(at > 0, F.try_element_at("_row", at)).alias(name)

    return rows.select(*keep, "pos", *[value(c) for c in columns])


def open_interest(rows: DataFrame) -> DataFrame:
    """Open interest per asset code; a missing value adds nothing."""
    code = parse.ticker("ASSETCODE")
    value = F.coalesce(F.col("PREVOPENPOSITION").try_cast("bigint"), F.lit(0))
    return (
        rows.select(code.alias("asset_code"), value.alias("v"))
        .filter("asset_code IS NOT NULL")
        .groupBy("asset_code")
        .agg(F.sum("v").alias("open_interest"))
    )


def lot_sizes(rows: DataFrame, arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """Whole positive lots; an unreadable one is dropped, never taken as one."""
    parsed = rows.select(
        parse.ticker("SECID").alias("ticker"),
        F.col("LOTSIZE").try_cast("int").alias("lot_size"),
        *arrival,
    ).filter("ticker IS NOT NULL AND lot_size > 0")
    last = latest_by(parsed, ["ticker"], arrival)
    return last.select(parse.asset_id("ticker").alias("asset_id"), "ticker", "lot_size")


def index_titles(rows: DataFrame, arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """Short names of indices; a blank title stays blank."""
    parsed = rows.select(
        parse.ticker("indexid").alias("index_id"),
        F.trim(F.coalesce("shortname", F.lit(""))).alias("title"),
        *arrival,
    ).filter("index_id IS NOT NULL")
    return latest_by(parsed, ["index_id"], arrival).select("index_id", "title")
