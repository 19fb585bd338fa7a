"""Values held in landed HTML pages.

Markup is the one input without a built-in reader, so pages go through ``mapInPandas`` in Arrow
batches, page by page, and come out as text cells. Everything after the cells (dates, numbers,
series names, which page failed) is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.functions import parse
from tradeaxis.operators.dedup import latest_by
from tradeaxis.sources.series import KEY_RATE_SERIES_ID

# Curve terms in column order, the caption of the wanted row, markup classes.
CURVE_TERMS = (
    "yield_0_25y",
    "yield_0_5y",
    "yield_0_75y",
    "yield_1y",
    "yield_2y",
    "yield_3y",
    "yield_5y",
    "yield_7y",
    "yield_10y",
    "yield_15y",
    "yield_20y",
    "yield_30y",
)
POSITION_TITLE = "количество договоров"
RATE_TABLE = ("data",)
CURVE_WRAPPER = "table-wrapper"
POSITION_TABLE = ("table1", "_full-width")
CAPTION_CLASS = "text-center"

_OBSERVATION = ["page_id", "series_id", "session_date"]
#: Table rows that a task holds before it hands them on.
_HELD_ROWS = 2_000
_CELLS = "page_id STRING, found BOOLEAN, caption STRING, row INT, cells ARRAY<STRING>"


class _TableReader(HTMLParser):
    """Collects ``td`` texts of the first wanted table, and the first caption span."""

    def __init__(self, table_classes: tuple[str, ...], wrapper: str | None) -> None:
        super().__init__()
        self.want, self.wrapper = set(table_classes), wrapper
        self.rows: list[list[str]] = []
        self.caption: str | None = None
        self.found = False
        self._stack: list[str] = []
        self._wrapped_at: int | None = None if wrapper else 0
        self._table_at: int | None = None
        self._cell: list[str] | None = None
        self._span: list[str] | None = None
        self._span_at = 0

    def handle_starttag(self, tag, attrs):
        classes = set((dict(attrs).get("class") or "").split())
        if tag in ("br", "img", "input", "hr", "meta", "link"):
            return
        self._stack.append(tag)
        depth = len(self._stack)
        if self._wrapped_at is None and self.wrapper in classes:
            self._wrapped_at = depth
        if tag == "table" and not self.found and self._wrapped_at is not None:
            if self.want <= classes:
                self.found, self._table_at = True, depth
        if self._table_at is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag == "td":
                self._cell = []
        if tag == "span" and self.caption is None and CAPTION_CLASS in classes:
            self._span, self._span_at = [], depth

    def handle_endtag(self, tag):
        if tag not in self._stack:
            return
        while self._stack:
            depth, last = len(self._stack), self._stack.pop()
            if last == "td" and self._cell is not None:
                if self.rows:
                    self.rows[-1].append(" ".join(self._cell).strip())
                self._cell = None
            if self._span is not None and depth == self._span_at:
                self.caption, self._span = " ".join(self._span).strip(), None
            if depth == self._table_at:
                self._table_at = None
            if last == tag:
                break

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        if self._cell is not None:
            self._cell.append(text)
        if self._span is not None:
            self._span.append(text)


def _cells(pages: DataFrame, table_classes: tuple[str, ...], wrapper: str | None) -> DataFrame:
    """One row per table row; a page without the table gives one row with ``found = false``."""

    names, most = ["page_id", "found", "caption", "row", "cells"], _HELD_ROWS

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                reader = _TableReader(table_classes, wrapper)
                reader.feed(html or "")
                reader.close()
                rows = [r for r in reader.rows if r] or [None]
                out += [(page_id, reader.found, reader.caption, i, r) for i, r in enumerate(rows)]
                if len(out) >= most:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return pages.select(F.col("page_id").cast("string"), "html").mapInPandas(read, _CELLS)


def _sized(cells: DataFrame, n: int) -> DataFrame:
    return cells.filter(F.col("found") & (F.size("cells") == n))


def rate_values(pages: DataFrame) -> DataFrame:
    """Key-rate pages: rows of exactly two cells; the last row of a date on a page counts."""
    day = parse.dotted_date(F.col("cells")[0])
    rows = _sized(_cells(pages, RATE_TABLE, None), 2).select(
        "page_id",
        F.lit(KEY_RATE_SERIES_ID).alias("series_id"),
        day.alias("session_date"),
        parse.local_decimal(F.col("cells")[1]).alias("value"),
        "row",
    )
    return latest_by(rows.filter("session_date IS NOT NULL"), _OBSERVATION, ["row"])


def curve_values(pages: DataFrame) -> DataFrame:
    """Curve pages: a date and twelve terms taken by position, never by header text."""
    terms = F.array(*[F.lit(t) for t in CURVE_TERMS])
    rows = _sized(_cells(pages, (), CURVE_WRAPPER), 1 + len(CURVE_TERMS)).select(
        "page_id",
        parse.dotted_date(F.col("cells")[0]).alias("session_date"),
        F.posexplode(F.slice("cells", 2, len(CURVE_TERMS))).alias("at", "text"),
        "row",
    )
    values = rows.filter("session_date IS NOT NULL").select(
        "page_id",
        parse.curve_series_id(F.get(terms, F.col("at"))).alias("series_id"),
        "session_date",
        parse.local_decimal("text").alias("value"),
        "row",
    )
    return latest_by(values, _OBSERVATION, ["row"])


def position_values(pages: DataFrame) -> DataFrame:
    """Position pages: the row found by its caption, four values, and the page's own trade date."""
    title = F.lower(F.regexp_replace(F.col("cells")[0], r"\s+", " "))
    rows = _sized(_cells(pages, POSITION_TABLE, None), 6).filter(title.startswith(POSITION_TITLE))
    legs = ("fiz_long", "fiz_short", "jur_long", "jur_short")
    values = [parse.local_decimal(F.col("cells")[i + 1], minus=True).alias(n) for i, n in enumerate(legs)]
    first = rows.groupBy("page_id").agg(
        F.min_by(F.struct("caption", "cells"), "row").alias("r")
    )
    return (
        first.select("page_id", "r.caption", "r.cells")
        .select("page_id", parse.date_in_text("caption").alias("trade_date"), *values)
        .filter("trade_date IS NOT NULL")
    )


def failed_rate_pages(pages: DataFrame) -> DataFrame:
    """Pages without the rate table; a table without a rate is an answer, and empty."""
    cells = _cells(pages, RATE_TABLE, None)
    return cells.filter(~F.col("found")).select("page_id").distinct()


def failed_pages(pages: DataFrame, values: DataFrame) -> DataFrame:
    """Pages that brought nothing: no table, or no row of the expected shape."""
    ids = pages.select(F.col("page_id").cast("string").alias("page_id"))
    return ids.join(values.select("page_id").distinct(), "page_id", "left_anti")


def of_requested_date(snapshots: DataFrame, requested: str = "session_date") -> DataFrame:
    """An answer about another date is no data, not an observation of the date asked for."""
    return snapshots.filter(F.col("trade_date") == F.col(requested))
