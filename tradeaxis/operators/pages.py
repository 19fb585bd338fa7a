"""Pages of a long ordered list by order statistics.

The list is cut once into ranges of its order, each a partition of files, and the ranges are counted. A page is
then located by the running count of the ranges: only the ranges it lies in are read and put in order, however
deep the page is. A cursor names the range and the place at which the next page begins, so paging on counts
nothing again and keeps its place.

The order should be total; rows equal in it share a range but may change places between two reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.session import scratch_path, staged

PART = "_range"
#: Rows of a range, about.
ROWS = 1_000_000
#: Ranges of a list whose ranges stay below ``ROWS``: each costs the driver a sample, a task and a folder.
RANGES = 512


@dataclass(frozen=True)
class Cursor:
    """Where a page begins: a range and the rows of it that come before."""

    part: int
    place: int


@dataclass(frozen=True)
class Arranged:
    """A list cut into ranges of its order, and where each range begins."""

    path: str
    schema: T.StructType
    order: tuple[Column, ...]
    starts: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.starts.sparkSession

    def at(self, offset: int) -> Cursor | None:
        """The place of a row by its number from zero; None beyond the end."""
        hit = self.starts.filter((F.col("before") <= offset) & (F.col("before") + F.col("n") > offset)).first()
        return None if hit is None else Cursor(hit[PART], offset - hit["before"])

    def page(self, start: int | Cursor | None, limit: int) -> tuple[DataFrame, Cursor | None]:
        """``limit`` rows from a number or cursor on, in order, and the cursor of the next page (None at the end)."""
        cursor = self.at(start) if isinstance(start, int) else start
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(self.path)
        if cursor is None or limit <= 0:
            return rows.limit(0).drop(PART), cursor
        first = self.starts.filter(F.col(PART) == cursor.part).first()["before"]
        till = first + cursor.place + limit
        parts = [r[0] for r in self.starts.filter((F.col(PART) >= cursor.part) & (F.col("before") < till)).select(PART).collect()]
        found = rows.filter(F.col(PART).isin(parts)).orderBy(*self.order).offset(cursor.place).limit(limit)
        return found.drop(PART), self.at(till)


def arrange(df: DataFrame, order: Sequence[Column], rows: int = ROWS, purpose: str = "pages") -> Arranged:
    """Cuts a list into ranges of about ``rows`` rows in the shared folder.

    A list that would have more than ``RANGES`` of them gets longer ones, up to ``ROWS``.
    """
    spark = df.sparkSession
    source = staged(df, purpose)
    n = source.count()
    parts = max(1, min(-(-n // rows), max(RANGES, -(-n // ROWS))))
    path = scratch_path(spark, purpose)
    cut = source.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id())
    cut.write.partitionBy(PART).parquet(path)
    counts = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(path).groupBy(PART).agg(F.count("*").alias("n"))
    # a row for every million of the list
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return Arranged(path, df.schema, tuple(order), staged(counts.select(PART, "n", before.alias("before")), "ranges"))
