"""As-of lookups for many keys and days at once: a merge of observations and requests, cut by range.

Observations and requests are put in one order of key and day, and cut into ranges of about equal size. Inside a
range the last observation is carried to the requests after it. What a range carries out, the last observation of
each of its keys, goes to the requests that lead the next range of the same key. So a key with a third of all
rows is spread over many ranges, and no window ever holds more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeaxis.session import staged

RANGE = "_range"
#: Rows of a range, about.
ROWS = 1_000_000


def last_known(observed: DataFrame, requests: DataFrame, key: str, day: str, values: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Every request ``(key, day, ...)`` with the last observation of its key at or before its day.

    ``observed`` has one row per key and day. The observation keeps its own day, as ``observed_{day}``; a request
    with none before it has NULLs. A request without a key or day has NULLs too.
    """
    carried = F.struct(F.col(day).alias("day"), *values)
    kinds = requests.schema
    own = [c for c in requests.columns]
    some = observed.filter(F.col(key).isNotNull() & F.col(day).isNotNull())
    left = some.select(F.col(key).alias("k"), F.col(day).alias("d"), F.lit(0).alias("kind"), carried.alias("seen"), F.lit(None).cast(kinds).alias("asked"))
    right = requests.select(F.col(key).alias("k"), F.col(day).alias("d"), F.lit(1).alias("kind"), F.lit(None).cast(left.schema["seen"].dataType).alias("seen"), F.struct(*own).alias("asked"))
    both = staged(left.unionByName(right), "merge")
    parts = max(1, -(-both.count() // rows))
    cut = staged(both.repartitionByRange(parts, "k", "d", "kind").withColumn(RANGE, F.spark_partition_id()), "cut")
    upto = Window.partitionBy(RANGE, "k").orderBy("d", "kind").rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumn("seen", F.last("seen", ignorenulls=True).over(upto)).filter("kind = 1")
    # a row for each key of a range; only keys that several ranges share have more than one
    out = cut.filter("kind = 0").groupBy("k", RANGE).agg(F.max_by("seen", "d").alias("out"))
    spans = cut.groupBy("k", RANGE).agg(F.lit(1).alias("one")).drop("one").join(out, ["k", RANGE], "left")
    earlier = Window.partitionBy("k").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    into = spans.select("k", RANGE, F.last("out", ignorenulls=True).over(earlier).alias("into")).filter("into is not null")
    joined = within.join(into, ["k", RANGE], "left").withColumn("seen", F.when(F.col("d").isNotNull(), F.coalesce("seen", "into")))
    return joined.select("asked.*", F.col("seen.day").alias(f"observed_{day}"), *[F.col(f"seen.{v}").alias(v) for v in values])
