"""Coverage that is kept up to date: counts per session beside the stored tables, and rollups that merge.

A merge changes the sessions it touches and no others. Their counts are taken from the merged partitions and
replace those that were kept, so rows that a merge empties are taken back as well. A report then reads a row per
group and session instead of the facts.

Rollups are kept at their finest grain with a sketch of the assets seen. Coarser groupings add the counts and
unite the sketches; the distinct assets they estimate are within :data:`SKETCH_ERROR` of the exact count in 99 of 100
cases, which can be had on demand from the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeaxis.config import SourceGroup
from tradeaxis.functions import money
from tradeaxis.operators import store
from tradeaxis.operators.calendar import SessionWindow
from tradeaxis.session import discard, scratch_path, staged_at

#: Logarithm of the sketch's registers, and three standard errors of it (1.04 / sqrt(2 ^ 14), rounded up).
SKETCH_SIZE, SKETCH_ERROR = 14, 0.025
COUNTS = "group_id string, session_date date, n long, v long"


def session_counts(group: SourceGroup, rows: DataFrame) -> DataFrame:
    """``(group_id, session_date, n, v)``: rows and rows with a value per session."""
    has_value = store.filled(group.value_columns)
    day = group.session_column
    per = rows.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("session_date")).agg(F.count("*").alias("n"), F.count_if(has_value).alias("v"))
    return per.select(F.lit(group.group_id).alias("group_id"), "session_date", "n", "v")


def merge_counted(
    spark: SparkSession,
    root: str,
    group: SourceGroup,
    incoming: DataFrame,
    arrival: Sequence[str],
    grain: str = "day",
    folded: bool = False,
) -> None:
    """Upserts into the group's table and brings the counts of the touched partitions up to date.

    What comes in is written once and read from there by the steps of the merge. ``folded`` says that it has one row
    per key, as for :func:`tradeaxis.operators.store.merge_into`.

    The counts of a partition of the table are a partition of their own, replaced as a whole. A run that is lost
    between table and counts is repeated: both steps give the same again.
    """
    path, keys = f"{root}/{group.table}", store.KEYS[group.table]
    copy = scratch_path(spark, "incoming")
    incoming = staged_at(incoming, copy)
    store.merge_into(spark, path, incoming, keys, arrival, grain, group.session_column, store.DERIVED.get(group.table, ()), folded)
    part = F.date_format(group.session_column, store._GRAIN[grain])
    # the days that landed, as literals: the scan reads these partitions alone
    touched = [r[0] for r in incoming.select(part.alias("p")).distinct().collect()]
    merged = spark.read.parquet(path).filter(F.col(store.PARTITION).isin([t for t in touched if t is not None]))
    counted = session_counts(group, merged).withColumn("part", F.date_format("session_date", store._GRAIN[grain]))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_id", "part").parquet(f"{root}/coverage")
    discard(spark, copy)


def kept_counts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{COUNTS}, part string").parquet(f"{root}/coverage").drop("part")


def coverage_from_counts(counts: DataFrame, group: SourceGroup, window: SessionWindow) -> DataFrame:
    """The coverage of a group in a window, from the kept counts alone."""
    own = counts.filter((F.col("group_id") == group.group_id) & window.contains())
    total = own.agg(
        F.count("session_date").alias("sessions_covered"),
        F.min("session_date").alias("period_from"),
        F.max("session_date").alias("period_till"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("rows_with_values"),
    )
    size = F.lit(len(window)).cast("bigint")
    named = total.select(F.lit(group.group_id).alias("group_id"), size.alias("window_sessions"), "*")
    return named.withColumn("gaps", F.col("window_sessions") - F.col("sessions_covered")).withColumn("coverage_ratio", money.ratio4("sessions_covered", "window_sessions"))


def rollup_base(rows: DataFrame, by: Sequence[str], value_columns: Sequence[str], asset: str = "asset_id") -> DataFrame:
    """The finest grain of a rollup: counts and a sketch of the assets, mergeable with those of other days."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows_total"),
        F.count_if(store.filled(value_columns)).alias("rows_with_values"),
        F.hll_sketch_agg(asset, SKETCH_SIZE).alias("assets"),
    )


def rolled_up(base: DataFrame, by: Sequence[str]) -> DataFrame:
    """All groupings of ``by`` from the base rows: ``level`` names the columns that are grouped by.

    ``base`` may hold several rows of a group, as days that were added later have.
    """
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in by])
    united = base.cube(*by).agg(
        level.alias("level"),
        F.sum("rows_total").alias("rows_total"),
        F.sum("rows_with_values").alias("rows_with_values"),
        F.hll_sketch_estimate(F.hll_union_agg("assets")).alias("assets_about"),
    )
    return united.select("level", *by, "rows_total", "rows_with_values", "assets_about")


def exact_assets(rows: DataFrame, by: Sequence[str], asset: str = "asset_id") -> DataFrame:
    """Exact distinct assets of every grouping: pairs first, so no group gathers its rows."""
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in by])
    pairs = rows.select(*by, asset).distinct()
    return pairs.cube(*by, asset).agg(level.alias("level"), F.grouping(asset).alias("g")).filter(F.col("g") == 0).groupBy("level", *by).agg(F.count(asset).alias("assets"))
