"""Reads and keyed writes of the stored observations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.functions import parse
from tradeaxis.operators.calendar import SessionWindow
from tradeaxis.operators.dedup import upsert
from tradeaxis.schema import POSITION_VALUES
from tradeaxis.session import discard, scratch_path, staged_at

# Natural keys of the stored tables.
KEYS = {
    "bar": ("price_series_id", "session_date"),
    "aggregate": ("price_series_id", "session_date"),
    "global_series": ("series_id", "session_date"),
    "position": ("asset_id", "session_date"),
    "sector": ("asset_id",),
    "dividend": ("asset_id", "record_date"),
}


#: Columns that follow from the key.
DERIVED = {"bar": ("asset_id",), "aggregate": ("asset_id",)}
#: A task that folds what landed has it in memory, ten times as long as its files or more.
SMALL_READS = {"spark.sql.files.maxPartitionBytes": "16m"}
#: Columns that follow from the values: made where the rows are written, not shuffled.
FOLLOWING = {"bar": {"source_revision": parse.fingerprint}}


def filled(columns: Sequence[str]) -> Column:
    """At least one value was observed."""
    return F.coalesce(*[F.col(c) for c in columns]).isNotNull()


def scan_window(df: DataFrame, window: SessionWindow, order: Sequence[str]) -> DataFrame:
    """Observations of the window's sessions in the given order."""
    return df.filter(window.contains()).orderBy(*order)


def rows_of_assets(df: DataFrame, assets: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.join(assets.select("asset_id"), "asset_id", "left_semi").orderBy(*order)


def count_session(df: DataFrame, session_date) -> DataFrame:
    return df.filter(F.col("session_date") == F.lit(session_date)).agg(F.count("*").alias("rows"))


def has_any(df: DataFrame) -> DataFrame:
    """One row saying whether the table holds anything; stops at the first row found."""
    return df.limit(1).agg((F.count("*") > 0).alias("has_rows"))


def with_fingerprint(bars: DataFrame) -> DataFrame:
    return bars.withColumn("source_revision", parse.fingerprint())


def revisions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Closed observations the exchange issued again with other values."""
    keys = list(KEYS["bar"])
    old = stored.select(*keys, F.col("source_revision").alias("was"))
    new = incoming.select(*keys, F.col("source_revision").alias("now"))
    return old.join(new, keys).filter(F.col("was") != F.col("now"))


def update_lots(assets: DataFrame, lots: DataFrame) -> DataFrame:
    """New lot sizes for known assets; an unknown asset is never added."""
    fresh = lots.select("asset_id", F.col("lot_size").alias("_lot"))
    joined = assets.join(fresh, "asset_id", "left")
    return joined.select(
        *[
            F.coalesce("_lot", "lot_size").alias("lot_size") if c == "lot_size" else F.col(c)
            for c in assets.columns
        ]
    )


def first_filled_dates(positions: DataFrame) -> DataFrame:
    """The earliest session with a value, per asset."""
    return (
        positions.filter(filled(POSITION_VALUES))
        .groupBy("asset_id")
        .agg(F.min("session_date").alias("first_date"))
    )


def assets_filled_at(positions: DataFrame, session_date) -> DataFrame:
    at = positions.filter(F.col("session_date") == F.lit(session_date))
    return at.filter(filled(POSITION_VALUES)).select("asset_id").distinct()


def known_tickers(assets: DataFrame) -> DataFrame:
    return assets.select("ticker").distinct()


def upsert_seen(
    stored: DataFrame, incoming: DataFrame, key: str, arrival: Sequence[str], carried: Sequence[str]
) -> DataFrame:
    """First and last seen day of a key, following arrival rather than the calendar.

    ``incoming`` carries ``session_date``. Loading old history moves ``last_seen`` back, as the
    arrival rule demands; ``earliest_date`` and ``latest_date`` hold the true extremes beside it.
    """
    types = dict(incoming.dtypes)
    old = stored.select(
        key,
        *carried,
        "first_seen",
        "last_seen",
        F.col("first_seen").alias("_lo"),
        F.col("last_seen").alias("_hi"),
        F.struct(F.lit(0).alias("g"), *[F.lit(None).cast(types[a]).alias(a) for a in arrival]).alias(
            "_o"
        ),
    )
    day = F.col("session_date")
    new = incoming.select(
        key,
        *carried,
        day.alias("first_seen"),
        day.alias("last_seen"),
        day.alias("_lo"),
        day.alias("_hi"),
        F.struct(F.lit(1).alias("g"), *[F.col(a) for a in arrival]).alias("_o"),
    )
    last = F.struct(*[F.col(c) for c in carried], F.col("last_seen"))
    merged = (
        old.unionByName(new)
        .groupBy(key)
        .agg(
            F.max_by(last, F.col("_o")).alias("_last"),
            F.min_by("first_seen", "_o").alias("first_seen"),
            F.min("_lo").alias("earliest_date"),
            F.max("_hi").alias("latest_date"),
        )
    )
    return merged.select(
        key,
        *[F.col(f"_last.{c}").alias(c) for c in carried],
        "first_seen",
        F.col("_last.last_seen").alias("last_seen"),
        "earliest_date",
        "latest_date",
    )


def drop_empty_positions(positions: DataFrame) -> DataFrame:
    return positions.filter(filled(POSITION_VALUES))


def drop_empty_weights(series: DataFrame) -> DataFrame:
    """Index weights without a value; the prefix is meant literally."""
    empty = F.col("series_id").startswith(parse.INDEX_WEIGHT_PREFIX) & F.col("value").isNull()
    return series.filter(~empty)


def drop_empty_sectors(sectors: DataFrame) -> DataFrame:
    return sectors.filter(F.col("sector").isNotNull())


def drop_foreign_curve(series: DataFrame) -> DataFrame:
    """Curve series that are not points of the curve."""
    curve = F.col("series_id").startswith(parse.CURVE_PREFIX)
    point = F.col("series_id").startswith(f"{parse.CURVE_PREFIX}yield_")
    return series.filter(~(curve & ~point))


PARTITION, WHOLE = "part", "all"
_GRAIN = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


def part_of(day: str, grain: str) -> Column:
    """The partition of a stored table that a day belongs to."""
    return F.date_format(day, _GRAIN[grain])


def merge_into(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    keys: Sequence[str],
    arrival: Sequence[str],
    grain: str = "day",
    day: str | None = "session_date",
    derived: Sequence[str] = (),
    folded: bool = False,
    following: Mapping[str, Callable[[], Column]] | None = None,
    fresh: bool = False,
) -> None:
    """Upsert into a parquet table partitioned by session, touching only the incoming partitions.

    The merged partitions are staged in the shared folder first: the table is never overwritten
    while it is being read, and a lost executor or a retried job reads the same staged files. A
    partition is a session; ``grain="month"`` suits tables too small for a file per session. Rows
    are rebalanced by partition before the write: small sessions share a task, and a session with
    much of the data is split over several. Without a ``day`` the table is one partition. The staged
    copy is removed after the write. ``folded`` says that the incoming rows are one per key already, as
    a source's own fold leaves them: they are not folded again, and of what is stored only the rows of keys
    that do not come in are kept, and staged alone. Such rows must not be read from the table itself. ``following`` names columns that the values give: a new table gets
    them after the rebalance. ``fresh`` says that nothing is stored in the partitions that come in: they are written
    as those of a new table.
    """
    names = [c for c in incoming.columns if c not in arrival]
    shape = incoming.limit(0).select(*names)
    part = F.lit(WHOLE) if day is None else part_of(day, grain)
    copy, late = None, {}
    if not fresh and exists(spark, path):
        layout = T.StructType([*shape.schema.fields, T.StructField(PARTITION, T.StringType())])
        stored = spark.read.schema(layout).parquet(path)
        # at most the days that landed: literals, so that the scan reads these partitions alone
        touched = [r[0] for r in incoming.select(part.alias("p")).distinct().collect()]
        here = F.col(PARTITION).isin([t for t in touched if t is not None])
        kept = stored.filter(here | F.col(PARTITION).isNull() if None in touched else here).select(*names)
        copy = scratch_path(spark, "merge")
        (_unreplaced(kept, incoming, keys, derived) if folded else upsert(kept, incoming, keys, arrival, derived)).write.option("compression", "zstd").parquet(copy)
        merged = spark.read.schema(shape.schema).parquet(copy)
        merged = merged.unionByName(incoming.select(*names)) if folded else merged
    else:
        merged = incoming.select(*names) if folded else upsert(shape, incoming, keys, arrival, derived)
        late = {c: made() for c, made in (following or {}).items() if c in names}
    order = [PARTITION, *keys]
    (
        merged.drop(*late)
        .withColumn(PARTITION, part)
        .hint("rebalance", PARTITION)
        .sortWithinPartitions(*order)
        .withColumns(late)
        .select(*names, PARTITION)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION)
        .parquet(path)
    )
    if copy:
        discard(spark, copy)


def _unreplaced(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], derived: Sequence[str]) -> DataFrame:
    """The stored rows of keys that do not come in; unknown keys are equal, as in a fold."""
    keys = [*keys, *[c for c in derived if c in stored.columns]]
    new = incoming.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    return stored.join(new, same, "left_anti")


def put(
    spark: SparkSession,
    root: str,
    table: str,
    rows: DataFrame,
    keys: Sequence[str],
    grain: str,
    day: str | None,
    folded: bool,
    scratch: str,
    parts: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of one batch into a stored table; returns them for further reads, computed once.

    A new table that gets folded rows holds just these, so they are written there alone and read from it, until
    more is stored in the table. So are those of partitions that have nothing yet, where ``parts`` names all that
    the rows belong to. Others are staged in ``scratch`` first.
    """
    path, derived, following = f"{root}/{table}", DERIVED.get(table, ()), FOLLOWING.get(table)
    new = not exists(spark, path)
    alone = folded and (new or parts is not None and not stored_parts(spark, path).intersection(parts))
    batch = rows if alone else staged_at(rows, scratch)
    merge_into(spark, path, batch.withColumn("_seq", F.lit(1)), keys, ["_seq"], grain, day, derived, folded, following, alone)
    if not alone:
        return batch
    layout = T.StructType([*rows.schema.fields, T.StructField(PARTITION, T.StringType())])
    written = spark.read.schema(layout).parquet(path)
    return (written if new else written.filter(F.col(PARTITION).isin(list(parts)))).select(*rows.columns)


def stored_parts(spark: SparkSession, path: str) -> set[str]:
    """Names of the partitions that a stored table has."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return {f.getPath().getName().removeprefix(f"{PARTITION}=") for f in found}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PARTITION)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
