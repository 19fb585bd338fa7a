"""One row per key, by arrival order, and the upsert built on it.

Each task folds its own rows before the shuffle, so a key holding a large part of the input costs one row
per task, where a ``row_number`` window would pull the whole key into one task. Where the order is one whole
number, day or moment and the values have a fixed width, every value is a ``max_by`` or ``min_by`` of its own
over a 64-bit number: a hash aggregation without any sort. Other shapes are folded as one struct, which Spark
aggregates by sorting, by a number made of the key before the key itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FIXED = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_NUMBERED = (*_WHOLE, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: The order of rows that any other replaces, and of rows whose own order is unknown.
_STORED, _UNKNOWN = -(2**63), 1 - 2**63


def packed(df: DataFrame, order: Sequence[str]) -> Column | None:
    """A 64-bit number that sorts like a single whole, day or moment column, nulls first; else None."""
    if len(order) != 1:
        return None
    kind = df.schema[order[0]].dataType
    if isinstance(kind, _WHOLE):
        number = F.col(order[0]).cast("bigint")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(order[0]).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(order[0])
    else:
        return None
    return F.coalesce(number, F.lit(_UNKNOWN))


def _fixed(df: DataFrame, names: Sequence[str]) -> bool:
    return all(isinstance(df.schema[n].dataType, _FIXED) for n in names)


def led(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Keys to group by where Spark sorts: led by a number, so that the sort hardly ever compares the keys themselves.

    A day leads the number, as rows of a day that lie together are shorter when packed. Keys of a type whose equal
    values might not have the same number stand alone.
    """
    kinds = {n: df.schema[n].dataType for n in keys}
    plain = [F.col(n) for n in keys]
    if not keys or not all(isinstance(k, _NUMBERED) or k == T.StringType() for k in kinds.values()):
        return plain
    days = [n for n in keys if isinstance(kinds[n], T.DateType)]
    rest = [n for n in keys if n not in days[:1]]
    number = F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")
    if days:
        number = F.shiftleft(F.unix_date(days[0]).cast("bigint"), 32).bitwiseOR(number.bitwiseAND(F.lit(0xFFFFFFFF)))
    return [number.alias("_led"), *plain]


def _struct(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``; ``order`` must tell the rows of a key apart."""
    return _pick(df, keys, order, F.max, F.max_by)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``."""
    return _pick(df, keys, order, F.min, F.min_by)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], extreme, extreme_by) -> DataFrame:
    """The greatest or least row: value by value if that needs no sort, else as one struct, order leading."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    number = packed(df, order)
    if number is not None and _fixed(df, rest):
        values = [c for c in df.columns if c not in keys]
        picked = df.withColumn("_order", number).groupBy(*keys).agg(
            *[extreme_by(c, "_order").alias(c) for c in values] or [F.lit(1).alias("_")]
        )
        return picked.select(*df.columns)
    row = _struct([*order, *rest])
    picked = df.groupBy(*led(df, keys)).agg(extreme(row).alias("_row"))
    return picked.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    arrival: Sequence[str],
    derived: Sequence[str] = (),
) -> DataFrame:
    """Stored rows with incoming ones laid over them.

    An incoming row replaces every value of its key, also with NULL; among incoming rows of one key
    the last by ``arrival`` wins. Columns are those of ``stored``. ``derived`` names columns that
    follow from the key, like an asset's id from its series'; they are grouped by, not folded.
    """
    keys = [*keys, *[c for c in derived if c in stored.columns]]
    values = [c for c in stored.columns if c not in keys]
    types = dict(incoming.dtypes)
    number = packed(incoming, arrival)
    if number is not None and values and _fixed(stored, values):
        typed = [F.col(v).cast(stored.schema[v].dataType).alias(v) for v in values]
        low = F.lit(_STORED).cast("bigint").alias("_order")
        both = stored.select(*keys, *values, low).unionByName(
            incoming.select(*keys, *typed, number.alias("_order"))
        )
        folded = both.groupBy(*keys).agg(*[F.max_by(v, "_order").alias(v) for v in values])
        return folded.select(*stored.columns)
    old = stored.select(
        *keys,
        _struct(values).alias("_values"),
        F.struct(F.lit(0).alias("_gen"), *[F.lit(None).cast(types[a]).alias(a) for a in arrival]).alias(
            "_order"
        ),
    )
    new = incoming.select(
        *keys,
        F.struct(*[F.col(v).cast(stored.schema[v].dataType).alias(v) for v in values]).alias(
            "_values"
        ),
        F.struct(F.lit(1).alias("_gen"), *[F.col(a) for a in arrival]).alias("_order"),
    )
    merged = (
        old.unionByName(new)
        .groupBy(*keys)
        .agg(F.max(F.struct("_order", "_values")).alias("_row"))
    )
    return merged.select(
        *[F.col(c) if c in keys else F.col(f"_row._values.{c}").alias(c) for c in stored.columns]
    )


def insert_if_absent(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: Sequence[str]
) -> DataFrame:
    """Incoming keys with a ``created`` flag: true where the key was not stored before.

    Inside one batch the first arrival wins and the rest are dropped.
    """
    first = earliest_by(incoming, keys, arrival)
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    return (
        first.join(known, list(keys), "left")
        .withColumn("created", F.col("_known").isNull())
        .drop("_known")
    )
