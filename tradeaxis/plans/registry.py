"""Names, builders and SQL twins of the registered queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.views import Views, with_views

# Decision date and moment of the registered queries: literals, so that both engines agree.
ASOF = dt.date(2001, 7, 30)
NOW = "2001-07-30 18:00:00"


@dataclass(frozen=True)
class Query:
    build: Callable[[Views], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Adds a query. ``sql`` may name the ``v_*`` views; without it only rows are checked."""

    def add(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(build, sql)
        return build

    return add


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text; arrays are joined, holes shown. Value hashes then do not depend on the engine."""

    def text(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            inner = field.dataType.elementType
            if isinstance(inner, (T.ArrayType, T.StructType)):
                return F.to_json(c, {"ignoreNullFields": "false"}).alias(field.name)
            return F.array_join(c.cast("array<string>"), ",", "NULL").alias(field.name)
        return c.cast("string").alias(field.name)

    return df.select(*[text(f) for f in df.schema.fields])


def load() -> dict[str, Query]:
    """Imports every family of queries."""
    from tradeaxis.plans import (  # noqa: F401
        q_completeness,
        q_dataset,
        q_jobs,
        q_journal,
        q_portfolio,
        q_ranking,
        q_scalars,
        q_sources,
        q_store,
    )

    return CATALOG


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(query: Query):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return as_text(query.build(Views(spark, folder)))

        return run

    return {name: runner(q) for name, q in load().items()}


def oracles() -> dict[str, str]:
    return {name: with_views(q.sql) for name, q in load().items() if q.sql is not None}


def sql_ratio(num: str, den: str, digits: int = 10) -> str:
    """Quotient of two ``DECIMAL(28,9)`` expressions rounded half-up, exact in integers.

    The oracle's own division of decimals is floating point.
    """
    n = f"cast(({num}) * 1000000000 as hugeint)"
    d = f"cast(({den}) * 1000000000 as hugeint)"
    scaled = f"(abs({n}) * {2 * 10**digits} + abs({d})) // (2 * abs({d}))"
    sign = f"(case when ({num} < 0) <> ({den} < 0) then -1 else 1 end)"
    unit = "0." + "0" * (digits - 1) + "1"
    return (
        f"cast(cast({sign} * ({scaled}) as decimal(28,0)) * cast('{unit}' as decimal({digits},{digits}))"
        f" as decimal(38,{digits}))"
    )
