"""Account snapshots: valuation, shares, checks and the sync journal."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.functions import money
from tradeaxis.operators.journal import failure_streaks
from tradeaxis.operators.ranking import rules
from tradeaxis.operators.store import exists
from tradeaxis.schema import PRICE
from tradeaxis.session import discard

# Reconciliation tolerances and the broker status of each failure reason.
ABSOLUTE_TOLERANCE = "1"
RELATIVE_TOLERANCE = "0.005"
BROKER_STATUS = {"token_missing": "not_configured", "broker_rejected_token": "rejected"}


def without_currency(positions: DataFrame) -> DataFrame:
    """Money is counted once, as cash."""
    return positions.filter(F.col("asset_type") != "currency")


def position_states(positions: DataFrame) -> DataFrame:
    """Value, cost basis and unrealised result of each position.

    A figure that ``(28,9)`` cannot hold is NULL like an unknown one; ``reason`` tells them apart.
    """
    states = (
        positions.withColumn(
            "value", money.position_value("quantity", "current_price", "accrued_interest")
        )
        .withColumn("cost_basis", money.cost_basis("quantity", "average_price"))
        .withColumn("unrealized_pnl", money.pnl("value", "cost_basis"))
    )

    def lost(figure: str, *inputs: str) -> Column:
        given = reduce(Column.__and__, [F.col(c).isNotNull() for c in inputs])
        return given & F.col(figure).isNull()

    reason = (
        F.when(lost("value", "quantity", "current_price"), F.lit("value_too_large"))
        .when(lost("cost_basis", "quantity", "average_price"), F.lit("cost_too_large"))
        .when(lost("unrealized_pnl", "value", "cost_basis"), F.lit("result_too_large"))
    )
    return states.withColumn("reason", reason)


def totals(accounts: DataFrame, states: DataFrame) -> DataFrame:
    """Per account: everything it is worth; the result only over positions with a known price.

    An account with a figure that cannot be represented, or whose sums cannot, has no totals but a ``reason``:
    a sum that leaves something out would look like a smaller account. Other accounts are not touched by it.
    """
    summed = states.groupBy("account_id").agg(
        F.sum("value").alias("v"),
        F.sum("cost_basis").alias("b"),
        F.sum("unrealized_pnl").alias("p"),
        F.min("reason").alias("r"),
        F.count("*").alias("n"),
    )
    zero = F.lit(0).cast(PRICE)

    def known(total: Column) -> Column:
        return F.when(F.col("r").isNull(), F.coalesce(total, zero).try_cast(PRICE))

    value = F.col("v").try_cast("decimal(36,9)")
    worth = F.coalesce(value, zero) + F.col("cash")
    told = accounts.join(summed, "account_id", "left").withColumns(
        {"total_value": known(worth), "positions_cost_basis": known(F.col("b")), "unrealized_pnl": known(F.col("p"))}
    )
    whole = F.col("total_value").isNotNull() & F.col("positions_cost_basis").isNotNull() & F.col("unrealized_pnl").isNotNull()
    reason = F.coalesce(F.col("r"), F.when(~whole & F.col("cash").isNotNull(), F.lit("total_too_large")))
    figures = [F.when(reason.isNull(), F.col(c)).alias(c) for c in ("total_value", "positions_cost_basis", "unrealized_pnl")]
    return told.select(*accounts.columns, *figures, F.coalesce("n", F.lit(0)).alias("positions_count"), reason.alias("reason"))


def account_view(account_totals: DataFrame) -> DataFrame:
    return account_totals.withColumn("cash_share", money.share("cash", "total_value")).withColumn(
        "unrealized_pnl_percent", money.percent("unrealized_pnl", "positions_cost_basis")
    )


def position_view(states: DataFrame, account_totals: DataFrame) -> DataFrame:
    """Positions with their part of the account and their own result in percent."""
    whole = account_totals.select("account_id", "total_value")
    return (
        states.join(whole, "account_id")
        .withColumn("share", money.share("value", "total_value"))
        .withColumn("unrealized_pnl_percent", money.percent("unrealized_pnl", "cost_basis"))
        .drop("total_value", "reason")
    )


def snapshot_violations(accounts: DataFrame, positions: DataFrame) -> DataFrame:
    """What makes a snapshot unfit to store: ``(account_id, rule, subject)``."""

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""

    def subject(df: DataFrame, c: str | None) -> DataFrame:
        value = F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
        return df.withColumn("subject", value).select("account_id", "rule", "subject")

    account_rules = [("blank_account_id", blank("account_id")), ("blank_account_currency", blank("currency"))]
    position_rules = [
        ("blank_instrument", blank("instrument_uid")),
        ("blank_currency", blank("currency")),
        ("negative_price", F.col("current_price") < 0),
        ("negative_average", F.col("average_price") < 0),
    ]
    twice = (
        positions.filter(~blank("instrument_uid"))
        .groupBy("account_id", "instrument_uid")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .withColumn("rule", F.lit("duplicate_instrument"))
    )
    return (
        subject(rules(accounts, ["account_id"], account_rules), None)
        .unionByName(
            subject(rules(positions, ["account_id", "instrument_uid"], position_rules), "instrument_uid")
        )
        .unionByName(subject(twice, "instrument_uid"))
    )


def reconciliation_violations(account_totals: DataFrame, broker_totals: DataFrame) -> DataFrame:
    """Accounts whose computed worth is off the broker's own total beyond tolerance.

    Without a broker total there is nothing to compare with.
    """
    theirs = F.col("broker_total_value")
    tolerance = F.greatest(
        F.lit(ABSOLUTE_TOLERANCE).cast(PRICE),
        (F.abs(theirs) * F.lit(RELATIVE_TOLERANCE).cast("decimal(4,3)")).cast(PRICE),
    )
    joined = account_totals.join(broker_totals, "account_id").filter(theirs.isNotNull())
    off = F.abs(F.col("total_value") - theirs).cast(PRICE)
    return joined.select(
        "account_id", "total_value", "broker_total_value", off.alias("difference"), tolerance.alias("tolerance")
    ).filter("difference > tolerance")


def ordered_page(
    view: DataFrame, column: str, offset: int, limit: int, ties: Sequence[str], ascending: bool = False
) -> DataFrame:
    """A page of positions in numeric order of any column; unknown values last either way."""
    c = F.col(column)
    first = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return view.orderBy(first, *ties).offset(offset).limit(limit)


def sync_failures(sync_journal: DataFrame) -> DataFrame:
    """Failures in a row since the last success of each account."""
    return failure_streaks(
        sync_journal,
        ["account_id"],
        ["attempted_at", "id"],
        F.col("status") == "ok",
        F.col("status") == "failed",
    )


def broker_status(reason: Column | str) -> Column:
    """A missing token is "not configured", a refused one "rejected"; others change nothing."""
    r = F.col(reason) if isinstance(reason, str) else reason
    out = F.lit(None).cast("string")
    for name, status in BROKER_STATUS.items():
        out = F.when(r == name, F.lit(status)).otherwise(out)
    return out


def sync_view(sync_journal: DataFrame, accounts: DataFrame, now: Column, interval: int) -> DataFrame:
    """Last sync status per account with the staleness of its snapshot."""
    at = F.struct("attempted_at", "id")
    last = sync_journal.groupBy("account_id").agg(
        F.max_by("status", at).alias("status"),
        F.max_by("reason", at).alias("failure_reason_code"),
        F.max("attempted_at").alias("last_attempt_at"),
        F.max(F.when(F.col("status") == "ok", F.col("attempted_at"))).alias("last_success_at"),
    )
    every = F.lit(interval)
    return (
        accounts.select("account_id", "captured_at")
        .join(last, "account_id", "left")
        .withColumn("is_stale", money.is_stale("captured_at", now, every))
        .withColumn("stale_after_seconds", money.stale_after(every))
        .withColumn("refresh_interval_seconds", every)
    )


def stored_snapshot(accounts: DataFrame, listed: DataFrame) -> DataFrame:
    """Snapshot rows to store, in the broker's order.

    ``listed`` has one row per account with ``positions``, an array as the broker sent it. An account
    without positions keeps one row with its own state and no position (``sort_order`` NULL).
    """
    rows = listed.select("account_id", F.posexplode_outer("positions").alias("sort_order", "p"))
    return accounts.join(rows.select("account_id", "sort_order", "p.*"), "account_id", "left")


def write_snapshot(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Replaces the snapshots of the accounts in ``rows``, each as a whole; the others stay.

    Accounts are spread over hash partitions, as many as the first write of a path says. The touched ones
    are read, their other accounts kept, and both written beside the table, whole, before they replace their
    partitions. A write that is lost at any point is finished by the next one: a whole copy is put in place
    again, half a copy is thrown away. ``read_snapshot`` sees a whole copy as if it were in place.
    """
    spark = rows.sparkSession
    pending, spread_over = f"{path}.pending", f"{path}.buckets"
    if exists(spark, f"{spread_over}/_SUCCESS"):
        buckets = spark.read.parquet(spread_over).first()[0]
    else:
        spark.createDataFrame([(buckets,)], "n int").write.mode("overwrite").parquet(spread_over)
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("account_id"), F.lit(buckets)).cast("int"))
    if exists(spark, f"{pending}/_SUCCESS"):
        _put_in_place(spark.read.schema(spread.schema).parquet(pending), path)
    discard(spark, pending)
    if exists(spark, path):
        touched = [r[0] for r in spread.select("bucket").distinct().collect()]  # at most ``buckets``
        stored = spark.read.schema(spread.schema).parquet(path).filter(F.col("bucket").isin(touched))
        others = stored.join(rows.select("account_id").distinct(), "account_id", "left_anti")
        spread = others.select(*spread.columns).unionByName(spread)
    _by_bucket(spread).write.partitionBy("bucket").parquet(pending)
    _put_in_place(spark.read.schema(spread.schema).parquet(pending), path)
    discard(spark, pending)


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "account_id", "sort_order")


def _put_in_place(whole: DataFrame, path: str) -> None:
    """The whole copy over its partitions of the table; may be repeated."""
    writer = _by_bucket(whole).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored snapshots in the columns of ``schema``; a write that was lost on its last step counts as done."""
    kept = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    pending = f"{path}.pending"
    whole = exists(spark, f"{pending}/_SUCCESS")
    frames = []
    if exists(spark, path):
        stored = spark.read.schema(kept).parquet(path)
        if whole:
            touched = [r[0] for r in spark.read.schema(kept).parquet(pending).select("bucket").distinct().collect()]
            stored = stored.filter(~F.col("bucket").isin(touched))
        frames.append(stored)
    if whole:
        frames.append(spark.read.schema(kept).parquet(pending))
    return reduce(DataFrame.unionByName, frames or [spark.createDataFrame([], kept)]).drop("bucket")
