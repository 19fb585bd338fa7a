"""Rebalancing plans: ranking and account to whole lots, for many requests at once.

Per request the rules are: instruments outside the ranked universe are left alone; quantities are
whole lots; the rest of rounding and the weight of an unavailable asset stay cash and are never
handed to other assets; a refusal gives no plan at all.

Small sides are small by rule: policy weights (a few hundred rows) and the selection of each policy.
The universe and the account tables are joined by key and left to adaptive execution, which
broadcasts what turns out small and splits what turns out skewed.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeaxis.functions import money
from tradeaxis.operators import calendar as cal
from tradeaxis.schema import PRICE
from tradeaxis.session import local_frame, staged

# Policy sizes, rank zones with their parts of capital, fee bounds, reason texts.
EQUAL_SIZES = (20, 30, 50, 100, 150)
RANK_ZONES = (
    (1, 20, "0.2403"),
    (21, 30, "0.1063"),
    (31, 50, "0.2039"),
    (51, 100, "0.4495"),
)
ZONES_POLICY = "rank_zones_100"
MAX_FEE_PERCENT = 5
DEFAULT_FEE_PERCENT = "0.04"
SHARE_TYPE = "share"
NO_ASSET = "актив не найден в справочнике"
NO_LOT = "не известен размер лота"
NO_PRICE = "не известна цена закрытия последней сессии"
OUTSIDE = "вне вселенной модели"
PRICE_DEPTH = 10

MAX_POSITIONS = max(*EQUAL_SIZES, RANK_ZONES[-1][1])


def equal_weights(spark: SparkSession) -> DataFrame:
    """``1/k`` for the first k places, as an exact fraction."""
    sizes = local_frame(spark, [(k,) for k in EQUAL_SIZES], k=pa.int32())
    places = sizes.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("k"))))
    return places.select(
        F.concat(F.lit("equal_top"), "k").alias("policy"),
        "place",
        F.lit(1).alias("num"),
        F.col("k").alias("den"),
    )


def zone_weights(spark: SparkSession) -> DataFrame:
    """Each zone's part of capital split evenly among its places, as an exact fraction."""
    rows = [
        (lo, hi, int(Decimal(part) * 10_000), 10_000 * (hi - lo + 1)) for lo, hi, part in RANK_ZONES
    ]
    zones = local_frame(
        spark, rows, lo=pa.int32(), hi=pa.int32(), num=pa.int32(), den=pa.int32()
    )
    return zones.select(
        F.lit(ZONES_POLICY).alias("policy"),
        F.explode(F.sequence("lo", "hi")).alias("place"),
        "num",
        "den",
    )


def policy_weights(spark: SparkSession) -> DataFrame:
    """Weights by place: at most 450 rows, whatever is planned."""
    return equal_weights(spark).unionByName(zone_weights(spark))


def policy_sizes() -> dict[str, int]:
    return {**{f"equal_top{k}": k for k in EQUAL_SIZES}, ZONES_POLICY: RANK_ZONES[-1][1]}


@dataclass(frozen=True)
class Market:
    """What every request of one planning job shares."""

    ranking: DataFrame  # asset_id, rank: all ranked assets of the run
    assets: DataFrame  # asset_id, ticker, lot_size
    prices: DataFrame  # asset_id, price
    ranking_stale: bool = False


def closing_prices(calendar: DataFrame, bars: DataFrame, asof) -> tuple[DataFrame, DataFrame]:
    """Closes of the last session *with bars* among the last ten, and that session.

    Of several series of an asset the one with the smallest id gives the price.
    """
    window = cal.window(calendar, asof, PRICE_DEPTH)
    recent = bars.filter(window.contains())
    session = recent.agg(F.max("session_date").alias("session_date"))
    at = recent.filter((F.col("session_date") == session.scalar()) & F.col("close").isNotNull())
    prices = at.groupBy("asset_id").agg(F.min_by("close", "price_series_id").alias("price"))
    return prices, session


def placed(ranking: DataFrame) -> DataFrame:
    """Ranked assets by place. Only as many as the largest policy takes are ever numbered."""
    top = ranking.select("asset_id", "rank").orderBy("rank").limit(MAX_POSITIONS)
    return top.withColumn("place", F.row_number().over(Window.orderBy("rank")))


def selection(spark: SparkSession, ranking: DataFrame) -> DataFrame:
    """Asset, place and weight of every policy; at most 450 rows."""
    return policy_weights(spark).join(F.broadcast(placed(ranking)), "place")


def universe(market: Market) -> DataFrame:
    """Every ranked asset with what is known about it: ticker, lot and close, each maybe missing."""
    known = market.assets.select("asset_id", "ticker", "lot_size", F.lit(True).alias("known"))
    return (
        market.ranking.select("asset_id", "rank")
        .join(known, "asset_id", "left")
        .join(market.prices.select("asset_id", "price"), "asset_id", "left")
    )


def chosen(assets: DataFrame) -> DataFrame:
    """The selection of each policy with its data, or the reason an asset cannot be held."""
    picked = selection(assets.sparkSession, assets)
    described = F.broadcast(picked).join(assets.drop("rank"), "asset_id")
    reason = exclusion_reason(F.col("known"), F.col("price"), F.col("lot_size"))
    return described.withColumn("reason", reason).drop("known")


def request_status(
    requests: DataFrame,
    accounts: DataFrame,
    assets: DataFrame,
    has_prices: Column,
    ranking_stale: bool,
    now: Column,
) -> DataFrame:
    """``ok`` or the first reason to refuse, checked in the order a person should hear them."""
    spark = requests.sparkSession
    known = list(policy_sizes().items())
    sizes = local_frame(spark, known, policy=pa.string(), required=pa.int32())
    available = placed(assets).agg(F.count("*").alias("n")).scalar()
    held = accounts.select(
        "account_id", "cash", "captured_at", "interval_seconds", F.lit(True).alias("_known")
    )
    joined = requests.join(F.broadcast(sizes), "policy", "left").join(held, "account_id", "left")
    fee, limit = F.col("fee_percent"), F.col("capital_limit")
    status = (
        F.when(F.col("required").isNull(), "unknown_policy")
        .when((fee < 0) | (fee > MAX_FEE_PERCENT), "invalid_fee")
        .when(limit <= 0, "invalid_limit")
        .when(available == 0, "no_successful_ranking")
        .when(F.lit(ranking_stale), "ranking_stale")
        .when(available < F.col("required"), "insufficient_assets")
        .when(F.col("_known").isNull(), "broker_not_connected")
        .when(money.is_stale("captured_at", now, "interval_seconds"), "portfolio_stale")
        .when(~has_prices, "no_prices")
        .otherwise("ok")
    )
    return joined.select(*requests.columns, "cash", status.alias("status"))


def split_positions(positions: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings of the ranked universe, and everything a plan does not touch.

    The universe is all that was ranked, not the selection. Several positions in one asset add up.
    A ticker held by a third of all accounts is a skewed join key; adaptive execution broadcasts
    the universe where its size allows and splits the key where it does not.
    """
    owner = (
        assets.filter("ticker IS NOT NULL")
        .groupBy("ticker")
        .agg(F.max("asset_id").alias("asset_id"))
    )
    joined = positions.join(owner, "ticker", "left")
    inside = (F.col("asset_type") == SHARE_TYPE) & F.col("asset_id").isNotNull()
    marked = joined.withColumn("_inside", F.coalesce(inside, F.lit(False)))
    holdings = (
        marked.filter("_inside")
        .groupBy("account_id", "asset_id")
        .agg(
            F.sum("quantity").cast(PRICE).alias("current_quantity"),
            F.sum("value").cast(PRICE).alias("current_value"),
        )
    )
    untouched = marked.filter("NOT _inside").select(
        "account_id", "ticker", "quantity", "value", F.lit(OUTSIDE).alias("reason")
    )
    return holdings, untouched


def books(holdings: DataFrame) -> DataFrame:
    """Per account its holdings as a map and their worth.

    ``holdings`` has a row per account and asset, so a map is no longer than the ranked universe,
    which a ranking request limits.
    """
    entry = F.struct("asset_id", "current_quantity")
    return holdings.groupBy("account_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("book"),
        F.sum("current_value").cast(PRICE).alias("held_value"),
    )


def capital(accepted: DataFrame, holdings: DataFrame) -> DataFrame:
    """What a request may distribute: cash and universe holdings, under its own cap.

    The account's book travels with the request, so that fanning a request out to its assets needs
    no further shuffle.
    """
    joined = accepted.join(books(holdings), "account_id", "left")
    held = F.coalesce("held_value", F.lit(0).cast(PRICE))
    funded = joined.withColumn("eligible", (F.col("cash") + held).cast(PRICE))
    cap = F.coalesce(F.col("capital_limit").cast(PRICE), F.col("eligible"))
    return funded.withColumn("limit_value", F.least("eligible", cap)).drop("held_value")


def exclusion_reason(asset: Column, price: Column, lot: Column) -> Column:
    """Name of the first input that is missing, in the order asset, lot, price."""
    return (
        F.when(asset.isNull(), F.lit(NO_ASSET))
        .when(lot.isNull() | (lot <= 0), F.lit(NO_LOT))
        .when(price.isNull() | (price <= 0), F.lit(NO_PRICE))
    )


def whole_lots(limit: Column, num: Column, den: Column, price: Column, lot: Column) -> Column:
    """``trunc(limit * num / (den * price * lot))``, exact: whole divisions one after another.

    Weights stay fractions, so an exact multiple never loses a lot to a rounded ``1/k``. The second
    divisor is whole, so cutting off twice is cutting off once. More pieces than 64 bits hold give NULL.
    """
    target = limit.cast(PRICE) * num.cast("decimal(6,0)")
    pieces = F.when(target.cast("double") / price.cast("double") < 9e18, F.call_function("div", target, price.cast(PRICE)))
    return F.call_function("div", pieces.cast("decimal(19,0)"), den.cast("decimal(6,0)") * lot.cast("decimal(19,0)"))


def target_rows(with_capital: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected assets of each request with target and difference, or the reason for none.

    ``selected`` is ``chosen(...)``: at most 450 rows by the size of the policies.
    """
    rows = with_capital.join(F.broadcast(selected), "policy").withColumn(
        "current_quantity", F.try_element_at("book", F.col("asset_id"))
    )
    zero = F.lit(0).cast(PRICE)
    lots = whole_lots(
        F.col("limit_value"), F.col("num"), F.col("den"), F.col("price"), F.col("lot_size")
    )
    usable = F.col("reason").isNull()
    weight = F.col("num").cast("decimal(12,0)") / F.col("den").cast("decimal(12,0)")
    return (
        rows.withColumn("target_weight", weight.cast("decimal(38,10)"))
        .withColumn("target_lots", F.when(usable, lots))
        .withColumn(
            "target_quantity", (F.col("target_lots") * F.col("lot_size")).cast(PRICE)
        )
        .withColumn("target_value", money.times("target_quantity", "price"))
        .withColumn("current_quantity", F.coalesce("current_quantity", zero))
        .withColumn(
            "delta_quantity", (F.col("target_quantity") - F.col("current_quantity")).cast(PRICE)
        )
        .withColumn("delta_value", money.times("delta_quantity", "price"))
    )


PLAN_COLUMNS = (
    "request_id",
    "asset_id",
    "ticker",
    "rank",
    "target_weight",
    "price",
    "lot_size",
    "target_lots",
    "target_quantity",
    "target_value",
    "current_quantity",
    "delta_quantity",
    "delta_value",
    "reason",
)


def close_out_rows(with_capital: DataFrame, assets: DataFrame, selected: DataFrame) -> DataFrame:
    """Universe holdings outside the selection: sold in full, or named when they have no price."""
    pairs = F.broadcast(selected.select("policy", "asset_id"))
    held = (
        with_capital.select(
            "request_id", "policy", F.explode("book").alias("asset_id", "current_quantity")
        )
        .filter("current_quantity <> 0")
        .join(pairs, ["policy", "asset_id"], "left_anti")
    )
    described = held.join(assets.drop("known"), "asset_id", "left")
    zero = F.lit(0).cast(PRICE)
    no_price = F.col("price").isNull() | (F.col("price") <= 0)
    delta = (-F.col("current_quantity")).cast(PRICE)
    return (
        described.withColumn("reason", F.when(no_price, F.lit(NO_PRICE)))
        .withColumn("target_weight", F.lit(0).cast("decimal(38,10)"))
        .withColumn("target_lots", F.lit(0).cast("bigint"))
        .withColumn("target_quantity", zero)
        .withColumn("target_value", zero)
        .withColumn("delta_quantity", delta)
        .withColumn("delta_value", money.times("delta_quantity", "price"))
        .select(*PLAN_COLUMNS)
    )


class Planner:
    """Plans every accepted request. ``positions`` carries ``value``; see ``position_states``.

    What several results need is computed once and staged: the universe, the selections, funded
    requests and the planned rows. A result that needs none of them stages nothing.
    """

    def __init__(
        self,
        requests: DataFrame,
        accounts: DataFrame,
        positions: DataFrame,
        market: Market,
        now: Column,
    ) -> None:
        self._requests, self._accounts, self._positions = requests, accounts, positions
        self._market, self._now = market, now

    @cached_property
    def assets(self) -> DataFrame:
        return staged(universe(self._market), "plan-universe")

    @cached_property
    def selected(self) -> DataFrame:
        return staged(chosen(self.assets), "plan-selection")

    @cached_property
    def status(self) -> DataFrame:
        """Each request with ``ok`` or the reason there is no plan."""
        priced = self._market.prices.limit(1).agg((F.count("*") > 0).alias("x")).scalar()
        return request_status(
            self._requests,
            self._accounts,
            self.assets,
            priced,
            self._market.ranking_stale,
            self._now,
        )

    @cached_property
    def _split(self) -> tuple[DataFrame, DataFrame]:
        return split_positions(self._positions, self.assets)

    @cached_property
    def funded(self) -> DataFrame:
        accepted = self.status.filter(F.col("status") == "ok").drop("status")
        funded = capital(accepted, self._split[0])
        # Each request fans out to as many rows as its policy has places: spread them evenly first.
        parallel = int(accepted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return staged(funded.repartition(parallel, "request_id"), "plan-funded")

    @cached_property
    def closing(self) -> DataFrame:
        return close_out_rows(self.funded, self.assets, self.selected)

    @cached_property
    def rows(self) -> DataFrame:
        targets = target_rows(self.funded, self.selected).select(*PLAN_COLUMNS)
        return staged(targets.unionByName(self.closing), "plan-rows")

    @cached_property
    def planned(self) -> DataFrame:
        return self.rows.filter("reason IS NULL").drop("reason")

    @cached_property
    def excluded(self) -> DataFrame:
        """Assets without a row in the plan, and why."""
        named = self.rows.filter("reason IS NOT NULL")
        return named.select("request_id", "asset_id", "rank", "reason")

    @cached_property
    def _untouched(self) -> DataFrame:
        return self.funded.select("request_id", "account_id").join(self._split[1], "account_id")

    @cached_property
    def totals(self) -> DataFrame:
        return plan_totals(self.funded, self.planned, self._untouched)

    @cached_property
    def positions(self) -> DataFrame:
        """Rows to trade or keep, each with its part of the account afterwards."""
        return weighted(self.planned, self.totals, "target_value")

    @cached_property
    def untouched(self) -> DataFrame:
        """Positions outside the universe, listed rather than silently left out."""
        return weighted(self._untouched, self.totals, "value")


def plan_totals(funded: DataFrame, planned: DataFrame, untouched: DataFrame) -> DataFrame:
    """Allocated, turnover, fee, cash left and the account total the weights are taken from.

    The base of weights is the limit plus untouched positions, so under a cap the capital beyond it
    is outside the base.
    """
    moved = planned.groupBy("request_id").agg(
        F.sum("target_value").cast(PRICE).alias("_allocated"),
        F.sum(F.abs("delta_value")).cast(PRICE).alias("_turnover"),
    )
    kept = untouched.groupBy("request_id").agg(F.sum("value").cast(PRICE).alias("_untouched"))
    zero = F.lit(0).cast(PRICE)
    fee = F.bround(
        F.col("turnover").cast(PRICE) * F.col("fee_percent").cast("decimal(7,4)") / 100, 2
    )
    return (
        funded.join(moved, "request_id", "left")
        .join(kept, "request_id", "left")
        .withColumn("allocated", F.coalesce("_allocated", zero))
        .withColumn("turnover", F.coalesce("_turnover", zero))
        .withColumn("fee_total", fee.cast("decimal(28,2)"))
        .withColumn("cash_after", (F.col("limit_value") - F.col("allocated")).cast(PRICE))
        .withColumn(
            "account_total", (F.col("limit_value") + F.coalesce("_untouched", zero)).cast(PRICE)
        )
        .select(
            "request_id",
            "account_id",
            "policy",
            "eligible",
            "limit_value",
            "allocated",
            "turnover",
            "fee_total",
            "cash_after",
            "account_total",
        )
    )


def weighted(rows: DataFrame, totals: DataFrame, amount: str) -> DataFrame:
    """Adds the part of the account each row takes after the plan; zero without a positive total."""
    base = totals.select("request_id", "account_total")
    positive = F.greatest(F.col("account_total"), F.lit(0).cast(PRICE))
    return (
        rows.join(base, "request_id")
        .withColumn("weight_after", money.share(amount, positive))
        .drop("account_total")
    )


def in_order(planned: DataFrame) -> DataFrame:
    """By request, then from the largest sale to the largest purchase."""
    return planned.orderBy("request_id", "delta_value", "rank", "asset_id")


def action_page(planned: DataFrame, action: str, offset: int, limit: int) -> DataFrame:
    acted = planned.withColumn("action", money.plan_action("delta_quantity"))
    chosen = acted.filter(F.col("action") == action)
    return in_order(chosen).offset(offset).limit(limit)
