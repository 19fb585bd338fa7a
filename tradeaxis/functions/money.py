"""Exact decimal arithmetic of positions, shares and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeaxis.schema import PRICE

# Staleness factor and floor, masking tail, ratio below which a group counts as empty.
STALE_FACTOR = 3
STALE_FLOOR_SECONDS = 180
MASK_TAIL = 4
EMPTY_RATIO = "0.01"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def times(a: Column | str, b: Column | str) -> Column:
    """Product of two stored decimals kept at scale 9, half-up; NULL if ``(28,9)`` cannot hold it.

    ``DECIMAL(28,9) * DECIMAL(28,9)`` would be typed ``(38,6)``, so the smaller factor is taken apart:
    its whole part in two pieces of at most six digits, and its fraction. Each partial product is exact.
    A product that fits has a smaller factor below 4.4e9.
    """
    x, y = _c(a).cast(PRICE), _c(b).cast(PRICE)
    big, small = F.when(F.abs(x) >= F.abs(y), x).otherwise(y), F.when(F.abs(x) >= F.abs(y), y).otherwise(x)
    size = F.abs(small)
    whole = F.floor(size)
    high = F.floor(whole / F.lit(100000)).try_cast("decimal(6,0)")
    low = (whole - high * F.lit(100000).cast("decimal(6,0)")).try_cast("decimal(5,0)")
    rest = (size - whole).cast("decimal(9,9)")
    part = (big * high).try_cast(PRICE) * F.lit(100000).cast("decimal(6,0)")
    total = part + big * low + (big * rest).try_cast(PRICE)
    return F.when(small < 0, -total).otherwise(total).try_cast(PRICE)


def position_value(quantity: Column | str, price: Column | str, accrued: Column | str) -> Column:
    unit = _c(price) + F.coalesce(_c(accrued), F.lit(0).cast(PRICE))
    return times(quantity, unit)


def cost_basis(quantity: Column | str, average_price: Column | str) -> Column:
    """NULL when the purchase price is unknown; a short position is legal."""
    return times(quantity, average_price)


def pnl(value: Column | str, basis: Column | str) -> Column:
    """NULL when either side is unknown, or if ``(28,9)`` cannot hold the difference."""
    return (_c(value) - _c(basis)).try_cast(PRICE)


def share(value: Column | str, total: Column | str) -> Column:
    """Part of a total; zero, without dividing, when the total is zero."""
    v, t = _c(value).cast(PRICE), _c(total).cast(PRICE)
    return F.when(t == 0, F.lit(0).cast("decimal(38,10)")).otherwise(v / t)


def percent(value: Column | str, base: Column | str) -> Column:
    """NULL when either side is unknown or the base is zero."""
    b = _c(base).cast(PRICE)
    return _c(value).cast(PRICE) / F.nullif(b, F.lit(0).cast(PRICE))


def ratio4(part: Column | str, whole: Column | str) -> Column:
    """Four digits, half-even; NULL instead of zero when there is nothing to divide by."""
    p, w = _c(part).cast("decimal(20,0)"), _c(whole).cast("decimal(20,0)")
    return F.when(w > 0, F.bround(p / w, 4).cast("decimal(18,4)"))


def collected_but_empty(coverage: Column | str, values: Column | str) -> Column:
    cov, val = _c(coverage), _c(values)
    return F.coalesce((cov > 0) & (val < F.lit(EMPTY_RATIO).cast("decimal(18,4)")), F.lit(False))


def age_seconds(captured_at: Column | str, now: Column) -> Column:
    """Whole seconds since the snapshot, never negative; NULL without a snapshot."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(_c(captured_at).cast("timestamp"))
    return F.when(micros.isNotNull(), F.greatest(F.lit(0), (micros / 1e6).cast("bigint")))


def stale_after(interval_seconds: Column | str) -> Column:
    return F.greatest(_c(interval_seconds) * STALE_FACTOR, F.lit(STALE_FLOOR_SECONDS))


def is_stale(captured_at: Column | str, now: Column, interval_seconds: Column | str) -> Column:
    """A missing snapshot is "no data yet", which is not the same as stale."""
    return F.coalesce(age_seconds(captured_at, now) > stale_after(interval_seconds), F.lit(False))


def run_seconds(started_at: Column | str, finished_at: Column | str) -> Column:
    """Whole seconds between both ends; NULL unless both are known."""
    micros = F.unix_micros(_c(finished_at).cast("timestamp")) - F.unix_micros(
        _c(started_at).cast("timestamp")
    )
    return (micros / 1e6).cast("bigint")


def decimal_text(c: Column | str) -> Column:
    return _c(c).cast("string")


def plan_action(delta: Column | str) -> Column:
    d = _c(delta)
    return F.when(d > 0, F.lit("buy")).when(d < 0, F.lit("sell")).otherwise(F.lit("keep"))


def mask_account(c: Column | str) -> Column:
    text = F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.when(text != "", F.concat(F.lit("•• "), F.right(text, F.lit(MASK_TAIL)))).otherwise(
        F.lit("••")
    )


def section_status(
    running: Column,
    gap: Column,
    paused: Column,
    failed: Column,
    queued: Column,
    data_ready: Column,
    last_success: Column,
) -> Column:
    """One word about the section: the first condition that asks for attention wins."""
    return (
        F.when(running, F.lit("running"))
        .when(gap > 0, F.lit("data_gap"))
        .when(paused, F.lit("paused"))
        .when(failed, F.lit("failed"))
        .when(queued > 0, F.lit("lagging"))
        .when(data_ready.isNotNull() & (data_ready == last_success), F.lit("up_to_date"))
        .otherwise(F.lit("waiting"))
    )


def shift_percent(c: Column | str) -> Column:
    """A fraction as a percentage, exact."""
    return (_c(c).cast(PRICE) * F.lit(100)).cast(PRICE)


def display_round(c: Column | str, digits: int) -> Column:
    """Half-up by magnitude, as shown to people."""
    return F.round(_c(c).cast(PRICE), digits).cast(f"decimal(38,{digits})")
