"""Futures positions: which contract to ask for, which pairs are still open, what may be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeaxis.functions import parse
from tradeaxis.operators.store import filled
from tradeaxis.schema import POSITION_VALUES


def contract_map(series: DataFrame, open_interest: DataFrame) -> DataFrame:
    """Share ticker to contract: the asset code with the most open interest, then the smaller code.

    A code without known interest counts as zero.
    """
    pairs = (
        series.select(
            parse.ticker("underlying_asset").alias("ticker"),
            parse.ticker("asset_code").alias("asset_code"),
        )
        .filter("ticker IS NOT NULL AND asset_code IS NOT NULL")
        .distinct()
    )
    weighed = pairs.join(open_interest, "asset_code", "left").withColumn(
        "oi", F.coalesce("open_interest", F.lit(0))
    )
    best = weighed.groupBy("ticker").agg(
        F.min_by("asset_code", F.struct((-F.col("oi")).alias("o"), "asset_code")).alias("code")
    )
    return best.select("ticker", F.concat("code", F.lit(parse.CONTRACT_SUFFIX)).alias("contract"))


#: Sessions in a word of a bitmap.
BITS = 63


def existed_then(pairs: DataFrame, first_filled: DataFrame, discovered: DataFrame) -> DataFrame:
    """Whether an instrument may be asked about a session.

    The first filled session is a lower bound only: later sessions are asked without a probe. For
    earlier ones the discovered first date decides, and not knowing is no reason not to ask.
    ``discovered`` is ``contract, searched, first_available``.
    """
    joined = pairs.join(first_filled, "asset_id", "left").join(discovered, "contract", "left")
    known = F.coalesce(F.col("session_date") >= F.col("first_date"), F.lit(False))
    found = F.col("first_available")
    searched = F.coalesce("searched", F.lit(False))
    existed = (
        F.when(known, F.lit(True))
        .when(found.isNotNull(), F.col("session_date") >= found)
        .otherwise(~searched)
    )
    return joined.withColumn("existed", existed)


def filled_sessions(positions: DataFrame, axis: DataFrame) -> DataFrame:
    """``(asset_id, first_date, words)``: the sessions of ``axis (session_date, idx)`` an asset is filled at, as bits.

    ``words`` maps a word's number to 63 sessions. The facts leave their tasks as one row per asset and word.
    """
    done = positions.filter(filled(POSITION_VALUES)).select("asset_id", "session_date")
    placed = done.join(F.broadcast(axis), "session_date", "left")  # as long as the calendar
    word, bit = F.floor(F.col("idx") / BITS).cast("int"), F.expr(f"shiftleft(1L, cast(idx % {BITS} as int))")
    per = placed.groupBy("asset_id", word.alias("word")).agg(F.bit_or(F.coalesce(bit, F.lit(0).cast("long"))).alias("bits"), F.min("session_date").alias("first"))
    known = F.filter(F.collect_list(F.struct("word", "bits")), lambda x: x["word"].isNotNull())
    return per.groupBy("asset_id").agg(F.min("first").alias("first_date"), F.map_from_entries(known).alias("words"))


def work_list(
    days: DataFrame,
    tickers: DataFrame,
    contracts: DataFrame,
    positions: DataFrame,
    discovered: DataFrame,
) -> DataFrame:
    """Pairs to ask: known tickers with a contract, not filled yet, not before they existed.

    ``days`` is a list of sessions to collect, as long as the calendar at most. The open sessions of a ticker are
    the complement of its filled ones within its lifetime (:func:`existed_then`), so a pair becomes a row only if
    it is to be asked.
    """
    wanted = tickers.select("ticker").distinct().join(contracts, "ticker").withColumn("asset_id", parse.asset_id("ticker"))
    listed = days.agg(F.array_sort(F.collect_set("session_date")).alias("all"))
    axis = listed.select(F.posexplode("all").alias("idx", "session_date"))
    joined = wanted.join(filled_sessions(positions, axis), "asset_id", "left").join(discovered, "contract", "left")
    found, never = F.col("first_available"), F.lit("9999-12-31").cast("date")
    since = (
        F.when(found.isNotNull(), F.least("first_date", found))
        .when(F.coalesce("searched", F.lit(False)), F.coalesce("first_date", never))
        .otherwise(F.lit("0001-01-01").cast("date"))
    )
    have = joined.select("asset_id", "ticker", "contract", "words", since.alias("since"), listed.scalar().alias("all"))
    places = F.sequence(F.lit(0), F.greatest(F.size("all"), F.lit(1)) - 1)

    def is_open(i: Column) -> Column:
        word = F.coalesce(F.try_element_at("words", F.floor(i / BITS).cast("int")), F.lit(0).cast("long"))
        return (F.get("all", i) >= F.col("since")) & (F.getbit(word, (i % BITS).cast("int")) == 0)

    open_ = have.withColumn("idx", F.explode(F.filter(places, is_open)))
    return open_.select("asset_id", "ticker", "contract", F.get("all", "idx").alias("session_date"))


def observed(rows: DataFrame) -> DataFrame:
    """Empty rows are not stored: they would make the pair look collected."""
    return rows.filter(filled(POSITION_VALUES))


def session_outcome(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Per session: asked pairs, filled rows, and a failure when pairs were asked and none filled."""
    requested = asked.groupBy("session_date").agg(F.count("*").alias("requested"))
    got = observed(rows).groupBy("session_date").agg(F.count("*").alias("filled"))
    joined = requested.join(got, "session_date", "left").withColumn(
        "filled", F.coalesce("filled", F.lit(0))
    )
    failed = (F.col("requested") > 0) & (F.col("filled") == 0)
    return joined.withColumn(
        "outcome", F.when(failed, F.lit("failed_empty")).otherwise(F.lit("ok"))
    )
