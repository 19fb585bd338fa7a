"""The immutable input of a decision date: dense arrays on a session axis, and their digest.

A series is folded to one row per session first, then to one array of at most a window's length, so
no aggregation buffer can outgrow the window whatever the input holds. The array is laid out with
``sequence`` over the axis; no row is generated for a session nobody observed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeaxis.config import Settings
from tradeaxis.functions import parse
from tradeaxis.operators import calendar as cal
from tradeaxis.operators import completeness as comp
from tradeaxis.operators.calendar import SessionWindow
from tradeaxis.operators.journal import OK
from tradeaxis.operators.store import exists
from tradeaxis.session import discard, local_frame, scratch_path
from tradeaxis.schema import AGGREGATE_VALUES, BAR_VALUES, POSITION_VALUES

PARTS = ("prices", "aggregates", "global", "positions", "sectors", "incomplete")


def dense_axis(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    window: SessionWindow,
    scalar: bool = False,
) -> DataFrame:
    """Per series one array with an entry for every session of the window.

    An entry is an array of decimal texts in the order of ``values`` (the text alone when
    ``scalar``); a session without an observation holds NULLs. Exact duplicates of a key and session
    are folded by their greatest row, so the result does not depend on row order.
    """
    text = [F.col(v).cast("string").alias(v) for v in values]
    axis = F.broadcast(window.axis(df.sparkSession))
    rows = (
        df.filter(window.contains())
        .join(axis, "session_date")
        .select(*keys, "idx", F.struct(*text).alias("v"))
        .groupBy(*keys, "idx")
        .agg(F.max("v").alias("v"))
    )
    folded = rows.groupBy(*keys).agg(F.collect_list(F.struct("idx", "v")).alias("have"))

    def values_of(entry: Column) -> Column:
        cell = entry["v"]
        if scalar:
            return cell[values[0]]
        return F.array(*[cell[v] for v in values])

    # the slots without an observation join the others, and sorting by slot lays the axis out
    slots = F.sequence(F.lit(0), F.lit(max(len(window) - 1, 0)))
    kind = rows.schema["v"].dataType
    unseen = F.transform(
        F.array_except(slots, F.transform("have", lambda e: e["idx"].cast("int"))),
        lambda i: F.struct(i.cast(rows.schema["idx"].dataType).alias("idx"), F.lit(None).cast(kind).alias("v")),
    )
    laid = F.array_sort(F.concat("have", unseen))
    return folded.select(*keys, F.transform(laid, values_of).alias("rows"))


def prices(bars: DataFrame, window: SessionWindow) -> DataFrame:
    return dense_axis(bars, ["asset_id", "price_series_id"], BAR_VALUES, window)


def aggregates(df: DataFrame, window: SessionWindow) -> DataFrame:
    return dense_axis(df, ["asset_id", "price_series_id"], AGGREGATE_VALUES, window)


def positions(df: DataFrame, window: SessionWindow) -> DataFrame:
    return dense_axis(df, ["asset_id"], POSITION_VALUES, window)


def global_series(df: DataFrame, window: SessionWindow) -> DataFrame:
    return dense_axis(df, ["series_id"], ["value"], window, scalar=True)


def asset_list(bars: DataFrame, window: SessionWindow) -> DataFrame:
    pairs = bars.filter(window.contains()).select("asset_id", "price_series_id").distinct()
    return pairs.orderBy("asset_id", "price_series_id")


def windows_of(calendar: DataFrame, asof: dt.date, settings: Settings) -> dict[str, SessionWindow]:
    depths = {
        "prices": settings.price_window,
        "aggregates": settings.price_window,
        "global": settings.global_window,
        "positions": settings.positions_window,
    }
    return cal.windows(calendar, asof, depths)


def window_depths(spark: SparkSession, windows: Mapping[str, SessionWindow]) -> DataFrame:
    """Sessions actually found per part: fewer than asked for at the start of history."""
    rows = [(part, len(w), w.first, w.last) for part, w in sorted(windows.items())]
    return local_frame(
        spark,
        rows,
        part=pa.string(),
        sessions=pa.int32(),
        window_from=pa.date32(),
        window_till=pa.date32(),
    )


def incomplete_declaration(
    missing: DataFrame, unfinished: DataFrame, window: SessionWindow
) -> DataFrame:
    """Unfinished sources per session of the price window; no rows states that it is full."""
    return comp.incomplete_by_session(missing, unfinished).filter(window.contains())


def preconditions(
    calendar: DataFrame, bars: DataFrame, asof: dt.date, window: SessionWindow
) -> DataFrame:
    """Why a dataset cannot be built for the date, or NULL."""
    is_session = (
        calendar.filter(F.col("session_date") == F.lit(asof))
        .agg((F.count("*") > 0).alias("x"))
        .scalar()
    )
    has_bars = bars.filter(window.contains()).limit(1).agg((F.count("*") > 0).alias("x")).scalar()
    one = calendar.sparkSession.range(1)
    reason = F.when(~is_session, F.lit("not_a_session")).when(~has_bars, F.lit("no_bars"))
    return one.select(F.lit(asof).alias("asof_date"), reason.alias("reason"))


def series_hashes(parts: Mapping[str, DataFrame]) -> DataFrame:
    """``(part, key, hash)``: every series hashed on its own, where it lies."""
    hashed = []
    for part, df in parts.items():
        content = [c for c in df.columns if c in ("rows", "sector", "sources")]
        keys = [c for c in df.columns if c not in content]
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        # A struct with one field keeps a NULL value apart from an absent series.
        body = F.to_json(F.struct(content[0]), {"ignoreNullFields": "false"})
        hashed.append(
            df.select(F.lit(part).alias("part"), key.alias("key"), F.sha2(body, 256).alias("hash"))
        )
    return reduce(DataFrame.unionByName, hashed)


def digest(hashes: DataFrame, header: str) -> DataFrame:
    """One digest over all series, whatever their order and partitioning.

    Series go to leaves by the hash of their name, leaves to 256 branches, branches to the root. A
    leaf holds one 65 536th of the series, so no task ever sees the whole list.
    """
    line = F.concat_ws("=", F.concat_ws("/", "part", "key"), "hash")
    named = hashes.select(
        F.substring(F.sha2(F.concat_ws("/", "part", "key"), 256), 1, 4).alias("node"),
        line.alias("line"),
    )
    for width in (2, 0):
        named = _fold(named, ["node"]).select(
            F.substring("node", 1, width).alias("node"),
            F.concat_ws("=", "node", "hash").alias("line"),
        )
    root = _fold(named, [])
    return root.select(F.sha2(F.concat_ws("\n", F.lit(header), "hash"), 256).alias("digest"))


def store_tree(hashes: DataFrame, path: str) -> None:
    """Keeps the nodes of the digest's tree below ``path``: series and leaves by branch, and the branches."""
    line = F.concat_ws("=", F.concat_ws("/", "part", "key"), "hash")
    node = F.substring(F.sha2(F.concat_ws("/", "part", "key"), 256), 1, 4)
    series = hashes.select("part", "key", "hash", node.alias("node"), F.substring(node, 1, 2).alias("branch"))
    series.hint("rebalance", "branch").write.partitionBy("branch").parquet(f"{path}/series")
    kept = hashes.sparkSession.read.schema(_SERIES).parquet(f"{path}/series")
    leaves = _fold(kept.select("branch", "node", line.alias("line")), ["branch", "node"])
    leaves.write.partitionBy("branch").parquet(f"{path}/leaves")
    kept = hashes.sparkSession.read.schema(_LEAVES).parquet(f"{path}/leaves")
    _fold(kept.select("branch", F.concat_ws("=", "node", "hash").alias("line")), ["branch"]).coalesce(1).write.parquet(f"{path}/branches")


_SERIES = "part string, key string, hash string, node string, branch string"
_LEAVES = "node string, hash string, branch string"


def changed_series(spark: SparkSession, before: str, after: str) -> DataFrame:
    """``(part, key, change)``: the series that differ between two kept trees: added, removed or changed.

    Branches are compared first, then the leaves of those that differ, then the series of the leaves that
    differ; what is equal is not read. At most 256 branch names are listed.
    """

    def differing(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
        left = a.select(*keys, F.col("hash").alias("was"))
        right = b.select(*keys, F.col("hash").alias("now"))
        return left.join(right, list(keys), "full").filter(~F.col("was").eqNullSafe(F.col("now")))

    def read(name: str, schema: str) -> tuple[DataFrame, DataFrame]:
        return tuple(spark.read.schema(schema).parquet(f"{path}/{name}") for path in (before, after))

    names = [r.branch for r in differing(*read("branches", "branch string, hash string"), ["branch"]).select("branch").collect()]
    here = F.col("branch").isin(names)
    nodes = differing(*[x.filter(here) for x in read("leaves", _LEAVES)], ["branch", "node"]).select("branch", "node")
    series = [x.filter(here).join(nodes, ["branch", "node"], "left_semi") for x in read("series", _SERIES)]
    change = F.when(F.col("was").isNull(), F.lit("added")).when(F.col("now").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    return differing(*series, ["part", "key"]).select("part", "key", change.alias("change"))


def _fold(df: DataFrame, by: Sequence[str]) -> DataFrame:
    body = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return df.groupBy(*by).agg(F.sha2(body, 256).alias("hash"))


def header(asof: dt.date, windows: Mapping[str, SessionWindow]) -> str:
    """The date and every axis; the moment of building is not part of the content."""
    axes = [
        f"{part}:{','.join(d.isoformat() for d in windows[part].dates)}" for part in sorted(windows)
    ]
    return "\n".join([asof.isoformat(), *axes])


def build_parts(
    tables: Mapping[str, DataFrame],
    calendar: DataFrame,
    journal: DataFrame,
    asof: dt.date,
    settings: Settings,
) -> tuple[dict[str, DataFrame], dict[str, SessionWindow]]:
    windows = windows_of(calendar, asof, settings)
    catchup = windows["prices"] if settings.catchup_depth == settings.price_window else None
    missing, unfinished, _ = comp.gap_report(
        calendar, tables["bar"], journal, asof, settings, catchup
    )
    parts = {
        "prices": prices(tables["bar"], windows["prices"]),
        "aggregates": aggregates(tables["aggregate"], windows["aggregates"]),
        "global": global_series(tables["global_series"], windows["global"]),
        "positions": positions(tables["position"], windows["positions"]),
        "sectors": tables["sector"].select("asset_id", "sector"),
        "incomplete": incomplete_declaration(missing, unfinished, windows["prices"]),
    }
    return parts, windows


def manifest(
    asof: dt.date,
    digest_df: DataFrame,
    windows: Mapping[str, SessionWindow],
    incomplete: DataFrame,
    assets: DataFrame,
) -> DataFrame:
    """One row describing the dataset; ``incomplete`` is always there, empty when full.

    Its list is bounded by the price window. The assets stay a table of their own and are counted.
    """
    listed = F.array_sort(F.collect_list(F.struct("session_date", "sources")))
    declared = incomplete.agg(listed.alias("x")).scalar()
    count = assets.agg(F.count("*").alias("x")).scalar()
    return digest_df.select(
        F.lit(asof).alias("asof_date"),
        F.concat(F.lit("sha256:"), "digest").alias("digest"),
        *[F.lit(len(w)).alias(f"{part}_sessions") for part, w in sorted(windows.items())],
        declared.alias("incomplete"),
        F.lit(len(windows["prices"])).alias("session_count"),
        count.alias("asset_count"),
    )


def dataset_name(asof: dt.date, digest_hex: str) -> str:
    return f"{asof.isoformat()}-{digest_hex[:16]}"


def materialise(
    spark: SparkSession,
    root: str,
    tables: Mapping[str, DataFrame],
    calendar: DataFrame,
    journal: DataFrame,
    asof: dt.date,
    settings: Settings,
) -> tuple[str, str, bool]:
    """Writes the dataset once; returns its path, digest and whether it was written now.

    A date that is no session, or whose window has no bars, is refused. The parts are staged in the
    shared folder while the digest is taken, and written from there. The path is named by the digest
    and the manifest goes last, so a dataset whose manifest exists is whole, and an equal one is never
    written again; if another digest begins alike, the whole digest names the path.
    """
    windows = windows_of(calendar, asof, settings)
    reason = preconditions(calendar, tables["bar"], asof, windows["prices"]).first().reason
    if reason:
        raise ValueError(f"no dataset for {asof}: {reason}")
    parts, windows = build_parts(tables, calendar, journal, asof, settings)
    kept, copies = {}, []
    for name, df in parts.items():
        copies.append(scratch_path(spark, f"part-{name}"))
        df.write.parquet(copies[-1])
        kept[name] = spark.read.schema(df.schema).parquet(copies[-1])
    try:
        value = digest(series_hashes(kept), header(asof, windows)).first().digest
        path = f"{root.rstrip('/')}/{dataset_name(asof, value)}"
        if exists(spark, f"{path}/manifest"):
            if spark.read.parquet(f"{path}/manifest").first().digest == f"sha256:{value}":
                return path, value, False
            path = f"{root.rstrip('/')}/{asof.isoformat()}-{value}"
            if exists(spark, f"{path}/manifest"):
                return path, value, False
        for name, df in kept.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = local_frame(spark, [(value,)], digest=pa.string())
        assets = kept["prices"].select("asset_id", "price_series_id")
        described = manifest(asof, row, windows, kept["incomplete"], assets)
        stamped = described.withColumn("materialized_at", F.current_timestamp())
        stamped.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        return path, value, True
    finally:
        for copy in copies:
            discard(spark, copy)


def expired(registry: DataFrame, now: Column, retention_days: int) -> DataFrame:
    """Datasets past their keeping time; a name that is no dated dataset is left alone."""
    asof = parse.iso_date(F.substring("name", 1, 10))
    cutoff = F.date_sub(F.to_date(now), retention_days)
    return registry.withColumn("asof_date", asof).filter(F.col("asof_date") < cutoff)


def availability(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Whether the input of each run still exists."""
    known = registry.select(F.col("ref").alias("dataset_ref")).distinct()
    marked = known.withColumn("_there", F.lit(True))
    return (
        runs.join(marked, "dataset_ref", "left")
        .withColumn("dataset_available", F.col("_there").isNotNull())
        .drop("_there")
    )


def not_yet_built(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Equal content means equal digest means nothing to write."""
    return candidates.join(registry.select("digest").distinct(), "digest", "left_anti")


def collected_after(journal: DataFrame, moment: Column, exclude_sources: Sequence[str] = ()) -> Column:
    """Whether anything may have been written after ``moment``: one aggregate serves all moments.

    A run that has not finished may be writing now; one that wrote nothing changed nothing.
    """
    done = journal.filter(F.col("status") == OK)
    if exclude_sources:
        done = done.filter(~F.col("source_id").isin(list(exclude_sources)))
    marks = done.agg(
        F.coalesce(F.bool_or(F.col("finished_at").isNull()), F.lit(False)).alias("open"),
        F.max(F.when(F.col("rows_written") > 0, F.col("finished_at"))).alias("last"),
    )
    last = marks.select("last").scalar()
    return marks.select("open").scalar() | F.coalesce(last > moment, F.lit(False))


def is_stale(
    collected: Column,
    recorded: tuple[Column, Column],
    current: tuple[Column, Column],
    stored_digest: Column,
    current_digest: Column,
) -> Column:
    """Whether the input changed since a run.

    Nothing collected since and the same window ends prove it did not. Otherwise digests decide,
    and a dataset that cannot be built any more (NULL digest) makes no run stale.
    """
    same_window = F.coalesce(
        (recorded[0] == current[0]) & (recorded[1] == current[1]), F.lit(False)
    )
    proven = ~collected & same_window
    return F.when(proven, F.lit(False)).otherwise(
        F.coalesce(current_digest != stored_digest, F.lit(False))
    )
