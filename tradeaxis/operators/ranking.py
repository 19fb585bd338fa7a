"""Ranking requests, answers and the registry of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeaxis.operators.dedup import insert_if_absent, latest_by
from tradeaxis.schema import PRICE

QUEUED, RUNNING, SUCCESS, RUN_FAILED = "queued", "running", "success", "failed"
RUN_KEY = ("asof_date", "dataset_digest", "model_id", "model_version")

# Fixed value: the most assets one request may carry.
MAX_ASSETS = 1000

ANSWER = (
    "input_digest STRING, model_id STRING, emulated BOOLEAN, "
    "items ARRAY<STRUCT<rank: STRING, asset_id: STRING, price_series_id: STRING, score: STRING>>, "
    "excluded ARRAY<STRUCT<asset_id: STRING, reason: STRING>>"
)


def rules(df: DataFrame, keep: Sequence[str], checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows of ``df`` that break a rule, one row per broken rule, in a single pass."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks])
    )
    return df.select(*keep, F.explode(broken).alias("rule"))


def request_violations(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """What makes a ranking request unusable: ``(request_id, rule, subject)``.

    An empty or oversized list, a blank identifier, an asset or series given twice.
    """
    blank = [
        (f"blank_{c}", F.trim(F.coalesce(c, F.lit(""))) == "")
        for c in ("asset_id", "price_series_id")
    ]
    blanks = rules(assets, ["request_id"], blank).withColumn("subject", F.lit("")).distinct()
    sizes = assets.groupBy("request_id").agg(F.count("*").alias("n"))
    sized = requests.select("request_id").join(sizes, "request_id", "left")
    n = F.coalesce("n", F.lit(0))
    counted = rules(
        sized, ["request_id"], [("empty", n == 0), ("too_many", n > MAX_ASSETS)]
    ).withColumn("subject", F.lit(""))
    out = blanks.unionByName(counted)
    for c in ("asset_id", "price_series_id"):
        twice = assets.groupBy("request_id", c).agg(F.count("*").alias("n")).filter("n > 1")
        out = out.unionByName(
            twice.select(
                "request_id",
                F.lit(f"duplicate_{c}").alias("rule"),
                F.coalesce(c, F.lit("")).alias("subject"),
            )
        )
    return out.select("request_id", "rule", "subject")


def parse_answers(responses: DataFrame, body: str = "body") -> DataFrame:
    """Answer bodies as columns; a body that is no JSON object has NULL everywhere."""
    rest = [c for c in responses.columns if c != body]
    parsed = responses.select(*rest, F.from_json(F.col(body), ANSWER).alias("_a"))
    return parsed.select(*rest, "_a.*")


def digest_mismatches(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers about other data than was sent."""
    sent = requests.select("request_id", F.col("digest").alias("sent_digest"))
    got = F.coalesce("input_digest", F.lit(""))
    return answers.join(sent, "request_id").filter(got != F.col("sent_digest"))


def items(answers: DataFrame) -> DataFrame:
    """Ranked rows with exact scores."""
    rows = answers.select("request_id", F.explode("items").alias("i"))
    return rows.select(
        "request_id",
        F.col("i.rank").try_cast("int").alias("rank"),
        "i.asset_id",
        "i.price_series_id",
        F.trim("i.score").try_cast(PRICE).alias("score"),
    )


def exclusions(answers: DataFrame) -> DataFrame:
    """Assets left out and why; no list is an empty list."""
    rows = answers.select("request_id", F.explode("excluded").alias("e"))
    return rows.select(
        "request_id",
        F.coalesce("e.asset_id", F.lit("")).alias("asset_id"),
        F.coalesce("e.reason", F.lit("")).alias("reason"),
    )


def unknown_assets(ranked: DataFrame, request_assets: DataFrame) -> DataFrame:
    """Ranked assets that were not in the request."""
    keys = ["request_id", "asset_id"]
    return ranked.join(request_assets.select(*keys).distinct(), keys, "left_anti")


def enqueue(runs: DataFrame, incoming: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Runs not registered under the same input yet; the first of a batch is created."""
    return insert_if_absent(runs, incoming, RUN_KEY, arrival)


def find_by_input(runs: DataFrame, inputs: DataFrame) -> DataFrame:
    return runs.join(inputs.select(*RUN_KEY).distinct(), list(RUN_KEY), "left_semi")


def result_rows(ranked: DataFrame) -> DataFrame:
    """The run row of a stored result: it is written after the items and carries their count."""
    return ranked.groupBy("run_id").agg(F.count("*").alias("included_asset_count"))


def readable_items(ranked: DataFrame, results: DataFrame) -> DataFrame:
    """Items of the runs that have as many of them as their run row says."""
    counted = result_rows(ranked).withColumnRenamed("included_asset_count", "_have")
    whole = results.join(counted, "run_id").filter(F.col("included_asset_count") == F.col("_have"))
    return ranked.join(whole.select("run_id"), "run_id", "left_semi")


def store_items(ranked: DataFrame, root: str, attempt: str) -> None:
    """The items of one attempt. Until its run rows are there nobody reads them."""
    ranked.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{root}/items")


def store_results(results: DataFrame, root: str, attempt: str, at: Column) -> None:
    """The run rows of one attempt; they go last and say how many items belong to each."""
    done = results.select(
        "run_id",
        F.lit(attempt).alias("attempt"),
        F.lit(SUCCESS).alias("status"),
        at.alias("finished_at"),
        F.col("included_asset_count").cast("bigint").alias("included_asset_count"),
    )
    done.write.mode("append").parquet(f"{root}/runs")


def stored_items(spark: SparkSession, root: str) -> DataFrame:
    """Items of the whole results: of the last attempt that has a run row, if none is missing.

    An attempt that ended between items and run row left items nobody names; a repeated one brings
    its own, so nothing is counted twice.
    """
    ranked = spark.read.parquet(f"{root}/items")
    runs = spark.read.parquet(f"{root}/runs").filter(F.col("status") == SUCCESS)
    last = latest_by(runs, ["run_id"], ["finished_at", "attempt"])
    named = ranked.join(last.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi")
    return readable_items(named, last).drop("attempt")


def run_states(log: DataFrame) -> DataFrame:
    """The present state of each run, folded from its event log in one aggregate.

    ``log`` is ``run_id, seq, kind, at, code, message, items``; a requeue raises the attempt and
    wipes the traces of the failure before it.
    """
    seq, kind = F.col("seq"), F.col("kind")
    folded = log.groupBy("run_id").agg(
        F.max_by(F.struct("kind", "at", "code", "message", "items"), seq).alias("last"),
        F.max(F.when(kind == "requeued", seq)).alias("requeued_seq"),
        F.max(F.when(kind == RUNNING, F.struct("seq", "at"))).alias("started"),
        F.count_if(kind == "requeued").alias("requeues"),
    )
    done = F.col("last.kind").isin(SUCCESS, RUN_FAILED)
    failed = F.col("last.kind") == RUN_FAILED
    fresh = F.col("requeued_seq").isNull() | (F.col("started.seq") > F.col("requeued_seq"))
    return folded.select(
        "run_id",
        F.when(F.col("last.kind") == "requeued", F.lit(QUEUED))
        .otherwise(F.col("last.kind"))
        .alias("status"),
        (F.col("requeues") + 1).alias("attempt"),
        F.when(fresh, F.col("started.at")).alias("started_at"),
        F.when(done, F.col("last.at")).alias("finished_at"),
        F.when(failed, F.col("last.code")).alias("error_code"),
        F.when(failed, F.col("last.message")).alias("error_message"),
        F.when(F.col("last.kind") == SUCCESS, F.col("last.items")).alias("included_asset_count"),
    )


def queue_progress(runs: DataFrame) -> DataFrame:
    """Dates done out of dates accepted, counted from the oldest one still waiting."""
    waiting = F.col("status").isin(QUEUED, RUNNING)
    oldest = runs.filter(waiting).agg(F.min("asof_date").alias("d")).scalar()
    counted = runs.agg(
        F.count_if(waiting).alias("pending"),
        F.count_if((F.col("status") == SUCCESS) & (F.col("asof_date") >= oldest)).alias(
            "completed"
        ),
    )
    return counted.select("completed", (F.col("completed") + F.col("pending")).alias("total"))


def top_items(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy("rank").limit(k)


def item_page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    return ranked.orderBy("rank").offset(offset).limit(limit)


def history_total(runs: DataFrame, status: str | None = None) -> DataFrame:
    chosen = runs if status is None else runs.filter(F.col("status") == status)
    return chosen.agg(F.count("*").alias("total"))


def history_page(runs: DataFrame, status: str | None, offset: int, limit: int) -> DataFrame:
    chosen = runs if status is None else runs.filter(F.col("status") == status)
    return chosen.orderBy(F.desc("asof_date"), F.desc("id")).offset(offset).limit(limit)


def latest_success(runs: DataFrame) -> DataFrame:
    """The successful run of the latest date; within a date the one finished last."""
    done = runs.filter(F.col("status") == SUCCESS)
    return _greatest(done, ["asof_date", "finished_at", "id"])


def latest_success_per_date(runs: DataFrame) -> DataFrame:
    done = runs.filter(F.col("status") == SUCCESS)
    return latest_by(done, ["asof_date"], ["finished_at", "id"])


def last_failure(runs: DataFrame) -> DataFrame:
    return _greatest(runs.filter(F.col("status") == RUN_FAILED), ["finished_at", "id"])


def _greatest(runs: DataFrame, order: Sequence[str]) -> DataFrame:
    row = F.struct(*[F.col(c) for c in runs.columns])
    picked = runs.agg(F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("r"))
    return picked.filter("r IS NOT NULL").select("r.*")


def pending_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin(QUEUED, RUNNING)).orderBy("asof_date", "id")


def run_detail(
    runs: DataFrame, page: DataFrame, staleness: DataFrame, available: DataFrame
) -> DataFrame:
    """A run with a page of its items, its staleness and whether its input still exists.

    Staleness that was not computed stays NULL, which is not "fresh".
    """
    return (
        runs.join(available.select("id", "dataset_available"), "id", "left")
        .join(staleness.select("id", "stale"), "id", "left")
        .join(page.withColumnRenamed("run_id", "id"), "id", "left")
    )
