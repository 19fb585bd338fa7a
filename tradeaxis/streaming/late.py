"""Late arrivals and journal progress as Structured Streaming micro-batches.

An observation is keyed by its own date and may arrive at any time, so no watermark drops it. A
micro-batch is written to its own folder of a log, named by the batch id: a batch that is run again
after a failure overwrites exactly what it wrote before, and nothing is rewritten per batch. Reading
folds the log by key, the later batch over the earlier one; compaction does the same fold once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tradeaxis.config import QUOTES_SOURCE
from tradeaxis.operators.dedup import latest_by, upsert
from tradeaxis.operators.journal import FAILED
from tradeaxis.operators.store import exists
from tradeaxis.session import discard

BATCH = "batch_id"


def start_upserts(
    stream: DataFrame, log: str, checkpoint: str, available_now: bool = True, mode: str = "append"
) -> StreamingQuery:
    """Writes every micro-batch of ``stream`` below ``log``, exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/{BATCH}={batch_id}")

    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def read_upserts(
    spark: SparkSession, log: str, schema: T.StructType, keys: Sequence[str], arrival: Sequence[str]
) -> DataFrame:
    """The present row of each key: the last batch wins, inside a batch the last arrival."""
    logged = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    rows = spark.read.schema(logged).parquet(log)
    return latest_by(rows, keys, [BATCH, *arrival]).drop(BATCH)


def compact(
    spark: SparkSession,
    log: str,
    target: str,
    schema: T.StructType,
    keys: Sequence[str],
    arrival: Sequence[str],
    partition: str = "session_date",
) -> None:
    """Folds the log over the sessions it touches, clustered by key, and empties the log.

    The merged sessions are first written beside the table, whole, with the numbers of the batches that went into
    them. Only then do they replace their partitions; after that the batches leave the log, and the copy goes
    last. A run that is lost at any point is finished by the next one: a whole copy is put in place again, half
    a copy is thrown away. Sessions the log does not name are neither read nor written.
    """
    pending = f"{target}.pending"
    if exists(spark, f"{pending}/batches/_SUCCESS"):
        _put_in_place(spark, log, target, schema, partition)
    discard(spark, pending)
    logged = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    rows = spark.read.schema(logged).parquet(log)
    done = [(r[0],) for r in rows.select(BATCH).distinct().collect()]  # a number per batch since the last compaction
    if not done:
        return
    tail = read_upserts(spark, log, schema, keys, arrival)
    merged = tail
    if exists(spark, target):
        days = [r[0] for r in rows.select(partition).distinct().collect()]  # the days that arrived, as literals for the scan
        here = F.col(partition).isin([x for x in days if x is not None])
        stored = spark.read.schema(schema).parquet(target)
        touched = stored.filter(here | F.col(partition).isNull() if None in days else here)
        merged = upsert(touched, tail.withColumn("_n", F.lit(1)), keys, ["_n"])
    others = [k for k in keys if k != partition]
    _by_session(merged, partition, others).write.partitionBy(partition).parquet(f"{pending}/rows")
    spark.createDataFrame(done, f"{BATCH} long").write.parquet(f"{pending}/batches")
    _put_in_place(spark, log, target, schema, partition)
    discard(spark, pending)


def _by_session(rows: DataFrame, partition: str, others: Sequence[str]) -> DataFrame:
    return rows.hint("rebalance", partition).sortWithinPartitions(partition, *others)


def _put_in_place(spark: SparkSession, log: str, target: str, schema: T.StructType, partition: str) -> None:
    """The whole copy over its partitions of the table, then its batches out of the log; may be repeated."""
    pending = f"{target}.pending"
    rows = spark.read.schema(schema).parquet(f"{pending}/rows")
    others = [f.name for f in schema.fields if f.name != partition][:1]
    writer = _by_session(rows, partition, others).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition).parquet(target)
    for row in spark.read.parquet(f"{pending}/batches").collect():
        discard(spark, f"{log}/{BATCH}={row[0]}")


def read_current(
    spark: SparkSession,
    log: str,
    target: str,
    schema: T.StructType,
    keys: Sequence[str],
    arrival: Sequence[str],
) -> DataFrame:
    """The compacted table with the rest of the log laid over it: one row per key."""
    tail = read_upserts(spark, log, schema, keys, arrival)
    if not exists(spark, target):
        return tail
    stored = spark.read.schema(schema).parquet(target)
    return upsert(stored, tail.withColumn("_n", F.lit(1)), keys, ["_n"])


def session_outcomes(journal_stream: DataFrame, run_key: str = "run_id") -> DataFrame:
    """Running state per run and session: the latest quotes outcome seen so far.

    State is one row per run and session; partial aggregation folds each batch before the shuffle.
    """
    quotes = journal_stream.filter(F.col("source_id") == QUOTES_SOURCE)
    return quotes.groupBy(run_key, "session_date").agg(
        F.max_by("status", F.struct("started_at", "id")).alias("status")
    )


def progress_of(outcomes: DataFrame, requested: DataFrame, run_key: str = "run_id") -> DataFrame:
    """Requested, closed, failed and remaining sessions per run, from folded outcomes."""
    state = requested.join(outcomes, [run_key, "session_date"], "left")
    counted = state.groupBy(run_key).agg(
        F.count("*").alias("requested"),
        F.count_if(F.col("status") != FAILED).alias("closed"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
    )
    left = F.col("requested") - F.col("closed") - F.col("failed")
    return counted.withColumn("remaining", F.greatest(left, F.lit(0)))
