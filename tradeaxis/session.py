"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tradeaxis", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators count on.

    Only semantics-bearing and adaptive settings are fixed. Partition counts come from the cluster
    or from ``conf``; adaptive execution coalesces them and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a folder exists on
    one machine and is lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tradeaxis-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def local_frame(spark: SparkSession, rows: Sequence[tuple], **columns: pa.DataType) -> DataFrame:
    """A handful of known rows as a relation inside the plan: no job, exact size."""
    data = {
        name: pa.array([row[i] for row in rows], type=kind)
        for i, (name, kind) in enumerate(columns.items())
    }
    return spark.createDataFrame(pa.table(data))


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder of the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: What a job shuffled goes when the job ends, not when the driver's memory happens to be collected.
SHORT_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written once to the shared folder and read back.

    Several uses then share one computation, a lost executor costs a re-read instead of the whole
    lineage, and later joins are planned on the size of the files rather than on a guess.
    """
    return staged_at(df, scratch_path(df.sparkSession, purpose))


def staged_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a path of the caller's, who may discard it."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
