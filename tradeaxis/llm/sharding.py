"""Global shuffle into shards, in two passes over buckets that fit in memory.

First pass: records are scattered by a seeded hash of id and text into as many buckets as it takes for each
to hold about ``BUCKET_BYTES``, and the buckets are counted. Second pass: every bucket gets a Fisher-Yates
permutation of its places, its records take their places in it, and the shuffled buckets one after another
are the shuffled corpus, cut into shards whose counts differ by one at most. The permutations are written
before they are used, so a retried task finds the same ones.

The permutations are drawn in ``ceil(buckets / DRAWN)`` partitions, bucket after bucket, from the seed and the
number of the partition. Both follow from the input, so the order depends on rows and seed alone, not on the
session's number of shuffle partitions. Records are dealt to tasks by bucket, ``PER_TASK`` buckets on average.

Native: columns and windows only. Records cross the network once; ordering a bucket can spill. Records of one
id or text are scattered by both, so a hot id, text or source makes no hot bucket; only rows equal in both
meet in one. Rows equal in both are told apart by a hash of their other columns.

Defined results: a null text has no bytes; null ids are ids; equal rows each get a slot. An empty table
gives no shard. Other columns are kept inside ``record``, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeaxis.session import staged

BUCKET_BYTES = 8 << 20
OVERHEAD = 16
SEED = 9
#: Buckets whose permutations one partition draws, and buckets that one writing task holds on average.
DRAWN = 256
PER_TASK = 1
#: Beyond this many tasks each takes more buckets; sorting them spills.
MOST_TASKS = 20_000


def size_of(text) -> F.Column:
    """Bytes of a record: UTF-8 text and a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def write(docs: DataFrame, path: str, shards: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes ``(slot, record)`` by ``shard`` below ``path``."""
    total = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size_of(text_col)), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-total["bytes"] // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), id_col, text_col)
    bucket = F.pmod(F.shiftright(hashed, 8), F.lit(buckets))

    # a row per bucket: where it begins, by sums over blocks of buckets, and its permutation
    counted = docs.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"bucket div {DRAWN}"))
    blocks = counted.groupBy("block").agg(F.sum("n").alias("rows"))
    ahead = blocks.select("block", (F.sum("rows").over(Window.orderBy("block")) - F.col("rows")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")
    begins = counted.withColumn("inside", inside).join(ahead, "block").withColumn("first", F.col("ahead") + F.col("inside"))
    dealt = begins.select("bucket", "first", "n").repartition(-(-buckets // DRAWN), "bucket").sortWithinPartitions("bucket")
    plan = staged(dealt.withColumn("places", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), seed)).select("bucket", "first", "places"), "buckets")

    tasks = min(MOST_TASKS, -(-buckets // PER_TASK))
    # maps have no hash; as text they have one
    told = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col)]
    other = F.xxhash64(F.lit(seed), *told)
    records = docs.select(bucket.alias("bucket"), hashed.alias("hash"), other.alias("other"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    order = Window.partitionBy("bucket").orderBy("hash", "other")
    numbered = records.repartition(tasks, "bucket").withColumn("nth", F.row_number().over(order))
    at = F.col("first") + F.element_at("places", F.col("nth"))
    rows = max(1, total["rows"])
    shard = F.expr(f"(at * {shards}) div {rows}")
    begin = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    placed = numbered.join(plan, "bucket").select(at.alias("at"), "record")
    out = placed.withColumn("shard", shard).withColumn("slot", F.col("at") - begin)
    out.select(F.col("shard").cast("int").alias("shard"), "slot", "record").write.partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """``(shard, slot, record)`` of a written shuffle of frames like ``like``."""
    record = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in like.schema.fields)
    return spark.read.schema(f"slot long, record struct<{record}>, shard int").parquet(path)
