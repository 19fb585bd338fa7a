"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Layout below one folder:

- ``ids/*.bin``: a 32-byte header (magic, id width, records, ids), the raw ids of all records one after
  another (little-endian, 2 bytes if the vocabulary allows, else 4), then the record lengths (8 bytes each);
- ``shards``: Parquet, one row per shard file in order, with the number of ids before it;
- ``index/*.mph``: for each bucket of keys a minimal perfect hash and its entries (fingerprint, shard, record
  number, first id and length of the key's first record, and where its last record ends). A lookup reads one
  entry and compares the fingerprint.

Records are in ascending key order across the shards (null first, equal keys by the hash of their text, so
reruns agree); a range shuffle deals them out, and its second column splits a key with very many rows.
Shards and index buckets are bounded in size, whatever the input. Files carry a name of their own per task
attempt and count only once a committed Parquet row names them, so a lost executor leaves nothing half
written in the result.

Defined results: a null or empty text is the end id alone. A null key is a key. Rows with one key are
records next to each other under one index entry. An empty table gives no shard and no index file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tradeaxis.llm import textops
from tradeaxis.llm.wordpieces import Encoder

SHARD_BYTES = 16 << 20
BUCKET_KEYS = 1 << 18
_HEADER = struct.Struct("<8sIIQQ")
_MAGIC, _INDEX_MAGIC = b"IDSHARD1", b"IDINDEX1"
_FIELDS = ("shard", "last", "record", "tail", "first", "length")
_ENTRY = np.dtype([("print", "<u8"), *((name, "<i8") for name in _FIELDS)])
_RECORDS = "doc_id {key}, hash long, print long, file string, part int, seq int, record long, first long, length long"


def _open(path: str, mode: str):
    """A file of the shared folder, wherever that is."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_output_stream(place) if mode == "w" else system.open_input_file(place)


def _make_folder(path: str) -> None:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place, recursive=True)


class _Shard:
    """One shard file being filled."""

    def __init__(self, folder: str, width: int):
        self.path = f"{folder}/ids/{uuid.uuid4().hex}.bin"
        self.width, self.parts, self.lengths, self.ids = width, [], [], 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.parts.append(ids.astype(f"<u{self.width}"))
        self.lengths.append(lengths)
        self.ids += len(ids)

    def close(self) -> None:
        lengths = np.concatenate(self.lengths).astype("<u8")
        with _open(self.path, "w") as out:
            out.write(_HEADER.pack(_MAGIC, self.width, 0, len(lengths), self.ids))
            for part in self.parts:
                out.write(part.tobytes())
            out.write(lengths.tobytes())


def _with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The ids of all records with the end id after each."""
    return np.insert(ids, np.cumsum(counts), end)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> None:
    """Encodes every text, writes the shards in key order, then the shard table and the index."""
    spark = docs.sparkSession
    for part in ("ids", "index"):
        _make_folder(f"{folder}/{part}")
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    key = docs.schema[id_col].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        shard = _Shard(folder, width)
        rows: list[pa.RecordBatch] = []
        for batch in batches:
            names: list[str] = []
            numbers: list[np.ndarray] = []
            ready: list[_Shard] = []
            for i, ids, counts in encoder.encode(batch.column(3)):
                lengths = counts + 1
                first = shard.ids + np.cumsum(lengths) - lengths
                record = sum(map(len, shard.lengths)) + np.arange(len(lengths))
                shard.add(_with_end(ids, counts, end_id), lengths)
                names += [shard.path] * len(lengths)
                numbers.append(np.stack((np.full(len(lengths), seq), record, first, lengths)))
                if shard.ids * width >= shard_bytes:
                    ready.append(shard)
                    shard, seq = _Shard(folder, width), seq + 1
            for full in ready:
                full.close()
            if batch.num_rows:
                n = np.concatenate(numbers, axis=1)
                columns = [*batch.columns[:3], pa.array(names), pa.array(np.full(len(names), part), pa.int32()), pa.array(n[0], pa.int32()), *(pa.array(x, pa.int64()) for x in n[1:])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "print", "file", "part", "seq", "record", "first", "length"])
        if shard.lengths:
            shard.close()

    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.lit(1), id_col).alias("hash"),
        F.xxhash64(F.lit(2), id_col).alias("print"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(text_col).alias("tie"),
    )
    dealt = keyed.repartitionByRange(tasks, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    dealt.mapInArrow(encode, _RECORDS.format(key=key)).write.mode("overwrite").parquet(f"{folder}/records")

    records = spark.read.parquet(f"{folder}/records")
    files = records.groupBy("part", "seq").agg(F.min("file").alias("file"), F.count("*").alias("records"), F.sum("length").alias("ids"))
    order = Window.orderBy("part", "seq")  # one row per shard file
    files.select(
        (F.row_number().over(order) - 1).alias("shard"), "part", "seq", "file", "records", "ids",
        (F.sum("ids").over(order) - F.col("ids")).alias("start"),
    ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/shards")

    # the place of a record as one number, so that the fold by key needs no sort
    place = F.shiftleft(F.col("part").cast("long"), 43) + F.shiftleft(F.col("seq").cast("long"), 25) + F.col("record")
    placed = records.select("hash", "print", "first", "length", place.alias("at"))
    keys = placed.groupBy("hash", "print").agg(
        F.min("at").alias("at"), F.max("at").alias("end"), F.min_by("first", "at").alias("first"), F.min_by("length", "at").alias("length")
    )
    shards = shard_table(spark, folder)
    number = shards.select((F.shiftleft(F.col("part").cast("long"), 18) + F.col("seq")).alias("file"), "shard")
    low = number.withColumnsRenamed({"file": "low", "shard": "shard"})
    high = number.withColumnsRenamed({"file": "high", "shard": "last"})
    record = F.lit((1 << 25) - 1)
    keys = keys.withColumns({"low": F.shiftright("at", 25), "high": F.shiftright("end", 25), "record": F.col("at").bitwiseAND(record), "tail": F.col("end").bitwiseAND(record) + 1})
    keys = keys.join(low, "low").join(high, "high")
    n = keys.count()
    total = max(1, -(-n // bucket_keys), min(64, -(-n // 1024)))
    built = keys.withColumn("bucket", F.pmod("hash", F.lit(total)).cast("int")).groupBy("bucket").applyInPandas(lambda g: _build(g, folder, total), "bucket int, file string, n long, total int")
    built.write.mode("overwrite").parquet(f"{folder}/buckets")


def shard_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/shards")


# --- minimal perfect hash -------------------------------------------------------------------------


class PerfectHash:
    """Levels of bit arrays: a key takes the first level where it is alone; its slot is the rank of its bit."""

    LOAD = 2

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = np.concatenate([np.packbits(x, bitorder="little") for x in levels]) if levels else np.zeros(0, np.uint8)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        self.words, self.ones = words, ones
        self.base = np.concatenate(([0], np.cumsum([len(x) for x in levels]))).astype(np.int64)

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (textops.mix(hashes + step) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> "PerfectHash":
        """Hashes are distinct. Sizes are multiples of 8, so that each level starts on a byte."""
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two keys of a bucket share a 64-bit hash")
        levels, rest = [], hashes
        while len(rest):
            size = max(64, -(-cls.LOAD * len(rest) // 8) * 8)
            at = cls._place(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; a foreign one gets some slot or -1, the fingerprint tells."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        rest = np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            if not len(rest):
                break
            at = self._place(hashes[rest], k, len(bits))
            found = bits[at]
            bit = self.base[k] + at[found]
            below = self.words[bit >> 3] & ((1 << (bit & 7)) - 1).astype(np.uint8)
            out[rest[found]] = self.ones[bit >> 3] + np.bitwise_count(below)
            rest = rest[~found]
        return out

    def dump(self) -> bytes:
        return struct.pack(f"<I{len(self.levels)}Q", len(self.levels), *map(len, self.levels)) + self.words.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> tuple["PerfectHash", int]:
        (n,) = struct.unpack_from("<I", raw)
        sizes = struct.unpack_from(f"<{n}Q", raw, 4)
        at, levels = 4 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size // 8, at), bitorder="little").astype(bool))
            at += size // 8
        return cls(levels), at


def _key_hash(hashes, prints) -> np.ndarray:
    """Both hashes of a key as one; keys that agree in it are told apart by level and fingerprint."""
    a, b = (np.asarray(x, dtype=np.int64).view(np.uint64) for x in (hashes, prints))
    return textops.mix(a ^ textops.mix(b))


def _build(group: pd.DataFrame, folder: str, total: int) -> pd.DataFrame:
    """The index file of one bucket."""
    perfect = PerfectHash.build(mixed := _key_hash(group["hash"], group["print"]))
    entries = np.zeros(len(group), dtype=_ENTRY)
    at = perfect.slot(mixed)
    entries["print"][at] = group["print"].to_numpy(np.int64).view(np.uint64)
    for name in _FIELDS:
        entries[name][at] = group[name].to_numpy()
    head = perfect.dump()
    path = f"{folder}/index/{uuid.uuid4().hex}.mph"
    with _open(path, "w") as out:
        out.write(_HEADER.pack(_INDEX_MAGIC, 0, 0, len(entries), len(head)))
        out.write(head)
        out.write(entries.tobytes())
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1].astype("int32"), "file": [path], "n": [len(group)], "total": [total]})


def _load_index(path: str) -> tuple[PerfectHash, np.ndarray]:
    with _open(path, "r") as f:
        raw = f.read()
    _, _, _, n, size = _HEADER.unpack_from(raw)
    perfect, _ = PerfectHash.load(raw[_HEADER.size : _HEADER.size + size])
    return perfect, np.frombuffer(raw, _ENTRY, n, _HEADER.size + size)


# --- keyed access ---------------------------------------------------------------------------------


def lookup(keys: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Where the records of each distinct key lie: first and last shard, record numbers, first id, length.

    Keys that the store does not hold give no row.
    """
    buckets = keys.sparkSession.read.parquet(f"{folder}/buckets")
    head = buckets.first()
    total = head["total"] if head else 1
    key = keys.schema[id_col].dataType.simpleString()
    asked = keys.select(F.col(id_col).alias("doc_id")).distinct()
    hashed = asked.select("doc_id", F.xxhash64(F.lit(1), "doc_id").alias("hash"), F.xxhash64(F.lit(2), "doc_id").alias("print"))
    placed = hashed.withColumn("bucket", F.pmod("hash", F.lit(total)).cast("int")).join(buckets.select("bucket", "file"), "bucket")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, index = None, None
        for batch in batches:
            files = batch.column(3).to_pandas()
            hashes, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for file, rows in files.groupby(files, sort=False).indices.items():
                if file != path:
                    path, index = file, _load_index(file)
                perfect, entries = index
                slot = perfect.slot(_key_hash(hashes[rows], prints[rows]))
                entry = entries[np.maximum(slot, 0)]
                right = (slot >= 0) & (entry["print"] == np.asarray(prints[rows], np.int64).view(np.uint64))
                columns = [batch.column(0).take(pa.array(rows[right])), *(pa.array(entry[k][right]) for k in _FIELDS)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_FIELDS])

    dealt = placed.repartition("file").sortWithinPartitions("file").select("doc_id", "hash", "print", "file")
    return dealt.mapInArrow(find, f"doc_id {key}, " + ", ".join(f"{k} long" for k in _FIELDS))


def read(found: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The records of looked-up keys, read from the shard files.

    Gives the key, the number of ids before the record in the store, the number of its ids, their CRC-32 as
    little-endian unsigned 32-bit integers, and the ids. A key whose records run on over several shards is
    served by each of them.
    """
    spark = found.sparkSession
    shards = shard_table(spark, folder).select("shard", "file", "start", "records")
    key = found.schema["doc_id"].dataType.simpleString()
    here = F.col("shard") == F.col("from")
    asked = (
        found.withColumnRenamed("shard", "from")
        .withColumn("shard", F.explode(F.sequence("from", "last")))
        .join(shards.withColumn("shard", F.col("shard").cast("long")), "shard")
        .select(
            "doc_id", "file", "start",
            F.when(here, F.col("record")).otherwise(0).alias("record"),
            F.when(here, F.col("first")).otherwise(0).alias("first"),
            F.when(here, F.col("length")).alias("length"),
            F.when(F.col("shard") == F.col("last"), F.col("tail")).otherwise(F.col("records")).alias("tail"),
        )
    )
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, reader = None, None, None
        rows: list[int] = []
        out: list[tuple] = []

        def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            if with_ids:
                columns.append(pa.array([x[3] for x in out], pa.list_(pa.int64())))
            rows.clear()
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            asked = zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True)
            for i, (where, start, record, first, length, tail) in enumerate(asked):
                if where != path:
                    if file:
                        file.close()
                    path, file = where, _open(where, "r")
                    reader = _Reader(file)
                for at, ids in reader.run(record, first, length, tail):
                    rows.append(i)
                    out.append((start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                    if len(out) >= 4000:
                        yield flush(batch)
            if out:
                yield flush(batch)
        if file:
            file.close()

    dealt = asked.repartition("file").sortWithinPartitions("file", "first")
    return dealt.mapInArrow(fetch, f"doc_id {key}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


class _Reader:
    """Ranged reads of one shard file, a window of it kept at a time."""

    WINDOW = 4 << 20

    def __init__(self, file):
        self.file = file
        _, self.width, _, self.records, self.ids = _HEADER.unpack(file.read_at(_HEADER.size, 0))
        self.low, self.held = 0, b""

    def _bytes(self, at: int, size: int) -> bytes:
        if not self.low <= at <= at + size <= self.low + len(self.held):
            self.low = at
            self.held = self.file.read_at(max(size, self.WINDOW), at)
        return self.held[at - self.low : at - self.low + size]

    def run(self, record: int, first: int, length: int | None, tail: int) -> Iterator[tuple[int, np.ndarray]]:
        """The records from ``record`` up to ``tail``; all but the first length come from the file."""
        while record < tail:
            if length is None:
                (length,) = struct.unpack("<Q", self.file.read_at(8, _HEADER.size + self.ids * self.width + 8 * record))
            yield first, np.frombuffer(self._bytes(_HEADER.size + first * self.width, length * self.width), f"<u{self.width}")
            record, first, length = record + 1, first + length, None
