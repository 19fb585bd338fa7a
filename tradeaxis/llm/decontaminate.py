"""Benchmark decontamination with suffix arrays over the training words.

Every Arrow batch of training documents is a shard. Its suffixes that could match are sorted into a
suffix array, and all test suffixes are looked up in it by binary search; neighbouring words give the
longest verbatim match and its place. Only suffixes that begin with enough words of the benchmark's
vocabulary are sorted: the others match nothing, whatever they are compared with, so the array is
complete for the questions asked. Documents stay in their task; nothing is shuffled.

A benchmark of at most ``BLOCK_BYTES`` is broadcast, after its size was summed. A larger one stays in Spark:
documents are cut into shards of about ``SHARD_BYTES`` and shuffled once, every shard is followed by all rows of the
benchmark, and its task reads these in blocks of ``BLOCK_BYTES``, one at a time (a block nested loop). Neither the
driver nor a task then holds more than a shard and a block, at the price of shipping the benchmark once a shard.

Defined results: a null or empty text, or one without words, has no words and no hits. A null item text
matches nothing. An item whose id is null marks words but is not listed. Repeated benchmark rows count
once; repeated document rows are judged one by one. An empty benchmark leaves every document clean. Item ids
may be of any type that can be compared. Other columns of documents travel inside a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tradeaxis.llm import textops

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 64 << 20
ITEM_OVERHEAD = 64


class Tests:
    """One block of the benchmark: its vocabulary, its word ids, and its distinct windows."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        column = pa.array(texts, pa.large_string())
        hashes, counts = [], []
        for _, _, _, _, (_, _, n, h) in textops.word_slices(column, textops.LETTERS):
            hashes.append(h)
            counts.append(n)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.window = window
        self.lexicon = textops.Lexicon(flat)
        self.words = self.lexicon.find(flat)
        #: Ids as they came, and the number of each item's id among them; -1 for none.
        self.names = sorted({x for x in ids if x is not None})
        number = {x: k for k, x in enumerate(self.names)}
        self.ids = np.array([number.get(x, -1) for x in ids], dtype=np.int64)
        self.named = self.ids >= 0
        first = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        own = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(flat))
        ahead = first[own + 1] - place if len(flat) else np.zeros(0, np.int64)
        size = np.repeat(np.minimum(counts, window), counts)
        keep = ahead >= size  # a test suffix of at least one window
        self.start, self.item, self.width = place[keep], own[keep], size[keep]
        self.offset = self.start - first[self.item] if len(self.start) else self.start
        self.length = ahead[keep]
        self.shortest = int(self.width.min()) if len(self.width) else 0
        self.longest = int(self.length.max()) if len(self.length) else 0

    def suffix(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the chosen test suffixes, -1 beyond their depth."""
        most = int(depth.max()) if len(depth) else 0
        out = np.full((len(rows), most), -1, dtype=np.int32)
        for k in range(most):
            have = depth > k
            out[have, k] = self.words[self.start[rows[have]] + k]
        return out


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes in the order of their first ``depth`` words, by prefix doubling."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    order, step = np.argsort(rank, kind="stable"), 1
    while step < depth and n:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.int64)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        step *= 2
        if rank.max() == n:
            break
    return order


def bounds(words: np.ndarray, order: np.ndarray, asked: np.ndarray, depth: np.ndarray):
    """For each asked word sequence the range of the suffix array that begins with it."""
    n = len(order)
    padded = np.concatenate((words, np.full(asked.shape[1] + 1, -2, dtype=np.int32)))

    def below(at: np.ndarray, rows: np.ndarray, equal_counts: bool) -> np.ndarray:
        """Whether the suffix at this place sorts before the asked sequence (or equals its prefix)."""
        result = np.full(len(at), equal_counts)
        open_ = np.arange(len(at))
        for k in range(asked.shape[1]):
            open_ = open_[depth[rows[open_]] > k]
            if not len(open_):
                break
            mine, theirs = padded[at[open_] + k], asked[rows[open_], k]
            differ = mine != theirs
            result[open_[differ]] = mine[differ] < theirs[differ]
            open_ = open_[~differ]
        return result

    def search(equal_counts: bool) -> np.ndarray:
        low = np.zeros(len(asked), dtype=np.int64)
        high = np.full(len(asked), n, dtype=np.int64)
        while True:
            rows = np.flatnonzero(low < high)
            if not len(rows):
                return low
            mid = (low[rows] + high[rows]) // 2
            less = below(order[mid], rows, equal_counts)
            low[rows[less]] = mid[less] + 1
            high[rows[~less]] = mid[~less]

    return search(False), search(True)


def _shard(column: pa.Array, tests: Tests):
    """Word counts of all rows, and the words in runs long enough to hold a match."""
    counts, ids, row, word = [], [], [], []
    for i, _, _, _, (_, _, n, hashes) in textops.word_slices(column, textops.LETTERS):
        counts.append(n)
        found = tests.lexicon.find(hashes)
        own = np.repeat(np.arange(len(n)), n)
        first = np.concatenate(([0], np.cumsum(n)))[own] if len(own) else own
        known = found >= 0
        cut = ~known
        cut[1:] |= own[1:] != own[:-1]
        run = np.cumsum(cut)
        size = np.bincount(run[known], minlength=int(run[-1]) + 1 if len(run) else 1)
        keep = np.flatnonzero(known & (size[run] >= tests.shortest)) if len(run) else known.nonzero()[0]
        if len(keep):
            gap = np.flatnonzero(np.diff(run[keep]) != 0) + 1
            ids.append(np.concatenate((np.insert(found[keep], gap, -1), [-1])).astype(np.int32))
            row.append(np.concatenate((np.insert(own[keep] + i, gap, -1), [-1])))
            word.append(np.concatenate((np.insert(keep - first[keep], gap, -1), [-1])))
    empty = np.zeros(0, np.int64)
    join = lambda x: np.concatenate(x) if x else empty
    return join(counts), join(ids).astype(np.int32), join(row), join(word)


def judge(column: pa.Array, tests: Tests) -> dict[str, object]:
    """Hits of one shard: per row the hit words, the items, and every match with its longest length."""
    counts, ids, row, word = _shard(column, tests)
    rows = len(column)
    hit_rows: np.ndarray = np.zeros(0, np.int64)
    hit_words = item_rows = items = hit_rows
    match = {k: np.zeros(0, np.int64) for k in ("row", "item", "offset", "word", "length")}
    if len(ids) and len(tests.start):
        order = suffix_array(ids, max(int(tests.width.max()), 1))
        order = order[ids[order] >= 0]
        every = np.arange(len(tests.start))
        low, high = bounds(ids, order, tests.suffix(every, tests.width), tests.width)
        many = high - low
        test = np.repeat(every, many)
        within = np.arange(len(test)) - np.repeat(np.cumsum(many) - many, many)
        at = order[np.repeat(low, many) + within]
        # distinct windows at a place mark the same words, so the cover is taken place by place
        reach = np.zeros(len(ids) + 1, dtype=np.int64)
        np.maximum.at(reach, at, tests.width[test])
        far = np.maximum.accumulate(np.where(reach[:-1] > 0, np.arange(len(ids)) + reach[:-1], 0))
        covered = np.flatnonzero(far > np.arange(len(ids)))
        hit_rows, hit_words = row[covered], word[covered]
        named = tests.named[tests.item[test]]
        pairs = np.unique(np.stack((row[at[named]], tests.ids[tests.item[test[named]]])), axis=1)
        item_rows, items = pairs[0], pairs[1]
        length = tests.width[test].copy()
        open_ = np.flatnonzero(tests.length[test] > length)
        padded = np.concatenate((ids, [-1]))
        while len(open_):
            same = padded[at[open_] + length[open_]] == tests.words[tests.start[test[open_]] + length[open_]]
            open_ = open_[same]
            length[open_] += 1
            open_ = open_[tests.length[test[open_]] > length[open_]]
        # a match is told once, at its beginning: the place before must not extend it
        before = np.maximum(at - 1, 0)
        inner = (at > 0) & (tests.offset[test] > 0) & (ids[before] == tests.words[np.maximum(tests.start[test] - 1, 0)])
        told = np.flatnonzero(~inner)
        match = {"row": row[at[told]], "item": tests.ids[tests.item[test[told]]], "offset": tests.offset[test[told]], "word": word[at[told]], "length": length[told]}
    return {"rows": rows, "n_words": counts if len(counts) else np.zeros(rows, np.int64), "hit_rows": hit_rows, "hit_words": hit_words, "item_rows": item_rows, "items": items, "match": match}


class Found:
    """Results of the blocks of the benchmark over one shard, one block after another."""

    def __init__(self, rows: int):
        self.rows, self.names, self.number = rows, [], {}
        self.parts: list[dict] = []

    def add(self, column: pa.Array, tests: Tests) -> None:
        part = judge(column, tests)
        # an id found is numbered over all blocks
        used = np.unique(np.concatenate((part["items"], part["match"]["item"])))
        used = used[used >= 0]
        new = np.full(len(tests.names) + 1, -1, dtype=np.int64)  # the last place is for -1
        for k in used.tolist():
            name = tests.names[k]
            if name not in self.number:
                self.number[name] = len(self.names)
                self.names.append(name)
            new[k] = self.number[name]
        part["items"], part["match"]["item"] = new[part["items"]], new[part["match"]["item"]]
        self.parts.append(part)

    def merged(self) -> dict[str, object]:
        parts, rows = self.parts, self.rows
        cover = np.unique(np.concatenate([p["hit_rows"] * (1 << 34) + p["hit_words"] for p in parts]))
        pairs = np.unique(np.concatenate([np.stack((p["item_rows"], p["items"])) for p in parts], axis=1), axis=1)
        match = {k: np.concatenate([p["match"][k] for p in parts]) for k in parts[0]["match"]}
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, match["row"], match["length"])
        return {"n_words": parts[0]["n_words"], "n_hit": np.bincount(cover >> 34, minlength=rows), "pairs": pairs, "match": match, "longest": longest}


def _lists(owner: np.ndarray, rows: int, values: pa.Array, order: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(order)))


def _ids(found: Found, numbers: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The ids behind their numbers, null for -1."""
    return pa.array(found.names, kind).take(pa.array(numbers, pa.int64(), mask=numbers < 0))


def _shards(docs: DataFrame, text_col: str, items: DataFrame, kind: T.DataType, window: int):
    """Documents as structs, each shard followed by the benchmark; and the reader of such a partition."""
    place = docs.columns.index(text_col)
    total = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + ITEM_OVERHEAD), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // SHARD_BYTES))
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # dealt by all that a row holds: only rows that are equal in every column meet for sure
    told = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    mine = docs.select(F.pmod(F.xxhash64(*told), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("part"), record.alias("record"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(kind).alias("item"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    theirs = items.select(every, F.lit(1).alias("part"), F.lit(None).cast(mine.schema["record"].dataType).alias("record"), "text", F.col("id").alias("item"))
    # hashing may put several shards into one partition; the reader tells them apart by their number
    dealt = mine.unionByName(theirs).repartition(shards, "shard").sortWithinPartitions("shard", "part")

    block = BLOCK_BYTES

    def read(batches: Iterator[pa.RecordBatch], finish):
        shard, rows, found, ids, texts, size = None, [], None, [], [], 0

        def search():
            nonlocal found, ids, texts, size
            if rows:
                if len(rows) > 1:
                    rows[:] = pa.Table.from_arrays([pa.chunked_array(rows)], ["record"]).combine_chunks()["record"].chunks
                found = found or Found(len(rows[0]))
                found.add(rows[0].field(place), Tests(ids, texts, window))
            ids, texts, size = [], [], 0

        def close():
            nonlocal rows, found
            if rows:
                if texts or found is None:
                    search()
                yield finish(rows[0].flatten(), found)
            rows, found = [], None

        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            parts = batch.column("part").to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(parts) != 0)) + 1
            for low, high in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(numbers)])), strict=True):
                if high == low:
                    continue
                piece = batch.slice(int(low), int(high - low))
                if numbers[low] != shard:
                    yield from close()
                    shard, ids, texts, size = numbers[low], [], [], 0
                if parts[low] == 0:
                    rows.append(piece.column("record"))
                    continue
                for item, words in zip(piece.column("item").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    ids.append(item)
                    texts.append(words)
                    size += len(words.encode()) + ITEM_OVERHEAD
                    if size >= block:
                        search()
        yield from close()

    return dealt, read


def _searched(docs: DataFrame, benchmark: DataFrame, text_col: str, bench_id: str, bench_text: str, window: int, finish, schema) -> DataFrame:
    """``finish(columns, found)`` over all documents, by the way the benchmark's size allows."""
    items = benchmark.select(F.col(f"`{bench_id}`").alias("id"), F.coalesce(F.col(f"`{bench_text}`").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + ITEM_OVERHEAD), F.lit(0))).first()[0]
    if size > BLOCK_BYTES:
        dealt, read = _shards(docs, text_col, items, benchmark.schema[bench_id].dataType, window)
        return dealt.mapInArrow(lambda batches: read(batches, finish), schema)
    rows = items.toArrow()  # at most ``BLOCK_BYTES``
    tests = docs.sparkSession.sparkContext.broadcast(Tests(rows["id"].to_pylist(), rows["text"].to_pylist(), window))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Found(batch.num_rows)
            found.add(batch.column(0).field(place), tests.value)
            yield finish(batch.column(0).flatten(), found)

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")).mapInArrow(run, schema)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """Per document row: its words, hit words, items found, and where the longest matches lie.

    ``matches`` holds each maximal verbatim match: item, word offset in the item, word offset in the
    document, length in words. A null item id is null there and left out of ``items``.
    """
    item = benchmark.schema[bench_id].dataType
    places = T.StructType([T.StructField("item", item), *[T.StructField(k, T.LongType()) for k in ("offset", "word", "length")]])
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *[T.StructField(k, T.LongType()) for k in ("n_words", "n_hit", "longest")],
            T.StructField("items", T.ArrayType(item)),
            T.StructField("matches", T.ArrayType(places)),
        ]
    )
    kind = to_arrow_type(item)

    def finish(own: list[pa.Array], found: Found) -> pa.RecordBatch:
        got, rows = found.merged(), found.rows
        m, pairs = got["match"], got["pairs"]
        order = np.lexsort((m["offset"], m["item"], m["word"], m["row"]))
        names = [_ids(found, m["item"], kind), *[pa.array(m[k], pa.int64()) for k in ("offset", "word", "length")]]
        columns = [
            own[0],
            pa.array(got["n_words"], pa.int64()),
            pa.array(got["n_hit"], pa.int64()),
            pa.array(got["longest"], pa.int64()),
            _lists(pairs[0], rows, _ids(found, pairs[1], kind), np.arange(pairs.shape[1])),
            _lists(m["row"], rows, pa.StructArray.from_arrays(names, ["item", "offset", "word", "length"]), order),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _searched(narrow, benchmark, "text", bench_id, bench_text, window, finish, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """The documents without any benchmark window, columns as they came."""

    names = docs.columns

    def finish(own: list[pa.Array], found: Found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(own, names).filter(pa.array(found.merged()["n_hit"] == 0))

    return _searched(docs, benchmark, text_col, bench_id, bench_text, window, finish, docs.schema)
