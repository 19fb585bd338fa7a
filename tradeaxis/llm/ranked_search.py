"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks, a batch of documents each: a directory with the ids and lengths, and for every
term of a query the places and counts of its documents. Every term has an owner, by its document frequency, rare
terms first. Queries travel in bundles. A bundle visits each block in a cell of its own, and carries a sparse
accumulator per query: places of documents and integer scores. The cells pass the owners one after another; at
each a cogroup brings a cell together with the owner's lists of that block, and the contributions are added. After
the last owner each cell gives its best documents, and Spark ranks these.

An accumulator may drop a document, or admit no new one, once the owners still to come cannot lift it over the
score that enough documents of the same cell have already. Contributions are never negative, so no document of
the result is lost; ties stay.

Terms: maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in the whole text, A-Z lower-cased; a null or
empty text has none. Terms are compared by 64-bit hashes. N, L and the document frequencies count every row of
the documents. What is broadcast is a bitmap of fixed size that keeps most other terms out of the index, and the
numbers N and L.

Defined results: every row of the documents is a document, also if ids repeat; documents with equal score rank by
id, without id last. Items equal in id and text are one item, items equal in id alone are ranked each. Items
without terms, or with terms that no document has, give no rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.llm import textops
from tradeaxis.session import staged

TOP = 20
#: Items that travel together.
BUNDLE = 128
#: A term belongs to the first owner whose share of the documents its frequency does not exceed; else to the last.
OWNERS = (0.001, 0.01, 0.1)
#: Bits of the map of query terms; a power of two.
MAP = 1 << 20
#: Length normalisation in hundredths, and its scale.
SLOPE, PIVOT, FLAT, UNIT = 25, 100, 12, 1000
_U64 = np.uint64


def _counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, last row, terms per row, and row, hash and count of every distinct term."""
    for i, j, _, _, (_, _, counts, hashes) in textops.word_slices(column, textops.LETTERS):
        rows = np.repeat(np.arange(i, j), counts)
        order = np.lexsort((rows, hashes))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        yield i, j, counts, rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def listed(items: DataFrame, id_col: str = "item_id", text_col: str = "text", bundle: int = BUNDLE) -> DataFrame:
    """``(bundle, slot, item, text)``: the distinct items, dealt out to bundles of about that many."""
    told = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    key = F.xxhash64(F.col("item").cast("string"), "text")
    parts = max(1, -(-told.count() // bundle))
    dealt = told.withColumn("bundle", F.pmod(key, F.lit(parts)).cast("int"))
    slot = F.row_number().over(Window.partitionBy("bundle").orderBy(key, "item", "text")) - 1
    return dealt.select("bundle", slot.alias("slot"), "item", "text")


def query_terms(items: DataFrame) -> DataFrame:
    """``(bundle, slot, term, q)``: how often every item of ``listed`` has each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, rows, terms, q in _counted(batch.column(2)):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(terms.view(np.int64)), pa.array(q.astype(np.int64))], ["bundle", "slot", "term", "q"]
                )

    return items.select("bundle", "slot", "text").mapInArrow(run, "bundle int, slot int, term long, q long")


def bitmap(terms: DataFrame) -> np.ndarray:
    """Which of the ``MAP`` cells hold a term: as many bytes whatever the number of terms."""
    cell = F.pmod(F.col("term"), F.lit(MAP))
    parts = terms.groupBy(F.bitmap_bucket_number(cell).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    bits = np.zeros(MAP + 1, dtype=bool)  # cells are numbered from 1 in a bucket after the first; position 0 is bit 0 of it
    for r in parts:
        own = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        start = (r["part"] - 1) * len(own) if r["part"] else 0
        # bucket b holds the numbers (b - 1) * size + 1 to b * size; bucket 0 the number 0
        numbers = np.flatnonzero(own) + start + (1 if r["part"] else 0)
        bits[numbers] = True
    return bits[:MAP]


def index(documents: DataFrame, bits: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: a directory row (no term) with ids and lengths, and a row for each term that ``bits`` lets through."""
    packed = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        task, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            block, turn = (task << 32) + turn, turn + 1
            lengths = np.zeros(n, np.int64)
            found = []
            for i, j, counts, rows, terms, tf in _counted(batch.column(1)):
                lengths[i:j] = counts
                keep = wanted[(terms & _U64(MAP - 1)).astype(np.int64)]
                found.append((rows[keep], terms[keep], tf[keep]))
            rows, terms, tf = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, _U64), np.zeros(0, np.int64))
            order = np.argsort(terms, kind="stable")
            rows, terms, tf = rows[order].astype("<i4"), terms[order], tf[order].astype("<i4")
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(terms)), dtype=bool), terms[1:] != terms[:-1])))
            ends = np.append(starts, len(terms))[1:]
            spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
            many = 1 + len(spans)
            most = np.maximum.reduceat(tf, starts) if len(starts) else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array([0, n] + [n] * len(spans), pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(many, block, dtype=np.int64)),
                    pa.array([None, *terms[starts].view(np.int64).tolist()], pa.int64()),
                    pa.array([None, *(rows[a:b].tobytes() for a, b in spans)], pa.binary()),
                    pa.array([None, *(tf[a:b].tobytes() for a, b in spans)], pa.binary()),
                    pa.array([int((lengths > 0).sum()), *(ends - starts).tolist()], pa.int64()),
                    pa.array([int(lengths.sum()), *most.tolist()], pa.int64()),
                    ids,
                    pa.array([lengths.astype("<i8").tobytes()] + [None] * len(spans), pa.binary()),
                ],
                ["block", "term", "places", "tfs", "df", "most", "ids", "lengths"],
            )

    kind = documents.schema[id_col].dataType
    schema = T.StructType([*T._parse_datatype_string("block long, term long, places binary, tfs binary, df long, most long").fields, T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.BinaryType())])
    return documents.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds for documents of normalised length m, per unit of weight."""
    return (1_000_000_000 * tf) // (UNIT * tf + FLAT * m)


def weighed(terms: DataFrame, postings: DataFrame, n: int) -> DataFrame:
    """``terms`` with weight, owner, and the most that the term can add to an item's score."""
    per = postings.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    owner = F.lit(len(OWNERS))
    for k, share in reversed(list(enumerate(OWNERS))):
        owner = F.when(F.col("df") <= share * n, F.lit(k)).otherwise(owner)
    least = PIVOT - SLOPE
    most = F.ceil(F.lit(1e9) * F.col("most") / (UNIT * F.col("most") + FLAT * least)).cast("long")
    found = terms.join(per, "term").withColumns({"w": weight, "owner": owner})
    return found.select("bundle", "slot", "term", "q", "w", "owner", (F.col("q") * F.col("w") * most).alias("bound"))


def _best(score: np.ndarray, top: int) -> np.ndarray:
    """For each row the ``top``-th greatest score, 0 where fewer are positive."""
    if score.shape[1] < top:
        return np.zeros(len(score), np.int64)
    return np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top]


CELL = "bundle int, block long, lengths binary, bounds binary, slots binary, places binary, scores binary"


def visit(owner: int, n: int, words: int, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The step at one owner: adds its lists of a block to the accumulators of a cell."""

    def run(cell: pa.Table, lists: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return cell
        row = cell.to_pylist()[0]
        lengths = np.frombuffer(row["lengths"], "<i8")
        bounds = np.frombuffer(row["bounds"], "<i8").reshape(len(OWNERS) + 1, -1)
        slots, places, scores = (np.frombuffer(row[c], kind) for c, kind in (("slots", "<i4"), ("places", "<i4"), ("scores", "<i8")))
        total = np.zeros((bounds.shape[1], len(lengths)), np.int64)
        total[slots, places] = scores
        # documents that no earlier owner named can still come in where the rest could lift them high enough
        admits = bounds[owner:].sum(axis=0) >= _best(total, top)
        m = PIVOT - SLOPE + (SLOPE * lengths * n) // max(1, words)
        seen = total > 0
        for k in range(lists.num_rows):
            at = np.frombuffer(lists["places"][k].as_buffer(), "<i4")
            tf = np.frombuffer(lists["tfs"][k].as_buffer(), "<i4").astype(np.int64)
            gain = lists["w"][k].as_py() * _impact(tf, m[at])
            users = lists["users"][k].as_py()
            for user in users:
                s, q = user["slot"], user["q"]
                total[s, at] += q * gain if admits[s] else np.where(seen[s, at], q * gain, 0)
        left = bounds[owner + 1 :].sum(axis=0)
        keep = (total > 0) & (total + left[:, None] >= _best(total, top)[:, None])
        slots, places = np.nonzero(keep)
        values = [row["bundle"], row["block"], row["lengths"], row["bounds"], slots.astype("<i4").tobytes(), places.astype("<i4").tobytes(), total[keep].astype("<i8").tobytes()]
        return pa.table([pa.array([v], f.type) for v, f in zip(values, cell.schema, strict=True)], schema=cell.schema)

    return run


def _cells(blocks: DataFrame, weights: DataFrame, items: DataFrame) -> DataFrame:
    """A cell for every bundle and block, with nothing accumulated, and what each owner can add to each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slots, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                table = np.zeros((len(OWNERS) + 1, slots), np.int64)
                for part in parts or ():
                    table[part["owner"], part["slot"]] += part["bound"]
                out.append(table.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["bundle", "bounds"])

    per = weights.groupBy("bundle", "slot", "owner").agg(F.sum("bound").alias("bound"))
    per = per.groupBy("bundle").agg(F.collect_list(F.struct("slot", "owner", "bound")).alias("parts"))  # at most a bundle's items times the owners
    sizes = items.groupBy("bundle").agg((F.max("slot") + 1).alias("slots"))
    bundles = staged(sizes.join(per, "bundle").select("bundle", "slots", "parts").mapInArrow(run, "bundle int, bounds binary"), "bundles")
    names = [r["bundle"] for r in bundles.select("bundle").collect()]  # a number per 128 items
    none = F.lit(b"").cast("binary")
    visits = blocks.withColumn("bundle", F.explode(F.array(*map(F.lit, names)).cast("array<int>")))
    return visits.join(bundles, "bundle").select("bundle", "block", "lengths", "bounds", none.alias("slots"), none.alias("places"), none.alias("scores"))


def _named(cells: DataFrame, directory: DataFrame, top: int) -> DataFrame:
    """``(bundle, slot, doc_id, score)``: the best documents of each cell, by score and then id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                slots, places, scores = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((1, "<i4"), (2, "<i4"), (3, "<i8")))
                ids = batch.column(4)[k].values
                found = pa.table({"slot": slots, "doc_id": ids.take(pa.array(places)), "score": scores})
                found = found.take(pc.sort_indices(found, sort_keys=[("slot", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
                slots = found["slot"].to_numpy()
                first = np.searchsorted(slots, slots)
                found = found.filter(pa.array(np.arange(len(slots)) - first < top))
                bundle = pa.array(np.full(found.num_rows, batch.column(0)[k].as_py(), dtype=np.int32))
                yield from pa.table([bundle, *found.columns], names=["bundle", "slot", "doc_id", "score"]).combine_chunks().to_batches()

    kind = directory.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("bundle", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    return cells.join(directory, "block").select("bundle", "slots", "places", "scores", "ids").mapInArrow(run, schema)


def search(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, bundle: int = BUNDLE) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of each item."""
    spark = documents.sparkSession
    asked = staged(listed(items, item_col, item_text_col, bundle), "items")
    terms = staged(query_terms(asked), "terms")
    segments = staged(index(documents, bitmap(terms), id_col, text_col), "index")
    directory = segments.filter(F.col("term").isNull())
    told: Row = directory.agg(F.sum("df").alias("n"), F.sum("most").alias("words")).first()
    n, words = told["n"] or 0, told["words"] or 0
    postings = segments.filter(F.col("term").isNotNull())
    weights = staged(weighed(terms, postings, n), "weights")
    kinds = {"item_id": asked.schema["item"].dataType, "doc_id": documents.schema[id_col].dataType}
    if weights.isEmpty():
        empty = T.StructType([T.StructField("item_id", kinds["item_id"]), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", kinds["doc_id"]), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], empty)
    lists = weights.groupBy("bundle", "term", "owner", "w").agg(F.collect_list(F.struct("slot", "q")).alias("users"))  # at most a bundle's items
    cells = _cells(directory.select("block", "lengths"), weights, asked)
    for owner in range(len(OWNERS) + 1):
        own = postings.join(lists.filter(F.col("owner") == owner).drop("owner"), "term")
        own = own.select(F.col("bundle").alias("bundle"), F.col("block").alias("block"), "w", "users", "places", "tfs")  # names of its own for the cogroup
        cells = cells.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block")).applyInArrow(visit(owner, n, words, top), CELL)
    best = _named(cells, directory.select("block", "ids"), top)
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(asked.select("bundle", "slot", "item"), ["bundle", "slot"]).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
