"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the set of its five-word shingles, each with a weight: one, and up to a quarter more the longer its
words are, as shingles of short words are shared by chance more often. Every shingle sends arrivals of a Poisson
process with its weight as rate to random registers; a register keeps its earliest arrival. A shingle stops as
soon as its next arrival is later than every register of its document (early termination). The share of equal
registers estimates the probability Jaccard similarity of the weighted sets.

Links are defined on the plain sets: Jaccard of 0.8 or more, verified on the whole sets. A shingle's weight is
its own, however often it occurs, and lies between 1 and 1.25; so two sets at 0.8 have a weighted similarity of
at least 0.8 / (0.8 + 0.2 * 1.25) = 0.76, and ``BANDS`` bands of ``ROWS`` registers, which give the candidates,
miss them with probability 6e-4 at the most and 5e-5 if both parts weigh alike.

Equal word sequences are one vertex, so exact copies cost one row each and no pair. Within a bucket pairs
are not listed. First every member is compared with the bucket's least vertex, which joins most of a bucket
of near copies. Where a bucket still holds several components, its members outside the largest one are
compared with the members of the other components, in blocks of bounded size of which only the links leave
the task. So no link that a bucket holds between different components is lost, and a bucket costs a
comparison per member and one per member and outsider.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Fewer than five words, but not none, are one
shingle. Documents without words, and null texts, are alone in their class. Equal ids are allowed: classes
are of rows. The class id is the least id in the class (null only if no row of the class has one). Vertices
are 64-bit hashes of the word sequence: among four billion different texts two would share one about
half the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.llm import textops
from tradeaxis.llm.components import components, joined
from tradeaxis.session import staged

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Most sets in a block of those that ask, and of those asked.
OUTSIDE, MEMBERS = 256, 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_U64 = np.uint64
_STEP = _U64(0x9E3779B97F4A7C15)


class Registers:
    """ProbMinHash registers of a batch of documents."""

    def __init__(self, rows: int, m: int = REGISTERS):
        self.m = m
        self.time = np.full(rows * m, np.inf)
        self.key = np.zeros(rows * m, _U64)
        self.waiting: list[tuple] = []

    def add(self, rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, rounds: int = 12) -> None:
        """Distinct (row, key) with weights; what is not done after some rounds waits for ``finish``."""
        left = self._run(rows, keys, weights, np.zeros(len(keys)), np.zeros(len(keys), _U64), rounds)
        if len(left[0]):
            self.waiting.append(left)

    def finish(self) -> np.ndarray:
        """Signatures of all rows: the key of each register's earliest arrival."""
        if self.waiting:
            self._run(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)), None)
            self.waiting = []
        return self.key.reshape(-1, self.m)

    def _run(self, rows, keys, weights, clock, turn, rounds):
        done = 0
        while len(rows) and (rounds is None or done < rounds):
            draw = textops.mix(keys + (turn + _U64(1)) * _STEP)
            clock = clock - np.log1p(-((draw >> _U64(11)).astype(float) * 2.0**-53)) / weights
            slot = rows * self.m + (textops.mix(draw) % _U64(self.m)).astype(np.int64)
            np.minimum.at(self.time, slot, clock)
            first = self.time[slot] == clock
            self.key[slot[first]] = keys[first]
            busy = np.unique(rows)
            latest = np.zeros(int(busy[-1]) + 1)
            latest[busy] = self.time.reshape(-1, self.m)[busy].max(axis=1)
            on = clock < latest[rows]
            rows, keys, weights, clock, turn = rows[on], keys[on], weights[on], clock[on], turn[on] + _U64(1)
            done += 1
        return rows, keys, weights, clock, turn


def sequence_hash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit number for the word sequence of each row; 0 for none."""
    out = np.zeros(len(counts), _U64)
    filled = np.flatnonzero(counts)
    if len(filled):
        first = np.cumsum(counts) - counts
        place = np.arange(len(hashes)) - np.repeat(first, counts)
        terms = textops.mix(hashes + (place.astype(_U64) + _U64(1)) * _STEP)
        out[filled] = textops.mix(np.add.reduceat(terms, first[filled]) + counts[filled].astype(_U64)) | _U64(1)
    return out


def shingle_sets(hashes: np.ndarray, counts: np.ndarray):
    """Distinct shingles of each row in order of row and value: rows, values, place of the first word."""
    values, rows = textops.shingles(hashes, counts, SHINGLE)
    ends = np.repeat(np.cumsum(counts), counts)
    ahead = ends - np.arange(len(hashes))
    place = np.flatnonzero((ahead >= SHINGLE) | ((ahead == np.repeat(counts, counts)) & (ahead < SHINGLE)))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], values[at], place[order][at]


def weights(place: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weight of the shingles that begin at these words: 1 to 1.25, by the bytes of their words."""
    total = np.concatenate(([0], np.cumsum(lengths)))
    ends = np.repeat(np.cumsum(counts), counts)
    size = total[np.minimum(place + SHINGLE, ends[place])] - total[place]
    return 1 + np.minimum(size, 64) / 256


def sketch_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertex, number of distinct shingles, and band hashes of every text."""
    n = len(column)
    vertex, size = np.zeros(n, _U64), np.zeros(n, np.int64)
    registers = Registers(n)
    for i, j, _, _, (starts, ends, counts, hashes) in textops.word_slices(column, textops.LETTERS):
        vertex[i:j] = sequence_hash(hashes, counts)
        _, told = np.unique(vertex[i:j], return_index=True)
        rows, values, place = shingle_sets(hashes, counts)
        size[i:j] = np.bincount(rows, minlength=j - i)
        alone = np.zeros(j - i, dtype=bool)
        alone[told] = True
        keep = alone[rows]
        registers.add(rows[keep] + i, values[keep], weights(place[keep], ends - starts, counts))
    signature = registers.finish()
    band = np.zeros((n, BANDS), _U64)
    for k in range(ROWS):
        band = textops.mix(band * _STEP + signature[:, k::ROWS][:, :BANDS] + _U64(k + 1))
    return vertex, size, textops.mix(band + np.arange(1, BANDS + 1, dtype=_U64) * _STEP)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, hash of the text, vertex (null without words), shingles, bands (null if the batch told them already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vertex, size, band = sketch_column(batch.column(1))
            _, first = np.unique(vertex, return_index=True)
            told = np.zeros(len(vertex), dtype=bool)
            told[first] = True
            told &= vertex != 0
            ends = np.concatenate(([0], np.cumsum(np.where(told, BANDS, 0)))).astype(np.int32)
            values = pa.array(band[told].ravel().view(np.int64))
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(vertex.view(np.int64), pa.int64(), mask=vertex == 0), pa.array(size, pa.int64()), bands],
                ["doc_id", "exact", "v", "n", "bands"],
            )

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind, True), *T._parse_datatype_string("exact long, v long, n long, bands array<long>").fields])
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), text, F.xxhash64(text)).mapInArrow(run, schema)


def sets_of(texts: DataFrame) -> DataFrame:
    """``(v, s)``: the sorted shingles of rows ``(v, text)`` whose text has that vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, _, _, (_, _, counts, hashes) in textops.word_slices(batch.column(1), textops.LETTERS):
                vertex = sequence_hash(hashes, counts).view(np.int64)
                right = np.zeros(j - i, dtype=bool)
                right[np.unique(vertex, return_index=True)[1]] = True
                right &= vertex == wanted[i:j]
                rows, values, _ = shingle_sets(hashes, counts)
                kept = right[rows]
                per_row = np.bincount(rows[kept], minlength=j - i)[right]
                ends = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(wanted[i:j][right], pa.int64()), lists], ["v", "s"])

    return texts.select("v", "text").mapInArrow(run, "v long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` of pairs ``(a, b)``, on their whole shingle sets."""
    left = pairs.join(sets.withColumnsRenamed({"v": "a", "s": "sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"v": "b", "s": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))


def links(docs: DataFrame, sketch: DataFrame, text_col: str = "text") -> tuple[DataFrame | None, DataFrame | None]:
    """Verified links ``(a, b)`` between vertices, and the components ``(v, root)`` they make.

    Links inside a component that is known already are not sought.
    """
    members = sketch.filter(F.col("bands").isNotNull()).select("v", "n", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("v").alias("head"), F.max("v").alias("other"), F.min_by("n", "v").alias("head_n"))
    heads = staged(heads.filter(F.col("head") != F.col("other")).select("bucket", "head", "head_n"), "heads")
    # members of the buckets with several vertices; everything after this is about them alone
    crowd = staged(members.join(heads, "bucket").groupBy("bucket", "v").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.first("head_n").alias("head_n")), "crowd")
    fits = F.least("n", "head_n") >= F.greatest("n", "head_n") * SIMILAR
    pairs = staged(crowd.filter((F.col("v") != F.col("head")) & fits).select(F.col("head").alias("a"), F.col("v").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return None, None
    need = crowd.select("v").distinct()
    # one text for each vertex, found again by its hash: an id may stand for many rows, a text for one vertex
    first = sketch.join(need, "v").groupBy("v").agg(F.min("exact").alias("exact"))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(text).alias("exact"), text.alias("text")).groupBy("exact").agg(F.first("text").alias("text"))
    found = texts.join(first, "exact").select("v", "text")
    sets = staged(sets_of(found).dropDuplicates(["v"]), "sets")
    tested = staged(_verified(pairs, sets), "tested")
    good = tested.filter(F.col("similarity") >= SIMILAR).select("a", "b")
    roots = components(good) if not good.isEmpty() else None
    more = staged(_across(crowd, roots, sets), "across")
    if more.isEmpty():
        return good, roots
    return good.unionByName(more), components(more) if roots is None else joined(roots, more)


def _across(crowd: DataFrame, roots: DataFrame | None, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the components that meet in a bucket.

    Whoever is outside the bucket's largest component is compared with all members of the others, block by
    block: a task gets two bounded blocks of shingle sets and gives back the links alone.
    """
    named = crowd.select("bucket", "v").withColumn("root", F.col("v"))
    if roots is not None:
        named = crowd.select("bucket", "v").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = staged(named, "named")
    sizes = named.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    parts = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    open_ = staged(parts.select("bucket", F.col("m.root").alias("main"), blocks(F.col("all") - F.col("m.k"), OUTSIDE).alias("rows"), blocks(F.col("all"), MEMBERS).alias("cols")), "open")
    have = named.join(open_, "bucket").join(sets, "v")
    one = lambda n: F.pmod(F.xxhash64(F.lit(7), "v"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = have.filter(F.col("root") != F.col("main")).select("bucket", one(F.col("rows")).alias("row"), every(F.col("cols")).alias("col"), F.lit(True).alias("asks"), "v", "root", "s")
    members = have.select("bucket", every(F.col("rows")).alias("row"), one(F.col("cols")).alias("col"), F.lit(False).alias("asks"), "v", "root", "s")
    return outside.unionByName(members).groupBy("bucket", "row", "col").applyInPandas(_compare, "a long, b long").distinct()


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the asking sets and the others of other components."""
    asks, rest = group[group["asks"]], group[~group["asks"]]
    found: list[np.ndarray] = []
    if len(asks) and len(rest):
        flat = np.concatenate(rest["s"].to_numpy())
        size = rest["s"].map(len).to_numpy()
        first = np.cumsum(size) - size
        known, place = np.unique(flat, return_inverse=True)
        names, roots = rest["v"].to_numpy(), rest["root"].to_numpy()
        for v, root, own in zip(asks["v"], asks["root"], asks["s"], strict=True):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            mark = np.zeros(len(known), dtype=np.int32)
            mark[at[known[at] == own]] = 1
            common = np.add.reduceat(mark[place], first)
            near = (common >= SIMILAR * (size + len(own) - common) - 1e-9) & (roots != root)
            found.append(np.stack((np.minimum(names[near], v), np.maximum(names[near], v))))
    links_ = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pd.DataFrame({"a": links_[0], "b": links_[1]})


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, vertex, class id (least id of the class), rows in the class."""
    sketch = staged(sketches(docs, id_col, text_col), "sketch")
    _, roots = links(docs, sketch, text_col)
    rows = sketch.select("doc_id", "v")
    texts = rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("doc_id").alias("least"), F.count("*").alias("k"))
    if roots is not None:
        texts = texts.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    else:
        texts = texts.withColumn("root", F.col("v"))
    texts = staged(texts, "texts")
    whole = texts.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("k").alias("class_size"))
    named = staged(texts.join(whole, "root").select("v", "class_id", "class_size"), "classes")
    known = rows.join(named, "v", "left")
    return known.select("doc_id", "v", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, columns as they came: the row with the class's least id.

    Of several rows with that id and the same words one stays (the text with the least hash), also if the
    rows are equal. Documents without words all stay. A class whose rows have no id keeps one row too.
    """
    sketch = staged(sketches(docs, id_col, text_col), "sketch")
    _, roots = links(docs, sketch, text_col)
    rows = sketch.filter(F.col("v").isNotNull()).select("doc_id", "v", "exact")
    if roots is not None:
        rows = rows.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    else:
        rows = rows.withColumn("root", F.col("v"))
    # nulls last: an id is preferred to none
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "exact")).alias("m"))
    keep = staged(best.select(F.col("m.doc_id").alias("id"), F.col("m.exact").alias("hash")).distinct(), "keep")
    # columns of any name travel inside
    given = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col).cast("string")
    bare = ~F.coalesce(F.translate(text, UPPER, LOWER).rlike(WORD), F.lit(False))
    given = given.select("row", F.col("row").getField(id_col).alias("doc_id"), F.xxhash64(text).alias("exact"), bare.alias("bare"))
    kept = given.filter(~F.col("bare")).join(keep, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("exact") == F.col("hash")))
    # equal rows are still several: all but one of them go
    repeated = sketch.filter(F.col("v").isNotNull()).groupBy("doc_id", "exact").agg(F.count("*").alias("k")).filter("k > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["exact", "doc_id"])
    return kept.select("row.*").unionByName(given.filter("bare").select("row.*"))
