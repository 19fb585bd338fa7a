"""Similarity self-join of word n-gram sets by signature trees.

A document is the set of its four-word shingles; two link at a Jaccard similarity of 0.85 or more. Equal sets are
one vertex, so exact copies cost one row each. Sets that link have sizes in the same or in neighbouring size
classes and share a shingle among their first 15 % in any order that is the same for all sets (frequent shingles
last, then by hash). So a cell is a size class and such a shingle; it holds a tree over its sets:

* a leaf is one set: its token bitmap, as wide as twice the sizes of its class, its size, and how many of its
  tokens share a bit with others;
* a node over ``FAN`` children holds their OR-combined bitmap, the range of their sizes and the most shared bits.

The dual traversal starts with the pairs of top nodes of a cell, and goes down to pairs of children wherever the
sizes and the maximum possible overlap (common bits plus shared bits) still admit a link. What arrives at the
leaves is verified on the whole sets. Small cells are dealt out together by hash, large ones are cut into blocks
and each pair of blocks is a cell of its own, so no task gets an unbounded cell.

A cell in which far more pairs than sets arrive (a group of near copies) does not list them: its sets are compared
within the task, which gives back links between sets that were not joined yet, at most one a set. Each set is
compared first in one such cell, and then only with sets of other components. No link between different
components is lost, so the components are those of all links.

The order of shingles is free for the result. The most frequent ones are counted over all texts; the table that
puts them last holds at most ``HOT`` of them.

Words: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``. Fewer than four words, but not none, are one shingle. Null texts and
texts without words have an empty set and are alone. Rows with equal ids are separate documents; the component
id is the least id in the component (null only if no document of it has one). Shingles and sets are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.llm import textops
from tradeaxis.llm.components import components, joined
from tradeaxis.session import staged

SHINGLE = 4
#: Two sets link when 100 * common >= SIMILAR * union.
SIMILAR = 85
#: Children of a node.
FAN = 4
#: Entries in the table of frequent shingles, and how often a slice of texts must hold one to be counted.
HOT, OFTEN = 1 << 16, 4
#: Most sets in a block of a cell, and most tokens of them.
BLOCK, TOKENS = 1024, 1 << 22
#: Bytes of bitmaps and number of entries that small cells share a task by; bytes of nodes that are held at once.
BYTES, ENTRIES, NODES = 1 << 25, 500_000, 1 << 25
#: More surviving pairs a set than this make a cell dense.
DENSE = 4
#: Size classes are a little wider than the ratio at which sets can link, so rounding cannot part two that do.
_RATIO = 100 / (SIMILAR - 1)
WORDS = textops.Alphabet(textops.SPACED.inside, textops.LETTERS.fold)
_U64 = np.uint64


def class_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(_RATIO)).astype(np.int32)


def width(c: int) -> int:
    """Bits of the bitmaps of a size class: a power of two."""
    return max(64, 1 << math.ceil(math.log2(2 * _RATIO ** (c + 1))))


def block_of(c: int) -> int:
    """Most sets in a block of a size class."""
    return int(max(64, min(BLOCK, TOKENS // _RATIO ** (c + 1))))


def frequent(docs: DataFrame, text_col: str) -> np.ndarray:
    """The most frequent shingles, least frequent of them first; at most ``HOT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, (_, _, counts, hashes) in textops.word_slices(batch.column(0), WORDS):
                values, many = np.unique(textops.shingles(hashes, counts, SHINGLE)[0], return_counts=True)
                often = many >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(many[often])], ["t", "k"])

    seen = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "t long, k long").groupBy("t").agg(F.sum("k").alias("k"))
    top = seen.orderBy(F.desc("k"), "t").limit(HOT).toArrow()
    return top["t"].to_numpy()[::-1].view(_U64)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and value of the distinct shingles of each row, in order, and how many each row has."""
    values, rows = textops.shingles(hashes, counts, SHINGLE)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    rows, values = rows[new], values[new]
    return rows, values, np.bincount(rows, minlength=len(counts))


def vertex_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set, 0 for an empty one."""
    out = np.zeros(len(sizes), _U64)
    some = sizes > 0
    first = np.cumsum(sizes) - sizes
    if some.any():
        out[some] = textops.mix(np.add.reduceat(textops.mix(values), first[some]) + sizes[some].astype(_U64)) | _U64(1)
    return out


def signatures(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The token bitmap of every row, as wide as its size class asks."""
    wide = np.array([width(c) for c in class_of(sizes).tolist()], dtype=np.int64)
    base = np.cumsum(wide) - wide
    bits = np.zeros(int(wide.sum()), dtype=bool)
    bits[base[rows] + (values & (wide[rows] - 1).astype(_U64)).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little")
    return [packed[a : a + w].tobytes() for a, w in zip((base // 8).tolist(), (wide // 8).tolist(), strict=True)]


def sketches(docs: DataFrame, hot: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, hash of the text, vertex (null without words), size; and unless the batch has told that vertex before, its first shingles and bitmap."""
    lexicon = textops.Lexicon(hot)
    rank = np.zeros(len(lexicon.keys) + 1, dtype=np.int32)
    rank[np.searchsorted(lexicon.keys, hot)] = np.arange(1, len(hot) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, (_, _, counts, hashes) in textops.word_slices(batch.column(1), WORDS):
                rows, values, sizes = shingle_sets(hashes, counts)
                vertex = vertex_of(values, sizes)
                told = np.zeros(j - i, dtype=bool)
                told[np.unique(vertex, return_index=True)[1]] = True
                told &= sizes > 0
                keep = told[rows]
                rows, values = (np.cumsum(told) - 1)[rows[keep]], values[keep]
                own = sizes[told]
                bitmaps = signatures(rows, values, own)
                turn = rank[lexicon.find(values)]  # -1 is the last place, which ranks 0
                if turn.any():
                    values = values[np.lexsort((values, turn, rows))]
                first = own - (SIMILAR * own + 99) // 100 + 1
                start = np.cumsum(own) - own
                place = np.arange(len(values)) - np.repeat(start, own)
                some = place < np.repeat(first, own)
                per_row = np.zeros(j - i, np.int64)
                per_row[told] = first
                ends = np.concatenate(([0], np.cumsum(per_row)))
                marks = np.full(j - i, None, dtype=object)
                marks[told] = bitmaps
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array(vertex.view(np.int64), pa.int64(), mask=sizes == 0),
                        pa.array(sizes.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[some].view(np.int64))),
                        pa.array(marks.tolist(), pa.binary()),
                    ],
                    ["doc_id", "exact", "v", "n", "first", "bits"],
                )

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string("exact long, v long, n long, first array<long>, bits binary").fields])
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), text, F.xxhash64(text)).mapInArrow(run, schema)


def sets_of(docs: DataFrame, sketch: DataFrame, need: DataFrame, text_col: str) -> DataFrame:
    """``(v, s)``: the whole shingle sets of the vertices asked for, each made from one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, (_, _, counts, hashes) in textops.word_slices(batch.column(1), WORDS):
                _, values, sizes = shingle_sets(hashes, counts)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))], ["v", "s"])

    one = sketch.filter(F.col("bits").isNotNull()).join(need, "v").groupBy("v").agg(F.min("exact").alias("exact"))
    text = F.col(text_col).cast("string")
    # one row for each text before it meets its vertex: a text of many rows is folded where it lies
    texts = docs.select(F.xxhash64(text).alias("exact"), text.alias("text")).groupBy("exact").agg(F.first("text").alias("text"))
    return texts.join(one, "exact").select("v", "text").mapInArrow(run, "v long, s array<long>")


def cells(sketch: DataFrame) -> DataFrame:
    """``(c, slot, i, j, v, home, side, ts)``: which cells of shingles ``ts`` a set is in, by the task that gets them.

    Sets of the next size class are guests of a cell: they meet its own sets, not each other.
    """
    told = sketch.filter(F.col("bits").isNotNull())
    tokens = told.select("v", F.floor(F.log("n") / math.log(_RATIO)).cast("int").alias("c"), F.explode("first").alias("t"))
    shared = tokens.groupBy("t").agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a != b").select("t")
    crowd = staged(tokens.join(shared, "t").distinct(), "crowd")
    both = crowd.select("c", "t", "v", F.lit(True).alias("home")).unionByName(crowd.select((F.col("c") - 1).alias("c"), "t", "v", F.lit(False).alias("home")))
    counts = staged(both.groupBy("c", "t").agg(F.count("*").alias("k"), F.sum(F.col("home").cast("int")).alias("own")).filter("own > 0 and k > 1").select("c", "t", "k"), "counts")
    load = {r["c"]: r["k"] for r in counts.groupBy("c").agg(F.sum("k").alias("k")).collect()}  # a number per size class
    sets = {r["c"]: r["k"] for r in crowd.select("c", "v").distinct().groupBy("c").agg(F.count("*").alias("k")).collect()}
    if not load:
        return counts.sparkSession.createDataFrame([], "c int, slot long, i int, j int, v long, home boolean, side boolean, ts array<long>")

    def by_class(of) -> F.Column:
        return F.create_map(*(F.lit(x) for c in load for x in (c, int(of(c)))))[F.col("c")]

    # a set's bitmap goes to each task that has one of its cells: as few as memory allows
    tasks = by_class(lambda c: 1 + max((sets.get(c, 0) + sets.get(c + 1, 0)) * width(c) // 8 // BYTES, load[c] // ENTRIES))
    parts = F.ceil(F.col("k") / by_class(block_of)).cast("int")
    placed = both.join(counts, ["c", "t"]).withColumn("parts", parts)
    small = placed.filter("parts = 1").select("c", F.pmod(F.xxhash64("t"), tasks).alias("slot"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "v", "home", F.lit(False).alias("side"), "t")
    mine = F.pmod(F.xxhash64(F.lit(3), "v"), F.col("parts")).cast("int")
    large = placed.filter("parts > 1").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select("c", F.col("t").alias("slot"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "v", "home", (F.col("mine") > F.col("other")).alias("side"), "t")
    return small.unionByName(large).groupBy("c", "slot", "i", "j", "v", "home", "side").agg(F.collect_list("t").alias("ts"))  # at most the set's first shingles


class Level:
    """Nodes of one height, of all trees of a task."""

    def __init__(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, spare: np.ndarray, home: np.ndarray, bits: np.ndarray, of: np.ndarray | None = None):
        self.low, self.high = low, high  # children below
        self.least, self.most, self.spare, self.home = least, most, spare, home
        self.bits, self.of = bits, of

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.bits[at if self.of is None else self.of[at]]

    def admits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a link: by sizes, then by the maximum possible overlap."""
        ok = (100 * self.most[a] >= SIMILAR * self.least[b]) & (100 * self.most[b] >= SIMILAR * self.least[a]) & (self.home[a] | self.home[b])
        at = np.flatnonzero(ok)
        step = max(1, (1 << 20) // self.bits.shape[1])
        for i in range(0, len(at), step):
            x, y = a[at[i : i + step]], b[at[i : i + step]]
            common = np.bitwise_count(self.rows(x) & self.rows(y)).sum(axis=1, dtype=np.int64) + np.minimum(self.spare[x], self.spare[y])
            ok[at[i : i + step]] = (100 + SIMILAR) * common >= SIMILAR * (self.least[x] + self.least[y])
        return ok


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every range, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _within(first: np.ndarray, count: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a < b (or a <= b) of places in each of some ranges."""
    a = _ranges(first, count)
    left = np.repeat(first + count, count) - a - (0 if itself else 1)
    return np.repeat(a, left), _ranges(a + (0 if itself else 1), left)


def _children(level: Level, a: np.ndarray, b: np.ndarray, leaves: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of node pairs; a node with itself gives each pair of its children once."""
    same = a == b
    x, y = _within(level.low[a[same]], (level.high - level.low)[a[same]], not leaves)
    a, b = a[~same], b[~same]
    many, other = (level.high - level.low)[a], (level.high - level.low)[b]
    one = _ranges(level.low[a], many)
    two = np.repeat(other, many)
    return np.concatenate((x, np.repeat(one, two))), np.concatenate((y, _ranges(np.repeat(level.low[b], many), two)))


def grow(first: np.ndarray, count: np.ndarray, leaves: Level) -> tuple[list[Level], list[tuple[np.ndarray, np.ndarray]]]:
    """The levels over leaves in ranges, one range a tree, and for each level the trees whose top it is: first node and nodes."""
    levels, tops = [leaves], []
    while True:
        done = count <= FAN
        tops.append((first[done], count[done]))
        first, count = first[~done], count[~done]
        if not len(first):
            return levels, tops
        below = levels[-1]
        nodes = -(-count // FAN)
        nth = _ranges(np.zeros(len(nodes), np.int64), nodes)
        low = np.repeat(first, nodes) + FAN * nth
        high = np.minimum(low + FAN, np.repeat(first + count, nodes))
        at = _ranges(low, high - low)
        edge = np.cumsum(high - low) - (high - low)
        fold = lambda f, x: f.reduceat(x[at], edge)
        levels.append(Level(low, high, fold(np.minimum, below.least), fold(np.maximum, below.most), fold(np.maximum, below.spare), fold(np.logical_or, below.home), np.bitwise_or.reduceat(below.rows(at), edge, axis=0)))
        first, count = np.cumsum(nodes) - nodes, nodes


def traverse(first: np.ndarray, count: np.ndarray, leaves: Level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of the same tree that node bounds and their own bounds admit."""
    levels, tops = grow(first, count, leaves)
    a = b = np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = _within(*tops[k], k > 0)
        a, b = np.concatenate((a, x)), np.concatenate((b, y))
        ok = levels[k].admits(a, b)
        a, b = a[ok], b[ok]
        if k:
            a, b = _children(levels[k], a, b, k == 1)
    return a, b


FOUND = "c int, t long, i int, j int, side boolean, v long, w long"


def _candidates(cell: pa.Table) -> pa.Table:
    """Candidate pairs (v, w) of a task's cells; of a dense cell its sets instead (w is null)."""
    kinds = {"c": pa.int32(), "t": pa.int64(), "i": pa.int32(), "j": pa.int32(), "side": pa.bool_(), "v": pa.int64(), "w": pa.int64()}
    c, i, j = (cell[x][0].as_py() for x in ("c", "i", "j"))
    words = width(c) // 64
    v, n = cell["v"].to_numpy(), cell["n"].to_numpy()
    home, side = cell["home"].to_numpy(), cell["side"].to_numpy()
    bits = np.zeros((len(v), words), _U64)
    for k, x in enumerate(cell["bits"]):
        own = np.frombuffer(x.as_buffer(), "<u8")
        bits[k] = np.bitwise_or.reduce(own.reshape(-1, words), axis=0)  # a guest's may be wider
    lists = cell["ts"].combine_chunks()
    many = np.diff(lists.offsets.to_numpy().astype(np.int64))
    row, t = np.repeat(np.arange(len(v)), many), lists.flatten().to_numpy()
    order = np.lexsort((row, n[row], t))
    row, t = row[order], t[order]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(t)), dtype=bool), t[1:] != t[:-1])))
    count = np.diff(np.append(edge, len(t)))
    spare = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    leaves = Level(np.zeros(0), np.zeros(0), n[row], n[row], spare[row], home[row], bits, row)
    # some trees at a time, so that their nodes stay within bounds
    turn = np.cumsum(count) // max(1, NODES // (8 * words))
    found = [traverse(edge[turn == k], count[turn == k], leaves) for k in np.unique(turn)]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    if i != j:
        across = side[row[a]] != side[row[b]]
        a, b = a[across], b[across]
    tree = np.searchsorted(edge, a, "right") - 1
    # near copies meet in many trees of a task: a pair belongs to the first
    order = np.argsort(tree, kind="stable")
    a, b, tree = a[order], b[order], tree[order]
    code = np.minimum(row[a], row[b]) * len(v) + np.maximum(row[a], row[b])
    own = np.sort(np.unique(code, return_index=True)[1])
    a, b, tree, code = a[own], b[own], tree[own], code[own]
    dense = np.bincount(tree, minlength=len(edge)) > DENSE * count
    pairs = code[~dense[tree]]
    x, y = v[pairs // max(1, len(v))], v[pairs % max(1, len(v))]
    hot = np.flatnonzero(np.repeat(dense, count))
    # only sets that are in a pair of that cell
    hot = hot[np.isin(hot, np.concatenate((a, b)))]
    sets = len(hot)
    none = [None] * len(x)
    columns = {
        "c": [None] * len(x) + [c] * sets,
        "t": none + t[hot].tolist(),
        "i": none + [i] * sets,
        "j": none + [j] * sets,
        "side": none + side[row[hot]].tolist(),
        "v": np.concatenate((np.minimum(x, y), v[row[hot]])),
        "w": np.maximum(x, y).tolist() + [None] * sets,
    }
    return pa.table({name: pa.array(columns[name], kind) for name, kind in kinds.items()})


def _compare(cell: pa.Table) -> pa.Table:
    """Links of a dense cell's sets, but for sets that are joined already or by a link found before."""
    v, side, apart = cell["v"].to_numpy(), cell["side"].to_numpy(), cell["i"][0].as_py() != cell["j"][0].as_py()
    _, label = np.unique(cell["root"].to_numpy(), return_inverse=True)
    lists = cell["s"].combine_chunks()
    first = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(first)
    known, place = np.unique(lists.values.to_numpy()[first[0] : first[-1]], return_inverse=True)
    first = first[:-1] - first[0]
    mark = np.zeros(len(known), dtype=np.int64)
    links: list[tuple[int, int]] = []
    for r in range(len(v) - 1):
        fits = (label[r + 1 :] != label[r]) & (100 * np.minimum(size[r + 1 :], size[r]) >= SIMILAR * np.maximum(size[r + 1 :], size[r]))
        if apart:
            fits &= side[r + 1 :] != side[r]
        others = np.flatnonzero(fits) + r + 1
        if not len(others):
            continue
        own = place[first[r] : first[r] + size[r]]
        mark[own] = 1
        common = np.add.reduceat(mark[place[_ranges(first[others], size[others])]], np.cumsum(size[others]) - size[others])
        mark[own] = 0
        near = others[100 * common >= SIMILAR * (size[others] + size[r] - common)]
        if len(near):
            met, at = np.unique(label[near], return_index=True)
            links += [(v[r], v[x]) for x in near[at]]
            label[np.isin(label, met)] = label[r]
            if (label == label[0]).all():
                break
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that link, on their whole sets."""
    left = pairs.join(sets.withColumnsRenamed({"v": "a", "s": "sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"v": "b", "s": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.filter(100 * common >= SIMILAR * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _gathered(dense: DataFrame) -> DataFrame:
    """``(c, t, i, j, side, v, root)``: every set of a dense cell once, where its least shingle is, in blocks.

    Each block of a cell also gets the cell's least set, so that blocks of near copies join through it. What is
    left apart after that meets in the other cells.
    """
    place = dense.groupBy("v").agg(F.min(F.struct("t", "c")).alias("at")).select("v", "at.*")
    size = place.groupBy("c", "t").agg(F.count("*").alias("k"), F.min("v").alias("head"))
    parts = F.ceil(F.col("k") / F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(TOKENS / F.pow(F.lit(_RATIO), F.col("c") + 1))))).cast("int")
    size = staged(size.select("c", "t", "head", parts.alias("parts")), "heads")
    own = place.join(size, ["c", "t"]).filter(F.col("v") != F.col("head")).select("c", "t", F.pmod(F.xxhash64(F.lit(4), "v"), F.col("parts")).cast("int").alias("i"), "v")
    heads = size.select("c", "t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("head").alias("v"))
    return own.unionByName(heads).select("c", "t", "i", F.col("i").alias("j"), F.lit(False).alias("side"), "v", F.col("v").alias("root"))


def roots(docs: DataFrame, sketch: DataFrame, text_col: str = "text") -> DataFrame | None:
    """``(v, root)`` of all sets that link with another one; None if there are none."""
    shapes = staged(sketch.filter(F.col("bits").isNotNull()).groupBy("v").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "shapes")
    key = ["c", "slot", "i", "j"]
    dealt = cells(sketch).join(shapes, "v").select(*key, "v", "n", "home", "side", "bits", "ts")
    found = staged(dealt.groupBy(*key).applyInArrow(_candidates, FOUND), "candidates")
    if found.isEmpty():
        return None
    pairs = found.filter(F.col("w").isNotNull()).select(F.col("v").alias("a"), F.col("w").alias("b")).distinct()
    dense = found.filter(F.col("w").isNull()).drop("w")
    need = found.select(F.explode(F.array("v", "w")).alias("v")).filter(F.col("v").isNotNull()).distinct()
    sets = staged(sets_of(docs, sketch, need, text_col), "sets")
    links = staged(_verified(pairs, sets), "links")
    at = ["c", "t", "i", "j"]
    near = staged(_gathered(dense).join(sets, "v").groupBy("c", "t", "i").applyInArrow(_compare, "a long, b long"), "near")
    links = links.unionByName(near)
    labels = components(links) if not links.isEmpty() else None
    rest = dense.withColumn("root", F.col("v")) if labels is None else dense.join(labels, "v", "left").withColumn("root", F.coalesce("root", "v"))
    rest = staged(rest, "rest")
    open_ = rest.groupBy(*at).agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select(*at)
    more = staged(rest.join(open_, at).join(sets, "v").groupBy(*at).applyInArrow(_compare, "a long, b long").distinct(), "more")
    if more.isEmpty():
        return labels
    return components(more) if labels is None else joined(labels, more)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per document."""
    sketch = staged(sketches(docs, frequent(docs, text_col), id_col, text_col), "signatures")
    labels = roots(docs, sketch, text_col)
    rows = sketch.select("doc_id", "v", "n")
    per = rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("doc_id").alias("least"))
    per = per.withColumn("root", F.col("v")) if labels is None else per.join(labels, "v", "left").withColumn("root", F.coalesce("root", "v"))
    per = staged(per, "least")
    named = per.join(per.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("v", "component_id")
    known = rows.join(staged(named, "components"), "v", "left")
    own = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return known.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
