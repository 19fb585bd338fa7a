"""Quality by rules and an isolation forest on rule statistics.

Every text gives statistics: word and symbol counts, repeated lines and word windows, and shares made from
them. Fixed rules fail the plain cases. The rest is judged by an isolation forest: random splits of random
statistics isolate odd documents after few splits, so a short mean path means an anomaly. Trees grow on
random subsamples of a bounded sample of documents, taken by hash of their text; every document is scored.

The threshold on the anomaly score comes from labelled rows, all of them: they are counted by score in fixed
bins, and the least score is taken from which on anomalies are mostly labelled bad, weighing both classes
alike (best sum of the shares of good rows kept and bad rows dropped).

Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at line feeds. Defined results: a null or empty text has no
words and fails the base rules. A null label or id is no label; rows of one id with labels that disagree
count as bad. Repeated rows are judged one by one. Without labels of both classes nothing but the base
rules drops a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.llm import textops

SAMPLE = 20_000
TREES, SUBSAMPLE = 120, 256
BINS = 2000
SEED = 11
LEAST_WORDS, MOST_REPEATED = 50, 50  # words, per cent of words
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees, in this order.
STATISTICS = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "stop_share", "end_mark_share", "bar_share", "digit_share", "upper_share", "words_per_line")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_END = np.zeros(256, bool)
_END[list(b"!?:;")] = True


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT, _UPPER, _BAR = _table(b"0123456789"), _table(bytes(range(65, 91))), _table(b"|")
_NOT_FEED = ~_table(b"\n")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def _repeats(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each (row, key), whether it occurs in its row again, and whether it occurred before."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    same = np.zeros(len(keys) + 1, dtype=bool)
    if len(keys) > 1:
        same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order] = same[1:] | same[:-1]
    before[order] = same[:-1]
    return np.stack((again, before))


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows × COUNTS) and forest statistics (rows × STATISTICS) of every whole text."""
    counts_out, stats_out = [], []
    for i, j, data, offsets, (starts, ends, counts, hashes) in textops.word_slices(column, textops.SPACED):
        n = j - i
        row = np.repeat(np.arange(n), counts)
        points = (data & 0xC0) != 0x80
        word_chars = _per_row(points & textops.SPACED.inside[data], offsets)
        symbols = _per_row(_SYMBOL[data], offsets)
        # lines: pieces between line feeds; only those with a word matter, and no empty one has any
        from_, to, per = textops.segment(data, offsets, _NOT_FEED)
        line_row = np.repeat(np.arange(n), per)
        worded = np.diff(np.searchsorted(starts, np.stack((from_, to), axis=1)), axis=1)[:, 0] > 0 if len(from_) else np.zeros(0, bool)
        from_, to, line_row = from_[worded], to[worded], line_row[worded]
        line_hash = textops.hash_pieces(data, from_, to, textops.SPACED.fold)
        lines = np.bincount(line_row, minlength=n)
        dup = np.bincount(line_row[_repeats(line_row, line_hash)[1]], minlength=n)
        # words in three-word windows that occur again
        left = np.cumsum(counts) - counts
        place = np.arange(len(hashes)) - np.repeat(left, counts)
        full = np.flatnonzero(place + 3 <= np.repeat(counts, counts))
        window = hashes[full]
        for k in (1, 2):
            window = textops.mix(window * np.uint64(0x9E3779B97F4A7C15) + hashes[full + k] + np.uint64(k))
        again = full[_repeats(row[full], window)[0]]
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[again + k] = True
        repeated = np.bincount(row[covered], minlength=n)
        distinct = np.bincount(row[~_repeats(row, hashes)[1]], minlength=n)
        short = np.bincount(row[ends - starts <= 3], minlength=n)
        marks = np.bincount(row[_END[data[ends - 1]]], minlength=n)
        digits, upper, bars = (_per_row(t[data], offsets) for t in (_DIGIT, _UPPER, _BAR))
        some, chars = np.maximum(counts, 1), np.maximum(word_chars, 1)
        counts_out.append(np.stack((counts, word_chars, symbols, dup, repeated), axis=1))
        stats_out.append(
            np.stack(
                (word_chars / some, symbols / chars, dup / np.maximum(lines, 1), repeated / some, distinct / np.sqrt(some), short / some,
                 marks / some, bars / some, digits / chars, upper / chars, np.log1p(counts / np.maximum(lines, 1))),
                axis=1,
            )
        )
    if not counts_out:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(STATISTICS)))
    return np.concatenate(counts_out), np.concatenate(stats_out)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search in a tree of n points: what a leaf's depth leaves out."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (n - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays of nodes: statistic (-1 at a leaf), split value, left child (right is next), path length."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    normal: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); higher is odder."""
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            rows = np.arange(len(x))
            while len(rows):
                inner = self.feature[node[rows]] >= 0
                rows = rows[inner]
                at = node[rows]
                node[rows] = self.child[at] + (x[rows, self.feature[at]] >= self.value[at])
            total += self.path[node]
        return 2.0 ** (-total / max(1, len(self.roots)) / self.normal)


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest | None:
    """A forest on a sample of statistics; None if there is nothing to tell apart."""
    if len(x) < 2:
        return None
    draw = np.random.default_rng(seed)
    size = min(subsample, len(x))
    limit = int(np.ceil(np.log2(size)))
    feature, value, child, path, roots = [], [], [], [], []

    def add() -> int:
        for store, empty in ((feature, -1), (value, 0.0), (child, -1), (path, 0.0)):
            store.append(empty)
        return len(feature) - 1

    for _ in range(trees):
        roots.append(root := add())
        todo = [(root, x[draw.choice(len(x), size, replace=False)], 0)]
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            able = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(able):
                path[node] = depth + float(_mean_path(len(part)))
                continue
            k = int(draw.choice(able))
            cut = draw.uniform(low[k], high[k])
            cut = high[k] if cut <= low[k] else cut
            first, second = add(), add()
            feature[node], value[node], child[node] = k, cut, first
            right = part[:, k] >= cut
            todo += [(first, part[~right], depth + 1), (second, part[right], depth + 1)]
    return Forest(np.array(feature), np.array(value), np.array(child), np.array(path), np.array(roots), float(_mean_path(size)))


def measured(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts, base verdict and anomaly score (0.5 without a forest), and the statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kind = docs.schema[id_col].dataType
    rest = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, statistics array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, stats = measure(batch.column(1))
            score = np.full(len(stats), 0.5) if shared.value is None else shared.value.score(stats)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(base_failed(counts)), pa.array(score), lists],
                ["doc_id", *COUNTS, "base_failed", "anomaly", "statistics"],
            )

    schema = T.StructType([T.StructField("doc_id", kind, True), *T._parse_datatype_string(rest).fields])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def train(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Forest | None:
    """The forest on about ``sample`` documents that pass the base rules, at most twice as many."""
    n = docs.count()
    part = docs.filter(F.pmod(F.xxhash64(F.lit(SEED), text_col), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / max(1, n)))))
    told = measured(part.select(F.lit(0).alias("doc_id"), text_col), None, "doc_id", text_col).filter(~F.col("base_failed"))
    rows = told.select("statistics").distinct().orderBy(F.xxhash64("statistics")).limit(2 * sample).toArrow()
    flat = rows["statistics"].combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return grow(flat.flatten().to_numpy().reshape(-1, len(STATISTICS))) if len(flat) else None


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The anomaly score from which on a document is dropped, from all labelled rows that pass the base rules."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bins = F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")
    rows = scored.filter(~F.col("base_failed")).select("doc_id", bins).join(known, "doc_id").groupBy("bin").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect()
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in rows:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return float("inf")
    gain = np.concatenate(([0], np.cumsum(good) / good.sum())) + 1 - np.concatenate(([0], np.cumsum(bad) / bad.sum()))
    return int(len(gain) - 1 - np.argmax(gain[::-1])) / BINS
