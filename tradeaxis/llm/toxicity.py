"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are the chain's positions. A word's evidence is its own identity and its first four, five and six
bytes, so that inflected forms share what is learned; two states (plain, toxic) with learned transitions
connect neighbours. Forward-backward gives each word its marginal; a logistic layer turns the largest
marginal and the expected number of toxic words into the document's score; words at 0.5 and over are the
offending spans.

Document labels are all there is, so the words of the fitting sample are labelled by distant supervision:
in a toxic document a word is toxic if it, or one of its beginnings, occurs almost only in toxic documents
(likelihood-ratio test over documents, near copies counted once); in a clean document no word is.

Fitting uses at most ``SAMPLE`` labelled rows of each class, taken by hash of their id from those no longer than
``LONGEST`` bytes; telling words are counted in all of it, the field is fitted on at most ``BUSY`` blocks
with a telling word and ``IDLE`` without, drawn at random. Scoring reads every whole text; a chain is a block of ``BLOCK`` consecutive words, so
memory does not follow the longest text. Nothing is shuffled but the sample.

Defined results: a null or empty text, or one without words, gets the score of no evidence. Repeated rows
are scored one by one; labels of one document that disagree count as toxic; a null label or null id is no
label. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.llm import textops
from tradeaxis.session import staged

SAMPLE = 2500
LONGEST = 200_000
BLOCK = 128
#: Most blocks the field is fitted on, with and without a telling word; what is left out is weighed in.
BUSY, IDLE = 2500, 500
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6)
_SALTS = [np.uint64(0xA24BAED4963EE407 * k % (1 << 64)) for k in range(1, 2 + len(BEGINNINGS))]
_TINY = 1e-12


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -10.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros(3))  # plain to toxic, toxic to plain, toxic to toxic
    layer: np.ndarray | None = None  # intercept, largest marginal's log-odds, expected toxic words

    def __post_init__(self):
        self.lexicon = textops.Lexicon(self.keys)
        lengths = np.arange(1, BLOCK + 1)
        idle = marginals(np.full((BLOCK, BLOCK), self.bias), lengths, self.moves)
        mask = np.arange(BLOCK) < lengths[:, None]
        self.idle_max = np.concatenate(([-np.inf], np.where(mask, idle, 0).max(axis=1)))
        self.idle_sum = np.concatenate(([0.0], np.where(mask, idle, 0).sum(axis=1)))


def evidence(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, keys) for each kind of evidence: identity, then each beginning."""
    out = [(np.arange(len(starts)), hashes ^ _SALTS[0])]
    lengths = ends - starts
    rest, value = np.arange(len(starts)), np.zeros(len(starts), np.uint64)
    powers = textops._powers(8)
    for k in range(max(BEGINNINGS)):
        alive = lengths[rest] > k
        rest, value = rest[alive], value[alive]
        value = value + textops._BYTE[textops.LETTERS.fold[data[starts[rest] + k]]] * powers[k]
        if k + 1 in BEGINNINGS:
            out.append((rest, textops.mix(value) ^ _SALTS[1 + BEGINNINGS.index(k + 1)]))
    return out


def _log_odds(r: np.ndarray, to_plain: tuple[float, float], to_toxic: tuple[float, float]) -> np.ndarray:
    """log of (e^(r+b1) + e^b0) / (e^(r+a1) + e^a0)."""
    return np.logaddexp(r + to_toxic[1], to_toxic[0]) - np.logaddexp(r + to_plain[1], to_plain[0])


def chains(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds of every position, and backward log-odds, of all blocks at once."""
    up, down, stay = moves
    wide = scores.shape[1]
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, wide):
        forward[:, t] = scores[:, t] + _log_odds(forward[:, t - 1], (0.0, down), (up, stay))
    for t in range(wide - 2, -1, -1):
        ahead = _log_odds(scores[:, t + 1] + backward[:, t + 1], (0.0, up), (down, stay))
        backward[:, t] = np.where(t + 1 < lengths, ahead, 0.0)
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    forward, backward = chains(scores, lengths, moves)
    return _sigmoid(forward + backward)


def blocks_of(counts: np.ndarray):
    """Block and place in the block of every word; first block of every row; length of every block."""
    per_row = -(-counts // BLOCK)
    base = np.concatenate(([0], np.cumsum(per_row)))
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    block = base[row] + place // BLOCK
    return block, place % BLOCK, base, np.bincount(block, minlength=int(base[-1]))


def score_batch(column: pa.Array, model: Model, with_spans: bool = False):
    """Score of every row; with spans also (row, start, end, marginal) in code points."""
    tops, sums, spans = [], [], []
    for i, _, data, offsets, (starts, ends, counts, hashes) in textops.word_slices(column, textops.LETTERS):
        block, place, base, lengths = blocks_of(counts)
        top, total = model.idle_max[lengths], model.idle_sum[lengths]
        rows, found = [], []
        for at, keys in evidence(data, starts, ends, hashes):
            hit = model.lexicon.find(keys)
            rows.append(at[hit >= 0])
            found.append(hit[hit >= 0])
        rows, found = np.concatenate(rows), np.concatenate(found)
        if len(rows):
            busy, own = np.unique(block[rows], return_inverse=True)
            scores = np.full((len(busy), BLOCK), model.bias)
            np.add.at(scores, (own, place[rows]), model.weights[found])
            marginal = marginals(scores, lengths[busy], model.moves)
            marginal[np.arange(BLOCK) >= lengths[busy][:, None]] = 0
            top[busy], total[busy] = marginal.max(axis=1), marginal.sum(axis=1)
            if with_spans and (marginal >= 0.5).any():
                first = np.searchsorted(block, busy)
                b, t = np.nonzero(marginal >= 0.5)
                word = first[b] + t
                row = np.searchsorted(offsets, starts[word], "right") - 1
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                origin = points[offsets[row]]
                spans.append(np.rec.fromarrays([row + i, points[starts[word]] - origin, points[ends[word]] - origin, marginal[b, t]], names="row,start,end,p"))
        filled = np.flatnonzero(counts)
        row_top, row_sum = np.full(len(counts), -np.inf), np.zeros(len(counts))
        if len(filled):
            row_top[filled] = np.maximum.reduceat(top, base[:-1][filled])
            row_sum[filled] = np.add.reduceat(total, base[:-1][filled])
        tops.append(row_top)
        sums.append(row_sum)
    top = np.concatenate(tops) if tops else np.zeros(0)
    total = np.concatenate(sums) if sums else np.zeros(0)
    x = features(top, total)
    score = np.zeros(len(x)) if model.layer is None else _sigmoid(x @ model.layer)
    return (score, spans, x) if with_spans else (score, [], x)


def features(top: np.ndarray, total: np.ndarray) -> np.ndarray:
    p = np.clip(np.where(np.isfinite(top), top, 0), 1e-7, 1 - 1e-7)
    return np.stack((np.ones(len(p)), np.log(p / (1 - p)), np.log1p(total)), axis=1)


def fit_layer(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights, none of them negative: more evidence never lowers a score."""
    used = list(range(x.shape[1]))
    while True:
        w = fit_logistic(x[:, used], y, weight)
        wrong = [k for k, v in zip(used[1:], w[1:], strict=True) if v < 0]
        if not wrong:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        used.remove(max(wrong))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio statistic of occurrence in toxic against clean documents."""

    def term(k, n, p):
        p = np.clip(p, _TINY, 1 - _TINY)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (a + b) / (n1 + n0)
    return 2 * (term(a, n1, a / n1) + term(b, n0, b / n0) - term(a, n1, both) - term(b, n0, both))


def fit(texts: pa.Array, toxic: np.ndarray, prior: float) -> Model:
    """The model from a sample of labelled texts; ``prior`` is the share of toxic among all labels."""
    if not (toxic == 1).any() or not (toxic == 0).any():
        return Model()
    # first pass: in which texts each evidence occurs; of a slice only distinct pairs are kept
    keys, docs, signatures, counts = [], [], [], []
    for i, j, data, offsets, (starts, ends, n, hashes) in textops.word_slices(texts, textops.LETTERS):
        row = np.repeat(np.arange(i, j, dtype=np.int32), n)
        for where, key in evidence(data, starts, ends, hashes):
            own = row[where]
            order = np.lexsort((own, key))
            key, own = key[order], own[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            keys.append(key[new])
            docs.append(own[new])
        runs, own = textops.shingles(hashes, n, 5)
        least = np.zeros(j - i, np.uint64)
        some = np.unique(own, return_index=True)
        if len(runs):
            least[some[0]] = np.minimum.reduceat(textops.mix(runs), some[1])
        signatures.append(least)
        counts.append(n)
    counts = np.concatenate(counts)
    # of near copies, which share the least shingle, one tells
    voices = np.zeros(len(toxic), dtype=bool)
    voices[np.unique(np.concatenate(signatures), return_index=True)[1]] = True
    key, doc = np.concatenate(keys), np.concatenate(docs)
    key, doc = key[voices[doc]], doc[voices[doc]]
    del keys, docs
    order = np.argsort(key, kind="stable")
    key, by = key[order], toxic[doc[order]]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
    names = key[edge]
    a = np.add.reduceat(by == 1, edge, dtype=float) if len(edge) else np.zeros(0)
    b = np.add.reduceat(by == 0, edge, dtype=float) if len(edge) else np.zeros(0)
    del key, doc, by, order
    n1, n0 = max(1, int((voices & (toxic == 1)).sum())), max(1, int((voices & (toxic == 0)).sum()))
    lift = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    telling = (_ratio(a, b, n1, n0) >= 15.1) & (np.abs(lift) >= 1) & (a + b >= 3)
    strong = telling & (lift >= 2.5)
    used = np.flatnonzero(telling)
    # second pass: where the telling evidence is
    lexicon, at, places, found = textops.Lexicon(names[used]), 0, [], []
    labels = np.zeros(int(counts.sum()))
    for i, j, data, offsets, (starts, ends, n, hashes) in textops.word_slices(texts, textops.LETTERS):
        row = np.repeat(np.arange(i, j), n)
        for where, key in evidence(data, starts, ends, hashes):
            f = lexicon.find(key)
            hit = np.flatnonzero(f >= 0)
            places.append(where[hit] + at)
            found.append(f[hit].astype(np.int64))
            guilty = hit[strong[used[f[hit]]]]
            labels[(where[guilty] + at)[toxic[row[where[guilty]]] == 1]] = 1
        at += len(hashes)
    rows, feature = np.concatenate(places), np.concatenate(found)

    block, place, _, lengths = blocks_of(counts)
    busy = np.unique(block[rows])
    idle = np.setdiff1d(np.arange(len(lengths)), busy)
    spread = np.random.default_rng(7)
    busy_kept = np.sort(spread.permutation(busy)[:BUSY])
    idle_kept = np.sort(spread.permutation(idle)[:IDLE])
    chosen = np.concatenate((busy_kept, idle_kept))
    factor = np.concatenate((np.full(len(busy_kept), len(busy) / max(1, len(busy_kept))), np.full(len(idle_kept), len(idle) / max(1, len(idle_kept)))))
    slot = np.full(len(lengths), -1)
    slot[chosen] = np.arange(len(chosen))
    inside = slot[block[rows]] >= 0
    cell = slot[block[rows[inside]]] * BLOCK + place[rows[inside]]
    feature = feature[inside]
    target = np.zeros((len(chosen), BLOCK))
    own = slot[block] >= 0
    target[slot[block[own]], place[own]] = labels[own]
    long = lengths[chosen]
    mask = (np.arange(BLOCK) < long[:, None]) * factor[:, None]
    model = _ascend(cell, feature, np.where(strong[used], lift[used], 0.0), target, long, mask, float(factor.sum()))
    fitted = Model(names[used], *model)
    _, _, x = score_batch(texts, fitted)
    share = np.where(toxic == 1, prior / max(1, (toxic == 1).sum()), (1 - prior) / max(1, (toxic == 0).sum())) * len(toxic)
    fitted.layer = fit_layer(x, toxic.astype(float), share)
    return fitted


def _ascend(cell, feature, begin, target, lengths, mask, scale, rounds: int = 150):
    """Regularised conditional likelihood by adaptive gradient steps; expectations by forward-backward.

    Evidence of the labelled words begins at its log-odds over documents.
    """
    size = len(begin)
    theta = np.concatenate((begin, [-6.0, 0.0, 0.0, 0.0]))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    pair = mask[:, 1:]
    y0, y1 = target[:, :-1], target[:, 1:]
    seen = np.array([(pair * (1 - y0) * y1).sum(), (pair * y0 * (1 - y1)).sum(), (pair * y0 * y1).sum()])
    for k in range(1, rounds + 1):
        weights, bias, moves = theta[:size], theta[size], theta[size + 1 :]
        scores = bias + np.bincount(cell, weights[feature], minlength=target.size).reshape(target.shape)
        forward, backward = chains(scores, lengths, moves)
        p = _sigmoid(forward + backward)
        miss = (target - p) * mask
        up, down, stay = moves
        ahead = scores[:, 1:] + backward[:, 1:]
        four = np.stack((np.zeros_like(ahead), up + ahead, forward[:, :-1] + down, forward[:, :-1] + stay + ahead))
        four = np.exp(four - four.max(axis=0))
        four *= pair / four.sum(axis=0)
        expected = four[1:].sum(axis=(1, 2))
        grad = np.concatenate((np.bincount(feature, miss.ravel()[cell], minlength=size), [miss.sum()], seen - expected)) / scale
        grad -= np.concatenate((2e-5 * weights, [0.0], 1e-3 * moves))
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta = theta + 0.25 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return theta[:size], float(theta[size]), theta[size + 1 :]


def held_out(id_col: str = "doc_id"):
    """Rows kept for judging: CRC-32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the labelled rows that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    # the sample is drawn among rows that may be in it, so long ones do not shrink it
    fits = docs.filter(F.octet_length(F.col(text_col).cast("string")) <= LONGEST).select(F.col(id_col).alias("doc_id"))
    known = staged(known.join(fits, "doc_id", "left_semi"), "labelled")
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).withColumnRenamed("doc_id", "id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") <= LONGEST)
    # a sample of bounded size; repeated rows of one document are folded before anything is gathered
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    prior = sizes[1] / (sizes[0] + sizes[1])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)).sort_by("id")  # the sample, of bounded size
        if not got.num_rows:
            return
        text = pa.concat_arrays(got["text"].chunks)
        model = fit(text, got["toxic"].to_numpy().astype(int), prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # one task learns: the driver holds neither the sample nor what fitting needs
    learned = rows.coalesce(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(learned.model) if learned else Model()


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: score, and the offending spans (code points, end exclusive) with their marginals."""
    key = docs.schema[id_col]
    kind = T._parse_datatype_string("score double, spans array<struct<start:long,end:long,p:double>>")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, spans, _ = score_batch(batch.column(1), shared.value, with_spans=True)
            flat = np.concatenate(spans) if spans else np.rec.fromarrays([np.zeros(0, np.int64)] * 3 + [np.zeros(0)], names="row,start,end,p")
            ends = np.concatenate(([0], np.cumsum(np.bincount(flat["row"], minlength=batch.num_rows)))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(flat["start"], pa.int64()), pa.array(flat["end"], pa.int64()), pa.array(flat["p"], pa.float64())], ["start", "end", "p"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), items)], ["doc_id", "score", "spans"])

    schema = T.StructType([T.StructField("doc_id", key.dataType, True), *kind.fields])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents scored below the threshold, columns as they came."""
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _, _ = score_batch(batch.column(place), shared.value)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
