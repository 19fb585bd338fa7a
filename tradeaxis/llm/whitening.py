"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The vectors are kept as whole numbers in blocks of rows, in the shared folder. With X the rows less their mean,
each step takes the product Xv, a number per row, less what the step before had of it, and then the product of X'
with the outcome, a number per dimension; a task takes both on its blocks, one after the other. Every new u is
made orthogonal to all u before it, by products of the same pass, and every new v to all v before it (full
reorthogonalisation). A vector u has a number per row and is never stored: it is X times a vector of
coefficients, which the driver keeps, so a task makes its rows of all u again from its block. What leaves a task
is a sum per dimension and per step; Spark adds these up. The driver holds vectors as long as the dimension,
never rows.

The singular values of the small bidiagonal matrix are the deviations times the root of n, its right singular
vectors turn the v into the components. The steps end when the components asked for no longer change, at the
latest with the dimension. Where a step finds nothing new (equal eigenvalues, dependent columns) the next v is a
seeded random one, orthogonal to the others.

The mean is taken exactly: n * x - S is a whole number and is divided once.

Defined results: a vector that is null, has no entries, or holds a null or an entry that is not finite is
dropped. Of vectors of several lengths those of the most common length (of two equally common, the greater) make
the fit list; the others are dropped. Components with no variance are not returned, so equal vectors, a single
one, or none give no rows. Ids may repeat or be null; every row is transformed. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.session import staged

COMPONENTS = 32
#: An entry c becomes the whole number floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Rows of a block.
BLOCK = 4096
SEED = 11
_EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """Mean, components and their variances; ``base`` and ``rest`` give the mean as base + rest / n, exactly."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0


def blocks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(ids, d, rows, x, sums)``: blocks of whole-number rows of one length, with their sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            whole = np.diff(column.offsets.to_numpy().astype(np.int64))
            whole[np.asarray(column.is_null())] = 0
            flat = column.flatten()
            value = flat.to_numpy(zero_copy_only=False).astype(float)
            value[np.asarray(flat.is_null())] = np.nan
            ends = np.cumsum(whole)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(value))))
            good = (whole > 0) & (bad[ends] == bad[ends - whole])
            for d in np.unique(whole[good]):
                rows = np.flatnonzero(good & (whole == d))
                for i in range(0, len(rows), BLOCK):
                    part = rows[i : i + BLOCK]
                    x = np.floor(scale * value[(ends - whole)[part][:, None] + np.arange(d)]).astype(np.int64) + offset
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column(0).take(pa.array(part))),
                            pa.array([int(d)], pa.int32()),
                            pa.array([len(part)], pa.int64()),
                            pa.array([x.astype("<i8").tobytes()], pa.binary()),
                            pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64())),
                        ],
                        ["ids", "d", "rows", "x", "sums"],
                    )

    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T._parse_datatype_string("d int, rows long, x binary, sums array<long>").fields])
    return vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>")).mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch], place: int, d: int, base: np.ndarray) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The blocks of a task, as whole numbers less ``base``."""
    for batch in batches:
        for i, x in enumerate(batch.column(place)):
            yield batch, i, np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d) - base


def _added(table: DataFrame, n: int, base: np.ndarray, rest: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``of(centred rows)``, added per task and then by Spark."""
    d = len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, x in _rows(batches, 0, d, base):
            part = of((n * x - rest) / n)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "value"])

    per = table.select("x").mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value"))
    found = per.toArrow()
    out = np.zeros(len(found))
    out[found["k"].to_numpy()] = found["value"].to_numpy()
    return out


def _orthogonal(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    for _ in range(2):
        w = w - v @ (v.T @ w)
    return w


def bidiagonalise(products: Callable[[np.ndarray, np.ndarray], np.ndarray], d: int, wanted: int, tolerance: float = 8 * _EPS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of X and the right singular vectors, by falling value.

    ``products(a, A)`` takes p = Xa and gives (XA)'p, |p|^2 and X'p.
    """
    random = np.random.default_rng(seed)

    def fresh(v: np.ndarray) -> np.ndarray:
        w = _orthogonal(random.standard_normal(d), v)
        w = _orthogonal(w / np.linalg.norm(w), v)
        return w / np.linalg.norm(w)

    left = np.zeros((d, 0))  # u_j = X left_j
    back = np.zeros((d, 0))  # X'u_j
    right = fresh(np.zeros((d, 0)))[:, None]
    small: list[tuple[int, int, float]] = []  # entries of the bidiagonal matrix
    size = beta = 0.0
    while True:
        j, k = right.shape[1] - 1, left.shape[1]
        a = right[:, j] - beta * left[:, -1] if beta else right[:, j]
        told = products(a, left)
        again, square, z = told[:k], float(told[k]), told[k + 1 :]
        alpha = float(np.sqrt(max(0.0, square - again @ again)))
        size = max(size, alpha)
        beta = 0.0
        if alpha > 64 * _EPS * size:
            u = (a - left @ again) / alpha
            z = (z - back @ again) / alpha
            left, back = np.column_stack((left, u)), np.column_stack((back, z))
            small.append((k, j, alpha))
            w = _orthogonal(z, right)
            beta = float(np.linalg.norm(w))
            size = max(size, beta)
        matrix = np.zeros((max(1, left.shape[1]), right.shape[1]))
        for r, c, value in small:
            matrix[r, c] = value
        if right.shape[1] == d:
            break
        if beta > 64 * _EPS * size:
            p, sigma, _ = np.linalg.svd(matrix)
            # what the next step can still change of the components asked for
            if len(sigma) > wanted and (beta * np.abs(p[-1, : wanted + 1]) <= tolerance * sigma[0]).all():
                break
            small.append((left.shape[1] - 1, right.shape[1], beta))
            right = np.column_stack((right, w / beta))
        else:
            beta = 0.0
            right = np.column_stack((right, fresh(right)))
    _, sigma, q = np.linalg.svd(matrix)
    return sigma, right @ q.T[:, : len(sigma)]


def fit(table: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of staged ``blocks``; None if there are no vectors."""
    lengths = table.groupBy("d").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = int(lengths["d"]), int(lengths["n"])
    table = table.filter(F.col("d") == d)
    sums = table.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    exact = [int(r["s"]) for r in sorted(sums, key=lambda r: r["k"])]
    # x - S/n = (x - base) - rest/n with |rest| <= n/2: small whole numbers, however far the mean is from zero
    base = np.array([(2 * s + n) // (2 * n) for s in exact], dtype=np.int64)
    rest = np.array([s - n * int(b) for s, b in zip(exact, base, strict=True)], dtype=np.int64)

    def products(a: np.ndarray, known: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            p = x @ a
            return np.concatenate(((x @ known).T @ p, [p @ p], x.T @ p))

        return _added(table, n, base, rest, of)

    trace = float(_added(table, n, base, rest, lambda x: np.array([np.sum(x * x)]))[0]) / n
    if not trace:
        return Whitening(n, base, rest, np.zeros((d, 0)), np.zeros(0), 0.0)
    sigma, vectors = bidiagonalise(products, d, min(components, d))
    some = int((sigma > 64 * d * _EPS * sigma[0]).sum())
    keep = min(components, some)
    model = Whitening(n, base, rest, vectors[:, :keep], sigma[:keep] ** 2 / n, trace)
    weight = model.components / np.sqrt(model.variances)

    def spread(x: np.ndarray) -> np.ndarray:
        y = x @ weight
        return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

    told = _added(table, n, base, rest, spread)
    mean = told[:keep] / n
    covariance = told[keep:].reshape(keep, keep) / n - np.outer(mean, mean)
    model.identity_error = float(np.abs(covariance - np.eye(keep)).max())
    return model


def _deviations(y: np.ndarray) -> pa.Array:
    """The exact sums of the squares of the rows; null beyond 64 bits."""
    if float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0**62:
        return pa.array((y * y).sum(axis=1))
    whole = [sum(v * v for v in row) for row in y.tolist()]
    return pa.array([s if s < 1 << 63 else None for s in whole], pa.int64())


def transform(table: DataFrame, model: Whitening) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained)`` for every row of ``blocks`` and component."""
    base, rest, n, d, k = model.base, model.rest, model.n, len(model.base), len(model.variances)
    weight, explained = model.components / np.sqrt(model.variances), model.variances / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, x in _rows(batches, 1, d, base):
            y = n * x - rest
            m = len(y)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i].values.take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)),
                    _deviations(y).take(at),
                    pa.array(((y / n) @ weight).ravel()),
                    pa.array(np.tile(explained, m)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    kind = table.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", kind), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double").fields])
    return table.filter(F.col("d") == d).select("ids", "x").mapInArrow(run, schema)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: the whitened coordinate, what the component explains, and how exact the whitening is."""
    table = staged(blocks(vectors, id_col, vector_col), "vectors")
    model = fit(table, components)
    if model is None:
        model = Whitening(0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    return transform(table, model).withColumn("identity_error", F.lit(model.identity_error))
