import math

import numpy as np
import pytest

from tradeaxis.llm import whitening

SMALL = "/root/testdata/sf0.001"


def _plain(vectors, k):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return ((n * x - s) ** 2).sum(axis=1), c @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def _check(found, ids, vectors, k):
    deviation, white, explained = _plain(vectors, k)
    place = {v: i for i, v in enumerate(ids)}
    got = np.zeros((len(ids), k))
    assert len(found) == len(ids) * k
    for r in found:
        i, c = place[r.vec_id], r.component - 1
        got[i, c] = r.whitened
        assert r.n == len(ids) and r.deviation == deviation[i] and r.identity_error <= 1e-4
        assert abs(r.explained / explained[c] - 1) < 1e-9
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-7


def test_given_vectors_equal_the_eigen_decomposition(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    _check(whitening.whiten(table).collect(), [r[0] for r in rows], [r[1] for r in rows], 32)


def test_rows_that_are_dropped_and_small_dimensions(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(5).tolist(), "x") for i in range(40)] + [(40, rng.standard_normal(5).tolist(), "x")]
    bad = [(90, None, "x"), (91, [], "x"), (92, [1.0, None, 2.0, 3.0, 4.0], "x"), (93, [math.nan] * 5, "x"), (94, [math.inf, 0.0, 0.0, 0.0, 0.0], "x"), (95, [1.0, 2.0], "x")]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, component string").repartition(3)
    _check(whitening.whiten(table).collect(), [r[0] for r in good], [r[1] for r in good], 5)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_no_variance_gives_no_rows(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_repeated_and_null_ids_and_dependent_columns(spark):
    rows = [(1, [0.0, 0.0, 0.0]), (1, [1.0, 1.0, 0.0]), (None, [2.0, 2.0, 0.0]), (None, [2.0, 2.0, 0.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id is None, r.component) for r in found) == [(False, 1)] * 2 + [(True, 1)] * 2
    assert {r.deviation for r in found if r.vec_id is None} == {2 * (4 * 128 - 5 * 64) ** 2}


@pytest.mark.parametrize("values", [[5.0, 5.0, 5.0, 2.0, 2.0, 1.0], [1e3, 1.0, 1e-3, 1e-4, 0.0, 0.0]])
def test_equal_and_small_singular_values(values):
    rng = np.random.default_rng(4)
    u, v = np.linalg.qr(rng.standard_normal((50, 6)))[0], np.linalg.qr(rng.standard_normal((6, 6)))[0]
    x = u * np.array(values) @ v.T

    def products(a, known):
        p = x @ a
        return np.concatenate(((x @ known).T @ p, [p @ p], x.T @ p))

    sigma, right = whitening.bidiagonalise(products, 6, 6)
    assert np.abs(np.append(sigma, np.zeros(6 - len(sigma))) - values).max() < 1e-9 * values[0]
    some = np.array(values) > 1e-6 * values[0]
    right = right[:, : int(some.sum())]
    assert np.abs(right.T @ right - np.eye(right.shape[1])).max() < 1e-12
    assert np.abs((x @ right).T @ (x @ right) - np.diag(np.array(values)[some] ** 2)).max() < 1e-9 * values[0] ** 2


def test_steps_end_before_the_dimension_where_nothing_changes_any_more():
    rng = np.random.default_rng(5)
    x = np.linalg.qr(rng.standard_normal((400, 300)))[0] * (2.0 ** -np.arange(300))
    steps = []

    def products(a, known):
        steps.append(1)
        p = x @ a
        return np.concatenate(((x @ known).T @ p, [p @ p], x.T @ p))

    sigma, _ = whitening.bidiagonalise(products, 300, 4)
    assert len(steps) < 60 and np.abs(sigma[:4] - 2.0 ** -np.arange(4)).max() < 1e-13
