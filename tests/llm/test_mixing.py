import itertools

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tradeaxis.llm import mixing

SMALL = "/root/testdata/sf0.001"


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 80))
@settings(max_examples=300, deadline=None)
def test_subset_comes_as_near_as_any(classes, budget):
    lengths, counts = np.array(list(classes)), np.array(list(classes.values()))
    taken = mixing.subset(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    total = int((lengths * counts).sum())
    if budget < total:
        sums = {int((np.array(c) * lengths).sum()) for c in itertools.product(*[range(b + 1) for b in counts])}
        assert abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_subset_of_many_long_documents():
    lengths, counts = np.arange(1, 20_001), np.full(20_000, 7)
    budget = int((lengths * counts).sum()) // 3 + 12_345
    assert int((mixing.subset(lengths, counts, budget) * lengths).sum()) == budget


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 9), min_size=1, max_size=4), st.integers(0, 300), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_shares_before_the_knapsack_never_pass_the_budget_by_more_than_they_would_fall_short(classes, budget, knapsack):
    lengths, counts = np.array(list(classes)), np.array(list(classes.values()))
    taken = mixing.subset(lengths, counts, budget, knapsack)
    assert (taken >= 0).all() and (taken <= counts).all()
    if budget < int((lengths * counts).sum()):
        assert abs(int((taken * lengths).sum()) - budget) <= lengths.max()


def test_a_rest_far_above_the_knapsack_and_sums_that_cannot_be_met_stay_in_bounded_memory():
    import tracemalloc

    lengths, counts = np.arange(2, 40_002, 2), np.full(20_000, 3)
    budget = int((lengths * counts).sum()) // 2 // 2 * 2 + 1
    tracemalloc.start()
    got = int((mixing.subset(lengths, counts, budget) * lengths).sum())
    assert tracemalloc.get_traced_memory()[1] < 50 << 20 and abs(got - budget) == 1
    tracemalloc.stop()


def test_columns_of_any_name_come_back_as_they_were(spark):
    rows = [(i, "w " * (i % 5), "s", 111, 7, 8, 9, 5, "dot") for i in range(40)] + [(3, "w " * 3, "s", 1, 2, 3, 4, 5, "other")]
    names = "doc_id long, text string, source string, _words int, _copy int, _times int, _id int, _n int, `a.b` string"
    docs = spark.createDataFrame(rows, names)
    kept = mixing.take(docs)
    assert kept.schema == docs.schema and {tuple(r) for r in kept.collect()} <= set(rows) and kept.count() >= 30


def _targets(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), sum(size.values()), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 3 * size[s]}
        if not over:
            return out | {s: rate * weight[s] for s in free}
        for s in over:
            out[s] = 3 * size[s]
            left -= out[s]
        free -= over
    return out


ROWS = (
    [(i, "w " * (i % 40 + 1), "big", 0) for i in range(300)]
    + [(1000 + i, "w " * 7, "same", 0) for i in range(200)]
    + [(5000, "w w w", "copies", 0)] * 11
    + [(6000, "w " * 5, "small", 0), (6001, None, None, 0), (6002, "", "none", 0), (None, "x y", None, 0), (None, "x y", None, 0)]
)


def test_targets_and_words_taken(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, size int")
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    size, taken = {}, {}
    for _, text, source, _ in ROWS:
        size[source] = size.get(source, 0) + len(plain.SPACED.findall(text or ""))
    wanted = _targets(size)
    longest = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.repeats
        longest[r.source] = max(longest.get(r.source, 0), r["size"])
        assert r.source_size == size[r.source] and r.target == pytest.approx(wanted[r.source]) and 0 <= r.repeats <= 3
    assert all(abs(taken[s] - wanted[s]) <= longest[s] for s in taken)
    assert abs(taken["big"] - wanted["big"]) <= 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    kept = mixing.take(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.repeats for r in rows)
    words = sum(len(plain.SPACED.findall(r.text or "")) for r in kept.collect())
    assert words == sum(taken.values())


def test_empty_table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, size int").limit(0)
    assert mixing.mix(docs).count() == 0 and mixing.take(docs).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mix(docs).collect()
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(plain.SPACED.findall(r.text or ""))
    wanted = _targets(size)
    assert all(r.target == pytest.approx(wanted[r.source]) for r in rows)
