import itertools

import numpy as np
import plain
import pyarrow as pa
import pytest

from tradeaxis.llm import toxicity
from tradeaxis.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    moves = np.array([-1.0, 0.5, 2.0])
    scores = rng.normal(size=(3, 6))
    lengths = np.array([6, 3, 1])
    got = toxicity.marginals(scores, lengths, moves)
    step = {(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}
    for row, n in enumerate(lengths):
        mass, total = np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(scores[row, t] for t in range(n) if y[t]) + sum(step[pair] for pair in itertools.pairwise(y)))
            total += p
            mass += p * np.array(y)
        assert np.allclose(got[row, :n], mass / total)


def _sample():
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"w{rng.integers(400)}" for _ in range(n))
    bad = [f"{fresh(30)} zlurp{rng.integers(1000)} {fresh(170)} vilest {fresh(5)}" for _ in range(80)]
    return [fresh(200) for _ in range(200)], bad


def test_spans_lie_on_the_telling_words_of_a_long_text():
    good, bad = _sample()
    model = toxicity.fit(pa.array(good + bad), np.array([0] * len(good) + [1] * len(bad)), 0.1)
    text = "é " * 9000 + "Zlurp99, then " + "w1 " * 9000 + "vilest"
    score, spans, _ = toxicity.score_batch(pa.array([text, None, "", "?!", good[0]]), model, with_spans=True)
    found = [(r.row, text[r.start : r.end]) for part in spans for r in part]
    assert found == [(0, "Zlurp99"), (0, "vilest")]
    assert score[0] >= 0.7 and (score[1:] < 0.7).all() and score[1] == score[2] == score[3]


def test_edges(spark):
    good, bad = _sample()
    rows = [(i, t, 0.5) for i, t in enumerate(good + bad)] + [(None, bad[0], 0.5), (1, good[1], 0.5), (900, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, int(i >= len(good))) for i in range(len(good + bad))] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.scores(docs, model)
    assert found.count() == len(rows)
    kept = toxicity.clean(docs, model)
    assert kept.schema == docs.schema and sorted(r.text or "" for r in kept.collect()) == sorted([*good, good[1], ""])
    assert toxicity.scores(docs.limit(0), model).count() == 0
    blind = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.scores(docs, blind).collect()} == {0.0}


def test_held_out_documents_and_nothing_learned_from_them(spark):
    pytest.importorskip("duckdb")
    frame = QUERIES["op3_toxicity"](spark, MIDDLE)
    rows = {r.doc_id: r for r in frame.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert all(r.held_out == (plain.crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    judged = [(labels[d], r.predicted) for d, r in rows.items() if r.held_out and d in labels]
    assert sum(a == b for a, b in judged) / len(judged) >= 0.95
    assert not any(b for a, b in judged if a == 0)


def test_a_word_of_few_toxic_documents_is_learned(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: " ".join(f"w{rng.integers(400)}" for _ in range(n))
    rows = [(i, fresh(20) + (" quxzarb" if i % 240 == 1 else " vilest" if i % 2 else "")) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8000)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    score, _, _ = toxicity.score_batch(pa.array(["w1 w2 quxzarb w3"]), model)
    assert score[0] >= 0.7
