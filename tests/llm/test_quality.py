import numpy as np
import plain
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tradeaxis.llm import quality
from tradeaxis.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@given(st.lists(st.none() | st.text(st.sampled_from("ab é#|\n\t \x00"), max_size=60), max_size=5))
@settings(max_examples=200, deadline=None)
def test_counts_equal_plain_counts(texts):
    assert quality.measure(pa.array(texts, pa.string()))[0].tolist() == [plain.quality_counts(t) for t in texts]


def test_forest_finds_the_odd_ones_and_equal_points_are_equal():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(size=(2000, 5)), rng.normal(6, 1, size=(20, 5))))
    score = quality.grow(x).score(x)
    assert score[2000:].min() > np.quantile(score[:2000], 0.98)
    assert quality.grow(x[:1]) is None
    flat = quality.grow(np.ones((50, 3)))
    assert len(set(flat.score(np.ones((4, 3))).tolist())) == 1


def test_threshold_parts_the_labels(spark):
    rows = [(i, 0.3 + i / 1000, False) for i in range(100)] + [(i, 0.6 + i / 1000, False) for i in range(100, 130)] + [(500, 0.1, True)]
    scored = spark.createDataFrame(rows, "doc_id long, anomaly double, base_failed boolean")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(130)] + [(500, 0, 0), (None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert 0.399 <= quality.threshold(scored, labels) <= 0.7
    assert quality.threshold(scored, labels.filter("quality = 1")) == float("inf")


def test_query_over_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op4_quality_rules"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = plain.quality_counts(texts[r.doc_id])
        assert [r[c] for c in quality.COUNTS] == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").collect()}
    passed = [r.kept for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(passed) >= 0.9 * len(passed)


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "x " * 50_000, 1)], "doc_id long, text string, anomaly int")
    rows = quality.measured(docs, quality.train(docs)).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 50_000] and all(r.base_failed for r in rows)
    assert quality.train(docs.limit(0)) is None and quality.measured(docs.limit(0)).count() == 0
