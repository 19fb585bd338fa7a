import numpy as np
import plain
import pytest

from tradeaxis.llm import near_dedup
from tradeaxis.llm.components import components, joined

SMALL = "/root/testdata/sf0.001"


def _varied(base, rng, changes):
    w = base.split()
    for k in rng.choice(len(w), changes, replace=False):
        w[k] = f"new{rng.integers(1_000_000)}"
    return " ".join(w)


def _texts():
    rng = np.random.default_rng(3)
    fresh = lambda n: " ".join(f"w{rng.integers(1_000_000)}" for _ in range(n))
    out = [None, "", "?!", "two words", "Two, WORDS!", "a b c d e", "a b c d e"]
    for _ in range(6):  # groups around a base, some members near others only
        base = fresh(200)
        out += [base, base.upper() + "!"] + [_varied(base, rng, int(k)) for k in rng.integers(1, 6, 12)]
    passage = fresh(120)  # a shared passage with texts that are not near each other
    out += [passage + " " + fresh(40 + 5 * k) for k in range(12)]
    out += ["again " * 3000, "again " * 3001, fresh(30_000)]
    return out


def _classes(rows):
    groups = {}
    for doc, cls in rows:
        groups.setdefault(cls, set()).add(doc)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("block", [3, 1024])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "OUTSIDE", block)
    monkeypatch.setattr(near_dedup, "MEMBERS", block)
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(3)
    found = near_dedup.classes(docs).collect()
    wanted = plain.near_classes(texts)
    assert sorted((r.doc_id, r.class_id) for r in found) == list(enumerate(wanted))
    sizes = {c: wanted.count(c) for c in wanted}
    assert all(r.class_size == sizes[r.class_id] for r in found)


def test_distinct_keeps_one_of_each_and_rows_without_words(spark):
    rows = [(3, "a b c d e f", 1), (2, "A b c d e f!", 2), (2, "A b c d e f!", 2), (5, "", 3), (5, "", 3), (6, None, 4), (None, "p q r s t", 5), (None, "p q r s t", 5), (9, "g h", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int")
    kept = near_dedup.distinct(docs)
    assert kept.schema == docs.schema
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in kept.collect()), key=lambda r: str(r)) == sorted([rows[1], rows[3], rows[4], rows[5], rows[6], rows[8]], key=lambda r: str(r))
    assert near_dedup.distinct(docs.limit(0)).count() == 0
    del key


def test_distinct_brings_columns_of_any_name_back(spark):
    rows = [(1, "a b c d e f", 111, 1, 2, "x"), (2, "a b c d e f", 222, 3, 4, "y"), (3, "", 5, 6, 7, "z"), (3, "", 5, 6, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash long, _id int, _exact int, `a.b` string")
    kept = near_dedup.distinct(docs)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]


def test_weights_belong_to_the_shingle():
    import pyarrow as pa

    from tradeaxis.llm import textops

    found = {}
    for text in ("one two three four five six", "zero one two three four five six seven", "a b", "x one two three four five"):
        for _, _, _, _, (starts, ends, counts, hashes) in textops.word_slices(pa.array([text]), textops.LETTERS):
            _, values, place = near_dedup.shingle_sets(hashes, counts)
            for v, w in zip(values.tolist(), near_dedup.weights(place, ends - starts, counts).tolist(), strict=True):
                assert found.setdefault(v, w) == w and 1 < w <= 1.25
    assert sorted(found.values())[0] == 1 + 2 / 256 and 1 + 19 / 256 in found.values()


def test_registers_estimate_the_probability_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 900, dtype=np.int64).view(np.uint64)
    a, b = np.arange(0, 600), np.arange(150, 750)
    weights = 1 + np.log(rng.integers(1, 20, 900))
    registers = near_dedup.Registers(2, m=4000)
    registers.add(np.zeros(600, int), keys[a], weights[a])
    registers.add(np.ones(600, int), keys[b], weights[b])
    one, two = registers.finish()
    x, y = np.zeros(900), np.zeros(900)
    x[a], y[b] = weights[a] / weights[a].sum(), weights[b] / weights[b].sum()
    wanted = sum(1 / np.maximum(x[x + y > 0] / x[i], y[x + y > 0] / y[i]).sum() for i in np.flatnonzero((x > 0) & (y > 0)))
    assert abs((one == two).mean() - wanted) < 0.04


def test_near_copies_with_a_phrase_repeated_many_times(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"w{rng.integers(1_000_000_000)}" for _ in range(n))
    texts = []
    for _ in range(40):  # weighted by counts these pairs are at 0.49, on sets above 0.8
        base = fresh(104)
        texts += [base, base + " " + " ".join([fresh(20)] * 50)]
    wanted = plain.near_classes(texts)
    assert wanted == [i - i % 2 for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == dict(enumerate(wanted))


def test_components_of_a_long_path_and_links_added_later(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    roots = components(links)
    assert {(r.v, r.root) for r in roots.collect()} == {(i, 1) for i in range(1, 61)} | {(100, 100), (101, 100)}
    more = joined(roots, spark.createDataFrame([(101, 7), (300, 200)], "a long, b long"))
    assert {(r.v, r.root) for r in more.collect()} == {(i, 1) for i in [*range(1, 61), 100, 101]} | {(200, 200), (300, 200)}


def test_given_documents_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    wanted = plain.near_classes([t for _, t in rows])
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert found == {rows[i][0]: rows[c][0] for i, c in enumerate(wanted)}
