import math
import re
from collections import Counter

import numpy as np
import pytest

from tradeaxis.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def _ranked(docs, items, top=20):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n, words = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for doc, c in counts:
            m = 75 + 25 * c.total() * n // max(1, words)
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]
    return out


def _tables():
    rng = np.random.default_rng(9)
    vocabulary = [f"t{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=(w := 1 / np.arange(1, 301)) / w.sum()))
    docs = [(int(i), text(int(rng.integers(1, 80)))) for i in rng.permutation(400)]
    docs += [(900 + k, "same words in many documents t200") for k in range(60)]  # ties
    docs += [(5, "t250 t250 T250"), (5, "t250 t250 T250"), (None, "t251 rare"), (1000, None), (1001, "- . ["), (1002, "t1 " * 20_000)]
    items = [(k, text(12)) for k in range(30)] + [(40, "same words"), (41, ""), (42, None), (43, "unknown-term"), (44, "T250 t251, rare; RARE"), (44, "t250"), (45, "t250"), (45, "t250")]
    return docs, items


@pytest.mark.parametrize(("bundle", "owners", "top"), [(128, (0.001, 0.01, 0.1), 20), (3, (0.05, 0.2, 0.6), 20), (7, (0.3,), 2)])
def test_search_equals_plain_scoring(spark, monkeypatch, bundle, owners, top):
    monkeypatch.setattr(ranked_search, "OWNERS", owners)
    docs, items = _tables()
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, slot string")
    found = ranked_search.search(frame, asked, top=top, bundle=bundle)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(_ranked(docs, list(dict.fromkeys(items)), top), key=str)


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "X")], "item_id string, text string")
    found = [tuple(r)[:3] for r in ranked_search.search(docs, items).orderBy("rank").collect()]
    assert found == [("q", 1, "a"), ("q", 2, "b")]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        out = ranked_search.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_the_bitmap_lets_all_terms_through(spark):
    rng = np.random.default_rng(0)
    keys = np.concatenate((rng.integers(-(2**63), 2**63, 500), [0, 1, ranked_search.MAP - 1, ranked_search.MAP, -1, 32768, 32767, 32769]))
    bits = ranked_search.bitmap(spark.createDataFrame([(int(k),) for k in keys], "term long"))
    cell = (keys.astype(np.int64).view(np.uint64) & np.uint64(ranked_search.MAP - 1)).astype(int)
    assert bits[cell].all() and bits.sum() == len(set(cell.tolist()))
