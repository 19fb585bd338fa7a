import numpy as np
import plain
import pytest

from tradeaxis.llm import signature_join


def shingles(text):
    w = plain.SPACED.findall((text or "").translate(plain._LOWER))
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def _components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def _texts():
    rng = np.random.default_rng(12)
    fresh = lambda n: " ".join(f"w{rng.integers(1_000_000)}" for _ in range(n))

    def varied(base, changes):
        w = base.split()
        for k in rng.choice(len(w), changes, replace=False):
            w[k] = f"new{rng.integers(1_000_000)}"
        return " ".join(w)

    out = [None, "", " \t\n", "one", "ONE", "two words", "three words here", "a b c d", "A b c d", "a b c d e", "x " * 50, "x " * 60]
    for size in (12, 40, 200, 900):
        for _ in range(3):
            base = fresh(size)
            out += [base, base.upper(), base + " end"] + [varied(base, int(k)) for k in rng.integers(1, 2 + size // 25, 14)]
    passage = fresh(120)
    out += [passage + " " + fresh(8 + 4 * k) for k in range(25)]
    # a chain: each near the next, the ends far apart
    w = fresh(200).split()
    for _ in range(15):
        out.append(" ".join(w))
        w = w[3:] + fresh(3).split()
    out += [fresh(30_000)]
    return out + [out[-1] + " more"]


@pytest.mark.parametrize(("block", "dense", "hot"), [(2048, 4, 1 << 16), (5, 0.2, 3), (2048, 0, 0), (7, 4, 1 << 16)])
def test_components_equal_all_pairs(spark, monkeypatch, block, dense, hot):
    monkeypatch.setattr(signature_join, "block_of", lambda c: block)
    monkeypatch.setattr(signature_join, "DENSE", dense)
    monkeypatch.setattr(signature_join, "OFTEN", 2)
    monkeypatch.setattr(signature_join, "HOT", hot)
    texts = _texts()
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, v int").repartition(3)
    found = signature_join.join(docs).collect()
    assert sorted(map(tuple, found)) == _components(texts)


def test_bounds_of_nodes_admit_every_link():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 400, dtype=np.int64).view(np.uint64)
    sets = []
    for _ in range(90):
        base = rng.choice(pool, rng.integers(20, 60), replace=False)
        sets += [np.unique(base), np.unique(np.append(base[: len(base) - 2], rng.choice(pool, 2)))]
    size = np.array([len(s) for s in sets])
    rows, values = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(size, kind="stable")
    c = int(signature_join.class_of(size).min())
    words = signature_join.width(c) // 64
    bits = np.stack([np.bitwise_or.reduce(np.frombuffer(b, "<u8").reshape(-1, words), axis=0) for b in signature_join.signatures(rows, values, size)])
    spare = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    none = np.zeros(0)
    leaves = signature_join.Level(none, none, size[order], size[order], spare[order], np.ones(len(sets), bool), bits, order)
    levels, _ = signature_join.grow(np.array([0]), np.array([len(sets)]), leaves)
    assert len(levels) > 2
    a, b = signature_join.traverse(np.array([0]), np.array([len(sets)]), leaves)
    got = {frozenset(p) for p in zip(order[a].tolist(), order[b].tolist(), strict=True)}
    every = {frozenset((x, y)) for x in range(len(sets)) for y in range(x) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 85 * len(np.union1d(sets[x], sets[y]))}
    assert every <= got and len(got) < len(sets) * (len(sets) - 1) / 4


def test_ids_that_repeat_or_are_null_and_no_rows(spark):
    rows = [(7, "a b c d e"), (7, "other words of its own"), (None, "a b c d e"), (None, "p q r s"), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, signature_join.join(docs).collect()), key=str)
    assert found == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (None, 1, None), (None, 0, None), (3, 0, 3)], key=str)
    assert signature_join.join(docs.limit(0)).count() == 0


def test_size_classes_of_sets_that_can_link_are_neighbours():
    n = np.arange(1, 40_000)
    assert (signature_join.class_of(n * 100 // 85) - signature_join.class_of(n) <= 1).all()
    assert all(signature_join.width(c + 1) in (signature_join.width(c), 2 * signature_join.width(c)) for c in range(-1, 90))
