import hashlib

import plain
import pytest

from tradeaxis.llm import decontaminate
from tradeaxis.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
ITEM = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "... !!", "a"),
    (4, "zero " + ITEM.upper() + " end", "a"),
    (4, "zero " + ITEM + " end", "a"),
    (5, "two three four five six seven eight nine ten", "a"),
    (6, ITEM + " x " + ITEM, "a"),
    (None, "tiny item", "a"),
    (7, "x " * 40_000 + ITEM + " y" * 40_000, "a"),
]
ITEMS = [(10, ITEM), (10, ITEM), (9, ITEM), (11, "tiny item"), (12, None), (13, ""), (None, "six seven")]


def _frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, n_hit string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_edges_equal_plain_search(spark):
    docs, items = _frames(spark)
    wanted = plain.hits([t for _, t, _ in DOCS], ITEMS)
    got = [(r.doc_id, r.n_words, r.n_hit, set(r["items"])) for r in decontaminate.hits(docs, items).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3])
    assert sorted(got, key=key) == sorted([(d[0], *w) for d, w in zip(DOCS, wanted, strict=True)], key=key)


def test_longest_match_and_its_place(spark):
    docs, items = _frames(spark)
    row = decontaminate.hits(docs.filter("doc_id = 7"), items.filter("item_id = 10")).first()
    assert row.longest == 12 and [tuple(m) for m in row.matches] == [(10, 0, 40_000, 12)]


def test_clean_keeps_columns_and_only_clean_documents(spark):
    docs, items = _frames(spark)
    kept = decontaminate.clean(docs, items)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def _beyond(monkeypatch):
    """A bound that the small benchmark exceeds, and shards of a few documents."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)


def test_benchmark_beyond_the_bound_gives_the_same(spark, monkeypatch):
    docs, items = _frames(spark)
    told = lambda: sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.longest, sorted(r["items"]), sorted(map(str, r.matches))) for r in decontaminate.hits(docs, items).collect())
    one, kept = told(), sorted(map(str, decontaminate.clean(docs, items).collect()))
    _beyond(monkeypatch)
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: pytest.fail("broadcast beyond the bound"))
    again = told()
    cleaned = sorted(map(str, decontaminate.clean(docs, items).collect()))
    none = decontaminate.hits(docs.limit(0), items).count()
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    assert again == one and cleaned == kept and none == 0


@pytest.mark.parametrize("beyond", [False, True])
def test_ids_of_text_and_columns_of_any_name(spark, monkeypatch, beyond):
    if beyond:
        _beyond(monkeypatch)
    kind = "doc_id long, body string, `a.b` string, shard int, part int, record map<string,int>, item string"
    rows = [(1, "zero " + ITEM, "x", 1, 2, {"k": 1}, None), (2, "clean words", "y", None, None, None, "i"), (3, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    items = spark.createDataFrame([("mmlu/7", ITEM), ("a", "six seven"), (None, "one two"), ("mmlu/7", "eleven twelve")], "name string, words string")
    more = {"text_col": "body", "bench_id": "name", "bench_text": "words"}
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.hits(docs, items, **more).collect()}
    assert {k: (n, sorted(i)) for k, (n, i) in got.items()} == {1: (12, ["a", "mmlu/7"]), 2: (0, []), 3: (0, [])}
    kept = decontaminate.clean(docs, items, **more)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == rows[1:]


def test_empty_tables(spark):
    docs, items = _frames(spark)
    assert decontaminate.hits(docs.limit(0), items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(DOCS)


def test_query_equals_its_sql_and_plain_search(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    frame = QUERIES["op2_benchmark_decontamination"](spark, SMALL)
    ours = sorted(tuple(r[c] for c in frame.columns) for r in frame.collect())
    found = con.execute(SQL["op2_benchmark_decontamination"])
    names = [c[0] for c in found.description]
    theirs = sorted(tuple(r[names.index(c)] for c in frame.columns) for r in found.fetchall())
    assert ours == theirs
    docs = con.execute("select doc_id, text from documents").fetchall()
    items = con.execute("select item_id, text from benchmark").fetchall()
    for (doc, _), (n, hit, ids) in zip(docs, plain.hits([t for _, t in docs], items), strict=True):
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert (doc, n, hit, len(ids), digest, hit > 0) in ours
