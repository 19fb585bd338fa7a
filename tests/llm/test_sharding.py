import zlib

from pyspark.sql import functions as F

from tradeaxis.llm import sharding
from tradeaxis.llm.queries import QUERIES
from tradeaxis.session import scratch_path

SMALL = "/root/testdata/sf0.001"
ROWS = [(i, f"text {i % 50}", "x", {"a": i}) for i in range(1000)] + [(None, None, None, None), (None, None, None, None), (3, "", "x", None), (4, "é" * 50_000, "x", None)]


def _written(spark, docs, shards, **more):
    path = scratch_path(spark, "shards")
    sharding.write(docs, path, shards, **more)
    return sharding.read(spark, path, docs).collect()


def test_rows_once_counts_even_slots_gapless_order_mixed(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, slot string, shard map<string,long>")
    rows = _written(spark, docs, 7, bucket_bytes=4000)
    assert sorted(str(tuple(r.record)) for r in rows) == sorted(map(str, ROWS))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 7 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.record.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.record.doc_id is not None]
    rising = sum(a < b for a, b in zip(order, order[1:], strict=False)) / len(order)
    assert 0.4 < rising < 0.6
    other = {(r.record.doc_id, r.record.text): (r.shard, r.slot) for r in _written(spark, docs, 7, bucket_bytes=4000, seed=1)}
    same = sum(other[r.record.doc_id, r.record.text] == (r.shard, r.slot) for r in rows)
    assert same < 30


def test_order_depends_on_rows_and_seed_alone(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, slot string, shard map<string,long>")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted((r.shard, r.slot, str(r.record)) for r in _written(spark, docs.repartition(n), 7, bucket_bytes=4000)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_places_equal_a_plain_scatter_and_shuffle(spark, monkeypatch):
    """Buckets, the order inside them and their beginnings recomputed; the drawn places are a permutation of each."""
    docs = spark.createDataFrame([(i, f"t{i * i}") for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(sharding, "DRAWN", 3)
    plans = []
    keep = sharding.staged
    monkeypatch.setattr(sharding, "staged", lambda frame, purpose: plans.append(keep(frame, purpose)) or plans[-1])
    rows = _written(spark, docs, 6, bucket_bytes=1000)
    drawn = {r.bucket: (r.first, list(r.places)) for r in plans[0].collect()}
    size = sum(len(f"t{i * i}") + 16 for i in range(400))
    buckets = -(-size // 1000)
    hashes = docs.select("doc_id", F.xxhash64(F.lit(sharding.SEED), "doc_id", "text").alias("h")).collect()
    members = {}
    for r in hashes:
        members.setdefault((r.h >> 8) % buckets, []).append((r.h, r.doc_id))
    place, first = {}, 0
    for b in sorted(members):
        assert drawn[b][0] == first and sorted(drawn[b][1]) == list(range(len(members[b])))
        for (_, doc), to in zip(sorted(members[b]), drawn[b][1], strict=True):
            place[doc] = first + to
        first += len(members[b])
    shard = {doc: at * 6 // 400 for doc, at in place.items()}
    begin = [min(at for doc, at in place.items() if shard[doc] == s) for s in range(6)]
    assert {r.record.doc_id: (r.shard, r.slot) for r in rows} == {doc: (shard[doc], at - begin[shard[doc]]) for doc, at in place.items()}
    assert len({tuple(p) for _, p in drawn.values()}) > buckets // 2


def test_fewer_rows_than_shards_and_none(spark):
    docs = spark.createDataFrame(ROWS[:3], "doc_id long, text string, slot string, shard map<string,long>")
    assert sorted((r.slot) for r in _written(spark, docs, 40)) == [0, 0, 0]
    assert _written(spark, docs.limit(0), 40) == []


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op9_sharding"](spark, SMALL).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    counts = [sum(r.shard == k for r in rows) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
