import corpus_pipeline
import plain

from tradeaxis.llm import mixing, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_plain_search(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {"start": {r.doc_id: r.text for r in docs.collect()}}
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "token_ids":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "token_ids":
            break
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["toxicity"]) == {d for d in kept["start"] if scores[d] < toxicity.THRESHOLD}
    order = sorted(kept["toxicity"].items())
    classes = plain.near_classes([t for _, t in order])
    assert kept["near_dedup"] == dict(order[i] for i in sorted(set(classes)))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    order = sorted(kept["near_dedup"].items())
    clean = plain.hits([t for _, t in order], items)
    assert kept["decontamination"] == dict(d for d, h in zip(order, clean, strict=True) if not h[1])
    before = spark.read.parquet(f"{tmp_path}/decontamination")
    times = {r.doc_id: r.repeats for r in mixing.mix(before).collect()}
    mixed = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/mixing").collect()]
    assert sorted(mixed) == sorted(d for d, n in times.items() for _ in range(n))
    stored = docs.collect()
    assert sorted(r.doc_id for r in stored) == sorted(mixed)
    at = 0
    for r in sorted(stored, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 0
