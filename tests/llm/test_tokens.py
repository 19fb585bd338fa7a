import zlib

import numpy as np
import pyarrow as pa
import pytest

from tradeaxis.llm import token_counts, token_store
from tradeaxis.llm.queries import END_ID, QUERIES, TOKENIZER
from tradeaxis.llm.wordpieces import ByteEncoder, Encoder
from tradeaxis.session import scratch_path

tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
ODD = ["", " a", "don't… STOP!!\"ʹ áb 12ab34, x≠ İstanbul", "b  c\n\n d ", "naïve  x\u3000 y  z", "hello <|endoftext|> World", "e ", " f", "'s 're'd x's\t\r\n", "e\u0301 . \u0301", "\x1f|a|'b'"]


def _texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + ODD


def _whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizers.path(TOKENIZER))


def test_pieces_give_the_ids_of_whole_texts(spark, monkeypatch):
    texts = _texts(spark)
    wanted = [e.ids for e in _whole().encode_batch(texts, add_special_tokens=False)]
    for memory in (600_000, 2000):  # with a table that is emptied all the time, too
        monkeypatch.setattr("tradeaxis.llm.wordpieces.MEMORY", memory)
        encoder, got = Encoder(tokenizers.path(TOKENIZER)), []
        for _, ids, counts in encoder.encode(pa.array(texts)):
            ends = np.cumsum(counts)
            got += [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)]
        assert got == wanted


def _byte_encoder():
    return ByteEncoder.of(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_a_walk_over_tokens(spark, rule):
    texts = [*_texts(spark)[-60:], None, "\n", "one\n\ntwo\n", "no feed", "x\n" * 500]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, section string")
    got = {}
    for r in token_counts.counts(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
    encoding = _byte_encoder().encoding
    for i, text in enumerate(texts):
        text = text or ""
        lines = text.splitlines(keepends=True) if set(text) <= set("\n") else [x + "\n" for x in text.split("\n")[:-1]] + [x for x in text.split("\n")[-1:] if x]
        lines = lines or [""]
        edges = np.cumsum([0] + [len(x.encode()) for x in lines])
        n, at = np.zeros(len(lines)), 0
        for token in encoding.encode_ordinary(text):
            size = len(encoding.decode_single_token_bytes(token))
            share = np.array([max(0, min(b, at + size) - max(a, at)) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            own = np.flatnonzero(share)
            if rule == "share":
                n += share / size
            else:
                n[{"start": own[0], "end": own[-1], "most": int(np.argmax(share))}[rule]] += 1
            at += size
        points = np.cumsum([0] + [len(x) for x in lines])
        mine = sorted(got[i])
        assert [m[:3] for m in mine] == [(k, points[k], points[k + 1]) for k in range(len(lines))]
        assert np.allclose([m[3] for m in mine], n)


def test_fields_are_sections(spark):
    docs = spark.createDataFrame([(1, "ab c", None, "d ef"), (2, None, None, None)], "doc_id long, a string, b string, c string")
    rows = sorted(tuple(r)[:5] for r in token_counts.counts(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, "share", ("a", "b", "c")).collect())
    assert [r[:4] for r in rows] == [(1, 0, 0, 4), (1, 1, 4, 4), (1, 2, 4, 8), (2, 0, 0, 0), (2, 1, 0, 0), (2, 2, 0, 0)]
    assert sum(r[4] for r in rows) == len(_byte_encoder().encoding.encode_ordinary("ab cd ef"))


def test_token_counts_query_adds_up(spark):
    encoding = _byte_encoder().encoding
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    total = {}
    for r in QUERIES["op7_token_counts"](spark, SMALL).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {d: len(encoding.encode_ordinary(t)) for d, t in texts.items()}


def test_perfect_hash_is_minimal_and_survives_a_round_trip():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 5000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
        made = token_store.PerfectHash.build(keys)
        again, used = token_store.PerfectHash.load(made.dump())
        assert used == len(made.dump())
        for h in (made, again):
            assert sorted(h.slot(keys).tolist()) == list(range(len(keys)))


ROWS = [(i, f"text {i} of some words", "x") for i in range(2500)] + [(None, None, "x"), (None, "x y", "x"), (5, "hello <|endoftext|>", "x"), (5, "", "x")] + [(9, f"copy {i}", "x") for i in range(300)]


def test_store_round_trip_with_repeated_keys_over_several_shards(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, shard string").repartition(3)
    folder = scratch_path(spark, "ids")
    token_store.write(docs, folder, tokenizers.path(TOKENIZER), END_ID, shard_bytes=200, bucket_keys=500)
    assert token_store.shard_table(spark, folder).count() > 3
    rows = token_store.read(token_store.lookup(docs, folder), folder).collect()
    whole = _whole()
    wanted = sorted((str(d), [*whole.encode(t or "", add_special_tokens=False).ids, END_ID]) for d, t, _ in ROWS)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == wanted
    at = 0
    last = None
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert last is None or r.doc_id >= last
        at, last = at + r.n_tokens, r.doc_id
    foreign = spark.createDataFrame([(10**9 + i,) for i in range(2000)] + [(7,)], "doc_id long")
    assert [r.doc_id for r in token_store.lookup(foreign, folder).collect()] == [7]


def test_store_of_nothing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, shard string")
    folder = scratch_path(spark, "ids")
    token_store.write(docs.limit(0), folder, tokenizers.path(TOKENIZER), END_ID)
    assert token_store.read(token_store.lookup(docs, folder), folder).count() == 0
