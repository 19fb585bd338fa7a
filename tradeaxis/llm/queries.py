"""The registered queries of the operators in this package, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeaxis.llm import decontaminate, mixing, near_dedup, quality, ranked_search, secrets, sharding, signature_join, token_counts, token_store, toxicity, url_filter, whitening
from tradeaxis.session import scratch_path, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_sql(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


def hits_sql(documents: str = "documents") -> str:
    """Contamination of ``documents`` by windows of ten words, as DuckDB SQL."""
    return f"""
with d as (select doc_id, {words_sql("text")} as w from {documents}),
b as (select item_id, w, least({decontaminate.WINDOW}, len(w)) as n from (select item_id, {words_sql("text")} as w from benchmark) where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as s from (select *, unnest(range(1, len(w) - n + 2)) as k from b)),
dw as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as s
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d join (select distinct n from bw) on len(w) >= n)),
m as (select dw.doc_id, dw.k, dw.n, bw.item_id from dw join bw using (n, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from (select distinct doc_id, k, n from m)) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
       from (select distinct doc_id, item_id from m) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)"""


@query("op1_url_filter")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"))


@query("op2_benchmark_decontamination", hits_sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    names = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    scored = toxicity.scores(documents, toxicity.train(documents, table(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


@query("op4_quality_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    scored = staged(quality.measured(documents, quality.train(documents)).drop("statistics"), "scored")
    limit = quality.threshold(scored, table(spark, folder, "labels"))
    kept = ~F.col("base_failed") & (F.col("anomaly") < F.lit(limit))
    return scored.select("doc_id", *quality.COUNTS, "base_failed", kept.alias("kept"), "anomaly")


@query("op5_mixing_sources")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


@query("op6_secret_scans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.spans(table(spark, folder, "documents"))
    counts = [secrets.counted("base", k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "most")


@query("op8_token_id_output")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return stored_ids(table(spark, folder, "documents"))


def stored_ids(documents: DataFrame) -> DataFrame:
    """Writes the ids of all documents and reads them back through the index, key by key."""
    import public_tokenizers

    folder = scratch_path(documents.sparkSession, "ids")
    token_store.write(documents, folder, public_tokenizers.path(TOKENIZER), END_ID)
    found = token_store.lookup(documents, folder)
    return token_store.read(found, folder, with_ids=False)


SHARDS = 40


@query("op9_sharding")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    path = scratch_path(spark, "shards")
    sharding.write(documents, path, SHARDS)
    return sharding.read(spark, path, documents).select(
        "record.doc_id",
        sharding.size_of("record.text").alias("size"),
        F.crc32(F.coalesce("record.text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_minhash_near_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.classes(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "class_size")


@query("op11_embedding_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


SPACED = r"[^\x20\x09-\x0D]+"

JOINED = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED}') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) between 1 and 3 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (s) where x.doc_id <> y.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r(v, u) as (select distinct a, a from l union select r.v, l.b from r join l on r.u = l.a),
m as (select v, min(u) as least from r group by 1)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(least, w.doc_id) as component_id
from w left join n using (doc_id) left join m on m.v = w.doc_id"""


@query("op12_ngram_jaccard_join", JOINED)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return signature_join.join(table(spark, folder, "documents"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{TERM}') as w from documents),
s as (select cast(count(*) as bigint) as n, cast(sum(len(w)) as bigint) as l from d where len(w) > 0),
m as (select doc_id, 100 - 25 + (25 * cast(len(w) as bigint) * n) // l as m from d, s),
q as (select item_id, term, count(*) as q
      from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) as term from benchmark) group by all),
t as (select doc_id, translate(term, '{UPPER}', '{LOWER}') as term from (select doc_id, unnest(w) as term from d)),
p as (select doc_id, term, count(*) as tf from t where term in (select term from q) group by all),
f as (select term, cast(floor(1000 * ln(cast(2 * (select n from s) + 2 as double) / (2 * count(*) + 1))) as bigint) as w from p group by 1),
c as (select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as score
      from q join p using (term) join f using (term) join m using (doc_id) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from c where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from r where rank <= 20"""


@query("op13_ranked_lexical_search", RANKED)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
