"""Mixing sources to target weights: exact token budgets, filled by counting lengths and by subset sums.

The mix takes whole documents. A source's target is met by as many whole passes over it as fit, and a rest.
For the rest only the number of documents of each length matters, so the choice is made on the histogram of
lengths: all but ``KNAPSACK`` words of it are shared out over the lengths, from the longest to the shortest, so
that the words taken keep pace with the words passed; then a bounded knapsack over the documents left, by
dynamic programming on the reachable sums, fills the budget that remains. Which documents of a length are taken
is decided by a seeded hash of their ids.

Nothing is collected: sources are folded to one row each, histograms have a row per length, and within a
length documents are counted by hash range first, so that only the range in which the choice ends is put in
order. A source or a length with a third of all rows therefore takes no task of its own.

Defined results: a null source is a source, the last; a null or empty text has size 0 and is never taken.
Equal rows (id, source, size) are one row with a count until the end; each comes back as a row of its own.
A source without words has target 0. An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeaxis.session import staged

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives no more than this many times its size, and a document no more copies.
MOST = 3
SEED = 20
#: Hash ranges of a length's documents.
RANGES = 1024
#: Words that are left to the knapsack, besides what the shares of whole documents leave (less than the longest).
KNAPSACK = 1 << 16


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, copies)``: words separated by ASCII white space, equal rows folded."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)``: shares of all words by weight, none above ``most`` times its size.

    One row per source. Sources are capped in the order of ``size / weight``; as all words are to be dealt
    out, the rate per weight after the first k capped sources is what is left over the weights left, and a
    source is capped if that rate would give it more than its most. That is where resharing ends.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1
    weighed = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    by_cap = Window.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rated = weighed.withColumn("rate", left / weight_left).withColumn("capped", F.col("rate") * F.col("weight") >= F.lit(most) * F.col("source_size"))
    # capped sources are a beginning of that order; the others share at the first rate that caps nobody
    rate = F.min(F.when(~F.col("capped"), F.struct(F.lit(most) * F.col("source_size") / F.col("weight"), "rate"))).over(whole)["rate"]
    target = F.when(F.col("capped"), F.lit(float(most)) * F.col("source_size")).otherwise(rate * F.col("weight"))
    return rated.select("source", "source_size", target.cast("double").alias("target"))


def subset(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take so that the lengths add up as near to the budget as can be.

    The sum never exceeds the budget by more than it would fall short of it otherwise.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    # shares: after each length as many words are taken as the lengths so far are of all, less what no whole document fits
    down = np.argsort(-lengths, kind="stable")
    taken, left, passed, got, share = np.zeros(len(lengths), np.int64), counts.copy(), 0, 0, max(0, budget - knapsack)
    for i in down:
        length = int(lengths[i])
        if length > 0:
            passed += length * int(counts[i])
            more = min(int(counts[i]), (share * passed // total - got) // length)
            taken[i], got = more, got + more * length
    left -= taken
    rest = budget - got
    # reachable sums; each step adds a power-of-two bundle of one length (bounded knapsack). A sum remembers the step that
    # reached it first, which builds on sums of earlier steps. Sums of twice the rest or more are farther off than none.
    limit = min(rest + int(lengths.max(initial=0)), 2 * rest)
    by = np.full(limit + 1, -1, dtype=np.int32)
    reach = np.zeros(limit + 1, dtype=bool)
    reach[0] = True
    steps: list[tuple[int, int]] = []
    for i in down:
        length, many, bundle = int(lengths[i]), int(left[i]), 1
        if not 0 < length <= limit:
            continue
        many = min(many, limit // length)
        while many:
            size = min(bundle, many)
            new = np.flatnonzero(reach[: limit + 1 - size * length]) + size * length
            new = new[~reach[new]]
            reach[new], by[new] = True, len(steps)
            steps.append((i, size))
            many, bundle = many - size, bundle * 2
        if reach[rest] and len(steps) > 8:
            break
    under = int(np.flatnonzero(reach[: rest + 1])[-1])
    above = np.flatnonzero(reach[rest + 1 :])
    over = rest + 1 + int(above[0]) if len(above) else None
    goal = over if over is not None and over - rest < rest - under else under
    while goal:
        i, size = steps[by[goal]]
        taken[i] += size
        goal -= size * int(lengths[i])
    return taken


def _choose(histogram: pd.DataFrame) -> pd.DataFrame:
    """Copies of a whole pass and documents of the rest, for every length of one source."""
    target, size = float(histogram["target"].iloc[0]), int(histogram["source_size"].iloc[0])
    budget = round(target)
    passes = min(MOST, budget // size) if size else 0
    lengths = histogram["size"].to_numpy(np.int64)
    counts = histogram["n"].to_numpy(np.int64)
    rest = subset(lengths, counts, budget - passes * size) if passes < MOST else np.zeros(len(counts), np.int64)
    return pd.DataFrame({"source": histogram["source"], "size": lengths, "passes": np.where(lengths > 0, passes, 0).astype(np.int64), "rest": np.where(lengths > 0, rest, 0)})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, repeats)`` per row: how often the mix takes it."""
    kind = docs.schema[source_col].dataType.simpleString()
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    sized = staged(sizes(docs, id_col, text_col, source_col).withColumns({"hash": hashed, "range": F.pmod(F.shiftright(hashed, 20), F.lit(RANGES)).cast("int")}), "sizes")
    aims = staged(targets(sized), "targets")
    ranges = staged(sized.groupBy("source", "size", "range").agg(F.sum("copies").alias("n")), "ranges")
    histogram = ranges.groupBy("source", "size").agg(F.sum("n").alias("n"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    aimed = histogram.join(aims, same(histogram, aims)).drop(aims["source"])
    chosen = staged(aimed.groupBy("source").applyInPandas(_choose, f"source {kind}, size long, passes long, rest long"), "chosen")
    # of each length, how many documents of the rest come from each hash range
    order = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    share = placed.join(chosen, same(placed, chosen) & (placed["size"] == chosen["size"])).select(
        placed["source"], placed["size"], "range", "n", "passes", F.greatest(F.lit(0), F.least(F.col("n"), F.col("rest") - F.col("before"))).alias("quota")
    )
    share = staged(share, "share")
    all_ = sized.join(share, same(sized, share) & (sized["size"] == share["size"]) & (sized["range"] == share["range"])).select(
        sized["doc_id"], sized["source"], sized["size"], sized["hash"], sized["range"], "copies", "n", "passes", "quota"
    )
    split = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    ranked = Window.partitionBy("source", "size", "range").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    partly = all_.filter(split).withColumn("ahead", F.coalesce(F.sum("copies").over(ranked), F.lit(0)))
    partly = partly.withColumn("picked", F.greatest(F.lit(0), F.least("copies", F.col("quota") - F.col("ahead")))).drop("ahead")
    plain = all_.filter(~split).withColumn("picked", F.when(F.col("quota") > 0, F.col("copies")).otherwise(F.lit(0)))
    rows = partly.unionByName(plain).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    repeats = F.col("passes") + F.when(F.col("nth") <= F.col("picked"), 1).otherwise(0)
    told = rows.select("doc_id", "source", "size", repeats.alias("repeats"))
    return told.join(aims, same(told, aims)).select("doc_id", told["source"], "size", "source_size", "target", "repeats")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, columns as they came."""
    given = docs.select(F.struct("*").alias("row"))  # columns of any name travel inside
    column = lambda name: F.col("row").getField(name)
    words = F.coalesce(F.regexp_count(column(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    given = given.select("row", column(id_col).alias("doc_id"), column(source_col).alias("source"), words.alias("size"))
    mixed = mix(docs, id_col, text_col, source_col, seed).filter(F.col("repeats") > 0)
    # equal (id, source, size) rows are interchangeable: the repeats of all of them are dealt out in turn
    per = mixed.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("words")).agg(F.sum("repeats").alias("n"), F.count("*").alias("k"))
    found = given.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("words")))
    alone = found.filter("k = 1").withColumn("times", F.col("n"))
    order = Window.partitionBy("id", "of", "words").orderBy(F.xxhash64(column(text_col)))
    many = found.filter("k > 1").withColumn("at", F.row_number().over(order))
    extra = F.when(F.col("at") <= F.col("n") % F.col("k"), 1).otherwise(0)
    many = many.withColumn("times", F.floor(F.col("n") / F.col("k")) + extra).filter("times > 0").drop("at")
    both = alone.unionByName(many).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return both.select("row.*")
