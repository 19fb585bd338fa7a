"""URL filter: domain rules first, then a character language-model ratio.

Rules of host and path prefix decide what they cover; the longest wins. The URLs they cover are also the
training data: two variable-order Markov models of characters, one of accepted and one of rejected URLs, give
each URL the difference of its log-likelihoods per character. A context that was seen gives its counts as much
weight as it has seen times, against its shorter suffix with as many as it has different followers
(Witten-Bell); so the order follows the evidence, up to ``ORDER`` characters of context.

A fifth of the covered URLs, by hash, is kept from training; on it the threshold with the best mean of the two
classes' accuracies is chosen. Counts cover all URLs of the input and stay distributed: windows of characters
are folded before they are shuffled, every order is a group of suffixes of the next longer one, and its
probabilities are joined to the next order. The models never reach the driver, whatever their size.

Host and path as in ``parts``; rules see no more than these. The models read the whole URL behind ``://`` (host
lower-cased, path, query and fragment), or all of it where there is none. Defined results: a null URL, or one without
``://``, has empty host and path and is covered by no rule; a null one is judged as the empty string. Equal URLs are scored once. Without covered URLs of both
kinds the threshold is 0 and every URL not covered is accepted. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeaxis.session import staged

#: Host and path prefix, and the verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 4
SYMBOLS = 256
FOLDS = 5
GRAIN = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BEGIN, _END = "\x02", "\x03"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def whole(url: Column) -> Column:
    """What the models read: all behind ``://`` with the host's A-Z lower-cased, or the URL as it is."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.substring(text, at + 3, F.length(text))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(at > 0, F.concat(F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + 1, F.length(rest)))).otherwise(text)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that covers host and path, and its verdict; null if there is none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = text.partition("/")
        covers = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(covers, F.lit(text)).otherwise(rule), F.when(covers, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _windows(texts: DataFrame, order: int, *columns: str) -> DataFrame:
    """All windows of ``order`` characters of context and the one they foretell."""
    padded = F.concat(F.lit(_BEGIN * order), F.col("text"), F.lit(_END))
    told = texts.withColumn("padded", padded).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text") + 1)))
    return told.select(F.expr(f"substring(padded, at, {order + 1})").alias("gram"), *columns)


def _smoothed(level: DataFrame, shorter: DataFrame | None, kind: str) -> Column:
    """Witten-Bell estimate of one model from its counts and the shorter context's estimate."""
    below = F.lit(1.0 / SYMBOLS) if shorter is None else F.col(f"p_{kind}")
    seen, kinds = F.col(f"seen_{kind}"), F.col(f"kinds_{kind}")
    return F.when(seen == 0, below).otherwise((F.col(kind) + kinds * below) / (seen + kinds))


def ratios(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, ratio)``: log-likelihood difference of every window, from counts ``good`` and ``bad`` of texts."""
    full = _windows(texts, order, "good", "bad").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    full = staged(full, "grams")
    known = None
    for k in range(order + 1):
        level = full if k == order else full.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = Window.partitionBy(F.expr(f"left(gram, {k})"))
        sums = {f"seen_{c}": F.sum(c).over(context) for c in ("good", "bad")} | {f"kinds_{c}": F.sum((F.col(c) > 0).cast("int")).over(context) for c in ("good", "bad")}
        level = level.withColumns(sums)
        if known is not None:
            level = level.withColumn("tail", F.expr(f"right(gram, {k})")).join(known.withColumnRenamed("gram", "tail"), "tail")
        known = staged(level.select("gram", _smoothed(level, known, "good").alias("p_good"), _smoothed(level, known, "bad").alias("p_bad")), "level")
    return staged(known.select("gram", (F.log("p_good") - F.log("p_bad")).alias("ratio")), "ratios")


def judged(pages: DataFrame, rules=RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (per character; null where a rule decides)."""
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), whole(F.col(url_col)).alias("text"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = split.withColumns({"rule": rule, "says": says})
    texts = rows.groupBy("text").agg(F.count(F.when(F.col("says") == "allow", 1)).alias("allow"), F.count(F.when(F.col("says") == "block", 1)).alias("block"))
    held = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    texts = staged(texts.withColumns({"good": F.when(held, 0).otherwise(F.col("allow")), "bad": F.when(held, 0).otherwise(F.col("block")), "held": held}), "texts")
    # only URLs that no rule decides, and the held ones that choose the threshold, need a score
    asked = texts.filter(F.col("held") | (F.col("allow") + F.col("block") == 0))
    told = _windows(asked, order, "text").join(ratios(texts, order), "gram")
    # sums in whole units, so that their order does not matter
    exact = F.sum(F.round(F.col("ratio") * 1e9).cast("long"))
    scores = staged(told.groupBy("text").agg((exact / F.lit(1e9) / F.count("*")).alias("score")), "scores")
    limit = threshold(scores.join(texts.filter("held"), "text"))
    undecided = rows.filter(F.col("rule").isNull()).join(scores, "text", "left")
    method = F.when(F.col("score") >= limit, "allow").otherwise("block")
    names = ("page_id", "host", "path", "rule")
    by_rule = rows.filter(F.col("rule").isNotNull()).select(*names, F.col("says").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return by_rule.unionByName(undecided.select(*names, method.alias("verdict"), "score"))


def threshold(scored: DataFrame) -> float:
    """The score from which on URLs are accepted; held-out rows are counted by score in bins first."""
    bins = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) * GRAIN).cast("int")
    rows = scored.groupBy(bins.alias("bin")).agg(F.sum("allow").alias("good"), F.sum("block").alias("bad")).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, above, below = -1.0, 0.0, good, 0
    for r in rows:  # at most 40 001 bins
        gain = above / good + below / bad
        if gain > best + 1e-12:
            best, at = gain, r["bin"] / GRAIN
        above, below = above - r["good"], below + r["bad"]
    return at
