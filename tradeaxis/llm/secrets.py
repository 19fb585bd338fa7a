"""Secrets in texts: fixed patterns, and strings of high entropy, as spans in code points.

Patterns (assignments to password-like names, access keys, long hexadecimal strings) are found by one
replacement that puts a separator around every match; the lengths of the pieces give the places. A separator
in the text itself is read as another control character, which no pattern contains, so places stay right.

Other candidate strings are runs of key characters with letters and digits. Each is of the narrowest class
that covers it (hexadecimal, letters of one case with digits, base64), and a window slides over it; counts of
its characters change by the one that enters and the one that leaves, and the entropy with them. A candidate
is told if a full window reaches its class's threshold, unless the allow-list knows it (identifiers in UUID
form, examples and placeholders, runs of the alphabet) or it overlaps a pattern's span.

Native: column functions only. Defined results: a null text is empty and has no spans. Rows are judged one by
one, whole, whatever their length; places are summed in blocks, so many matches in one text cost no square.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR, OTHER = "\x01", "\x02"
#: Fixed patterns, in the order of their kinds; letters of the names in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Classes from narrow to wide with the bits a window must reach.
CLASSES = ((r"^(?:[0-9a-f-]+|[0-9A-F-]+)$", 3.2), (r"^(?:[0-9a-z_-]+|[0-9A-Z_-]+)$", 3.65), (r"^.+$", 3.75))
#: Strings that look random by design or by accident and are no secrets.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|xxxxxx|redacted",
    r"(?i)abcdefgh|01234567|12345678",
    r"^(?:[A-Za-z]{3,}+[/_=-]?)++[0-9]{0,4}$",  # words, joined, and a number
)
_BLOCK = 512


def _found(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as ``(start, kind, end, value)``."""
    pieces = F.split(F.regexp_replace(text, pattern, SEPARATOR + "$0" + SEPARATOR), SEPARATOR, -1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")), lambda i: F.slice(pieces, i * _BLOCK + 1, F.lit(_BLOCK)))
    zero = F.lit(0)
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda n, p: n + F.length(p)))
    no_places = F.array().cast("array<int>")
    begins = F.aggregate(
        sums,
        F.struct(zero.alias("at"), no_places.alias("out")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def inside(block: Column, begin: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            end = s["at"] + F.length(p)
            span = F.struct(s["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p.alias("value"))
            return F.struct(end.alias("at"), (~s["match"]).alias("match"), F.when(s["match"], F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("at"), F.lit(False).alias("match"), none.alias("out")), step, lambda s: s["out"])

    return F.when(text.rlike(pattern), F.flatten(F.zip_with(blocks, begins, inside))).otherwise(none)


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the full windows of an ASCII string."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    term = F.array(*[F.lit(float(c * log2(c)) if c else 0.0) for c in range(window + 2)])
    of = lambda n: F.element_at(term, n + 1)
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))

    def step(s: Column, i: Column) -> Column:
        enter = F.element_at(codes, i)
        leave = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(-1))
        # the one that leaves goes first, then the one that enters
        left = F.when(leave < 0, s["sum"]).otherwise(s["sum"] - of(F.element_at(s["counts"], leave + 1)) + of(F.element_at(s["counts"], leave + 1) - 1))
        now = F.element_at(s["counts"], enter + 1) - F.when(leave == enter, 1).otherwise(0)
        total = left - of(now) + of(now + 1)
        counts = F.transform(s["counts"], lambda c, k: c + F.when(k == enter, 1).otherwise(0) - F.when(k == leave, 1).otherwise(0))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= window, F.least(s["least"], total)).otherwise(s["least"]).alias("least"))

    least = F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step, lambda s: s["least"])
    return F.lit(log2(window)) - least / window


def _told(value: Column) -> Column:
    """Whether a candidate's entropy tells a secret; cheap questions first."""
    need = F.lit(99.0)
    for pattern, bits in reversed(CLASSES):
        need = F.when(value.rlike(pattern), F.lit(bits)).otherwise(need)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    return F.when(mixed & ~allowed, window_entropy(value) >= need).otherwise(F.lit(False))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``base`` and ``spans`` (base and added), each sorted arrays of (start, kind, end, value)."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SEPARATOR, OTHER)
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        _found(F.col("text"), ASSIGN, 0).alias("assign"),
        _found(F.col("text"), ACCESS, 1).alias("access"),
        _found(F.col("text"), HEX, 2).alias("hex"),
        _found(F.col("text"), CANDIDATE, 3).alias("candidates"),
    )
    long = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 8)
    keys = F.filter("access", lambda s: F.length(s["value"]) >= 16)
    based = found.select("doc_id", "candidates", F.array_sort(F.concat(long, keys, "hex")).alias("base"))
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.filter(free, lambda c: _told(c["value"]))
    return based.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def counted(spans: Column | str, kind: int) -> Column:
    """How many spans are of a kind."""
    # one parameter only: Spark gives a second one the place in the array, a default would not hold
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column | str) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
