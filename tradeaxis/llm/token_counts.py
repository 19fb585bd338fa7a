"""Tokens of fields or sections, by the places of the tokens of whole documents.

A document is encoded once. Its tokens spell its bytes, so their lengths give every token's place; an interval
join (two sorted lists of places) then hands the tokens to the sections. A token that crosses a boundary is
allotted by a rule that the caller names:

- ``start``: to the section of its first byte, - ``end``: of its last byte,
- ``most``: to the section with most of its bytes, the first of equals,
- ``share``: to each section by its share of the bytes, so counts are fractions.

Under any rule the sections' counts add up to the document's tokens. Sections are the lines of the text (a
line feed belongs to the line it ends), or the given fields one after another.

Defined results: a null or empty text is one section without tokens; a null field is an empty section.
Repeated rows are counted one by one. A text is cut for encoding only where the tokenizer always cuts, so
the ids are those of the whole text. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeaxis.llm import textops
from tradeaxis.llm.wordpieces import ByteEncoder

RULES = ("start", "end", "most", "share")


def allot(tokens: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; both are given by their edges, which begin and end at the same places."""
    n = len(sections) - 1
    first, last = tokens[:-1], tokens[1:]
    of = lambda at: np.searchsorted(sections, at, "right") - 1
    if rule == "start":
        return np.bincount(of(first), minlength=n).astype(float)
    if rule == "end":
        return np.bincount(of(last - 1), minlength=n).astype(float)
    head, tail = of(first), of(last - 1)
    out = np.bincount(head[head == tail], minlength=n).astype(float)
    for k in np.flatnonzero(head != tail):  # the few that cross
        own = np.arange(head[k], tail[k] + 1)
        bytes_ = np.minimum(sections[own + 1], last[k]) - np.maximum(sections[own], first[k])
        if rule == "share":
            out[own] += bytes_ / (last[k] - first[k])
        else:
            out[own[np.argmax(bytes_)]] += 1
    return out


def counts(docs: DataFrame, tokenizer: str, pattern: str, rule: str = "start", fields: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, section, start, end, n_tokens, n_crossing)``, places in code points, end exclusive.

    With ``fields`` the document is these columns one after another and each is a section; else the text's
    lines are. ``n_crossing`` counts the tokens that begin in a section and end in another.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {', '.join(RULES)}")
    kind = docs.schema[id_col].dataType
    names = fields or (text_col,)
    lines = fields is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(tokenizer, pattern)
        for batch in batches:
            columns = [textops.text_bytes(batch.column(1 + k)) for k in range(len(names))]
            if len(columns) == 1:
                data, offsets = columns[0]
                edges = None
            else:
                sizes = np.stack([np.diff(o) for _, o in columns], axis=1)
                cells = np.concatenate(([0], np.cumsum(sizes.ravel())))
                data, edges = np.empty(int(cells[-1]), np.uint8), cells.reshape(-1)
                for r in range(batch.num_rows):
                    for k, (raw, o) in enumerate(columns):
                        at = edges[r * len(names) + k]
                        data[at : at + o[r + 1] - o[r]] = raw[o[r] : o[r + 1]]
                offsets = edges[:: len(names)]
            for i, j in textops.slices(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if edges is None:
                    feed = np.flatnonzero(part == 10) + 1 if lines else np.zeros(0, np.int64)
                    feed = np.setdiff1d(feed, own)  # an edge of a row is none of its own
                    bounds = np.sort(np.concatenate((own, feed)))  # an empty row keeps its empty section
                    per_row = np.bincount(np.searchsorted(own, feed, "right") - 1, minlength=j - i) + 1
                else:
                    bounds = edges[i * len(names) : j * len(names) + 1] - offsets[i]
                    per_row = np.full(j - i, len(names))
                token_ids, _ = encoder.slice(part, own)
                tokens = np.concatenate(([0], np.cumsum(encoder.size_of[token_ids])))
                n = allot(tokens, bounds, rule) if len(token_ids) else np.zeros(len(bounds) - 1)
                crossing = np.zeros(len(bounds) - 1, np.int64)
                if len(token_ids):
                    head, tail = (np.searchsorted(bounds, x, "right") - 1 for x in (tokens[:-1], tokens[1:] - 1))
                    crossing = np.bincount(head[head != tail], minlength=len(bounds) - 1)
                points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                row = np.repeat(np.arange(j - i), per_row)
                section = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
                origin = points[own[row]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + i)), pa.array(section, pa.int32()), pa.array(points[bounds[:-1]] - origin), pa.array(points[bounds[1:]] - origin), pa.array(n), pa.array(crossing, pa.int64())],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    schema = T.StructType([T.StructField("doc_id", kind, True), *T._parse_datatype_string("section int, start long, end long, n_tokens double, n_crossing long").fields])
    return docs.select(F.col(id_col), *[F.col(c).cast("string") for c in names]).mapInArrow(run, schema)
