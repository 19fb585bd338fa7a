"""Ids of whole texts by a public tokenizer, each distinct piece encoded once per worker.

The tokenizer splits a text before merging, so a text can be cut wherever it always splits: at ASCII
white space, and between ASCII letters, digits and punctuation (but for the apostrophe, which begins
contractions, and ``<|>``, which spell special tokens). Pieces repeat a lot; their ids are kept in a
bounded table and put together with array operations. A full table gives up the half of its pieces that the
fewest slices used. The result is the same as encoding the whole text. A text that spells a special token is
encoded whole.

A piece of letters that normalising and splitting leave whole goes straight to the merges.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from tradeaxis.llm import textops

#: Pieces a worker remembers.
MEMORY = 1_000_000
#: New pieces are looked up apart until there are so many; then they go into the sorted table.
RECENT = 1 << 16
#: Letters below this are letters in every version of Unicode that tokenizers and Python know.
_SETTLED = "\u0530"


def _classes() -> np.ndarray:
    kind = np.full(256, 4, dtype=np.uint8)
    kind[9:14] = kind[32] = 0
    kind[65:91] = kind[97:123] = 1
    kind[48:58] = 2
    for low, high in ((33, 47), (58, 64), (91, 96), (123, 126)):
        kind[low : high + 1] = 3
    for c in b"'<|>":
        kind[c] = 4
    return kind


_KIND = _classes()


def byte_letters() -> list[str]:
    """The character that byte-level merges use for each byte: printable ones are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    letters.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [letters[b] for b in range(256)]


class Memory:
    """Ids of pieces by the hash of the piece, in arrays; the pieces used least go when it is full."""

    def __init__(self, most: int):
        self.most = most
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.recent: dict[int, int] = {}
        self.first, self.size, self.uses = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.pieces = self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each of the sorted keys, or -1."""
        out = np.full(len(keys), -1, dtype=np.int32)
        if len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[k] == keys
            out[hit] = self.at[k[hit]]
        if self.recent:
            missing = np.flatnonzero(out < 0)
            out[missing] = [self.recent.get(k, -1) for k in keys[missing].tolist()]
        return out

    def learn(self, keys: list[int], encoded: list[list[int]]) -> None:
        """New keys with their ids."""
        sizes = np.array([len(x) for x in encoded], dtype=np.int32)
        flat = np.array([i for x in encoded for i in x], dtype=np.uint32)
        a, b = self.pieces, self.pieces + len(keys)
        if b > len(self.first):
            self.first, self.size, self.uses = (np.concatenate((x[:a], np.zeros(b // 2 + len(keys), np.int32))) for x in (self.first, self.size, self.uses))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(self.used // 2 + len(flat), np.uint32)))
        self.size[a:b], self.uses[a:b] = sizes, 0
        self.first[a:b] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.pieces, self.used = b, self.used + len(flat)
        self.recent.update(zip(keys, range(a, b), strict=True))
        if len(self.recent) >= RECENT:
            self._settle()

    def _settle(self) -> None:
        keys = np.fromiter(self.recent.keys(), np.uint64, len(self.recent))
        at = np.fromiter(self.recent.values(), np.int32, len(self.recent))
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at = np.insert(self.keys, where, keys), np.insert(self.at, where, at)
        self.recent = {}

    def make_room(self, more: int) -> None:
        """Before so many new pieces: gives up the less used half if they do not fit."""
        if self.pieces + more <= self.most or not self.pieces:
            return
        self._settle()
        kept = np.sort(np.argsort(-self.uses[: self.pieces], kind="stable")[: self.most // 2])
        new = np.full(self.pieces, -1, dtype=np.int32)
        new[kept] = np.arange(len(kept), dtype=np.int32)
        sizes = self.size[kept]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.first[kept] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        self.first, self.size, self.uses = (ends - sizes).astype(np.int32), sizes, self.uses[kept]
        self.pieces, self.used = len(kept), len(self.ids)
        stay = new[self.at] >= 0
        self.keys, self.at = self.keys[stay], new[self.at[stay]]


class Encoder:
    """Encodes columns with one tokenizer file; one per worker and file."""

    _made: dict[tuple, "Encoder"] = {}
    fold = textops.LETTERS.fold

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.markers = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.memory = Memory(MEMORY)

    @classmethod
    def of(cls, *args: str) -> "Encoder":
        key = (cls, *args)
        if key not in cls._made:
            cls._made[key] = cls(*args)
        return cls._made[key]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        kind = _KIND[data]
        inside = kind > 0
        split = np.zeros(len(data), dtype=bool)
        split[1:] = (kind[1:] != kind[:-1]) & (kind[1:] < 4) & (kind[:-1] < 4)
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        split[filled] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (split | ~before))
        after = np.ones(len(data), dtype=bool)
        after[:-1] = ~inside[1:] | split[1:]
        ends = np.flatnonzero(inside & after) + 1
        return starts, ends, np.diff(np.searchsorted(starts, offsets))

    def _merged(self, piece: str) -> str | None:
        """What the merges see of a piece that is one word of settled letters, else None."""
        if piece.isascii():
            return piece.lower() if piece.isalpha() else None
        low = piece.lower()
        if not low.isalpha() or max(piece) >= _SETTLED or "\u03a3" in piece or not unicodedata.is_normalized("NFC", piece):
            return None
        return "".join([self.letters[b] for b in low.encode()])

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        words, model = [self._merged(p) for p in pieces], self.tokenizer.model
        rest = [p for p, w in zip(pieces, words, strict=True) if w is None]
        others = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        return [next(others).ids if w is None else [t.id for t in model.tokenize(w)] for w in words]

    def slice(self, data: np.ndarray, offsets: np.ndarray):
        """The ids of a slice's rows one after another, and their counts."""
        starts, ends, counts = self._pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        hashes = textops.hash_pieces(data, starts, ends, self.fold)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = self.memory.find(keys)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            raw = data.tobytes()
            spans = zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist(), strict=True)
            encoded = self._encoded([raw[a:b].decode() for a, b in spans])
            if self.memory.pieces + len(fresh) > self.memory.most:
                self.memory.make_room(len(fresh))
                at = self.memory.find(keys)
                gone = np.flatnonzero(at < 0)  # the fresh ones, and what this slice has of the pieces given up
                new = dict(zip(fresh.tolist(), encoded, strict=True))
                again = [g for g in gone.tolist() if g not in new]
                spans = zip(starts[where[again]].tolist(), ends[where[again]].tolist(), strict=True)
                new.update(zip(again, self._encoded([raw[a:b].decode() for a, b in spans]), strict=True))
                fresh, encoded = gone, [new[g] for g in gone.tolist()]
            self.memory.learn(keys[fresh].tolist(), encoded)
            at = self.memory.find(keys)
        self.memory.uses[at] += 1
        slot = at[inverse]
        size = self.memory.size[slot].astype(np.int64)
        done = np.cumsum(size)
        ids = self.memory.ids[np.repeat(self.memory.first[slot] - (done - size), size) + np.arange(int(done[-1]))]
        edges = np.concatenate(([0], done))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(edges)

    def encode(self, column: pa.Array):
        """For each slice of rows: its first row, the ids of its rows one after another, and their counts."""
        data, offsets = textops.text_bytes(column)
        for i, j in textops.slices(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            raw = part.tobytes()
            if not any(m in raw for m in self.markers):
                yield i, *self.slice(part, own)
                continue
            for k in range(j - i):  # a text that may spell a special token
                text = raw[own[k] : own[k + 1]]
                if any(m in text for m in self.markers):
                    ids = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=np.uint32)
                    yield i + k, ids, np.array([len(ids)])
                else:
                    yield i + k, *self.slice(part[own[k] : own[k + 1]], own[k : k + 2] - own[k])


class ByteEncoder(Encoder):
    """Byte-level ids; the tokens of a text spell its bytes. Cut before a single blank and an ASCII letter."""

    fold = textops.SPACED.fold

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size_of[rank] = len(token)
        self.markers = []
        self.memory = Memory(MEMORY)

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(piece) for piece in pieces]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        # the byte before is visible ASCII, so the blank begins the next token
        cut = np.zeros(len(data), dtype=bool)
        letter = (_KIND == 1)[data]
        visible = (data > 32) & (data < 127)
        cut[1:-1] = (data[1:-1] == 32) & visible[:-2] & letter[2:]
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        # a blank that ends a row is followed by another row's letter
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        cut[last] = False
        cut[filled] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data)), np.diff(np.searchsorted(starts, offsets))
