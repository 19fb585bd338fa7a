import plain
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tradeaxis.llm import textops

TEXT = st.text(st.sampled_from("aZ9 \n\t.,é漢'-_\x00\x1f~|#"), max_size=40)


def _pieces(texts, alphabet):
    column, out, hashes = pa.array(texts, pa.string()), [], []
    for i, j, data, _, (starts, ends, counts, h) in textops.word_slices(column, alphabet, limit=16):
        raw, k = data.tobytes(), 0
        for n in counts.tolist():
            out.append([raw[starts[x] : ends[x]].decode() for x in range(k, k + n)])
            hashes.append(h[k : k + n].tolist())
            k += n
    return out, hashes


@given(st.lists(st.none() | TEXT, max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_patterns(texts):
    found, hashes = _pieces(texts, textops.LETTERS)
    wanted = [plain.words(t) for t in texts]
    assert [[w.translate(plain._LOWER) for w in row] for row in found] == wanted
    flat = dict(zip([w for row in wanted for w in row], [h for row in hashes for h in row], strict=True))
    assert len(set(flat.values())) == len(flat)
    assert [[flat[w] for w in row] for row in wanted] == hashes
    assert _pieces(texts, textops.SPACED)[0] == [plain.SPACED.findall(t or "") for t in texts]


def test_a_word_longer_than_a_chunk_hashes_like_itself():
    long = "x" * (3 * textops._CHUNK + 17)
    _, hashes = _pieces([long, long + "y", long], textops.LETTERS)
    assert hashes[0] == hashes[2] != hashes[1]


@given(st.lists(TEXT, min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_shingles_differ_as_their_words_do(texts):
    column, names = pa.array(texts), {}
    for i, _, _, _, (_, _, counts, hashes) in textops.word_slices(column, textops.LETTERS):
        values, rows = textops.shingles(hashes, counts, 5)
        for k in range(len(counts)):
            w = plain.words(texts[i + k])
            wanted = [tuple(w[x : x + 5]) for x in range(max(1, len(w) - 4))] if w else []
            own = values[rows == k].tolist()
            assert len(own) == len(wanted)
            for a, b in zip(wanted, own, strict=True):
                assert names.setdefault(a, b) == b
    assert len(set(names.values())) == len(names)
