"""Plain Python statements of what the operators compute, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(_LOWER))


def hits(texts, items, window=10):
    """For each text: words, hit words, ids of the items found."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= ids
        out.append((len(w), len(hit), found - {None}))
    return out


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_classes(texts, least=0.8):
    """Class number of each text: the first index of its class."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def quality_counts(text):
    text = text or ""
    w, seen, dup = SPACED.findall(text), set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    n, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if n[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Base spans as (start, kind, end)."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def entropy(value, window):
    """The highest entropy of the full windows."""
    best = -math.inf
    for i in range(len(value) - window + 1):
        n = Counter(value[i : i + window])
        best = max(best, -sum(c / window * math.log2(c / window) for c in n.values()))
    return best


def url_parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def whole_url(url):
    url = url or ""
    if "://" not in url:
        return url
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER) + rest[len(host) :]


def witten_bell(good, bad, order, symbols):
    """Per-character log-likelihood difference under two models counted from texts."""

    def counted(texts):
        grams = [Counter() for _ in range(order + 1)]
        for text in texts:
            padded = "\x02" * order + text + "\x03"
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    grams[k][padded[i - k : i + 1]] += 1
        seen, kinds = [Counter() for _ in grams], [Counter() for _ in grams]
        for k, table in enumerate(grams):
            for g, n in table.items():
                seen[k][g[:k]] += n
                kinds[k][g[:k]] += 1
        return grams, seen, kinds

    models = counted(good), counted(bad)

    def chance(model, gram):
        grams, seen, kinds = model
        p = 1 / symbols
        for k in range(order + 1):
            g = gram[len(gram) - k - 1 :]
            if seen[k][g[:k]]:
                p = (grams[k][g] + kinds[k][g[:k]] * p) / (seen[k][g[:k]] + kinds[k][g[:k]])
        return p

    def score(text):
        padded = "\x02" * order + text + "\x03"
        total = 0.0
        for i in range(order, len(padded)):
            gram = padded[i - order : i + 1]
            total += math.log(chance(models[0], gram)) - math.log(chance(models[1], gram))
        return total / (len(text) + 1)

    return score
