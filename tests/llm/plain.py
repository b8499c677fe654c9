"""Plain answers that the tests hold the operators against."""

import hashlib

from tests.llm.conftest import rows  # noqa: F401


def brute_components(data):
    sets = []
    for _, text, *_ in data:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n = len(data)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, *_) in enumerate(data):
        k = find(i)
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return [(d, len(sets[i]), least.get(find(i)), links[i]) for i, (d, *_) in enumerate(data)]


def brute_dedup(data, width=50):
    first = {}
    key = lambda d: (d is None, d)
    for d, text, *_ in data:
        b = (text or "").encode()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w not in first or key(d) < key(first[w]):
                first[w] = d
    out = []
    for d, text, *_ in data:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if key(first[b[i : i + width]]) < key(d):
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
