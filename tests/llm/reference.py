"""Plain-Python answers to hold the operators against; documents are (id, text) in any order, ids may be None or repeat."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACE = " \t\n\x0b\x0c\r"
LAST = float("inf")


def order(i):
    return LAST if i is None else i


def removed_bytes(docs, length=100):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, LAST), order(i))
    out = []
    for i, t in docs:
        b, seen = (t or "").encode(), set()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if first[w] < order(i) or w in seen:
                gone[p] += 1
                gone[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed_words(docs, length=13):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            k = tuple(w[p:p + length])
            first[k] = min(first.get(k, LAST), order(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] < order(i):
                gone[p:p + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def learns(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def language_scores(docs, order=3, share=0.5, add=0.5):
    tokens = [(i, ["start", *(t or "").encode().lower().split(), None]) for i, t in docs]
    seen, visits = Counter(), Counter()
    for i, w in tokens:
        for k in range(1, len(w)):
            for m in range(min(order, k + 1)):
                seen[tuple(w[k - m:k + 1])] += learns(i)
                visits[tuple(w[k - m:k])] += learns(i)
    n, types = visits[()], sum(1 for g, c in seen.items() if len(g) == 1 and c)
    out = []
    for i, w in tokens:
        base = score = 0.0
        for k in range(1, len(w)):
            p = (seen[(w[k],)] + add) / (n + add * (types + 1))
            base += math.log10(p)
            for m in range(1, min(order, k + 1)):
                c = visits[tuple(w[k - m:k])]
                p = share * seen[tuple(w[k - m:k + 1])] / c + (1 - share) * p if c else p
            score += math.log10(p)
        out.append((i, not learns(i), len(w) - 1, sum(seen[(x,)] > 0 for x in w[1:]), n, base, score))
    return out


def simhash(text, size=3, seed=42):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[j:j + size]) for j in range(max(1, len(w) - size + 1))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams))


def components(bits, distance=2):
    """Least index of each entry's component."""
    parent = list(range(len(bits)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(bits)):
        for b in range(a):
            if (bits[a] ^ bits[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(bits))]


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()


def similar_components(texts, similarity=0.8, size=5):
    """Least index of each text's component, texts linked by the Jaccard similarity of their shingles."""
    sets, roots = [shingles(t, size) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= similarity * union:
                x, y = roots[a], roots[b]
                roots = [min(x, y) if r in (x, y) else r for r in roots]
    return roots


def edited(docs):
    """(id, text, edited text, next text) in descending order of id, then text."""
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        out.append((i, t, t[:len(t) - third] + n[:third], n))
    return out


def targets(sizes, weights=(1, 2, 3), repeats=3):
    """Shares by weight, capped, the excess given out again until none is above; ``sizes`` in source order."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while left > 1e-9 and free:
        total = sum(weights[k % len(weights)] for k in free)
        give, left = left, 0.0
        for k in list(free):
            target[k] += give * weights[k % len(weights)] / total
            if target[k] >= repeats * sizes[k]:
                left += target[k] - repeats * sizes[k]
                target[k] = float(repeats * sizes[k])
                free.discard(k)
    return target
