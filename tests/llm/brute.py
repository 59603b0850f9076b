"""Plain single-process versions of the digest contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, window=10):
    """docs: (id, text); items: (id, text) -> {(id, text): (n_words, n_hit, n_items, sha, flag)}"""
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners:
                    found |= owners
                    hit |= set(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def simhash(text):
    w = TOKEN.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near_classes(docs):
    """docs: (id, text) with distinct ids -> {id: (fingerprint hex, component)}"""
    prints = {d: simhash(t) for d, t in docs}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = components(pairs, ids)
    return {d: (f"{prints[d]:016x}", root[d]) for d in ids}


def targets(sizes, weights=(5, 2, 1)):
    """sizes: {source: words} -> {source: target}"""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else rest * weight[s] / total for s in names}
        full |= over


def base_scores(docs, held=lambda d: zlib.crc32(str(d).encode()) % 7 == 2):
    counts = Counter()
    for d, text in docs:
        if not held(d):
            counts.update([*TOKEN.findall(lower(text)), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, text in docs:
        tokens = [*TOKEN.findall(lower(text)), None]
        score = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        out[d] = (held(d), len(tokens), sum(counts[t] > 0 for t in tokens), n, score)
    return out
