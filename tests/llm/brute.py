"""Plain versions of the contracts, one row at a time."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str | None) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def fold(doc_id, n: int = 5) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id to (size, component)."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by: dict = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    shared: Counter = Counter()
    for d, s in sets.items():
        near: Counter = Counter(y for x in s for y in by[x] if y < d)
        for y, both in near.items():
            if 100 * both >= 75 * (len(s) + len(sets[y]) - both):
                a, b = sorted((root(d), root(y)))
                parent[b] = a
        shared.update(near)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def base_licenses(text: str | None) -> tuple:
    w = [x.decode() for x in ALNUM.findall(lowered(text))]
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def lm_base(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    docs = {d: [*WORD.findall(lowered(t)), None] for d, t in rows}
    count = Counter(w for d, ws in docs.items() if fold(d) != 1 for w in ws)
    total, distinct = sum(count.values()), len(count)
    denominator = total + 0.5 * (distinct + 1)
    return {d: (len(ws), sum(count[w] > 0 for w in ws), total, sum(math.log10((count[w] + 0.5) / denominator) for w in ws)) for d, ws in docs.items()}


def lm_scores(rows: list[tuple[int, str | None]], rounded, weight: float = 0.2) -> dict[int, float]:
    """Interpolated log10 probability of each text, with all words' and bigrams' counts rounded."""
    docs = {d: [*WORD.findall(lowered(t)), None] for d, t in rows}
    train = [ws for d, ws in docs.items() if fold(d) != 1]
    count = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip(["start", *ws], ws, strict=False))
    denominator = sum(map(rounded, count.values())) + 0.5 * (len(count) + 1)
    out = {}
    for d, ws in docs.items():
        out[d] = 0.0
        for before, w in zip(["start", *ws], ws, strict=False):
            alone = (rounded(count[w]) + 0.5) / denominator
            head = rounded(count[None if before == "start" else before])
            follows = min(1.0, rounded(pairs[before, w]) / max(head, 1)) if head else alone
            out[d] += math.log10(min(1.0, (1 - weight) * alone + weight * follows))
    return out


def nearest(ids: np.ndarray, x: np.ndarray, queries: list[int], k: int = 5) -> dict[int, list[tuple[int, float]]]:
    norm = np.sqrt((x * x).sum(1))
    at = {i: n for n, i in enumerate(ids.tolist())}
    out = {}
    for q in queries:
        s = (x * x[at[q]]).sum(1) / (norm * norm[at[q]])
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def mix_targets(sizes: dict, most: int = 3) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over
        if len(full) == len(names):
            return {s: most * sizes[s] for s in names}
