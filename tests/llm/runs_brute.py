"""Runs by their definition: every period, every stretch, smallest period checked."""

import hashlib

import numpy as np


def runs(codes):
    codes = np.asarray(codes, dtype=np.int64)
    n, out = len(codes), []
    for q in range(1, n // 4 + 1):
        eq = np.concatenate(([False], codes[:-q] == codes[q:], [False])).astype(np.int8)
        change = np.diff(eq)
        for x, y in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
            length = int(y - x + q)
            if length < max(6, 4 * q):
                continue
            seg = codes[x:x + length]
            if any(q % d == 0 and np.array_equal(seg[:-d], seg[d:]) for d in range(1, q)):
                continue
            out.append((int(x), length, q))
    return sorted(out)


def describe(words):
    ids = {}
    codes = [ids.setdefault(w, len(ids)) for w in words]
    found = runs(codes)
    drop = set()
    for s, n, q in found:
        drop.update(range(s + q, s + n))
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (len(found), *(best if best else (None, None, None)), (1000 * best[1]) // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())
