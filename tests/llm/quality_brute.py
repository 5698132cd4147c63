"""The base rules of the quality check, by their definition."""

import collections
import math
import re

SYMBOLS = re.compile(r"[#*$%&|<>]")


def base(text):
    t = text or ""
    w = t.encode().split()
    words = [x.decode() for x in w]
    n = len(words)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i:i + 3]) for i in range(n - 2))
    covered = set()
    for i in range(n - 2):
        if grams[tuple(words[i:i + 3])] >= 2:
            covered.update((i, i + 1, i + 2))
    rep = len(covered)
    return (n, sum(len(x) for x in words), len(SYMBOLS.findall(t)), dup, rep, n < 50 or 100 * rep > 50 * n)


def log_perplexities(docs):
    """Leave-one-out modified Kneser-Ney log-perplexities of (text, lang) rows."""
    grams = []
    for text, _ in docs:
        w = [x.decode() for x in (text or "").lower().encode().split()]
        seq = [0, 0, *w, 1]
        grams.append([tuple(seq[i:i + 3]) for i in range(len(w) + 1)])
    count = collections.Counter

    def discounts(counts):
        n = [sum(1 for x in counts.values() if x == k) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]

    out = {}
    for lang in {x for _, x in docs}:
        mine = [i for i, (_, x) in enumerate(docs) if x == lang]
        c3 = count(g for i in mine for g in grams[i])
        c2 = count((b, c) for _, b, c in c3)
        c1 = count(c for _, c in c2)
        d3, d2, d1 = discounts(c3), discounts(c2), discounts(c1)
        by = lambda n, d: d[min(n, 3) - 1] if n > 0 else 0.0
        s1, free1 = sum(c1.values()), sum(by(n, d1) for n in c1.values())
        s2, free2, contexts = count(), count(), collections.defaultdict(list)
        for (b, _), n in c2.items():
            s2[b] += n
            free2[b] += by(n, d2)
        for g in c3:
            contexts[g[:2]].append(g)
        for i in mine:
            own, own_context, total = count(grams[i]), count(g[:2] for g in grams[i]), 0.0
            for g, n in own.items():
                _, b, c = g
                p1 = (c1[c] - by(c1[c], d1)) / s1 + free1 / s1 / len(c1)
                p2 = (c2[b, c] - by(c2[b, c], d2)) / s2[b] + free2[b] / s2[b] * p1
                rest = {x: c3[x] - (n if x == g else 0) for x in contexts[g[:2]]}
                s = sum(c3[x] for x in contexts[g[:2]]) - own_context[g[:2]]
                free = sum(by(x, d3) for x in rest.values())
                p = p2 if s <= 0 else max(rest[g] - by(rest[g], d3), 0.0) / s + free / s * p2
                total += n * math.log(p if p > 0 else p2)
            out[i] = -total / len(grams[i])
    return [out[i] for i in range(len(docs))]
