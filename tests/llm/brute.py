"""Plain-Python versions of the operators that SQL can't express, for small tables."""

import re
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def near_components(rows, k=4, percent=80):
    """{row index: (set size, component id)} by comparing all classes that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    classes = defaultdict(list)
    for n, s in enumerate(sets):
        if s:
            classes[s].append(n)
    order, parent = list(classes), list(range(len(classes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for c, s in enumerate(order):
        shared = Counter(o for g in s for o in held[g])
        for g in s:
            held[g].append(c)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(order[o]) - n):
                parent[find(c)] = find(o)
    low = {}
    for c, s in enumerate(order):
        ids = [rows[n][0] for n in classes[s] if rows[n][0] is not None]
        if ids:
            low[find(c)] = min([*ids, *([low[find(c)]] if find(c) in low else [])])
    out = {n: (0, rows[n][0]) for n in range(len(rows))}
    for c, s in enumerate(order):
        for n in classes[s]:
            out[n] = (len(s), low.get(find(c)))
    return out
