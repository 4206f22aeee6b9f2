"""Plain versions of what the operators compute, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = words(fold(text))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows, k, percent):
    """[(doc_id, set size, component)] by comparing all pairs."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y:
                shared = len(x & y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    return [(d, len(s), None if d is None else root(d)) for d, s in sets]


def removed(rows, k):
    """[(doc_id, words, flags of removed words)] for windows of k words."""
    first = defaultdict(lambda: float("inf"))
    for d, t in rows:
        if d is not None:
            w = words(t)
            for i in range(len(w) - k + 1):
                first[tuple(w[i:i + k])] = min(first[tuple(w[i:i + k])], d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i:i + k])] < d:
                gone[i:i + k] = [True] * k
        out.append((d, w, gone))
    return out
