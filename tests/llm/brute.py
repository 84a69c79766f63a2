"""Plain versions of the operators, straight from their definitions."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def repeats(rows, size=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + size] for _, b in raw for p in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = [True] * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), sha(kept)))
    return out


def windows(rows, items, size=10):
    own = []
    for k, (item, text) in enumerate(items):
        w = words(text)
        n = min(size, len(w))
        own += [(tuple(w[i : i + n]), (k, "") if item is None else (-1, str(item))) for i in range(len(w) - n + 1)] if n else []
    out = []
    for i, text in rows:
        w = words(text)
        hit, found = [False] * len(w), set()
        for window, item in own:
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p : p + len(window)]) == window:
                    hit[p : p + len(window)] = [True] * len(window)
                    found.add(item)
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(x for k, x in found if k < 0)).encode()), any(hit)))
    return out


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = [i for i, _ in sets]
    while True:
        before = list(label)
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if a != b and x and 100 * len(x & y) >= 80 * len(x | y):
                    known = [v for v in (label[a], label[b]) if v is not None]
                    label[a] = label[b] = min(known, default=None)
        if label == before:
            return [(i, len(s), c) for (i, s), c in zip(sets, label)]
