"""Hard negatives and vector codes by plain Python, in whole numbers."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

LONG = (1 << 63) - 1


def kept(rows, scale):
    """(id, label, whole vector) of rows whose vector takes part."""
    out = []
    for i, label, v in rows:
        if v and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v):
            out.append((i, label, [math.floor(Fraction(x) * scale) for x in v]))
    return out


def product(a, b):
    return max(-LONG, min(LONG, sum(x * y for x, y in zip(a, b))))


def hard_negatives(rows, asks, positives=5, negatives=10, low=30, high=90):
    rows = [r for r in kept(rows, 256) if r[0] is not None and r[1] is not None]
    out = []
    for i, label, v in rows:
        if not asks(i):
            continue
        others = [(product(v, w), j, g) for j, g, w in rows if len(w) == len(v)]
        first = sorted(((s, j) for s, j, g in others if g == label and j != i), key=lambda x: (-x[0], x[1]))[:positives]
        for ps, p in first:
            fits = sorted(((s, j) for s, j, g in others if g != label and low * ps <= 100 * s <= high * ps),
                          key=lambda x: (-x[0], x[1]))[:negatives]
            out += [(i, p, k + 1, j, ps, s) for k, (s, j) in enumerate(fits)]
    return out


def codes(rows, parts=8, entries=16, rounds=6):
    groups = defaultdict(list)
    for r in kept(rows, 4096):
        if len(r[2]) % parts == 0:
            groups[len(r[2])].append(r)
    out = []
    for dim, own in groups.items():
        d = dim // parts
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        books = [[r[2][p * d:(p + 1) * d] for r in own[:entries]] for p in range(parts)]

        def nearest(v, book):
            return min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(book))

        for _ in range(rounds):
            moved = []
            for p, book in enumerate(books):
                members = defaultdict(list)
                for r in own:
                    v = r[2][p * d:(p + 1) * d]
                    members[nearest(v, book)[1]].append(v)
                moved.append([[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else c
                              for k, c in enumerate(book)])
            books = moved
        digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
        for i, label, v in own:
            found = [nearest(v[p * d:(p + 1) * d], b) for p, b in enumerate(books)]
            out.append((i, label, "".join(f"{k:02x}" for _, k in found), min(LONG, sum(e for e, _ in found)), digest))
    errors = defaultdict(int)
    for _, label, _, e, _ in out:
        errors[label] += e
    return [(i, c, e, min(LONG, errors[label]), g) for i, label, c, e, g in out]
