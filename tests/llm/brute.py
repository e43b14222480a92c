"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from math import isqrt

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def order_key(x):
    return (x is None, x if x is not None else 0)


def feistel(x, n, seed):
    prime, a = (1 << 31) - 1, isqrt(max(n - 1, 0)) + 1
    b = -(-n // a)

    def f(half, key):
        y = (half + key) * 48271 % prime
        y = (y ^ (y >> 13)) * 69621 % prime
        return y ^ (y >> 15)
    while True:
        left, right = x % a, x // a
        for k in range(6):
            key = (seed * 48271 + 40692 * (k + 1) * (k + 1)) % prime
            if k % 2 == 0:
                left = (left + f(right, key)) % a
            else:
                right = (right + f(left, key)) % b
        x = right * a + left
        if x < n:
            return x


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s:s + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if (win := tuple(w[s:s + size])) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[win]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_duplicates(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    first = {}
    for i, s in enumerate(sets):
        if s and first.setdefault(s, i) != i:
            parent[root(i)] = root(first[s])
    different = sorted(first, key=len)
    for x, a in enumerate(different):
        for b in different[x + 1:]:
            if 100 * len(a) < 80 * len(b):
                break
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                parent[root(first[a])] = root(first[b])
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = min(least.get(r, d), d, key=order_key)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)]


def line_dedup(docs):
    blank = " \t\n\r\x0b\x0c"
    key = lambda line: line.strip(blank).translate(A_TO_Z)
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(i)
    owner = {k: min(v, key=order_key) for k, v in held.items() if len(v) > 1}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in owner or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def suffix_dedup(docs, length=400):
    seen = Counter()
    bodies = [(i, (t or "").encode()) for i, t in docs]
    for _, b in bodies:
        seen.update(hash(b[s:s + length]) for s in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[hash(b[s:s + length])] > 1:
                gone[s:s + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return {s: 3.0 * sizes[s] for s in order}
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        above = {s for s in rest if weight[s] * level > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= above


def crc(text):
    return zlib.crc32((text or "").encode())


def dice(a, b):
    def bag(text):
        w = [x.translate(A_TO_Z) for x in re.findall(r"[^\W_]+", text)]
        return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)
    x, y = bag(a), bag(b)
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if x and y else 0.0


# --- language

def has_letter(text):
    return any(unicodedata.category(c)[0] == "L" for c in text or "")


def words_of(text):
    """Runs of letters and marks."""
    out, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def language_model(rows):
    """A function from a text to (language, score), learned from (language, text)."""
    words = defaultdict(Counter)
    for lang, text in rows:
        if lang is not None and text is not None:
            words[lang].update(words_of(text))
    words = {g: c for g, c in words.items() if c}
    langs = sorted(words)
    total = {g: sum(words[g].values()) for g in langs}
    grams = {g: Counter() for g in langs}
    for g in langs:
        for w, n in words[g].items():
            padded = f" {w} "
            for size in (5, 4, 3, 2, 1):
                for i in range(len(padded) - size + 1):
                    grams[g][padded[i:i + size]] += n

    def logs(table, unit):
        if not any(table[g][unit] for g in langs):
            return None
        own = [math.log((table[g][unit] + .1) / (total[g] + 1)) for g in langs]
        return [x - sum(own) / len(own) for x in own]

    def of_word(w):
        if (known := logs(words, w)) is not None:
            return known
        for size, weight in ((5, .8), (4, .6), (3, .4), (2, .25), (1, .1)):
            padded = f" {w} "
            found = [s for i in range(len(padded) - size + 1) if (s := logs(grams, padded[i:i + size])) is not None]
            if found:
                return [weight * sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)

    def predict(text):
        if not has_letter(text) or not langs:
            return "und", 0.0
        sums = [sum(x) for x in zip(*map(of_word, words_of(text)))]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        return langs[best], 1 / sum(math.exp(max(x - sums[best], -700)) for x in sums)
    return predict
