"""Whole Arrow columns of text as flat bytes: token borders and 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
STEP = 0x9E3779B97F4A7C15 | 1
BACK = pow(STEP, -1, 1 << 64)
FOLD = U(0xD6E8FEB86659FD93)

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the same with A-Z read as a-z.
VALUES = _rng.integers(1, 1 << 64, 256, dtype=U, endpoint=False)
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]
#: Kinds of bytes: 0 between tokens.  ``SPACED``: all but blanks.  ``MIXED``: words apart from signs.
SPACED = np.ones(256, np.uint8)
SPACED[[0x20, 9, 10, 11, 12, 13]] = 0
MIXED = np.full(256, 2, np.uint8)
MIXED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
MIXED[[0x20, 9, 10, 11, 12, 13]] = 0

_powers = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``STEP`` and of its inverse modulo 2**64, for offsets up to ``n``."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        _powers = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size, base, U))])
                        for base in (STEP, BACK))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20
           ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows with some ``limit`` bytes: first row, bytes, offsets."""
    first, last = 0, len(offsets) - 1
    while first < last:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """s with (s[e] - s[b]) * BACK**b the hash of bytes b to e, wherever they stand."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * powers(len(data))[0][:len(data)], out=out[1:])
    return out


def tokens(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = SPACED,
           values: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Row number and 64-bit hash of each token, in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U)
    kind = kinds[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    borders = np.flatnonzero(change)
    inside = kind[borders[:-1]] != 0
    starts, ends = borders[:-1][inside], borders[1:][inside]
    sums = prefix_sums(data, values)
    hashes = mixed((sums[ends] - sums[starts]) * powers(len(data))[1][starts]
                   + (ends - starts).astype(U))
    return np.searchsorted(offsets, starts, "right") - 1, hashes


def folded(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for the tokens of each position across ``parts``, in order."""
    out = np.full(len(parts[0]), U(len(parts)), U)
    for part in parts:
        out = out * FOLD + part
    return mixed(out)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-token shingles (see ngram_join)."""
    for _, data, offsets in pieces(*flat(column)):
        row, word = tokens(data, offsets)
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        n = max(0, len(word) - size + 1)
        grams = folded([word[k:k + n] for k in range(size)])
        for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if e - b >= size:
                yield np.unique(grams[b:e - size + 1])
            elif e > b:
                yield folded([word[k:k + 1] for k in range(b, e)])
            else:
                yield grams[:0]
