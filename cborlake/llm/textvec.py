"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word's hash is a polynomial over its bytes modulo 2 ** 64 with an odd base, taken as a difference of running sums
and mixed with its length; it depends on nothing but the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GRAM = 5
#: Texts are taken in groups of about so many bytes; a longer text is a group of its own.
CHUNK = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit generator: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) <= most:
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry than texts)."""
    blob = b"\n".join(texts) + b"\n"
    data = np.frombuffer(blob, np.uint8)
    space = _SPACE[data]
    word = ~space
    first = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(space & np.concatenate([[False], word[:-1]]))
    powers, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    h = (sums[last] - sums[first]) * inverse[first]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return mix(h + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(first, begins)


_WEIGHTS = [np.uint64(pow(_BASE, 2 * k + 3, 1 << 64) | 1) for k in range(64)]


def shingles(texts: list[bytes], gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text of fewer words has all of them as its only one."""
    h, begins = words(texts)
    full = np.zeros(max(0, len(h) - gram + 1), np.uint64)
    for k in range(gram):
        full += h[k : len(h) - gram + 1 + k] * _WEIGHTS[k] if len(full) else full
    full = mix(full)
    out = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b - a >= gram:
            out.append(np.unique(full[a : b - gram + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(h[a + k]) * int(_WEIGHTS[k]) for k in range(b - a)) + int(b - a) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
