"""Suffix order and common-prefix values of a shard by external induced sorting.

S* suffixes (of type S after one of type L) are sorted by what follows them: first by names of their leading symbols,
then, where names are equal, recursively by the names after those. From them the L suffixes are induced in ascending,
and from those the S suffixes in descending order. The priority queue of an induction holds tuples (symbol, rank of the
suffix that follows, position, common prefix with the tuple before it under the same symbol). As suffixes are
processed in order of rank, tuples under a symbol arrive sorted, so that the queue is a first-in, first-out spool for
each symbol, taken out symbol by symbol in bulk; spools go to files when they outgrow the memory they may use.

Only common prefixes up to ``depth`` matter: suffixes that agree so far stay in any order, with that value.
"""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

import numpy as np

#: Symbols are below this; nine bits of seven of them fill a key.
SYMBOLS, PACK, BITS = 512, 7, 9
#: Tuples that all spools together keep in memory.
MEMORY = 4_000_000


class Queue:
    """A monotone priority queue of (symbol, position, prefix) whose tuples of a symbol arrive in order."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.folder, self.files = memory, 0, None, 0
        self.spools: list[list] = [[] for _ in range(SYMBOLS)]

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.spools[symbol].append((position, prefix))
        self.held += len(position)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = Path(tempfile.mkdtemp(prefix="spool-"))
        for spool in self.spools:
            for k, part in enumerate(spool):
                if not isinstance(part, Path):
                    path = self.folder / f"{self.files}.npy"
                    np.save(path, np.stack([part[0], part[1].astype(np.int64)]))
                    spool[k], self.files = path, self.files + 1
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of the symbol, in order."""
        parts = []
        for part in self.spools[symbol]:
            if isinstance(part, Path):
                both = np.load(part)
                part.unlink()
                part = both[0], both[1].astype(np.uint8)
            else:
                self.held -= len(part[0])
            parts.append(part)
        self.spools[symbol] = []
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def close(self) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder)


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S, smaller than the next one."""
    n = len(text)
    up = text[:-1] < text[1:]
    at = np.where(text[:-1] != text[1:], np.arange(n - 1), n)  # the next place where a symbol changes
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(up, True)[np.minimum(at, n - 1)], True)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes a[k] and b[k], up to depth."""
    n = len(text)
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    for d in range(depth):
        x, y = a[live] + d, b[live] + d
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live = live[ok]
        if not len(live):
            break
        out[live] += 1
    return out


def _sort_stars(text: np.ndarray, stars: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The S* positions in order of their suffixes, and the common prefix of each with the one before. Names are of PACK
    symbols; those of equal names are sorted by the name after, and so on."""
    padded = np.concatenate([text, np.zeros(depth + 2 * PACK, text.dtype)]).astype(np.uint64)
    names = padded[: len(text) + depth + PACK].copy()
    for k in range(1, PACK):
        names = names << np.uint64(BITS) | padded[k : k + len(names)]
    order, prefix = stars.copy(), np.full(len(stars), depth, np.uint8)
    prefix[:1] = 0
    new = np.zeros(len(stars), bool)  # differs from the one before
    new[:1] = True
    tied = np.arange(len(stars)) if len(stars) > 1 else np.zeros(0, np.int64)
    for start in range(0, depth, PACK):
        if not len(tied):
            break
        own = order[tied]
        key = names[np.minimum(own + start, len(names) - 1)]
        by = np.lexsort((key, np.cumsum(new)[tied])) if start else np.argsort(key, kind="stable")
        order[tied], key = own[by], key[by]
        apart = np.flatnonzero(~new[tied[1:]] & (tied[1:] == tied[:-1] + 1) & (key[1:] != key[:-1])) + 1
        x = key[apart] ^ key[apart - 1]
        same = np.full(len(apart), start, np.int64)
        for k in range(1, PACK):
            same += x < np.uint64(1 << BITS * (PACK - k))
        prefix[tied[apart]] = np.minimum(same, depth)
        new[tied[apart]] = True
        joined = ~new
        joined[:-1] |= ~new[1:]
        tied = np.flatnonzero(joined)
    return order, prefix


class _Minima:
    """Least values of ranges of a batch's common prefixes."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            v, step = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(v[:-step], v[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of [a, b), which are not empty."""
        level = np.floor(np.log2(b - a)).astype(np.int64)
        out = np.empty(len(a), np.uint8)
        for k in np.unique(level):
            w = level == k
            out[w] = np.minimum(self.levels[k][a[w]], self.levels[k][b[w] - 2**k])
        return out


class _Induction:
    """One direction of inducing: takes batches in order, queues the suffixes before them of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int, memory: int):
        self.text, self.wanted, self.depth = text, wanted, depth
        self.queue = Queue(memory)
        self.carry = np.full(SYMBOLS, depth, np.uint8)  # least prefix since the last tuple under each symbol
        self.seen = np.zeros(SYMBOLS, bool)

    def take(self, positions: np.ndarray, prefix: np.ndarray) -> None:
        """prefix: with the suffix before it in the order taken."""
        if not len(positions):
            return
        run = np.minimum.accumulate(prefix)
        ok = np.flatnonzero((positions > 0) & self.wanted[positions - 1])
        if not len(ok):
            self.carry = np.minimum(self.carry, run[-1])
            return
        symbols = self.text[positions[ok] - 1]
        by = np.argsort(symbols, kind="stable")
        ok, symbols = ok[by], symbols[by]
        first = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        least = np.empty(len(ok), np.uint8)
        heads = np.flatnonzero(first)
        least[heads] = np.minimum(self.carry[symbols[heads]], run[ok[heads]])
        least[heads[~self.seen[symbols[heads]]]] = 0
        minima = _Minima(prefix)
        rest = np.flatnonzero(~first)
        if len(rest):
            least[rest] = minima(ok[rest - 1] + 1, ok[rest] + 1)
        new = np.minimum(least.astype(np.int64) + 1, self.depth).astype(np.uint8)
        new[heads[~self.seen[symbols[heads]]]] = 0
        tails = np.concatenate([heads[1:], [len(ok)]]) - 1
        carry = np.minimum(self.carry, run[-1])
        last = ok[tails]
        carry[symbols[heads]] = self.depth
        inner = last + 1 < len(prefix)
        if inner.any():
            carry[symbols[heads][inner]] = minima(last[inner] + 1, np.full(inner.sum(), len(prefix)))
        self.carry = carry
        self.seen[symbols[heads]] = True
        before = positions[ok] - 1
        for a, b in zip(heads.tolist(), (tails + 1).tolist(), strict=True):
            self.queue.push(int(symbols[a]), before[a:b], new[a:b])


def suffixes(text: np.ndarray, depth: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """text: symbols, the last one 0 and the only 0. Returns positions in suffix order and the common prefix of each
    with the one before, up to depth."""
    text = text.astype(np.uint16)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    small = _types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    stars, star_prefix = _sort_stars(text, stars, depth)
    heads = np.searchsorted(text[stars], np.arange(SYMBOLS + 1))
    used = np.flatnonzero(np.bincount(text, minlength=SYMBOLS))

    one = lambda a, b: common(text, np.array([a]), np.array([b]), depth)[0]
    large: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    induce = _Induction(text, ~small, depth, memory)
    try:
        for c in used.tolist():
            got, last = [], None
            while True:  # a run of one symbol is induced round by round
                pos, prefix = induce.queue.pop(c)
                if not len(pos):
                    break
                got.append((pos, prefix))
                last = pos[-1]
                induce.take(pos, prefix)
            large[c] = tuple(np.concatenate([g[k] for g in got]) for k in (0, 1)) if got else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
            pos, prefix = stars[heads[c] : heads[c + 1]], star_prefix[heads[c] : heads[c + 1]].copy()
            if len(pos):
                prefix[0] = 0 if last is None else one(last, pos[0])
                induce.take(pos, prefix)
    finally:
        induce.queue.close()
    # descending: positions come from the largest on, each with the prefix it shares with the next larger one
    out: list[tuple[np.ndarray, np.ndarray]] = []
    induce = _Induction(text, small, depth, memory)
    try:
        for c in used[::-1].tolist():
            last = None
            while True:
                pos, prefix = induce.queue.pop(c)
                if not len(pos):
                    break
                out.append((pos, prefix))
                last = pos[-1]
                induce.take(pos, prefix)
            pos, up = large[c]
            if len(pos):
                down = np.concatenate([[0], up[:0:-1]]).astype(np.uint8)
                pos = pos[::-1]
                if last is not None:
                    down[0] = one(last, pos[0])
                out.append((pos, down))
                induce.take(pos, down)
    finally:
        induce.queue.close()
    order = np.concatenate([o[0] for o in out] + [np.array([n - 1])])[::-1]
    down = np.concatenate([o[1] for o in out] + [np.zeros(1, np.uint8)])
    return order, np.concatenate([[0], down[::-1][:-1]]).astype(np.uint8)
