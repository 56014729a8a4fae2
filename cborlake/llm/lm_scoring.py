"""Language-model scores by online logistic context mixing.

A text is a string of bytes and an end, each coded as the bits of a fixed prefix code that is short for common letters.
For each context in CONTEXTS (the last bytes, the last bytes of this word, all of this word so far) a predictor
keeps how often each symbol followed; so the counts of both outcomes of each bit are known. They are kept for every
context that occurs, by key (54 bits of a hash and the symbol), so that their number grows with the text and contexts do
not share a place. The predictors' logits are mixed by weights that a gate picks: by the place of the bit and by how
often the contexts within the word were seen. The mixed logit is refined by an adaptive map from (gate, logit) to what
came out.

Training is online: a task walks through its documents in steps; each step is predicted with what was learned from the
steps before it, then weights take a gradient step, the map and the counts are brought up to date. The first step, of FIRST
bytes, has nothing to be predicted from and only gives counts; then steps are as long as all before them, up to STEP, so that
a task of any size learns weights. Weights and maps of
all tasks are then added up, in a tree. What a task predicts from are the counts of LEARNED bytes at most, so that its time and
memory do not depend on how much text it was given. In a step, equal contexts with equal outcomes are worked out once; a step is
learned in slices.

Counts of all tasks meet by key: documents are read in chunks, and the keys of a chunk, each once and with its count in
training texts, are dealt into buckets of the hash. A bucket adds up the counts of all chunks and gives each chunk the
cells of its own keys, with which its texts are scored. Cells are worked out once for each key of a bucket, however many
chunks have it. The model is nowhere in one place.

The base score counts words instead: Laplace's estimate over the training documents' words. Words that occur most (HOT
at most, of HOT_BYTES at most) are looked up where texts are scored; all others are joined.

Defined results: null and empty texts have one token, the end. Null ids are scored and not learned from. Repeated rows
are documents of their own. Without training text all predictions are even. Other columns are not carried. An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import io
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _trim, discard, frugal, materialize
from .textvec import _SPACE, _power, chunks

#: Kinds of context: so many last bytes; so many last bytes of the word, in lower case; the word so far, in lower case.
CONTEXTS = (("bytes", 1), ("bytes", 3), ("word", 4), ("word", 6), ("word", 1 << 30))
_TAIL = 6  # last bytes kept of each place
#: Bytes of a chunk, of a step of training and of texts scored at once, and of the text whose keys one bucket of a
#: predictor takes.
CHUNK, STEP, BUCKET = 8_000_000, 2_500_000, 32_000_000
#: So many bits less say the bucket of a predictor whose contexts are fewer; eight buckets at least.
FEWER = (6, 2, 1, 0, 0)
#: Bytes of text whose counts a task has at once to predict from. Then it begins to count anew; weights and map go on.
LEARNED = 64_000_000
#: Buckets are dealt out, and chunks scored, in so many rounds: only the keys or texts of one round are in shuffle files.
ROUNDS = 4
#: Bytes of a task's first step.
FIRST = 8_192
#: Bytes worked on at once where it is bytes that are worked on, few enough to stay in a core's cache.
BLOCK = 1 << 17
#: Distinct symbols in contexts predicted at once, before what they teach is taken in.
SLICE = 32_768
#: Values told apart, and keys added up, at once, so that hash tables stay small.
SHARE = 1 << 18
#: The gate tells apart so many places of a bit in a code, and for each predictor that it watches, how often the slot
#: was seen: less often than these numbers.
PLACES, WATCHED = 8, (4, 2)
SEEN = (1, 2, 4, 16, 128, 2048)
GATES = PLACES * (len(SEEN) + 1) ** len(WATCHED)
PRIOR, RATE, BOUND = 0.4, 0.1, 11.0
#: Cells of the adaptive map for a gate; it learns in the nearest one, and logits in between are interpolated.
CELLS = 24
#: Logits of cells are kept as multiples of this.
UNIT = BOUND / 127
HOT, HOT_BYTES = 131_072, 64
#: Words counted in a task before they are handed on.
WORDS = 150_000
#: Partial models added up in one task.
FAN_IN = 32
_END = 256


#: Symbols in order of how common they are taken to be.
_COMMON = b" enrtiasohldcugmbpfv.z,w\xc3\nkyjqx\xa4\xb6\xbc\xa9\xb3SEDTALIONRHUCMGBPFVZWKYJQX0123456789"


def _code() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each symbol, by Huffman's rule for frequencies that fall with the place in _COMMON."""
    order = [*dict.fromkeys(_COMMON), *(x for x in range(256) if x not in _COMMON), _END]
    heap = [(0.9**k + 2e-5, k, [x]) for k, x in enumerate(order)]
    heapq.heapify(heap)
    bits, sizes = [0] * 257, [0] * 257
    while len(heap) > 1:
        (wa, _, a), (wb, k, b) = heapq.heappop(heap), heapq.heappop(heap)
        for own, bit in ((a, 0), (b, 1)):
            for x in own:
                bits[x] |= bit << sizes[x]
                sizes[x] += 1
        heapq.heappush(heap, (wa + wb, 1000 + k + len(heap), a + b))
    return np.array(bits, np.int64), np.array(sizes, np.int64)


_BITS, _SIZES = _code()
_DEPTH = int(_SIZES.max())


def _places() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in the order of their codes, the place of each in it, and for each symbol and bit the first place where
    that bit is one after the same bits. What shares the first bits stands together."""
    ends = _BITS << (_DEPTH - _SIZES)
    order = np.argsort(ends)
    place = np.empty(257, np.int64)
    place[order] = np.arange(257)
    middle = np.zeros((257, _DEPTH), np.uint64)
    for d in range(_DEPTH):
        own = _SIZES > d
        middle[own, d] = np.searchsorted(ends[order], (2 * (_BITS[own] >> _SIZES[own] - d) + 1) << (_DEPTH - d - 1))
    return order, place.astype(np.uint64), middle


_ORDER, _PLACE, _MIDDLE = _places()
#: Of each symbol and bit, whether it is one; and of the symbols of two places, at how many bits both are counted.
_BIT = np.arange(_DEPTH) < _SIZES[:, None]
_BIT &= (_BITS[:, None] >> np.maximum(_SIZES[:, None] - 1 - np.arange(_DEPTH), 0) & 1).astype(bool)


def _shared() -> np.ndarray:
    ends = (_BITS << (_DEPTH - _SIZES))[_ORDER]
    apart = ends[:, None] ^ ends
    same = _DEPTH - np.frexp(apart.astype(np.float64))[1]  # bits alike
    return np.minimum(same + 1, _SIZES[_ORDER][:, None]).astype(np.uint8)


_SHARED = _shared()
_LOW = np.uint64(511)  # bits of a key that have the place
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def _block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each symbol of the texts: a hash of the word so far, the bytes before it (the last one lowest; none before a
    text begins), how many of them belong to the word, and the symbol; and the hash of all that."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)  # an end is coded in place of the line end
    n = len(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = np.concatenate([[0], ends[:-1]])
    place = np.arange(n, dtype=np.int32)
    after = np.zeros(n, np.int32)  # where this symbol's word begins
    after[1:] = np.where(_SPACE[data[:-1]], place[1:], 0)
    after[begins] = begins
    after = np.maximum.accumulate(after)
    symbol = data.astype(np.uint16)
    symbol[ends - 1] = _END
    powers, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * powers[:n], out=sums[1:])
    word = (sums[:n] - sums[after]) * inverse[after]
    word ^= word >> np.uint64(32)
    word *= np.uint64(0x9E3779B97F4A7C15)
    before = np.zeros(n, np.uint64)
    wide = data.astype(np.uint64)
    for k in range(1, _TAIL + 1):
        before[k:] |= wide[:-k] << np.uint64(8 * (k - 1))
    for k in range(_TAIL):  # nothing before a text's first byte
        at = begins[begins + k < ends] + k
        before[at] &= np.uint64((1 << 8 * k) - 1)
    inside = np.minimum(place - after, _TAIL).astype(np.uint8)
    # all contexts follow from the word so far and the last few bytes
    joint = word ^ (word >> np.uint64(29))
    joint += ((before & np.uint64(0xFFFFFF)) << np.uint64(9) | symbol) * np.uint64(0xD6E8FEB86659FD93)
    joint ^= joint >> np.uint64(31)
    return word, before, inside, symbol, joint


def _keys(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each distinct pair of symbol and contexts: the symbol and the hashed contexts; which one each symbol of the
    texts is; and where texts begin."""
    parts, codes, n = [], [], 0
    for a, b in chunks(texts, BLOCK):  # of each block, what is distinct there
        columns = _block(texts[a:b])
        own, first = _firsts(columns[-1])
        parts.append([x[first] for x in columns])
        codes.append(own + np.int32(n))
        n += len(first)
    own, first = _firsts(np.concatenate([p.pop() for p in parts]))
    codes = own[np.concatenate(codes)]
    symbol, inside, before, word = (np.concatenate([p.pop() for p in parts])[first] for _ in range(4))  # each goes when it is joined
    lower = before | _capitals(before) >> np.uint64(1)
    contexts = []
    for k, (kind, size) in enumerate(CONTEXTS):
        if kind == "bytes":
            h = before & np.uint64((1 << 8 * size) - 1)
        elif size <= _TAIL:
            held = np.minimum(inside, size).astype(np.uint64)
            h = (lower & ((np.uint64(1) << (held * np.uint64(8))) - np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) + held
        else:
            h = word
        h = h ^ (h >> np.uint64(32))
        h = (h + np.uint64(2 * k + 1)) * np.uint64(0xD6E8FEB86659FD93)
        contexts.append(h ^ (h >> np.uint64(29)))
    return symbol, contexts, codes, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])


def _firsts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct value each is, in the order in which they are met; and where each is met first."""
    codes, firsts, n = np.empty(len(values), np.int32), [], 0
    for rows in _shares(values, 64):
        own = pa.array(values[rows]).dictionary_encode().indices.to_numpy()
        firsts.append(np.empty(own.max(initial=-1) + 1, np.int64))
        firsts[-1][own[::-1]] = rows[::-1]
        codes[rows] = own + np.int32(n)
        n += len(firsts[-1])
    first = np.sort(np.concatenate(firsts))
    turn = np.empty(n, np.int32)
    turn[codes[first]] = np.arange(n, dtype=np.int32)
    return turn[codes], first


def _shares(values: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Rows by the first bits of their values, which have so many bits: about SHARE rows at once, in the order of the values."""
    bits = max(0, math.ceil(math.log2(max(1, len(values)) / SHARE)))
    if not bits:
        yield np.arange(len(values))
        return
    of = (values >> np.uint64(width - bits)).astype(np.uint16)
    for k in range(1 << bits):
        yield np.flatnonzero(of == k)


def _capitals(x: np.ndarray) -> np.ndarray:
    """0x40 in each byte that is a letter from A to Z."""
    ones = np.uint64(0x0101010101010101)
    low = x & (ones * np.uint64(0x7F))
    over = (low + ones * np.uint64(0x80 - 65)) & ~(low + ones * np.uint64(0x80 - 91)) & ~x
    return (over >> np.uint64(1)) & (ones * np.uint64(0x40))


def _key(symbol: np.ndarray, context: np.ndarray) -> np.ndarray:
    return (context >> np.uint64(1)) & ~_LOW | _PLACE[symbol]


def _kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which one each is."""
    turn, out, n = np.empty(len(keys), np.int32), [], 0
    for rows in _shares(keys, 63):
        codes = pa.array(keys[rows]).dictionary_encode()
        own = codes.dictionary.to_numpy()
        by = np.argsort(own)
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(n, n + len(by), dtype=np.int32)
        turn[rows] = place[codes.indices.to_numpy()]
        out.append(own[by])
        n += len(by)
    return np.concatenate(out), turn


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct keys of sorted lists, which a stable sort merges."""
    keys = np.sort(np.concatenate(parts), kind="stable")
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[by], first) if len(first) else n


def _totals(lists: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of sorted lists, and the sums of their counts; worked out range by range of the keys."""
    n, longest = max(1, sum(map(len, lists)) // SHARE), max(lists, key=len)
    bounds = longest[np.arange(1, n) * len(longest) // n]
    cuts = [[0, *np.searchsorted(x, bounds).tolist(), len(x)] for x in lists]
    found = [_sum(*(np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(some, cuts, strict=True)]) for some in (lists, counts))) for k in range(n)]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _decisions(symbol: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the bit, rows that have it, and its outcome."""
    rows, bits, sizes = np.arange(len(symbol)), _BITS[symbol], _SIZES[symbol]
    for d in range(_DEPTH):
        if d:
            own = np.flatnonzero(sizes > d)
            rows, bits, sizes = rows[own], bits[own], sizes[own]
        if not len(rows):
            return
        yield d, rows, (bits >> sizes - d - 1 & 1).astype(bool)


def _halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and how often each occurred."""
    return counts[0], counts[1].view(np.int64)


def _cell(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What cells are worked out from: sorted keys and sums of their counts, which start at 0."""
    return keys, np.concatenate([[0], np.cumsum(n)])


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the cells of each key begin; and their number."""
    return np.concatenate([[0], np.cumsum(_SIZES[_ORDER[(keys & _LOW).astype(np.int64)]])])


def _cells(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> np.ndarray:
    """For each bit of the symbols of sorted keys: the logit in its context in units, times 8, and the level."""
    return np.concatenate([np.zeros(0, np.int16), *(_slice_cells(table, asked[at : at + SLICE]) for at in range(0, len(asked), SLICE))])


def _slice_cells(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> np.ndarray:
    keys, sums = table
    start = _starts(asked)
    out = np.zeros(start[-1], np.int16)  # of what did not occur the logit is 0
    if not len(keys):
        return out
    context = asked & ~_LOW
    low = np.searchsorted(keys, context)
    at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] - context <= _LOW)  # the others' contexts did not occur
    low, context = low[at], context[at]
    end = context + _LOW
    single = keys[np.minimum(low + 1, len(keys) - 1)] - context > _LOW
    single |= low + 1 == len(keys)
    # one symbol only followed: its count stands at each bit up to where the codes part
    w = np.flatnonzero(single)
    own, found = asked[at[w]] & _LOW, keys[low[w]] & _LOW
    size = _SHARED[own, found].astype(np.int64)
    ends = np.cumsum(size)
    step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    n = sums[low[w] + 1] - sums[low[w]]
    one = _BIT.ravel()[np.repeat(_ORDER[found.astype(np.int64)] * _DEPTH, size) + step]
    out[np.repeat(start[at[w]], size) + step] = np.where(one, np.repeat(_value(n, np.zeros_like(n)), size), np.repeat(_value(np.zeros_like(n), n), size))
    w = np.flatnonzero(~single)
    at, low, context, high = at[w], low[w], context[w], np.searchsorted(keys, end[w], side="right")
    symbol = _ORDER[(asked[at] & _LOW).astype(np.int64)]
    for d in range(_DEPTH):
        if not len(at):
            break
        middle = np.searchsorted(keys, context + _MIDDLE[symbol, d])
        below, middle_sum, above = sums[low], sums[middle], sums[high]
        out[start[at] + d] = _value(above - middle_sum, middle_sum - below)
        one = _BIT[symbol, d]
        low, high = np.where(one, middle, low), np.where(one, high, middle)
        on = np.flatnonzero((high > low) & (_SIZES[symbol] > d + 1))
        at, low, high, context, symbol = at[on], low[on], high[on], context[on], symbol[on]
    return out


def _worked_out(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    units = np.rint(np.clip(_logit(ones, zeros), -BOUND, BOUND) / UNIT).astype(np.int16)
    return units * np.int16(8) + _level(ones + zeros).astype(np.int16)


def _value(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What a cell of these counts holds; for small ones it is looked up."""
    out = _VALUES[np.minimum(ones, 63) << 6 | np.minimum(zeros, 63)]
    large = np.flatnonzero((ones | zeros) > 63)
    out[large] = _worked_out(ones[large], zeros[large])
    return out


def _logit(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


_LEVELS = np.searchsorted(SEEN, np.arange(SEEN[-1] + 1), side="right").astype(np.int64)


def _level(n: np.ndarray) -> np.ndarray:
    return _LEVELS[np.minimum(n, SEEN[-1])]


_VALUES = _worked_out(np.arange(64 * 64) >> 6, np.arange(64 * 64) & 63)


def _mixed(d: int, logits: list[np.ndarray], levels: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gate and mixed logit of each row. levels: of the watched predictors."""
    gate = np.full(len(logits[0]), d, np.int64)
    for x in levels:
        gate = gate * (len(SEEN) + 1) + x
    total = weights[:, -1].astype(np.float32)[gate]
    for k, x in enumerate(logits):
        total += weights[:, k].astype(np.float32)[gate] * x
    return gate, np.clip(total, -BOUND, BOUND)


def _between(gate: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower of the two cells a logit lies between, and its share in the upper one."""
    x = (logit + BOUND) * ((CELLS - 1) / (2 * BOUND))
    low = np.minimum(x.astype(np.int64), CELLS - 2)
    return gate * CELLS + low, x - low


def _start() -> tuple[np.ndarray, np.ndarray]:
    """Weights, and the map's counts of (one, all), which begin as the identity."""
    weights = np.full((GATES, len(CONTEXTS) + 1), 0.45)
    weights[:, -1] = 0
    centre = np.linspace(-BOUND, BOUND, CELLS)
    return weights, np.tile(np.stack([_squash(centre), np.ones(CELLS)]), (1, GATES)).reshape(2, GATES * CELLS)


class Trainer:
    """What one task learns."""

    def __init__(self):
        # for each predictor sorted keys, and the count of each
        self.counts = [np.zeros((2, 0), np.uint64) for _ in CONTEXTS]
        self.weights, self.map = _start()
        self.seen = np.zeros(GATES)
        self.bytes = 0

    def step(self, texts: list[bytes]) -> None:
        symbol, contexts, codes, _ = _keys(texts)
        self.learn(symbol, [_kinds(_key(symbol, c)) for c in contexts], np.bincount(codes, minlength=len(symbol)))

    def learn(self, symbol: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]], times: np.ndarray) -> list[np.ndarray]:
        """kinds: of each predictor the keys and which one each row has; rows of no times teach nothing. Returns how often
        each key occurred."""
        cells = [_cells(_cell(*_halves(c)), own) for c, (own, _) in zip(self.counts, kinds, strict=True)]
        starts = [_starts(own) for own, _ in kinds]
        rows = np.flatnonzero(times) if len(self.counts[0][0]) else np.zeros(0, np.int64)
        self.bytes += int(times.sum())
        n = -(-len(rows) // SLICE)
        for at in range(n):  # each slice a cross-section: what comes first in a text is more common than what comes last
            w = rows[at::n]
            self._learn(symbol[w], cells, [s[kind[w]] for s, (_, kind) in zip(starts, kinds, strict=True)], times[w])
        # counts last: within a step rare symbols come after the common ones of their context, and are not to see them
        counted = [np.bincount(kind, times, len(own)).astype(np.int64) for own, kind in kinds]
        for k, (n, (own, _)) in enumerate(zip(counted, kinds, strict=True)):
            keys, old = _halves(self.counts[k])
            own, n = own[n > 0], n[n > 0]
            at = np.searchsorted(keys, own)
            known = np.append(keys, ~np.uint64(0))[at] == own
            old[at[known]] += n[known]
            place = at[~known] + np.arange(np.count_nonzero(~known))  # of what is new
            grown = np.empty((2, len(keys) + len(place)), np.uint64)
            rest = np.ones(grown.shape[1], bool)
            rest[place] = False
            grown[:, place] = own[~known], n[~known].view(np.uint64)
            grown[:, rest] = self.counts[k]
            self.counts[k] = grown
        return counted

    def _learn(self, symbol: np.ndarray, cells: list[np.ndarray], starts: list[np.ndarray], times: np.ndarray) -> None:
        for d, rows, outcome in _decisions(symbol):
            n = times[rows].astype(np.float64)
            own = [c[s[rows] + d] for c, s in zip(cells, starts, strict=True)]
            logits = [(c >> 3) * np.float32(UNIT) for c in own]
            gate, mixed = _mixed(min(d, PLACES - 1), logits, [own[k] & 7 for k in WATCHED], self.weights)
            p = _squash(mixed)
            error, curve = n * (outcome - p), n * p * (1 - p)
            for k, x in enumerate([*logits, np.ones(len(rows), np.float32)]):
                self.weights[:, k] += RATE * np.bincount(gate, error * x, GATES) / (np.bincount(gate, curve * x**2, GATES) + 100)
            np.clip(self.weights, -2, 3, out=self.weights)
            self.seen += np.bincount(gate, n, GATES)
            low, share = _between(gate, mixed)
            cell = low + (share > 0.5)
            self.map[0] += np.bincount(cell, n * outcome, GATES * CELLS)
            self.map[1] += np.bincount(cell, n, GATES * CELLS)

    def forget(self) -> None:
        """Begins to count anew."""
        self.counts = [np.zeros((2, 0), np.uint64) for _ in CONTEXTS]
        self.bytes = 0

    def part(self) -> bytes:
        """The weights, times what they have seen, and the map."""
        return _pack(weights=self.weights * self.seen[:, None], seen=self.seen, map=self.map - _start()[1])


def _pack(**arrays: np.ndarray) -> bytes:
    import zstandard

    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(body: bytes) -> dict[str, np.ndarray]:
    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(body))) as found:
        return {k: found[k] for k in found.files}


def _planes(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes())


def _numbers(body: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _add(group: pa.Table) -> pa.Table:
    """Adds up partial weights and maps."""
    total: dict[str, np.ndarray] = {}
    for body in group.column("body"):
        total = {k: v + total.get(k, 0) for k, v in _unpack(body.as_py()).items()}
    return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int64()), "body": pa.array([_pack(**total)], pa.binary())})


@dataclass
class Model:
    """tables: of each predictor, keys and sums of counts; weights; refined: the map's logits. Without tables, cells are
    given by who asks."""

    tables: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    refined: np.ndarray

    def costs(self, symbol: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Bits that coding each symbol in its contexts takes."""
        kinds = [_kinds(_key(symbol, c)) for c in contexts]
        return self.coded(symbol, [_cells(t, own) for t, (own, _) in zip(self.tables, kinds, strict=True)], [_starts(own)[kind] for own, kind in kinds])

    def coded(self, symbol: np.ndarray, cells: list[np.ndarray], starts: list[np.ndarray]) -> np.ndarray:
        """starts: where in a predictor's cells those of each symbol begin."""
        out = np.zeros(len(symbol))
        for at in range(0, len(symbol), SLICE):
            w = slice(at, at + SLICE)
            for d, rows, outcome in _decisions(symbol[w]):
                own = [c[s[at + rows] + d] for c, s in zip(cells, starts, strict=True)]
                logits = [(c >> 3) * np.float32(UNIT) for c in own]
                gate, mixed = _mixed(min(d, PLACES - 1), logits, [own[k] & 7 for k in WATCHED], self.weights)
                low, share = _between(gate, mixed)
                final = 0.5 * mixed + 0.5 * (self.refined[low] * (1 - share) + self.refined[low + 1] * share)
                out[at + rows] += np.logaddexp(0, np.where(outcome, -final, final)) / math.log(2)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits that coding each text and its end takes."""
        symbol, contexts, codes, begins = _keys(texts)
        return np.add.reduceat(self.costs(symbol, contexts)[codes], begins)


def _model(trained: DataFrame, n_parts: int) -> Model:
    """Adds up partial weights and maps, FAN_IN at a time; what comes to the driver has a fixed size."""
    own = trained
    while True:
        own = own.groupBy(F.floor(F.col("part") / FAN_IN).alias("of")).applyInArrow(_add, "part long, body binary")
        n_parts = -(-n_parts // FAN_IN)
        if n_parts <= 1:
            break
    weights, counts = _start()
    for row in own.select("body").collect():
        part = _unpack(bytes(row["body"]))
        some = part["seen"] > 0
        weights[some] = part["weights"][some] / part["seen"][some, None]
        counts = counts + part["map"]
    refined = np.log((counts[0] + 1e-4) / (counts[1] - counts[0] + 1e-4))
    return Model([], weights, np.clip(refined, -BOUND, BOUND))


def _chunks(docs: DataFrame, learn, id_col: str, text_col: str) -> DataFrame:
    """chunk, size (in bytes of text), body: a record batch of id, held_out and text as bytes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([size], pa.int64()), pa.array([_write(held)], pa.binary())], names=["chunk", "size", "body"])

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                upto = max(at + (not held), int(np.searchsorted(ends, before + CHUNK - size, side="right")))
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    size += int(ends[upto - 1] - before)
                if upto < batch.num_rows:
                    yield row()
                    number, held, size = number + 1, [], 0
                at = upto
        if held:
            yield row()

    rows = docs.select(F.col(id_col).alias("id"), (~F.coalesce(learn(F.col(id_col)), F.lit(False))).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(frugal("lm_scoring", gather), "chunk long, size long, body binary"), "chunks", compression="uncompressed")


def _write(batches: list[pa.RecordBatch]) -> bytes:
    sink, batch = io.BytesIO(), pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def _read(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def _growing(texts: list[bytes], trainer: Trainer) -> Iterator[tuple[int, int]]:
    """Steps of training: each as long as what the trainer has learned from so far."""
    at = 0
    while at < len(texts):
        if trainer.bytes >= LEARNED:
            trainer.forget()
        most, upto, size = min(STEP, max(FIRST, trainer.bytes)), at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) <= most:
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def _steps(texts: list[bytes], trainer: Trainer | None = None) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]]:
    """First and last text of a step, symbols, each predictor's keys and which one a symbol has, and what else _keys gives."""
    for a, b in chunks(texts, STEP) if trainer is None else _growing(texts, trainer):
        yield a, b, *_step(texts[a:b])  # nothing of it stays here


def _step(texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    symbol, contexts, codes, begins = _keys(texts)
    return symbol, [_kinds(_key(symbol, contexts.pop(0))) for _ in CONTEXTS], codes, begins


def train(docs: DataFrame, id_col: str, text_col: str, learn) -> tuple[Model, DataFrame, DataFrame]:
    """The model without its counts; a table of words: token (null: the end) and n, how often it occurs in training texts;
    and chunks with a list of bucket and cells."""
    found = _chunks(docs, learn, id_col, text_col)
    size = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tops = [max(3, math.ceil(math.log2(max(1, size) / BUCKET)) - less) for less in FEWER]  # bits of a key that say its bucket

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trainer, words, ends = TaskContext.get().partitionId(), Trainer(), Counter(), 0
        names = {"part": pa.int64(), "bucket": pa.int32(), "chunk": pa.int64(), "body": pa.binary(), "count": pa.binary(), "token": pa.binary(), "n": pa.int64()}

        def rows(size: int, **columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in names.items()], names=list(names))

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs = _read(body.as_py())
                texts, learned = docs.column(2).to_pylist(), ~docs.column(1).to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(learned).tolist():
                    words.update(texts[k].lower().split())
                    if len(words) > WORDS:
                        yield rows(len(words), token=list(words.keys()), n=list(words.values()))
                        words.clear()
                ends += int(learned.sum())
                asked: list[list] = [[] for _ in CONTEXTS]
                for a, b, symbol, kinds, codes, _ in _steps(texts, trainer):
                    own = np.repeat(learned[a:b], [len(t) + 1 for t in texts[a:b]])
                    counted = trainer.learn(symbol, kinds, np.bincount(codes[own], minlength=len(symbol)))
                    for k, (keys, _) in enumerate(kinds):
                        asked[k].append((keys, counted[k]))
                    del symbol, kinds, codes, own, counted, keys
                    _trim()
                for k in range(len(CONTEXTS)):
                    some, asked[k] = asked[k], []
                    keys, n = _totals([x for x, _ in some], [x for _, x in some])
                    del some
                    of = (keys >> np.uint64(63 - tops[k])).astype(np.int64)
                    for w in np.split(np.arange(len(keys)), np.flatnonzero(of[1:] != of[:-1]) + 1):
                        yield rows(1, bucket=[k << 24 | int(of[w[0]])], chunk=[name], body=[_planes(np.diff(keys[w], prepend=np.uint64(0)))], count=[_planes(n[w])])
        if words:
            yield rows(len(words), token=list(words.keys()), n=list(words.values()))
        if ends:
            yield rows(1, n=[ends])
            yield rows(1, part=[part], body=[trainer.part()])

    learned = found.select("chunk", "body").mapInArrow(frugal("lm_scoring", read), "part long, bucket int, chunk long, body binary, count binary, token binary, n long")
    learned = materialize(learned.withColumn("turn", F.coalesce(F.col("bucket") % ROUNDS, F.lit(-1))), "learned", compression="zstd", by=("turn", ROUNDS + 1))
    others = learned.where("turn = -1")
    n_parts = (others.agg(F.max("part")).first()[0] or 0) + 1
    model = _model(others.where("part IS NOT NULL").select("part", "body"), n_parts)
    words = others.where("n IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    words = materialize(words, "words", compression="zstd")
    discard(learned, "turn=-1")
    answered = []
    for k in range(ROUNDS):
        some = learned.where(F.col("turn") == k).select("bucket", "chunk", "body", "count").groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, cells binary")
        # a table, so that what was learned, and dealt to buckets, is gone before cells are dealt to chunks
        answered.append(materialize(some, "cells", compression="uncompressed"))
        discard(learned, f"turn={k}")
    discard(learned)
    cells = reduce(DataFrame.unionAll, answered)
    cells = cells.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "cells")).alias("cells"))
    return model, words, found.join(cells, "chunk").select("chunk", "body", "cells")


def _answer(group: pa.Table) -> pa.Table:
    """Adds up the counts of a bucket's keys, and gives each chunk the cells of its own."""
    asked = [np.cumsum(_numbers(x.as_py(), np.uint64), dtype=np.uint64) for x in group.column("body")]
    keys, n = _totals(asked, [_numbers(x.as_py(), np.int64) for x in group.column("count")])
    cells, starts = _cells(_cell(keys[n > 0], n[n > 0]), keys), _starts(keys)
    del n
    return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "cells": pa.array([_planes(_picked(cells, starts, np.searchsorted(keys, x))) for x in asked], pa.binary())})


def _picked(cells: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The cells of some keys, one after the other. starts: where those of each key begin; and their number."""
    sizes = starts[which + 1] - starts[which]
    ends = np.cumsum(sizes)
    return cells[np.repeat(starts[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _bits(model: Model, texts: list[bytes], answers: list[dict]) -> np.ndarray:
    """Bits of a chunk's texts. answers: the cells of its keys by bucket; buckets are in the order of the keys."""
    parts = [[] for _ in CONTEXTS]
    for x in sorted(answers, key=lambda x: x["bucket"]):
        parts[x["bucket"] >> 24].append(_numbers(x["cells"], np.int16))
    del answers, x
    cells = [np.concatenate(parts.pop(0)) for _ in CONTEXTS]
    steps = []
    for step in _steps(texts):
        steps.append(step)
        _trim()
    for k in range(len(CONTEXTS)):  # of a key, where its cells begin is all that is kept
        all_ = _merged([kinds[k][0] for _, _, _, kinds, _, _ in steps])
        starts = _starts(all_)
        for _, _, _, kinds, _, _ in steps:
            kinds[k] = starts[np.searchsorted(all_, kinds[k][0])], kinds[k][1]
    del all_, starts
    out = []
    while steps:
        _, _, symbol, kinds, codes, begins = steps.pop(0)
        costs = [model.coded(symbol[w], cells, [s[kind[w]] for s, kind in kinds]) for w in (slice(at, at + 8 * SLICE) for at in range(0, len(symbol), 8 * SLICE))]
        out.append(np.add.reduceat(np.concatenate(costs)[codes], begins))
    return np.concatenate(out)


def score(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability of the text) and
    bits_per_byte of each document. learn: a condition on the id; texts are learned from only where it holds."""
    model, words, chunked = train(docs, id_col, text_col, learn)
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    whole = math.log10(total + kinds + 1)
    hot = {bytes(r[0]) if r[0] is not None else None: r[1] for r in words.where(F.coalesce(F.octet_length("token"), F.lit(0)) <= HOT_BYTES).orderBy(F.desc("n"), "token").limit(HOT).collect()}
    # the end is looked up as well
    ends = words.where("token IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = docs.sparkSession.sparkContext.broadcast((model, {k: (n, math.log10(n + 1)) for k, n in hot.items() if k is not None}))  # sizes fixed by HOT and GATES
    end_score = math.log10(ends + 1) - whole

    def read(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, known = held.value
        base = turn << 58 | TaskContext.get().partitionId() << 36
        row = 0
        for batch in batches:
            for at in range(batch.num_rows):
                ids = _read(batch.column(0)[at].as_py())
                some = ids.column(2).to_pylist()
                n_tokens, n_known, base_score, cold_row, cold_token, cold_n = [], [], [], [], [], []
                for k, text in enumerate(some):
                    own = text.lower().split()
                    sure, sums = int(ends > 0), end_score - len(own) * whole
                    for token, n in Counter(own).items():
                        if (x := known.get(token)) is not None:
                            sure += n
                            sums += n * x[1]
                        else:
                            cold_row.append(base + row + k)
                            cold_token.append(token)
                            cold_n.append(n)
                    n_tokens.append(len(own) + 1)
                    n_known.append(sure)
                    base_score.append(sums)
                bits = _bits(mix, some, batch.column(1)[at].as_py())
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(base + row, base + row + k)), ids.column(0), ids.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base_score, pa.float64()), pa.array(bits), pa.array([len(t) for t in some], pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=names
                )
                c = len(cold_row)
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(cold_row, pa.int64()), pa.nulls(c, ids.column(0).type), pa.nulls(c, pa.bool_()), pa.nulls(c, pa.int64()), pa.nulls(c, pa.int64()), pa.nulls(c, pa.float64()), pa.nulls(c, pa.float64()), pa.nulls(c, pa.int64()), pa.array(cold_token, pa.binary()), pa.array(cold_n, pa.int64())], names=names)
                row += k

    names = ["uid", "id", "held_out", "n_tokens", "n_known", "base_score", "bits", "n_bytes", "token", "n"]
    kind = docs.schema[id_col].dataType.simpleString()
    names_and_types = f"uid long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, bits double, n_bytes long, token binary, n long"
    done = []
    for k in range(ROUNDS):
        some = chunked.where(F.pmod(F.hash("chunk"), F.lit(ROUNDS)) == k).select("body", "cells")
        done.append(materialize(some.mapInArrow(frugal("lm_scoring", partial(read, k)), names_and_types), "scored", compression="zstd"))
    done = reduce(DataFrame.unionAll, done)
    discard(chunked)
    cold = done.where("token IS NOT NULL").select("uid", "token", "n").join(words.where("token IS NOT NULL").select("token", F.col("n").alias("c")), "token")
    late = cold.groupBy("uid").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_score"))
    out = done.where("token IS NULL").join(late, "uid", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_score", F.lit(0.0))).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        F.try_divide(F.col("bits"), F.col("n_bytes")).alias("bits_per_byte"),
    )
