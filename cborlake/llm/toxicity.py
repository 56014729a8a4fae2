"""Toxicity by a subsequence string kernel over sentences, Nystroem landmarks and a support vector machine.

A sentence is a run of words up to a line end, or to a full stop, question or exclamation mark before white space. Letters
are lower-cased, marks inside words fall away, letters standing apart in a row are one word. A sentence is read in
windows of WORDS words, each beginning STRIDE words after the one before, so that any STRIDE + 1 neighbouring words
share a window; a word of more than UNIT letters counts as several. The kernel of two windows is the sum, over
subsequences of 4 and 5 characters (spaces between words are characters, so phrases have subsequences of their own)
that occur in both with up to GAP characters between, of the products of their weights, DECAY to the power of the
characters spanned; each window is scaled by the root of its squared weights. A word or phrase with inserted or missing
characters thus keeps most of its likeness.

Learning, from labelled sentences: labels belong to documents, so that a toxic document says that one of its windows is
toxic, and a clean one that none is. At first the window of each toxic document whose subsequences are over-represented
in toxic documents stands for it; an SVM is fitted on these windows and the worst ones of clean documents; then the
windows that this SVM finds the worst take their places, and so on for ROUNDS rounds. Examples are learned from a second
time with inserted letters. Toxic documents none of whose
windows is worse than the worst of most clean ones are passed over; of others up to WITNESSES windows may count. LANDMARKS of the examples are the landmarks; the SVM
(squared hinge) is linear in the Nystroem features, so that its decision is a weighted sum over landmarks, and thus
over subsequences: one table of weights gives all margins by look-ups. A document's margin is that of its worst window; a
logistic curve gives scores; it is laid through the margins of one in FOLDS documents, by a fit without their windows.

Labelled documents used to fit are bounded by SAMPLE, chosen by the hash of their ids, and so are the clean windows taken
from them (HARD a round); the fit runs in one task and what comes to the driver has a fixed size. Scoring reads whole texts.

Defined results: null and empty texts have the least margin. Labels that are null or not 0 or 1 are ignored, of several
labels of an id the largest counts. Without toxic examples every score is 0. Null ids are scored and never learned
from; of rows that repeat an id one is learned from; repeated rows stay. Other columns are not carried by ``classify``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize

SAMPLE = 16_000
DECAY, GAP = 0.6, 1
#: Words of a window, words between the beginnings of two, letters of a word.
WORDS, STRIDE, UNIT = 4, 2, 24
LANDMARKS, HARD, ROUNDS = 1_000, 2_000, 3
#: What an example on the wrong side of its margin costs the SVM.
COST = 1.0
#: Margin of a window that has nothing in common with any example: that of a clean one.
BIAS = -1.0
#: Windows of a toxic document that may be examples.
WITNESSES = 3
#: One in so many labelled documents is kept out of a second fit, for the curve.
FOLDS = 4
#: Slots of the table of weights; a subsequence's slot is a hash of its characters.
SLOTS = 1 << 20
#: Subsequences counted in a task leave it in so many pieces.
PIECES = 64
#: Standard deviations by which a subsequence has to be over-represented to say where to look first.
CLEAR = 3.0
#: Margins beyond these count as these.
LOWEST, HIGHEST = -3.0, 3.0
#: Characters of texts that are read at once.
CHUNK = 1 << 18
_PATTERNS = [(0, *inner, span - 1) for n in (4, 5) for span in range(n, n + GAP + 1) for inner in combinations(range(1, span - 1), n - 2)]
_REACH = max(p[-1] for p in _PATTERNS) + 1
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1) for k in range(5)]
#: Squared weights of the subsequences that begin where so many characters are left.
_POWER = np.array([sum(DECAY ** (2 * p[-1] + 2) for p in _PATTERNS if p[-1] < left) for left in range(_REACH + 1)])
_SPACE, _LETTER, _END, _MARK = range(4)


@lru_cache
def _kinds() -> np.ndarray:
    """Kind of each character of the first plane; the others are letters."""
    kind = np.full(1 << 16, _MARK, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        if c.isalnum():
            kind[k] = _LETTER
        elif c.isspace():
            kind[k] = _SPACE
    kind[[ord(c) for c in ".!?"]] = _END
    return kind


@dataclass
class Windows:
    """symbols: words, a space before each and after a sentence; left: characters to the end of the sentence from each;
    start, end: windows; text: which text each window is of."""

    symbols: np.ndarray
    left: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def examples(self, at: np.ndarray) -> list[tuple[str, int]]:
        """Characters of windows, with those after it that its last subsequences reach, and how many are its own."""
        out = []
        for k in at.tolist():
            a, b = int(self.start[k]), int(self.end[k])
            upto = min(b + _REACH - 1, b - 1 + int(self.left[b - 1]))
            out.append((self.symbols[a:upto].astype("<u4").tobytes().decode("utf-32-le", "replace"), b - a))
        return out


def windows(texts: list[str]) -> Windows:
    lower = [t.lower() for t in texts]
    code = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in lower])
    kind = np.where(code < 1 << 16, _kinds()[np.minimum(code, (1 << 16) - 1)], np.uint8(_LETTER))
    space = kind == _SPACE
    stop = code == 10
    stop[:-1] |= (kind[:-1] == _END) & space[1:]
    at = np.flatnonzero(kind == _LETTER)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Windows(none, none, none, none, none)
    gap, sentence = np.cumsum(space)[at], np.cumsum(stop)[at]
    fresh = np.concatenate([[True], gap[1:] != gap[:-1]])
    word = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    # letters standing apart: from the second of a run of three on they go on with the word before
    of = sentence[first]
    single = np.diff(np.append(first, len(at))) == 1
    tied = np.concatenate([[False], single[1:] & single[:-1] & (of[1:] == of[:-1])])
    begins = np.flatnonzero(~tied)
    size = np.diff(np.append(begins, len(tied)))
    joined = tied & np.repeat(size > 2, size)
    word = (np.cumsum(~joined) - 1)[word]
    first = first[~joined]
    of = sentence[first]
    opens = np.concatenate([[True], of[1:] != of[:-1]])
    order = np.cumsum(opens) - 1  # of each word's sentence
    place = np.arange(len(at)) + word + 1 + order[word]
    symbols = np.full(len(at) + len(first) + order[-1] + 1, 32, np.uint32)
    symbols[place] = code[at]
    head = place[first] - 1  # the space before each word
    bounds = np.append(head[opens], len(symbols))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(symbols))
    # units: words, or pieces of long ones
    inner = np.arange(len(at)) - first[word]
    cut = np.flatnonzero((inner > 0) & (inner % UNIT == 0))
    unit = np.sort(np.concatenate([head, place[cut]]))
    mine = np.searchsorted(bounds, unit, side="right") - 1  # sentence of each unit
    count = np.bincount(mine, minlength=len(bounds) - 1)
    base = np.cumsum(count) - count
    n = np.maximum(1, -(-(count - WORDS) // STRIDE) + 1)
    which = np.repeat(np.arange(len(count)), n)
    turn = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    start = unit[base[which] + turn]
    last = turn + WORDS >= count[which]
    end = np.where(last, bounds[which + 1], unit[np.minimum(base[which] + turn + WORDS, len(unit) - 1)])
    text = np.searchsorted(ends, at[first[opens]], side="right")
    return Windows(symbols, left, start, end, text[which])


def _slots(symbols: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, float]]:
    """Of each pattern: where it fits, the slots of what stands there, and its weight."""
    wide = symbols.astype(np.uint64)
    parts = [wide * f for f in _FACTORS]
    n = len(wide)
    for pattern in _PATTERNS:
        reach = pattern[-1]
        if n <= reach:
            continue
        code = np.full(n - reach, np.uint64(len(pattern)), np.uint64)
        for part, step in zip(parts, pattern, strict=False):
            code += part[step : n - reach + step]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        yield left[: n - reach] > reach, (code >> np.uint64(44)).astype(np.int64), DECAY ** (reach + 1)


def _power(left: np.ndarray) -> np.ndarray:
    return _POWER[np.minimum(left, _REACH)]


def occurrences(examples: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all subsequences: example, slot and weight; weights are scaled by example."""
    texts = [t for t, _ in examples]
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[of] - at
    own = at < np.array([n for _, n in examples], np.int64)[of]
    scale = np.sqrt(np.maximum(np.bincount(of[own], _power(left[own]), len(texts)), 1e-12))
    row, slot, weight = [], [], []
    for fits, slots, w in _slots(symbols, left):
        k = np.flatnonzero(fits & own[: len(fits)])
        row.append(of[k].astype(np.int32))
        slot.append(slots[k].astype(np.int32))
        weight.append((w / scale[of[k]]).astype(np.float32))
    if not row:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(row), np.concatenate(slot), np.concatenate(weight)


def kernel(a: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, b: tuple[np.ndarray, np.ndarray, np.ndarray], m: int, often: int = 8, block: int = 1024, strip: int = 4096) -> np.ndarray:
    """The kernel of n examples with m others, both as occurrences. Slots that many of the others have are multiplied as
    blocks of a matrix, the rest one by one."""
    times = np.bincount(b[1], minlength=SLOTS)
    out = np.zeros((n, m), np.float32)
    common = np.flatnonzero(times > often)
    name = np.full(SLOTS, -1, np.int32)
    name[common] = np.arange(len(common))
    dense = []
    for row, slot, weight in (a, b):
        k = name[slot]
        at = np.flatnonzero(k >= 0)
        by = at[np.argsort(k[at], kind="stable")]
        dense.append((row[by], k[by], weight[by]))
    for low in range(0, len(common), block):
        row, k, weight = dense[1]
        w = slice(*np.searchsorted(k, [low, low + block]))
        right = np.zeros((m, block), np.float32)
        np.add.at(right, (row[w], k[w] - low), weight[w])
        row, k, weight = dense[0]
        w = slice(*np.searchsorted(k, [low, low + block]))
        by = np.argsort(row[w], kind="stable")
        row, k, weight = row[w][by], k[w][by] - low, weight[w][by]
        for at in range(0, n, strip):  # so many examples at once, as a row of the matrix is long
            v = slice(*np.searchsorted(row, [at, at + strip]))
            left = np.zeros((min(strip, n - at), block), np.float32)
            np.add.at(left, (row[v] - at, k[v]), weight[v])
            out[at : at + strip] += left @ right.T
    del dense
    rare = (times > 0) & (times <= often)
    own = np.flatnonzero(rare[b[1]])
    by = own[np.argsort(b[1][own], kind="stable")]
    first = np.cumsum(np.where(rare, times, 0)) - np.where(rare, times, 0)
    asked = np.flatnonzero(rare[a[1]])
    for low in range(0, len(asked), 500_000):
        k = asked[low : low + 500_000]
        n_k = times[a[1][k]]
        other = by[np.repeat(first[a[1][k]] - (np.cumsum(n_k) - n_k), n_k) + np.arange(n_k.sum())]
        k = np.repeat(k, n_k)
        np.add.at(out, (a[0][k], b[0][other]), a[2][k] * b[2][other])
    return out


def nystroem(gram: np.ndarray) -> np.ndarray:
    """A root of the inverse of the landmarks' kernel: kernels with the landmarks times it are the features."""
    values, vectors = np.linalg.eigh((gram + gram.T).astype(np.float64) / 2)
    ok = values > 1e-5 * values.max()
    return vectors[:, ok] / np.sqrt(values[ok])


def _squared_hinge(z: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = 25) -> np.ndarray:
    """Weights of a linear SVM, by Newton's method on the squared hinge; its bias is BIAS."""
    z, y = z.astype(np.float32), y.astype(np.float32)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        m = y * (z @ w.astype(np.float32) + np.float32(BIAS))
        live = np.flatnonzero(m < 1)
        hessian, grad = np.eye(len(w)), w.copy()
        for at in range(0, len(live), 4096):
            k = live[at : at + 4096]
            hessian += cost * (z[k].T @ z[k])
            grad -= cost * (z[k].T @ (y[k] * (1 - m[k])))
        move = np.linalg.solve(hessian, grad)
        w = w - move
        if np.abs(move).max() < 1e-4:
            break
    return w


def disturbed(example: tuple[str, int]) -> tuple[str, int]:
    """The window with a letter inserted in each word of five letters or more; where and which follows from the word."""
    text, own = example
    words, at, grown = text.split(" "), 0, 0
    for k, word in enumerate(words):
        if len(word) >= 5:
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            cut = 1 + h % (len(word) - 1)
            words[k] = word[:cut] + chr(97 + (h >> 16) % 26) + word[cut:]
            grown += at + cut < own
        at += len(word) + 1
    return " ".join(words), own + grown


def fit(bad: list[tuple[str, int]], good: list[tuple[str, int]]) -> np.ndarray:
    """The table of weights, of windows that stand for toxic documents and of clean ones, each kind with those
    that matter most first. The toxic ones, and as many clean ones, are examples in disturbed form, too."""
    half = LANDMARKS // 2
    extra = [[disturbed(x) for x in side[: max(HARD, len(bad))]] for side in (bad, good)]
    some = np.concatenate([np.arange(min(len(bad), max(half, LANDMARKS - len(good)))), len(bad) + np.arange(min(len(good), max(half, LANDMARKS - len(bad))))])
    row, slot, weight = occurrences([*bad, *good, *extra[0], *extra[1]])
    name = np.full(len(bad) + len(good) + len(extra[0]) + len(extra[1]), -1, np.int32)
    name[some] = np.arange(len(some))
    at = np.flatnonzero(name[row] >= 0)
    marks = name[row[at]], slot[at], weight[at]
    likeness = kernel((row, slot, weight), len(name), marks, len(some))
    del row, slot, weight
    root = nystroem(likeness[some])
    y = np.concatenate([sign * np.ones(len(side)) for sign, side in ((1, bad), (-1, good), (1, extra[0]), (-1, extra[1]))])
    features = likeness @ root.astype(np.float32)
    del likeness
    shares = root @ _squared_hinge(features, y)
    return np.bincount(marks[1], marks[2] * shares[marks[0]], SLOTS).astype(np.float32)


@dataclass
class Model:
    """table: weight of each slot; bias; slope and offset of the curve from margins to scores."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, w: Windows) -> np.ndarray:
        """Of each window."""
        total = np.zeros(len(w.symbols) + 1)
        for fits, slots, weight in _slots(w.symbols, w.left):
            total[1 : len(fits) + 1] += (self.table[slots] * np.float32(weight)) * fits
        total = np.cumsum(total)
        power = np.concatenate([[0.0], np.cumsum(_power(w.left))])
        return (total[w.end] - total[w.start]) / np.sqrt(np.maximum(power[w.end] - power[w.start], 1e-12)) + self.bias

    def worst(self, texts: list[str]) -> np.ndarray:
        """Of each text."""
        out = np.full(len(texts), LOWEST)
        for a, b in _groups(texts):
            w = windows(texts[a:b])
            np.maximum.at(out, a + w.text, self.margins(w))
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(margin, LOWEST, HIGHEST) + self.offset, -30, 30))) if self.slope else np.zeros(len(margin))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) <= CHUNK:
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve as if both labels were equally common, with a prior count on each side so that
    clear cases stay finite."""
    m = np.concatenate([np.clip(margin, LOWEST, HIGHEST), [1.0, -1.0]])
    t = np.concatenate([y, [1.0, 0.0]])
    a = np.stack([m, np.ones(len(m))], 1)
    each = np.where(t > 0, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum()))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (each * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), a.T @ (each * (p - t)) + 0.01 * w)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _counts(labelled: DataFrame) -> np.ndarray:
    """For each slot, by how many standard deviations more than expected the toxic documents have it, less CLEAR."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.int32)
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen = np.zeros(SLOTS, bool)
                w = windows([text or ""])
                for fits, slots, _ in _slots(w.symbols, w.left):
                    seen[slots[fits]] = True
                total[y] += seen
        cut = total.reshape(2, PIECES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), *[pa.array([x.tobytes() for x in cut[y]], pa.binary()) for y in (0, 1)]], names=["piece", "clean", "toxic"])

    both = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(both.values())
    share = both.get(1, 0) / max(1, n)

    def add(group: pa.Table) -> pa.Table:
        clean, toxic = (sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group.column(c).to_pylist()) for c in ("clean", "toxic"))
        have = np.maximum(1, clean + toxic)
        z = (toxic - have * share) / np.sqrt(have * share * (1 - share) * np.maximum(1e-9, 1 - have / (n + 1)) + 1e-9)
        return pa.table({"piece": group.column("piece").slice(0, 1), "z": pa.array([np.maximum(0, z - CLEAR).astype(np.float32).tobytes()], pa.binary())})

    rows = labelled.select("id", "text", "y").mapInArrow(frugal("toxicity", count), "piece int, clean binary, toxic binary").groupBy("piece").applyInArrow(add, "piece int, z binary")
    out = np.zeros((PIECES, SLOTS // PIECES), np.float32)
    for r in rows.collect():  # SLOTS numbers
        out[r["piece"]] = np.frombuffer(r["z"], np.float32)
    return out.ravel()


def _worst(labelled: DataFrame, model: Model, name: str) -> DataFrame:
    """id, y, fold, place, margin, text and own: of each document its worst windows that do not overlap (place 0 to
    WITNESSES - 1) and another one (place -1), as a table. A document without words has an empty window."""
    held = labelled.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers, whatever the input
    names = ["id", "y", "fold", "place", "margin", "text", "own"]

    def chosen(w: Windows, margin: np.ndarray) -> list[tuple[int, float, str, int]]:
        if not len(margin):
            return [(0, LOWEST, "", 0)]
        some = [int(margin.argmax())]
        for k in np.argsort(-margin, kind="stable")[: 8 * WITNESSES].tolist():
            if len(some) < WITNESSES and all(w.start[k] >= w.end[x] or w.end[k] <= w.start[x] for x in some):
                some.append(k)
        places = [*range(len(some)), -1]
        some.append((some[0] + len(margin) // 2) % len(margin))
        return [(p, float(margin[k]), *example) for p, k, example in zip(places, some, w.examples(np.array(some)), strict=True)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                w = windows([text or ""])
                rows = chosen(w, held.value.margins(w) if len(w.start) else np.zeros(0))
                of += [k] * len(rows)
                out += rows
            found = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of, pa.int64())) for k in (0, 2, 3)), *found], names=names)

    kind = labelled.schema["id"].dataType.simpleString()
    return materialize(labelled.select("id", "text", "y", "fold").mapInArrow(frugal("toxicity", read), f"id {kind}, y int, fold int, place int, margin double, text string, own int"), name)


def _fitted(examples: DataFrame) -> np.ndarray:
    """fit in one task. examples: y, turn, margin, text, own. Of the clean ones those of the last turn come first, the largest
    margins before; the others are shuffled, as those of large margins are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        bad = sorted((zlib.crc32(text.encode()), text, own) for y, _, _, text, own in rows if y and own)
        good = sorted((-turn, -margin, text, own) for y, turn, margin, text, own in rows if not y and own)
        sides = [list(dict.fromkeys(r[-2:] for r in side)) for side in (bad, good)]
        if not sides[0] or not sides[1]:
            return
        yield pa.RecordBatch.from_arrays([pa.array([fit(*sides).tobytes()], pa.binary())], names=["body"])

    found = examples.select("y", "turn", "margin", "text", "own").coalesce(1).mapInArrow(frugal("toxicity", run), "body binary").collect()
    return np.frombuffer(found[0]["body"], np.float32) if found else np.zeros(SLOTS, np.float32)


def train(labelled: DataFrame) -> Model:
    """labelled: id, text and y (0 or 1), SAMPLE rows at most."""
    none = Model(np.zeros(SLOTS, np.float32), LOWEST, 0.0, 0.0)
    labelled = materialize(labelled.select("id", "text", "y", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    if len(labelled.groupBy("y").agg(F.lit(1)).take(2)) < 2:
        return none
    model, kept = Model(_counts(labelled), 0.0, 0.0, 0.0), None
    for turn in range(ROUNDS):
        seen = _worst(labelled, model, "worst")
        clean = seen.where("y = 0 AND place = 0")
        usual, rare = clean.agg(F.percentile("margin", F.array(F.lit(0.9), F.lit(0.99)))).first()[0]
        now = ["y", "fold", F.lit(turn).alias("turn"), "margin", "text", "own"]
        bad = seen.where((F.col("y") == 1) & (F.col("place") >= 0) & (F.col("margin") > F.when(F.col("place") == 0, usual).otherwise(rare))).select(*now)
        hard = clean.orderBy(F.desc("margin"), "id").limit(HARD).select(*now)
        if kept is None:  # and any windows of clean documents, from the first round
            kept = seen.where("y = 0 AND place < 0").orderBy(F.xxhash64("id"), "id").limit(HARD).select("y", "fold", F.lit(-1).alias("turn"), "margin", "text", "own")
        kept = materialize(kept.unionByName(hard), "clean")
        examples = kept.unionByName(bad)
        model = Model(_fitted(examples), BIAS, 0.0, 0.0)
    # the curve is that of documents on which a fit without their windows is tried
    judged = _worst(labelled.where("fold = 0"), Model(_fitted(examples.where("fold > 0")), BIAS, 0.0, 0.0), "judged")
    judged = judged.where("place = 0").select("y", "margin").orderBy("margin", "y").toArrow()  # SAMPLE rows at most
    if judged.num_rows:
        margin, y = judged.column("margin").to_numpy(), judged.column("y").to_numpy().astype(np.float64)
        sure = (y == 0) | (margin > (np.quantile(margin[y == 0], 0.9) if (y == 0).any() else LOWEST))  # as above
        model.slope, model.offset = _curve(margin[sure], y[sure])
    return model if model.slope > 0 else none


def _judged(rows: DataFrame, model: Model) -> DataFrame:
    """id and text to id and score."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers, whatever the input

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(held.value.worst(texts)) for texts in _some(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["id", "score"])

    return rows.mapInArrow(frugal("toxicity", read), f"id {rows.schema['id'].dataType.simpleString()}, score double")


def _some(texts: pa.Array, most: int = 500) -> Iterator[list[str]]:
    for at in range(0, len(texts), most):
        yield [t or "" for t in texts.slice(at, most).to_pylist()]


def model_of(docs: DataFrame, labels: DataFrame, learn: Callable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """learn: a condition on the id; labels are learned only where it holds."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).where(learn(F.col("id")))
    # ids are chosen before texts are read; of rows with the same id the one of the least hash is learned from
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest")).join(known, "id").groupBy("id", "y").agg(F.min("digest").alias("digest"))
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest")).join(F.broadcast(chosen), ["id", "digest"])  # sample rows at most
    return train(materialize(texts.groupBy("id", "y").agg(F.first("text").alias("text")), "chosen"))


def keep_below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores less than limit."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in zip(range(0, batch.num_rows, 500), _some(batch.column(place)), strict=True):
                yield batch.slice(at, 500).filter(pa.array(held.value.score(held.value.worst(texts)) < limit))

    return docs.mapInArrow(frugal("toxicity", read), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, learn: Callable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """id and score of each document."""
    model = model_of(docs, labels, learn, id_col, text_col, label_col, sample)
    return _judged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select(F.col("id").alias(id_col), "score")
