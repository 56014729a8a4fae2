"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is put into bins, and the model is a table over each feature's bins, a table over the bins
of each chosen pair of features, and an intercept; a score is a sum of looked-up cells. Tables are learned by
cyclic boosting: round after round, each feature in turn gets a shallow tree on what is left unexplained, shrunk and
added to its table. Pairs are chosen by how much a two-way split of the remaining gradients would gain.

The labelled rows used to fit are bounded by SAMPLE, chosen by the hash of their ids; features are computed on whole
texts and for all documents.

Defined results: null and empty texts have all features 0 and a score like any other. Labels that are null or not 0
or 1 are ignored, of several labels of an id the least counts. Without any label to learn from the score is 0.5.
Null ids are scored and never learned from; repeated rows stay. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textvec import GRAM, chunks, words

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 120, 40, 0.15, 2.0
FEATURES = (
    "words", "word_bytes", "symbols", "pipes", "bangs", "upper", "digits", "stops", "lines", "other",
    "distinct_words", "equal_neighbours", "distinct_grams", "top_word", "wide_bytes",
)
#: Bytes counted for each text: symbols, pipes, bangs, capitals, digits, stops, line ends, other marks, non-ASCII.
_CLASSES = (b"#*$%&<>", b"|", b"!", bytes(range(65, 91)), b"0123456789", b".,;:", b"\n", b"?'\"()[]{}/\\@~^_=+-`", bytes(range(128, 256)))


def measure(texts: list[bytes]) -> np.ndarray:
    """len(texts) x len(FEATURES)."""
    h, begins = words(texts)
    n = np.diff(begins).astype(np.float64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.float64)
    counts = []
    for marks in _CLASSES:
        table = np.zeros(256, np.int64)
        table[list(marks)] = 1
        counts.append(np.add.reduceat(table[data], at).astype(np.float64))
    counts[6] -= 1  # the line end between texts
    space = np.zeros(256, np.int64)
    space[[32, 9, 10, 11, 12, 13]] = 1
    inked = sizes + 1 - np.add.reduceat(space[data], at)
    out = np.zeros((len(texts), len(FEATURES)))
    w, b = np.maximum(n, 1), np.maximum(inked, 1)
    out[:, 0] = np.log1p(n)
    out[:, 1] = inked / w
    for k, c, per in ((2, 0, w), (3, 1, w), (4, 2, w), (5, 3, b), (6, 4, b), (7, 5, w), (8, 6, w), (9, 7, w), (14, 8, b)):
        out[:, k] = counts[c] / per
    for k in range(len(texts)):
        own = h[begins[k] : begins[k + 1]]
        if not len(own):
            continue
        _, times = np.unique(own, return_counts=True)
        out[k, 10] = len(times) / len(own)
        out[k, 11] = np.count_nonzero(own[1:] == own[:-1]) / len(own)
        out[k, 13] = times.max() / len(own)
        if len(own) >= GRAM:
            grams = own[: len(own) - GRAM + 1].copy()
            for j in range(1, GRAM):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + own[j : len(own) - GRAM + 1 + j]
            out[k, 12] = len(np.unique(grams)) / len(grams)
    return out


@dataclass
class Model:
    """edges: of each feature's bins; main: a table for each; pairs: (feature, feature, edges, edges, table)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    main: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.main, strict=True)):
            out += table[np.searchsorted(edges, x[:, k], side="right")]
        for a, b, ea, eb, table in self.pairs:
            out += table[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.zeros(0)


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + SMOOTH)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of bins in a row."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + SMOOTH) + (g.sum() - gl) ** 2 / (h.sum() - hl + SMOOTH) - g.sum() ** 2 / (h.sum() + SMOOTH)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step of each bin by a tree of that depth."""
    gain, cut = _split(g, h) if depth and len(g) > 1 else (0.0, 0)
    if not cut:
        return np.full(len(g), _step(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray, depth: int = 3) -> np.ndarray:
    """The same over the cells of a pair, split along either feature."""
    best = max(((*_split(g.sum(1 - axis), h.sum(1 - axis)), axis) for axis in (0, 1)), key=lambda x: x[0]) if depth else (0.0, 0, 0)
    if not best[1]:
        return np.full(g.shape, _step(g.sum(), h.sum()))
    _, cut, axis = best
    parts = [_tree2(x, y, depth - 1) for x, y in zip(np.split(g, [cut], axis), np.split(h, [cut], axis), strict=True)]
    return np.concatenate(parts, axis)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: rows x features; y: 0 or 1."""
    model = Model()
    if not len(y):
        return model
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(rate / (1 - rate)))
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    model.main = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    margin = np.full(len(y), model.intercept)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.main):
            g, h = left()
            step = RATE * _tree(np.bincount(bins[k], g, len(table)), np.bincount(bins[k], h, len(table)))
            table += step
            margin += step[bins[k]]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    g, h = left()
    cells = lambda a, b, v: np.bincount(at[a] * (len(coarse[b]) + 1) + at[b], v, (len(coarse[a]) + 1) * (len(coarse[b]) + 1)).reshape(len(coarse[a]) + 1, -1)
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            step = _tree2(cells(a, b, g), cells(a, b, h))
            gains.append((float((step * cells(a, b, g)).sum()), a, b))
    for _, a, b in sorted(gains, reverse=True)[:PAIRS]:
        model.pairs.append((a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))))
    for _ in range(PAIR_ROUNDS):
        for a, b, _, _, table in model.pairs:
            g, h = left()
            step = RATE * _tree2(cells(a, b, g), cells(a, b, h))
            table += step
            margin += step[at[a], at[b]]
    return model


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x (array<double>, FEATURES) of each document, as a table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(measure(texts[a:b])))], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(read, f"id {kind}, x array<double>"), "features")


def classify(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """id and score of each document. learn: a condition on the id; labels are learned only where it holds."""
    rows = features(docs, id_col, text_col)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y")).where(learn(F.col("id")))
    some = rows.join(known, "id").select("id", "x", "y").orderBy(F.xxhash64("id"), "x").limit(sample).toArrow()
    x = np.array(some.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    model = fit(x, some.column("y").to_numpy().astype(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(own))], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")
