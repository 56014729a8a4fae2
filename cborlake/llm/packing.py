"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

1. Each document becomes token ids and an end id; only a longer one is cut, into full pieces after a first,
   shorter one. Pieces, with their ids, go to a table in the shared folder.
2. How pieces are best packed depends on their lengths only. The histogram of lengths, ``capacity`` numbers at
   most whatever the input, comes to the driver, which packs it: a bin is filled greedily with the longest length
   that still fits; then, as long as that helps, its smallest document is replaced by the two unpacked ones that
   fill the widened gap most. The bin is repeated as often as the histogram allows, so that each bin pattern uses
   up a length, and billions of documents need a few thousand patterns.
3. Pieces of a length are numbered: a running number within the task that wrote them plus what earlier tasks hold,
   and the number says which pattern, copy and place a piece has. No single task sees all pieces of a length.

Defined results: null and empty texts are one piece with the end id only. Null ids and repeated rows are
documents of their own. Other columns are not carried. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import frugal, kept, materialize

CAPACITY, END_ID = 1024, 2
#: Words kept with their ids in each Python worker (about 200 bytes each), twice at most; characters encoded at once.
CACHE, CHUNK = 600_000, 1_000_000
#: Letters and marks for which the word pattern below splits as the tokenizer's own does. Texts that have other
#: characters, or a special token's string, take the tokenizer's own path.
_LETTERS, _MARKS, _SPECIAL = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~", "<|endoftext|>"
#: The byte-level tokenizer's word pattern, for those characters; any other one is a word of its own.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+|[\s\S]")
_OTHER = re.compile(rf"[^ \t\n\r0-9{_LETTERS}{_MARKS}]")


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes. Words are encoded once and remembered, in two
    generations, so that frequent words outlive a full memory. Words that start with a space and a letter part again
    where they were joined, so that many of them are encoded in one call."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.older = Tokenizer.from_file(path), cache, {}, {}
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())])

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        joined, rest = [], []
        for w in fresh:
            if w[0] == " " and w[-1].isalpha():
                joined.append(w)
            elif len(w) == 1 and _OTHER.match(w):
                self.known[w] = None
            else:
                rest.append(w)
        for at in range(0, len(joined), 2048):
            some = joined[at : at + 2048]
            (found,) = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(w.encode()) for w in some]), side="left") + 1
            raw, start = ids.tobytes(), 0
            for w, cut in zip(some, (4 * cuts).tolist(), strict=True):
                self.known[w] = raw[start:cut]
                start = cut
        for at in range(0, len(rest), 4096):  # what the tokenizer gives back takes much more room than the ids
            self.known.update(zip(rest[at : at + 4096], self._raw(rest[at : at + 4096]), strict=True))

    def _ids(self, text: str, words: list[str]) -> bytes:
        if _SPECIAL not in text:
            try:
                return b"".join(map(self.known.__getitem__, words))
            except TypeError:  # a word without ids
                pass
        return self._raw([text])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        words = list(map(_WORDS.findall, texts))
        wanted = set().union(*words)
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        fresh = []
        for w in wanted - self.known.keys():
            if ids := self.older.get(w):
                self.known[w] = ids
            else:
                fresh.append(w)
        self._learn(fresh)
        return list(map(self._ids, texts, words))


def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task until the worker does something else: it holds over 200 MB."""
    return kept("packing", path, lambda: Encoder(path))


PIECES = "part int, row long, piece int, start long, length long, nth long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id and PIECES: part and row name the document, nth counts the part's pieces of one length. The result
    is a table; numbers are those of the run that wrote it."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part, row = encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
            at = 0
            while at < batch.num_rows:
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
                out: dict[str, list] = {c: [] for c in ("of", "row", "piece", "start", "length", "nth", "ids")}
                for k, raw in zip(range(at, min(upto, batch.num_rows)), encode([t or "" for t in column.slice(at, upto - at).to_pylist()]), strict=True):
                    raw += end
                    n, start = len(raw) // 4, 0
                    piece = 0
                    while start < n:
                        length = capacity if n - start >= capacity and (start or not n % capacity) else (n - start if n <= capacity else n % capacity)
                        for c, v in (("of", k), ("row", row), ("piece", piece), ("start", start), ("length", length), ("nth", seen[length]), ("ids", raw[4 * start : 4 * (start + length)])):
                            out[c].append(v)
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                    row += 1
                at = upto
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(out["of"])), pa.array([part] * len(out["of"]), pa.int32()), pa.array(out["row"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["nth"], pa.int64()), pa.array(out["ids"], pa.binary())],
                    names=[id_col, "part", "row", "piece", "start", "length", "nth", "ids"],
                )

    schema = T.StructType([docs.select(id_col).schema[0], *T._parse_datatype_string(PIECES).fields])
    return materialize(docs.select(id_col, text_col).mapInArrow(frugal("packing", cut), schema), "pieces", compression="zstd")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin, times) that use up counts (length: number of pieces)."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        pattern: list[int] = []
        used: dict[int, int] = {}
        free = lambda x: left[x] - used.get(x, 0)

        def largest(gap: int) -> int:
            k = bisect.bisect_right(lengths, gap) - 1
            while k >= 0 and free(lengths[k]) <= 0:
                k -= 1
            return lengths[k] if k >= 0 else 0

        gap = capacity
        while gap and (x := largest(gap)):
            pattern.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        while gap:
            small = min(pattern)
            best = _two(lengths, free, gap + small, small)
            if not best:
                break
            pattern.remove(small)
            used[small] -= 1
            for x in best:
                pattern.append(x)
                used[x] = used.get(x, 0) + 1
            gap += small - sum(best)
        used = {k: v for k, v in used.items() if v}
        times = min(left[k] // v for k, v in used.items())
        out.append((sorted(pattern, reverse=True), times))
        for k, v in used.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
                lengths.remove(k)
    return out


def _two(lengths: list[int], free, room: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths still free whose sum is largest, over more_than and within room."""
    best, found = more_than, None
    i, j = 0, bisect.bisect_right(lengths, room) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > room:
            j -= 1
        elif free(b) <= 0:
            j -= 1
        else:
            if free(a) > (a == b) and a + b > best:
                best, found = a + b, (b, a)
            i += 1
    return found


def _places(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, number of pieces for each bin, offset in the bin, first sequence), by length and
    first number: how the pieces of a length are dealt to bins."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            m = lengths.count(length)
            rows.append((length, given.get(length, 0), m, offset, sequence))
            given[length] = given.get(length, 0) + m * times
            offset += m * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def assign(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, **more: Column) -> DataFrame:
    """id, part, row, piece, start, length, more (columns made of a piece), sequence_id, offset for the pieces of a table
    made by ``pieces``."""
    light = cut.select(id_col, "part", "row", "piece", "start", "length", "nth", *[c.alias(n) for n, c in more.items()])
    by_part = materialize(light.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = _places(best_two_fit(counts, capacity))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = by_part.select("length", "part", before.alias("before"))
    numbered = light.join(offsets, ["length", "part"]).select(F.col(id_col).alias("id"), "part", "row", "piece", "start", "length", *more, (F.col("before") + F.col("nth")).alias("number"))
    keys = places[:, 0] << 48 | places[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = places[np.searchsorted(keys, length << 48 | number, side="right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            nth, m = number - at[:, 1], np.maximum(at[:, 2], 1)
            extra = [pa.array(at[:, 4] + nth // m), pa.array(at[:, 3] + nth % m * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = [f for f in numbered.schema.fields if f.name != "number"]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: id, piece, start, length, sequence_id, offset and ids (little-endian unsigned 32-bit)."""
    cut = pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
    where = assign(cut, id_col, capacity).drop(id_col, "start", "length")
    return cut.join(where, ["part", "row", "piece"]).select(id_col, "piece", "start", "length", "sequence_id", "offset", "ids")
