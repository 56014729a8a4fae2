"""Removal of repeated passages by suffix order.

Every byte covered by a string of LENGTH bytes that also starts in a document of a smaller id goes; strings are judged
on the input.

1. Documents are read in chunks of whole documents, which are stored compressed in the shared folder.
2. In each window of LENGTH bytes the GRAM-byte string of the least hash, the first one if several, is its anchor. Equal
   windows have equal anchors, and a run of neighbouring windows shares one, so that some 1 in 16 bytes is an anchor.
   Of each chunk's anchors 4 bytes of hash travel, each once; those seen in two chunks, or in two documents of a
   chunk, are where equal windows can be. Anything else cannot repeat and stays where it is.
3. The segments around those anchors are dealt into shards by the anchor's hash: all windows that may be equal meet in a
   shard, whatever document they are from. Of equal segments of a chunk one travels, with the least id that has it and
   that id's places; where an id of the chunk is larger, all of the segment goes, which needs no other chunk.
4. A shard's segments are put in suffix order by induced sorting (module ``induced``), with common prefixes. Neighbours
   that share LENGTH bytes are one string, the least id among its places is where it stays. The different segments of
   a shard are held in memory; only the queue's spools go to files.
5. What is to go returns to the chunks as intervals, whose union is cut out of each document.

Defined results: null and empty texts have no bytes and stay. A null id is larger than all others; documents of equal
ids do not remove each other's bytes. Repeated rows stay. Extra columns are carried in ``kept`` if asked for, under
names of their own. An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, materialize, parts, quoted
from .induced import suffixes
from .textvec import _power

LENGTH, GRAM = 50, 20
#: Starts of grams in a window; bytes of the longest segment.
STARTS = LENGTH - GRAM + 1
SEGMENT = LENGTH + STARTS - 1
CHUNK = 4_000_000
#: Positions worked on at once, few enough to stay in a core's cache; a place has to fit below the bits kept of a hash.
BLOCK, PLACE_BITS = 1 << 18, 19
LAST = np.iinfo(np.int64).max


def _pack(**arrays: np.ndarray) -> bytes:
    import zstandard

    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(body: bytes) -> dict[str, np.ndarray]:
    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(body))) as found:
        return {k: found[k] for k in found.files}


def _write(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def _read(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def _chunks(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """chunk, body: a record batch of order (the id, LAST for null), id, text as bytes, and kept."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
                yield pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([_write(batch.slice(at, upto - at))], pa.binary())], names=["chunk", "body"])
                at, number = upto, number + 1

    order = F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST)))
    kept = [F.struct(*quoted(keep)).alias("kept")] if keep else []
    rows = docs.select(order.alias("order"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *kept)
    return materialize(rows.mapInArrow(frugal("suffix_dedup", gather), "chunk long, body binary"), "chunks", compression="uncompressed")


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all anchors: hash, document, and first and last window start in the document; and the documents' bytes."""
    found = []
    for k, text in enumerate(texts):
        if len(text) > BLOCK:  # long documents in blocks that share the windows at their borders
            for at in range(0, len(text) - LENGTH + 1, BLOCK - LENGTH):
                h, _, lo, hi = _anchors([text[at : at + BLOCK]])
                found.append((h, np.full(len(h), k), lo + at, hi + at))
    short = [k for k, t in enumerate(texts) if LENGTH <= len(t) <= BLOCK]
    at = 0
    while at < len(short):
        size, upto = 0, at
        while upto < len(short) and (upto == at or size + len(texts[short[upto]]) <= BLOCK):
            size += len(texts[short[upto]])
            upto += 1
        h, doc, lo, hi = _anchors([texts[k] for k in short[at:upto]])
        found.append((h, np.array(short[at:upto])[doc], lo, hi))
        at = upto
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    powers, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    hashes = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    key = hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
    key |= np.arange(len(key), dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= STARTS:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < STARTS:
        rest = STARTS - span
        least = np.minimum(least[:-rest], least[rest:])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)  # of the anchor of each window
    ends = np.cumsum([len(t) for t in texts])
    valid = np.ones(len(place), bool)
    for end in ends[:-1].tolist():  # windows over a border
        valid[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(valid)
    own = place[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(starts)]]) - 1 if len(first) else first
    doc = np.searchsorted(ends, starts[first], side="right")
    begin = np.concatenate([[0], ends[:-1]])[doc]
    return hashes[own[first]], doc, starts[first] - begin, starts[last] - begin


def _two(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Sorted hashes that occur in two documents or more."""
    if not len(hashes):
        return hashes
    by = np.lexsort((docs, hashes))
    h, d = hashes[by], docs[by]
    return np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(2).to_pylist()


def marks(chunks: DataFrame) -> DataFrame:
    """chunk, body: document of the chunk, start and end of the intervals to be removed."""
    spark = chunks.sparkSession
    shards = max(16, 4 * parts(spark))
    buckets = 1 << int(np.ceil(np.log2(2 * shards)))
    shift = np.uint64(64 - int(np.log2(buckets)))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h = np.unique(anchors(_texts(_read(batch.column(1)[k].as_py())))[0])
                cuts = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=np.uint64))
                low = (h >> np.uint64(12)).astype(np.uint32)
                rows = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([batch.column(0)[k].as_py()] * len(rows), pa.int64()), pa.array([low[cuts[b] : cuts[b + 1]].tobytes() for b in rows], pa.binary())], names=["bucket", "chunk", "low"])

    def shared(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk").to_pylist()
        own = [np.unique(np.frombuffer(x, np.uint32)) for x in group.column("low").to_pylist()]
        values, times = np.unique(np.concatenate(own), return_counts=True)
        often = values[times > 1]
        hit = [x[np.isin(x, often, assume_unique=True)] for x in own]
        rows = [k for k, x in enumerate(hit) if len(x)]
        return pa.table({"chunk": pa.array([chunk[k] for k in rows], pa.int64()), "bucket": pa.array([group.column("bucket")[0].as_py()] * len(rows), pa.int32()), "low": pa.array([hit[k].tobytes() for k in rows], pa.binary())})

    answers = chunks.mapInArrow(frugal("suffix_dedup", seen), "bucket int, chunk long, low binary").groupBy("bucket").applyInArrow(shared, "chunk long, bucket int, low binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "low")).alias("shared"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = _read(batch.column(1)[k].as_py())
                texts, order = _texts(rows), rows.column(0).to_numpy()
                h, doc, lo, hi = anchors(texts)
                ok = np.isin(h, _two(h, doc))
                bucket, low = (h >> shift).astype(np.int64), (h >> np.uint64(12)).astype(np.uint32)
                known = [(x["bucket"], np.frombuffer(x["low"], np.uint32)) for x in batch.column(2)[k].as_py() or []]
                if known:
                    wanted = np.concatenate([np.uint64(b) << np.uint64(32) | x.astype(np.uint64) for b, x in known])
                    ok |= np.isin(bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64), wanted)
                h, doc, lo, hi = h[ok], doc[ok], lo[ok], hi[ok]
                shard = (h % np.uint64(shards)).astype(np.int64)
                by = np.lexsort((lo, doc, shard))
                h, doc, lo, hi, shard = h[by], doc[by], lo[by], hi[by], shard[by]
                data = np.frombuffer(b"".join(texts) + bytes(SEGMENT), np.uint8)
                begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[doc] + lo
                size = hi - lo + LENGTH
                every = np.lib.stride_tricks.sliding_window_view(data, SEGMENT)
                segments = np.empty((len(h), SEGMENT), np.uint8)
                for a in range(0, len(h), 50_000):
                    w = slice(a, a + 50_000)
                    segments[w] = every[begin[w]]
                    segments[w][np.arange(SEGMENT) >= size[w, None]] = 0
                name = batch.column(0)[k].as_py()
                first, kind, least, late = _least(h, order[doc], size, segments)
                if late.any():  # rides to a shard's number beyond the others, which is the chunk's own
                    w = np.flatnonzero(late)
                    body = _pack(doc=doc[w].astype(np.int32), start=lo[w], end=lo[w] + size[w])
                    yield pa.RecordBatch.from_arrays([pa.array([shards + ((name >> 32) + name) % shards], pa.int32()), pa.array([name], pa.int64()), pa.array([body], pa.binary())], names=["shard", "chunk", "body"])
                stay = np.flatnonzero(~late)
                cuts = np.searchsorted(shard[stay], np.arange(shards + 1))
                for s in np.unique(shard[stay]).tolist():
                    w = stay[cuts[s] : cuts[s + 1]]
                    own, turn = np.unique(kind[w], return_inverse=True)
                    f = first[own]
                    body = _pack(h=h[f], order=least[own], size=size[f].astype(np.uint8), data=segments[f], kind=turn.astype(np.int32), doc=doc[w].astype(np.int32), lo=lo[w])
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([name], pa.int64()), pa.array([body], pa.binary())], names=["shard", "chunk", "body"])

    segments = chunks.join(answers, "chunk", "left").select("chunk", "body", "shared").mapInArrow(frugal("suffix_dedup", cut), "shard int, chunk long, body binary")

    def judge(group: pa.Table) -> pa.Table:
        if group.column("shard")[0].as_py() >= shards:
            return group.select(["chunk", "body"])
        names = group.column("chunk").to_pylist()
        bodies = [_unpack(x) for x in group.column("body").to_pylist()]
        out = {"chunk": [], "body": []}
        chunk = np.repeat(np.arange(len(bodies)), [len(b["h"]) for b in bodies])
        f = {k: np.concatenate([b[k] for b in bodies]) for k in ("h", "order", "size")}
        data = np.concatenate([b.pop("data") for b in bodies])
        start, end = _removed(f["h"], f["order"], f["size"].astype(np.int64), data)
        cuts = np.searchsorted(chunk, np.arange(len(bodies) + 1))
        for c, b in enumerate(bodies):
            own = cuts[c] + b["kind"]
            w = np.flatnonzero(end[own] > 0)
            if len(w):
                out["chunk"].append(names[c])
                out["body"].append(_pack(doc=b["doc"][w], start=b["lo"][w] + start[own[w]], end=b["lo"][w] + end[own[w]]))
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "body": pa.array(out["body"], pa.binary())})

    return segments.groupBy("shard").applyInArrow(judge, "chunk long, body binary")


def _distinct(h: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of equal segments, and the kind of each segment."""
    words = data.view(np.uint64)
    name = h + size.astype(np.uint64)
    for k in range(words.shape[1]):
        name = (name ^ (name >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[:, k]
    _, first, kind = np.unique(name, return_index=True, return_inverse=True)
    same = (h == h[first[kind]]) & (size == size[first[kind]])
    for k in range(words.shape[1]):
        same &= words[:, k] == words[first[kind], k]
    if not same.all():  # different segments of one name: told apart by all they are
        whole = np.concatenate([h[:, None], size[:, None].astype(np.uint64), words], 1)
        _, first, kind = np.unique(whole, axis=0, return_index=True, return_inverse=True)
    return first, kind.ravel()


def _least(h: np.ndarray, order: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What _distinct gives, the least id of each kind, and which segments have a larger one: all of those goes."""
    first, kind = _distinct(h, size, data)
    least = np.full(len(first), LAST)
    np.minimum.at(least, kind, order)
    return first, kind, least, order > least[kind]


def _removed(h: np.ndarray, order: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the part to be removed, from start to end; end is 0 where nothing goes. data: SEGMENT bytes for
    each segment, zeros after its size."""
    first, inverse = _distinct(h, size, data)
    least = np.full(len(first), LAST)
    np.minimum.at(least, inverse, order)
    # the distinct segments one after the other, each ended by a mark below all bytes
    sizes = size[first]
    grid = np.ones((len(first), SEGMENT + 1), np.uint16)
    grid[:, :SEGMENT] = data[first]
    grid[:, :SEGMENT] += 2
    inside = np.arange(SEGMENT + 1) <= sizes[:, None]
    grid[np.arange(len(first)), sizes] = 1
    text = np.append(grid[inside], np.uint16(0))
    own, offset = (x.astype(np.int32) for x in np.nonzero(inside))
    place, prefix = suffixes(text, LENGTH)
    full = place < len(own)
    full[full] = offset[place[full]] <= sizes[own[place[full]]] - LENGTH
    at = np.flatnonzero(full)
    fresh = prefix[at] < LENGTH
    fresh[:1] = True
    runs = np.flatnonzero(fresh)
    keeper = np.full((len(first), STARTS), LAST)
    if len(at):
        of = own[place[at]]
        best = np.minimum.reduceat(least[of], runs)
        keeper[of, offset[place[at]]] = np.repeat(best, np.diff(np.concatenate([runs, [len(at)]])))
    start, end = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    for a in range(0, len(h), 100_000):
        w = slice(a, a + 100_000)
        goes = keeper[inverse[w]] < order[w, None]
        some = goes.any(1)
        start[w] = np.where(some, goes.argmax(1), 0)
        # windows of a segment start so close to each other that what they cover is one piece
        end[w] = np.where(some, STARTS - 1 - goes[:, ::-1].argmax(1) + LENGTH, 0)
    return start, end


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals."""
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(fresh)
    return start[first], end[np.concatenate([first[1:], [len(start)]]) - 1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """For each document: id, n_bytes, spans (array<struct<start, end>>, in bytes of the input), rest (the remaining
    bytes) and, if columns are to be kept, the struct ``kept``. as_text: rest is a string; a character that a cut
    has parted is left out."""
    chunks = _chunks(docs, id_col, text_col, keep)
    found = marks(chunks).groupBy("chunk").agg(F.collect_list("body").alias("marks"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(f"n_bytes long, spans array<struct<start:long,end:long>>, rest {'string' if as_text else 'binary'}").fields])
    if keep:
        schema.add("kept", T.StructType([docs.schema[c] for c in keep]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = _read(batch.column(1)[k].as_py())
                texts = _texts(rows)
                got = [_unpack(x) for x in batch.column(2)[k].as_py() or []]
                f = {c: np.concatenate([g[c] for g in got]) for c in ("doc", "start", "end")} if got else {c: np.zeros(0, np.int64) for c in ("doc", "start", "end")}
                by = np.argsort(f["doc"], kind="stable")
                cuts = np.searchsorted(f["doc"][by], np.arange(len(texts) + 1))
                spans, rest = [], []
                for d, text in enumerate(texts):
                    w = by[cuts[d] : cuts[d + 1]]
                    if not len(w):
                        spans.append([])
                        rest.append(text)
                        continue
                    start, end = _union(f["start"][w], f["end"][w])
                    spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                    edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
                    rest.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                arrays = [rows.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x.decode("utf-8", "ignore") for x in rest], pa.string()) if as_text else pa.array(rest, pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, *rows.columns[3:]], names=["id", "n_bytes", "spans", "rest", *["kept"] * bool(keep)])

    return chunks.join(found, "chunk", "left").select("chunk", "body", "marks").mapInArrow(frugal("suffix_dedup", apply), schema).withColumnRenamed("id", id_col)
