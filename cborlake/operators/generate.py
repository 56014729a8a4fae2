"""Seeded random logical values: the same seed and number give the same rows, however they are partitioned."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_EDGES = sorted({s * (1 << k) + d for k in (0, 3, 5, 8, 16, 32, 63, 64) for d in (-1, 0, 1) for s in (1, -1) if -(1 << 64) <= s * (1 << k) + d < 1 << 64})
_TEXTS = ("", "a", "IETF", "ü", "ü", "水", "é", "\U0001d11e")
_FLOATS = ("0.0", "-0.0", "1.5", "65504.0", "5.960464477539063e-08", "1.1", "NaN", "Infinity", "-Infinity", "1e300", "16777217.0")


def value(rng: random.Random, depth: int = 4, known_tags: bool = False) -> dict:
    """known_tags: only what a strict decoder accepts under both profiles' tag rules."""
    kinds = ["int", "int", "float", "text", "bytes", "bool", "null", "bignum"]
    if depth:
        kinds += ["array", "map", *([] if known_tags else ["tag"])]
    kind = rng.choice(kinds)
    inner = lambda: value(rng, depth - 1, known_tags)
    if kind == "int":
        return {"type": "int", "value": str(rng.choice(_EDGES) if rng.random() < 0.5 else rng.randint(-1000, 100000))}
    if kind == "float":
        return {"type": "float", "width": "auto", "value": rng.choice(_FLOATS)}
    if kind == "text":
        return {"type": "text", "value": rng.choice(_TEXTS)}
    if kind == "bytes":
        return {"type": "bytes", "value": rng.randbytes(rng.randint(0, 30)).hex()}
    if kind == "bool":
        return {"type": "bool", "value": rng.random() < 0.5}
    if kind == "null":
        return {"type": "null"}
    if kind == "bignum":
        small = rng.random() < 0.1 and not known_tags
        return {"type": "bignum", "sign": rng.choice(["positive", "negative"]), "value": str(rng.randint(0, 1 << 63) if small else rng.randint((1 << 64) + 1, 1 << 130))}
    if kind == "array":
        return {"type": "array", "items": [inner() for _ in range(rng.randint(0, 6))]}
    if kind == "map":
        return {"type": "map", "entries": [[inner(), inner()] for _ in range(rng.randint(0, 6))]}
    return {"type": "tag", "tag": rng.choice([2, 3, 37, 1 << 32, (1 << 64) - 1]), "value": inner()}


def values(spark: SparkSession, n: int, seed: int = 42, known_tags: bool = False) -> DataFrame:
    """id and logical_value (JSON text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [json.dumps(value(random.Random(f"{seed}:{i}"), known_tags=known_tags)) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array([f"rand_{i:08d}" for i in ids]), pa.array(texts)], names=["id", "logical_value"])

    return spark.range(n).mapInArrow(make, "id string, logical_value string")
