"""Implementations by name, and differential queries between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dynamic
from ..functions.columns import PROFILES, check_profile


@dataclass(frozen=True)
class Implementation:
    """encode: JSON text column to BINARY; decode: BINARY column to STRUCT<verdict, reason, canonical>."""

    name: str
    encode: Callable[[Column, str], Column]
    decode: Callable[[Column, str], Column]
    profiles: tuple[str, ...] = PROFILES


_known: dict[str, Implementation] = {}


def register(implementation: Implementation) -> None:
    _known[implementation.name] = implementation


def get(name: str) -> Implementation:
    if name not in _known:
        raise ValueError(f"unknown implementation: {name!r}")
    return _known[name]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i.name, "", list(i.profiles)) for i in _known.values()], "name string, binary string, profiles array<string>")


def run_encode(vectors: DataFrame, name: str, profile: str) -> DataFrame:
    """id and actual (lowercase hexadecimal, empty on error) of each vector."""
    check_profile(profile)
    return vectors.select("id", F.coalesce(F.lower(F.hex(get(name).encode(F.col("logical_value"), profile))), F.lit("")).alias("actual"))


def run_decode(vectors: DataFrame, name: str, profile: str) -> DataFrame:
    """id and actual (the result line) of each vector with input_hex."""
    check_profile(profile)
    item = F.unhex(F.when(F.col("input_hex").rlike("^([0-9a-f]{2})*$"), F.col("input_hex")))
    decoded = vectors.select("id", get(name).decode(item, profile).alias("d"))
    return decoded.select("id", dynamic.result_line(F.col("d")).alias("actual"))


def differential(vectors: DataFrame, first: str, second: str, profile: str) -> DataFrame:
    """Vectors on which two implementations give different bytes; one scan, both results side by side."""
    get_hex = lambda n: F.coalesce(F.lower(F.hex(get(n).encode(F.col("logical_value"), profile))), F.lit(""))
    both = vectors.withColumns({"first": get_hex(first), "second": get_hex(second)})
    return both.where("first <> second")


register(Implementation("dynamic", dynamic.encode_json, dynamic.decode_strict))
register(Implementation("dynamic-strict", lambda c, p: dynamic.encode_json(c, p, strict=True), dynamic.decode_strict))
