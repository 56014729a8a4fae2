"""Columns of values of any shape: JSON text or item bytes, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codec
from .columns import PROFILES, check_profile, encode_text

DECODED = "verdict string, reason string, canonical binary"


def encode_json(value: Column, profile: str, strict: bool = False) -> Column:
    """BINARY of a column of logical values as JSON text; null where the value is none or cannot be encoded."""
    check_profile(profile)

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _or_none(codec.encode_json, t, profile, strict))

    return run(value)


def _or_none(f, value, *args):
    if value is None:
        return None
    try:
        return f(value, *args)
    except codec.Malformed:
        return None


def decode_strict(value: Column, profile: str) -> Column:
    """STRUCT<verdict, reason, canonical> of a BINARY column; a null input gives null fields."""
    check_profile(profile)

    @F.pandas_udf(DECODED)
    def run(items: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None else codec.decode_strict(bytes(x), profile) for x in items]
        return pd.DataFrame(rows, columns=["verdict", "reason", "canonical"], dtype=object)

    return run(value)


def decode_both(value: Column) -> Column:
    """STRUCT<rfc8949, dcbor>, each what ``decode_strict`` gives, of one pass over most items."""

    @F.pandas_udf(", ".join(f"{p}_{f} {t}" for p in PROFILES for f, t in (("verdict", "string"), ("reason", "string"), ("canonical", "binary"))))
    def run(items: pd.Series) -> pd.DataFrame:
        rows = []
        for x in items:
            both = codec.decode_both(bytes(x)) if x is not None else {}
            rows.append([v for p in PROFILES for v in both.get(p, (None, None, None))])
        return pd.DataFrame(rows, columns=[f"{p}_{f}" for p in PROFILES for f in ("verdict", "reason", "canonical")], dtype=object)

    flat = run(value)
    return F.transform(F.array(flat), lambda d: F.struct(*[F.struct(*[d[f"{p}_{f}"].alias(f) for f in ("verdict", "reason", "canonical")]).alias(p) for p in PROFILES]))[0]


def result_line(decoded: Column) -> Column:
    """The one-line form of a verdict; errors are an empty line."""
    return (
        F.when(decoded["verdict"] == "ACCEPT", F.concat(F.lit("ACCEPT "), F.lower(F.hex(decoded["canonical"]))))
        .when(decoded["verdict"] == "REJECT", F.concat(F.lit("REJECT "), decoded["reason"]))
        .otherwise(F.lit(""))
    )


def is_valid_json(value: Column) -> Column:
    """Whether JSON text follows the grammar of logical values."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else codec.valid_json(t))

    return run(value)


def to_logical_json(value: Column) -> Column:
    """JSON text of the value that an item stands for; null if it is not accepted."""

    @F.pandas_udf("string")
    def run(items: pd.Series) -> pd.Series:
        found = [None if x is None else codec.to_logical(bytes(x)) for x in items]
        return pd.Series([None if v is None else codec.json_of(v) for v in found], dtype=object)

    return run(value)


def nfc(value: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return run(value)


def encode_text_nfc(value: Column) -> Column:
    """Text under dcbor."""
    return encode_text(nfc(value))


def encode_bignum(sign: Column, digits: Column, strict: bool = False) -> Column:
    """BINARY of a magnitude in decimal digits and its sign (positive, negative); null if a plain integer holds it."""

    @F.pandas_udf("binary")
    def run(signs: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or n is None else _or_none(codec.encode, {"type": "bignum", "sign": s, "value": n}, "rfc8949", strict) for s, n in zip(signs, numbers, strict=True)], dtype=object)

    return run(sign, digits)


NODES = "array<struct<path:array<int>,major:int,arg:decimal(20,0),width:int,start:int,end:int>>"


def nodes(value: Column) -> Column:
    """The nodes of each item, parents before children: diagnostics for malformed and rejected ones too."""

    @F.pandas_udf(NODES)
    def run(items: pd.Series) -> pd.Series:
        from decimal import Decimal

        return items.map(lambda x: None if x is None else [{"path": list(n.path), "major": n.major, "arg": Decimal(n.arg), "width": n.width, "start": n.start, "end": n.end} for n in codec.nodes(bytes(x))])

    return run(value)
