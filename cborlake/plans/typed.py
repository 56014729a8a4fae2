"""Encoding of typed columns, compiled from their Spark type when the plan is made.

A struct becomes a map with text keys; the keys are encoded and put in order here, so that a row needs no sort.
Integers become integers, FLOAT and DOUBLE floats (by profile), STRING text, BINARY bytes, BOOLEAN and null
themselves, ARRAY an array, MAP a map of entries sorted at run time, DATE and timestamps integers (days and microseconds since
1970). DECIMAL(p, 0) up to 19 digits is an integer; other decimals have no rule and are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.codec import head as head_bytes
from ..functions.dynamic import encode_text_nfc

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def encode_column(value: Column, kind: T.DataType, profile: str = "rfc8949") -> Column:
    """BINARY; never null: SQL NULL becomes the null item."""
    C.check_profile(profile)
    return F.coalesce(_encode(value, kind, profile), C.null_item())


def _encode(value: Column, kind: T.DataType, profile: str) -> Column:
    if isinstance(kind, T.NullType):
        return C.null_item()
    if isinstance(kind, _INTEGERS):
        return C.encode_int(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return C.encode_float_dcbor(value.cast("double")) if profile == "dcbor" else C.encode_float(value.cast("double"))
    if isinstance(kind, T.StringType):
        return encode_text_nfc(value) if profile == "dcbor" else C.encode_text(value)
    if isinstance(kind, T.BinaryType):
        return C.encode_bytes(value)
    if isinstance(kind, T.BooleanType):
        return C.encode_bool(value)
    if isinstance(kind, T.DateType):
        return C.encode_int(F.unix_date(value))
    if isinstance(kind, T.TimestampType):
        return C.encode_int(F.unix_micros(value))
    if isinstance(kind, T.TimestampNTZType):
        return C.encode_int(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value))
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 19:
        return C.encode_wide_int(value)
    if isinstance(kind, T.ArrayType):
        _no_python(kind.elementType, profile)
        return F.when(value.isNotNull(), C.encode_array(F.transform(value, lambda x: encode_column(x, kind.elementType, profile))))
    if isinstance(kind, T.MapType):
        _no_python(kind, profile)
        pair = lambda e: F.struct(encode_column(e["key"], kind.keyType, profile).alias("k"), encode_column(e["value"], kind.valueType, profile).alias("v"))
        return F.when(value.isNotNull(), C.encode_entries(F.transform(F.map_entries(value), pair), profile))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), _entries([(f.name, value.getField(f.name), f.dataType) for f in kind], profile))
    raise TypeError(f"no rule for {kind.simpleString()}")


def _no_python(kind: T.DataType, profile: str) -> None:
    """Functions over array elements cannot call Python, which NFC needs."""
    if profile == "dcbor" and "string" in kind.simpleString():
        raise TypeError("text inside arrays and maps under dcbor: normalise it first or use the dynamic encoder")


def _entries(fields: list[tuple[str, Column, T.DataType]], profile: str) -> Column:
    if len({f[0] for f in fields}) < len(fields):
        raise ValueError("field names repeat")
    keyed = sorted(((head_bytes(3, len(name.encode())) + name.encode(), value, kind) for name, value, kind in fields), key=lambda x: x[0])
    parts = [F.lit(bytearray(head_bytes(5, len(keyed))))]
    for key, value, kind in keyed:
        parts += [F.lit(bytearray(key)), encode_column(value, kind, profile)]
    return F.concat(*parts)


def encode_struct(df: DataFrame, names: list[str] | None = None, profile: str = "rfc8949") -> Column:
    """The named columns of each row (all by default) as one map."""
    C.check_profile(profile)
    return _entries([(n, F.col(f"`{n}`"), df.schema[n].dataType) for n in names or df.columns], profile)


def canonical_hash(item: Column) -> Column:
    """SHA-256, in lowercase hexadecimal, of encoded bytes."""
    return F.sha2(item, 256)
