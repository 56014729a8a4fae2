"""Deterministic encoding of typed columns as JVM expressions; no Python worker takes part.

Every function maps a column to a BINARY column that holds one canonical item. SQL NULL in, SQL NULL out; the encoded
null is ``null_item``. PROFILES: ``rfc8949`` (core deterministic) and ``dcbor`` (numeric reduction, one zero, NFC text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILES = ("rfc8949", "dcbor")
NAN = "F97E00"


def check_profile(profile: str) -> str:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile!r}; one of {', '.join(PROFILES)}")
    return profile


def _item(prefix: str) -> Column:
    return F.unhex(F.lit(prefix))


def _bytes(first: str, digits: Column, width: int) -> Column:
    """One byte and an unsigned number, given by its hexadecimal digits, in width bytes."""
    return F.unhex(F.concat(F.lit(first), F.lpad(digits, 2 * width, "0")))


def head(major: int, arg: Column) -> Column:
    """The shortest head for a BIGINT argument of 0 or more."""
    base = major << 5
    digits = F.hex(arg.cast("long"))
    return (
        F.when(arg < 24, F.unhex(F.lpad(F.hex(arg.cast("long") + base), 2, "0")))
        .when(arg < 1 << 8, _bytes(f"{base + 24:02X}", digits, 1))
        .when(arg < 1 << 16, _bytes(f"{base + 25:02X}", digits, 2))
        .when(arg < 1 << 32, _bytes(f"{base + 26:02X}", digits, 4))
        .when(arg.isNotNull(), _bytes(f"{base + 27:02X}", digits, 8))
    )


def head_u64(major: int, arg: Column) -> Column:
    """The shortest head for a DECIMAL(20,0) argument from 0 to 2^64 - 1; null outside."""
    small = head(major, F.when(arg < F.lit("9223372036854775808").cast("decimal(20,0)"), arg).cast("long"))
    fits = (arg >= 0) & (arg <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    large = _bytes(f"{(major << 5) + 27:02X}", F.conv(F.when(fits, arg).cast("string"), 10, 16), 8)
    return F.when(~fits, None).otherwise(F.coalesce(small, large))


def encode_int(value: Column) -> Column:
    """Of an integral column (up to BIGINT)."""
    wide = value.cast("long")
    return F.when(wide >= 0, head(0, wide)).otherwise(head(1, F.bitwise_not(wide)))


def encode_wide_int(value: Column) -> Column:
    """Of a DECIMAL(20,0) column, -2^64 to 2^64 - 1; null outside."""
    number = value.cast("decimal(20,0)")
    return F.when(number >= 0, head_u64(0, number)).otherwise(head_u64(1, (-1 - number).cast("decimal(20,0)")))


def encode_text(value: Column) -> Column:
    return F.concat(head(3, F.octet_length(value)), value.cast("binary"))


def encode_bytes(value: Column) -> Column:
    return F.concat(head(2, F.octet_length(value)), value)


def encode_hex(value: Column) -> Column:
    """Of bytes written as lowercase hexadecimal; null for anything else."""
    return encode_bytes(F.unhex(F.when(value.rlike("^([0-9a-f]{2})*$"), value)))


def encode_bool(value: Column) -> Column:
    return F.when(value, _item("F5")).when(~value, _item("F4"))


def null_item() -> Column:
    return _item("F6")


def double_bits(value: Column) -> Column:
    """The IEEE 754 bits of a DOUBLE as BIGINT; unlike comparisons, they tell zeros apart. Spark takes the call for
    non-deterministic: select what is made of it before it goes into an aggregate or a join condition."""
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value.cast("double")).cast("long")


def _float_parts(bits: Column) -> tuple[Column, Column, Column]:
    exponent = F.shiftright(bits, 52).bitwiseAND(F.lit(0x7FF)) - 1023
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1))
    sign = F.when(bits < 0, 1).otherwise(0).cast("long")
    return sign, exponent, fraction


def _narrow(bits: Column, digits: int, bias: int) -> Column:
    """The bits of the same number in a format with so many fraction digits and that exponent bias; null if it has none.
    bits: of a finite number."""
    sign, exponent, fraction = _float_parts(bits)
    drop = 52 - digits
    low = 1 - bias
    top = sign * (1 << digits + (2 * bias + 1).bit_length())
    whole = fraction.bitwiseOR(F.lit(1 << 52))
    # below the normal range the fraction shifts further right
    shift = F.greatest(F.lit(0), low - exponent) + drop
    kept = F.call_function("shiftrightunsigned", whole, F.least(shift, F.lit(63)).cast("int"))
    exact = (shift <= 52) & (whole == F.call_function("shiftleft", kept, F.least(shift, F.lit(63)).cast("int")))
    normal = top + (exponent + bias) * (1 << digits) + F.shiftrightunsigned(fraction, drop)
    return (
        F.when((exponent == -1023) & (fraction == 0), top)
        .when((exponent > bias) | ~exact, None)
        .when(exponent >= low, F.when(fraction.bitwiseAND(F.lit((1 << drop) - 1)) == 0, normal))
        .otherwise(top + kept)
    )


def encode_float(value: Column, width: str = "auto") -> Column:
    """Of a DOUBLE column, under rfc8949: the shortest of f16, f32 and f64 that keeps every bit; or the width asked for,
    null where that one cannot hold the number. NaN has one form."""
    if width not in ("auto", "f16", "f32", "f64"):
        raise ValueError(f"unknown float width: {width!r}")
    # the bits in an array of their own, so that the call is made once
    return F.transform(F.array(double_bits(F.coalesce(value, F.lit(0.0)))), lambda bits: _encode_bits(bits, value, width))[0]


def _encode_bits(bits: Column, value: Column, width: str) -> Column:
    half, single = _narrow(bits, 10, 15), _narrow(bits, 23, 127)
    infinite = F.abs(value) == float("inf")
    minus = value < 0
    forms = {
        "f16": F.when(infinite, F.when(minus, _item("F9FC00")).otherwise(_item("F97C00"))).otherwise(_bytes("F9", F.hex(half), 2)),
        "f32": F.when(infinite, F.when(minus, _item("FAFF800000")).otherwise(_item("FA7F800000"))).otherwise(_bytes("FA", F.hex(single), 4)),
        "f64": _bytes("FB", F.hex(bits), 8),
    }
    out = F.coalesce(*forms.values()) if width == "auto" else forms[width]
    return F.when(F.isnan(value), _item(NAN)).when(value.isNotNull(), out)


def float_width(value: Column) -> Column:
    """2, 4 or 8: bytes of the shortest form."""
    return (F.octet_length(encode_float(value)) - 1).cast("long")


def encode_float_dcbor(value: Column) -> Column:
    """Of a DOUBLE column: whole numbers from -2^63 to 2^64 - 1 become integers, both zeros the integer 0."""
    whole = (value == F.rint(value)) & (value >= -(2.0**63)) & (value < 2.0**64)
    small = F.when(whole & (value < 2.0**63), value).cast("long")
    def rest(bits: Column) -> Column:
        # from 2^63 on the bits themselves are shifted, as a cast to a decimal would round
        fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)).bitwiseOR(F.lit(1 << 52))
        return F.when(whole & (value >= 2.0**63), _bytes("1B", F.hex(F.shiftleft(fraction, 11)), 8)).otherwise(_encode_bits(bits, value, "auto"))

    return F.coalesce(encode_int(small), F.transform(F.array(double_bits(F.coalesce(value, F.lit(0.0)))), rest)[0])


def encode_array(items: Column, count: Column | None = None) -> Column:
    """Of an ARRAY<BINARY> of encoded items."""
    return F.concat(head(4, F.size(items) if count is None else count), _joined(items))


def _joined(items: Column) -> Column:
    return F.unhex(F.array_join(F.transform(items, lambda x: F.hex(x)), ""))


def encode_tag(tag: Column | int, item: Column) -> Column:
    """tag: 0 to 2^64 - 1."""
    number = F.lit(str(tag)).cast("decimal(20,0)") if isinstance(tag, int) else tag.cast("decimal(20,0)")
    return F.concat(head_u64(6, number), item)


def encode_entries(entries: Column, profile: str = "rfc8949") -> Column:
    """Of an ARRAY<STRUCT<k BINARY, v BINARY>> of encoded keys and values, in input order: sorted by key bytes. Equal keys
    all stay, in order, under rfc8949; under dcbor the last one wins."""
    check_profile(profile)
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))))
    if profile == "dcbor":
        last = F.transform(placed, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i")))
        keys = F.transform(placed, lambda e: e["k"])
        placed = F.filter(last, lambda e: ~F.coalesce(F.get(keys, e["i"] + 1) == e["k"], F.lit(False)))
    return F.concat(head(5, F.size(placed)), _joined(F.transform(placed, lambda e: F.concat(e["k"], e["v"]))))
