"""Column expressions: bases, zig-zag, quantization, predicates and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: two-bit codes of the bases, in order.
BASES = "ACGT"


def base_code(base: Column) -> Column:
    """0 to 3; everything else is 0, as A."""
    return F.when(base == "C", 1).when(base == "G", 2).when(base == "T", 3).otherwise(0)


def code_base(code: Column) -> Column:
    return F.substring(F.lit(BASES), code.cast("int") + 1, F.lit(1))


def zigzag(d: Column) -> Column:
    """Small codes for small numbers of either sign: 0, -1, 1, -2 are 0, 1, 2, 3."""
    d = d.cast("long")
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 63))


def unzigzag(z: Column) -> Column:
    z = z.cast("long")
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def prequantize(value: Column, eb: float) -> Column:
    """The number of the quantum, halves away from zero."""
    return F.round(value.cast("double") / F.lit(2.0 * eb)).cast("long")


def dequantize(q: Column, eb: float) -> Column:
    return q.cast("double") * F.lit(2.0 * eb)


def is_equal(x: Column, to: object) -> Column:
    return x == to


def in_ball(x: Column, r: object) -> Column:
    return F.abs(x) < r


def in_shifted_ball(x: Column, r: object) -> Column:
    """0 <= x < 2r."""
    return (x >= 0) & (x < 2 * r)


def is_numeric(piece: Column) -> Column:
    """Digits only, one at least."""
    return piece.rlike("^[0-9]+$")


def wrapped_int(piece: Column) -> Column:
    """Base-10 value modulo 2**32 as a signed 32-bit number, however many digits there are, and -1 for what is no number."""
    long = F.lit(0).cast("long")
    low = F.aggregate(F.split(piece, ""), long, lambda a, c: F.when(c == "", a).otherwise((a * 10 + c.try_cast("int")) % 2**32))
    return F.when(is_numeric(piece), F.when(low >= 2**31, low - 2**32).otherwise(low)).otherwise(-1).cast("int")


def bit_string(code: Column, length: Column) -> Column:
    """A prefix code as text of zeros and ones."""
    return F.lpad(F.bin(code), length.cast("int"), F.lit("0"))
