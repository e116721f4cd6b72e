"""Complex numbers as struct<re, im> columns. Results follow IEEE arithmetic where Spark's would be NULL or an error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_complex_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == ["re", "im"]


def complex_(re_part, im_part=0.0) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, int | float) else F.col(x)
    return F.struct(as_column(re_part).alias("re"), as_column(im_part).alias("im"))


def literal(z: complex) -> Column:
    return F.struct(F.lit(float(z.real)).alias("re"), F.lit(float(z.imag)).alias("im"))


def re(c: Column) -> Column:
    return c.getField("re")


def im(c: Column) -> Column:
    return c.getField("im")


real, imag = re, im


def mag(c: Column) -> Column:
    return F.hypot(re(c), im(c))


abs_ = mag


def conj(c: Column) -> Column:
    return complex_(re(c), -im(c))


def neg(c: Column) -> Column:
    return complex_(-re(c), -im(c))


def log10(x: Column) -> Column:
    """-inf of 0 and NaN of negative numbers, where Spark's is NULL."""
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log10(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN."""
    # A zero's power of -1 is the infinity of its sign.
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def db20_real(x: Column) -> Column:
    return 20.0 * log10(F.abs(x))


def db20(c: Column) -> Column:
    return 20.0 * log10(mag(c))


def phase(c: Column) -> Column:
    """Degrees, from -180 to 180."""
    return F.degrees(F.atan2(im(c), re(c)))


def add(a: Column, b: Column) -> Column:
    return complex_(re(a) + re(b), im(a) + im(b))


def sub(a: Column, b: Column) -> Column:
    return complex_(re(a) - re(b), im(a) - im(b))


def mul(a: Column, b: Column) -> Column:
    return complex_(re(a) * re(b) - im(a) * im(b), re(a) * im(b) + im(a) * re(b))


def div(a: Column, b: Column) -> Column:
    d = re(b) * re(b) + im(b) * im(b)
    return complex_(ratio(re(a) * re(b) + im(a) * im(b), d), ratio(im(a) * re(b) - re(a) * im(b), d))


def power(a: Column, n: int | float) -> Column:
    """Whole powers by multiplication, others in polar form."""
    if isinstance(n, int) or float(n).is_integer():
        n, out, square = int(n), None, a
        k = abs(n)
        while k:
            if k & 1:
                out = square if out is None else mul(out, square)
            square, k = mul(square, square), k >> 1
        out = literal(1) if out is None else out
        return div(literal(1), out) if n < 0 else out
    r, angle = F.pow(mag(a), F.lit(float(n))), F.atan2(im(a), re(a)) * float(n)
    return complex_(r * F.cos(angle), r * F.sin(angle))
