"""Scalar helpers that Spark lacks or that differ from what waveform tables need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal(c: Column, value) -> Column:
    """Equal within a relative 1e-5 for numbers, which is what six written digits keep; else exactly."""
    if isinstance(value, bool | str):
        return c == value
    return F.abs(c - float(value)) <= 1e-5 * abs(float(value)) + 1e-300


def round_sig_figs(c: Column, digits: int) -> Column:
    """Rounded to significant digits; 0 stays 0."""
    exponent = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - exponent)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def round_scaled(c: Column, digits: int) -> Column:
    """Rounded as SQL engines do that scale, round to a whole number and scale back; Spark's round() takes the written digits, so ties can differ."""
    scale = F.lit(10.0**digits)
    out = F.round(c * scale) / scale
    return F.when(F.abs(out) < float("inf"), out).otherwise(c)


def bucket(c: Column, width: float) -> Column:
    """The start of the bucket of this width that the value is in."""
    return F.floor(c / width) * width


def all_of(conditions) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


def horizontal_sum(columns) -> Column:
    out = None
    for x in columns:
        out = x if out is None else out + x
    return F.lit(0.0) if out is None else out


def quoted(name: str) -> str:
    """A column's name for col(): names hold dots, colons and brackets."""
    return "`" + name.replace("`", "``") + "`"
