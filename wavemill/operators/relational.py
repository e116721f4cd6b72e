"""Recipes over tables that waveform reports use: alignment, shares, ordered lists, reshaping, device tables, leaf x signal plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import complexes as cx
from ..functions.scalars import quoted as q
from .ordered import with_previous


def align(frames: list[DataFrame], index: list[str]) -> DataFrame:
    """Frames side by side on their common index, every index row kept, in order."""
    return reduce(lambda a, b: a.join(b, index, "full"), frames).orderBy(*map(q, index))


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def share_of_total(df: DataFrame, value: str, keys: list[str] = (), name: str = "share") -> DataFrame:
    """Each row's part of the sum, of all rows or of its keys' rows. The sums are aggregated first, so no row set meets in one task."""
    if keys:
        totals = df.groupBy(*map(q, keys)).agg(F.sum(q(value)).alias("_total"))
        out = df.join(totals, list(keys))
    else:
        out = df.crossJoin(F.broadcast(df.agg(F.sum(q(value)).alias("_total"))))  # one row
    return out.withColumn(name, F.col(q(value)) / F.nullif(F.col("_total"), F.lit(0.0))).drop("_total")


def ordered_list(df: DataFrame, keys: list[str], x: str, y: str, name: str = "curve") -> DataFrame:
    """Each group's (x, y) as one list in order of x. A group must fit in a task's memory."""
    return df.groupBy(*map(q, keys)).agg(F.sort_array(F.collect_list(F.struct(F.col(q(x)).alias("x"), F.col(q(y)).alias("y")))).alias(name))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in this order."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*map(q, others))
    best = F.min_by(row, F.struct(*map(q, order)))
    return df.groupBy(*map(q, keys)).agg(best.alias("_row")).select(*map(q, keys), "_row.*")


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "signal", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(q(c)) for c in ids], [F.col(q(c)) for c in values], name, value)


def pivot(df: DataFrame, index: list[str], on: str, values: str, of: list, how=F.first) -> DataFrame:
    return df.groupBy(*map(q, index)).pivot(on, list(of)).agg(how(F.col(q(values))))


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns as one column for each member, `<name>.<member>`."""
    out: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(q(f.name)).getField(m).alias(f"{f.name}.{m}") for m in f.dataType.names]
        else:
            out.append(F.col(q(f.name)))
    return df.select(*out)


def device_tables(df: DataFrame) -> dict[tuple[str, ...], DataFrame]:
    """Of a one-row table of structs: for each make-up of members a table (name, members) of the devices that have it."""
    makes: dict[tuple, list[str]] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType) and not cx.is_complex_type(f.dataType):
            makes.setdefault((tuple(f.dataType.names), f.dataType.simpleString()), []).append(f.name)
    out = {}
    for (members, _), names in makes.items():
        rows = F.array(*[F.struct(F.lit(n).alias("name"), *[F.col(q(n)).getField(m).alias(m) for m in members]) for n in names])
        out[members] = df.select(F.inline(rows))
    return out


def leaf_signal_pairs(leaves: DataFrame, names: DataFrame, condition: Column | None = None, max_pairs: int = 20_000_000) -> DataFrame:
    """Which signals to read of which leaves: the pairs that meet the condition, from tables whose product is checked first."""
    if leaves.count() * names.count() > max_pairs:
        raise ValueError(f"over {max_pairs} pairs of leaf and signal")
    pairs = leaves.crossJoin(names)
    return pairs if condition is None else pairs.filter(condition)


def phasor(df: DataFrame, groups: list[str], x: str, y: str, frequency: float, segments: int = 8) -> DataFrame:
    """The Fourier sum of each curve at a frequency: re and im of sum y * exp(-i 2 pi f x) dx. Curves are cut into stretches."""
    d = with_previous(df, groups, x, [x], segments)
    dx = F.coalesce(F.col(q(x)) - F.col("_prev").getField(x), F.lit(0.0))
    d = d.withColumn("_dx", dx).withColumn("_angle", 2 * F.pi() * frequency * F.col(q(x)))
    return d.groupBy(*map(q, groups)).agg(F.sum(F.col(q(y)) * F.cos("_angle") * F.col("_dx")).alias("re"), F.sum(-F.col(q(y)) * F.sin("_angle") * F.col("_dx")).alias("im"))


def of_type(df: DataFrame, *kinds: str, without: list[str] = ()) -> list[str]:
    """Names of the columns whose type is one of these (`double`, `struct`, ...), in order."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() in kinds and f.name not in without]


def within(df: DataFrame, ranges: DataFrame, x: str, low: str, high: str, width: float, most: int = 100_000) -> DataFrame:
    """Rows of df joined to the ranges (low <= x < high) that hold them. Both sides meet in stretches of the axis of `width`, so neither side
    is sent whole to the other; a range that spans over `most` stretches is an error."""
    cell = lambda c: F.floor(F.col(q(c)) / width)
    spans = F.when(cell(high) - cell(low) > most, F.raise_error(F.lit(f"a range spans over {most} stretches: take a larger width"))).otherwise(cell(high))
    cut = ranges.filter(F.col(q(low)) < F.col(q(high))).withColumn("_cell", F.explode(F.sequence(cell(low), spans.cast("long"))))
    return df.withColumn("_cell", cell(x)).join(cut, "_cell").filter((F.col(q(low)) <= F.col(q(x))) & (F.col(q(x)) < F.col(q(high)))).drop("_cell")
