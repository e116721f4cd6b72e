"""Waveforms: a value column over index columns. The last index column is the axis, the others tell curves of a family apart.

Operations on values stay lazy. A measurement of one curve is a number; of a family it is a table with a row for each
curve. Curves that never meet a condition have NaN.
"""

from __future__ import annotations


from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import complexes as cx
from ..functions.scalars import all_of, equal, quoted as q
from .ordered import running_sum, with_previous

NAN = float("nan")


class Waveform:
    #: Samples in a stretch: curves are cut into stretches along their axis for operations on neighbours.
    STRETCH = 4_000_000
    #: Stretches at least where the number of samples isn't known: of a single curve, and of a family, whose curves run in parallel anyway.
    SEGMENTS = (8, 2)

    def __init__(self, df: DataFrame, name: str, index: list[str], units: dict | None = None, n: int | None = None, segments: int | None = None):
        self.df, self.yname, self.index = df, name, list(index)
        self.units, self._n = dict(units or {}), n
        self._segments = segments
        # A waveform made of another sample by sample names that one as its root and how it is made of the root's table, whose
        # other columns are carried along: two with one root are paired within its rows.
        self._root, self._made = self, lambda frame, carried: frame

    # Metadata.
    groups = property(lambda self: self.index[:-1])
    xname = property(lambda self: self.index[-1])
    xunit = property(lambda self: self.units.get(self.xname))
    yunit = property(lambda self: self.units.get(self.yname))
    lazy = property(lambda self: self.df)
    frame = property(lambda self: self.df)

    @property
    def segments(self) -> int:
        """Into how many stretches the axis is cut, the same cuts for all curves, so that neither a long curve nor a family of few fills one task."""
        known = -(-self._n // self.STRETCH) if self._n else 0
        return self._segments or max(known, self.SEGMENTS[bool(self.groups)], self.df.sparkSession.sparkContext.defaultParallelism if not self._n and self.groups else 1)

    @cached_property
    def is_complex(self) -> bool:
        return cx.is_complex_type(self.df.schema[self.yname].dataType)

    def __len__(self) -> int:
        return self._n if self._n is not None else self.df.count()

    def __repr__(self) -> str:
        return f"Waveform({self.yname!r}, index={self.index}, units={self.units})"

    @property
    def _x(self) -> Column:
        return F.col(q(self.xname))

    @property
    def _y(self) -> Column:
        return F.col(q(self.yname))

    @property
    def _keys(self) -> list[Column]:
        return [F.col(q(g)) for g in self.groups]

    def _sorted(self):
        return self.df.select(*map(q, [*self.index, self.yname])).orderBy(*map(q, self.index))

    def to_pandas(self):
        return self._sorted().toPandas()

    toPandas = to_pandas

    def to_numpy(self) -> np.ndarray:
        return column_to_numpy(self._sorted().select(q(self.yname)), self.yname)

    x = property(lambda self: column_to_numpy(self._sorted().select(q(self.xname)), self.xname))
    y = property(to_numpy)

    # New waveforms.
    def _with(self, value: Column, name: str | None = None, unit: str | None = "same", n="same", df: DataFrame | None = None) -> Waveform:
        name = name or self.yname
        units = {k: v for k, v in self.units.items() if k in self.index} | {name: self.yunit if unit == "same" else unit}
        by_row = df is None or df is self.df
        df = (self.df if df is None else df).select(*map(q, self.index), value.alias(name))
        out = Waveform(df, name, self.index, units, self._n if n == "same" else n, self._segments)
        if by_row:
            out._root, out._made = self._root, lambda frame, carried: self._made(frame, carried).select(*map(q, self.index), value.alias(name), *carried)
        return out

    def renamed(self, name: str) -> Waveform:
        return self._with(self._y, name)

    def filter(self, condition: Column) -> Waveform:
        return Waveform(self.df.filter(condition), self.yname, self.index, self.units, None, self._segments)

    def leaf(self, **params) -> Waveform:
        """The curves with these parameters; the parameters leave the index."""
        unknown = sorted(set(params) - set(self.groups))
        if unknown:
            raise KeyError(f"unknown parameter(s) {unknown}; have {self.groups}")
        df = self.df.filter(all_of(equal(F.col(q(k)), v) for k, v in params.items()))
        index = [g for g in self.index if g not in params]
        return Waveform(df.select(*map(q, [*index, self.yname])), self.yname, index, self.units, None, self._segments)

    def clip(self, x0=None, x1=None) -> Waveform:
        """Samples between x0 and x1, both included."""
        return self.filter(all_of([self._x >= x0] * (x0 is not None) + [self._x <= x1] * (x1 is not None)))

    def real(self) -> Waveform:
        return self._with(cx.re(self._y)) if self.is_complex else self

    def imag(self) -> Waveform:
        return self._with(cx.im(self._y)) if self.is_complex else self._with(F.lit(0.0))

    def conj(self) -> Waveform:
        return self._with(cx.conj(self._y)) if self.is_complex else self

    def __abs__(self) -> Waveform:
        return self._with(cx.mag(self._y) if self.is_complex else F.abs(self._y))

    abs = mag = __abs__

    def db20(self) -> Waveform:
        return self._with(cx.db20(self._y) if self.is_complex else cx.db20_real(self._y), unit="dB")

    def phase(self) -> Waveform:
        y = self._y if self.is_complex else cx.complex_(self._y)
        return self._with(cx.phase(y), unit="deg")

    dB20 = db20

    def __neg__(self) -> Waveform:
        return self._with(cx.neg(self._y) if self.is_complex else -self._y)

    def _combined(self, other, operation, swap: bool = False, unit=None) -> Waveform:
        if isinstance(other, Waveform):
            return self._aligned(other, operation)
        if isinstance(other, DataFrame):
            value = [c for c in other.columns if c not in self.groups]
            if len(value) != 1:
                raise ValueError(f"expected the groups {self.groups} and one value, not {other.columns}")
            keys = [g for g in self.groups if g in other.columns]
            other = other.withColumnRenamed(value[0], "_other")
            if keys:
                joined = self.df.join(other, keys)
            else:
                if len(other.take(2)) != 1:
                    raise ValueError("a table without the curves' groups must have one row")
                joined = self.df.crossJoin(F.broadcast(other))  # one row
            a, b, b_complex = self._y, F.col("_other"), cx.is_complex_type(other.schema["_other"].dataType)
            df = joined
        else:
            b_complex = isinstance(other, complex)
            a, b, df = self._y, cx.literal(other) if b_complex else F.lit(float(other)), self.df
        a_complex = self.is_complex
        if swap:
            a, b, a_complex, b_complex = b, a, b_complex, a_complex
        return self._with(arithmetic(operation, a, b, a_complex, b_complex), df=df)

    def _aligned(self, other: Waveform, operation) -> Waveform:
        if self.index != other.index:
            raise ValueError(f"indexes differ: {self.index} and {other.index}")
        if operation == "pow":
            raise NotImplementedError("waveform ** waveform")
        name = f"({self.yname} {SYMBOLS[operation]} {other.yname})"
        units = {k: v for k, v in self.units.items() if k in self.index} | {name: None}
        if self._root is other._root:
            made = self._paired(other, operation, name)
            root = self._root
            out = Waveform(made(root.df.select(*map(q, [*root.index, root.yname])), []), name, self.index, units, self._n, self._segments)
            out._root, out._made = root, made
            return out
        # Groups tell null parameters apart, which a join would drop.
        a = self.df.select(*map(q, self.index), F.lit(1).alias("_in_a"), F.lit(0).alias("_in_b"), self._y.alias("_a"), F.lit(None).cast(other.df.schema[other.yname].dataType).alias("_b"))
        b = other.df.select(*map(q, other.index), F.lit(0).alias("_in_a"), F.lit(1).alias("_in_b"), F.lit(None).cast(self.df.schema[self.yname].dataType).alias("_a"), other._y.alias("_b"))
        both = a.union(b).groupBy(*map(q, self.index)).agg(F.sum("_in_a").alias("_in_a"), F.sum("_in_b").alias("_in_b"), F.first("_a", True).alias("_a"), F.first("_b", True).alias("_b"))
        # Odd samples are told before a result is handed out: those without a partner, and repeated ones, whose partners nothing tells.
        odd = both.filter("_in_a <> 1 OR _in_b <> 1").select("_in_a", "_in_b").first()
        if odd:
            raise ValueError("the waveforms have different axes" if odd["_in_a"] != odd["_in_b"] else "the waveforms repeat samples, so partners can't be told")
        value = arithmetic(operation, F.col("_a"), F.col("_b"), self.is_complex, other.is_complex)
        return Waveform(both.select(*map(q, self.index), value.alias(name)), name, self.index, units, self._n, self._segments)

    def _paired(self, other: Waveform, operation, name: str):
        """How the combination of two waveforms with one root is made of the root's table: sample by sample, so repeated samples and null
        parameters stay rows of their own."""

        def made(frame: DataFrame, carried: list[str]) -> DataFrame:
            # The root's values are kept while the left side is made of them, then the left side while the right one is.
            values, left = f"_values{len(carried)}", f"_left{len(carried)}"
            index, root = [*map(q, self.index)], self._root.yname
            frame = self._made(frame.withColumn(values, F.col(q(root))), [*carried, values])
            frame = other._made(frame.select(*index, self._y.alias(left), F.col(values).alias(root), *carried), [*carried, left])
            return frame.select(*index, arithmetic(operation, F.col(left), other._y, self.is_complex, other.is_complex).alias(name), *carried)

        return made

    def __add__(self, other):
        return self._combined(other, "add")

    def __radd__(self, other):
        return self._combined(other, "add", True)

    def __sub__(self, other):
        return self._combined(other, "sub")

    def __rsub__(self, other):
        return self._combined(other, "sub", True)

    def __mul__(self, other):
        return self._combined(other, "mul")

    def __rmul__(self, other):
        return self._combined(other, "mul", True)

    def __truediv__(self, other):
        return self._combined(other, "div")

    def __rtruediv__(self, other):
        return self._combined(other, "div", True)

    def __pow__(self, n):
        if not isinstance(n, int | float):
            raise NotImplementedError("a waveform's power must be a number")
        return self._with(cx.power(self._y, n) if self.is_complex else F.pow(self._y, F.lit(float(n))))

    # Measurements.
    def _need_real(self) -> None:
        if self.is_complex:
            raise TypeError(f"{self.yname} is complex; take abs(), real(), db20() or phase() first")

    def _answer(self, table: DataFrame, name: str):
        """The table of a family, the number of a single curve."""
        if self.groups:
            return table.select(*map(q, self.groups), F.col(q(name)))
        row = table.select(q(name)).first()
        value = row[0] if row is not None else None
        if value is None:
            return NAN
        return complex(value["re"], value["im"]) if isinstance(value, T.Row) else value

    def _measured(self, name: str, value: Column):
        return self._answer(self.df.groupBy(*self._keys).agg(value.alias(name)), name)

    def _real_y(self) -> Column:
        """Values without NaN, which Spark takes for the largest."""
        self._need_real()
        return F.when(~F.isnan(self._y), self._y)

    def ymax(self):
        return self._measured("ymax", F.coalesce(F.max(self._real_y()), F.lit(NAN)))

    def ymin(self):
        return self._measured("ymin", F.coalesce(F.min(self._real_y()), F.lit(NAN)))

    def xmax(self):
        """Where the largest value is, at first."""
        y = self._real_y()
        return self._measured("xmax", F.max_by(self._x, F.when(y.isNotNull(), F.struct(y, -self._x))))

    def xmin(self):
        y = self._real_y()
        return self._measured("xmin", F.min_by(self._x, F.when(y.isNotNull(), F.struct(y, self._x))))

    argmax, argmin = xmax, xmin

    def _weighted(self, name: str, value: Column, finish=lambda c: c):
        """The mean over the axis: trapezoids over the width."""
        d = self._steps(value)
        width = F.sum("_dx")
        return self._answer(d.groupBy(*self._keys).agg(finish(F.when(width > 0, F.sum(F.col("_dx") * (F.col("_a") + F.col("_b")) / 2) / width)).alias(name)), name)

    def mean(self, weighted: bool = False):
        self._need_real()
        return self._weighted("mean", self._y) if weighted else self._measured("mean", F.avg(self._y))

    average = mean

    def rms(self, weighted: bool = False):
        self._need_real()
        return self._weighted("rms", self._y * self._y, F.sqrt) if weighted else self._measured("rms", F.sqrt(F.avg(self._y * self._y)))

    def describe(self, accuracy: int | None = None) -> DataFrame:
        """Count, mean, deviation, extremes and quartiles of each curve. Exact quartiles keep a count of each distinct value of a curve in
        one task; with an accuracy they come from a sketch of bounded size, within 1 / accuracy of the rank."""
        y = self._real_y()
        of = F.percentile if accuracy is None else lambda c, at: F.percentile_approx(c, at, accuracy)
        quartiles = [of(y, p).alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
        return self.df.groupBy(*self._keys).agg(F.count(y).alias("count"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), *quartiles, F.max(y).alias("max"))

    def value(self, x0: float):
        """The value at x0: between samples on the line between them, outside that of the nearest."""
        row = F.struct(self._x.alias("x"), self._y.alias("y"))
        below = F.max_by(row, F.when(self._x <= x0, self._x))
        above = F.min_by(row, F.when(self._x >= x0, self._x))
        d = self.df.groupBy(*self._keys).agg(below.alias("_b"), above.alias("_a"))
        b, a = F.coalesce("_b", "_a"), F.coalesce("_a", "_b")
        t = F.when(a["x"] > b["x"], (F.lit(float(x0)) - b["x"]) / F.nullif(a["x"] - b["x"], F.lit(0.0))).otherwise(0.0)
        line = (lambda u, v: u + (v - u) * t) if not self.is_complex else (lambda u, v: cx.complex_(cx.re(u) + (cx.re(v) - cx.re(u)) * t, cx.im(u) + (cx.im(v) - cx.im(u)) * t))
        return self._answer(d.select(*self._keys, line(b["y"], a["y"]).alias("value")), "value")

    # Along the axis.
    def _pairs(self, y: Column | None = None) -> DataFrame:
        """Each sample with the one before: _x0, _y0, _x1, _y1; without each curve's first."""
        d = self.df.select(*self._keys, self._x.alias("_x1"), (self._y if y is None else y).alias("_y1"))
        d = with_previous(d, self.groups, "_x1", ["_x1", "_y1"], self.segments).filter(F.col("_prev").isNotNull())
        return d.select(*self._keys, F.col("_prev._x1").alias("_x0"), F.col("_prev._y1").alias("_y0"), "_x1", "_y1")

    def _steps(self, y: Column) -> DataFrame:
        return self._pairs(y).select(*self._keys, (F.col("_x1") - F.col("_x0")).alias("_dx"), F.col("_y0").alias("_a"), F.col("_y1").alias("_b"))

    def deriv(self) -> Waveform:
        """Forward differences; one sample fewer."""
        slope = lambda a, b: (b - a) / (F.col("_x1") - F.col("_x0"))
        y0, y1 = F.col("_y0"), F.col("_y1")
        value = cx.complex_(slope(cx.re(y0), cx.re(y1)), slope(cx.im(y0), cx.im(y1))) if self.is_complex else slope(y0, y1)
        df = self._pairs().filter("_x1 <> _x0").select(*self._keys, F.col("_x0").alias(self.xname), value.alias(self.yname))
        unit = f"{self.yunit}/{self.xunit}" if self.yunit and self.xunit else None
        return Waveform(df, self.yname, self.index, self.units | {self.yname: unit}, None if self._n is None or self.groups else max(0, self._n - 1), self._segments)

    def integ(self) -> Waveform:
        """The running integral by trapezoids, 0 at the first sample."""
        self._need_real()
        d = self.df.select(*self._keys, self._x.alias("_x1"), self._y.alias("_y1"))
        d = with_previous(d, self.groups, "_x1", ["_x1", "_y1"], self.segments)
        area = F.coalesce((F.col("_x1") - F.col("_prev._x1")) * (F.col("_y1") + F.col("_prev._y1")) / 2, F.lit(0.0))
        d = running_sum(d.withColumn("_area", area), self.groups, "_x1", "_area", "_total", self.segments)
        return Waveform(d.select(*self._keys, F.col("_x1").alias(self.xname), F.col("_total").alias(self.yname)), self.yname, self.index, self.units | {self.yname: f"{self.yunit}*{self.xunit}" if self.yunit and self.xunit else None}, self._n, self._segments)

    def integral(self):
        """The area under each curve."""
        self._need_real()
        d = self._steps(self._y)
        return self._answer(d.groupBy(*self._keys).agg(F.sum(F.col("_dx") * (F.col("_a") + F.col("_b")) / 2).alias("integral")), "integral")

    def crossings(self, level: float | Column = 0.0, edge: str = "either", y: Column | None = None) -> DataFrame:
        """All crossings: groups, x (on the line between samples), rising."""
        if edge not in ("rising", "falling", "either"):
            raise ValueError(f"edge is rising, falling or either, not {edge!r}")
        return _crossed(self._pairs(y), self._keys, F.lit(float(level)) if not isinstance(level, Column) else level, edge)

    def _nth(self, crossings: DataFrame, n: int, name: str) -> DataFrame:
        """Each curve's n-th crossing; from the end where n is negative. Only the |n| outermost of a curve are held."""
        if n == 0:
            raise ValueError("crossings count from 1, or from the end from -1")
        if abs(n) == 1:
            found = crossings.groupBy(*self._keys).agg((F.min if n > 0 else F.max)("x").alias(name))
        else:
            from pyspark.sql.window import Window

            order = F.col("x").asc() if n > 0 else F.col("x").desc()
            keys = self._keys or [F.lit(0)]
            found = crossings.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_n") == abs(n)).select(*self._keys, F.col("x").alias(name))
        return self._every_curve(found, name)

    def _every_curve(self, found: DataFrame, name: str) -> DataFrame:
        if not self.groups:
            return found
        every = self.df.select(*self._keys).distinct()
        return every.join(found, self.groups, "left").select(*self._keys, F.coalesce(q(name), F.lit(NAN)).alias(name))

    def cross(self, level: float = 0.0, n: int = 1, edge: str = "either"):
        """Where the curve crosses the level the n-th time (-1: the last)."""
        self._need_real()
        return self._answer(self._nth(self.crossings(level, edge), n, "cross"), "cross")

    def _magnitude(self) -> Column:
        return cx.mag(self._y) if self.is_complex else F.abs(self._y)

    def bandwidth(self, db: float = 3.0, type: str = "low", interp: str = "linear"):
        """Where the magnitude first falls `db` below its reference: the first sample's (low) or, from the end, the last's
        (high); for `band` the width around the peak. interp: magnitude over x, or `log`: decibels over log10 x."""
        if type not in ("low", "high", "band"):
            raise ValueError(f"type is low, high or band, not {type!r}")
        base = self.df.select(*self._keys, self._x.alias("_x"), self._magnitude().alias("_m"))
        w = Waveform(base, "_m", [*self.groups, "_x"], segments=self._segments)
        reference = {"low": F.min_by("_m", "_x"), "high": F.max_by("_m", "_x"), "band": F.max("_m")}[type]
        at_peak = F.max_by("_x", F.struct("_m", -F.col("_x")))
        refs = base.groupBy(*self._keys).agg((reference * 10 ** (-db / 20)).alias("_target"), at_peak.alias("_peak"))
        pairs = w._pairs()
        pairs = pairs.join(refs, self.groups) if self.groups else pairs.crossJoin(F.broadcast(refs))  # one row
        target, y0, y1 = F.col("_target"), F.col("_y0"), F.col("_y1")
        falls, rises = (y0 >= target) & (y1 < target), (y0 < target) & (y1 >= target)
        if interp == "log":
            db_of = lambda c: 20 * F.log10(c)
            t = (db_of(target) - db_of(y0)) / (db_of(y1) - db_of(y0))
            x = F.pow(10.0, F.log10("_x0") + t * (F.log10("_x1") - F.log10("_x0")))
        else:
            x = F.col("_x0") + (target - y0) / F.nullif(y1 - y0, F.lit(0.0)) * (F.col("_x1") - F.col("_x0"))
        if type == "low":
            found = F.min(F.when(falls, x))
        elif type == "high":
            found = F.max(F.when(rises, x))
        else:
            found = F.min(F.when(falls & (F.col("_x1") > F.col("_peak")), x)) - F.max(F.when(rises & (F.col("_x0") < F.col("_peak")), x))
        table = pairs.groupBy(*self._keys).agg(found.alias("bandwidth"))
        return self._answer(self._every_curve(table, "bandwidth"), "bandwidth")

    def unity_gain_frequency(self):
        """Where the magnitude falls through 1."""
        return self._answer(self._nth(self.crossings(1.0, "falling", self._magnitude()), 1, "unity_gain_frequency"), "unity_gain_frequency")

    def phase_margin(self):
        """180 degrees and the phase where the magnitude falls through 1."""
        both = F.struct(self._magnitude().alias("m"), cx.re(self._y).alias("re"), cx.im(self._y).alias("im"))
        p = self._pairs(both).filter("_y0.m > 1 and _y1.m <= 1")
        t = (1 - F.col("_y0.m")) / (F.col("_y1.m") - F.col("_y0.m"))
        # Phases on the line between the samples' phases, along the shorter way around.
        angle = lambda c: F.degrees(F.atan2(F.col(f"{c}.im"), F.col(f"{c}.re")))
        turn = angle("_y1") - angle("_y0")
        turn = turn - 360 * F.round(turn / 360)
        margin = 180 + angle("_y0") + t * turn
        table = p.groupBy(*self._keys).agg(F.min_by(margin, F.col("_x0")).alias("phase_margin"))
        return self._answer(self._every_curve(table, "phase_margin"), "phase_margin")

    def gain_margin(self):
        """Decibels below 1 of the magnitude where the phase first passes -180 degrees."""
        p = self._pairs()
        y0, y1 = F.col("_y0"), F.col("_y1")
        passes = (cx.im(y0) < 0) & (cx.im(y1) >= 0) & ((cx.re(y0) < 0) | (cx.re(y1) < 0))
        t = -cx.im(y0) / (cx.im(y1) - cx.im(y0))
        m = -cx.db20_real(cx.mag(y0) + t * (cx.mag(y1) - cx.mag(y0)))
        table = p.filter(passes).groupBy(*self._keys).agg(F.min_by(m, F.col("_x0")).alias("gain_margin"))
        return self._answer(self._every_curve(table, "gain_margin"), "gain_margin")

    def _ends(self, low: float, high: float) -> DataFrame:
        first, last = F.min_by(self._y, self._x), F.max_by(self._y, self._x)
        return self.df.groupBy(*self._keys).agg(first.alias("_first"), last.alias("_last")).select(*self._keys, "_first", "_last", (F.col("_first") + low * (F.col("_last") - F.col("_first"))).alias("_low"), (F.col("_first") + high * (F.col("_last") - F.col("_first"))).alias("_high"))

    def _edge(self, name: str, low: float, high: float, slope: bool):
        self._need_real()
        p, ends = self._pairs(), self._ends(low, high)
        p = p.join(ends, self.groups) if self.groups else p.crossJoin(F.broadcast(ends))  # one row
        x0, x1, y0, y1 = (F.col(c) for c in ("_x0", "_x1", "_y0", "_y1"))

        def first(level):
            c = F.col(level)
            up = F.col("_last") > F.col("_first")
            hit = F.when(up, (y0 < c) & (y1 >= c)).otherwise((y0 > c) & (y1 <= c))
            return F.min(F.when(hit, x0 + (c - y0) / F.nullif(y1 - y0, F.lit(0.0)) * (x1 - x0)))

        time = first("_high") - first("_low")
        height = F.max(F.col("_high") - F.col("_low"))
        table = p.groupBy(*self._keys).agg((height / F.nullif(time, F.lit(0.0)) if slope else time).alias(name))
        return self._answer(self._every_curve(table, name), name)

    def rise_time(self, low: float = 0.1, high: float = 0.9):
        return self._edge("rise_time", low, high, False)

    def slew_rate(self, low: float = 0.1, high: float = 0.9):
        return self._edge("slew_rate", low, high, True)

    def overshoot(self):
        """How far the curve passes its final value, in percent of the step."""
        self._need_real()
        first, last = F.min_by(self._y, self._x), F.max_by(self._y, self._x)
        over = F.when(last >= first, F.max(self._y) - last).otherwise(last - F.min(self._y))
        return self._measured("overshoot", 100 * over / F.nullif(F.abs(last - first), F.lit(0.0)))

    def settling_time(self, tolerance: float = 1.0):
        """From the first sample to the last outside a band of `tolerance` percent of the step around the final value."""
        self._need_real()
        ends = self._ends(0, 1)
        d = self.df.join(ends, self.groups) if self.groups else self.df.crossJoin(F.broadcast(ends))  # one row
        outside = F.abs(self._y - F.col("_last")) > tolerance / 100 * F.abs(F.col("_last") - F.col("_first"))
        table = d.groupBy(*self._keys).agg((F.coalesce(F.max(F.when(outside, self._x)), F.min(self._x)) - F.min(self._x)).alias("settling_time"))
        return self._answer(table, "settling_time")

    def delay(self, other: Waveform, level: float = 0.0, level2: float | None = None, n: int = 1, n2: int | None = None, type: str = "rising", type2: str | None = None):
        """From this curve's n-th crossing of the level to the other's."""
        a = self._nth(self.crossings(level, type), n, "_a")
        b = other._nth(other.crossings(level if level2 is None else level2, type2 or type), n2 or n, "_b")
        if not self.groups:
            x, y = (self._answer(t, c) for t, c in ((a, "_a"), (b, "_b")))
            return y - x
        return a.join(b, self.groups).select(*self._keys, (F.col("_b") - F.col("_a")).alias("delay"))

    def frequency(self):
        """One over the mean distance of rising crossings of the middle between the extremes."""
        self._need_real()
        middle = self.df.groupBy(*self._keys).agg(((F.max(self._real_y()) + F.min(self._real_y())) / 2).alias("_level"))
        p = self._pairs()
        p = p.join(middle, self.groups) if self.groups else p.crossJoin(F.broadcast(middle))  # one row
        c = _crossed(p, self._keys, F.col("_level"), "rising")
        table = c.groupBy(*self._keys).agg(F.when(F.count("*") > 1, (F.count("*") - 1) / F.nullif(F.max("x") - F.min("x"), F.lit(0.0))).alias("frequency"))
        return self._answer(self._every_curve(table, "frequency"), "frequency")

    def iip3(self, third: Waveform, at: float):
        """The input intercept of this fundamental and the third-order product, both in dB over input dB, extrapolated from `at` with slopes 1 and 3."""
        a, b = self.value(at), third.value(at)
        if not self.groups:
            return at + (a - b) / 2
        joined = a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), self.groups)
        return joined.select(*self._keys, (F.lit(float(at)) + (F.col("_a") - F.col("_b")) / 2).alias("iip3"))

    IIP3 = iip3

    def dft(self) -> Waveform:
        """Single-sided amplitudes over frequency. The axis must be even; a curve's samples must fit in a task's memory."""
        self._need_real()
        groups, x, y = self.groups, self.xname, self.yname

        def spectrum(table):
            import pyarrow as pa

            table = table.sort_by("_x")
            t, v = table["_x"].to_numpy(), table["_y"].to_numpy()
            n = len(v)
            step = (t[-1] - t[0]) / (n - 1) if n > 1 else 1.0
            if n > 2 and np.abs(np.diff(t) - step).max() > 1e-3 * abs(step):
                raise ValueError("dft needs an even axis; interpolate first")
            amplitude = np.abs(np.fft.rfft(v)) / n
            amplitude[1 : (n + 1) // 2] *= 2
            out = {g: pa.array([table[g][0].as_py()] * len(amplitude), table[g].type) for g in groups}
            return pa.table(out | {"freq": np.fft.rfftfreq(n, step), y: amplitude})

        d = self.df.select(*self._keys, self._x.cast("double").alias("_x"), self._y.cast("double").alias("_y"))
        schema = ", ".join([*[f"{q(g)} {self.df.schema[g].dataType.simpleString()}" for g in groups], "freq double", f"{q(y)} double"])
        df = d.groupBy(*self._keys).applyInArrow(spectrum, schema)
        return Waveform(df, y, [*groups, "freq"], {"freq": "Hz" if self.xunit == "s" else None, y: self.yunit})

    # Names of the calculator.
    unityGainFreq = unityGainFrequency = unity_gain_frequency
    phaseMargin, gainMargin, riseTime, slewRate, settlingTime = phase_margin, gain_margin, rise_time, slew_rate, settling_time
    leafValue = leaf

    @classmethod
    def from_series(cls, spark, x, y, xname: str = "x", yname: str = "y", units: dict | None = None) -> Waveform:
        x, y = np.asarray(x, float), np.asarray(y)
        rows = [(float(a), T.Row(re=float(b.real), im=float(b.imag)) if np.iscomplexobj(y) else float(b)) for a, b in zip(x, y, strict=True)]
        kind = "struct<re:double,im:double>" if np.iscomplexobj(y) else "double"
        return cls(spark.createDataFrame(rows, f"{q(xname)} double, {q(yname)} {kind}"), yname, [xname], units, len(rows))

    @classmethod
    def from_nested(cls, df: DataFrame, x: str, y: str, groups: list[str] = (), units: dict | None = None) -> Waveform:
        """From a table with a row for each curve and arrays of x and y."""
        rows = df.select(*map(q, groups), F.inline(F.arrays_zip(F.col(q(x)).alias(x), F.col(q(y)).alias(y))))
        return cls(rows, y, [*groups, x], units)


SYMBOLS = {"add": "+", "sub": "-", "mul": "*", "div": "/", "pow": "**"}


def arithmetic(operation: str, a: Column, b: Column, a_complex: bool, b_complex: bool) -> Column:
    if a_complex or b_complex:
        a, b = a if a_complex else cx.complex_(a), b if b_complex else cx.complex_(b)
        return {"add": cx.add, "sub": cx.sub, "mul": cx.mul, "div": cx.div}[operation](a, b)
    if operation == "div":
        return cx.ratio(a.cast("double"), b.cast("double"))
    return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b}[operation]()


def _crossed(pairs: DataFrame, keys: list[Column], level: Column, edge: str) -> DataFrame:
    """Of pairs of neighbours: those that pass the level, and where."""
    y0, y1 = F.col("_y0"), F.col("_y1")
    up, down = (y0 < level) & (y1 >= level), (y0 > level) & (y1 <= level)
    some = {"rising": up, "falling": down, "either": up | down}[edge]
    x = F.col("_x0") + (level - y0) / F.nullif(y1 - y0, F.lit(0.0)) * (F.col("_x1") - F.col("_x0"))
    return pairs.filter(some).select(*keys, x.alias("x"), up.alias("rising"))


def column_to_numpy(df: DataFrame, name: str) -> np.ndarray:
    column = df.toArrow()[name].combine_chunks()
    if column.type.num_fields == 2 and [column.type.field(i).name for i in range(2)] == ["re", "im"]:
        re, im = (column.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        return re + 1j * im
    if column.type.num_fields:
        return np.array(column.to_pylist(), dtype=object)
    return column.to_numpy(zero_copy_only=False)
