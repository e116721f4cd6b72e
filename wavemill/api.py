"""The names most uses need, in one place."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .functions import complexes as cx
from .operators.calculator import *  # noqa: F403
from .operators.calculator import __all__ as _measurements
from .operators.waveform import Waveform
from .sources.dataset import Dataset, Result
from .sources.files import open_file
from .sources.model import FormatError, ResultFile
from .sources.names import NameMap

__all__ = ["Dataset", "FormatError", "NameMap", "Result", "Waveform", "cx", "openResults", "open_file", "open_results", "read_table", "wave", "waves", *_measurements]


def open_results(spark: SparkSession, path: str | os.PathLike, netlist: str | os.PathLike | None = None) -> Dataset:
    return Dataset(spark, path, netlist)


openResults = open_results


def _dataset(spark, source) -> Dataset:
    return source if isinstance(source, Dataset) else Dataset(spark, source)


def wave(spark: SparkSession, source, signal: str, result: str | None = None, **params) -> Waveform:
    return _dataset(spark, source).wave(signal, result, **params)


def waves(spark: SparkSession, source, names=None, result: str | None = None, **params) -> dict[str, Waveform]:
    return _dataset(spark, source).waves(names, result, **params)


def arrow_table(file: ResultFile, names: list[str] | None = None) -> pa.Table:
    """A swept file's sweep and signals, or one row of a file without sweep, read here and now."""
    names = list(file.names if names is None else names)
    if not file.is_swept:
        kinds = {n: file.signal(n).kind for n in names}
        names = [n for n in names if not (kinds[n].name == "array" and kinds[n].length is None)]
        values = {n: file.value(n) for n in names}
        return pa.table({n: pa.array([{"re": v.real, "im": v.imag} if isinstance(v, complex) else v]) for n, v in values.items()})
    x, ys = file.columns(names)
    full = [n for n in names if len(ys[n]) == len(x)]  # declared only: left out
    return pa.table([file.sweep.kind.arrow(x), *(file.signal(n).kind.arrow(ys[n]) for n in full)], names=[file.sweep_name, *full])


def read_table(spark: SparkSession, path: str | os.PathLike, names: list[str] | None = None) -> DataFrame:
    """One file, read by the driver: for small files, without a job of decoding."""
    return spark.createDataFrame(arrow_table(open_file(path), names))
