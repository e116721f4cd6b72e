"""What every result file has in common: typed declarations, columns, and their Spark and Arrow forms."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T


class FormatError(ValueError):
    """A malformed or unsupported result file."""


@dataclass(frozen=True)
class Kind:
    """A value type. name: int8, int32, float32, float64, complex64, complex128, string, array or struct."""

    name: str
    members: tuple[tuple[str, Kind], ...] = ()
    item: Kind | None = None
    length: int | None = None

    @property
    def is_complex(self) -> bool:
        return self.name.startswith("complex")

    def dtype(self) -> np.dtype:
        if self.name == "struct":
            return np.dtype([(n, k.dtype()) for n, k in self.members])
        if self.name == "array":
            return np.dtype((self.item.dtype(), (self.length or 0,)))
        return np.dtype("O" if self.name == "string" else self.name)

    def spark(self) -> T.DataType:
        """Nullable throughout, as what comes from Arrow functions is; there are no nulls."""
        if self.is_complex:
            part = T.FloatType() if self.name == "complex64" else T.DoubleType()
            return T.StructType([T.StructField("re", part), T.StructField("im", part)])
        if self.name == "struct":
            return T.StructType([T.StructField(n, k.spark()) for n, k in self.members])
        if self.name == "array":
            return T.ArrayType(self.item.spark())
        return {"int8": T.ByteType(), "int32": T.IntegerType(), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType()}[self.name]

    def arrow(self, a: np.ndarray) -> pa.Array:
        """A column of this type."""
        if self.is_complex:
            return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(a.real)), pa.array(np.ascontiguousarray(a.imag))], ["re", "im"])
        if self.name == "struct":
            return pa.StructArray.from_arrays([k.arrow(np.ascontiguousarray(a[n])) for n, k in self.members], [n for n, _ in self.members])
        if self.name == "array":
            flat = self.item.arrow(np.ascontiguousarray(a).reshape(-1))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * self.length), flat)
        return pa.array(list(a), pa.string()) if self.name == "string" else pa.array(np.ascontiguousarray(a))


#: The scalar types by their declaration in text files.
TEXT_KINDS = {"FLOAT DOUBLE": Kind("float64"), "FLOAT SINGLE": Kind("float32"), "COMPLEX DOUBLE": Kind("complex128"), "COMPLEX SINGLE": Kind("complex64"), "INT BYTE": Kind("int8"), "INT LONG": Kind("int32"), "STRING *": Kind("string")}


@dataclass
class Signal:
    """A sweep variable, a trace or a non-swept value."""

    name: str
    kind: Kind
    props: list[tuple[str, object]] = field(default_factory=list)
    id: int | None = None
    type_name: str = ""


def first_wins(pairs) -> dict:
    out = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


def distinct_names(signals: list[Signal]) -> list[tuple[str, str]]:
    """Renames repeated traces `name#<id>` (the place where there's no id), with `_` appended until free. Gives (old, new)."""
    taken, renamed, seen = {s.name for s in signals}, [], set()
    for i, s in enumerate(signals):
        if s.name in seen:
            new = f"{s.name}#{i if s.id is None else s.id}"
            while new in taken:
                new += "_"
            renamed.append((s.name, new))
            taken.add(new)
            s.name = new
        seen.add(s.name)
    return renamed


class ResultFile:
    """One result file. Formats fill in the declarations and read columns; nothing is read before it's asked for."""

    format = layout = ""
    #: Whether the file ends within a window, as that of a running or stopped simulation does.
    cut_off = False

    def __init__(self, path: str):
        self.path = path
        self.header_pairs: list[tuple[str, object]] = []
        self.sweep: Signal | None = None
        self.traces: list[Signal] = []
        self.renamed: list[tuple[str, str]] = []

    @cached_property
    def header(self) -> dict:
        return first_wins(self.header_pairs)

    @property
    def is_swept(self) -> bool:
        return self.sweep is not None

    @property
    def sweep_name(self) -> str | None:
        return self.sweep.name if self.sweep else None

    @cached_property
    def _by_name(self) -> dict[str, Signal]:
        return {s.name: s for s in (self.traces if self.is_swept else self.value_signals())}

    @property
    def names(self) -> list[str]:
        return list(self._by_name)

    def names_with_field(self, member: str) -> list[str]:
        return [n for n, s in self._by_name.items() if s.kind.name == "struct" and member in dict(s.kind.members)]

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def signal(self, name: str) -> Signal:
        if self.sweep and name == self.sweep.name:
            return self.sweep
        if name not in self._by_name:
            raise KeyError(name)
        return self._by_name[name]

    def props(self, name: str) -> dict:
        s = self.signal(name)
        return first_wins(s.props) | ({"type": s.type_name} if s.type_name else {})

    def units(self, name: str) -> str | None:
        return self.props(name).get("units") or None

    @property
    def is_complete(self) -> bool:
        planned = self.header.get("PSF sweep points")
        return not self.is_swept or not planned or self.points() >= planned

    def points(self) -> int:
        return len(self.columns([])[0])

    def __len__(self) -> int:
        """How many signals there are."""
        return len(self._by_name)

    @property
    def meta(self) -> dict[str, str]:
        """What stands in a file of metadata beside the file, if there is one."""
        return {}

    def schema(self, names: list[str] | None = None) -> pa.Schema:
        """Of the wide table: the sweep and the signals. Nothing is read."""
        signals = [self.signal(n) for n in (self.names if names is None else names)]
        return _arrow_schema([(s.name, s.kind) for s in ([self.sweep] if self.sweep else []) + signals])

    def long_schema(self, member: str | None = None) -> pa.Schema:
        """Of the long table: the sweep, `signal`, and `value` of the first signal's type."""
        if not self.is_swept:
            raise FormatError(f"{self.path}: not swept")
        names = self.names if member is None else self.names_with_field(member)
        if not names:
            raise KeyError(member)
        return _arrow_schema([(self.sweep.name, self.sweep.kind), ("signal", Kind("string")), ("value", self.kind_of(names[0], member))])

    # Formats fill these in.
    def value_signals(self) -> list[Signal]:
        """Of a file without sweep: its values' declarations."""
        return []

    def value(self, name: str):
        raise KeyError(name)

    def values(self) -> dict:
        return {n: self.value(n) for n in self.names}

    def columns(self, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The sweep's values, and those of the traces named."""
        raise FormatError(f"{self.path}: no swept values")

    def declared_only(self) -> set[str]:
        """Traces without values, as parents of sweeps may have. Told without reading values."""
        return set()

    def column(self, name: str, member: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sweep, values) of one trace, or of a member of a struct trace."""
        x, y = self.columns([name])
        return x, y[name] if member is None else y[name][member]

    def kind_of(self, name: str, member: str | None = None) -> Kind:
        kind = self.signal(name).kind
        if member is None:
            return kind
        if kind.name != "struct" or member not in dict(kind.members):
            raise KeyError(f"{name} has no member {member!r}")
        return dict(kind.members)[member]


def _arrow_schema(columns: list[tuple[str, Kind]]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType([T.StructField(n, k.spark()) for n, k in columns]))


def read_bytes(path: str):
    """The file's bytes: mapped where it is local, else read through Arrow's file systems."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_file(inner) as f:
            return f.read()
    import mmap

    path = path.removeprefix("file://")
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(path) else b""
