"""Result files of 32-bit big-endian words: row records, windows, and values without a sweep."""

from __future__ import annotations

import os
import struct
from functools import cached_property

import numpy as np

from .model import FormatError, Kind, ResultFile, Signal, distinct_names, read_bytes

#: Fixed values of the format: chunk codes, codes of scalar types, codes that a header may begin with.
DECLARATION, GROUP, END_MEMBERS, PADDING, FORWARD, BACKWARD = 0x10, 0x11, 0x12, 0x14, 0x15, 0x16
STRING_PROP, INT_PROP, DOUBLE_PROP, INDEX = 0x21, 0x22, 0x23, 0x24
SCALARS = {1: "int8", 5: "int32", 9: "float32", 10: "complex64", 11: "float64", 12: "complex128"}
STRUCT_CODE = 16
HEADER_CODES = (0x0, 0x200, 0x300, 0x400, 0x500)
TYPES, SWEEPS, TRACES, VALUES, TABLE = 1, 2, 3, 4, 0xF


def disk_dtype(kind: Kind) -> np.dtype:
    """A value's layout in the file: bytes take a whole word."""
    if kind.name == "struct":
        return np.dtype([(n, disk_dtype(k)) for n, k in kind.members])
    if kind.name == "array":
        return np.dtype((disk_dtype(kind.item), (kind.length,)))
    return np.dtype({"int8": ">i4", "int32": ">i4", "float32": ">f4", "float64": ">f8", "complex64": ">c8", "complex128": ">c16"}[kind.name])


class Words:
    """A place in the bytes."""

    def __init__(self, data, at: int = 0):
        self.data, self.at = data, at

    def u32(self) -> int:
        if self.at + 4 > len(self.data):
            raise FormatError("the file ends early")
        self.at += 4
        return int.from_bytes(self.data[self.at - 4 : self.at], "big")

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at : self.at + 4], "big") if self.at + 4 <= len(self.data) else -1

    def unpack(self, form: str):
        n = struct.calcsize(form)
        if self.at + n > len(self.data):
            raise FormatError("the file ends early")
        self.at += n
        return struct.unpack(form, self.data[self.at - n : self.at])

    def string(self) -> str:
        n = self.u32()
        if n > len(self.data) - self.at:
            raise FormatError("a string passes the end of the file")
        raw = bytes(self.data[self.at : self.at + n])
        self.at += n + -n % 4
        return raw.split(b"\0")[0].decode("utf-8", "replace")

    def props(self) -> list[tuple[str, object]]:
        out = []
        while (code := self.peek()) in (STRING_PROP, INT_PROP, DOUBLE_PROP):
            self.u32()
            name = self.string()
            out.append((name, self.string() if code == STRING_PROP else self.unpack(">i" if code == INT_PROP else ">d")[0]))
        return out


def looks_binary(data) -> bool:
    w = Words(data)
    return len(data) >= 8 and w.u32() in HEADER_CODES and w.u32() in (FORWARD, BACKWARD)


class BinaryFile(ResultFile):
    format = "psfbin"

    def __init__(self, path: str, data=None):
        super().__init__(path)
        self.data = read_bytes(path) if data is None else data
        self.types: dict[int, tuple[str, Kind, list]] = {}
        self.groups: dict[int, list[Signal]] = {}
        self.index: dict[str, tuple] = {}
        self._entries: list[tuple[int, int, list[Signal]]] = []  # (chunk code, id, its traces)
        self.value_start, self.value_end = None, len(self.data)
        try:
            self._sections()
        except (struct.error, UnicodeDecodeError, OverflowError) as e:
            raise FormatError(f"{path}: {e}") from None
        self.renamed = distinct_names(self.traces)
        self.window = self.header.get("PSF window size")
        self.layout = "psfxl" if self.index else "nonswept" if not self.sweep else "windowed" if self.window else "rows"
        if self.index:
            self.format = "psfxl"

    def _sections(self) -> None:
        if not looks_binary(self.data):
            raise FormatError(f"{self.path}: not a result file")
        start, code = 4, 0
        while True:
            w, after, end = Words(self.data, start), None, None
            while w.peek() in (FORWARD, BACKWARD):
                if w.u32() == FORWARD:
                    after = w.u32()
                else:
                    end = w.u32()
            self._section(code, w, end)
            if after is None or not start < after <= len(self.data):
                return
            code = int.from_bytes(self.data[after - 4 : after], "big")
            if code == TABLE:
                return
            start = after

    def _section(self, code: int, w: Words, end: int | None) -> None:
        if code == 0:
            self.header_pairs = w.props()
        elif code == TYPES:
            while w.peek() == DECLARATION:
                self._type(w)
        elif code in (SWEEPS, TRACES):
            found = []
            while w.peek() in (DECLARATION, GROUP):
                chunk = w.u32()
                if chunk == GROUP:
                    gid, _, n = w.u32(), w.string(), w.u32()
                    members = []
                    for _ in range(n):
                        if w.u32() != DECLARATION:
                            raise FormatError(f"{self.path}: a group's member is no declaration")
                        members.append(self._trace(w))
                    self._entries.append((GROUP, gid, members))
                    found += members
                else:
                    s = self._trace(w)
                    if code == TRACES:
                        self._entries.append((DECLARATION, s.id, [s]))
                    found.append(s)
            if code == TRACES:
                self.traces = found
            elif len(found) > 1:
                raise FormatError(f"{self.path}: {len(found)} sweep variables")
            else:
                self.sweep = found[0] if found else None
        elif code == VALUES:
            self.value_start = w.at
            if end and w.at <= end <= len(self.data):
                self.value_end = end

    def _type(self, w: Words, depth: int = 0) -> tuple[str, Kind]:
        if depth > 32:
            raise FormatError(f"{self.path}: types nest too deeply")
        w.u32()
        tid, name = w.u32(), w.string()
        dims = [w.u32() for _ in range(min(w.u32(), 64))]
        code = w.u32()
        if code == STRUCT_CODE:
            members = []
            while w.peek() == DECLARATION:
                members.append(self._type(w, depth + 1))
            if w.u32() != END_MEMBERS:
                raise FormatError(f"{self.path}: a struct's members don't end")
            kind = Kind("struct", tuple(members))
        elif code in SCALARS:
            kind = Kind(SCALARS[code])
        else:
            raise FormatError(f"{self.path}: unsupported type code {code}")
        if dims:
            kind = Kind("array", item=kind, length=int(np.prod(dims)))
        self.types[tid] = (name, kind, w.props())
        return name, kind

    def _trace(self, w: Words) -> Signal:
        tid, name, kind = w.u32(), w.string(), w.u32()
        if kind not in self.types:
            raise FormatError(f"{self.path}: {name} has the unknown type {kind}")
        if w.peek() == INDEX:
            w.u32()
            self.index[name] = w.unpack(">QQdddd")
        type_name, of, props = self.types[kind]
        return Signal(name, of, w.props() + props, tid, type_name)

    # Swept values.
    def _present(self) -> list[tuple[int, int, list[Signal]]]:
        """What the first record holds after the sweep's value."""
        by_tag = {(c, i): (c, i, t) for c, i, t in self._entries}
        at, out = self.value_start + 8 + disk_dtype(self.sweep.kind).itemsize, []
        while at + 8 <= self.value_end:
            w = Words(self.data, at)
            entry = by_tag.get((w.u32(), w.u32()))
            if entry is None or entry in out:
                break
            out.append(entry)
            at += 8 + sum(disk_dtype(s.kind).itemsize for s in entry[2])
        return out

    @cached_property
    def _records(self) -> tuple[int, int, dict[str, int]] | None:
        """(points, bytes of a record, each signal's place in it) where all records are alike; else None."""
        at, tags, places = 8, [], {}
        sweep_size = disk_dtype(self.sweep.kind).itemsize
        at += sweep_size
        for code, tid, traces in self._present():
            tags.append((at, code, tid))
            at += 8
            for t in traces:
                places[t.name] = at
                at += disk_dtype(t.kind).itemsize
        n = (self.value_end - self.value_start) // at

        def tagged(place, code, tid, step=1):
            pair = np.ndarray((len(range(0, n, step)), 2), ">u4", self.data, self.value_start + place, (at * step, 4))
            return (pair[:, 0] == code) & (pair[:, 1] == tid)

        if n:
            good = tagged(0, DECLARATION, self.sweep.id)
            n = n if good.all() else int(good.argmin())
        step = max(1, min(1024, n // 8))
        if n and not all(tagged(p, c, i, step).all() for p, c, i in tags):
            return None
        rest = self.value_start + n * at
        if rest + 8 <= self.value_end and self.value_end - rest >= at and Words(self.data, rest).u32() in (DECLARATION, GROUP):
            return None
        return n, at, places

    def declared_only(self):
        if self.layout != "rows" or self.value_start is None or self._records is None or not self._records[0]:
            return set()
        return {s.name for s in self.traces if s.name not in self._records[2]}

    def _rows(self, names: list[str]):
        if self._records is None:
            return self._walk(names)
        n, size, places = self._records

        def gather(kind: Kind, place: int | None):
            if place is None or not n:  # declared only
                return np.empty(0, kind.dtype())
            view = np.frombuffer(self.data, np.uint8, n * size, self.value_start)
            d = disk_dtype(kind)
            return np.ndarray((n,), d, view, place, (size,)).astype(kind.dtype()) if not d.subdtype else np.ndarray((n, *d.shape), d.base, view, place, (size, *np.empty(d.shape, d.base).strides)).astype(kind.item.dtype())

        return gather(self.sweep.kind, 8), {m: gather(self.signal(m).kind, places.get(m)) for m in names}

    def column(self, name, member=None):
        """A member of a struct is read alone where records are alike."""
        if member is not None and self.layout == "rows" and self._records is not None:
            kind, offset = self.signal(name).kind, 0
            n, size, places = self._records
            for m, k in kind.members:
                if m == member and name in places and n:
                    view = np.frombuffer(self.data, np.uint8, n * size, self.value_start)
                    return self._rows([])[0], np.ndarray((n,), disk_dtype(k), view, places[name] + offset, (size,)).astype(k.dtype())
                offset += disk_dtype(k).itemsize
        if self.layout == "psfxl":
            from .xl_format import signal

            self.signal(name)
            x, y = signal(self, name)
            return x, y if member is None else y[member]
        return super().column(name, member)

    def _walk(self, names: list[str]):
        """Records of differing make-up, tag by tag; an unfinished last point is left out."""
        by_tag = {(c, i): t for c, i, t in self._entries}
        xs, ys, w = [], {s.name: [] for s in self.traces}, Words(self.data, self.value_start)
        while w.at + 8 <= self.value_end:
            c, i = w.u32(), w.u32()
            if (c, i) == (DECLARATION, self.sweep.id):
                signals, out = [self.sweep], [xs]
            elif (c, i) in by_tag:
                signals = by_tag[c, i]
                out = [ys[s.name] for s in signals]
            else:
                break
            for s, to in zip(signals, out, strict=True):
                d = disk_dtype(s.kind)
                if w.at + d.itemsize > self.value_end:
                    w.at = self.value_end
                    break
                to.append(np.frombuffer(self.data, d, 1, w.at).astype(s.kind.dtype())[0])
                w.at += d.itemsize
        full = [len(v) for v in ys.values() if v]
        n = min([len(xs), *full])
        column = lambda kind, v: np.array(v[:n], kind.dtype()) if v else np.empty(0, kind.dtype())
        return column(self.sweep.kind, xs), {m: column(self.signal(m).kind, ys[m]) for m in names}

    @cached_property
    def _windows(self) -> list[tuple[int, int]]:
        """(place of the sweep's values, points) of each whole window."""
        out, w, size = [], Words(self.data, self.value_start or self.value_end), disk_dtype(self.sweep.kind).itemsize
        widest = max((disk_dtype(t.kind).itemsize for t in self.traces), default=0)
        while w.at + 8 <= self.value_end:
            code = w.u32()
            if code == PADDING:
                skip = w.u32()
                w.at += skip
                continue
            if code != DECLARATION:
                break
            n = w.u32() & 0xFFFF
            at = w.at
            if n * widest > self.window:
                raise FormatError(f"{self.path}: {n} points don't fit in a window of {self.window} bytes")
            w.at += n * size + self.window * len(self.traces)
            if w.at > self.value_end:
                self.cut_off = True
                break
            out.append((at, n))
        return out

    def _windowed(self, names: list[str]):
        order = {s.name: k for k, s in enumerate(self.traces)}
        wide = disk_dtype(self.sweep.kind)

        def gather(kind: Kind, places):
            d, parts = disk_dtype(kind), [np.frombuffer(self.data, disk_dtype(kind), n, at) for at, n in places]
            return (np.concatenate(parts) if parts else np.empty(0, d)).astype(kind.dtype())

        def blocks(name):
            kind = self.signal(name).kind
            for at, n in self._windows:
                yield at + n * wide.itemsize + (order[name] + 1) * self.window - n * disk_dtype(kind).itemsize, n

        x = gather(self.sweep.kind, self._windows)
        planned = self.header.get("PSF sweep points")
        if planned and not self.cut_off and len(x) != planned:
            raise FormatError(f"{self.path}: {len(x)} points where the header announces {planned}")
        return x, {m: gather(self.signal(m).kind, blocks(m)) for m in names}

    def columns(self, names):
        if not self.sweep:
            raise FormatError(f"{self.path}: not swept")
        for n in names:
            self.signal(n)
        if self.layout == "psfxl":
            from .xl_format import columns

            return columns(self, names)
        if self.value_start is None:
            return np.empty(0, self.sweep.kind.dtype()), {n: np.empty(0, self.signal(n).kind.dtype()) for n in names}
        return self._windowed(names) if self.window else self._rows(names)

    def points(self) -> int:
        if self.layout == "psfxl":
            return max((v[1] for v in self.index.values()), default=0)
        planned = self.header.get("PSF sweep points")
        return len(self.columns([])[0]) if not planned or self.layout == "rows" else min(planned, sum(n for _, n in self._windows))

    @property
    def is_complete(self) -> bool:
        if self.layout == "psfxl":
            stop = self.header.get("stop")
            return stop is None or all(v[3] >= stop * (1 - 1e-9) for v in self.index.values())
        return super().is_complete

    @property
    def meta(self):
        if self.layout != "psfxl" or not os.path.exists(self.path + ".sig"):
            return {}
        from .xl_format import metadata

        return metadata(self.path)

    # Values without a sweep.
    @cached_property
    def _offsets(self) -> list[tuple[Signal, int]]:
        out, w = [], Words(self.data, self.value_start if self.value_start is not None else self.value_end)
        while not self.is_swept and w.at < self.value_end and w.peek() == DECLARATION:
            w.u32()
            vid, name, tid = w.u32(), w.string(), w.u32()
            if tid not in self.types:
                raise FormatError(f"{self.path}: {name} has the unknown type {tid}")
            type_name, kind, props = self.types[tid]
            at = w.at
            w.at += disk_dtype(kind).itemsize
            if w.at > self.value_end:
                break
            out.append((Signal(name, kind, w.props() + props, vid, type_name), at))
        return out

    def value_signals(self):
        return [s for s, _ in self._offsets]

    @cached_property
    def _value_places(self) -> dict[str, tuple[Signal, int]]:
        return {s.name: (s, at) for s, at in reversed(self._offsets)}

    def value(self, name):
        s, at = self._value_places[name]
        return python_value(s.kind, np.frombuffer(self.data, disk_dtype(s.kind), 1, at)[0])


def python_value(kind: Kind, v):
    if kind.name == "struct":
        return {n: python_value(k, v[n]) for n, k in kind.members}
    if kind.name == "array":
        return [python_value(kind.item, x) for x in v]
    return v.item()
