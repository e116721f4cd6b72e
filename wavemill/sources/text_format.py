"""Result files as text: sections HEADER, TYPE, SWEEP, TRACE, VALUE and END."""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np

from .model import TEXT_KINDS, FormatError, Kind, ResultFile, Signal, distinct_names, read_bytes

_TOKEN = re.compile(r'"((?:[^"\\]|\\"|\\(?!"))*)"|([()])|([^\s()"]+)')
_SECTIONS = ("HEADER", "TYPE", "SWEEP", "TRACE", "VALUE", "END")


def tokens(text: str):
    """('s', string), ('p', parenthesis) or ('w', word). In strings only `\\"` is an escape."""
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        if text[at : m.start()].strip():
            raise FormatError(f"unexpected {text[at : m.start()].strip()[:20]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("s", m[1].replace('\\"', '"')))
        else:
            out.append(("p", m[2]) if m[2] else ("w", m[3]))
    if text[at:].strip():
        raise FormatError(f"unexpected {text[at:].strip()[:20]!r}")
    return out


class Reader:
    """A place in a list of tokens."""

    def __init__(self, items):
        self.items, self.at = items, 0

    def more(self) -> bool:
        return self.at < len(self.items)

    def peek(self, ahead: int = 0):
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if not k or (kind and k != kind) or (value is not None and v != value):
            raise FormatError(f"expected {value or kind}, found {v!r}" if k else "the file ends early")
        self.at += 1
        return v

    def props(self) -> list[tuple[str, object]]:
        if self.peek() != ("w", "PROP"):
            return []
        self.take()
        self.take("p", "(")
        out = []
        while self.peek() != ("p", ")"):
            out.append((self.take("s"), self.scalar()))
        self.take()
        return out

    def scalar(self):
        kind, value = self.peek()
        self.take()
        return value if kind == "s" else number(value)

    def kind(self) -> Kind:
        word = self.take("w")
        if word == "STRUCT":
            self.take("p", "(")
            members = []
            while self.peek() != ("p", ")"):
                name = self.take("s")
                members.append((name, self.kind()))
                self.props()
            self.take()
            return Kind("struct", tuple(members))
        if word == "ARRAY":
            self.take("p", "(")
            size = self.take("w")
            self.take("p", ")")
            return Kind("array", item=self.kind(), length=None if size == "*" else int(size))
        name = f"{word} {self.take('w')}"
        if name not in TEXT_KINDS:
            raise FormatError(f"unsupported type {name}")
        return TEXT_KINDS[name]

    def value(self, kind: Kind):
        """A value of a type: number, complex, string, tuple of members or list."""
        if kind.name in ("struct", "array") or kind.is_complex:
            if kind.is_complex and self.peek() != ("p", "("):
                return complex(number(self.take("w")), 0)
            self.take("p", "(")
            if kind.is_complex:
                out = complex(number(self.take("w")), number(self.take("w")))
            elif kind.name == "struct":
                out = tuple(self.value(k) for _, k in kind.members)
            else:
                out = []
                while self.peek() != ("p", ")"):
                    out.append(self.value(kind.item))
            self.take("p", ")")
            return out
        if kind.name == "string":
            return self.take("s")
        x = number(self.take("w"))
        if kind.name.startswith("int"):
            if x != int(x):
                raise FormatError(f"{x} is no integer")
            return int(x)
        return float(x)


def number(word: str):
    try:
        return int(word) if re.fullmatch(r"[+-]?\d+", word) else float(word)
    except ValueError:
        raise FormatError(f"{word!r} is no number") from None


def plain(kind: Kind, value):
    """A value as Python objects: structs as dicts."""
    if kind.name == "struct":
        return {n: plain(k, v) for (n, k), v in zip(kind.members, value, strict=True)}
    if kind.name == "array":
        return [plain(kind.item, v) for v in value]
    return value


def flat_width(kind: Kind) -> int | None:
    """Number of words of a value written without its parentheses; None where it varies or isn't numeric."""
    if kind.name == "struct":
        parts = [flat_width(k) for _, k in kind.members]
        return None if None in parts else sum(parts)
    if kind.name == "array":
        inner = flat_width(kind.item)
        return None if inner is None or kind.length is None else inner * kind.length
    return None if kind.name == "string" else 2 if kind.is_complex else 1


def from_flat(kind: Kind, words: np.ndarray) -> np.ndarray:
    """A column from its numbers, one row a value."""
    if kind.name == "struct":
        out, at = np.empty(len(words), kind.dtype()), 0
        for name, k in kind.members:
            n = flat_width(k)
            out[name] = from_flat(k, words[:, at : at + n])
            at += n
        return out
    if kind.name == "array":
        n = flat_width(kind.item)
        return np.stack([from_flat(kind.item, words[:, i * n : (i + 1) * n]) for i in range(kind.length)], axis=1)
    if kind.is_complex:
        return (words[:, 0] + 1j * words[:, 1]).astype(kind.dtype())
    return words[:, 0].astype(kind.dtype())


class TextFile(ResultFile):
    format = layout = "ascii"

    def __init__(self, path: str, data: bytes | None = None):
        super().__init__(path)
        text = bytes(read_bytes(path) if data is None else data).decode("utf-8", "replace")
        parts = dict.fromkeys(_SECTIONS, "")
        marks = [(m.start(), m.end(), m[1]) for m in re.finditer(r"^(HEADER|TYPE|SWEEP|TRACE|VALUE|END)[ \t\r]*$", text, re.M)]
        if not marks or marks[0][2] != "HEADER" or text[: marks[0][0]].strip():
            raise FormatError(f"{path}: no HEADER")
        for i, (_, end, name) in enumerate(marks):
            parts[name] += text[end : marks[i + 1][0] if i + 1 < len(marks) else len(text)]
            if name == "VALUE":  # its strings may hold such lines
                stop = re.search(r"^END[ \t\r]*$", text[end:], re.M)
                parts[name] = text[end : end + stop.start() if stop else len(text)]
                break
        r = Reader(tokens(parts["HEADER"]))
        while r.more():
            self.header_pairs.append((r.take("s"), r.scalar()))
        self.types: dict[str, Kind] = {}
        self.type_props: dict[str, list] = {}
        r = Reader(tokens(parts["TYPE"]))
        while r.more():
            name = r.take("s")
            self.types[name] = r.kind()
            self.type_props[name] = r.props()
        sweeps = self._declared(Reader(tokens(parts["SWEEP"])))[0]
        if len(sweeps) > 1:
            raise FormatError(f"{path}: {len(sweeps)} sweep variables")
        self.sweep = sweeps[0] if sweeps else None
        self.traces, self._groups = self._declared(Reader(tokens(parts["TRACE"])))
        self._text = parts["VALUE"]
        self._tags = [s.name for s in self.traces]  # as they stand in the values
        self.renamed = distinct_names(self.traces)

    def _declared(self, r: Reader):
        out, groups = [], []  # groups: (name, number of members) in place of what precedes them
        while r.more():
            name = r.take("s")
            if r.peek() == ("w", "GROUP"):
                r.take()
                n = int(r.take("w"))
                groups.append((name, len(out), n))
                for _ in range(n):
                    out.append(self._one(r, r.take("s")))
            else:
                out.append(self._one(r, name))
        return out, groups

    def _one(self, r: Reader, name: str) -> Signal:
        kind = r.take("s")
        if kind not in self.types:
            raise FormatError(f"{self.path}: {name} has the unknown type {kind}")
        own = r.props()
        return Signal(name, self.types[kind], own + self.type_props[kind], type_name=kind)

    def _entries(self) -> list[tuple[str, list[int]]]:
        """(tag, places of the traces) of what follows the sweep's value in a record."""
        out, i, groups = [], 0, {start: (name, n) for name, start, n in self._groups}
        while i < len(self.traces):
            name, n = groups.get(i, (self._tags[i], 1))
            out.append((name, list(range(i, i + n))))
            i += n
        return out

    @cached_property
    def _swept(self) -> tuple[np.ndarray, list[np.ndarray]]:
        fast = self._regular()
        return fast if fast is not None else self._walked()

    def _regular(self):
        """All records alike and numeric: columns are strides of one array of words."""
        entries = self._entries()
        kinds = [self.sweep.kind, *(s.kind for s in self.traces)]
        widths = [flat_width(k) for k in kinds]
        if None in widths or "\\" in self._text:
            return None
        words = re.findall(r'"[^"]*"|[^\s()"]+', self._text)
        stride = 1 + widths[0] + sum(1 + sum(widths[1 + i] for i in at) for _, at in entries)
        if len(words) % stride:
            return None
        n = len(words) // stride
        table = np.array(words, dtype=object).reshape(n, stride) if n else np.empty((0, stride), object)
        at, spans = 0, []
        for tag, places in [(self.sweep.name, [-1]), *entries]:
            if n and not (table[:, at] == f'"{tag}"').all():
                return None
            at += 1
            for i in places:
                spans.append((at, at + widths[1 + i]))
                at += widths[1 + i]
        try:
            columns = [from_flat(k, table[:, a:b].astype(float)) for k, (a, b) in zip(kinds, spans, strict=True)]
        except ValueError:
            return None
        return columns[0], columns[1:]

    def _walked(self):
        r = Reader(tokens(self._text))
        by_tag = {}
        for tag, places in self._entries():
            by_tag.setdefault(tag, []).append(places)
        x, ys, turn = [], [[] for _ in self.traces], {}
        while r.more():
            tag = r.take("s")
            if tag == self.sweep.name and tag not in by_tag:
                x.append(r.value(self.sweep.kind))
                turn = {}
                continue
            if tag not in by_tag:
                raise FormatError(f"{self.path}: value of the undeclared {tag!r}")
            k = turn.get(tag, 0)
            turn[tag] = k + 1
            places = by_tag[tag][min(k, len(by_tag[tag]) - 1)]
            paren = len(places) > 1 and r.peek() == ("p", "(") and self.traces[places[0]].kind.name not in ("struct", "array") and not self.traces[places[0]].kind.is_complex
            if paren:
                r.take()
            for i in places:
                ys[i].append(r.value(self.traces[i].kind))
            if paren:
                r.take("p", ")")
        if any(len(y) not in (0, len(x)) for y in ys):
            raise FormatError(f"{self.path}: columns of unequal length")
        column = lambda kind, v: np.array(v, dtype=kind.dtype()) if v else np.empty(0, kind.dtype())
        return column(self.sweep.kind, x), [column(s.kind, y) for s, y in zip(self.traces, ys, strict=True)]

    def columns(self, names):
        if not self.sweep:
            raise FormatError(f"{self.path}: not swept")
        place = {s.name: i for i, s in enumerate(self.traces)}
        for n in names:
            self.signal(n)
        x, ys = self._swept
        return x, {n: ys[place[n]] for n in names}

    def declared_only(self):
        written = self._text.replace('\\"', "")
        return {self.traces[i].name for tag, places in self._entries() for i in places if written and f'"{tag}"' not in written}

    @cached_property
    def _plain(self) -> list[tuple[Signal, object]]:
        r, out = Reader(tokens(self._text)), []
        while not self.is_swept and r.more():
            name = r.take("s")
            if r.peek()[0] == "s" and r.peek()[1] in self.types:
                kind = r.take("s")
                value = r.value(self.types[kind])
                out.append((Signal(name, self.types[kind], r.props() + self.type_props[kind], type_name=kind), value))
            else:
                raise FormatError(f"{self.path}: {name} has no known type")
        return out

    def value_signals(self):
        return [s for s, _ in self._plain]

    def value(self, name):
        for s, v in self._plain:
            if s.name == name:
                return plain(s.kind, v)
        raise KeyError(name)
