"""Result directories: logs of analyses and tables of runs, flattened to rows.

A log and a run table have the same shape: rows that name their parent, some of which sweep a variable. `chains` turns
either into one row for each leaf, with all its ancestors. Families are groups of these rows, a leaf's parameters are read off
its chain, and the values of a sweep are joined to the children of the entry that declares it.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import pairwise

import numpy as np

from .files import open_file, shared
from .model import FormatError, first_wins

# Fixed names of the formats.
LOGS = ("logFile", "logFile.tmp")
RUNS = "runObjFile"
PARENTS = frozenset({"sweep", "montecarlo"})
MOST_DEEP = 64
#: Relative tolerance of values written with six digits.
CLOSE = 1e-5


class UnknownResult(KeyError):
    pass


@dataclass(frozen=True)
class Leaf:
    family: str
    analysis: str
    name: str
    params: tuple[tuple[str, float | str], ...]
    path: str


@dataclass
class Family:
    name: str
    label: str
    analysis: str
    params: list[str]
    leaves: int
    description: str | None


@dataclass(frozen=True, eq=False)
class Row:
    """One entry of a log or of a run table."""

    name: str
    parent: str
    variable: str | None
    props: dict
    kind: str = ""
    file: str = ""
    note: str = ""
    logs: tuple[str, ...] = ()

    @property
    def base(self) -> str:
        return self.name.removesuffix(f"-{self.kind}")

    def value_of(self, variable: str) -> float | str | None:
        v = self.props.get(variable)
        return v if v is None or isinstance(v, str) else float(v)


@dataclass(frozen=True, eq=False)
class Way:
    """A leaf entry of a log with what is above it: the run's parameters and the entries from the root down."""

    folder: str
    outer: tuple[tuple[str, float | str], ...]
    chain: tuple[Row, ...]

    root = property(lambda self: self.chain[0])
    leaf = property(lambda self: self.chain[-1])

    @property
    def variables(self) -> list[str]:
        return [k for k, _ in self.outer] + [r.variable for r in self.chain[:-1] if r.variable]


def strings(value) -> tuple[str, ...]:
    """A text or a list of texts, without empty ones."""
    return tuple(x for x in (value if isinstance(value, list) else [value]) if isinstance(x, str) and x)


def table(path: str, of_type: str) -> list[Row]:
    """The rows of a log (`analysisInst`) or a run table (`runObject`)."""
    f, out = open_file(path), []
    for signal in f.value_signals():
        if signal.type_name == of_type:
            v = f.value(signal.name)
            variable = strings(v.get("sweepVariable"))[:1]
            out.append(Row(signal.name, v.get("parent") or "", variable[0] if variable else None, first_wins(signal.props), v.get("analysisType", ""), v.get("dataFile", ""), v.get("description", ""), strings(v.get("logName"))))
    return out


def chains(rows: list[Row], rooted: bool = True) -> list[tuple[Row, ...]]:
    """From the root down to each row, in the order of a walk through the tree. A row whose parents don't lead to a root (one
    without parent, or with an unknown one if not `rooted`) has none."""
    place = {id(r): i for i, r in enumerate(rows)}
    by_name = {r.name: r for r in reversed(rows)}
    out = []
    for r in rows:
        way = [r]
        while (above := by_name.get(way[0].parent)) is not None and len(way) <= MOST_DEEP:
            way.insert(0, above)
        if above is None and not (rooted and way[0].parent):
            out.append(tuple(way))
    return sorted(out, key=lambda way: [place[id(r)] for r in way])


def close(a, b) -> bool:
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    return abs(a - b) <= CLOSE * max(abs(a), abs(b)) + 1e-300


def matched(rounded: list, exact: list) -> list:
    """For each rounded value the exact one that it stands for, or None: the one at its place where the lists agree, else the nearest."""
    if len(rounded) == len(exact) and all(r is None or close(r, e) for r, e in zip(rounded, exact, strict=True)):
        return list(exact)
    numbers = np.sort(np.array([e for e in exact if not isinstance(e, str)], float))
    texts = {e for e in exact if isinstance(e, str)}

    def nearest(r):
        if r is None or isinstance(r, str):
            return r if r in texts else None
        at = np.searchsorted(numbers, r)
        around = numbers[max(0, at - 1) : at + 1].tolist()
        best = min(around, key=lambda e: abs(e - r), default=None)
        return best if best is not None and close(best, r) else None

    return [nearest(r) for r in rounded]


def own_name(family: str, leaf: str) -> str:
    """The part of a family's name that its leaves' names end with too: `ac1` of `swp_ac1` and `swp-000_ac1`."""
    parts = family.split("_")
    same = 0
    for a, b in zip(reversed(parts), reversed(leaf.split("_")), strict=False):
        if a != b:
            break
        same += 1
    return "_".join(parts[len(parts) - same :]) or family


@dataclass
class _Sweeps:
    """The values of the children of every sweeping entry, each read once."""

    warn: list[str]
    known: dict[int, dict[str, float | str | None]] = field(default_factory=dict)

    def values(self, folder: str, entry: Row, children: list[Row]) -> dict[str, float | str | None]:
        if id(entry) not in self.known:
            rounded = [c.value_of(entry.variable) for c in children]
            try:
                exact = [x if isinstance(x, str) else float(x) for x in open_file(os.path.join(folder, entry.file)).columns([])[0].tolist()]
                found = matched(rounded, exact)
            except (OSError, FormatError) as e:
                self.warn.append(f"{entry.name}: its sweep file can't be read ({e}); the log's rounded {entry.variable} is taken")
                found = rounded
            lost = [c.name for c, v in zip(children, found, strict=True) if v is None]
            if lost:
                self.warn.append(f"{entry.name}: no {entry.variable} found for {', '.join(lost)}; left out")
            self.known[id(entry)] = {c.name: v for c, v in zip(children, found, strict=True)}
        return self.known[id(entry)]


class Results:
    """A directory with a log, or one file. Only the top file is read at once; logs, sweeps and leaves when they are asked for."""

    def __init__(self, path: str | os.PathLike):
        self.root = path = os.fspath(path)
        self.warnings: list[str] = []
        self.single: Family | None = None
        self._leaves: dict[str, list[Leaf]] = {}
        self._sources: list[tuple[str, tuple]] = []
        if os.path.isdir(path):
            there = [n for n in (RUNS, *LOGS) if os.path.isfile(os.path.join(path, n))]
            if not there:
                raise FileNotFoundError(f"{path}: no {RUNS} or {LOGS[0]}")
            top = os.path.join(path, there[0])
        elif not os.path.isfile(path):
            raise FileNotFoundError(path)
        elif os.path.basename(path) in (RUNS, *LOGS):
            top, self.root = path, os.path.dirname(path) or "."
        else:
            self._one(path)
            return
        self._sources = list(self._run_logs(top)) if os.path.basename(top) == RUNS else [(top, ())]

    @property
    def is_single_file(self) -> bool:
        return self.single is not None

    def _one(self, path: str) -> None:
        f = shared(path)
        name, kind = f.header.get("analysis name") or os.path.basename(path).split(".")[0], f.header.get("analysis type") or ""
        self.single = Family(name, name, kind, [], 1, None)
        self._leaves[name] = [Leaf(name, kind, name, (), path)]
        self._tell_renamed(f)

    def _tell_renamed(self, f) -> None:
        if f.renamed:
            text = f"{f.path}: {len(f.renamed)} trace(s) share a name with another; {f.renamed[0][0]} became {f.renamed[0][1]}"
            self.warnings += [text] if text not in self.warnings else []

    def _run_logs(self, path: str) -> Iterable[tuple[str, tuple]]:
        """(log, parameters) of each run that names logs."""
        for way in chains(table(path, "runObject"), rooted=False):
            logs = [x for x in way[-1].logs if os.path.basename(x) in LOGS]
            swept = [(above.variable, below.value_of(above.variable), below.name) for above, below in pairwise(way) if above.variable] if logs else []
            self.warnings += [f"run {name}: its {k} isn't given" for k, v, name in swept if v is None]
            for log in logs:
                yield os.path.normpath(os.path.join(os.path.dirname(path), log)), tuple((k, v) for k, v, _ in swept if v is not None)

    @cached_property
    def _logs(self) -> list[tuple[str, tuple, list[Row]]]:
        """(folder, run's parameters, rows) of every log that is there."""
        self.warnings += [f"log file {path} isn't there" for path, _ in self._sources if not os.path.isfile(path)]
        return [(os.path.dirname(path) or ".", outer, table(path, "analysisInst")) for path, outer in self._sources if os.path.isfile(path)]

    @cached_property
    def _ways(self) -> dict[str, list[Way]]:
        """The leaf entries of each family. An analysis with outputs of several kinds has a family for each: `base_<output>` for `<output>.<kind>`."""
        found = []
        for folder, outer, rows in self._logs:
            inner = {r.parent for r in rows}
            found += [Way(folder, outer, c) for c in chains(rows) if c[-1].name not in inner and c[-1].kind not in PARENTS]
        kinds = Counter(base for base, _ in {(w.root.base, w.leaf.kind) for w in found})
        out: dict[str, list[Way]] = {}
        for w in found:
            output = w.leaf.kind.rpartition(".")[0] if kinds[w.root.base] > 1 else ""
            out.setdefault(f"{w.root.base}_{output}" if output else w.root.base, []).append(w)
        return out

    @cached_property
    def _families(self) -> list[Family]:
        if self.single:
            return [self.single]
        labels = {name: own_name(ways[0].root.base, ways[0].leaf.base) + name[len(ways[0].root.base) :] for name, ways in self._ways.items()}
        taken = Counter(labels.values())
        return [Family(n, labels[n] if taken[labels[n]] == 1 else n, w[0].leaf.kind, w[0].variables, len(w), w[0].leaf.note) for n, w in self._ways.items()]

    def families(self) -> list[Family]:
        return self._families

    def resolve(self, name: str) -> str:
        """A family by its name or label; else by what its name ends with; else by its kind of analysis. The last two must fit one only."""
        ends = () if self.single else [x for x in self._families if x.name.endswith(f"_{name}")]
        for fits in ([x for x in self._families if name in (x.name, x.label)][:1], ends, [x for x in self._families if x.analysis == name]):
            if len(fits) > 1:
                raise UnknownResult(f"{name} may be any of {', '.join(x.name for x in fits)}")
            if fits:
                return fits[0].name
        raise UnknownResult(name)

    def only(self, name: str | None) -> str:
        if name is not None:
            return self.resolve(name)
        if len(self._families) == 1:
            return self._families[0].name
        raise ValueError(f"which result? There are {[x.label for x in self._families]}")

    def leaves(self, name: str) -> list[Leaf]:
        family = self.resolve(name)
        if family not in self._leaves:
            self._leaves[family] = list(self._leaf_rows(family))
            if self._leaves[family]:
                self._tell_renamed(shared(self._leaves[family][0].path))
        return self._leaves[family]

    def _leaf_rows(self, family: str) -> Iterable[Leaf]:
        sweeps = _Sweeps(self.warnings)
        children: dict[tuple[int, str], list[Row]] = {}
        for i, (_, _, rows) in enumerate(self._logs):
            for r in rows:
                children.setdefault((i, r.parent), []).append(r)
        log_of = {id(r): i for i, (_, _, rows) in enumerate(self._logs) for r in rows}
        for w in self._ways[family]:
            params = [(a.variable, sweeps.values(w.folder, a, children[log_of[id(a)], a.name])[b.name]) for a, b in pairwise(w.chain) if a.variable]
            if any(v is None for _, v in params):
                continue
            path = os.path.join(w.folder, w.leaf.file)
            if os.path.isfile(path):
                yield Leaf(family, w.leaf.kind, w.leaf.name, (*w.outer, *params), path)
            else:
                self.warnings.append(f"{w.leaf.name}: missing data file {path}")
