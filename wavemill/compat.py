"""A numpy-style accessor of one result file. No Spark job is involved."""

from __future__ import annotations

import numpy as np

from .sources.files import open_file


def _plain(values: np.ndarray, invert: bool):
    """Struct signals as an array of dicts, or as a dict of arrays."""
    names = values.dtype.names
    if not names:
        return values
    if invert:
        return {n: _plain(np.ascontiguousarray(values[n]), invert) for n in names}
    return np.array([{n: row[n].item() for n in names} for row in values], dtype=object)


class PSFDataSet:
    def __init__(self, filename):
        self._file = open_file(filename)
        self.invertstruct = False
        self._held: dict = {}

    def close(self) -> None:
        self._file, self._held = None, {}

    def __repr__(self) -> str:
        return f"PSFDataSet({self._file.path!r})"

    def get_header_properties(self) -> dict:
        return self._file.header

    def get_signal_names(self) -> list[str]:
        return self._file.names

    def is_swept(self) -> bool:
        return self._file.is_swept

    def get_nsweeps(self) -> int:
        return int(self._file.is_swept)

    def get_sweep_param_names(self) -> list[str]:
        return [self._file.sweep_name] if self._file.is_swept else []

    def get_sweep_npoints(self) -> int:
        return self._file.header.get("PSF sweep points") or (len(self.get_sweep_values()) if self._file.is_swept else 0)

    def get_signal_properties(self, name: str) -> dict:
        return {k: v for k, v in self._file.props(name).items() if k != "type"}

    def get_sweep_values(self) -> np.ndarray:
        if not self._file.is_swept:
            raise ValueError("the file isn't swept")
        if "" not in self._held:
            self._held[""] = self._file.columns([])[0]
        return self._held[""]

    def get_signal(self, name: str):
        if not self._file.is_swept:
            return self._file.value(name)
        key = name, self.invertstruct
        if key not in self._held:
            self._held[key] = _plain(self._file.column(name)[1], self.invertstruct)
        return self._held[key]
