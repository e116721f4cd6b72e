"""Opening a result file by its content; a worker keeps the last ones open."""

from __future__ import annotations

import os
import sys

from .binary_format import BinaryFile, looks_binary
from .model import FormatError, ResultFile, read_bytes
from .text_format import TextFile


def open_file(path: str | os.PathLike) -> ResultFile:
    path = os.fspath(path)
    data = read_bytes(path)
    if looks_binary(data):
        return BinaryFile(path, data)
    if bytes(data[:4096]).lstrip().startswith(b"HEADER"):
        return TextFile(path, data)
    raise FormatError(f"{path}: neither a binary nor a text result file")


def shared(path: str, most: int = 64) -> ResultFile:
    """The file, from this process's most recently opened ones if it hasn't changed since."""
    held = sys.__dict__.setdefault("_wavemill_files", {})
    stamp = os.stat(path).st_mtime_ns if "://" not in path else 0
    file = held.pop((path, stamp), None) or open_file(path)
    held[path, stamp] = file
    while len(held) > most:
        held.pop(next(iter(held)))
    return file
