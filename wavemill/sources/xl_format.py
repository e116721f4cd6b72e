"""The compressed two-file variant: a stub of declarations with an index, and chains of compressed records beside it."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa

from .model import FormatError, read_bytes

MARK = bytes(range(8, 0, -1))
NO_RECORD = 0xFFFFFFFFFFFFFFFF


def _blosclz(src: bytes, size: int) -> bytes:
    """The FastLZ-like codec: runs of literals, and copies from up to 8191 (or further, by two more bytes) back."""
    out, i, n = bytearray(), 0, len(src)
    first = True
    while i < n and len(out) < size:
        ctrl = src[i] & 31 if first else src[i]
        first = False
        i += 1
        if ctrl < 32:
            out += src[i : i + ctrl + 1]
            i += ctrl + 1
            continue
        length, back = (ctrl >> 5) - 1, (ctrl & 31) << 8
        if length == 6:
            while True:
                length += src[i]
                i += 1
                if src[i - 1] != 255:
                    break
        low = src[i]
        i += 1
        if low == 255 and back == 31 << 8:
            back = (src[i] << 8) + src[i + 1] + 8191
            i += 2
        else:
            back += low
        start = len(out) - back - 1
        for k in range(length + 3):
            out.append(out[start + k])
    return bytes(out)


def blosc(data: bytes) -> bytes:
    """A buffer of version 1 of the container: 16 bytes of header, places of blocks, blocks of one or `typesize` streams."""
    flags, size = data[2], data[3]
    total, block, whole = (int.from_bytes(data[i : i + 4], "little") for i in (4, 8, 12))
    if whole > len(data):
        raise FormatError("a compressed buffer is cut off")
    if flags & 2:
        return bytes(data[16 : 16 + total])
    codec = flags >> 5
    if codec == 0:
        inflate = _blosclz
    elif codec == 3:
        inflate = lambda s, n: zlib.decompress(s)
    elif codec in (1, 2, 4):
        kind = pa.Codec({1: "lz4_raw", 2: "snappy", 4: "zstd"}[codec])
        inflate = lambda s, n: kind.decompress(s, n, asbytes=True)
    else:
        raise FormatError(f"unknown codec {codec}")
    out = []
    for k in range(-(-total // block) if block else 0):
        at = int.from_bytes(data[16 + 4 * k : 20 + 4 * k], "little")
        n = min(block, total - k * block)
        split = size if not flags & 16 and n == block and n % size == 0 and size <= 16 and n // size >= 128 else 1
        parts = []
        for _ in range(split):
            m = int.from_bytes(data[at : at + 4], "little")
            raw = bytes(data[at + 4 : at + 4 + m])
            parts.append(raw if m == n // split else inflate(raw, n // split))
            at += 4 + m
        plain = np.frombuffer(b"".join(parts), np.uint8)
        if flags & 1 and size > 1:
            rows = n // size
            body = plain[: rows * size].reshape(size, rows).T.reshape(-1)
            plain = np.concatenate([body, plain[rows * size :]])
        elif flags & 4:
            raise FormatError("bit-shuffled buffers aren't supported")
        out.append(plain.tobytes())
    return b"".join(out)


def values(payload: bytes, points: int) -> np.ndarray:
    """Doubles of a value or axis buffer; single precision, a constant and nothing at all (zeros) are told by their size."""
    if not payload:
        return np.zeros(points)
    return _doubles(blosc(payload), points)


def _doubles(raw: bytes, points: int) -> np.ndarray:
    for kind in ("<f8", "<f4"):
        size = np.dtype(kind).itemsize
        if len(raw) == points * size:
            return np.frombuffer(raw, kind).astype(float)
        if len(raw) == size and points > 1:
            return np.full(points, np.frombuffer(raw, kind)[0], float)
    raise FormatError(f"{len(raw)} bytes for {points} points")


# Fixed values of the format: the marks of the two variants, and a record's line of hexadecimal fields, the last of which one variant leaves out.
MARKS = rb"\0!(?:ngpsf|psfxl)-1\.\d+:[^\n]*\n"
RECORD = re.compile(rb"\0([0-9a-f]+):[0-9a-f]+:([0-9a-f]+):([0-9a-f]+):([0-9a-f]+):[0-9a-f]+:(?:([0-9a-f]+)\.)?([0-9a-f]+)(?::[^\n:]*)?\n")
DOUBLES = b"3"


def _body(file):
    data = getattr(file, "_body", None)
    if data is None:
        data = read_bytes(file.path + ".psfxl")
        head = re.match(MARKS, bytes(data[:256]))
        if not head:
            raise FormatError(f"{file.path}.psfxl: not such a file or another version")
        if bytes(data[head.end() : head.end() + 64]).find(MARK) < 0:
            raise FormatError(f"{file.path}.psfxl: another byte order")
        file._body = data
    return data


def _container(data, at: int, points: int) -> tuple[int, int] | None:
    """(start, end) of the container at a place or after zeros up to the second next word, if one for so many points is there."""
    near = bytes(data[at : at + 32])
    zeros = len(near[:16]) - len(near[:16].lstrip(b"\0"))
    head = near[zeros : zeros + 16]
    if len(head) < 16 or head[0] != 2 or int.from_bytes(head[4:8], "little") not in (8 * points, 4 * points, 8, 4):
        return None
    return at + zeros, at + zeros + int.from_bytes(head[12:16], "little")


def _chunk(data, at: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(place of the record before, axis, values) of one record. Values are a container, a constant as it is, or nothing."""
    m = RECORD.match(bytes(data[at : at + 256]))
    if not m or m[1] != DOUBLES:
        raise FormatError(f"no record of doubles at {at}")
    prev, points, size, axis_size = (int(m[i], 16) for i in (2, 3, 4, 6))
    body = at + m.end()
    axis = at - int(m[5], 16) if m[5] else body + -body % 8
    x = values(bytes(data[axis : axis + axis_size]), points)
    start = body if m[5] else axis + axis_size
    if (found := _container(data, start, points)) is not None:
        y = values(bytes(data[slice(*found)]), points)
    else:
        own = size if m[5] else size - axis_size
        if own not in (0, 4, 8):
            raise FormatError(f"the record at {at} holds neither a container nor a constant")
        y = _doubles(bytes(data[start : start + own]), points) if own else np.zeros(points)
    return prev, x, y


def signal(file, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(axis, values) of one signal, from its last record backwards."""
    data, at = _body(file), file.index[name][0]
    xs, ys, seen = [], [], set()
    while at != NO_RECORD:
        if at in seen or at >= len(data):
            raise FormatError(f"{file.path}: the records of {name} don't end")
        seen.add(at)
        at, x, y = _chunk(data, at)
        xs.append(x)
        ys.append(y)
    cat = lambda v: np.concatenate(v[::-1]) if v else np.empty(0)
    return cat(xs), cat(ys)


def columns(file, names: list[str]):
    found = {n: signal(file, n) for n in names or list(file.index)[:1]}
    axes = [x for x, _ in found.values()]
    if any(len(x) != len(axes[0]) or not (x == axes[0]).all() for x in axes[1:]):
        raise FormatError(f"{file.path}: the signals have different axes; read them in long form")
    return (axes[0] if axes else np.empty(0)), {n: found[n][1] for n in names}


def metadata(path: str) -> dict[str, str]:
    """`*key 26 value` lines of the file of metadata."""
    text = bytes(read_bytes(path + ".sig")).replace(b"\x01", b"\n").decode("utf-8", "replace")
    return {m[1]: m[2].strip() for m in re.finditer(r"^\*(\S+) 26 (.*)$", text, re.M)}
