"""Result files made by the layouts' descriptions, independently of the readers."""

from __future__ import annotations

import struct
import zlib


def s(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def u(*xs: int) -> bytes:
    return struct.pack(f">{len(xs)}I", *xs)


def prop(name: str, v) -> bytes:
    if isinstance(v, str):
        return u(0x21) + s(name) + s(v)
    return u(0x22) + s(name) + struct.pack(">i", v) if isinstance(v, int) else u(0x23) + s(name) + struct.pack(">d", v)


def props(d: dict) -> bytes:
    return b"".join(prop(k, v) for k, v in d.items())


CODES = {"int8": 1, "int32": 5, "float32": 9, "complex64": 10, "float64": 11, "complex128": 12}


def type_decl(tid: int, name: str, kind, p: dict | None = None, dims=()) -> bytes:
    out = u(0x10, tid) + s(name) + u(len(dims), *dims)
    if isinstance(kind, list):
        out += u(16) + b"".join(type_decl(100 + i, n, k) for i, (n, k) in enumerate(kind)) + u(0x12)
    else:
        out += u(CODES[kind])
    return out + props(p or {})


def trace(tid: int, name: str, kind: int, p: dict | None = None, index: bytes = b"") -> bytes:
    return u(0x10, tid) + s(name) + u(kind) + index + props(p or {})


def group(gid: int, name: str, members: list[bytes]) -> bytes:
    return u(0x11, gid) + s(name) + u(len(members)) + b"".join(members)


def number(kind: str, v) -> bytes:
    if kind.startswith("complex"):
        return struct.pack(">2d" if kind == "complex128" else ">2f", v.real, v.imag)
    return struct.pack({"int8": ">i", "int32": ">i", "float32": ">f", "float64": ">d"}[kind], v)


def binary(code: int, header: dict, types: bytes, sweeps: bytes, traces: bytes, values: bytes | None, table: bool = True) -> bytes:
    sections = [(code, props({"PSFversion": "1.1"} | header), False), (1, types, True)]
    if sweeps:
        sections.append((2, sweeps, False))
    sections.append((3, traces, True))
    if values is not None:
        sections.append((4, values, True))
    out, places = b"", []
    for i, (c, body, back) in enumerate(sections):
        at = len(out)
        links = 8 + (8 if back else 0)
        end = at + 4 + links + len(body)
        last = i == len(sections) - 1
        places.append((c, at + 4))
        out += u(c) + u(0x15, end + 4 if not last or table else 0) + (u(0x16, end) if back else b"") + body
    if table:
        at = len(out)
        out += u(0xF) + b"".join(u(c, p) for c, p in places) + b"Clarissa" + u(at)
    return out


def rows(xs, columns: list[tuple[int, str, list]], x_id: int = 1) -> bytes:
    """Row records: columns of (id, kind, values)."""
    out = b""
    for i, x in enumerate(xs):
        out += u(0x10, x_id) + struct.pack(">d", x)
        for tid, kind, ys in columns:
            out += u(0x10, tid) + number(kind, ys[i])
    return out


def windows(xs, columns: list[tuple[str, list]], size: int, per: int, padding: int = 0) -> bytes:
    out = u(0x14, padding) + b"\0" * padding if padding else b""
    for a in range(0, len(xs), per):
        part = xs[a : a + per]
        out += u(0x10, len(part) | 0x30000) + struct.pack(f">{len(part)}d", *part)
        for kind, ys in columns:
            body = b"".join(number(kind, y) for y in ys[a : a + per])
            out += b"\xee" * (size - len(body)) + body
    return out


def blosc(raw: bytes, codec: str = "zlib", shuffle: bool = True) -> bytes:
    """One buffer in blocks of 1 KiB, each as one stream."""
    import pyarrow as pa

    code = {"lz4_raw": 1, "snappy": 2, "zlib": 3, "zstd": 4}[codec]
    size, block = 8, 1024
    pack = zlib.compress if codec == "zlib" else lambda x: pa.Codec(codec).compress(x, asbytes=True)
    blocks = []
    for a in range(0, len(raw), block):
        b = raw[a : a + block]
        if shuffle:
            b = b"".join(b[i::size] for i in range(size))
        z = pack(b)
        z = b if len(z) >= len(b) else z
        blocks.append(struct.pack("<I", len(z)) + z)
    starts, at = [], 16 + 4 * len(blocks)
    for b in blocks:
        starts.append(at)
        at += len(b)
    head = bytes([2, 1, (1 if shuffle else 0) | 16 | code << 5, size]) + struct.pack("<III", len(raw), block, at)
    return head + struct.pack(f"<{len(starts)}I", *starts) + b"".join(blocks)


def xl(axis_chunks: list[list[float]], signals: dict[str, list[list[float]]], codec: str = "zlib") -> tuple[bytes, dict[str, tuple]]:
    """(file, index by name): the first signal stores each chunk's axis, the others point to it."""
    out = b"\0!ngpsf-1.4:0:ffffffffffffffff:4:20\n" + bytes(4) + bytes(range(8, 0, -1))
    out += b"\0" * (-len(out) % 8)
    last = dict.fromkeys(signals, 0xFFFFFFFFFFFFFFFF)
    for k, xs in enumerate(axis_chunks):
        axis = blosc(struct.pack(f"<{len(xs)}d", *xs), codec)
        axis_at = None
        for i, (name, chunks) in enumerate(signals.items()):
            ys = chunks[k]
            body = b"" if not any(ys) else blosc(struct.pack(f"<{len(ys)}d", *ys), codec)
            at = len(out)
            own = axis_at is None
            form = f"{len(axis):x}" if own else f"{at - axis_at:x}.{len(axis):x}"
            line = f"3:{i:x}:{last[name]:x}:{len(xs):x}:{len(body) + (len(axis) if own else 0):x}:{'22' if own else 'a2'}:{form}:{len(body):x}\n".encode()
            out += b"\0" + line
            out += b"\0" * (-len(out) % 8)
            if own:
                axis_at = len(out)
                out += axis
            out += body
            out += b"\0" * (-len(out) % 8)
            last[name] = at
    flat = [x for xs in axis_chunks for x in xs]
    index = {n: (last[n], len(flat), flat[0], flat[-1], min(min(c) for c in cs), max(max(c) for c in cs)) for n, cs in signals.items()}
    return out, index
