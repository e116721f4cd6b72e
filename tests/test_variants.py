"""The second compressed variant, checks of windows, and what a file says about itself."""

import re
import struct

import pytest
import writers as W

from wavemill.sources.files import open_file
from wavemill.sources.model import FormatError

XS = [float(i) * 0.5 for i in range(40)]
CHUNKS = [XS[:10], XS[10:]]


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


def stub(index, stop=XS[-1]):
    types = W.type_decl(1, "sweep", "float64") + W.type_decl(2, "V", "float64")
    traces = b"".join(W.trace(10 + i, n, 2, index=W.u(0x24) + struct.pack(">QQdddd", *v)) for i, (n, v) in enumerate(index.items()))
    return W.binary(0x400, {"PSF window size": 128, "PSF sweep points": 0, "stop": stop}, types, W.trace(1, "time", 1), traces, None)


def test_other_mark_and_seven_fields(tmp_path):
    """Lines without the last field; zeros have no bytes at all."""
    body, index = W.xl(CHUNKS, {"a": [[x + 1 for x in c] for c in CHUNKS], "z": [[0.0] * len(c) for c in CHUNKS]})
    body = body.replace(b"\0!ngpsf-", b"\0!psfxl-")
    # The last field becomes zeros of padding, so that all places stay.
    seven = re.sub(rb"(\0(?:[0-9a-f]+:){6}[0-9a-f.]+):([0-9a-f]+)\n", lambda m: m[1] + b"\n" + b"\0" * (len(m[2]) + 1), body)
    assert seven != body and len(seven) == len(body)
    path = put(tmp_path, "t.tran", stub(index))
    put(tmp_path, "t.tran.psfxl", seven)
    put(tmp_path, "t.tran.sig", b"\x01*title 26 a circuit\x01*other 3 x\x01")
    f = open_file(path)
    x, y = f.columns(["a", "z"])
    assert x.tolist() == XS and y["a"].tolist() == [v + 1 for v in XS] and not y["z"].any()
    assert f.meta == {"title": "a circuit"} and len(f) == 2


@pytest.mark.parametrize("form", ["<d", "<f"])
def test_constants_as_they_are(tmp_path, form):
    axis = W.blosc(struct.pack("<40d", *XS))
    out = b"\0!psfxl-1.4:0:ffffffffffffffff:4:20\n" + bytes(4) + bytes(range(8, 0, -1))
    out += b"\0" * (-len(out) % 8)
    first = len(out)
    body = W.blosc(struct.pack("<40d", *XS))
    out += f"\0" .encode() + f"3:0:ffffffffffffffff:28:{len(axis) + len(body):x}:22:{len(axis):x}\n".encode()
    out += b"\0" * (-len(out) % 8)
    axis_at = len(out)
    out += axis + body
    out += b"\0" * (-len(out) % 8)
    second = len(out)
    constant = struct.pack(form, 2.5)
    out += b"\0" + f"3:1:ffffffffffffffff:28:{len(constant):x}:a2:{second - axis_at:x}.{len(axis):x}\n".encode() + constant
    index = {"a": (first, 40, XS[0], XS[-1], 0.0, 1.0), "c": (second, 40, XS[0], XS[-1], 2.5, 2.5)}
    path = put(tmp_path, "c.tran", stub(index))
    put(tmp_path, "c.tran.psfxl", out)
    x, y = open_file(path).columns(["a", "c"])
    assert x.tolist() == XS and y["a"].tolist() == XS and y["c"].tolist() == [2.5] * 40


def windows(points, planned, per=10, size=128):
    types = W.type_decl(1, "sweep", "float64") + W.type_decl(2, "V", "float64")
    values = W.windows(XS[:points], [("float64", XS[:points])], size, per)
    return W.binary(0x400, {"PSF window size": size, "PSF sweep points": planned}, types, W.trace(1, "time", 1), W.trace(11, "a", 2), values, table=False)


def test_windows_are_checked(tmp_path):
    assert len(open_file(put(tmp_path, "ok", windows(30, 30))).columns(["a"])[0]) == 30
    for planned in (20, 40):
        with pytest.raises(FormatError, match="announces"):
            open_file(put(tmp_path, f"p{planned}", windows(30, planned))).columns(["a"])
    cut = open_file(put(tmp_path, "cut", windows(30, 30)[:-50]))
    assert len(cut.columns(["a"])[0]) == 20 and not cut.is_complete
    with pytest.raises(FormatError, match="fit"):
        open_file(put(tmp_path, "wide", windows(20, 20, per=20, size=160).replace(struct.pack(">d", 0.0), struct.pack(">d", 0.0)).replace(W.u(0x10, 20 | 0x30000), W.u(0x10, 21 | 0x30000)))).columns(["a"])


def test_schemas_without_reading(tmp_path):
    f = open_file(put(tmp_path, "s", windows(30, 30)))
    assert f.schema().names == ["time", "a"] and f.long_schema().names == ["time", "signal", "value"] and f.schema([]).names == ["time"]
    with pytest.raises(KeyError):
        f.schema(["nope"])
    with pytest.raises(KeyError):
        f.long_schema("member")


def test_stretches_of_long_signals(spark, tmp_path):
    """A job decodes so many points of a signal; all of them make the whole table, and a limit is met without the rest."""
    from wavemill.sources.dataset import Dataset

    d = Dataset(spark, put(tmp_path, "tran1.tran", windows(30, 30)))
    whole, cut = d.scan_long(), d.scan_long(chunk_rows=7)
    assert cut.count() == 30 and whole.exceptAll(cut).count() == 0
    assert cut.limit(5).count() == 5
