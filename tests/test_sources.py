import struct

import numpy as np
import pytest
import writers as W
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.sources.files import open_file
from wavemill.sources.model import FormatError
from wavemill.sources.xl_format import blosc

XS = [float(i) * 0.5 for i in range(25)]


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def row_file(xs=XS):
    types = W.type_decl(1, "sweep", "float64", {"units": "Hz"}) + W.type_decl(2, "V", "complex128", {"units": "V"}) + W.type_decl(3, "I", "float32")
    traces = W.trace(11, "out", 2) + W.trace(12, "V1:p", 3, {"units": "A"})
    ys = [complex(x, -x) for x in xs]
    values = W.rows(xs, [(11, "complex128", ys), (12, "float32", [2 * x for x in xs])])
    return W.binary(0x200, {"analysis name": "ac1", "analysis type": "ac", "PSF sweep points": len(xs)}, types, W.trace(1, "freq", 1), traces, values)


def test_row_records(tmp_path):
    f = open_file(put(tmp_path, "a.ac", row_file()))
    assert (f.layout, f.sweep_name, f.names, f.is_complete) == ("rows", "freq", ["out", "V1:p"], True)
    x, y = f.columns(["out", "V1:p"])
    assert x.tolist() == XS and y["out"].tolist() == [complex(v, -v) for v in XS] and y["V1:p"].dtype == np.float32
    assert f.units("out") == "V" and f.units("V1:p") == "A" and f.header["analysis name"] == "ac1"
    with pytest.raises(KeyError):
        f.columns(["nope"])


def test_every_cut_gives_an_error_or_whole_points(tmp_path):
    data = row_file()
    full = open_file(put(tmp_path, "f", data)).columns(["out"])
    for cut in range(0, len(data), 37):
        try:
            f = open_file(put(tmp_path, "c", data[:cut]))
            x, y = f.columns(["out"]) if f.is_swept else ([], {"out": []})
        except (FormatError, KeyError):
            continue
        assert list(x) == list(full[0][: len(x)]) and list(y["out"]) == list(full[1]["out"][: len(y["out"])])


def test_windows_groups_and_padding(tmp_path):
    types = W.type_decl(1, "sweep", "float64") + W.type_decl(2, "V", "float64") + W.type_decl(3, "F", "float32")
    traces = W.group(20, "g", [W.trace(11, "a", 2), W.trace(12, "b", 3)])
    values = W.windows(XS, [("float64", [x * 3 for x in XS]), ("float32", XS)], 128, 10, padding=20)
    data = W.binary(0x400, {"PSF window size": 128, "PSF sweep points": 25}, types, W.trace(1, "time", 1), traces, values + b"\xff" * 64, table=False)
    f = open_file(put(tmp_path, "t", data))
    assert f.layout == "windowed" and f.points() == 25
    x, y = f.columns(["b", "a"])
    assert x.tolist() == XS and y["a"].tolist() == [v * 3 for v in XS] and y["b"].tolist() == XS
    cut = open_file(put(tmp_path, "t2", data[: len(data) - 64 - 200]))
    assert cut.columns(["a"])[0].tolist() == XS[:10] or cut.columns(["a"])[0].tolist() == XS[:20]


def test_groups_and_structs_in_rows(tmp_path):
    members = [("rn", "float64"), ("total", "float64")]
    types = W.type_decl(1, "sweep", "float64") + W.type_decl(2, "V", "float64") + W.type_decl(3, "N", members)
    traces = W.group(20, "g", [W.trace(11, "a", 2), W.trace(12, "b", 2)]) + W.trace(13, "r1", 3)
    values = b"".join(W.u(0x10, 1) + struct.pack(">d", x) + W.u(0x11, 20) + struct.pack(">2d", x, -x) + W.u(0x10, 13) + struct.pack(">2d", x * x, 1) for x in XS)
    f = open_file(put(tmp_path, "g", W.binary(0x300, {}, types, W.trace(1, "freq", 1), traces, values)))
    assert f.columns(["b"])[1]["b"].tolist() == [-x for x in XS]
    assert f.column("r1", "rn")[1].tolist() == [x * x for x in XS] and f.names_with_field("total") == ["r1"]


def test_values_without_a_sweep(tmp_path):
    types = W.type_decl(1, "cap", [("c", "float64"), ("on", "int8")], {"key": "inst"}) + W.type_decl(2, "v", "float64") + W.type_decl(3, "arr", "float64", dims=(3,))
    values = W.u(0x10, 1) + W.s("C1") + W.u(1) + struct.pack(">di", 1e-12, -1) + W.props({"model": "m"})
    values += W.u(0x10, 2) + W.s("vout") + W.u(2) + struct.pack(">d", 1.5) + W.u(0x10, 3) + W.s("xs") + W.u(3) + struct.pack(">3d", 1, 2, 3)
    f = open_file(put(tmp_path, "i", W.binary(0x500, {}, types, b"", b"", values)))
    assert f.layout == "nonswept" and f.values() == {"C1": {"c": 1e-12, "on": -1}, "vout": 1.5, "xs": [1.0, 2.0, 3.0]}
    assert f.props("C1")["model"] == "m"


@pytest.mark.parametrize("codec", ["zlib", "lz4_raw", "zstd", "snappy"])
def test_compressed_variant(tmp_path, codec):
    chunks = [XS[:10], XS[10:]]
    body, index = W.xl(chunks, {"n1": [[x + 1 for x in c] for c in chunks], "n2": [[0.0] * len(c) for c in chunks]}, codec)
    types = W.type_decl(1, "sweep", "float64") + W.type_decl(2, "V", "float64")
    traces = b"".join(W.trace(10 + i, n, 2, index=W.u(0x24) + struct.pack(">QQdddd", *v)) for i, (n, v) in enumerate(index.items()))
    stub = W.binary(0x400, {"PSF window size": 128, "PSF sweep points": 0, "stop": XS[-1]}, types, W.trace(1, "time", 1), traces, None)
    path = put(tmp_path, "tran1.tran.tran", stub)
    put(tmp_path, "tran1.tran.tran.psfxl", body)
    f = open_file(path)
    assert f.layout == "psfxl" and f.is_complete
    x, y = f.columns(["n1", "n2"])
    assert x.tolist() == XS and y["n1"].tolist() == [v + 1 for v in XS] and not y["n2"].any()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(allow_nan=False), max_size=400), st.booleans())
def test_blosc_round_trip(xs, shuffle):
    raw = struct.pack(f"<{len(xs)}d", *xs)
    assert blosc(W.blosc(raw, "zlib", shuffle)) == raw


TEXT = '''HEADER
"PSFversion" "1.00"
"analysis name" "ac1"
TYPE
"sweep" FLOAT DOUBLE PROP(
"units" "Hz"
)
"V" COMPLEX DOUBLE PROP(
"units" "V"
)
"N" STRUCT(
"rn" FLOAT DOUBLE
"total" FLOAT DOUBLE
) PROP(
"key" "inst"
)
SWEEP
"freq" "sweep"
TRACE
"n1" "V"
"grp" GROUP 2
"M1\\\\&2" "N"
"N1" "V"
VALUE
'''


def test_text_file(tmp_path):
    body = "".join(f'"freq" {x}\n"n1" ({x} {-x})\n"grp" (1 2) ({2 * x} 0)\n' for x in (1.0, 2.0, 3.0))
    f = open_file(put(tmp_path, "a.ac", TEXT + body + "END\n"))
    x, y = f.columns(f.names)
    assert f.names == ["n1", "M1\\\\&2", "N1"] and x.tolist() == [1, 2, 3]
    assert y["n1"].tolist() == [1 - 1j, 2 - 2j, 3 - 3j] and y["N1"].tolist() == [2, 4, 6]
    assert f.column("M1\\\\&2", "total")[1].tolist() == [2, 2, 2]
    assert f.units("n1") == "V" and f.units("freq") == "Hz"


def test_repeated_names_are_renamed(tmp_path):
    head = 'HEADER\n"PSFversion" "1.00"\nTYPE\n"V" FLOAT DOUBLE\nSWEEP\n"time" "V"\nTRACE\n"a" "V"\n"b" "V"\n"a" "V"\nVALUE\n'
    f = open_file(put(tmp_path, "p", head + '"time" 0\n"a" 1\n"b" 2\n"a" 3\n"time" 1\n"a" 4\n"b" 5\n"a" 6\nEND\n'))
    assert f.names == ["a", "b", "a#2"] and f.columns(["a#2"])[1]["a#2"].tolist() == [3, 6]
    assert f.renamed == [("a", "a#2")]


def test_text_values_without_a_sweep(tmp_path):
    head = 'HEADER\n"PSFversion" "1.00"\nTYPE\n"capacitor" STRUCT(\n"c" FLOAT DOUBLE PROP(\n"units" "F"\n)\n"names" ARRAY ( * ) STRING *\n)\n"v" FLOAT DOUBLE\nVALUE\n'
    f = open_file(put(tmp_path, "i", head + '"C1" "capacitor" (\n1e-12\n("a" "b")\n) PROP(\n"model" "m"\n)\n"x" "v" nan\nEND\n'))
    assert f.value("C1") == {"c": 1e-12, "names": ["a", "b"]} and np.isnan(f.value("x"))


@pytest.mark.parametrize("text", ["", "HEADER\n\"a\"", 'HEADER\n"v" 1\nTYPE\n"V" FLOAT TRIPLE\n', 'HEADER\nTYPE\n"V" FLOAT DOUBLE\nSWEEP\n"t" "V"\nTRACE\n"a" "V"\nVALUE\n"t" 1\n"a" 1\n"t" 2\n"zz" 4\n'])
def test_malformed_text(tmp_path, text):
    with pytest.raises((FormatError, KeyError)):
        f = open_file(put(tmp_path, "bad", text))
        f.columns(["a"])


def test_traces_that_are_only_declared(tmp_path):
    types = W.type_decl(1, "sweep", "float64") + W.type_decl(2, "V", "float64")
    data = W.binary(0x200, {}, types, W.trace(1, "x", 1), W.trace(11, "a", 2) + W.trace(12, "b", 2), W.rows(XS, [(11, "float64", XS)]))
    f = open_file(put(tmp_path, "s", data))
    assert f.declared_only() == {"b"} and f.columns(["a", "b"])[1]["b"].tolist() == []
    text = 'HEADER\n"v" 1\nTYPE\n"V" FLOAT DOUBLE\nSWEEP\n"t" "V"\nTRACE\n"a" "V"\n"b" "V"\nVALUE\n"t" 1\n"b" 2\n'
    assert open_file(put(tmp_path, "s2", text)).declared_only() == {"a"}
