import time

import pytest
from test_dataset import ac_file

from wavemill import api
from wavemill.operators import relational as R
from wavemill.streaming.growing import follow


def test_eager_reads(spark, tmp_path):
    p = tmp_path / "a.ac"
    p.write_text(ac_file(1e3, 1e-6))
    t = api.read_table(spark, p, ["out"])
    assert t.columns == ["freq", "out"] and t.count() == 4
    w = api.wave(spark, p, "out")
    assert api.db20(w).yunit == "dB" and set(api.waves(spark, api.open_results(spark, p), ["in"])) == {"in"}
    assert api.unityGainFreq(w) != api.unityGainFreq(w)  # NaN: it stays below 1
    op = tmp_path / "op.dc"
    op.write_text('HEADER\n"PSFversion" "1.00"\nTYPE\n"V" FLOAT DOUBLE\n"R" STRUCT(\n"i" FLOAT DOUBLE\n"v" FLOAT DOUBLE\n)\nVALUE\n"VOUT" "V" 1.5\n"R1" "R" (\n2\n3\n)\n"R2" "R" (\n4\n5\n)\nEND\n')
    devices = R.device_tables(api.read_table(spark, op))
    assert {tuple(r) for r in devices["i", "v"].collect()} == {("R1", 2.0, 3.0), ("R2", 4.0, 5.0)}
    with pytest.raises(api.FormatError):
        api.open_file(__file__)


def test_stream_of_a_growing_file(spark, tmp_path):
    p, rows = tmp_path / "t.tran", [f'"time" {i}\n"a" {i * i}\n' for i in range(6)]
    head = 'HEADER\n"PSFversion" "1.00"\nTYPE\n"V" FLOAT DOUBLE\nSWEEP\n"time" "V"\nTRACE\n"a" "V"\nVALUE\n'
    p.write_text(head + "".join(rows[:2]))
    q = follow(spark, str(p), "a").writeStream.format("memory").queryName("grown").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert spark.table("grown").count() == 2
        p.write_text(head + "".join(rows))
        for _ in range(40):
            if spark.table("grown").count() == 6:
                break
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("grown").orderBy("x").collect()] == [(float(i), float(i * i)) for i in range(6)]
    finally:
        q.stop()
