import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.operators import calculator
from wavemill.operators.waveform import Waveform


def wave(spark, x, y, **k):
    return Waveform.from_series(spark, x, y, "t", "v", {"t": "s", "v": "V"}, **k)


def test_single_curve(spark):
    x = np.linspace(0, 2 * np.pi * 3, 301)
    w = wave(spark, x, np.sin(x))
    assert w.ymax() == pytest.approx(np.sin(x).max()) and w.xmax() == pytest.approx(x[np.sin(x).argmax()])
    assert w.value(1.0) == pytest.approx(np.interp(1.0, x, np.sin(x))) and w.value(-5) == 0 and w.value(99) == pytest.approx(np.sin(x)[-1])
    assert w.cross(0.5, 1, "rising") == pytest.approx(math.asin(0.5), abs=1e-3)
    assert w.cross(0.5, 2, "falling") == pytest.approx(np.pi - math.asin(0.5) + 2 * np.pi, abs=1e-3)
    assert w.cross(0.5, -1, "rising") == pytest.approx(math.asin(0.5) + 4 * np.pi, abs=1e-3)
    assert math.isnan(w.cross(2.0)) and math.isnan(w.cross(0.5, 9))
    assert w.frequency() == pytest.approx(1 / (2 * np.pi), rel=1e-2)
    np.testing.assert_allclose(w.deriv().to_numpy(), np.diff(np.sin(x)) / np.diff(x))
    assert len(w.deriv()) == 300 and w.deriv().yunit == "V/s"
    area = np.concatenate([[0], np.cumsum(np.diff(x) * (np.sin(x)[1:] + np.sin(x)[:-1]) / 2)])
    np.testing.assert_allclose(w.integ().to_numpy(), area, atol=1e-12)
    assert w.integral() == pytest.approx(area[-1], abs=1e-12)
    assert w.rms() == pytest.approx(np.sqrt((np.sin(x) ** 2).mean())) and w.clip(1, 2).ymin() >= 0.8
    assert calculator.dB20(w).yunit == "dB" and calculator.ymax(w) == w.ymax()
    with pytest.raises(NotImplementedError):
        w**w
    with pytest.raises(ValueError):
        w + wave(spark, x[:-1], np.sin(x)[:-1])


def test_step(spark):
    t = np.linspace(0, 10, 1001)
    y = 1 - np.exp(-t) * np.cos(5 * t)
    w = wave(spark, t, y)
    final, step = y[-1], y[-1] - y[0]
    assert w.overshoot() == pytest.approx(100 * (y.max() - final) / step)
    up = lambda level: t[np.flatnonzero((y[1:] >= level) & (y[:-1] < level))[0]]
    assert w.rise_time() == pytest.approx(up(y[0] + 0.9 * step) - up(y[0] + 0.1 * step), abs=0.011)
    assert w.slew_rate() == pytest.approx(0.8 * step / w.rise_time())
    assert w.settling_time(2) == pytest.approx(t[np.flatnonzero(abs(y - final) > 0.02 * step)[-1]])
    assert w.delay(w * 1 + 0.0, 0.5) == 0


def test_loop_margins(spark):
    f = np.logspace(2, 9, 400)
    h = 1000 / ((1 + 1j * f / 1e4) * (1 + 1j * f / 2.2e7))
    w = wave(spark, f, h)
    assert w.unity_gain_frequency() == pytest.approx(9.2e6, rel=0.02) and w.phase_margin() == pytest.approx(67, abs=1)
    assert math.isnan(w.gain_margin())
    k = 200 / ((1 + 1j * f / 1e4) * (1 + 1j * f / 1e6) * (1 + 1j * f / 1e7))
    g = wave(spark, f, k).gain_margin()
    i = np.flatnonzero((k.imag[:-1] < 0) & (k.imag[1:] >= 0))[0]
    assert g == pytest.approx(-20 * np.log10(abs(k[i])), abs=0.5)
    assert w.bandwidth() == pytest.approx(1e4, rel=0.02) and w.bandwidth(interp="log") == pytest.approx(1e4, rel=0.02)
    high = wave(spark, f, 1 / (1 + 1e5 / (1j * f)))
    assert high.bandwidth(type="high") == pytest.approx(1e5, rel=0.02)


def test_families_and_null_safety(spark):
    df = spark.createDataFrame([(c, float(i), float(i * c) if (c, i) != (2, 3) else float("nan")) for c in (1, 2, 3) for i in range(10)], "c int, x double, y double")
    w = Waveform(df, "y", ["c", "x"])
    assert {(r["c"], r["ymax"]) for r in w.ymax().collect()} == {(1, 9.0), (2, 18.0), (3, 27.0)}
    centred = (w - w.mean()).leaf(c=3)
    assert centred.groups == [] and centred.mean() == pytest.approx(0)
    crossed = {r["c"]: r["cross"] for r in w.cross(12.0, 1, "rising").collect()}
    assert math.isnan(crossed[1]) and crossed[2] == 6.0 and crossed[3] == 4.0
    with pytest.raises(KeyError):
        w.leaf(z=1)


def test_spectrum_and_intercept(spark):
    t = np.arange(64) / 64
    s = wave(spark, t, 2 * np.cos(2 * np.pi * 5 * t) + 1).dft()
    y = s.to_numpy()
    assert s.xname == "freq" and y[5] == pytest.approx(2) and y[0] == pytest.approx(1) and y[6] == pytest.approx(0, abs=1e-9)
    p = np.linspace(-40, -10, 7)
    assert wave(spark, p, p + 10).iip3(wave(spark, p, 3 * p + 10), -30) == pytest.approx(-30 + (-20 - -80) / 2)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=40), st.integers(1, 9))
def test_segments_change_nothing(spark, ys, segments):
    x = np.arange(len(ys), dtype=float)
    a, b = (Waveform(wave(spark, x, ys).df, "v", ["t"], segments=n) for n in (1, segments))
    np.testing.assert_allclose(a.integ().to_numpy(), b.integ().to_numpy(), atol=1e-9)
    np.testing.assert_array_equal(a.deriv().to_numpy(), b.deriv().to_numpy())


def test_nested_curves(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], [3.0, 4.0]), ("b", [1.0], [9.0])], "g string, t array<double>, v array<double>")
    w = Waveform.from_nested(df, "t", "v", ["g"])
    assert w.df.count() == 3 and {r["ymax"] for r in w.ymax().collect()} == {4.0, 9.0}
    assert w.filter(F.col("g") == "a").df.count() == 2
