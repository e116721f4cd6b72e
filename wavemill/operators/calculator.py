"""Measurements as functions of a waveform, under the names that calculators of simulators use."""

from __future__ import annotations

from .waveform import Waveform


def _as_function(name: str):
    def call(wave: Waveform, *args, **options):
        return getattr(wave, name)(*args, **options)

    call.__name__ = name
    return call


MEASUREMENTS = (
    "ymax", "ymin", "xmax", "xmin", "argmax", "argmin", "mean", "average", "rms", "describe", "value", "cross", "crossings", "bandwidth", "unity_gain_frequency",
    "phase_margin", "gain_margin", "rise_time", "slew_rate", "overshoot", "settling_time", "delay", "frequency", "iip3", "deriv", "integ", "integral", "dft", "clip",
    "leaf", "real", "imag", "conj", "mag", "db20", "phase",
)
#: Other names of the same functions.
ALIASES = {
    "dB20": "db20", "riseTime": "rise_time", "slewRate": "slew_rate", "settlingTime": "settling_time", "phaseMargin": "phase_margin", "gainMargin": "gain_margin",
    "unityGainFreq": "unity_gain_frequency", "unityGainFrequency": "unity_gain_frequency", "leafValue": "leaf", "IIP3": "iip3",
}

globals().update({n: _as_function(n) for n in MEASUREMENTS})
globals().update({a: globals()[n] for a, n in ALIASES.items()})
__all__ = [*MEASUREMENTS, *ALIASES]
