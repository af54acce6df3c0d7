"""Scalar column expressions: calibration, phases, wraps and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: keV for each channel and offset, by mission.
CALIBRATION = {"nustar": (0.04, 1.6), "xmm": (0.001, 0.0), "nicer": (0.01, 0.0), "ixpe": (15 / 375, 0.0)}


def rough_energy(pi: Column, mission: Column) -> Column:
    """Rough energy in keV of a channel; null where the mission has no linear calibration."""
    out = F.lit(None).cast("double")
    low = F.lower(F.trim(mission))
    for name, (slope, offset) in CALIBRATION.items():
        out = F.when(low == name, pi.cast("double") * slope + offset).otherwise(out)
    return out


def phase(t: Column, f, fdot=0.0, fddot=0.0) -> Column:
    """Pulse phase in [0, 1) at a time relative to the reference epoch."""
    f, fdot, fddot = (x if isinstance(x, Column) else F.lit(float(x)) for x in (f, fdot, fddot))
    turns = f * t + fdot * t * t / 2.0 + fddot * t * t * t / 6.0
    return turns - F.floor(turns)


def wrap_zero_one(x: Column) -> Column:
    """Wrap to (0, 1]."""
    return x - F.ceil(x) + 1


def wrap_around_zero(x: Column) -> Column:
    """Wrap to [-0.5, 0.5)."""
    return x - F.floor(x + 0.5)


def uniform_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """Index of a uniform bin of [lo, hi); null outside."""
    b = F.floor((x - lo) / (hi - lo) * n)
    return F.when((x >= lo) & (x < hi), F.least(b, F.lit(n - 1)))
