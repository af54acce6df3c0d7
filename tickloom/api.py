"""Fluent frames over the operators: an event list and a spectrum with what belongs to them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import events as ev
from tickloom.operators import folding, fourier, gti
from tickloom.operators import lightcurve as lc


@dataclass(frozen=True)
class SpectrumFrame:
    """A spectrum (k, freq, power, power_err, m) and the length of its segments."""

    df: DataFrame
    segment: float
    norm: str = "leahy"

    def rebin(self, factor: float) -> DataFrame:
        """By a whole factor evenly, else geometrically by its fraction above one."""
        return fourier.rebin_linear(self.df, int(factor)) if float(factor).is_integer() else fourier.rebin_geometric(self.df, factor - 1)


@dataclass(frozen=True)
class EventFrame:
    """Events (event_id, t, ...) between tstart and tstop, with good intervals (start, stop) if given."""

    df: DataFrame
    tstart: float
    tstop: float
    gtis: DataFrame | None = None

    def filter_energy(self, lo: float | None, hi: float | None, closed: str = "both") -> EventFrame:
        return replace(self, df=ev.filter_energy(self.df, lo, hi, closed))

    def where(self, condition: str) -> EventFrame:
        """Filter by a SQL expression over the columns; nothing else is evaluated."""
        return replace(self, df=self.df.where(F.expr(condition)))

    def good(self) -> EventFrame:
        """Only events in good intervals."""
        return self if self.gtis is None else replace(self, df=gti.inside(self.df, self.gtis))

    def deorbit(self, asini: float, porb: float, t0: float) -> EventFrame:
        return replace(self, df=self.df.withColumn("t", ev.orbit_delay(F.col("t"), asini, porb, t0)))

    def light_curve(self, dt: float, weight: str | None = None) -> DataFrame:
        return lc.light_curve(self.df, lc.bin_time(dt), self.tstart, self.tstop, weight)

    def spectrum(self, dt: float, segment: float, norm: str = "leahy", fft: bool | None = None) -> SpectrumFrame:
        """Averaged spectrum; segments of more than 256 bins go through fast transforms."""
        n = round(segment / lc.bin_time(dt))
        bins = fourier.segment_bins(self.df.withColumn("t", F.col("t") - self.tstart), lc.bin_time(dt), segment)
        dft = (fourier.segment_fft if (n > 256 if fft is None else fft) else fourier.segment_dft)(bins, n)
        return SpectrumFrame(fourier.averaged_spectrum(dft, segment, norm), segment, norm)

    def fold(self, nbin: int, f: float, fdot: float = 0.0, pepoch: float = 0.0) -> DataFrame:
        return folding.fold(self.df.withColumn("t", F.col("t") - pepoch), nbin, f, fdot)

    def search(self, freqs: Sequence[float], fdots: Sequence[float] = (0.0,), nbin: int = 16, n: int = 2, kind: str = "z2") -> DataFrame:
        """Statistic over a grid of trials: i, j, stat."""
        p = folding.trial_profiles(self.df, nbin, freqs, fdots)
        return folding.z2_stat(p, nbin, n, ["i", "j"]) if kind == "z2" else folding.epoch_folding_stat(p, nbin, ["i", "j"])
