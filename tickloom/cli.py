"""Commands over Parquet folders: python -m tickloom.cli COMMAND INPUT OUTPUT [options]."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import names
from tickloom.operators import candidates, folding, fourier, gti, simulate
from tickloom.operators import events as ev
from tickloom.operators import lightcurve as lc

#: Options all commands share: name to type and default.
OPTIONS: dict[str, tuple[type, object]] = {
    "bintime": (float, 1.0), "tstart": (float, 0.0), "tstop": (float, 0.0), "emin": (float, None), "emax": (float, None), "segment": (float, 128.0), "norm": (str, "leahy"), "rebin": (float, 1.0),
    "freq": (float, 1.0), "fdot": (float, 0.0), "fmin": (float, 0.1), "fmax": (float, 1.0), "nbin": (int, 16), "harmonics": (int, 2), "oversample": (float, 2.0), "dead_time": (float, 0.0), "length": (float, 100.0), "overlap": (float, 0.0),
    "filter": (str, None), "min_length": (float, 0.0), "weight": (str, None), "asini": (float, 0.0), "porb": (float, 1.0), "t0": (float, 0.0), "second": (str, None), "seed": (int, 0), "asymmetry": (float, 0.01), "lam": (float, 1e5), "pulsed_fraction": (float, 0.0), "count": (int, 1000),
}


def _freqs(o) -> list[float]:
    step = 1 / (o.oversample * (o.tstop - o.tstart))
    return [o.fmin + i * step for i in range(int((o.fmax - o.fmin) / step + 1 + 1e-9))]


def _second(df: DataFrame, o) -> DataFrame:
    return df.sparkSession.read.parquet(o.second)


def _dft(df: DataFrame, o) -> DataFrame:
    n = round(o.segment / o.bintime)
    bins = fourier.segment_bins(df.withColumn("t", F.col("t") - o.tstart), o.bintime, o.segment)
    return (fourier.segment_fft if n > 256 else fourier.segment_dft)(bins, n)


def _rebin(df: DataFrame, o) -> DataFrame:
    if names.kind_of_columns(df.columns) == "lc":
        return lc.rebin_curve(df, int(o.rebin))
    return fourier.rebin_linear(df, int(o.rebin)) if float(o.rebin).is_integer() else fourier.rebin_geometric(df, o.rebin - 1)


COMMANDS: dict[str, tuple[str, Callable[[DataFrame, argparse.Namespace], DataFrame]]] = {
    "filter-events": ("events within an energy interval", lambda d, o: ev.filter_energy(d, o.emin, o.emax)),
    "light-curve": ("counts in uniform bins", lambda d, o: lc.light_curve(ev.filter_energy(d, o.emin, o.emax, "right"), lc.bin_time(o.bintime), o.tstart, o.tstop, o.weight)),
    "make-gti": ("intervals where a SQL condition on a light curve holds", lambda d, o: gti.shrink(gti.intervals_where(d, F.expr(o.filter), o.bintime), 0.0, 0.0, o.min_length)),
    "apply-gti": ("events in the intervals of the second input", lambda d, o: gti.inside(d, _second(d, o))),
    "split": ("sliding chunks of events", lambda d, o: ev.split_overlapping(d, o.tstart, o.tstop, o.length, o.overlap)),
    "join": ("events of both inputs in order of time", lambda d, o: d.unionByName(_second(d, o), allowMissingColumns=True).orderBy("t")),
    "dead-time": ("events after a dead time", lambda d, o: ev.dead_time(d.withColumn("__k", F.lit(0)), ["__k"], o.dead_time).drop("__k")),
    "deorbit": ("times of emission in a circular orbit", lambda d, o: d.withColumn("t", ev.orbit_delay(F.col("t"), o.asini, o.porb, o.t0))),
    "exposure": ("livetime of bins from events with prior", lambda d, o: lc.livetime_per_bin(d, o.bintime, int((o.tstop - o.tstart) / o.bintime))),
    "excess-variance": ("excess variance of segments of a light curve", lambda d, o: lc.excess_variance(d, int(o.length), max(1, int(o.length * (1 - o.overlap))))),
    "baseline": ("asymmetric least-squares baseline", lambda d, o: lc.baseline(d, o.asymmetry, o.lam)),
    "spectrum": ("averaged power spectrum", lambda d, o: fourier.averaged_spectrum(_dft(ev.filter_energy(d, o.emin, o.emax), o), o.segment, o.norm)),
    "dynamic-spectrum": ("power of every segment", lambda d, o: _dft(d, o).withColumn("power", fourier.power(F.col("re"), F.col("im"), F.col("n_ph"), o.segment, o.norm))),
    "cross-spectrum": ("averaged cross spectrum with the second input", lambda d, o: fourier.cross_spectrum(_dft(d, o), _dft(_second(d, o), o), o.segment)),
    "lags": ("time lags of a cross spectrum", lambda d, o: fourier.time_lags(d)),
    "sum-spectra": ("average of spectra, weighted by segments", lambda d, o: fourier.average_spectra(d)),
    "rebin": ("rebinned light curve or spectrum", _rebin),
    "fold": ("folded profile", lambda d, o: folding.fold(d, o.nbin, o.freq, o.fdot)),
    "phaseogram": ("phase by time histogram", lambda d, o: folding.phaseogram(d, o.nbin, 32, o.freq, o.tstop, o.fdot)),
    "z-search": ("Z squared over trial frequencies", lambda d, o: folding.z2_stat(folding.trial_profiles(d, o.nbin, _freqs(o)), o.nbin, o.harmonics, ["i"])),
    "ef-search": ("epoch-folding statistic over trial frequencies", lambda d, o: folding.epoch_folding_stat(folding.trial_profiles(d, o.nbin, _freqs(o)), o.nbin, ["i"])),
    "accel-search": ("frequency and drift search of binned events (bin, n)", lambda d, o: folding.acceleration_search(d, int((o.tstop - o.tstart) / o.bintime), 100, 20)),
    "h-test": ("H test of a profile", lambda d, o: folding.h_test(d.withColumn("__k", F.lit(0)), o.nbin, ["__k"]).drop("__k")),
    "phase-exposure": ("exposure of phase bins in intervals", lambda d, o: candidates.phase_exposure(d, o.freq, o.nbin)),
    "scramble": ("events at new times in the intervals of the second input", lambda d, o: simulate.scramble(d, _second(d, o), o.seed)),
    "fake": ("uniform events (the input is not read)", lambda d, o: simulate.uniform_events(SparkSession.active(), o.count, o.tstart, o.tstop, o.seed)),
}


def main(args: list[str] | None = None) -> int:
    """Run one command; returns 0."""
    p = argparse.ArgumentParser(prog="tickloom", description="\n".join(f"{k}: {h}" for k, (h, _) in COMMANDS.items()), formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("input")
    p.add_argument("output")
    for name, (kind, default) in OPTIONS.items():
        p.add_argument("--" + name.replace("_", "-"), dest=name, type=kind, default=default)
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    df = spark.range(0) if o.command == "fake" else spark.read.parquet(o.input)
    COMMANDS[o.command][1](df, o).write.mode("overwrite").parquet(o.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
