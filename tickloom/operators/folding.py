"""Folding and pulsation search: profiles, statistics over trial grids, pre-folded search, transients, candidates, arrival times."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import phase
from tickloom.functions import kernels

TWO_PI = 2 * math.pi


def fold(events: DataFrame, nbin: int, f: float, fdot: float = 0.0, fddot: float = 0.0, keys: Sequence[str] = (), t: Column | None = None) -> DataFrame:
    """Folded profile: keys, phbin, counts. Empty phase bins have no row."""
    p = phase(F.col("t") if t is None else t, f, fdot, fddot)
    return events.groupBy(*keys, F.least(F.floor(p * nbin), F.lit(nbin - 1)).alias("phbin")).agg(F.count(F.lit(1)).alias("counts"))


def trial_profiles(events: DataFrame, nbin: int, freqs: Sequence[float], fdots: Sequence[float] = (0.0,), keys: Sequence[str] = (), asini: float = 0.0) -> DataFrame:
    """Profiles at every point of a grid of trials: keys, i, j, phbin, counts.

    The trials are generated per event and folded into counts before anything is shuffled: what is sent is cells of the
    grid for each partition, not events times trials.
    """
    fs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("f")) for i, f in enumerate(freqs)])
    ds = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(d)).alias("d")) for j, d in enumerate(fdots)])
    rows = events.select(*keys, "t", F.explode(fs).alias("a")).select(*keys, "t", "a", F.explode(ds).alias("b"))
    p = phase(F.col("t"), F.col("a.f"), F.col("b.d"))
    return rows.groupBy(*keys, F.col("a.i").alias("i"), F.col("b.j").alias("j"), F.least(F.floor(p * nbin), F.lit(nbin - 1)).alias("phbin")).agg(F.count(F.lit(1)).alias("counts"))


def epoch_folding_stat(profiles: DataFrame, nbin: int, keys: Sequence[str]) -> DataFrame:
    """Chi squared of profiles against a constant, empty bins counted: keys, stat."""
    total, square = F.sum("counts"), F.sum(F.col("counts") * F.col("counts"))
    mean = total / F.lit(float(nbin))
    return profiles.groupBy(*keys).agg((square / mean - total).alias("stat"))


def z2_stat(profiles: DataFrame, nbin: int, n: int, keys: Sequence[str]) -> DataFrame:
    """Z squared with n harmonics of binned profiles: keys, stat."""
    angle = (F.col("phbin") + 0.5) * F.lit(TWO_PI / nbin)
    sums = []
    for h in range(1, n + 1):
        sums += [F.sum(F.col("counts") * F.cos(angle * h)).alias(f"c{h}"), F.sum(F.col("counts") * F.sin(angle * h)).alias(f"s{h}")]
    out = profiles.groupBy(*keys).agg(F.sum("counts").alias("w"), *sums)
    total = sum((F.col(f"c{h}") * F.col(f"c{h}") + F.col(f"s{h}") * F.col(f"s{h}") for h in range(1, n + 1)), F.lit(0.0))
    return out.select(*keys, (2.0 / F.col("w") * total).alias("stat"))


def h_test(profiles: DataFrame, nbin: int, keys: Sequence[str] = (), nmax: int = 20) -> DataFrame:
    """H = max over m of Z squared (m) - 4 m + 4, and the m: keys, h, m (the smallest of equals)."""
    rows = profiles.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(nmax))))
    angle = (F.col("phbin") + 0.5) * F.lit(TWO_PI / nbin) * F.col("k")
    per = rows.groupBy(*keys, "k").agg((2.0 * (F.pow(F.sum(F.col("counts") * F.cos(angle)), 2) + F.pow(F.sum(F.col("counts") * F.sin(angle)), 2)) / F.sum("counts")).alias("z"))
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    h = per.withColumn("h", F.sum("z").over(w) - 4 * F.col("k") + 4)
    return h.groupBy(*keys).agg(F.max("h").alias("h"), F.max_by("k", F.struct(F.round("h", 9), -F.col("k"))).alias("m"))


def phaseogram(events: DataFrame, nbin: int, nt: int, f: float, span: float, fdot: float = 0.0) -> DataFrame:
    """Phase by time histogram: phbin, tbin, counts."""
    p = phase(F.col("t"), f, fdot)
    tbin = F.floor(F.col("t") / (span / nt))
    return events.where((F.col("t") >= 0) & (F.col("t") < span)).groupBy(F.least(F.floor(p * nbin), F.lit(nbin - 1)).alias("phbin"), tbin.alias("tbin")).agg(F.count(F.lit(1)).alias("counts"))


def normalize_rows(cells: DataFrame, row: str, value: str, norm: str) -> DataFrame:
    """Normalise each row of a two-dimensional profile: 'to1', 'meansub', 'meannorm', 'mediansub', 'mediannorm', 'std', 'ratios'.

    Adds norm. All cells of a row have to be there; rows are short (the bins of a profile).
    """
    w = Window.partitionBy(row)
    x = F.col(value).cast("double")
    mean, low, high = F.avg(x).over(w), F.min(x).over(w), F.max(x).over(w)
    median, std = F.percentile(x, 0.5).over(w), F.stddev_pop(x).over(w)
    out = {"to1": (x - low) / (high - low), "meansub": x - mean, "meannorm": (x - mean) / mean, "mediansub": x - median, "mediannorm": (x - median) / median, "std": (x - mean) / std, "ratios": x / mean}
    return cells.withColumn("norm", out[norm])


def prefold(events: DataFrame, f: float, fdot: float, nbin: int, nprof: int, span: float) -> DataFrame:
    """One pass over the events for a whole range of trials: phase by time counts (prof, phbin, counts) at one frequency."""
    tmid = F.col("t") - span / 2
    p = phase(tmid, f, fdot)
    prof = F.least(F.floor(F.col("t") / (span / nprof)), F.lit(nprof - 1))
    return events.where((F.col("t") >= 0) & (F.col("t") < span)).groupBy(prof.alias("prof"), F.least(F.floor(p * nbin), F.lit(nbin - 1)).alias("phbin")).agg(F.count(F.lit(1)).alias("counts"))


def shift_search(profiles: DataFrame, nbin: int, nprof: int, linear: Sequence[float], quadratic: Sequence[float], n: int) -> DataFrame:
    """Statistic of all trials around a pre-folded frequency, by shifting and adding sub-profiles: l, q, stat.

    Sub-profile k is rolled by rint(u l + u^2 q) bins, u from -1 to 1: as many rows as phase-time cells times trials, which
    doesn't depend on the number of events.
    """
    ls = F.array(*[F.lit(float(x)) for x in linear])
    qs = F.array(*[F.lit(float(x)) for x in quadratic])
    u = F.col("prof") * F.lit(2.0 / (nprof - 1)) - 1
    rows = profiles.select("prof", "phbin", "counts", F.explode(ls).alias("l")).select("*", F.explode(qs).alias("q"))
    moved = F.pmod(F.col("phbin") + F.rint(u * F.col("l") + u * u * F.col("q")).cast("long"), F.lit(nbin))
    summed = rows.groupBy("l", "q", moved.alias("phbin")).agg(F.sum("counts").alias("counts"))
    return z2_stat(summed, nbin, n, ["l", "q"])


def transient_search(profiles: DataFrame, nbin: int, nprof: int, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Z squared of dyadic blocks of sub-profiles (nprof a power of 2): keys, level, tbin, stat. Level l joins 2^l of them."""
    if nprof & (nprof - 1):
        raise ValueError("nprof has to be a power of 2")
    rows = profiles.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(nprof.bit_length() - 1))))
    blocks = rows.groupBy(*keys, "level", F.shiftright(F.col("prof").cast("int"), 0).alias("prof"), "phbin").agg(F.sum("counts").alias("counts"))
    blocks = blocks.groupBy(*keys, "level", F.floor(F.col("prof") / F.pow(F.lit(2), F.col("level"))).alias("tbin"), "phbin").agg(F.sum("counts").alias("counts"))
    return z2_stat(blocks, nbin, n, [*keys, "level", "tbin"])


def top_candidates(grid: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k trials of the highest statistic, ties by the given columns: rank and all columns."""
    best = grid.orderBy(F.desc("stat"), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("stat"), *ties)))


def peaks(grid: DataFrame, x: str, threshold: float) -> DataFrame:
    """Peak of every run of neighbouring trials above a threshold: x, stat. ``x`` is the index of the trial."""
    w = Window.orderBy(x)
    high = grid.where(F.col("stat") > threshold)
    runs = high.withColumn("new", F.coalesce((F.col(x) - F.lag(x).over(w) > 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(w))
    return runs.groupBy("run").agg(F.max_by(x, "stat").alias(x), F.max("stat").alias("stat")).drop("run")


def ffa_search(bins: DataFrame, dt: float, periods: Sequence[int], n: int = 2) -> DataFrame:
    """Fast folding of a light curve (bin, counts) for base periods in bins: base, period, stat.

    Every base period is a task of its own; the light curve of a search is what one task holds.
    """
    ps = F.array(*[F.lit(int(p)) for p in periods])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(int(pdf["bin"].max()) + 1)
        x[pdf["bin"].to_numpy()] = pdf["counts"].to_numpy()
        p, z = kernels.fast_fold(x, int(key[0]), n)
        return pd.DataFrame({"base": np.full(len(p), key[0], "int32"), "period": p * dt, "stat": z})

    return bins.select(F.explode(ps).alias("base"), "bin", F.col("counts").cast("double").alias("counts")).groupBy("base").applyInPandas(run, "base int, period double, stat double")


def arrival_times(profiles: DataFrame, template: np.ndarray, keys: Sequence[str] = ("seg",)) -> DataFrame:
    """Phase of each segment's profile against a template, by the greatest correlation: seg, phase, phase_err, amp, base."""
    nbin = len(template)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(nbin)
        x[pdf["phbin"].to_numpy()] = pdf["counts"].to_numpy()
        ph, err, amp, base = kernels.fit_template(x, template)
        return pd.DataFrame({"seg": [key[0]], "phase": [ph], "phase_err": [err], "amp": [amp], "base": [base]})

    return profiles.groupBy(*keys).applyInPandas(run, "seg bigint, phase double, phase_err double, amp double, base double")


def orbital_search(events: DataFrame, f: float, nbin: int, asini: Sequence[float], porb: Sequence[float], t0_steps: int) -> DataFrame:
    """Epoch-folding statistic over orbits and times of passage: x, p, best_t0, max_stat, min_stat."""
    orbits = [(a, p, p * k / t0_steps) for a in asini for p in porb for k in range(t0_steps)]
    grid = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(p)).alias("p"), F.lit(float(z)).alias("z")) for a, p, z in orbits])
    rows = events.select("t", F.explode(grid).alias("o")).select("t", "o.*")
    first = F.col("t") - F.col("x") * F.sin(F.lit(TWO_PI) * (F.col("t") - F.col("z")) / F.col("p"))
    second = F.col("t") - F.col("x") * F.sin(F.lit(TWO_PI) * (first - F.col("z")) / F.col("p"))
    ph = phase(second, f)
    prof = rows.groupBy("x", "p", "z", F.least(F.floor(ph * nbin), F.lit(nbin - 1)).alias("phbin")).agg(F.count(F.lit(1)).alias("counts"))
    stat = epoch_folding_stat(prof, nbin, ["x", "p", "z"]).withColumn("stat", F.round("stat", 6))
    return stat.groupBy("x", "p").agg(F.max_by("z", F.struct("stat", -F.col("z"))).alias("best_t0"), F.max("stat").alias("max_stat"), F.min("stat").alias("min_stat"))


def acceleration_search(bins: DataFrame, n_bins: int, zmax: int, n_best: int) -> DataFrame:
    """Frequency and derivative search in the Fourier domain of one light curve (bin, n): k, z, power; the best ones.

    The transform of one light curve is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n_bins)
        x[pdf["bin"].to_numpy()] = pdf["n"].to_numpy()
        k, z, p = kernels.accelerate(x, zmax, n_best)
        return pd.DataFrame({"k": k.astype("int64"), "z": z.astype("float64"), "power": p})

    return bins.groupBy(F.lit(0).alias("g")).applyInPandas(run, "k bigint, z double, power double")
