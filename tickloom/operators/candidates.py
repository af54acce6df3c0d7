"""Candidates of a search: best trials, their limits and boundaries, orbital grids, phase exposure."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import kernels, stats

TWO_PI = 2 * math.pi


def boundaries(grid: DataFrame, index: str, peak: int, level: float) -> DataFrame:
    """First and last trial around a peak up to which the statistic stays above a level: lo, hi (indices of the outermost).

    The trials next to the peak that are below the level bound it; without one the grid's end does.
    """
    low = grid.where((F.col("stat") <= level) | F.col("stat").isNull())
    ends = grid.agg(F.min(index).alias("a"), F.max(index).alias("z"))
    near = low.agg(F.max(F.when(F.col(index) < peak, F.col(index))).alias("l"), F.min(F.when(F.col(index) > peak, F.col(index))).alias("h"))
    return ends.join(F.broadcast(near)).select(F.coalesce(F.col("l") + 1, F.col("a")).alias("lo"), F.coalesce(F.col("h") - 1, F.col("z")).alias("hi"))


def local_maxima(grid: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Trials of a two-dimensional grid that are not below any of their eight neighbours: by one join on shifted indices."""
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]))
    around = grid.select(F.col(i), F.col(j), F.col("stat"), shift.alias("s")).groupBy((F.col(i) + F.col("s.a")).alias(i), (F.col(j) + F.col("s.b")).alias(j)).agg(F.max("stat").alias("__around"))
    return grid.join(around, [i, j], "left").where(F.col("stat") >= F.coalesce("__around", F.lit(-math.inf))).drop("__around")


def candidate_table(spark: SparkSession, best: list[dict], counts: float, n: int) -> DataFrame:
    """Power limits and pulsed amplitudes of the best trials (f, fdot, stat): a handful of rows made on the driver."""
    rows = []
    for c in best:
        lo, hi = stats.power_limits(c["stat"], n, 0.8)
        noise = 2 * n
        rows.append((float(c["f"]), float(c.get("fdot", 0.0)), float(c["stat"]), lo, hi, stats.amplitude_of(max(c["stat"] - noise, 0.0), counts), stats.amplitude_of(lo, counts), stats.amplitude_of(hi, counts), stats.pulsed_fraction_limit(c["stat"], counts, n, 0.9)))
    return spark.createDataFrame(rows, "f double, fdot double, stat double, power_lo double, power_hi double, amp double, amp_lo double, amp_hi double, amp_limit double")


def orbital_grid(spark: SparkSession, draws: int, length: float, freqs: tuple[float, float], porbs: tuple[float, float], asinis: tuple[float, float], seed: int = 0) -> DataFrame:
    """Random trials of frequency, projected axis and period, as many as the resolution asks for: draw, freq, x, porb.

    The steps are dx = 1 / (2 pi f) and dOmega = 2 sqrt(3) / (2 pi f x T); counts follow per draw and per axis.
    """

    def uniform(salt: int, *cols: str):
        return F.pmod(F.xxhash64(*cols, F.lit(seed), F.lit(salt)), F.lit(2**52)) / float(2**52)

    rows = spark.range(draws).withColumnRenamed("id", "draw").withColumn("freq", F.lit(freqs[0]) + uniform(1, "draw") * (freqs[1] - freqs[0]))
    n_x = F.floor(F.lit(asinis[1] - asinis[0]) * TWO_PI * F.col("freq")) + 1
    rows = rows.withColumn("ix", F.explode(F.sequence(F.lit(1).cast("long"), n_x))).withColumn("x", F.lit(asinis[0]) + uniform(2, "draw", "ix") * (asinis[1] - asinis[0]))
    lo, hi = 1 / porbs[1], 1 / porbs[0]
    n_o = F.floor(F.lit(hi - lo) * TWO_PI * F.col("freq") * F.col("x") * length / (2 * math.sqrt(3))) + 1
    rows = rows.withColumn("io", F.explode(F.sequence(F.lit(1).cast("long"), n_o)))
    return rows.select("draw", "freq", "x", (1 / (F.lit(lo) + uniform(3, "draw", "ix", "io") * (hi - lo))).alias("porb"))


def pending(grid: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Trials without a result yet."""
    return grid.join(done, list(keys), "left_anti")


def phase_exposure(gtis: DataFrame, f: float, nbin: int) -> DataFrame:
    """Exposure of each phase bin in good intervals, as a share of the mean: phbin, expo.

    Whole cycles count for all bins alike; what is left of an interval is shared out by the overlap with each bin.
    """
    a, z = F.col("start") * f, F.col("stop") * f
    rest = gtis.select(a.alias("a"), z.alias("z"), F.floor(z - a).alias("whole")).withColumn("a", F.col("a") + F.col("whole"))
    rows = rest.withColumn("phbin", F.explode(F.sequence(F.lit(0), F.lit(nbin - 1))))
    first = F.floor("a")

    def overlap(cycle):
        lo = cycle + F.col("phbin") / F.lit(float(nbin))
        return F.greatest(F.least("z", lo + 1 / nbin) - F.greatest("a", lo), F.lit(0.0))

    part = F.col("whole") / F.lit(float(nbin)) + overlap(first) + overlap(first + 1)
    sums = rows.groupBy("phbin").agg(F.sum(part).alias("e"))
    return sums.withColumn("expo", F.col("e") / F.avg("e").over(Window.partitionBy())).select("phbin", "expo")


def fit_peak(freqs: np.ndarray, power: np.ndarray, kind: str = "sinc", width: float | None = None) -> tuple[float, float, float]:
    """Centre, height and width of a peak as squared sinc or Gaussian, by Gauss-Newton steps from the highest point."""
    k = int(np.argmax(power))
    w = width or (freqs[-1] - freqs[0]) / 4 or 1.0

    def model(p):
        u = (freqs - p[0]) / p[2]
        return p[1] * (np.sinc(u) ** 2 if kind == "sinc" else np.exp(-0.5 * u * u))

    p = np.array([freqs[k], power[k], w], float)
    lam = 1e-3
    cost = ((power - model(p)) ** 2).sum()
    for _ in range(200):
        step = np.maximum(np.abs(p) * 1e-6, [w * 1e-6, 1e-9, w * 1e-6])
        jac = np.stack([(model(p + np.eye(3)[i] * step[i]) - model(p - np.eye(3)[i] * step[i])) / (2 * step[i]) for i in range(3)], 1)
        a = jac.T @ jac
        d = np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-30), jac.T @ (power - model(p)))
        new = ((power - model(p + d)) ** 2).sum()
        if new < cost:
            done = cost - new < 1e-12 * max(cost, 1e-30)
            p, cost, lam = p + d, new, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return float(p[0]), float(p[1]), abs(float(p[2]))


def default_template(profile: np.ndarray, fine: int = 100) -> tuple[np.ndarray, float]:
    """Smooth template of a profile and the phase of its maximum.

    The H test says how many harmonics matter: up to five, the profile is rebuilt from them on a finer grid; beyond, it is
    smoothed by a moving polynomial and interpolated.
    """
    n = len(profile)
    z = np.cumsum([kernels.z2_of_profiles(profile[None, :], k)[0] - (kernels.z2_of_profiles(profile[None, :], k - 1)[0] if k > 1 else 0) for k in range(1, min(20, n // 2) + 1)])
    harmonics = int(np.argmax(z - 4 * np.arange(1, len(z) + 1) + 4)) + 1
    harmonics = min(max(1, n // 16), harmonics)
    if harmonics <= 5:
        f = np.fft.rfft(profile)
        keep = np.zeros(n * fine // 2 + 1, complex)
        # Bins are centred half a bin into the phase; the finer grid is centred anew.
        shift = np.exp(-1j * TWO_PI * np.arange(harmonics + 1) * (0.5 / n - 0.5 / (n * fine)))
        keep[: harmonics + 1] = f[: harmonics + 1] * shift
        out = np.fft.irfft(keep, n * fine) * fine
    else:
        smooth = kernels.savitzky_golay(profile, 5, 2)
        x = (np.arange(-1, n + 1) + 0.5) / n
        out = np.interp((np.arange(n * fine) + 0.5) / (n * fine), x, np.r_[smooth[-1], smooth, smooth[0]])
    return out, float(np.argmax(out) / len(out))


def two_sinusoids(profile: np.ndarray) -> tuple[float, float, float, float, float]:
    """Base, amplitude 1, phase 1, amplitude 2, phase 2 of base + a1 cos(2 pi (x + p1)) + a2 cos(2 pi (2 x + p2)): the least-squares fit on an even grid."""
    n = len(profile)
    f = np.fft.rfft(profile) / n
    half = 0.5 / n
    amps = 2 * np.abs(f[1:3])
    # The grid's first point is half a bin into the phase.
    phases = [float((np.angle(f[k]) / TWO_PI - k * half) % 1.0) for k in (1, 2)]
    return float(f[0].real), float(amps[0]), phases[0], float(amps[1]), phases[1]
