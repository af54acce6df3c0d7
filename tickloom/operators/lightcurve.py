"""Light curves and what is made of them: exposure, colours, excess variance, rebinning, histograms, baselines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.kernels import als_baseline


def dense_bins(df: DataFrame, n: int, tstart: float, dt: float) -> DataFrame:
    """All bins of a grid with their centre: bin, time."""
    return df.sparkSession.range(n).select(F.col("id").alias("bin"), (F.col("id") * F.lit(float(dt)) + F.lit(tstart + dt / 2)).alias("time"))


def light_curve(events: DataFrame, dt: float, tstart: float, tstop: float, weight: str | None = None) -> DataFrame:
    """Counts (or sums of a weight) in uniform bins of [tstart, tstop), empty ones included: bin, time, counts, counts_err.

    The error is the root of the counts, or with a weight the counts times the population scatter of the weights.  Counts
    are combined before the shuffle, and the grid is joined to one row for each bin.
    """
    n = int((tstop - tstart) / dt)
    b = F.floor((F.col("t") - tstart) / dt)
    hits = events.where((F.col("t") >= tstart) & (F.col("t") < tstart + n * dt)).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), *([F.sum(weight).alias("w"), F.stddev_pop(weight).alias("s")] if weight else []))
    rows = dense_bins(events, n, tstart, dt).join(hits, "bin", "left")
    counts = F.coalesce("w", F.lit(0.0)) if weight else F.coalesce("n", F.lit(0))
    err = F.coalesce(F.col("n") * F.col("s"), F.lit(0.0)) if weight else F.sqrt(F.coalesce("n", F.lit(0)).cast("double"))
    return rows.select("bin", "time", counts.alias("counts"), err.alias("counts_err"))


def histogram(df: DataFrame, axes: Sequence[tuple[str, float, float, int]], weight: str | None = None) -> DataFrame:
    """Histogram over any number of axes (column, lo, hi, bins), right-open in all bins: b0, b1, ..., counts.

    Rows outside on any axis, and nulls, are left out; empty cells have no row.
    """
    keys = [F.when((F.col(c) >= lo) & (F.col(c) < hi), F.least(F.floor((F.col(c) - lo) / (hi - lo) * n), F.lit(n - 1))).alias(f"b{i}") for i, (c, lo, hi, n) in enumerate(axes)]
    rows = df.select(*keys, *([F.col(weight).alias("w")] if weight else []))
    for i in range(len(axes)):
        rows = rows.where(F.col(f"b{i}").isNotNull())
    return rows.groupBy(*[f"b{i}" for i in range(len(axes))]).agg((F.sum("w") if weight else F.count(F.lit(1))).alias("counts"))


def scrunch(curves: DataFrame, series: str, n_series: int | None = None) -> DataFrame:
    """Sum of light curves over the bins that all series have (all that there are, or ``n_series``): bin, counts."""
    sums = curves.groupBy("bin").agg(F.sum("counts").alias("counts"), F.countDistinct(series).alias("__n"))
    if n_series is None:
        sums = sums.join(F.broadcast(curves.agg(F.countDistinct(series).alias("__all"))), F.col("__n") == F.col("__all")).drop("__all")
    else:
        sums = sums.where(F.col("__n") == n_series)
    return sums.drop("__n")


def livetime_per_bin(events: DataFrame, dt: float, n_bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Livetime in each bin: every event's interval [t - prior, t] shared out among the bins it overlaps: keys, bin, expo."""
    a, z = F.col("t") - F.col("prior"), F.col("t")
    rows = events.where("prior > 0").withColumn("bin", F.explode(F.sequence(F.floor(a / dt), F.floor(z / dt))))
    part = F.least(z, (F.col("bin") + 1) * F.lit(float(dt))) - F.greatest(a, F.col("bin") * F.lit(float(dt)))
    return rows.where(F.col("bin").between(0, n_bins - 1)).groupBy(*keys, "bin").agg(F.sum(F.greatest(part, F.lit(0.0))).alias("expo"))


def exposure_corrected(counts: Column, expo: Column, dt: float, limit: float = 1e-7) -> Column:
    """Counts as if the bin had full exposure; 0 where exposure is below the limit."""
    return F.when(expo < limit, 0.0).otherwise(counts / expo * F.lit(float(dt)))


def color_evolution(events: DataFrame, bands: Sequence[tuple[float, float]], segment: float) -> DataFrame:
    """Ratio of counts of two bands per segment with its error: seg, ratio, ratio_err, both counts. Bands are closed.

    Segments without counts in the first band have a null ratio.
    """
    (a0, a1), (b0, b1) = bands
    seg = F.floor(F.col("t") / segment).alias("seg")
    rows = events.groupBy(seg).agg(F.count_if(F.col("energy").between(a0, a1)).alias("n1"), F.count_if(F.col("energy").between(b0, b1)).alias("n2"))
    ratio = F.when(F.col("n1") > 0, F.col("n2") / F.col("n1"))
    err = F.when((F.col("n1") > 0) & (F.col("n2") > 0), ratio * F.sqrt(1 / F.col("n1") + 1 / F.col("n2")))
    return rows.select("seg", "n1", "n2", ratio.alias("ratio"), err.alias("ratio_err"))


def excess_variance(bins: DataFrame, per_segment: int, step: int) -> DataFrame:
    """Excess variance, normalised excess variance and fractional variability of overlapping segments of bins.

    ``bins``: bin, counts, counts_err.  Segments start every ``step`` bins; only full ones count.
    """
    b = F.col("bin")
    first = F.greatest(F.floor((b - per_segment) / step) + 1, F.lit(0))
    rows = bins.withColumn("seg", F.explode(F.sequence(first, F.floor(b / step))))
    out = rows.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.avg("counts").alias("m"), F.var_samp("counts").alias("v"), F.avg(F.col("counts_err") * F.col("counts_err")).alias("e")).where(F.col("n") == per_segment)
    raw = F.col("v") - F.col("e")
    norm = F.when(F.col("m") > 0, raw / (F.col("m") * F.col("m")))
    return out.select("seg", raw.alias("excvar"), norm.alias("norm_excvar"), F.when(norm >= 0, F.sqrt(norm)).alias("fvar"))


def rebin_curve(bins: DataFrame, factor: int) -> DataFrame:
    """Sum of every ``factor`` bins; a remainder at the end is dropped: bin, counts."""
    return bins.groupBy(F.floor(F.col("bin") / factor).alias("bin")).agg(F.sum("counts").alias("counts"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == factor).drop("__n")


def baseline(curves: DataFrame, p: float = 0.01, lam: float = 1e5) -> DataFrame:
    """Asymmetric least-squares baseline of each light curve (series, bin, counts): adds base.

    A curve is one banded system and stays in one task; split longer ones into stretches by the series column.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf.assign(base=als_baseline(pdf["counts"].to_numpy(float), lam, p))

    return curves.select("series", "bin", F.col("counts").cast("double").alias("counts")).groupBy("series").applyInPandas(solve, "series string, bin bigint, counts double, base double")


def incident_rate(detected: Column, dead: float) -> Column:
    """Incident rate of a detected one: 1 / (1 / r - dead)."""
    return 1.0 / (1.0 / detected - F.lit(float(dead)))


def detected_rate(incident: Column, dead: float) -> Column:
    """Detected rate of an incident one: 1 / (1 / r + dead)."""
    return 1.0 / (1.0 / incident + F.lit(float(dead)))


def bin_time(value: float) -> float:
    """Bin time as given, or 2 to its power if negative; 0 is an error."""
    if value == 0:
        raise ValueError("bin time can't be 0")
    return 2.0**value if value < 0 else float(value)


def smooth_lengths(most: int) -> np.ndarray:
    """Sorted products of powers of 2, 3 and 5 up to a number."""
    out = {2**a * 3**b * 5**c for a in range(64) if 2**a <= most for b in range(41) if 2**a * 3**b <= most for c in range(28) if 2**a * 3**b * 5**c <= most}
    return np.array(sorted(out))
