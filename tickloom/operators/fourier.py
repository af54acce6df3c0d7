"""Fourier operators: segment spectra, cross spectra, lags, power colours, energy-dependent variability."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def segment_bins(events: DataFrame, dt: float, segment: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in the bins of segments of equal length from time 0: keys, seg, bin, n. Empty bins have no row.

    Zeros add nothing to a transform, so that the sparse form is enough; it is combined before the shuffle.
    """
    seg = F.floor(F.col("t") / segment)
    b = F.floor((F.col("t") - seg * F.lit(float(segment))) / dt)
    return events.groupBy(*keys, seg.alias("seg"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bins_in_segments(events: DataFrame, segments: DataFrame, dt: float, length: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in the bins of given segments, as those inside good intervals (see gti.segments): keys, seg, bin, n.

    ``segments``: keys, start.  Each begins where its interval does, so that none reaches into a gap and what is left of an
    interval is left out; ``seg`` is the segment's start in microseconds.  Events find their segment by a join on buckets of a
    segment's length, of which each segment touches two; events outside all of them are dropped.
    """
    first = F.floor(F.col("start") / length)
    near = segments.select(*keys, F.col("start").alias("__s"), F.explode(F.array(first, first + 1)).alias("__b"))
    rows = events.withColumn("__b", F.floor(F.col("t") / length)).join(near, [*keys, "__b"]).where((F.col("t") >= F.col("__s")) & (F.col("t") < F.col("__s") + length))
    seg, b = F.round(F.col("__s") * 1e6).cast("long"), F.floor((F.col("t") - F.col("__s")) / dt)
    return rows.groupBy(*keys, seg.alias("seg"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def segment_dft(bins: DataFrame, n_bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Fourier sums of every segment at the positive frequencies below Nyquist: keys, seg, k, re, im, n_ph.

    For few bins in a segment: each bin adds its terms to all frequencies and the sums are ordinary aggregates.
    """
    terms = bins.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit((n_bins - 1) // 2))))
    angle = F.col("k") * F.col("bin") * F.lit(TWO_PI / n_bins)
    return terms.groupBy(*keys, "seg", "k").agg(F.sum(F.col("n") * F.cos(angle)).alias("re"), (-F.sum(F.col("n") * F.sin(angle))).alias("im"), F.sum("n").alias("n_ph"))


def segment_fft(bins: DataFrame, n_bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """The same by fast transforms, for many bins: a segment's bins are its task's memory, and segments run in parallel."""
    ks = list(keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bins.schema if f.name in ks)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n_bins)
        x[pdf["bin"].to_numpy()] = pdf["n"].to_numpy()
        z = np.fft.rfft(x)[1 : (n_bins - 1) // 2 + 1]
        out = pd.DataFrame({"k": np.arange(1, len(z) + 1, dtype="int32"), "re": z.real, "im": z.imag, "n_ph": int(x.sum())})
        for name, v in zip([*ks, "seg"], key):
            out[name] = v
        return out[[*ks, "seg", "k", "re", "im", "n_ph"]]

    return bins.groupBy(*ks, "seg").applyInPandas(run, (fields + ", " if fields else "") + "seg bigint, k int, re double, im double, n_ph bigint")


def power(re: Column, im: Column, n_ph: Column, segment: float, norm: str) -> Column:
    """Power of a transform: 'leahy', 'abs', 'frac' (squared rms per Hz) or 'none'."""
    p = re * re + im * im
    if norm == "leahy":
        return 2.0 * p / n_ph
    if norm == "abs":
        return 2.0 * p / F.lit(float(segment))
    if norm == "frac":
        return 2.0 * p * F.lit(float(segment)) / (n_ph * n_ph)
    if norm == "none":
        return p
    raise ValueError(f"unknown norm {norm}")


def averaged_spectrum(dft: DataFrame, segment: float, norm: str = "leahy", keys: Sequence[str] = ()) -> DataFrame:
    """Mean power over segments: keys, k, freq, power, power_err (power over the root of the segments), m, n_ph."""
    out = dft.withColumn("p", power(F.col("re"), F.col("im"), F.col("n_ph"), segment, norm))
    out = out.groupBy(*keys, "k").agg(F.avg("p").alias("power"), F.count(F.lit(1)).alias("m"), F.sum("n_ph").alias("n_ph"))
    return out.select(*keys, "k", (F.col("k") / F.lit(float(segment))).alias("freq"), "power", (F.col("power") / F.sqrt(F.col("m").cast("double"))).alias("power_err"), "m", "n_ph")


def average_spectra(spectra: DataFrame) -> DataFrame:
    """Spectra (k, power, power_err, m) of several files as one: means weighted by their segments."""
    m = F.sum("m")
    return spectra.groupBy("k").agg((F.sum(F.col("power") * F.col("m")) / m).alias("power"), (F.sqrt(F.sum(F.pow("power_err", 2) * F.col("m"))) / m).alias("power_err"), m.alias("m"))


def rebin_linear(spectrum: DataFrame, factor: int) -> DataFrame:
    """Mean of every ``factor`` frequencies, an incomplete last bin left out: j, freq, power, power_err, m."""
    j = F.floor((F.col("k") - 1) / factor)
    out = spectrum.groupBy(j.alias("j")).agg(F.avg("freq").alias("freq"), F.avg("power").alias("power"), (F.sqrt(F.sum(F.pow("power_err", 2))) / F.count(F.lit(1))).alias("power_err"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") == factor).drop("n")


def rebin_geometric(spectrum: DataFrame, ratio: float) -> DataFrame:
    """Mean over bins whose width grows by a ratio, as floor(log(k) / log(1 + ratio)): j, freq, power, m."""
    j = F.floor(F.log(F.col("k").cast("double")) / F.lit(math.log(1 + ratio)) + 1e-9)
    return spectrum.groupBy(j.alias("j")).agg(F.avg("freq").alias("freq"), F.avg("power").alias("power"), F.sum("m").alias("m"))


def cross_spectrum(a: DataFrame, b: DataFrame, segment: float, keys: Sequence[str] = ()) -> DataFrame:
    """Mean cross spectrum of two series over the segments both have, Leahy normalised with the geometric mean of counts.

    Output: keys, k, freq, re (cospectrum), im, p1, p2 (mean Leahy powers), m.
    """
    y = b.select(*keys, "seg", "k", F.col("re").alias("re2"), F.col("im").alias("im2"), F.col("n_ph").alias("n2"))
    both = a.join(y, [*keys, "seg", "k"])
    scale = 2.0 / F.sqrt(F.col("n_ph") * F.col("n2"))
    out = both.select(
        *keys, "k",
        (scale * (F.col("re") * F.col("re2") + F.col("im") * F.col("im2"))).alias("c"),
        (scale * (F.col("im") * F.col("re2") - F.col("re") * F.col("im2"))).alias("q"),
        (2.0 * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n_ph")).alias("a"),
        (2.0 * (F.col("re2") * F.col("re2") + F.col("im2") * F.col("im2")) / F.col("n2")).alias("b"),
    )
    out = out.groupBy(*keys, "k").agg(F.avg("c").alias("re"), F.avg("q").alias("im"), F.avg("a").alias("p1"), F.avg("b").alias("p2"), F.count(F.lit(1)).alias("m"))
    return out.withColumn("freq", F.col("k") / F.lit(float(segment)))


def coherence(cross: DataFrame) -> DataFrame:
    """Raw coherence |C|^2 / (P1 P2): k, freq, coherence."""
    c = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("p1") * F.col("p2"))
    return cross.select("k", "freq", c.alias("coherence"))


def time_lags(cross: DataFrame) -> DataFrame:
    """Time lag of the phase of the mean cross spectrum and its error: k, freq, lag, lag_err."""
    g = F.least((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("p1") * F.col("p2")), F.lit(1.0))
    phase_err = F.sqrt((1 - g) / (2 * g * F.col("m")))
    return cross.select("k", "freq", (F.atan2("im", "re") / (F.lit(TWO_PI) * F.col("freq"))).alias("lag"), (phase_err / (F.lit(TWO_PI) * F.col("freq"))).alias("lag_err"))


def band_power(dft: DataFrame, edges: Sequence[float], segment: float, noise: float = 2.0) -> DataFrame:
    """Power above the noise in bands [edge, next edge) for each segment: seg, band, var."""
    f = F.col("k") / F.lit(float(segment))
    band = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        band = F.when((f >= edges[i]) & (f < edges[i + 1]), i).otherwise(band)
    p = power(F.col("re"), F.col("im"), F.col("n_ph"), segment, "leahy")
    return dft.select("seg", band.alias("band"), ((p - noise) / segment).alias("v")).where("band is not null").groupBy("seg", "band").agg(F.sum("v").alias("var"))


def power_colors(dft: DataFrame, edges: Sequence[float], segment: float, rebin: int = 5, noise: float = 2.0) -> DataFrame:
    """Power colours of every ``rebin`` segments: group, pc1 = var C / var A, pc2 = var B / var D, hue.

    Groups where a colour isn't positive are left out. The hue is the angle in the plane of the logarithms around
    (4.51920, 0.453724), counted from the direction of 135 degrees.
    """
    v = band_power(dft, edges, segment, noise).groupBy(F.floor(F.col("seg") / rebin).alias("grp")).agg(*[F.sum(F.when(F.col("band") == i, F.col("var"))).alias(c) for i, c in enumerate("abcd")])
    out = v.select("grp", (F.col("c") / F.col("a")).alias("pc1"), (F.col("b") / F.col("d")).alias("pc2")).where("pc1 > 0 and pc2 > 0")
    x, y = F.log10(F.col("pc1")) - math.log10(4.51920), F.log10(F.col("pc2")) - math.log10(0.453724)
    angle = F.lit(3 * math.pi / 4) - F.atan2(y, x)
    return out.withColumn("hue", angle - F.floor(angle / TWO_PI) * F.lit(TWO_PI))


def lomb_scargle(rows: DataFrame, freqs: Sequence[float]) -> DataFrame:
    """Lomb-Scargle power of unevenly sampled values (t, y) at frequencies: freq, power.

    Standard normalisation with the offset tau.  Two passes of sums for each frequency; no pair of rows is ever formed.
    """
    stat = rows.agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    grid = F.array(*[F.lit(float(f)) for f in freqs])
    x = rows.join(F.broadcast(stat)).select("t", (F.col("y") - F.col("m")).alias("y"), "v", F.explode(grid).alias("freq"))
    w = F.lit(2 * TWO_PI) * F.col("freq") * F.col("t")
    tau = x.groupBy("freq").agg(F.sum(F.sin(w)).alias("s"), F.sum(F.cos(w)).alias("c")).select("freq", (F.atan2("s", "c") / (F.lit(2 * TWO_PI) * F.col("freq"))).alias("tau"))
    z = x.join(F.broadcast(tau), "freq").withColumn("a", F.lit(TWO_PI) * F.col("freq") * (F.col("t") - F.col("tau")))
    c, s = F.cos("a"), F.sin("a")
    sums = z.groupBy("freq").agg(F.sum(F.col("y") * c).alias("yc"), F.sum(F.col("y") * s).alias("ys"), F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.max("v").alias("v"))
    return sums.select("freq", ((F.col("yc") * F.col("yc") / F.col("cc") + F.col("ys") * F.col("ys") / F.col("ss")) / (2 * F.col("v"))).alias("power"))


def variability_by_energy(events: DataFrame, dt: float, segment: float, edges: Sequence[float], ref: tuple[float, float], n_bins: int) -> DataFrame:
    """Counts, fractional rms, lag and covariance of energy bands against a reference band, over all positive frequencies.

    A band's photons are taken out of the reference where they overlap.  Output: band, counts, rms, lag, cov.
    """
    band = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        band = F.when((F.col("energy") >= edges[i]) & (F.col("energy") < edges[i + 1]), i).otherwise(band)
    marked = events.withColumns({"band": band, "in_ref": (F.col("energy") >= ref[0]) & (F.col("energy") < ref[1])})
    own = segment_dft(segment_bins(marked.where("band is not null"), dt, segment, ["band"]), n_bins, ["band"])
    all_ref = segment_dft(segment_bins(marked.where("in_ref"), dt, segment), n_bins).select("seg", "k", F.col("re").alias("rr"), F.col("im").alias("ri"), F.col("n_ph").alias("rn"))
    shared = segment_dft(segment_bins(marked.where("band is not null and in_ref"), dt, segment, ["band"]), n_bins, ["band"]).select("band", "seg", "k", F.col("re").alias("sr"), F.col("im").alias("si"), F.col("n_ph").alias("sn"))
    x = own.join(all_ref, ["seg", "k"]).join(shared, ["band", "seg", "k"], "left")
    rr, ri, rn = (F.col(a) - F.coalesce(b, F.lit(0)) for a, b in (("rr", "sr"), ("ri", "si"), ("rn", "sn")))
    x = x.withColumns({"rr": rr, "ri": ri, "rn": rn})
    df = 1.0 / segment
    c, q = F.col("re") * F.col("rr") + F.col("im") * F.col("ri"), F.col("im") * F.col("rr") - F.col("re") * F.col("ri")
    per = x.groupBy("band").agg(
        F.avg((2.0 * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) - 2.0 * F.col("n_ph")) * segment / (F.col("n_ph") * F.col("n_ph"))).alias("p"),
        F.avg(2.0 / segment * c).alias("c"), F.avg(2.0 / segment * q).alias("q"),
        F.avg((2.0 * (F.col("rr") * F.col("rr") + F.col("ri") * F.col("ri")) - 2.0 * F.col("rn")) / segment).alias("pr"),
        F.avg("k").alias("kk"), F.max("k").alias("nk"))
    counts = marked.where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("counts"))
    power_sum = F.col("p") * df * F.col("nk")
    lag = F.atan2("q", "c") / (F.lit(TWO_PI) * F.col("kk") * df)
    cov = F.when(F.col("pr") > 0, F.sqrt((F.col("c") * F.col("c") + F.col("q") * F.col("q")) * df * F.col("nk") / F.col("pr")))
    return counts.join(per, "band").select("band", "counts", F.when(power_sum > 0, F.sqrt(power_sum)).otherwise(0.0).alias("rms"), lag.alias("lag"), cov.alias("cov"))
