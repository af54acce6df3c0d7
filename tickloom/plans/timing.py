"""Timing queries over the events stream and the domain's tables, each with its SQL in timing_sql.

The events of the stream stand for photons: t is seconds since 2024-01-01, energy the value, pi the number in props,
instr the event type, detector_id the user modulo 4.  They span 30 days.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import kernels, stats
from tickloom.functions.expr import phase, rough_energy, wrap_around_zero, wrap_zero_one
from tickloom.operators import events as ev
from tickloom.operators import candidates, folding, fourier, gti, simulate
from tickloom.operators import lightcurve as lc
from tickloom.operators.blocks import broadcast_if_small, ranked
from tickloom.operators.ingest import IngestOptions, fill_gaps, ingest, occultations
from tickloom.operators.intervals import periods_and_gaps, to_millis
from tickloom.sources.sinks import xspec_rows
from tickloom.sources.tables import first_arrivals, read_table

SPAN, HOUR, DAY = 2_592_000.0, 3600.0, 86_400.0
N_HOURS, N_DAYS = 720, 30
#: Trial frequency and grid around one cycle a day.
F0 = 1 / 86_400.0
FREQS = [F0 * (1 + (i - 24) / 600) for i in range(49)]
FDOTS = [(j - 2) * 2e-13 for j in range(5)]
#: Edges of frequency bands of a day's segments of hours.
EDGES = [0.9 / DAY, 3.5 / DAY, 6.5 / DAY, 9.5 / DAY, 11.5 / DAY]
NPROF, NBIN = 32, 16
SHIFTS = [-8.0, -6.0, -4.0, -2.0, 0.0, 2.0, 4.0, 6.0, 8.0]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as photons; columns that aren't used are pruned at the scan."""
    rows = read_table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6
    return rows.select("event_id", t.alias("t"), F.col("value").alias("energy"), F.get_json_object("props", "$.k").cast("int").alias("pi"), F.col("event_type").alias("instr"), (F.col("user_id") % 4).alias("detector_id"), "user_id")


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def _hourly(e: DataFrame) -> DataFrame:
    return lc.light_curve(e, HOUR, 0.0, SPAN)


def lightcurve_hourly(s, d):
    return _round(_hourly(events(s, d)), "counts_err").withColumn("counts", F.col("counts").cast("long"))


def lightcurve_energy_band(s, d):
    e = ev.filter_energy(events(s, d), 5.0, 20.0, "right")
    return _hourly(e).select("bin", "time", F.col("counts").cast("long").alias("counts"))


def lightcurve_weighted(s, d):
    return _round(lc.light_curve(events(s, d), HOUR, 0.0, SPAN, "energy"), "counts", "counts_err", digits=5)


def filter_energy_closed(s, d):
    return ev.filter_energy(events(s, d), 3.0, 30.0).select("event_id", "energy")


def filter_pi(s, d):
    return events(s, d).where(ev.between(F.col("pi"), 20, 60, "right")).select("event_id", "pi")


def rough_calibration(s, d):
    obs = read_table(s, d, "observation").select("obs_id", "mission").dropDuplicates(["obs_id"])
    rows = first_arrivals(read_table(s, d, "photon").select("event_id", "obs_id", "pi"), "event_id").join(broadcast_if_small(obs), "obs_id")
    return rows.select("event_id", F.round(rough_energy(F.col("pi"), F.col("mission")), 6).alias("energy_kev")).where("energy_kev is not null")


def calibrate_lookup(s, d):
    response = s.range(90).select(F.col("id").cast("int").alias("channel"), (F.col("id") * 0.04 + 1.58).alias("e_min"), (F.col("id") * 0.04 + 1.62).alias("e_max"))
    return _round(ev.calibrate_by_table(events(s, d), response).select("event_id", "energy"), "energy")


def _gti_of(s, d, instr: str | None, least: int) -> DataFrame:
    e = events(s, d)
    e = e if instr is None else e.where(F.col("instr") == instr)
    return gti.intervals_where(_hourly(e), F.col("counts") > least, HOUR)


def gti_from_condition(s, d):
    return _gti_of(s, d, None, 12)


def gti_intersect(s, d):
    return gti.intersect(_gti_of(s, d, "click", 1), _gti_of(s, d, "view", 1))


def gti_complement(s, d):
    return gti.complement(_gti_of(s, d, None, 12))


def gti_safe_minlen(s, d):
    return gti.shrink(_gti_of(s, d, None, 10), 600.0, 300.0, 7200.0)


def gti_total_exposure(s, d):
    return _gti_of(s, d, None, 12).agg(F.sum(F.col("stop") - F.col("start")).alias("exposure"), F.count(F.lit(1)).alias("n_gti"))


def apply_gti(s, d):
    return gti.inside(events(s, d), _gti_of(s, d, None, 12)).select("event_id", "t")


def photons_in_gti(s, d):
    """Photons of every observation inside its merged good periods."""
    spans = read_table(s, d, "observation").select(F.col("obs_id").alias("key"), to_millis("tstart").alias("span_start"), to_millis("tstop").alias("span_stop"))
    rows = read_table(s, d, "gti").where("gti_stop > gti_start").select(F.col("obs_id").alias("key"), to_millis("gti_start").alias("start"), to_millis("gti_stop").alias("stop"))
    good = periods_and_gaps(rows, spans).where("span_kind = 'period'").select(F.col("key").alias("obs_id"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    photons = first_arrivals(read_table(s, d, "photon").select("event_id", "obs_id", to_millis("event_time").cast("double").alias("t")).where("t is not null"), "event_id")
    return gti.inside(photons, good, ["obs_id"], 3_600_000.0).groupBy("obs_id").agg(F.count(F.lit(1)).alias("n_photons"))


def occultation_gti(s, d):
    """Empty bins are occultations if the median of a bin's counts is high enough."""
    bins = lc.light_curve(events(s, d), 2 * HOUR, 0.0, SPAN)
    median = bins.agg(F.percentile("counts", 0.5).alias("median"))
    return gti.intervals_where(bins.join(F.broadcast(median)), (F.col("counts") > 0) | (F.col("median") <= 5), 2 * HOUR)


def split_overlap_chunks(s, d):
    return ev.split_overlapping(events(s, d), 0.0, SPAN, 5 * DAY, 0.5).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t"), 6).alias("first_t"), F.round(F.max("t"), 6).alias("last_t"))


def split_detector_chunks(s, d):
    return events(s, d).groupBy("detector_id", F.floor(F.col("t") / DAY).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


def split_at_mjd(s, d):
    at = (60325.5 - 60310.0) * DAY
    return events(s, d).groupBy(F.when(F.col("t") < at, 1).otherwise(2).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t"), 6).alias("last_t"))


def join_events_union(s, d):
    e = events(s, d)
    a, b = e.where("instr = 'click'").select("event_id", "t", "energy"), e.where("instr = 'view'").select("event_id", "t", "pi")
    return _round(ev.concatenate([(a, 60310.0), (b, 60311.0)], 60310.0), "t")


def concatenate_sorted(s, d):
    e = events(s, d)
    rows = ev.concatenate([(e.where(F.col("detector_id") == i).select("event_id", "t"), 60310.0) for i in range(4)], 60310.0)
    return _round(rows.orderBy("t", "event_id"), "t")


def scrunch_lightcurves(s, d):
    e = events(s, d)
    return lc.scrunch(e.groupBy("instr", F.floor(F.col("t") / HOUR).alias("bin")).agg(F.count(F.lit(1)).alias("counts")), "instr")


def join_lightcurves_instr(s, d):
    return events(s, d).groupBy("instr", F.floor(F.col("t") / (6 * HOUR)).alias("bin")).agg(F.count(F.lit(1)).alias("counts"))


def livetime_per_bin(s, d):
    return _round(lc.livetime_per_bin(ev.with_prior(events(s, d), ["instr"], 1800.0), HOUR, N_HOURS), "expo")


def exposure_corrected_lc(s, d):
    e = ev.with_prior(events(s, d), ["instr"], 1800.0)
    n = e.groupBy("instr", F.floor(F.col("t") / HOUR).alias("bin")).agg(F.count(F.lit(1)).alias("counts"))
    grid = e.select("instr").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_HOURS - 1).cast("long"))))
    bins = grid.join(n, ["instr", "bin"], "left").join(lc.livetime_per_bin(e, HOUR, N_HOURS, ["instr"]), ["instr", "bin"], "left")
    corrected = lc.exposure_corrected(F.coalesce("counts", F.lit(0)), F.coalesce("expo", F.lit(0.0)), HOUR, 60.0)
    return bins.select("instr", "bin", F.round(corrected, 6).alias("counts"))


def deadtime_paralyzable(s, d):
    return ev.dead_time_paralyzable(events(s, d), ["instr"], 300.0).select("event_id")


def deadtime_nonparalyzable(s, d):
    return ev.dead_time(events(s, d), ["instr"], 300.0).select("event_id")


def color_evolution(s, d):
    return _round(lc.color_evolution(events(s, d), [(0.0, 10.0), (10.5, 80.0)], DAY), "ratio", "ratio_err")


def hardness_intensity(s, d):
    c = lc.color_evolution(events(s, d), [(0.0, 10.0), (10.5, 80.0)], DAY)
    return _round(c.select("seg", "ratio", ((F.col("n1") + F.col("n2")) / DAY).alias("rate")), "ratio", "rate", digits=9)


def excess_variance(s, d):
    return _round(lc.excess_variance(_hourly(events(s, d)), 24, 12), "excvar", "norm_excvar", "fvar")


def rebin_lightcurve(s, d):
    return lc.rebin_curve(_hourly(events(s, d)), 7).select("bin", F.col("counts").cast("long").alias("counts"))


def histogram_2d(s, d):
    return lc.histogram(events(s, d), [("t", 0.0, SPAN, 10), ("energy", 0.0, 50.0, 8)])


def histogram_3d_weighted(s, d):
    return _round(lc.histogram(events(s, d), [("t", 0.0, SPAN, 6), ("energy", 0.0, 50.0, 5), ("pi", 0.0, 100.0, 4)], "energy"), "counts", digits=4)


def rate_inversion(s, d):
    r = events(s, d).groupBy("instr").agg((F.count(F.lit(1)) / SPAN).alias("detected"))
    return _round(r.select("instr", "detected", lc.incident_rate(F.col("detected"), 30.0).alias("incident"), lc.detected_rate(lc.incident_rate(F.col("detected"), 30.0), 30.0).alias("again")), "detected", "incident", "again", digits=12)


def _dft(s, d, fft: bool = False, keys=(), where: str = "true") -> DataFrame:
    bins = fourier.segment_bins(events(s, d).where(where), HOUR, DAY, keys)
    return (fourier.segment_fft if fft else fourier.segment_dft)(bins, 24, keys)


def _pds(s, d, norm: str, fft: bool = False, digits: int = 6) -> DataFrame:
    return _round(fourier.averaged_spectrum(_dft(s, d, fft), DAY, norm), "power", "power_err", digits=digits).select("k", F.round("freq", 12).alias("freq"), "power", "power_err", "m")


def pds_leahy(s, d):
    return _pds(s, d, "leahy")


def pds_fft_arrow(s, d):
    return _pds(s, d, "leahy", True)


def pds_frac(s, d):
    return _pds(s, d, "frac", digits=3)


def pds_abs(s, d):
    return _pds(s, d, "abs", digits=9)


def _gti_segments(s, d) -> DataFrame:
    """Segments of a day inside the good time, which are the runs of hours with events."""
    return gti.segments(_gti_of(s, d, None, 0), DAY)


def _gti_dft(s, d, where: str = "true") -> DataFrame:
    return fourier.segment_dft(fourier.bins_in_segments(events(s, d).where(where), _gti_segments(s, d), HOUR, DAY), 24)


def pds_gti(s, d):
    """Averaged spectrum over full segments inside the good time only."""
    return _round(fourier.averaged_spectrum(_gti_dft(s, d), DAY).select("k", F.round("freq", 12).alias("freq"), "power", "m"), "power")


def cospectrum_gti(s, d):
    """Cross spectrum of two instruments over the same segments inside the good time."""
    cross = fourier.cross_spectrum(_gti_dft(s, d, "instr = 'click'"), _gti_dft(s, d, "instr = 'view'"), DAY)
    return _round(cross.select("k", F.col("re").alias("cospectrum"), F.col("im").alias("quadrature"), "m"), "cospectrum", "quadrature")


def pds_dynamic(s, d):
    out = _dft(s, d)
    return out.select("seg", "k", F.round(fourier.power(F.col("re"), F.col("im"), F.col("n_ph"), DAY, "leahy"), 6).alias("power"))


def pds_rebin_linear(s, d):
    return _round(fourier.rebin_linear(fourier.averaged_spectrum(_dft(s, d), DAY), 3), "power", "power_err").withColumn("freq", F.round("freq", 12))


def pds_rebin_geom(s, d):
    return _round(fourier.rebin_geometric(fourier.averaged_spectrum(_dft(s, d), DAY), 0.5), "power").withColumn("freq", F.round("freq", 12))


def pds_average_files(s, d):
    own = fourier.averaged_spectrum(_dft(s, d, keys=["instr"]), DAY, "leahy", ["instr"])
    return _round(fourier.average_spectra(own), "power", "power_err")


def xspec_export(s, d):
    return _round(xspec_rows(fourier.averaged_spectrum(_dft(s, d), DAY), 1 / DAY), "f_lo", "f_hi", "flux", "flux_err", digits=10)


def _cross(s, d) -> DataFrame:
    return fourier.cross_spectrum(_dft(s, d, where="instr = 'click'"), _dft(s, d, where="instr = 'view'"), DAY)


def cospectrum(s, d):
    return _round(_cross(s, d).select("k", F.col("re").alias("cospectrum"), F.col("im").alias("quadrature"), "m"), "cospectrum", "quadrature")


def coherence(s, d):
    return _round(fourier.coherence(_cross(s, d)).select("k", "coherence"), "coherence", digits=7)


def time_lags(s, d):
    return _round(fourier.time_lags(_cross(s, d)).select("k", "lag", "lag_err"), "lag", "lag_err", digits=2)


def lomb_scargle(s, d):
    rows = events(s, d).select("t", F.col("energy").alias("y"))
    freqs = [(i + 1) / (4 * DAY) for i in range(30)]
    return fourier.lomb_scargle(rows, freqs).select(F.round(F.col("freq") * 4 * DAY).cast("long").alias("i"), F.round("power", 5).alias("power"))


def power_colors(s, d):
    return _round(fourier.power_colors(_dft(s, d), EDGES, DAY, 5, 0.0), "pc1", "pc2", "hue")


def _by_energy(s, d) -> DataFrame:
    return fourier.variability_by_energy(events(s, d), HOUR, DAY, [0.0, 5.0, 10.0, 20.0, 1000.0], (0.0, 1000.0), 24)


def rms_energy(s, d):
    return _round(_by_energy(s, d).select("band", "rms"), "rms")


def count_energy(s, d):
    return _by_energy(s, d).select("band", "counts")


def lag_energy(s, d):
    return _round(_by_energy(s, d).select("band", "lag"), "lag", digits=2)


def cov_energy(s, d):
    return _round(_by_energy(s, d).select("band", "cov"), "cov", digits=7)


def fold_profile(s, d):
    return folding.fold(events(s, d), NBIN, F0, 1e-14)


def phase_energy_hist(s, d):
    """Phase by energy, with energy bins of equal population."""
    e = events(s, d)
    cuts = e.agg(F.percentile("energy", [0.25, 0.5, 0.75]).alias("q"))
    rows = e.join(F.broadcast(cuts)).withColumn("ebin", F.expr("cast(energy > q[0] as int) + cast(energy > q[1] as int) + cast(energy > q[2] as int)"))
    return folding.fold(rows, NBIN, F0, keys=["ebin"])


def phaseogram(s, d):
    return folding.phaseogram(events(s, d), 8, 10, F0, SPAN)


def phaseogram_norm(s, d):
    cells = folding.phaseogram(events(s, d), 8, 10, F0, SPAN)
    out = {n: folding.normalize_rows(cells, "tbin", "counts", n).select("phbin", "tbin", F.lit(n).alias("kind"), F.col("norm")) for n in ("to1", "meansub", "meannorm", "mediansub", "std")}
    first, *rest = out.values()
    for r in rest:
        first = first.unionByName(r)
    return _round(first, "norm")


def _grid(s, d, fdots=(0.0,)) -> DataFrame:
    return folding.trial_profiles(events(s, d), NBIN, FREQS, fdots)


def ef_search(s, d):
    return _round(folding.epoch_folding_stat(_grid(s, d), NBIN, ["i"]), "stat")


def z2_search(s, d):
    return _round(folding.z2_stat(_grid(s, d), NBIN, 2, ["i"]), "stat")


def z2_fdot_search(s, d):
    return _round(folding.z2_stat(folding.trial_profiles(events(s, d), NBIN, FREQS[::4], FDOTS), NBIN, 2, ["i", "j"]), "stat")


def h_test(s, d):
    return _round(folding.h_test(folding.fold(events(s, d), 64, F0, keys=["instr"]), 64, ["instr"]), "h")


def dyn_search(s, d):
    e = events(s, d).withColumn("win", F.floor(F.col("t") / (10 * DAY)))
    return _round(folding.z2_stat(folding.trial_profiles(e, NBIN, FREQS[::6], keys=["win"]), NBIN, 1, ["win", "i"]), "stat")


def qffa_search(s, d):
    pre = folding.prefold(events(s, d), F0, 0.0, NBIN, NPROF, SPAN)
    return _round(folding.shift_search(pre, NBIN, NPROF, SHIFTS, SHIFTS[::2], 2), "stat")


def transient_search(s, d):
    pre = folding.prefold(events(s, d), F0, 0.0, NBIN, NPROF, SPAN)
    return _round(folding.transient_search(pre, NBIN, NPROF, 1), "stat")


def top_candidates(s, d):
    grid = _round(folding.z2_stat(_grid(s, d), NBIN, 2, ["i"]), "stat")
    return folding.top_candidates(grid, 5, "i")


def super_threshold_peaks(s, d):
    grid = _round(folding.epoch_folding_stat(_grid(s, d), NBIN, ["i"]), "stat")
    return folding.peaks(grid, "i", round(stats.fold_level(NBIN, 0.5), 3))


def phase_tag(s, d):
    p = phase(F.col("t") - SPAN / 2, F0, 1e-13)
    return events(s, d).select("event_id", F.round(p, 6).alias("ph"), F.round(wrap_around_zero(p), 6).alias("ph_half"), F.round(wrap_zero_one(p), 6).alias("ph_one"))


def deorbit_circular(s, d):
    return events(s, d).select("event_id", F.round(ev.orbit_delay(F.col("t"), 12.5, 3.7 * DAY, 1000.0), 5).alias("t_emit"))


def interpolate_orbit(s, d):
    """Delay interpolated from a grid of the model."""
    step = SPAN / 1000
    grid = s.range(1001).select((F.col("id") * step).alias("t"), (12.5 * F.sin(F.col("id") * (2 * math.pi * step / (3.7 * DAY)))).alias("value"))
    return ev.interpolate(events(s, d).select("event_id", "t"), grid, step, "delay").select("event_id", F.round("delay", 5).alias("delay"))


def orbital_search(s, d):
    return folding.orbital_search(events(s, d), F0, 8, [500.0, 2000.0], [2 * DAY, 3 * DAY], 6).select("x", "p", "max_stat", "min_stat")


def ffa_search(s, d):
    bins = _hourly(events(s, d))
    return _round(folding.ffa_search(bins, HOUR, list(range(18, 31))), "period", "stat")


def toas(s, d):
    template = 1 + np.cos(2 * np.pi * (np.arange(NBIN) + 0.5) / NBIN)
    e = events(s, d).withColumn("seg", F.floor(F.col("t") / (5 * DAY)))
    return _round(folding.arrival_times(folding.fold(e, NBIN, F0, keys=["seg"]), template), "phase", "phase_err", "amp", "base")


def baseline_als(s, d):
    curves = events(s, d).groupBy(F.col("instr").alias("series"), F.floor(F.col("t") / (6 * HOUR)).alias("bin")).agg(F.count(F.lit(1)).alias("counts"))
    return _round(lc.baseline(curves), "base")


def accelsearch(s, d):
    bins = events(s, d).groupBy(F.floor(F.col("t") / (SPAN / 1024)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _round(folding.acceleration_search(bins, 1024, 10, 10), "power")


def simulate_events(s, d):
    rate = simulate.pulsed_rate(s, 1000, 5000.0, 0.01, 1.0, 0.5)
    return simulate.events_from_rate(rate, 1.0, 7).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def scramble_flat(s, d):
    """Counts of every interval after scrambling: those before it."""
    g = _gti_of(s, d, None, 12)
    return simulate.scramble(events(s, d), g, 11).groupBy("start", "stop").agg(F.count(F.lit(1)).alias("n"))


def z2_vs_pf(s, d):
    return _round(simulate.detection_study(s, 50, 400, 5), "fraction", "z2")


def lineitem_lightcurve_weighted(s, d):
    t = F.expr("timestampdiff(DAY, timestamp_ntz'1995-01-01 00:00:00', l_shipdate)")
    rows = read_table(s, d, "lineitem").select(t.alias("day"), "l_extendedprice", "l_returnflag")
    return rows.groupBy("l_returnflag", F.floor(F.col("day") / 7).alias("week")).agg(F.count(F.lit(1)).alias("counts"), F.round(F.sum("l_extendedprice"), 2).alias("flux"))


def lineitem_pds(s, d):
    """Spectrum of daily shipments in segments of 64 days."""
    t = F.expr("timestampdiff(DAY, timestamp_ntz'1995-01-01 00:00:00', l_shipdate)").cast("double")
    bins = fourier.segment_bins(read_table(s, d, "lineitem").select(t.alias("t")), 1.0, 64.0)
    return _round(fourier.averaged_spectrum(fourier.segment_dft(bins, 64), 64.0), "power", "power_err").select("k", "power", "power_err", "m")


def observation_spectra(s, d):
    """Averaged Leahy spectra of the photons of every mission, in segments of 16 s and bins of half a second."""
    obs = read_table(s, d, "observation").select("obs_id", "tstart", F.lower(F.trim("mission")).alias("mission")).where("mission is not null").dropDuplicates(["obs_id"])
    photons = first_arrivals(read_table(s, d, "photon").select("event_id", "obs_id", "event_time").where("event_time is not null"), "event_id")
    rows = photons.join(broadcast_if_small(obs), "obs_id").select("mission", "obs_id", F.round(F.col("event_time") - F.col("tstart"), 6).alias("t")).where("t >= 0")
    dft = fourier.segment_dft(fourier.segment_bins(rows, 0.5, 16.0, ["mission", "obs_id"]), 32, ["mission", "obs_id"])
    return _round(fourier.averaged_spectrum(dft, 16.0, "leahy", ["mission"]).select("mission", "k", "power", "m"), "power")


def ingest_chunks(s, d):
    """Events prepared with safe intervals and a least length, split by good interval."""
    rows, _ = ingest(events(s, d).select("event_id", "t"), _gti_of(s, d, None, 10), IngestOptions(min_length=7200.0, safe_before=600.0, safe_after=300.0, split_by_gti=True), 0.0, SPAN)
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t"), 6).alias("first_t"))


def occultation_ingest(s, d):
    """Good time after empty bins are taken for occultations."""
    whole = s.createDataFrame([(0.0, SPAN)], "start double, stop double")
    return occultations(events(s, d), whole, 2 * HOUR, 0.0, SPAN, 1.0)


def fill_short_gaps(s, d):
    """Random events at the local rate in short gaps of the good time."""
    rows, _ = fill_gaps(events(s, d).select("event_id", "t"), _gti_of(s, d, None, 12), 3 * HOUR, 5)
    return rows.where("filled").groupBy(F.floor(F.col("t") / HOUR).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def peak_boundaries(s, d):
    grid = _round(folding.z2_stat(_grid(s, d), NBIN, 2, ["i"]), "stat")
    return candidates.boundaries(grid, "i", 24, 1.0)


def grid_maxima(s, d):
    grid = _round(folding.z2_stat(folding.trial_profiles(events(s, d), NBIN, FREQS[::4], FDOTS), NBIN, 2, ["i", "j"]), "stat")
    return candidates.local_maxima(grid)


def phase_exposure(s, d):
    return _round(candidates.phase_exposure(_gti_of(s, d, None, 12), 1 / 30_000, 16), "expo", digits=7)


def candidate_limits(s, d):
    """Limits and amplitudes of the five best trials."""
    e = events(s, d)
    best = folding.top_candidates(_round(folding.z2_stat(_grid(s, d), NBIN, 2, ["i"]), "stat"), 5, "i").collect()
    return _round(candidates.candidate_table(s, [{"f": FREQS[r["i"]], "stat": r["stat"]} for r in best], float(e.count()), 2), "f", "power_lo", "power_hi", "amp", "amp_lo", "amp_hi", "amp_limit", digits=9)


def orbital_grid(s, d):
    """Trials of a random orbital grid that have no result yet."""
    grid = candidates.orbital_grid(s, 10, SPAN, (1e-5, 2e-5), (2 * DAY, 5 * DAY), (1000.0, 200_000.0), 3)
    return candidates.pending(grid, grid.where("draw < 3").select("draw").distinct(), "draw")


def pulsed_fraction_energy(s, d):
    """Pulsed fraction (max - min) / max of the profile of each energy quartile, with all phase bins."""
    e = events(s, d)
    cuts = e.agg(F.percentile("energy", [0.25, 0.5, 0.75]).alias("q"))
    rows = e.join(F.broadcast(cuts)).withColumn("ebin", F.expr("cast(energy > q[0] as int) + cast(energy > q[1] as int) + cast(energy > q[2] as int)"))
    prof = folding.fold(rows, NBIN, F0, keys=["ebin"]).groupBy("ebin").agg(F.max("counts").alias("hi"), F.min("counts").alias("low"), F.count(F.lit(1)).alias("n"))
    return prof.select("ebin", F.round((F.col("hi") - F.when(F.col("n") < NBIN, 0).otherwise(F.col("low"))) / F.col("hi"), 6).alias("pulsed_fraction"))


def color_color(s, d):
    """Two colours of the same segments."""
    e = events(s, d)
    soft, hard = (lc.color_evolution(e, bands, DAY).select("seg", F.col("ratio").alias(n)) for n, bands in (("soft", [(0.0, 5.0), (5.01, 10.0)]), ("hard", [(10.01, 20.0), (20.01, 80.0)])))
    return _round(soft.join(hard, "seg"), "soft", "hard")


def deadtime_distribution(s, d):
    """Histogram of the time between events less the livetime before each."""
    e = ev.with_prior(events(s, d), ["instr"], 7200.0)
    rows = e.withColumn("dead", F.col("prior") - F.least(F.col("prior"), F.lit(1800.0)))
    return lc.histogram(rows, [("dead", 0.0, 5400.0, 54)])


def pds_white_sub(s, d):
    """Spectrum above the level of its upper third, times frequency."""
    p = fourier.averaged_spectrum(_dft(s, d), DAY)
    level = p.where("k > 8").agg(F.avg("power").alias("level"))
    return _round(p.join(F.broadcast(level)).select("k", (F.col("freq") * (F.col("power") - F.col("level"))).alias("fp"), F.lit(round(stats.power_level(0.01, 11, 30), 6)).alias("detection")), "fp", digits=10)


def instrument_files(s, d):
    """Every observation with its position in the order of its instrument by start, from 1, and the number of them."""
    o = read_table(s, d, "observation").dropDuplicates(["obs_id"]).select("instr", "tstart", "obs_id")
    return ranked(o, ["instr"], ["tstart", "obs_id"], "at", "n").select("instr", F.col("n").cast("int").alias("n_files"), (F.col("at") + 1).alias("position"), "obs_id")


def observation_summary(s, d):
    """Header summary: photons, span in MJD and mean rate of every observation."""
    o = read_table(s, d, "observation").dropDuplicates(["obs_id"]).select("obs_id", "mission", "instr", "mjdref", "tstart", "tstop")
    n = first_arrivals(read_table(s, d, "photon").select("event_id", "obs_id"), "event_id").groupBy("obs_id").agg(F.count(F.lit(1)).alias("n"))
    rows = o.join(n, "obs_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mjd = lambda c: F.round(F.col(c) / DAY + F.col("mjdref"), 6)
    return rows.select("obs_id", "mission", "instr", "n", mjd("tstart").alias("mjd_start"), mjd("tstop").alias("mjd_stop"), F.round(F.col("n") / (F.col("tstop") - F.col("tstart")), 6).alias("rate"))


def channel_spectrum(s, d):
    """Counts of energies of every mission's photons in bins of half a keV, by the rough calibration."""
    return rough_calibration(s, d).groupBy(F.floor(F.col("energy_kev") * 2).alias("ebin")).agg(F.count(F.lit(1)).alias("n"))


def spectrum_model(s, d):
    """Maximum-likelihood fits of models to the averaged spectrum, which is a few rows."""
    p = sorted(fourier.averaged_spectrum(_dft(s, d), DAY).select("freq", "power", "m").collect())
    f, x, m = (np.array(c, float) for c in zip(*p))
    rows = []
    for kind in ("constant", "powerlaw"):
        q, ll = kernels.fit_spectrum(f, x, m, kind)
        rows.append((kind, json.dumps([round(float(v), 6) for v in q]), round(ll, 4)))
    return s.createDataFrame(rows, "model string, parameters string, loglike double")


NAMES = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n != "events"]
