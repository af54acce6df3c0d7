import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels, stats
from tickloom.functions.expr import phase, rough_energy, wrap_around_zero, wrap_zero_one
from tickloom.operators import events as ev
from tickloom.operators import folding, fourier, gti, simulate
from tickloom.operators import lightcurve as lc
from tickloom.plans import timing
from tickloom.streaming.light_curves import streaming_intervals, streaming_light_curve


def _events(spark, times, key="k"):
    return spark.createDataFrame([(i, key, float(t)) for i, t in enumerate(times)], "event_id long, instr string, t double")


def test_dead_time(spark, rows):
    rng = np.random.default_rng(11)
    t = np.sort(np.round(rng.uniform(0, 60, 150), 3))
    kept, last = [], -1e9
    for x in t:
        if x - last >= 0.4:
            kept.append(x)
            last = x
    assert [r[0] for r in rows(ev.dead_time(_events(spark, t), ["instr"], 0.4).select("t"))] == kept
    alone = [x for x, before in zip(t, np.r_[-1e9, t]) if x - before >= 0.4]
    assert [r[0] for r in rows(ev.dead_time_paralyzable(_events(spark, t), ["instr"], 0.4).select("t"))] == alone


def test_livetime(spark):
    # An event's live stretch is shared out among the bins by its overlap with each of them.
    rng = np.random.default_rng(12)
    t, prior = np.sort(rng.uniform(0, 20, 40)), rng.uniform(0, 3, 40)
    got = {r.bin: r.expo for r in lc.livetime_per_bin(spark.createDataFrame([(float(x), float(p)) for x, p in zip(t, prior)], "t double, prior double"), 2.0, 10).collect()}
    for b in range(10):
        want = sum(max(0.0, min(x, 2.0 * b + 2) - max(x - p, 2.0 * b)) for x, p in zip(t, prior))
        assert got.get(b, 0.0) == pytest.approx(want)


def test_segments_inside_good_time(spark):
    # Two intervals with a gap; the rest of each behind its last full segment is left out.
    good = spark.createDataFrame([(10.0, 55.0), (61.0, 82.0)], "start double, stop double")
    t = [9.0, 10.5, 29.9, 30.0, 49.0, 51.0, 58.0, 61.0, 80.0, 81.5]
    bins = fourier.bins_in_segments(_events(spark, t), gti.segments(good, 20.0), 5.0, 20.0)
    assert {(r.seg // 10**6, r.bin, r.n) for r in bins.collect()} == {(10, 0, 1), (10, 3, 1), (30, 0, 1), (30, 3, 1), (61, 0, 1), (61, 3, 1)}


def test_filters_and_calibration(spark, rows):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 30.0), (3, 4.0), (4, 1.0)], "t int, energy double")
    assert [r[0] for r in rows(ev.filter_energy(df, 3.0, None).select("t"))] == [2, 3]
    pi = spark.createDataFrame([(0, 0), (1, 0), (2, 30), (3, 4), (4, 1)], "t int, pi int")
    assert [r[0] for r in rows(ev.filter_energy(pi, None, 20.0).select("t"))] == [0, 1, 3, 4]
    cal = spark.createDataFrame([(0, "nustar"), (0, "IXPE"), (1200, "xmm"), (100, "nicer"), (5, "none"), (5, None)], "pi int, m string")
    assert [r[0] for r in cal.select(rough_energy(F.col("pi"), F.col("m"))).collect()] == [1.6, 0.0, pytest.approx(1.2), 1.0, None, None]


def test_wraps(spark):
    r = spark.range(1).select(wrap_zero_one(F.lit(3.1)), wrap_around_zero(F.lit(3.9)), phase(F.lit(2.5), 1.0)).first()
    assert [round(x, 9) for x in r] == [0.1, -0.1, 0.5]


def test_z2_and_h_of_a_sinusoid(spark):
    p = [(int(i), float(math.sin(2 * math.pi * (i + 0.5) / 100) + 1)) for i in range(100)]
    df = spark.createDataFrame(p, "phbin long, counts double").withColumn("k", F.lit(1))
    for n in (2, 4):
        assert folding.z2_stat(df, 100, n, ["k"]).first().stat == pytest.approx(50, rel=1e-6)
    h = folding.h_test(df, 100, ["k"], 4).first()
    assert h.h == pytest.approx(50, rel=1e-6) and h.m == 1


def test_dyadic_levels(spark):
    flat = [(k, b, 1.0) for k in range(16) for b in range(100) if k != 8] + [(8, b, math.sin(2 * math.pi * (b + 0.5) / 100) + 1) for b in range(100)]
    got = folding.transient_search(spark.createDataFrame(flat, "prof long, phbin long, counts double"), 100, 16, 2)
    best = {r.level: r.m for r in got.groupBy("level").agg(F.max("stat").alias("m")).collect()}
    assert [round(best[i], 4) for i in range(4)] == [50, 25, 12.5, 6.25]


def test_fast_fold_recovers_a_period():
    x = np.random.default_rng(1).poisson(10 + 8 * np.cos(2 * np.pi * np.arange(4096) / 32.25)).astype(float)
    p, z = kernels.fast_fold(x, 32)
    assert abs(p[np.argmax(z)] - 32.25) < 0.02 and kernels.fast_fold(x, 32)[0][0] == 32


def test_fast_fold_uses_the_whole_curve():
    # 720 bins at 22: 33 rows, more than a power of two, so that nothing at the end may be cut.
    x = np.zeros(720)
    x[715:] = 3
    for base in (22, 45, 90):
        rows = -(-720 // base)
        table = np.zeros(2 ** math.ceil(math.log2(rows)) * base)
        table[:720] = x
        direct = kernels.z2_of_profiles(table.reshape(-1, base).sum(axis=0)[None, :], 2)[0]
        assert kernels.fast_fold(x, base)[1][0] == pytest.approx(direct) and direct > 0


def test_fft_matches_sums(spark, rows):
    rng = np.random.default_rng(2)
    e = _events(spark, rng.uniform(0, 64, 500))
    bins = fourier.segment_bins(e, 0.5, 16.0, ["instr"])
    a = {(r.seg, r.k): (r.re, r.im) for r in fourier.segment_dft(bins, 32, ["instr"]).collect()}
    b = {(r.seg, r.k): (r.re, r.im) for r in fourier.segment_fft(bins, 32, ["instr"]).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_average_of_spectra(spark):
    df = spark.createDataFrame([(1, 3.0, 0.1, 1), (1, 3.0, 0.1, 2)], "k int, power double, power_err double, m int")
    r = fourier.average_spectra(df).first()
    assert (r.power, r.m) == (pytest.approx(3), 3) and r.power_err == pytest.approx(0.1 / math.sqrt(3))


def test_rebin_scrunch_bins(spark, rows):
    df = spark.createDataFrame([(i, i + 1) for i in range(11)], "bin long, counts long")
    assert [r[1] for r in rows(lc.rebin_curve(df, 2))] == [3, 7, 11, 15, 19]
    two = spark.createDataFrame([("a", i, 1) for i in range(4)] + [("b", i, c) for i, c in enumerate([1, 3, 4, 5])], "s string, bin long, counts long")
    assert [r[1] for r in rows(lc.scrunch(two, "s", 2))] == [2, 4, 5, 6]
    assert lc.bin_time(2) == 2 and lc.bin_time(-2) == 0.25
    with pytest.raises(ValueError):
        lc.bin_time(0)
    assert list(lc.smooth_lengths(12)) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 12]


def test_profile_norms(spark):
    df = spark.createDataFrame([(r, c, v) for r, row in enumerate([[1, 2], [2, 3], [3, 4]]) for c, v in enumerate(row)], "r int, c int, v int")
    out = {n: sorted(x.norm for x in folding.normalize_rows(df, "r", "v", n).where("r = 0").collect()) for n in ("meansub", "meannorm", "to1")}
    assert out["meansub"] == [-0.5, 0.5] and out["meannorm"] == [pytest.approx(-1 / 3), pytest.approx(1 / 3)] and out["to1"] == [0, 1]


def test_levels():
    assert stats.chi2_sf(9.210340371976182, 2) == pytest.approx(0.01)
    assert stats.chi2_isf(0.05, 15) == pytest.approx(24.9958, abs=1e-3)
    assert stats.z2_level(2, 0.01) == pytest.approx(13.2767, abs=1e-3)
    assert stats.multi_trial(stats.single_trial(0.01, 50), 50) == pytest.approx(0.01)
    lo, hi = stats.power_limits(50)
    assert lo < 50 < hi and stats.noncentral_sf(50, 2, hi) == pytest.approx(0.84, abs=1e-3)


def test_baseline_and_template():
    y = np.r_[np.ones(50) * 10, np.ones(10) * 100, np.ones(50) * 10].astype(float)
    z = kernels.als_baseline(y, 1e3)
    n = len(y)
    d = np.diff(np.eye(n), 2, axis=0)
    w = np.where(y > z, 0.01, 0.99)
    assert np.allclose(z, np.linalg.solve(np.diag(w) + 1e3 * d.T @ d, w * y), atol=1e-6)
    t = np.exp(-0.5 * ((np.arange(64) / 64 - 0.5) / 0.1) ** 2)
    ph, err, amp, _ = kernels.fit_template(20 + 200 * np.roll(t, 13), t)
    assert abs(ph - 13 / 64) < 3 * err + 1e-6 and amp == pytest.approx(200, rel=0.01)


def test_acceleration_finds_a_frequency():
    x = 100 + 30 * np.cos(2 * np.pi * 37 * np.arange(1024) / 1024)
    k, z, _ = kernels.accelerate(x, 10, 5)
    assert abs(k[0] - 37) <= 1 and z[0] == 0


def test_scramble_keeps_counts(spark):
    e = _events(spark, np.linspace(0, 99, 100))
    g = spark.createDataFrame([(0.0, 30.0), (50.0, 99.5)], "start double, stop double")
    out = simulate.scramble(e, g, 3).collect()
    assert sum(r.start == 0 for r in out) == 31 and all(r.start <= r.t < r.stop for r in out) or sum(r.start == 0 for r in out) == 30


def test_streams_match_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00") for i in range(0, 40, 3)] + [(99, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "event_id long, s string").select("event_id", F.to_timestamp("s").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, make in (("lc", lambda d: streaming_light_curve(d, "ts", "10 minutes", "1 minute")), ("gti", lambda d: streaming_intervals(d, "ts", "5 minutes", "1 minute"))):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "lc" else "append").trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = {(r.start, r.counts) for r in spark.table(name).collect()}
        want = {(r.start, r.counts) for r in make(df).collect()}
        assert got <= want and len(got) >= len(want) - 1


def _events_table(spark, tmp_path, n=80):
    """An events table in a folder, and its times and values."""
    rng = np.random.default_rng(6)
    ms, y = rng.choice(2_592_000_000, n, replace=False), rng.gamma(2.0, 5.0, n)
    df = spark.createDataFrame([(i, int(i), "click", int(m), float(v)) for i, (m, v) in enumerate(zip(ms, y))], "event_id long, user_id long, event_type string, ms long, value double")
    ts = F.timestamp_millis(F.col("ms") + 1_704_067_200_000).cast("timestamp_ntz")
    df.select("event_id", "user_id", "event_type", ts.alias("ts"), "value", F.lit('{"k": 1}').alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    return ms / 1000, y


def test_all_detectors_are_concatenated(spark, tmp_path):
    t, _ = _events_table(spark, tmp_path)
    got = [tuple(r) for r in timing.concatenate_sorted(spark, str(tmp_path)).collect()]
    assert got == sorted(((i, round(float(x), 6)) for i, x in enumerate(t)), key=lambda r: r[1])


def test_lomb_scargle_of_all_events(spark, tmp_path):
    t, y = _events_table(spark, tmp_path)
    got = {r.i: r.power for r in timing.lomb_scargle(spark, str(tmp_path)).collect()}
    d = y - y.mean()
    for i in range(1, 31):
        w = 2 * np.pi * i / 345_600.0
        a = w * t - np.arctan2(np.sin(2 * w * t).sum(), np.cos(2 * w * t).sum()) / 2
        power = ((d @ np.cos(a)) ** 2 / (np.cos(a) ** 2).sum() + (d @ np.sin(a)) ** 2 / (np.sin(a) ** 2).sum()) / (2 * y.var(ddof=1))
        assert got[i] == pytest.approx(power, abs=2e-5)
    assert len(got) == 30


def test_all_files_of_an_instrument_in_order(spark, tmp_path):
    rows = [(f"o{i:02d}", None if i % 4 == 0 else f"i{i % 4}", float((i * 7) % 10)) for i in range(40)]
    spark.createDataFrame(rows + rows[:3], "obs_id string, instr string, tstart double").write.parquet(str(tmp_path / "observation.parquet"))
    got = [tuple(r) for r in timing.instrument_files(spark, str(tmp_path)).collect()]
    want = []
    for k in (None, "i1", "i2", "i3"):
        own = sorted((t, o) for o, instr, t in rows if instr == k)
        want += [(k, len(own), n + 1, o) for n, (_, o) in enumerate(own)]
    assert len(got) == 40 and set(got) == set(want)
