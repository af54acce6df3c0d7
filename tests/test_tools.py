import math

import numpy as np
import pytest

from tickloom import cli
from tickloom.api import EventFrame
from tickloom.functions import names
from tickloom.operators import candidates, ingest


def test_names():
    assert names.extension("a/b_ev.evt.gz") == ".evt.gz" and names.split_extension("x.parquet") == ("x", ".parquet")
    assert names.product_root("a_ev_calib.parquet") == "a" and names.format_of("a.evt.gz") == "fits"
    assert names.common_name("nuA01_ev.nc", "nuB01_ev.nc") == "nu01_ev.nc" and names.common_name("a", "bb") == "common"
    assert names.kind_of_columns(["k", "power"]) == "pds" and names.kind_of_columns(["t"]) == "events"
    with pytest.raises(ValueError):
        names.format_of("a.unknown")


def test_product_root_column(spark):
    df = spark.createDataFrame([("a_ev_calib.evt.gz",), (None,)], "n string")
    assert [r[0] for r in df.select(names.product_root_column(df.n)).collect()] == ["a", None]


def test_templates():
    ph = (np.arange(64) + 0.5) / 64
    out, peak = candidates.default_template(np.cos(2 * np.pi * ph) + 2)
    assert out.max() == pytest.approx(3, abs=0.01) and min(peak, 1 - peak) < 0.01
    many = np.arange(0.005, 1, 0.001)
    sharp, _ = candidates.default_template(np.exp(-((many - 0.5) ** 2) / 2e-4))
    assert sharp.max() == pytest.approx(1, abs=0.1)
    base, a1, p1, a2, _ = candidates.two_sinusoids(5 + 2 * np.cos(2 * np.pi * (ph - 0.2)))
    assert (base, a1, a2) == (pytest.approx(5), pytest.approx(2), pytest.approx(0, abs=1e-9)) and p1 == pytest.approx(0.8, abs=1e-6)


def test_peak_fits():
    x = np.linspace(-1, 1, 81)
    for kind, f in (("sinc", lambda u: np.sinc(u) ** 2), ("gauss", lambda u: np.exp(-0.5 * u * u))):
        c, h, w = candidates.fit_peak(x, 7 * f((x - 0.12) / 0.3), kind)
        assert (c, h, w) == (pytest.approx(0.12, abs=1e-4), pytest.approx(7, rel=1e-3), pytest.approx(0.3, rel=1e-2))


def test_boundaries_and_maxima(spark):
    g = spark.createDataFrame([(i, float(s)) for i, s in enumerate([1, 5, 6, 9, 6, 1, 8])], "i long, stat double")
    assert tuple(candidates.boundaries(g, "i", 3, 4.0).first()) == (1, 4)
    two = spark.createDataFrame([(i, j, float(s)) for i, row in enumerate([[1, 2, 1], [2, 9, 2], [1, 2, 7]]) for j, s in enumerate(row)], "i long, j long, stat double")
    assert [(r.i, r.j) for r in candidates.local_maxima(two).collect()] == [(1, 1)]


def test_fill_and_occultations(spark):
    t = [i * 0.1 for i in range(1000) if not 400 <= i < 420 and not 700 <= i < 800]
    e = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "event_id long, t double")
    g = spark.createDataFrame([(0.0, 40.0), (42.0, 70.0), (80.0, 100.0)], "start double, stop double")
    rows, good = ingest.fill_gaps(e, g, 5.0, 1)
    made = [r.t for r in rows.where("filled").collect()]
    assert 5 <= len(made) <= 25 and all(40 <= x < 42 for x in made)
    assert sorted(tuple(r) for r in good.collect()) == [(0.0, 70.0), (80.0, 100.0)]
    whole = spark.createDataFrame([(0.0, 100.0)], "start double, stop double")
    assert sorted(tuple(r) for r in ingest.occultations(e, whole, 1.0, 0.0, 100.0, 5.0).collect()) == [(1.0, 39.0), (43.0, 69.0), (81.0, 99.0)]
    assert ingest.occultations(e, whole, 1.0, 0.0, 100.0).count() == 1


def test_frames_and_commands(spark, tmp_path):
    e = spark.createDataFrame([(i, i * 0.25, float(i % 7)) for i in range(400)], "event_id long, t double, energy double")
    f = EventFrame(e, 0.0, 100.0).filter_energy(1.0, None)
    assert sum(r.counts for r in f.light_curve(1.0).collect()) == e.where("energy >= 1").count()
    assert EventFrame(e, 0.0, 100.0).spectrum(0.5, 10.0).df.count() == 9
    assert f.search([0.1, 0.2]).count() == 2 and f.fold(8, 0.1).count() == 8
    e.write.parquet(str(tmp_path / "e"))
    assert cli.main(["light-curve", str(tmp_path / "e"), str(tmp_path / "lc"), "--bintime", "2", "--tstop", "100"]) == 0
    assert spark.read.parquet(str(tmp_path / "lc")).count() == 50
    assert cli.main(["make-gti", str(tmp_path / "lc"), str(tmp_path / "g"), "--filter", "counts > 0", "--bintime", "2"]) == 0
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "g")).collect()] == [(0.0, 100.0)]
    assert cli.main(["fake", "-", str(tmp_path / "f"), "--count", "10", "--tstop", "5"]) == 0 and spark.read.parquet(str(tmp_path / "f")).count() == 10
    assert math.isclose(spark.read.parquet(str(tmp_path / "lc")).agg({"counts": "sum"}).first()[0], 400)


def test_spectrum_fits():
    from tickloom.functions import kernels

    rng = np.random.default_rng(4)
    f, m = np.linspace(0.1, 10, 200), np.full(200, 50.0)
    true = 30 * (f / f.mean()) ** -1.5 + 2
    exact, _ = kernels.fit_spectrum(f, true, m, "powerlaw")
    assert exact == pytest.approx([30, 1.5, 2], rel=1e-3)
    q, ll = kernels.fit_spectrum(f, true * rng.gamma(50, 1 / 50, 200), m, "powerlaw")
    # Four times the errors that the information matrix gives at the truth: 0.99 for the norm, 0.021 for the index.
    assert q[0] == pytest.approx(30, abs=4.0) and q[1] == pytest.approx(1.5, abs=0.084) and ll > kernels.fit_spectrum(f, true, m, "constant")[1]
    line = 40 * 0.3**2 / ((f - 4) ** 2 + 0.3**2) + 2
    q, _ = kernels.fit_spectrum(f, line * rng.gamma(50, 1 / 50, 200), m, "lorentzian")
    assert q[1] == pytest.approx(4, abs=0.1) and q[2] == pytest.approx(0.3, rel=0.3)
