import numpy as np

from tickloom.sources import fits, sinks


def test_fits_round_trip(spark, tmp_path):
    p = str(tmp_path / "a.evt")
    t = np.arange(10.0)
    fits.write_table(p, "EVENTS", {"TIME": t, "PI": np.arange(10, dtype="i4")}, {"MJDREFI": 55197, "MJDREFF": 0.25})
    fits.write_table(p, "GTI", {"START": np.array([0.0]), "STOP": np.array([9.0])}, append=True)
    spark.dataSource.register(fits.FitsTable)
    df = spark.read.format("fits_table").option("rows_each", 3).load(p)
    assert sorted(map(tuple, df.collect())) == [(float(i), i) for i in range(10)]
    assert [tuple(r) for r in spark.read.format("fits_table").option("extension", "GTI").load(p).collect()] == [(0.0, 9.0)]
    header = next(h for h, _ in fits.tables(p))
    assert fits.high_precision(header, "MJDREF") == 55197.25 and fits.high_precision(header, "TIMEZERO") is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, 0.5), (0, 1.5, None)], "bin long, counts double, err double")
    sinks.write_qdp(df, str(tmp_path / "a.qdp"), [("bin", None), ("counts", "err")], ["bin"])
    assert (tmp_path / "a.qdp").read_text().splitlines() == ["READ SERR 2", "0 1.5 NO", "1 2.5 0.5"]
    assert sinks.write_binary(df, str(tmp_path / "a.dat"), 3) == 4
    assert np.fromfile(tmp_path / "a.dat", np.float32).tolist() == [1.5, 2.5, 0.0, 0.0]
    sinks.write_ascii(df, str(tmp_path / "txt"), ["bin", "counts"], ["bin"])
    back = sinks.columns_from_ascii(spark, str(tmp_path / "txt" / "part-*"), "bin long, counts double")
    assert sorted(map(tuple, back.collect())) == [(0, 1.5), (1, 2.5)]
