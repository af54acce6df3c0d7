import json
import math

import numpy as np

from tickloom.operators.clocks import utc_instants
from tickloom.operators.drift import canonical_names, header, pair_renames, schema_changes, unified
from tickloom.operators.grid import regular_grid, spacing_of_readings
from tickloom.operators.spikes import implausible
from tickloom.operators.units import header_times, photon_energies

READ = "key string, reading_id long, t double, value double, counting int"
SRC = "key string, t0 double, step double, n_cells long, counting boolean"


def test_grid_marks_and_fills(spark):
    season = lambda u: 10 + 4 * u + 3 * math.cos(2 * math.pi * u)
    full = [("a", i, 100 + i * 2 + 0.5, season((i + 0.5) / 60), 0) for i in range(60) if i not in (0, 20, 21, 59)]
    odd = [("a", 900, None, 1.0, 0), ("a", 901, 140.5, None, 0), ("a", 902, 140.5, float("nan"), 0), ("a", 903, 99.0, 5.0, 0), ("a", 904, 221.0, 5.0, 0), ("x", 905, 1.0, 1.0, 0), ("a", 1, 102.5, full[0][3], 0)]
    src = spark.createDataFrame([("a", 100.0, 2.0, 60, False), ("b", 0.0, 1.0, 3, False), ("c", 0.0, None, 3, False), ("d", 0.0, 1.0, 0, False)], SRC)
    got = regular_grid(spark.createDataFrame(full + odd, READ), src).collect()
    empty = {(r.key, r.cell_no): r.value for r in got if not r.filled}
    assert set(empty) == {("a", 0), ("a", 20), ("a", 21), ("a", 59), ("b", 0), ("b", 1), ("b", 2)}
    assert all(abs(empty["a", i] - season((i + 0.5) / 60)) < 0.05 for i in (0, 20, 21, 59))
    assert empty["b", 0] is None and len(got) == 63


def test_grid_finds_the_season(spark):
    value = lambda k: 5 + 0.02 * k + 4 * math.sin(2 * math.pi * k / 30)
    gap = set(range(100, 125))
    rows = [(s, 1000 * n + k, k + 0.5, value(k), 0) for n, s in enumerate("ab") for k in range(240) if k not in gap]
    src = spark.createDataFrame([("a", 0.0, 1.0, 240, False, None), ("b", 0.0, 1.0, 240, False, 30.0)], SRC + ", season double")
    got = [r for r in regular_grid(spark.createDataFrame(rows, READ), src).collect() if not r.filled]
    assert {(r.key, r.cell_no) for r in got} == {(s, k) for s in "ab" for k in gap} and {r.origin for r in got} == {"predicted"}
    assert max(abs(r.value - value(r.cell_no)) for r in got) < 0.05


def test_grid_needs_its_regression(spark, tmp_path):
    from tickloom.plans import problems

    spark.createDataFrame([("a", 1, 0.5, 1.0, 1.0), ("a", 2, 3.5, 2.0, 1.0)], "series_id string, reading_id long, bin_time double, counts double, dt double").write.parquet(str(tmp_path / "lightcurve.parquet"))
    spark.createDataFrame([("a", 1.0, 0.0, 5.0)], "series_id string, timedel double, tstart double, tstop double").write.parquet(str(tmp_path / "lc_series.parquet"))
    spark.createDataFrame([], "obs_id string, event_id long, event_time double").write.parquet(str(tmp_path / "photon.parquet"))
    spark.createDataFrame([("o", 0.0, 2.0, 1.0)], "obs_id string, tstart double, tstop double, bin_dt double").write.parquet(str(tmp_path / "observation.parquet"))
    found = problems.p1_found(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("a", 1), ("a", 2), ("a", 4), ("o", 0), ("o", 1)}
    assert "coef" in found._jdf.queryExecution().optimizedPlan().toString()


def test_grid_counts_and_empty_tables(spark):
    src = spark.createDataFrame([("a", 0.0, 1.0, 3, True)], SRC)
    got = regular_grid(spark.createDataFrame([("a", 1, 0.2, 1.0, 0), ("a", 2, 0.7, 1.0, 0), ("a", 2, 0.7, 1.0, 0)], READ), src).collect()
    assert {(r.cell_no, r.filled, r.n_readings) for r in got} == {(0, True, 2), (1, False, 0), (2, False, 0)}
    assert regular_grid(spark.createDataFrame([], READ), spark.createDataFrame([], SRC)).count() == 0


def test_spacing(spark):
    rows = [("a", 0.25 + 0.5 * i, 0.0, 50.0) for i in range(100) if i % 7] + [("b", 1.0, 0.0, 9.0)]
    got = spacing_of_readings(spark.createDataFrame(rows, "key string, t double, t0 double, len double"), "key", "t", "t0", "len", 5.0).collect()
    assert [tuple(r) for r in got] == [("a", 0.5)]


def test_spikes_frozen_impossible(spark):
    rng = np.random.default_rng(0)
    y = rng.poisson(400 + 100 * np.sin(np.arange(300) / 40)).astype(float)
    y[50], y[51], y[120] = 2500, 2600, 0
    y[200:210] = y[200]
    y[30], y[31], y[32] = -5, 7.5, np.inf
    few = rng.poisson(0.3, 200).astype(float)
    gauss = rng.normal(0, 5, 200)
    gauss[77] = 120
    data = [("p", i, float(i), float(v), True) for i, v in enumerate(y)] + [("f", 1000 + i, float(i), float(v), True) for i, v in enumerate(few)]
    data += [("g", 2000 + i, float(i), float(v), False) for i, v in enumerate(gauss)] + [("p", 9000, 3.5, None, True), ("p", 9001, None, 1e9, True), ("p", 9002, 4.5, float("nan"), True), (None, 9003, 1.0, 1.0, True), ("s", 9004, 1.0, -1.0, True), ("p", 50, 50.0, 2500.0, True)]
    got = implausible(spark.createDataFrame(data, "key string, reading_id long, t double, value double, counting boolean")).collect()
    assert sorted((r.reading_id, r.reason) for r in got) == sorted([(50, "spike"), (51, "spike"), (120, "spike"), (30, "impossible"), (31, "impossible"), (32, "impossible"), (2077, "spike"), (9004, "impossible"), *((i, "frozen") for i in range(200, 210))])


def test_blocks_of_any_size_give_the_same(spark):
    from tickloom.operators.spikes import BLOCK_ROWS

    rng = np.random.default_rng(5)
    y = rng.poisson(300, 9000).astype(float)
    at = [3, 511, 512, 2047, 2048, 2049, 4100, 8999]
    y[at] = 3000
    y[4090:4098], y[508:511] = 300, 301
    few = rng.poisson(0.2, 3000).astype(float)
    few[700:1500] = 0
    gauss = np.cumsum(rng.normal(0, 0.3, 5000)) + rng.normal(0, 1, 5000)
    gauss[2000:3500] = gauss[2000]
    gauss[100] += 60
    data = [(k, 10_000 * i + j, float(j), float(v), k != "g") for i, (k, x) in enumerate((("a", y), ("f", few), ("g", gauss))) for j, v in enumerate(x)]
    df = spark.createDataFrame(data, "key string, reading_id long, t double, value double, counting boolean")
    got = [{tuple(r) for r in implausible(df, size).collect()} for size in (512, 2048, BLOCK_ROWS, 100_000)]
    assert got[0] == got[1] == got[2] == got[3]
    ids = {r[1] for r in got[0]}
    assert set(at) | set(range(4090, 4098)) | set(range(22_000, 23_500)) | {20_100} <= ids and len({i for i in ids if i < 10_000}) < 20


def test_bursts_and_far_times_in_blocks(spark):
    from tickloom.operators.spikes import with_blocks, with_halo

    # All readings but the last in a burst: a frozen run lies four and four across a border, and spikes on either side of another.
    rng = np.random.default_rng(9)
    y = rng.poisson(300, 9001).astype(float)
    edge = 4096
    y[edge - 4 : edge + 4] = 300
    y[edge - 5], y[edge + 4] = 290, 290
    at = [2047, 2048]
    y[at] = 3000
    t = np.r_[np.arange(9000) * 1e-3, 1e9]
    df = spark.createDataFrame([("a", i, float(x), float(v), True) for i, (x, v) in enumerate(zip(t, y))] * 2, "key string, reading_id long, t double, value double, counting boolean")
    got = {r.reading_id for r in implausible(df, 2048).collect()}
    assert set(at) | set(range(edge - 4, edge + 4)) <= got and len(got) < 10 + 12
    cut = with_halo(with_blocks(df.dropDuplicates(["reading_id"]), 2048), 2048, 100).groupBy("block").agg({"*": "count"}).collect()
    assert {b: n for b, n in cut} == {0: 2148, **{b: 2248 for b in (1, 2, 3)}, 4: 9001 - 4 * 2048 + 100}


STAMP = "stamp_id long, source string, raw string, mjdref double, timezero double, system string, zone string, latest timestamp"
LEAPS = [(51179, 32), (57204, 36), (57754, 37)]


def test_instants(spark):
    cases = [
        ("2020-02-30T00:00:00", None, None, "UTC", None, None),
        ("2020-02-29T12:00:00", None, None, "UTC", None, 1582977600000),
        ("2020:060:12:00:00.500", None, None, "UTC", None, 1582977600500),
        ("2020-02-29T12:00:00", None, None, "TT", None, 1582977600000 - 69184),
        ("58908.5", None, None, "UTC", None, 1582977600000),
        ("JD 2458909.0", None, None, "UTC", None, 1582977600000),
        ("MJD 58908.5", None, None, "TAI", None, 1582977600000 - 37000),
        ("1582977600", None, None, "UNIX", None, 1582977600000),
        ("1582977600123456", None, None, "POSIX", None, 1582977600123),
        ("86400.5", 58907.5, None, "UTC", None, 1582977600500),
        ("1.0E+02", 58908.5, -100.0, "utc", None, 1582977600000),
        ("29/02/2020 13:00", None, None, "LOCAL", "Europe/Rome", 1582977600000),
        ("03/04/2020 13:00", None, None, "LOCAL", "Europe/Rome", 1585911600000),
        ("31/03/2019 02:30:00", None, None, "LOCAL", "Europe/Rome", None),
        ("27/10/2019 02:30:00", None, None, "LOCAL", "Europe/Rome", None),
        ("27/10/2019 02:30:00 CEST", None, None, "LOCAL", "Europe/Rome", 1572136200000),
        ("Feb 29, 2020 01:00 PM", None, None, "LOCAL", "Europe/Rome", 1582977600000),
        ("29-Feb-2020 13:00:00", None, None, "LOCAL", None, None),
        ("Sat, 29 Feb 2020 13:00:00 +0100", None, None, None, None, 1582977600000),
        ("20200229T120000Z", None, None, None, None, 1582977600000),
        ("2020-02-29T12:00:00", None, None, None, None, None),
        ("100000000", None, None, "UNIX", None, 100000000000),
        ("40000.5", None, None, "UTC", None, int((40000.5 - 40587) * 86400000)),
        ("2016-12-31T23:59:60", None, None, "UTC", None, 1483228800000), ("2016-11-30T23:59:60", None, None, "UTC", None, None),
        ("2020-02-29T12:00:00.1234567890", None, None, "UTC", None, 1582977600123),
        ("1960-02-29T12:00:00", None, None, "UTC", None, -310478400000), ("0000-02-01T00:00:00", None, None, "UTC", None, None), ("2019", None, None, "UTC", None, None),
        ("13:00:00", None, None, "UTC", None, None), ("2020-02", None, None, "UTC", None, None), ("", None, None, "UTC", None, None), (None, None, None, "UTC", None, None), ("n/a", None, None, "LOCAL", "Europe/Rome", None), ("0000-00-00T00:00:00", None, None, "UTC", None, None), ("x" * 5000, None, None, "UTC", None, None),
    ]
    df = spark.createDataFrame([(i, "s", raw, ref, zero, sys, zone, None) for i, (raw, ref, zero, sys, zone, _) in enumerate(cases)] * 2, STAMP)
    got = {r.stamp_id: r.utc_ms for r in utc_instants(df, LEAPS, ["Europe/Rome"]).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases)}


def test_forms_of_numbers_by_arrival(spark):
    import datetime as dt

    at = dt.datetime(2013, 3, 10)
    cases = [("1362351728", "UNIX", 1362351728000), ("1362351728000", "UNIX", 1362351728000), ("1362351728000000", "POSIX", 1362351728000), ("1362351728000000000", "POSIX", 1362351728000), ("2456354.5", "UTC", 1362268800000), ("56354", "UTC", 1362268800000), ("01/02/13 10:00", "UTC", None), ("13/02/13 10:00", "UTC", 1360749600000), ("13/02/72 10:00", "UTC", 66823200000)]
    df = spark.createDataFrame([(i, f"s{i}", raw, None, None, sys, None, at) for i, (raw, sys, _) in enumerate(cases)], STAMP)
    assert {r.stamp_id: r.utc_ms for r in utc_instants(df, LEAPS, []).collect()} == {i: c[-1] for i, c in enumerate(cases)}


def test_unresolved_order_is_marked(spark):
    df = spark.createDataFrame([(1, "lone", "03/04/2020 13:00", None, None, "LOCAL", "Europe/Rome", None)], STAMP)
    assert [tuple(r) for r in utc_instants(df, LEAPS, ["Europe/Rome"]).collect()] == [(1, None, "ambiguous")]


def test_few_decisive_stamps_settle_the_order(spark):
    stamp = lambda i, site, raw: (i, site, raw, None, None, "LOCAL", "Europe/Rome", None)
    day = [stamp(i, "d", "03/04/2020 13:00" if i else "29/02/2020 13:00") for i in range(1000)]
    month = [stamp(1000 + i, "m", "03/04/2020 13:00" if i else "02/29/2020 13:00") for i in range(10)]
    mixed = [stamp(2000 + i, "b", ["29/02/2020 13:00", "02/29/2020 13:00", "03/04/2020 13:00"][i % 3]) for i in range(9)]
    got = {r.stamp_id: (r.utc_ms, r.status) for r in utc_instants(spark.createDataFrame(day + month + mixed, STAMP), LEAPS, ["Europe/Rome"]).collect()}
    assert {got[i] for i in range(1, 1000)} == {(1585911600000, "ok")}
    assert {got[i] for i in range(1001, 1010)} == {(1583323200000, "ok")}
    assert [got[2000 + i][1] for i in range(9)] == ["ok", "ok", "ambiguous"] * 3


FILES = "file_id long, stream string, seq int, header_json string, fields int"


def test_schema_changes(spark, rows):
    hs = [{"A": 1.5, "B": "x", "c": {"n": 1}}, {"a": 1.5, "B": None, "C": {"n": 1}}, {"A2": 1.5, "B": 7, "C": {"n": 1}}, {"A2": 1.5, "B": 7, "D": {"n": 1}}, {"A2": "1.5", "BI": 7, "E": 4}, {"A2": "1.5", "B": "x"}]
    data = [(i, "s", i + 1, json.dumps(h), 0) for i, h in enumerate(hs)] + [(2, "s", 3, json.dumps(hs[2]), 0), (90, "s", None, "{}", 0), (91, None, 1, "{}", 0), (92, "t", 1, "not json", 0), (93, "t", 2, None, 0)]
    ch = schema_changes(spark.createDataFrame(data, FILES))
    assert rows(ch.select("file_id", "field_name", "change_kind")) == sorted([(2, "A", "renamed"), (2, "B", "retyped"), (3, "C", "renamed"), (4, "A2", "retyped"), (4, "B", "renamed"), (4, "D", "removed"), (4, "E", "added"), (5, "BI", "removed"), (5, "E", "removed"), (5, "B", "added")])
    assert schema_changes(spark.createDataFrame([], FILES)).count() == 0
    names = canonical_names(ch, support=1)
    assert names["A2"] == "A" and names["D"] == "C"
    table = {r.file_id: r.fields for r in unified(spark.createDataFrame(data[:6], FILES), names).collect()}
    assert table[2]["A"] == "1.5" and table[3]["C"] == '{"n": 1}'


def test_changes_across_blocks(spark, monkeypatch):
    from tickloom.operators import drift

    monkeypatch.setattr(drift, "BLOCK_FILES", 2)
    hs = [{"A": 1}, {"A": None}, {"A": None}, {"A": "x"}, {"B": "x"}, {"B": "x"}]
    df = spark.createDataFrame([(i, "s", i + 1, json.dumps(h), 0) for i, h in enumerate(hs)], FILES)
    got = {(r.file_id, r.field_name, r.change_kind) for r in drift.schema_changes(df).collect()}
    assert got == {(3, "A", "retyped"), (4, "A", "renamed")}


def test_one_rename_unifies_its_stream_only(spark, tmp_path, monkeypatch):
    from tickloom.operators import drift
    from tickloom.plans import problems

    monkeypatch.setattr(drift, "BLOCK_FILES", 3)
    names = ["INSTRUME"] * 3 + ["DETNAM"] * 4 + ["CAMERA"] * 5
    data = [(i, "s", i + 1, json.dumps({n: "ccd", "EXPO": i})) for i, n in enumerate(names)]
    # Another stream has both names for other things, and a field under a name that came back.
    data += [(100 + i, "t", i + 1, json.dumps({"INSTRUME": "a", "DETNAM": "b"})) for i in range(3)]
    data += [(200, "u", 1, '{"A": "x"}'), (201, "u", 2, '{"B": "x"}'), (202, "u", 3, '{"B": "x", "A": "y"}'), (203, "u", 4, '{"B": "x", "C": "y"}'), (300, None, 1, '{"DETNAM": "c"}'), (301, "s", None, '{"DETNAM": "d"}')]
    spark.createDataFrame(data, "file_id long, stream_id string, seq_no int, header_json string").write.parquet(str(tmp_path / "file_header.parquet"))
    got = {r.file_id: {k[3:]: v for k, v in r.asDict().items() if k.startswith("kw_") and v is not None} for r in problems.p5_table(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    assert all(len(got[i]) == 2 and got[i]["EXPO"] == float(i) for i in range(12))
    one = {k for i in range(12) for k in got[i]} - {"EXPO"}
    assert len(one) == 1 and all(got[i][min(one)] == "ccd" for i in range(12))
    assert all(got[100 + i] == {"INSTRUME": "a", "DETNAM": "b"} for i in range(3))
    assert got[200] == got[201] == {"A": "x"} and all(sorted(got[i].values()) == ["x", "y"] for i in (202, 203))
    assert got[300] == {"DETNAM": "c"} and got[301] == {"DETNAM": "d"}


def test_many_renames_are_paired_at_once():
    for n in (2, 8, 20):
        gone = {f"NAME{i}": 1.0 for i in range(n)}
        got = dict(pair_renames(gone, {f"NAME{i}_NEW": 1.0 for i in range(n)}))
        assert got == {f"NAME{i}": f"NAME{i}_NEW" for i in range(n)}
    # The same two keywords whatever else changes in the file.
    few = dict(pair_renames({"C": 1, "CA": 1}, {"B": 1, "CC": 1}))
    more = dict(pair_renames({"C": 1, "CA": 1} | {f"X{i}": f"v{i}" for i in range(9)}, {"B": 1, "CC": 1} | {f"Y{i}": f"v{i}" for i in range(9)}))
    assert few == {k: more[k] for k in few} and len(more) == 11


def test_assignment_is_the_best():
    import itertools

    from tickloom.operators.drift import assigned

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 4), (4, 3), (5, 5), (3, 6)):
        for _ in range(20):
            w = np.round(rng.uniform(-1, 2, (n, m)), 2)
            best = max(sum(max(w[i, j], 0) for i, j in zip(rows, cols)) for rows in itertools.permutations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m)))
            got = assigned(w)
            assert abs(sum(w[i, j] for i, j in got) - best) < 1e-9 and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def test_moves():
    from tickloom.operators.drift import edit_script

    a = {"RA": 1.5, "POS": {"DEC": 2.5}, "T": {"x": 1, "y": "a"}, "OLD": {"deep": {"z": 7.25}}}
    b = {"POS": {"DECL": 2.5}, "CENTRE": {"RA": 1.5}, "T": {"x": "1", "y": "a"}, "z": 7.25}
    assert sorted(edit_script(a, b)) == sorted([("RA", "moved", "CENTRE.RA"), ("CENTRE", "added", None), ("POS.DEC", "renamed", "POS.DECL"), ("T.x", "retyped", None), ("OLD", "removed", None), ("OLD.deep.z", "moved", "z")])


def test_typed_columns(spark):
    from tickloom.operators.drift import typed_columns

    df = spark.createDataFrame([(1, "s", 1, {"A": "1.5", "B": "x"}), (2, "s", 2, {"A": "soon", "file_id": "9"}), (3, "s", 3, None), (4, "s", 4, {"A": "2"})], "file_id long, stream string, seq int, fields map<string,string>")
    got = typed_columns(df)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][3:] == [("kw_A", "double"), ("kw_B", "string"), ("kw_file_id", "double"), ("unparsed", "map<string,string>")]
    rows = {r.file_id: r for r in got.collect()}
    assert rows[2].kw_A is None and rows[2].unparsed == {"A": "soon"} and rows[1].kw_A == 1.5 and rows[3].kw_B is None


def test_pairing():
    assert pair_renames({"RA": 1.0, "DEC": 1.0}, {"RA_OBJ": 1.0, "DEC_OBJ": 1.0}) in ([("DEC", "DEC_OBJ"), ("RA", "RA_OBJ")], [("RA", "RA_OBJ"), ("DEC", "DEC_OBJ")])
    assert pair_renames({"A": None}, {"B": None}) == []
    assert header('{"a": 1, "A": null}') == {"A": 1} and header("[1]") is None


def test_energies(spark):
    obs = spark.createDataFrame([("k", "NuSTAR ", "keV", None), ("e", "xmm", None, "Angabe in eV"), ("m", "nicer", None, None), ("n", None, "erg", None), ("u", None, None, None)], "obs_id string, mission string, energy_unit string, remark string")
    ph = [(1, "k", 10, 2.0), (2, "e", 5000, 5000.0), (3, "m", 300, 0.003), (4, "n", 9, 1.602176634e-9), (5, "k", 10, None), (6, "n", 10, None), (7, "k", 10, float("nan")), (8, "zz", 1, 1.0), (9, "m", None, None), (10, "m", 400, 0.004)]
    got = {r.event_id: r for r in photon_energies(spark.createDataFrame(ph, "event_id long, obs_id string, pi int, energy double"), obs).collect()}
    assert {i: round(r.energy_kev, 9) for i, r in got.items() if r.energy_kev is not None} == {1: 2.0, 2: 5.0, 3: 3.0, 4: 1.0, 5: 2.0, 10: 4.0}
    assert got[3].unit == "MeV" and got[3].sure and got[2].unit == "eV"


def test_two_units_in_one_observation(spark):
    obs = spark.createDataFrame([("h", "xmm", "keV", None), ("w", None, None, None)], "obs_id string, mission string, energy_unit string, remark string")
    ph = [(i, "h", 1000 + i, (1.0 + i / 1000) * (1000 if i % 2 else 1)) for i in range(400)] + [(1000, "w", 5, None), (1001, "w", 5, 40.0), (1002, "h", 500, 500.0)]
    got = {r.event_id: r for r in photon_energies(spark.createDataFrame(ph, "event_id long, obs_id string, pi int, energy double"), obs).collect()}
    assert all(got[i].sure and abs(got[i].energy_kev - (1.0 + i / 1000)) < 1e-9 for i in range(400))
    assert got[1001].energy_kev is None and not got[1001].sure and got[1002].energy_kev == 0.5


def test_mixture_shares():
    from tickloom.functions.kernels import mixture_shares

    assert abs(mixture_shares(np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([1, 10**6])) - [1, 0]).max() < 1e-9
    assert abs(mixture_shares(np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]), np.array([30, 10, 5])) - [0.75, 0.25]).max() < 1e-9
    assert mixture_shares(np.array([[1.0, 1.0]]), np.array([7])).tolist() == [0.5, 0.5] and mixture_shares(np.zeros((0, 3)), np.zeros(0)).sum() == 1


def test_header_times(spark):
    rows = [(1, 1.0, 2.0, "d", None, 80000.0), (2, 0.0, 90.0, None, "minutes since reference", None), (3, 0.0, 1.0, None, None, 3500.0), (4, None, 1.0, "s", None, None), (5, 0.0, 1.0, None, "quick look", None)]
    got = {r.file_id: (r.unit, r.duration_s) for r in header_times(spark.createDataFrame(rows, "file_id long, start double, stop double, time_unit string, comment string, livetime double")).collect()}
    assert got[1] == ("d", 86400.0) and got[2][0] == "min" and abs(got[2][1] - 5400) < 1e-9 and got[3][0] == "h" and got[4] == ("s", None) and got[5] == (None, None)
