import random

from tickloom.operators import gti
from tickloom.operators.blocks import blocked_lag, blocked_running_sum, explode_range
from tickloom.operators.intervals import periods_and_gaps
from pyspark.sql import functions as F

IV = "key string, start long, stop long, start_ms int"
SPANS = "key string, span_start long, span_stop long"


def brute(ivs, spans):
    out = set()
    for key, lo, hi in spans:
        if lo is None or hi is None or hi <= lo:
            continue
        cut = sorted((max(s, lo), min(e, hi)) for k, s, e, *_ in ivs if k == key and s is not None and e is not None and min(e, hi) > max(s, lo))
        merged = []
        for s, e in cut:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        at = lo
        for s, e in merged:
            out.add((key, "period", s, e))
            if s > at:
                out.add((key, "gap", at, s))
            at = e
        if at < hi:
            out.add((key, "gap", at, hi))
    return out


def test_periods_against_brute_force(spark):
    rng = random.Random(1)
    spans = [(f"k{i}", rng.randint(0, 50), rng.randint(60, 5_000_000)) for i in range(30)] + [("none", 0, 10), ("bad", 5, 5), ("null", None, 3)]
    ivs = [(rng.choice(spans)[0], rng.randint(-100, 5_000_000), rng.randint(-100, 5_000_000), 1) for _ in range(400)]
    ivs += [("k0", 10, 20, 1), ("k0", 20, 30, 1), ("k0", 20, 30, 1), ("k1", None, 5, 1), ("k1", 5, None, 1), (None, 1, 2, 1), ("nospan", 1, 2, 1)]
    got = periods_and_gaps(spark.createDataFrame(ivs, IV), spark.createDataFrame(spans, SPANS)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(ivs, spans)


def test_periods_of_empty_tables(spark):
    assert periods_and_gaps(spark.createDataFrame([], IV), spark.createDataFrame([], SPANS)).count() == 0
    assert [tuple(r) for r in periods_and_gaps(spark.createDataFrame([], IV), spark.createDataFrame([("a", 0, 9)], SPANS)).collect()] == [("a", "gap", 0, 9)]


def test_blocked_operations(spark, rows):
    data = [("a", i * 3, 1) for i in range(50)] + [("b", 7, 2)]
    df = spark.createDataFrame(data, "k string, x long, w long")
    total = blocked_running_sum(df, ["k"], "x", "w", F.expr("x div 20"), "s")
    assert rows(total.where("k = 'a'").select("x", "s")) == [(i * 3, i + 1) for i in range(50)]
    lag = blocked_lag(df, ["k"], ["x"], {"x": "p"}, F.expr("x div 20"))
    assert rows(lag.where("k = 'a'").select("x", "p")) == [(i * 3, (i - 1) * 3 if i else None) for i in range(50)]
    assert lag.where("k = 'b' and p is null").count() == 1


def test_explode_range(spark, rows):
    df = spark.createDataFrame([(0, 5), (3, 2), (7, 7), (None, 4)], "a long, z long")
    assert rows(explode_range(df, F.col("a"), F.col("z"), "i", 2).select("i")) == [(i,) for i in [0, 1, 2, 3, 4, 5, 7]]


def test_intersection_and_membership(spark, rows):
    a = spark.createDataFrame([(0.0, 10.0), (20.0, 300_000.0)], "start double, stop double")
    b = spark.createDataFrame([(5.0, 25.0), (100_000.0, 200_000.0), (10.0, 20.0)], "start double, stop double")
    assert rows(gti.intersect(a, b)) == [(5.0, 10.0), (20.0, 25.0), (100_000.0, 200_000.0)]
    ev = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 150_000.0), (4, None)], "event_id long, t double")
    assert rows(gti.inside(ev, a).select("event_id")) == [(1,), (3,)]
    assert rows(gti.complement(a)) == [(10.0, 20.0)]
    assert rows(gti.segments(a, 4.0).where("stop <= 10")) == [(0.0, 4.0), (4.0, 8.0)]


def test_runs_of_a_condition(spark, rows):
    bins = spark.createDataFrame([(i, c) for i, c in enumerate([5, 6, 0, 7, None, 8, 9, 9])], "bin long, counts long")
    assert rows(gti.intervals_where(bins, F.col("counts") > 4, 10.0, block_bins=3)) == [(0.0, 20.0), (30.0, 40.0), (50.0, 80.0)]
