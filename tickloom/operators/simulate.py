"""Simulated events: from a rate, re-randomised within intervals, and for detection studies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.gti import bucketed


def uniform_events(spark: SparkSession, n: int, tstart: float, tstop: float, seed: int, channels: int = 1024) -> DataFrame:
    """n uniform events with a random channel: event_id, t, pi. Each row's randomness follows from its id and the seed."""

    def draw(salt: int):
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(2**52)) / float(2**52)

    return spark.range(n).select(F.col("id").alias("event_id"), (F.lit(tstart) + draw(1) * (tstop - tstart)).alias("t"), F.floor(draw(2) * channels).cast("int").alias("pi"))


def events_from_rate(bins: DataFrame, dt: float, seed: int) -> DataFrame:
    """Events of a binned rate (bin, rate = expected counts): rounded counts of each bin spread evenly at random: bin, t."""
    rows = bins.withColumn("__n", F.floor(F.col("rate") + F.pmod(F.xxhash64("bin", F.lit(seed)), F.lit(2**40)) / float(2**40))).where("__n > 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    u = F.pmod(F.xxhash64("bin", "i", F.lit(seed + 1)), F.lit(2**52)) / float(2**52)
    return rows.select("bin", ((F.col("bin") + u) * F.lit(float(dt))).alias("t"))


def pulsed_rate(spark: SparkSession, n_bins: int, counts: float, f: float, dt: float, fraction: float) -> DataFrame:
    """Expected counts of a sinusoid in bins: bin, rate; they sum to about ``counts``."""
    t = (F.col("id") + 0.5) * dt
    return spark.range(n_bins).select(F.col("id").alias("bin"), (F.lit(counts / n_bins) * (1 + fraction * F.cos(F.lit(2 * math.pi * f) * t))).alias("rate"))


def scramble(events: DataFrame, gtis: DataFrame, seed: int, width: float = 86_400.0) -> DataFrame:
    """Every event of an interval at a new uniform time in it; the counts of all intervals stay: event_id, t, start, stop.

    Events outside all intervals are dropped.  Intervals have to be disjoint.
    """
    g = bucketed(gtis.select("start", "stop"), width)
    rows = events.withColumn("bucket", F.floor(F.col("t") / width)).join(g, "bucket").where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    u = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(2**52)) / float(2**52)
    return rows.select("event_id", (F.col("start") + u * (F.col("stop") - F.col("start"))).alias("t"), "start", "stop")


def detection_study(spark: SparkSession, trials: int, counts: int, seed: int, n: int = 2) -> DataFrame:
    """Z squared of simulated pulses of random pulsed fraction: trial, fraction, z2. Trials and events are rows of Spark."""
    rows = spark.range(trials).withColumnRenamed("id", "trial")
    fraction = F.pmod(F.xxhash64("trial", F.lit(seed)), F.lit(2**40)) / float(2**40)
    rows = rows.withColumn("fraction", fraction).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(counts))))
    u = F.pmod(F.xxhash64("trial", "i", F.lit(seed + 1)), F.lit(2**52)) / float(2**52)
    v = F.pmod(F.xxhash64("trial", "i", F.lit(seed + 2)), F.lit(2**52)) / float(2**52)
    # A phase is turned by half a cycle where the pulse is low: accepts u with the odds of the sinusoid.
    phase = F.when(v < 0.5 * (1 + F.col("fraction") * F.cos(2 * math.pi * u)), u).otherwise(u - F.floor(u + 0.5) + 0.5)
    sums = []
    for h in range(1, n + 1):
        sums += [F.sum(F.cos(2 * math.pi * h * phase)).alias(f"c{h}"), F.sum(F.sin(2 * math.pi * h * phase)).alias(f"s{h}")]
    out = rows.groupBy("trial", "fraction").agg(*sums)
    return out.select("trial", "fraction", (F.lit(2.0 / counts) * sum((F.col(f"c{h}") ** 2 + F.col(f"s{h}") ** 2 for h in range(1, n + 1)), F.lit(0.0))).alias("z2"))
