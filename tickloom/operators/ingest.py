"""Event ingest: good intervals, occultations, jitter, gap filling and the keys by which lists are split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import gti as G
from tickloom.operators.lightcurve import light_curve


@dataclass
class IngestOptions:
    """What to do with an event list on ingest. Times are seconds."""

    min_length: float = 0.0
    safe_before: float | None = None
    safe_after: float | None = None
    occultation_bin: float | None = None
    randomize_by: float | None = None
    fill_gaps_below: float | None = None
    discard_calibration: bool = False
    split_length: float | None = None
    split_by_gti: bool = False
    seed: int = 0


def occultations(events: DataFrame, gtis: DataFrame, dt: float, tstart: float, tstop: float, least: float = 25.0) -> DataFrame:
    """Good intervals without empty bins, if the median counts of a bin are above ``least``; else as they are.

    A bin has to lie inside an interval to count.  Intervals found are shrunk by a bin at both ends.
    """
    bins = light_curve(events, dt, tstart, tstop)
    median = bins.agg(F.percentile("counts", 0.5)).first()[0] or 0.0
    if median <= least:
        return gtis
    good = G.intervals_where(bins, F.col("counts") > 0, dt).select((F.col("start") + tstart).alias("start"), (F.col("stop") + tstart).alias("stop"))
    return G.shrink(G.intersect(good, gtis), dt, dt)


def jitter(events: DataFrame, width: float, seed: int) -> DataFrame:
    """Times moved by a uniform amount within half the width on either side, given by the event's id and the seed."""
    u = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(2**52)) / float(2**52)
    return events.withColumn("t", F.col("t") + (u - 0.5) * width)


def fill_gaps(events: DataFrame, gtis: DataFrame, longest: float, seed: int, around: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill gaps below ``longest`` with random events at the rate around them; events and the joined intervals.

    The rate is that of the events within ``around`` (default: the gap's limit) on either side, counted by a join on time
    buckets.  Filled events have a null id and filled = true.
    """
    width = around or longest
    gaps = G.complement(gtis).where(F.col("stop") - F.col("start") < longest)
    near = gaps.select(F.col("start").alias("g0"), F.col("stop").alias("g1"), (F.col("start") - width).alias("start"), (F.col("stop") + width).alias("stop"))
    hit = events.select("t", F.floor(F.col("t") / 86_400.0).alias("bucket")).join(G.bucketed(near, 86_400.0), "bucket").where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    rate = hit.groupBy("g0", "g1").agg(F.count(F.lit(1)).alias("n")).withColumn("lam", F.col("n") / (2 * width) * (F.col("g1") - F.col("g0")))
    u = F.pmod(F.xxhash64("g0", F.lit(seed)), F.lit(2**52)) / float(2**52)
    rows = rate.withColumn("n", F.floor(F.col("lam") + u)).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    v = F.pmod(F.xxhash64("g0", "i", F.lit(seed + 1)), F.lit(2**52)) / float(2**52)
    made = rows.select((F.col("g0") + v * (F.col("g1") - F.col("g0"))).alias("t"), F.lit(True).alias("filled"))
    both = events.withColumn("filled", F.lit(False)).unionByName(made, allowMissingColumns=True)
    wide = G.complement(gtis).where(F.col("stop") - F.col("start") >= longest)
    ends = gtis.agg(F.min("start").alias("a"), F.max("stop").alias("z"))
    # The good time is what lies between the gaps that stay.
    edges = wide.select("start", "stop").unionByName(ends.select(F.col("a").alias("start"), F.col("a").alias("stop"))).unionByName(ends.select(F.col("z").alias("start"), F.col("z").alias("stop")))
    return both, G.complement(edges)


def ingest(events: DataFrame, gtis: DataFrame, options: IngestOptions, tstart: float, tstop: float) -> tuple[DataFrame, DataFrame]:
    """Prepare an event list: the events with a chunk to partition by, and their good intervals.

    Safe intervals are cut off only where occultations aren't inferred.  A chunk is an interval, or a fixed length from
    ``tstart``; events outside all chunks are dropped.  Split by detector by writing with partitionBy.
    """
    o = options
    if o.discard_calibration:
        events = events.drop("energy", "cal_pi")
    if o.occultation_bin:
        gtis = occultations(events, gtis, o.occultation_bin, tstart, tstop)
    elif o.safe_before or o.safe_after:
        gtis = G.shrink(gtis, o.safe_before or 0.0, o.safe_after or 0.0)
    gtis = gtis.where(F.col("stop") - F.col("start") >= o.min_length)
    if o.randomize_by:
        events = jitter(events, o.randomize_by, o.seed)
    if o.fill_gaps_below:
        events, gtis = fill_gaps(events, gtis, o.fill_gaps_below, o.seed)
    if o.split_length:
        events = events.where((F.col("t") >= tstart) & (F.col("t") < tstop)).withColumn("chunk", F.floor((F.col("t") - tstart) / o.split_length))
    elif o.split_by_gti:
        b = G.bucketed(gtis, 86_400.0).select("bucket", F.col("start").alias("__s"), F.col("stop").alias("__e"))
        rows = events.withColumn("bucket", F.floor(F.col("t") / 86_400.0)).join(b, "bucket").where((F.col("t") >= F.col("__s")) & (F.col("t") < F.col("__e")))
        events = rows.withColumn("chunk", F.col("__s")).drop("bucket", "__s", "__e")
    else:
        events = events.withColumn("chunk", F.lit(0))
    return events, gtis
