"""Good time intervals: from conditions, intersection, complement, and events inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import blocked_lag


def intervals_where(bins: DataFrame, good: Column, dt: float, keys: Sequence[str] = (), block_bins: int = 100_000) -> DataFrame:
    """Continuous runs of bins (bin, an index) where a condition holds: keys, start, stop.

    Only bins of the table count; a missing bin ends a run; a null condition is false.  Runs are found from borders of
    blocks, so no key is sorted as a whole.
    """
    held = bins.where(good)
    lagged = blocked_lag(held.select(*keys, "bin"), keys, ["bin"], {"bin": "__b"}, F.floor(F.col("bin") / block_bins)) if keys else blocked_lag(held.select(F.lit(0).alias("__k"), "bin"), ["__k"], ["bin"], {"bin": "__b"}, F.floor(F.col("bin") / block_bins))
    # Numbers of neighbouring good bins less their rank are equal; runs are short against the number of their starts.
    by = list(keys) or ["__k"]
    starts = lagged.where(F.col("__b").isNull() | (F.col("bin") > F.col("__b") + 1)).select(*by, F.col("bin").alias("at"), F.col("__b").alias("stop_before"))
    w = Window.partitionBy(*by).orderBy("at")
    last = held.select(*(keys or [F.lit(0).alias("__k")]), "bin").groupBy(*by).agg(F.max("bin").alias("__last"))
    runs = starts.withColumn("until", F.lead("stop_before").over(w)).join(last, by)
    return runs.select(*keys, (F.col("at") * F.lit(float(dt))).alias("start"), ((F.coalesce("until", "__last") + 1) * F.lit(float(dt))).alias("stop"))


def bucketed(intervals: DataFrame, width: float) -> DataFrame:
    """Intervals once for each time bucket they touch: column bucket. The arrays hold an interval's buckets only."""
    return intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), width: float = 86_400.0) -> DataFrame:
    """Pairwise intersections of two interval lists: keys, start, stop.

    An equi-join on time buckets in place of a nested loop; a pair that shares several buckets is taken in the one where
    the intersection starts.
    """
    x = bucketed(a.select(*keys, "start", "stop"), width)
    y = bucketed(b.select(*keys, F.col("start").alias("s2"), F.col("stop").alias("e2")).withColumnsRenamed({"s2": "start", "e2": "stop"}), width).withColumnsRenamed({"start": "s2", "stop": "e2"})
    both = x.join(y, [*keys, "bucket"]).withColumns({"lo": F.greatest("start", "s2"), "hi": F.least("stop", "e2")})
    return both.where((F.col("hi") > F.col("lo")) & (F.floor(F.col("lo") / width) == F.col("bucket"))).select(*keys, F.col("lo").alias("start"), F.col("hi").alias("stop"))


def complement(gtis: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bad intervals between good ones (which are apart): keys, start, stop."""
    rows = gtis.select(*(keys or [F.lit(0).alias("__k")]), "start", "stop")
    by = list(keys) or ["__k"]
    lagged = blocked_lag(rows, by, ["start"], {"stop": "left"}, F.floor(F.col("start") / 86_400.0))
    return lagged.where("left < start").select(*keys, F.col("left").alias("start"), F.col("start").alias("stop"))


def shrink(gtis: DataFrame, before: float, after: float, least: float = 0.0) -> DataFrame:
    """Intervals without a safe interval at both ends, of at least ``least`` seconds and positive length."""
    out = gtis.withColumns({"start": F.col("start") + float(before), "stop": F.col("stop") - float(after)})
    return out.where((F.col("stop") - F.col("start") >= least) & (F.col("stop") > F.col("start")))


def inside(events: DataFrame, gtis: DataFrame, keys: Sequence[str] = (), width: float = 86_400.0) -> DataFrame:
    """Events in [start, stop) of some interval, by a semi-join on time buckets."""
    g = bucketed(gtis.select(*keys, "start", "stop"), width).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("start").alias("__s"), F.col("stop").alias("__e"), F.col("bucket").alias("__b"))
    e = events.withColumn("__b2", F.floor(F.col("t") / width))
    cond = (F.col("__b2") == F.col("__b")) & (F.col("t") >= F.col("__s")) & (F.col("t") < F.col("__e"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return e.join(g, cond, "left_semi").drop("__b2")


def segments(gtis: DataFrame, length: float, keys: Sequence[str] = ()) -> DataFrame:
    """Full segments of a length inside each interval: keys, start, stop of the segment."""
    n = F.floor((F.col("stop") - F.col("start")) / length)
    rows = gtis.where(n >= 1).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select(*keys, (F.col("start") + F.col("__i") * length).alias("start"), (F.col("start") + (F.col("__i") + 1) * length).alias("stop"))
