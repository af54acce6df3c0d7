"""Interval algebra: merging, gaps, intersection and range joins of time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import broadcast_if_small
from tickloom.sources.tables import finite

#: Width of a block along time, in the integer unit of the bounds: as many distinct bounds at most lie in one.
BLOCK_UNITS = 1_000_000


def periods_and_gaps(intervals: DataFrame, spans: DataFrame, key: str = "key", start: str = "start", stop: str = "stop", span_start: str = "span_start", span_stop: str = "span_stop") -> DataFrame:
    """Continuous periods covered by the intervals of each entity, and the gaps within the entity's span.

    Starts and ends are sorted independently of each other, each with its rank: a gap lies behind the end of rank i where
    the start of rank i + 1 is greater, that is where as many starts as ends have passed; and the boundaries left, paired in
    their order, give the periods.  All bounds are integers (say milliseconds).  Intervals are clipped to the span first.
    Intervals with a null bound or without positive length (also after clipping) cover nothing; overlapping and touching
    ones form one period; repeats change nothing; an entity without intervals is one gap; a span that is null or not
    positive gives no rows; entities that are not in ``spans`` are left out.  Output: key, span_kind ('period' or 'gap'),
    start, stop.  Other columns are ignored.

    Bounds are shuffled once, by entity and block of time; ranks and boundaries run inside the blocks, and what crosses
    their borders is one row for each block.
    """
    spans = spans.select(F.col(key).alias("key"), F.col(span_start).cast("long").alias("lo"), F.col(span_stop).cast("long").alias("hi")).where("key is not null and hi > lo").dropDuplicates(["key"])
    ivs = intervals.select(F.col(key).alias("key"), F.col(start).cast("long").alias("s"), F.col(stop).cast("long").alias("e")).where("e > s")
    cut = ivs.join(broadcast_if_small(spans), "key").select("key", F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e")).where("e > s")
    none, one = F.lit(0), F.lit(1)
    bound = lambda at, starts, ends, edge: F.struct(F.col(at).alias("at"), starts.alias("starts"), ends.alias("ends"), edge.alias("edge"))
    of_intervals = cut.select("key", F.explode(F.array(bound("s", one, none, none), bound("e", none, one, none))).alias("b"))
    of_spans = spans.select("key", F.explode(F.array(bound("lo", none, none, one), bound("hi", none, none, one))).alias("b"))
    rows = of_intervals.unionByName(of_spans).select("key", "b.*").withColumn("block", F.expr(f"at div {BLOCK_UNITS}")).repartition("key", "block")
    rows = rows.groupBy("key", "block", "at").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.max("edge").alias("edge"))
    inner, earlier = Window.partitionBy("key", "block").orderBy("at"), Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Ranks of the starts and of the ends up to every bound: within its block, then with those of the blocks before.
    rows = rows.withColumns({"rank_s": F.sum("starts").over(inner), "rank_e": F.sum("ends").over(inner)})
    # A block's ends can't outnumber its starts by more than were open before it, so that one number carries over.
    over = rows.groupBy("key", "block").agg(F.sum(F.col("starts") - F.col("ends")).alias("net"))
    over = over.select("key", "block", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("open"))
    rows = rows.join(over, ["key", "block"]).withColumn("covered", F.col("open") + F.col("rank_s") - F.col("rank_e"))
    was = F.col("covered") - F.col("starts") + F.col("ends")
    borders = rows.where((F.col("edge") > 0) | ((was == 0) != (F.col("covered") == 0))).select("key", "block", "at", (F.col("covered") > 0).alias("good"))
    here = F.struct("at", "good")
    last = borders.groupBy("key", "block").agg(F.max(here).alias("last"))
    last = last.select("key", "block", F.lag("last").over(Window.partitionBy("key").orderBy("block")).alias("carried"))
    found = borders.withColumn("before", F.lag(here).over(inner)).join(last, ["key", "block"]).withColumn("before", F.coalesce("before", "carried"))
    return found.where("before is not null and at > before.at").select("key", F.when(F.col("before.good"), "period").otherwise("gap").alias("span_kind"), F.col("before.at").alias("start"), F.col("at").alias("stop"))


def to_millis(column) -> F.Column:
    """Seconds as double to whole milliseconds; null where not finite."""
    return F.round(finite(column) * 1000.0).cast("long")
