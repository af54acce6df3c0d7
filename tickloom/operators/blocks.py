"""Ordered operations inside a key that never put a whole key into one task.

A window over a key alone sends all rows of a hot key to one task.  Here every key is cut into blocks along its order
column, the window runs over (key, block), and one summary row for each block carries what crosses a border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.tables import with_checkpoints


def _plain(names: Sequence[str]) -> list[str]:
    return [*names]


def blocked_running_sum(df: DataFrame, keys: Sequence[str], order: str, weight: str, block: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``weight`` along ``order`` within ``keys``.

    ``block`` has to grow with ``order``.  ``order`` is expected to be unique within the keys; ties are summed in any order.
    """
    keys = _plain(keys)
    rows = df.withColumn("__block", block)
    inner = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "__block").agg(F.sum(weight).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    return rows.withColumn("__inner", F.sum(weight).over(inner)).join(offsets, [*keys, "__block"]).withColumn(out, F.col("__inner") + F.col("__before")).drop("__inner", "__before", "__block")


def blocked_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], block: Column) -> DataFrame:
    """The values of the row before along ``order`` within ``keys``: ``values`` maps a column to the name of its lag.

    ``block`` has to grow with the first column of ``order``.  The first row of a key gets nulls.
    """
    keys = _plain(keys)
    rows = df.withColumn("__block", block)
    key_of = F.struct(*order)
    carried = F.struct(*values)
    inner = Window.partitionBy(*keys, "__block").orderBy(*order)
    ends = rows.groupBy(*keys, "__block").agg(F.max_by(carried, key_of).alias("__last"))
    ends = ends.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block"))).drop("__last")
    rows = rows.withColumn("__n", F.row_number().over(inner)).withColumn("__lag", F.lag(carried).over(inner))
    rows = rows.join(ends, [*keys, "__block"])
    prev = F.when(F.col("__n") == 1, F.col("__carry")).otherwise(F.col("__lag"))
    return rows.withColumn("__prev", prev).withColumns({out: F.col(f"__prev.{name}") for name, out in values.items()}).drop("__prev", "__lag", "__carry", "__n", "__block")


def explode_range(df: DataFrame, first: Column, last: Column, out: str, chunk: int = 4096) -> DataFrame:
    """One row for each integer from ``first`` to ``last``; arrays never grow beyond ``chunk`` times two levels."""
    pieces = df.withColumns({"__a": first.cast("long"), "__z": last.cast("long")}).where("__z >= __a")
    pieces = pieces.withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__z - __a) div {chunk}"))))
    pieces = pieces.withColumns({"__from": F.col("__a") + F.col("__p") * chunk})
    return pieces.withColumn(out, F.explode(F.sequence(F.col("__from"), F.least(F.col("__z"), F.col("__from") + (chunk - 1))))).drop("__a", "__z", "__p", "__from")


def broadcast_if_small(df: DataFrame, most_rows: int = 300_000) -> DataFrame:
    """Hint a broadcast if the side has at most ``most_rows`` rows, as counted; else leave the join to Spark (a shuffle)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, count: str) -> DataFrame:
    """Position of every row along ``order`` within ``keys``, from 0 without holes, and the number of rows of its key.

    Rows are spread by ranges of keys and order together and numbered inside each range; what the ranges before it hold of
    a key is added.  So a hot key fills many tasks however its rows are distributed.  ``order`` has to be unique within
    the keys.  The ranges are checkpointed.
    """
    keys = _plain(keys)
    with_checkpoints(df.sparkSession)
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumn("__range", F.shiftright("__at", 33))
    parts = rows.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__range").alias("__part"), "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias(count))
    on = F.col("__range") == F.col("__part")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    placed = rows.join(broadcast_if_small(parts), on).withColumn(out, F.col("__at") - F.col("__first") + F.col("__before"))
    return placed.drop("__at", "__range", "__part", "__first", "__before", *[f"__key{i}" for i in range(len(keys))])
