"""Event lists: filters, splits, joins, dead time and orbit correction."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import blocked_lag, blocked_running_sum

#: Seconds of a block along time in ordered operations.
BLOCK_S = 3_600.0


def block_of(t: str, seconds: float = BLOCK_S) -> Column:
    """Block of an ordered operation along a time."""
    return F.floor(F.col(t) / seconds)


def between(x: Column, lo: float | None, hi: float | None, closed: str = "both") -> Column:
    """Interval test with explicit ends: closed is 'both' (filters), 'right' (light curves) or 'left' (binary export).

    An open bound is None; null and NaN values are outside.
    """
    ok = x.isNotNull() & ~F.isnan(x)
    if lo is not None:
        ok = ok & (x >= lo if closed in ("both", "left") else x > lo)
    if hi is not None:
        ok = ok & (x <= hi if closed in ("both", "right") else x < hi)
    return ok


def filter_energy(events: DataFrame, lo: float | None, hi: float | None, closed: str = "both") -> DataFrame:
    """Events with an energy in the interval; without an energy column their channel is taken, without both all stay."""
    name = next((c for c in ("energy", "pi") if c in events.columns), None)
    if name is None:
        return events
    out = events.where(between(F.col(name).cast("double"), lo, hi, closed))
    return out if name == "energy" else out.withColumn("energy", F.col("pi").cast("double"))


def energy_or_channel(events: DataFrame) -> Column:
    """The column that stands for energy: energy, else channel, else ones."""
    return F.col("energy") if "energy" in events.columns else F.col("pi").cast("double") if "pi" in events.columns else F.lit(1.0)


def calibrate_by_table(events: DataFrame, response: DataFrame) -> DataFrame:
    """Energy as the middle of the channel's bounds (channel, e_min, e_max); channels that are not listed get 0."""
    middle = response.select(F.col("channel").alias("pi"), ((F.col("e_min") + F.col("e_max")) / 2).alias("__e")).dropDuplicates(["pi"])
    return events.drop("energy").join(middle, "pi", "left").withColumn("energy", F.coalesce("__e", F.lit(0.0))).drop("__e")


def split_overlapping(events: DataFrame, tstart: float, tstop: float, length: float, overlap: float = 0.0) -> DataFrame:
    """Events with the sliding chunks they lie in; a last chunk shorter than half is left out.

    Each event gets its chunks by arithmetic, so that no join is needed.  Output: events and chunk.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap has to be from 0 to below 1")
    step = length * (1 - overlap)
    last = max(0, math.ceil((tstop - tstart) / step) - 1)
    while last > 0 and tstop - (tstart + last * step) < length / 2:
        last -= 1
    t = F.col("t") - tstart
    first = F.greatest(F.floor((t - length) / step) + 1, F.lit(0))
    final = F.least(F.floor(t / step), F.lit(last))
    return events.where((F.col("t") >= tstart) & (F.col("t") < tstop)).withColumn("chunk", F.explode(F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<bigint>"))))


def concatenate(lists: Sequence[tuple[DataFrame, float]], mjdref: float) -> DataFrame:
    """Event lists of different reference dates as one: times are shifted to ``mjdref``. Missing columns become null."""
    shifted = [df.withColumn("t", F.col("t") + (ref - mjdref) * 86400.0) for df, ref in lists]
    out = shifted[0]
    for df in shifted[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_prior(events: DataFrame, keys: Sequence[str], most: float) -> DataFrame:
    """Time since the event before within the keys, at most ``most``; the first event gets ``most``."""
    lagged = blocked_lag(events, keys, ["t", "event_id"], {"t": "__before"}, block_of("t"))
    return lagged.withColumn("prior", F.least(F.col("t") - F.col("__before"), F.lit(float(most)))).withColumn("prior", F.coalesce("prior", F.lit(float(most)))).drop("__before")


def dead_time_paralyzable(events: DataFrame, keys: Sequence[str], dead: float) -> DataFrame:
    """Events at least ``dead`` after the event before them, kept or not."""
    lagged = blocked_lag(events, keys, ["t", "event_id"], {"t": "__before"}, block_of("t"))
    return lagged.where(F.col("__before").isNull() | (F.col("t") - F.col("__before") >= dead)).drop("__before")


def dead_time(events: DataFrame, keys: Sequence[str], dead: float) -> DataFrame:
    """Events at least ``dead`` after the last kept event (non-paralysable).

    An event that follows a pause of ``dead`` is always kept, whatever lies before it.  So pauses cut a key into runs
    that don't depend on each other, and only a run is scanned in order; a hot key is as many runs as it has pauses.
    """
    lagged = blocked_lag(events, keys, ["t", "event_id"], {"t": "__before"}, block_of("t"))
    marked = lagged.withColumn("__new", (F.col("__before").isNull() | (F.col("t") - F.col("__before") >= dead)).cast("long")).drop("__before")
    named = blocked_running_sum(marked.withColumn("__o", F.struct("t", "event_id")), keys, "__o", "__new", F.floor(F.col("t") / BLOCK_S), "__run").drop("__o", "__new")
    schema = named.schema
    order = [*keys, "__run"]

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, 0.0
        for part in parts:
            mask = []
            for at, t in zip(zip(*[part[k] for k in order]), part["t"]):
                take = at != run or t - last >= dead
                run = at
                if take:
                    last = t
                mask.append(take)
            yield part[mask]

    return named.repartition(*order).sortWithinPartitions(*order, "t", "event_id").mapInPandas(keep, schema).drop("__run")


def orbit_delay(t: Column, asini: float | Column, porb: float | Column, t0: float | Column) -> Column:
    """Time of emission in a circular orbit, by two steps of the delay A sin(2 pi (t - T0) / P)."""
    a, p, z = (x if isinstance(x, Column) else F.lit(float(x)) for x in (asini, porb, t0))
    first = t - a * F.sin(F.lit(2 * math.pi) * (t - z) / p)
    return t - a * F.sin(F.lit(2 * math.pi) * (first - z) / p)


def interpolate(events: DataFrame, grid: DataFrame, step: float, out: str) -> DataFrame:
    """Linear interpolation of a regular grid (t, value) at the events' times, by an equi-join on the cell.

    Events outside the grid get null.
    """
    w = grid.select(F.round(F.col("t") / step).cast("long").alias("__cell"), F.col("value").alias("__v0"))
    after = w.select((F.col("__cell") - 1).alias("__cell"), F.col("__v0").alias("__v1"))
    cells = w.join(after, "__cell")
    rows = events.withColumn("__cell", F.floor(F.col("t") / step)).join(cells, "__cell", "left")
    share = F.col("t") / step - F.col("__cell")
    return rows.withColumn(out, F.col("__v0") + share * (F.col("__v1") - F.col("__v0"))).drop("__cell", "__v0", "__v1")
