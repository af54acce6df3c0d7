"""Irregular readings onto a regular grid, with the empty cells predicted and marked."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import blocked_lag, broadcast_if_small, explode_range
from tickloom.sources.tables import finite, with_checkpoints

#: Cells of one key that are handled together, at most.
CELL_BLOCK = 4096
#: Seconds by which a reading may lie before the border of a cell and still count as in it (rounding of doubles).
EDGE = 1e-6


def spacing_of_readings(readings: DataFrame, key: str, time: str, origin: str, span: str, block_seconds: float = 10_000.0) -> DataFrame:
    """Step of regularly spaced keys: the most frequent positive spacing of consecutive readings.

    Among equally frequent spacings the smallest counts.  Spacings that divide ``span`` (the key's length) go before those
    that do not.  Keys with fewer than two different times get no row.  ``origin`` is the key's start; times before it
    form blocks of their own.  Null times are ignored.  Output: key, step.
    """
    times = readings.select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(origin).alias("t0"), F.col(span).alias("len")).where("t is not null and not isnan(t)").dropDuplicates(["key", "t"])
    lagged = blocked_lag(times, ["key"], ["t"], {"t": "before"}, F.floor((F.col("t") - F.coalesce("t0", F.lit(0.0))) / block_seconds))
    gaps = lagged.where("before is not null").select("key", "len", F.round(F.col("t") - F.col("before"), 5).alias("step")).where("step > 0")
    counted = gaps.groupBy("key", "step").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len"))
    ratio = F.col("len") / F.col("step")
    fits = (F.abs(ratio - F.round(ratio)) < 1e-6).cast("int")
    return counted.groupBy("key").agg(F.max_by("step", F.struct(fits, "n", -F.col("step"))).alias("step"))


#: Seasons in a source's span that are tried where none is given, harmonics of a season, and filled cells that each season
#: tried needs.
CYCLES, HARMONICS, CELLS_EACH = (1, 2, 4, 8), 2, 16
#: Ridge of the normal equations, in shares of the number of cells; the part of the squared values below which residuals
#: don't count as better, and the share by which each further candidate has to be better.
RIDGE, LEVEL, PENALTY = 1e-6, 1e-6, 0.01

#: Angular frequencies of the harmonics of all candidates, and of each candidate its columns of the design.
FREQUENCIES = sorted({c * h for c in CYCLES for h in range(1, HARMONICS + 1)})
_COLUMNS = [[0, 1] + [2 + 2 * FREQUENCIES.index(c * h) + part for h in range(1, HARMONICS + 1) for part in (0, 1)] for c in CYCLES]


def _features(u: F.Column, frequencies: Sequence[int | F.Column], phase: F.Column | None = None) -> list[F.Column]:
    """Columns of the design at a position u (0 to 1) in the span: constant, trend, and the pairs of the frequencies."""
    at = u if phase is None else phase
    return [F.lit(1.0), u] + [f(at * F.lit(2 * math.pi) * k) for k in frequencies for f in (F.cos, F.sin)]


def _solved(flat: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of seasons and coefficients of each row of sums.

    A row has the upper half of the normal matrix over all candidates' columns, its right side, and the sum of squares.
    Each candidate is a part of that matrix; the one of the least residuals is taken, the earlier where it is hardly worse.
    """
    p = 2 + 2 * len(FREQUENCIES)
    upper = np.triu_indices(p)
    gram = np.zeros((len(flat), p, p))
    gram[:, upper[0], upper[1]] = flat[:, : len(upper[0])]
    gram += np.transpose(np.triu(gram, 1), (0, 2, 1))
    right, squares = flat[:, len(upper[0]) : -1], flat[:, -1]
    n = gram[:, 0, 0]
    best, chosen, coef = np.full(len(flat), np.inf), np.ones(len(flat), int), np.zeros((len(flat), 2 + 2 * HARMONICS))
    for i, (cycles, cols) in enumerate(zip(CYCLES, _COLUMNS)):
        own = gram[:, cols][:, :, cols] + np.eye(len(cols)) * (RIDGE * n + 1e-9)[:, None, None]
        x = np.linalg.solve(own, right[:, cols][..., None])[..., 0]
        rest = np.maximum(squares - (x * right[:, cols]).sum(axis=1), 0.0)
        score = (rest + LEVEL * squares) * (1 + PENALTY * i)
        better = (score < best) & ((i == 0) | (~given & (n >= CELLS_EACH * cycles)))
        best, chosen = np.where(better, score, best), np.where(better, cycles, chosen)
        coef[better] = x[better]
    return chosen, coef


def seasonal_fit(cells: DataFrame) -> DataFrame:
    """Harmonic seasonal regression with trend for each key, by distributed normal equations.

    ``cells`` has key, u (position in the span, 0 to 1), seasons (number of them in the span if the key's season is known,
    else null) and value.  The sums of the normal equations are ordinary aggregates, combined on the map side, so that a hot
    key costs no more than its partial sums; only one small system for each key and candidate is solved.  Where the season
    isn't known it is the part of the span among ``CYCLES`` that leaves the least residuals.
    Output: key, cycles (number of seasons), coef (array: constant, trend, cosine and sine of each harmonic).
    """
    p = 2 + 2 * len(FREQUENCIES)
    phase = F.col("u") * F.coalesce("seasons", F.lit(1.0))
    rows = cells.withColumns({f"x{i}": x for i, x in enumerate(_features(F.col("u"), FREQUENCIES, phase))})
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)] + [F.sum(F.col(f"x{i}") * F.col("value")) for i in range(p)] + [F.sum(F.col("value") * F.col("value"))]
    normal = rows.groupBy("key").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)], F.max("seasons").alias("seasons"))

    @F.pandas_udf("struct<cycles: double, coef: array<double>>")
    def solve(sums: pd.Series, seasons: pd.Series) -> pd.DataFrame:
        if not len(sums):
            return pd.DataFrame({"cycles": pd.Series([], dtype=float), "coef": pd.Series([], dtype=object)})
        known = seasons.to_numpy(float)
        chosen, coef = _solved(np.stack(sums.to_numpy()), ~np.isnan(known))
        return pd.DataFrame({"cycles": np.where(np.isnan(known), chosen, known), "coef": list(coef)})

    out = normal.select("key", solve(F.array(*[f"s{i}" for i in range(len(sums))]), "seasons").alias("f"))
    return out.select("key", "f.cycles", "f.coef")


def _predict(u: F.Column) -> F.Column:
    total = F.lit(0.0)
    for i, x in enumerate(_features(u, range(1, HARMONICS + 1), u * F.col("cycles"))):
        total = total + F.col("coef")[i] * x
    return total


def observed_cells(readings: DataFrame, sources: DataFrame) -> DataFrame:
    """Readings into the cells of their source: key, cell, n_readings, value (their mean), n_cells, seasons.

    ``readings``: key, reading_id, t, value; ``sources``: key, t0, step, n_cells, counting, seasons.  A reading fills a cell
    if its value is finite and its time lies in the grid.  Rows that repeat a reading_id of the key and cell count once.
    """
    placed = readings.where(F.col("t").isNotNull() & finite("value").isNotNull()).join(broadcast_if_small(sources), "key")
    cell = F.floor((F.col("t") - F.col("t0") + EDGE) / F.col("step")).cast("long")
    placed = placed.withColumn("cell", cell).where("cell >= 0 and cell < n_cells")
    of_source = ["n_cells", "counting", "seasons"]
    once = placed.groupBy("reading_id", "key", "cell", *of_source).agg(F.max("value").alias("value"))
    value = F.when(F.max("counting"), F.count(F.lit(1)).cast("double")).otherwise(F.avg("value"))
    return once.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n_readings"), value.alias("value"), F.max("n_cells").alias("n_cells"), F.max("seasons").alias("seasons"))


def regular_grid(readings: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source on its regular grid, with empty cells predicted and marked.

    ``readings``: key, reading_id, t, value.  ``sources``: key, t0, step, n_cells, counting, and if known season, the length
    of the source's season in the unit of t.  The value of a filled cell is the mean of its readings, or in a counting
    source their number.  A harmonic seasonal regression with trend is fitted to the filled cells of each source (see
    seasonal_fit); an empty cell gets its prediction plus the residual bridged linearly between the two filled cells around
    it (the nearest one at an edge).

    Output: key, cell_no, value, filled, n_readings, origin: 'observed' for a filled cell, 'predicted' for an empty one
    with a value, 'unknown' for those of a source without any reading, whose value is null.  (A value that overflows a
    double is taken as the largest one.)

    Sources with a null or non-positive step or without cells give no rows; readings with null time, null, NaN or infinite
    value, of an unknown source or outside the grid fill nothing; repeats count once; of repeated sources any one counts;
    a season that is null or not positive is as unknown.  Extra columns are ignored.  The sources, the filled cells and the
    fits are written to the checkpoint folder, since several steps read them.
    """
    with_checkpoints(readings.sparkSession)
    length = F.col("n_cells") * F.col("step")
    seasons = F.when(F.col("season") > 0, length / F.col("season")) if "season" in sources.columns else F.lit(None).cast("double")
    sources = sources.select("key", "t0", "step", "n_cells", "counting", seasons.alias("seasons")).where("key is not null and t0 is not null and step > 0 and n_cells > 0").dropDuplicates(["key"]).checkpoint()
    filled = observed_cells(readings.select("key", "reading_id", "t", "value"), sources).checkpoint()
    u = (F.col("cell") + F.lit(0.5)) / F.col("n_cells")
    fits = seasonal_fit(filled.select("key", u.alias("u"), "seasons", "value")).checkpoint()
    block = F.expr(f"cell div {CELL_BLOCK}")
    steps = blocked_lag(filled.select("key", "cell", "value", "n_cells"), ["key"], ["cell"], {"cell": "cell_before", "value": "value_before"}, block)
    inner = steps.where("cell - cell_before > 1").select("key", "n_cells", "cell_before", "value_before", F.col("cell").alias("cell_after"), F.col("value").alias("value_after"))
    ends = filled.groupBy("key", "n_cells").agg(F.min(F.struct("cell", "value")).alias("a"), F.max(F.struct("cell", "value")).alias("z"))
    nothing = F.lit(None).cast("double")
    head = ends.where("a.cell > 0").select("key", "n_cells", F.lit(-1).cast("long").alias("cell_before"), F.col("a.value").alias("value_before"), F.col("a.cell").alias("cell_after"), F.col("a.value").alias("value_after"))
    tail = ends.where("z.cell < n_cells - 1").select("key", "n_cells", F.col("z.cell").alias("cell_before"), F.col("z.value").alias("value_before"), F.col("n_cells").alias("cell_after"), nothing.alias("value_after"))
    holes = inner.unionByName(head).unionByName(tail).join(broadcast_if_small(fits), "key")

    def bridged(hole: F.Column, value: F.Column) -> F.Column:
        return value - _predict((hole + F.lit(0.5)) / F.col("n_cells"))

    first = F.when(F.col("cell_before") >= 0, bridged(F.col("cell_before"), F.col("value_before")))
    last = F.when(F.col("cell_after") < F.col("n_cells"), bridged(F.col("cell_after"), F.col("value_after")))
    holes = holes.withColumns({"r0": F.coalesce(first, last), "r1": F.coalesce(last, first)})
    empty = explode_range(holes, F.col("cell_before") + 1, F.col("cell_after") - 1, "cell")
    share = (F.col("cell") - F.col("cell_before")) / (F.col("cell_after") - F.col("cell_before"))
    value = _predict(u) + F.col("r0") + share * (F.col("r1") - F.col("r0"))
    most = F.lit(sys.float_info.max)
    value = F.when(F.isnan(value), 0.0).otherwise(F.greatest(F.least(value, most), -most))

    def cells(df: DataFrame, value: F.Column, filled: bool, n: F.Column, origin: str) -> DataFrame:
        return df.select("key", F.col("cell").alias("cell_no"), value.alias("value"), F.lit(filled).alias("filled"), n.alias("n_readings"), F.lit(origin).alias("origin"))

    none = F.lit(0).cast("long")
    bare = explode_range(sources.join(broadcast_if_small(ends.select("key")), "key", "left_anti"), none, F.col("n_cells") - 1, "cell")
    return cells(filled, F.col("value"), True, F.col("n_readings"), "observed").unionByName(cells(empty, value, False, none, "predicted")).unionByName(cells(bare, nothing, False, none, "unknown"))
