"""Spikes, frozen values and impossible readings, relative to each source's usual behaviour."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import broadcast_if_small, ranked
from tickloom.sources.tables import with_checkpoints

#: Readings of one source that are filtered together, and those of the neighbouring blocks that are seen besides.  A verdict
#: on a reading depends on at most HALO_ROWS readings on either side, so the blocks don't change it.
BLOCK_ROWS, HALO_ROWS = 4096, 640
#: Readings on either side that a run of equal values is followed over, and then those beyond its ends it is held against.
FOLLOW, BESIDE = 256, 256
#: Standardised innovation beyond which an update is withheld; a candidate is then held against LIMIT times the scatter.
GATE, LIMIT = 4.0, 10.0
#: Equal readings in a row that may count as frozen, and the expected number of such runs below which chance is ruled out.
RUN, CHANCE = 6, 1e-3
#: Readings on either side that show the level around a reading.
AROUND = 6
#: Updates withheld in a row after which the level is taken to have moved.
MOVED = 8
#: Process noise of the level against the variance of a reading: least and most.
WALK = (0.05, 2.0)
#: Widths of the bins of the histograms of differences, as a ratio, and rows that are filtered at once.
BIN, BATCH = 1.001, 150_000
#: Sources whose usual behaviour is broadcast; beyond that the join shuffles and the order is made again.
MOST_SOURCES = 300_000


def with_blocks(rows: DataFrame, rows_each: int = BLOCK_ROWS) -> DataFrame:
    """Cut every key into blocks of ``rows_each`` rows along t and reading_id, numbered from 0; the last has the rest.

    Output: besides the columns of ``rows``, block, up and down (rows of the block before and behind a row), last (whether
    it is the key's last block).  A hot key is spread without sorting it in one task, however its times are distributed.
    """
    placed = ranked(rows, ["key"], ["t", "reading_id"], "__rank", "__n")
    placed = placed.withColumns({"block": F.expr(f"__rank div {rows_each}"), "up": F.col("__rank") % rows_each, "last": F.expr(f"__rank div {rows_each} = (__n - 1) div {rows_each}")})
    behind = F.when(F.col("last"), F.col("__n") - F.col("block") * rows_each).otherwise(F.lit(rows_each)) - 1 - F.col("up")
    return placed.withColumn("down", behind).drop("__rank", "__n")


def with_halo(rows: DataFrame, rows_each: int = BLOCK_ROWS, halo: int = HALO_ROWS) -> DataFrame:
    """Rows near a border of blocks once more with the blocks they are near to, where own is false."""
    reach = -(-halo // rows_each)
    to = [F.struct(F.col("block").alias("b"), F.lit(True).alias("own"))]
    for k in range(1, reach + 1):
        beyond = halo - (k - 1) * rows_each
        to += [F.struct(F.when((F.col("up") < beyond) & (F.col("block") >= k), F.col("block") - k).alias("b"), F.lit(False).alias("own"))]
        to += [F.struct(F.when((F.col("down") < beyond) & ~F.col("last"), F.col("block") + k).alias("b"), F.lit(False).alias("own"))]
    return rows.withColumn("__to", F.explode(F.array(*to))).where("__to.b is not null").withColumns({"block": F.col("__to.b"), "own": F.col("__to.own")}).drop("__to", "up", "down", "last")


class _Groups:
    """Readings of whole blocks one after another: values, borders of the groups, and what each group is."""

    def __init__(self, df: pd.DataFrame):
        ids = df["reading_id"].to_numpy()
        keys, blocks = df["key"].to_numpy(), df["block"].to_numpy()
        new = np.r_[True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])]
        once = new | np.r_[True, ids[1:] != ids[:-1]]  # re-sent rows lie side by side
        self.df = df[once]
        self.value = self.df["value"].to_numpy(float)
        self.own = self.df["own"].to_numpy(bool)
        self.start = np.flatnonzero(new[once])
        self.group = np.cumsum(new[once]) - 1
        self.counting = self.df["counting"].to_numpy(bool)
        y = self.value
        self.cannot = np.isinf(y) | (self.counting & ((y < 0) | (y != np.floor(y))))

    def same(self, idx: np.ndarray, lag: int) -> np.ndarray:
        """Whether idx[k] and idx[k + lag] are of one group."""
        return self.group[idx[:-lag]] == self.group[idx[lag:]] if len(idx) > lag else np.zeros(0, bool)


def _equal_runs(g: _Groups, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of every reading's run of equal values, and the one behind its last, in ``idx``."""
    y = g.value[idx]
    new = np.r_[True, (y[1:] != y[:-1]) | ~g.same(idx, 1)] if len(idx) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return starts[run], np.r_[starts[1:], len(idx)][run]


def _differences(df: pd.DataFrame) -> pd.DataFrame:
    """Counts of the sizes of differences by bins on a log scale: of a reading to the mean of its neighbours, to the next, and to the one after.

    Only those whose middle (or first) reading is the block's own count, so that a source's sums don't depend on its blocks.
    Long runs of equal values are left out: they may be frozen.
    """
    g = _Groups(df)
    idx = np.flatnonzero(~g.cannot)
    first, end = _equal_runs(g, idx)
    counting = g.counting[idx]
    idx = idx[(end - first < RUN) | counting]
    y, near, far = g.value[idx], g.same(idx, 1), g.same(idx, 2)
    parts = []
    if len(idx) > 2:
        own = g.own[idx]
        parts = [("d", np.abs(y[1:-1] - (y[:-2] + y[2:]) / 2), far & own[1:-1], idx[1:-1]), ("s", np.abs(y[2:] - y[:-2]), far & own[:-2], idx[:-2])]
    if len(idx) > 1:
        parts.append(("e", np.abs(y[1:] - y[:-1]), near & g.own[idx][:-1], idx[:-1]))
    keys = g.df["key"].to_numpy()
    out = []
    for kind, size, ok, at in parts:
        bins = np.where(size > 0, np.round(np.log(np.maximum(size, 1e-300)) / np.log(BIN)), -(2**31)).astype(np.int64)
        out.append(pd.DataFrame({"key": keys[at[ok]], "kind": kind, "bin": bins[ok], "n": 1}))
    own = g.df[g.own]
    out.append(pd.DataFrame({"key": own["key"], "kind": "n", "bin": 0, "n": 1}))
    equal = idx[1:][near & (y[1:] == y[:-1])] if len(idx) > 1 else idx[:0]
    out.append(pd.DataFrame({"key": keys[equal[g.own[equal]]], "kind": "q", "bin": 0, "n": 1}))
    return pd.concat(out).groupby(["key", "kind", "bin"], as_index=False)["n"].sum()


def usual_scatter(cut: DataFrame) -> DataFrame:
    """How every source usually varies: key, n (readings), usual (scatter), walk (variance of the level's steps), same.

    The scatter is that of a reading about the mean of its neighbours, from the median of all of the source; what differences
    two readings apart have beyond those one apart is the walk of the level; ``same`` is the share of readings that
    equal the one before.  Medians come from counts by bins, one row for each bin, so that no source is held in one task.
    """
    counts = cut.mapInPandas(lambda parts: _by_group(parts, _differences), "key string, kind string, bin bigint, n bigint").groupBy("key", "kind", "bin").agg(F.sum("n").alias("n"))
    hist = counts.groupBy("key").agg(
        F.max(F.when(F.col("kind") == "n", F.col("n"))).alias("n"),
        F.coalesce(F.max(F.when(F.col("kind") == "q", F.col("n"))), F.lit(0)).alias("q"),
        *[F.collect_list(F.when(F.col("kind") == k, F.struct("bin", "n"))).alias(k) for k in "des"])

    @F.pandas_udf("double")
    def median(hist: pd.Series) -> pd.Series:
        def of(rows) -> float | None:
            if not len(rows):
                return None
            b, n = np.array(sorted((r["bin"], r["n"]) for r in rows)).T
            at = int(b[np.searchsorted(np.cumsum(n), n.sum() / 2)])
            return 0.0 if at == -(2**31) else float(BIN**at)

        return pd.Series([of(r) for r in hist], dtype=float)

    d, e, s = (1.4826 * median(k) for k in "des")
    walk = F.greatest(s * s - e * e, F.lit(0.0))
    return hist.select("key", "n", (d / np.sqrt(1.5)).alias("usual"), walk.alias("walk"), (F.col("q") / F.col("n")).alias("same"))


def _pass(y: np.ndarray, r: np.ndarray, q: np.ndarray, counting: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of a local-level Kalman filter over padded rows (groups by position): standardised innovations, and how far
    every reading's innovation is from what the one before leaves behind, as a share of the values.

    The level walks with variance q, a reading has variance r, in a counting source at least its level.  Updates beyond GATE
    are withheld; after MOVED of them in a row the state starts anew.  After an innovation e and a gain k the next one is
    (1 - k) e if nothing new is read: the rest is what is new, and its variance vanishes where a source is frozen.
    """
    s, n = y.shape
    level, var, misses, started = np.zeros(s), np.zeros(s), np.zeros(s, int), np.zeros(s, bool)
    left = np.zeros(s)
    z, fresh_part = np.zeros((s, n)), np.full((s, n), np.inf)
    for k in range(n):
        on = use[:, k]
        noise = np.where(counting, np.maximum(np.maximum(r, level), 1.0), r)
        fresh = on & (~started | (misses >= MOVED))
        predicted = var + q
        innovation = y[:, k] - level
        fresh_part[:, k] = np.where(on & started, np.abs(innovation - left) / (np.abs(y[:, k]) + np.abs(level) + 1e-300), np.inf)
        score = np.where(on & ~fresh, innovation / np.sqrt(predicted + noise), 0.0)
        z[:, k] = score
        take = on & ~fresh & (np.abs(score) <= GATE)
        gain = np.where(fresh, 1.0, np.where(take, predicted / (predicted + noise), 0.0))
        level = np.where(on, level + gain * innovation, level)
        left = np.where(on, (1 - gain) * innovation, left)
        var = np.where(fresh, noise, np.where(take, (1 - gain) * predicted, np.where(on, predicted, var)))
        var = np.minimum(var, 25 * noise)
        misses = np.where(fresh | take, 0, np.where(on, misses + 1, misses))
        started |= fresh
    return z, fresh_part


def _filtered(g: _Groups, idx: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The filter over some readings of all groups, each in its own row: innovations and what is new in them."""
    z, fresh = np.zeros(len(idx)), np.full(len(idx), np.inf)
    if not len(idx):
        return z, fresh
    groups, first, size = np.unique(g.group[idx], return_index=True, return_counts=True)
    row = np.repeat(np.arange(len(groups)), size)
    col = np.arange(len(idx)) - np.repeat(first, size)
    if backward:
        col = np.repeat(size, size) - 1 - col
    y, use = np.zeros((len(groups), size.max())), np.zeros((len(groups), size.max()), bool)
    y[row, col], use[row, col] = g.value[idx], True
    per = g.df.iloc[g.start[groups]]
    r = np.maximum(per["usual"].fillna(0.0).to_numpy(float) ** 2, 1e-12)
    counting = per["counting"].to_numpy(bool)
    q = np.clip(per["walk"].fillna(0.0).to_numpy(float), WALK[0] * r, WALK[1] * r)
    q = np.where(counting, np.maximum(q, WALK[0]), q)
    # Groups of like length go together, so that a long one doesn't pad all others.
    order = np.argsort(size, kind="stable")
    zs, fs = np.zeros_like(y), np.full_like(y, np.inf)
    for part in np.split(order, np.flatnonzero(np.diff(np.ceil(np.log2(size[order] + 1)))) + 1):
        most = size[part].max()
        zs[part, :most], fs[part, :most] = _pass(y[part, :most], r[part], q[part], counting[part], use[part, :most])
    return zs[row, col], fs[row, col]


def _frozen(g: _Groups, idx: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Readings of runs in which the variance of what is new vanishes, where chance doesn't explain them.

    A run is taken from the filter; the exact check is that its values are equal and that as many in a row are unlikely from
    the readings beside it: n p^(length - 1), where p is the share of the value, in a counting source at least its
    chance at the level beside.
    """
    out = np.zeros(len(idx), bool)
    y = g.value[idx]
    still = fresh <= 1e-12  # of the values themselves: what rounding leaves
    # Variance over the last RUN - 1 steps: it vanishes where each of them does.
    calm = np.convolve(still, np.ones(RUN - 1, int))[: len(idx)] >= RUN - 1 if len(idx) else still
    first, end = _equal_runs(g, idx)
    runs = np.unique(first[calm & (end - first >= RUN)])
    n, same = g.df["n"].to_numpy(float), g.df["same"].to_numpy(float)
    group = g.group[idx]
    bounds = np.searchsorted(group, np.arange(len(g.start) + 1))
    for a in runs:
        z, lo, hi = end[a], bounds[group[a]], bounds[group[a] + 1]
        at = np.arange(a, z)
        before, after = np.minimum(at - a, FOLLOW), np.minimum(z - 1 - at, FOLLOW)
        sees = (at - a <= FOLLOW).astype(int) + 2 * (z - 1 - at <= FOLLOW)
        for kind in np.unique(sees):
            left = y[max(lo, a - BESIDE) : a] if kind & 1 else y[:0]
            right = y[z : min(hi, z + BESIDE)] if kind & 2 else y[:0]
            beside = np.r_[left, right]
            size = n[idx[a]]
            share = np.mean(beside == y[a]) if len(beside) else (same[idx[a]] if kind != 3 else 0.0)
            if g.counting[idx[a]]:
                near = np.r_[left[-20:], right[:20]]
                level = max(float(np.median(near)), float(np.mean(np.minimum(near, np.median(near) * 3 + 3))), 0.05) if len(near) else max(y[a], 0.05)
                share = max(share, 1 / np.sqrt(2 * np.pi * max(level, 1)) * np.exp(-((y[a] - level) ** 2) / (2 * max(level, 1))))
            length = before + after + 1
            out[at[sees == kind]] = (size * np.maximum(share, 1 / size) ** (length - 1) < CHANCE)[sees == kind]
    return out


def _levels(y: np.ndarray, good: np.ndarray, bounds: np.ndarray, at: np.ndarray, sides: bool) -> np.ndarray:
    """Median of the good readings around some positions, without themselves; NaN without any.

    ``good``: sorted positions; ``bounds``: for each position the part of ``good`` that is of its group.  With ``sides`` that
    of either side counts as well, and the one closest to the reading is taken: next to a long gap in a changing series
    only the near side shows the level.
    """
    if not len(at) or not len(good):
        return np.full(len(at), np.nan)
    left, right = np.searchsorted(good, at), np.searchsorted(good, at, side="right")
    steps = np.arange(AROUND)
    b, a = left[:, None] - AROUND + steps, right[:, None] + steps
    inside = lambda i: (i >= bounds[0][:, None]) & (i < bounds[1][:, None])
    before = np.where(inside(b), y[good[np.clip(b, 0, len(good) - 1)]], np.nan)
    after = np.where(inside(a), y[good[np.clip(a, 0, len(good) - 1)]], np.nan)
    around = np.concatenate([before, after], axis=1)
    some = ~np.isnan(around).all(axis=1)
    out = np.full(len(at), np.nan)
    out[some] = np.nanmedian(around[some], axis=1)
    if sides:
        half = AROUND // 2
        for part in (before[:, -half:], after[:, :half]):
            whole = ~np.isnan(part).any(axis=1)
            level = np.median(part[whole], axis=1)
            nearer = np.abs(y[at[whole]] - level) < np.abs(y[at[whole]] - out[whole])
            out[whole] = np.where(nearer, level, out[whole])
    return out


FLAG = "key string, reading_id bigint, reason string"


def _flags(df: pd.DataFrame) -> pd.DataFrame:
    """Flagged readings of whole blocks that carry their source's usual behaviour."""
    g = _Groups(df)
    y, counting = g.value, g.counting
    usual = g.df["usual"].to_numpy(float)
    idx = np.flatnonzero(~g.cannot)
    forward, fresh = _filtered(g, idx)
    stuck = np.zeros(len(y), bool)
    stuck[idx[_frozen(g, idx, fresh)]] = True
    clean = idx[~stuck[idx]]
    # Frozen readings are withheld: groups that have some are filtered again without them.
    again = np.isin(g.group[clean], np.unique(g.group[stuck]))
    score = np.zeros(len(y))
    score[idx] = np.abs(forward)
    score[clean[again]] = np.abs(_filtered(g, clean[again])[0])
    hot = (score[clean] > GATE) | (np.abs(_filtered(g, clean, backward=True)[0]) > GATE)

    def levels(good: np.ndarray, at: np.ndarray, sides: bool) -> np.ndarray:
        of = g.group[good]
        return _levels(y, good, (np.searchsorted(of, g.group[at]), np.searchsorted(of, g.group[at], side="right")), at, sides)

    def is_far(at: np.ndarray, level: np.ndarray) -> np.ndarray:
        floor = np.where(counting[at], np.maximum(np.sqrt(np.maximum(level, 0.0)), 1.0), 0.0)
        scale = np.fmax(usual[at], floor)
        return (np.abs(y[at] - level) > LIMIT * scale) & (scale > 0)

    # Once more without what is far off, so that spikes next to each other don't hide one another. Candidates that turn
    # out plausible, as behind a long gap in a changing series, stay among the readings that show the level.
    at = clean[hot]
    far = is_far(at, levels(clean, at, False))
    good = np.setdiff1d(clean, at[far], assume_unique=True)
    spike = at[is_far(at, levels(good, at, True))]
    reason = np.full(len(y), "", dtype=object)
    reason[spike], reason[stuck], reason[g.cannot] = "spike", "frozen", "impossible"
    pick = (reason != "") & g.own
    return pd.DataFrame({"key": g.df["key"].to_numpy()[pick], "reading_id": g.df["reading_id"].to_numpy()[pick], "reason": reason[pick]})


def _by_group(parts: Iterator[pd.DataFrame], run: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups (key, block) from sorted batches, many at once; the last of them may go on in the next batch."""
    waiting: list[pd.DataFrame] = []
    rows = 0
    for part in parts:
        waiting.append(part)
        rows += len(part)
        if rows > BATCH:
            whole = pd.concat(waiting, ignore_index=True)
            done = np.flatnonzero(((whole["key"] != whole["key"].iloc[-1]) | (whole["block"] != whole["block"].iloc[-1])).to_numpy())
            end = int(done[-1]) + 1 if len(done) else 0
            if end:
                yield run(whole.iloc[:end])
            waiting, rows = [whole.iloc[end:]], len(whole) - end
    if rows:
        yield run(pd.concat(waiting, ignore_index=True))


def implausible(readings: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Flag spikes, frozen and impossible readings of each source.

    ``readings``: key, reading_id, t, value, counting (true: a Poisson series of whole counts).  A local-level Kalman
    filter runs over each source in both directions, with the source's own scatter and walk of the level; readings whose
    standardised innovation passes the gate are withheld from it and become candidates, and a candidate is a spike if it
    differs from the median of the readings around it (without other spikes, and also from that of either side) by more
    than ten times the usual scatter of its source (of a counting source at least the root of that level, and 1).  Readings
    are frozen where the variance of what is new in the innovations vanishes and chance can't explain it; they are withheld
    too.  A reading is impossible if infinite, or in a counting source negative or not whole.

    Null and NaN values, null times and null keys are never flagged and used for nothing; rows that repeat a reading_id
    count once; readings at the same time are ordered by id; sources of fewer than three readings have only impossible
    readings.  Sources of more than ``block_rows`` readings are cut into blocks with a halo as wide as any verdict looks, and
    what holds for a source comes from all its readings: blocks of any size give the same.  Output: key, reading_id, reason.
    """
    with_checkpoints(readings.sparkSession)
    rows = readings.select("key", "reading_id", F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"), F.coalesce("counting", F.lit(False)).alias("counting"))
    rows = rows.where("key is not null and reading_id is not null and t is not null and not isnan(t) and value is not null and not isnan(value)")
    # Only sources longer than a block are ranked; re-sent rows of the others are dropped where they lie side by side.
    long_ones = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block_rows).select("key").checkpoint()
    small = rows.join(broadcast_if_small(long_ones), "key", "left_anti").withColumns({"block": F.lit(0).cast("long"), "own": F.lit(True)})
    cut = small
    if not long_ones.isEmpty():
        large = rows.join(broadcast_if_small(long_ones), "key", "left_semi").dropDuplicates(["key", "t", "reading_id"])
        cut = small.unionByName(with_halo(with_blocks(large, block_rows), block_rows))
    cut = cut.repartition("key", "block").sortWithinPartitions("key", "block", "t", "reading_id").checkpoint()
    usual = usual_scatter(cut).checkpoint()
    known = cut.join(broadcast_if_small(usual), "key").select(*cut.columns, "n", "usual", "walk", "same")
    if usual.count() > MOST_SOURCES:
        known = known.repartition("key", "block").sortWithinPartitions("key", "block", "t", "reading_id")
    return known.mapInPandas(lambda parts: _by_group(parts, _flags), FLAG).dropDuplicates(["reading_id"])

