"""Quantities recorded in different units onto common ones."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import kernels
from tickloom.functions.expr import rough_energy
from tickloom.operators.blocks import broadcast_if_small
from tickloom.sources.tables import finite, with_checkpoints

#: How many of each unit make one keV, and one second.
ENERGY_UNITS = {"keV": 1.0, "eV": 1e3, "MeV": 1e-3, "GeV": 1e-6, "erg": 1.602176634e-9, "J": 1.602176634e-16}
TIME_UNITS = {"s": 1.0, "ms": 1e3, "us": 1e6, "ks": 1e-3, "min": 1 / 60, "h": 1 / 3600, "d": 1 / 86400}
#: How units are written, as whole texts or words of a remark, in lower case.
ENERGY_WORDS = {"keV": "kev|kiloelectron ?volts?", "eV": "ev|electron ?volts?", "MeV": "mev|megaelectron ?volts?", "GeV": "gev|gigaelectron ?volts?", "erg": "ergs?", "J": "j|joules?"}
TIME_WORDS = {"s": "s|sec|secs|seconds?|sekunden|secondes", "ms": "ms|msec|milliseconds?|millisekunden", "us": "us|usec|microseconds?", "ks": "ks|ksec|kiloseconds?|kilosekunden", "min": "min|mins|minutes?|minuten", "h": "h|hr|hrs|hours?|stunden|heures?", "d": "d|days?|tagen?|jours?"}

#: Widths of a component of the log-scale mixture in decades: against a calibrated energy, against the usual one, and against
#: a live time; width of the histogram's bins; posterior to be sure.
SPREAD, WIDE, NARROW, BIN, SURE = 0.25, 0.8, 0.1, 0.05, 0.99
#: Values of each unit that a source may have beside those seen.
UNSEEN = 0.5
#: Prior weight of a declared unit against any of the others.
DECLARED = 1e4
#: Usual energy of a photon in keV.
USUAL_KEV = 4.0


def named_unit(text: Column, words: dict[str, str], whole: bool) -> Column:
    """The unit a text names: the whole text, or with ``whole`` false the one unit among its words; else null."""
    low = F.lower(F.trim(text))
    hits = F.array_compact(F.array(*[F.when(low.rlike(rf"^({w})\.?$" if whole else rf"(^|[^a-z0-9])({w})([^a-z0-9]|$)"), F.lit(u)) for u, w in words.items()]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def _weight(k: int, centres: Sequence[float], unit: str, x: Column, spread: Column, declared: Column) -> Column:
    """Likelihood of a value under a unit, relative to a declared one; 1 for all units where the value tells nothing."""
    off = (x - centres[k]) / spread
    return F.coalesce(F.exp(F.greatest(-0.5 * off * off, F.lit(-600.0))), F.lit(1.0)) * F.when(declared == unit, DECLARED).otherwise(1.0)


def unit_of_values(values: DataFrame, units: dict[str, float]) -> DataFrame:
    """The unit of every value by its posterior in a mixture fitted to its source.

    ``values``: source, x (log10 of a value over what it should be in the common unit; null where it tells nothing), spread
    (width of a component in decades; wide where only the population is known), declared (unit named for the value, or null)
    and any other columns.  For each source a mixture in log scale is fitted by expectation-maximisation, whose components
    are offset by the known conversion factors; a declared unit is a prior.  Values are first counted in bins of x, so that
    a source is as many rows as it has bins.  Adds unit (the likeliest; null where nothing is known) and posterior.
    """
    names, centres = [*units], [math.log10(v) for v in units.values()]
    x = F.round(F.col("x") / BIN) * BIN
    weights = F.array(*[_weight(k, centres, u, F.col("b"), F.col("spread"), F.col("declared")) for k, u in enumerate(names)])
    counted = values.where("source is not null").select("source", x.alias("b"), "spread", "declared").groupBy("source", "b", "spread", "declared").agg(F.count(F.lit(1)).alias("n"))
    hist = counted.groupBy("source").agg(F.collect_list(F.struct(weights.alias("w"), "n")).alias("bins"))

    @F.pandas_udf("array<double>")
    def fit(bins: pd.Series) -> pd.Series:
        out = []
        for rows in bins:
            n = np.array([r["n"] for r in rows])
            shares = kernels.mixture_shares(np.stack([r["w"] for r in rows]), n)
            out.append(((shares * n.sum() + UNSEEN) / (n.sum() + UNSEEN * len(names))).tolist())
        return pd.Series(out, dtype=object)

    with_checkpoints(values.sparkSession)
    shares = hist.select("source", fit("bins").alias("shares")).checkpoint()  # counted, and read by the join
    rows = values.join(broadcast_if_small(shares), "source", "left")
    own = F.array(*[_weight(k, centres, u, F.col("x"), F.col("spread"), F.col("declared")) * F.get("shares", F.lit(k)) for k, u in enumerate(names)])
    rows = rows.withColumn("__w", own)
    top = F.array_max("__w")
    unit = F.get(F.array(*[F.lit(u) for u in names]), (F.array_position("__w", top) - 1).cast("int"))
    posterior = top / F.aggregate("__w", F.lit(0.0), lambda a, w: a + w)
    known = F.col("x").isNotNull() | F.col("declared").isNotNull() | (F.array_max("shares") >= SURE)
    return rows.withColumns({"unit": F.when(known, unit), "posterior": F.when(known, posterior)}).drop("__w", "shares")


def in_common_units(value: Column, unit: Column, units: dict[str, float]) -> Column:
    """A value in the common unit; null where the unit is unknown."""
    factor = F.lit(None).cast("double")
    for name, per in units.items():
        factor = F.when(unit == name, per).otherwise(factor)
    return value / factor


def photon_energies(photons: DataFrame, observations: DataFrame) -> DataFrame:
    """Photon energies in keV.

    ``photons``: event_id, obs_id, pi, energy; ``observations``: obs_id, mission, energy_unit, remark.  Every energy gets the
    unit of its posterior in its observation's mixture of units (see unit_of_values), of the recorded energies over those of
    the rough calibration of their channels; where the mission is unknown, over the usual energy of all photons.  A unit
    named in energy_unit, else by words of the remark, is a prior.  A null energy is calibrated from its channel where the
    mission is known.

    Output: event_id, obs_id, energy_kev, unit (the likeliest), sure, from_channel.  Energies whose unit isn't sure (a
    posterior below SURE) are withheld: energy_kev is null and sure false.  NaN and infinite energies and photons of unknown
    observations give null.  Energies of zero or less have no logarithm and take their observation's unit if that is
    one.  Missions are compared without case and blanks around; repeated rows give repeated rows.
    """
    declared = F.coalesce(named_unit(F.col("energy_unit"), ENERGY_WORDS, True), named_unit(F.col("remark"), ENERGY_WORDS, False))
    with_checkpoints(photons.sparkSession)
    obs = observations.select("obs_id", F.lower(F.trim("mission")).alias("mission"), declared.alias("declared")).where("obs_id is not null").dropDuplicates(["obs_id"])
    rows = photons.select("event_id", "obs_id", "pi", F.col("energy").cast("double").alias("energy")).join(broadcast_if_small(obs.withColumn("source", F.col("obs_id"))), "obs_id", "left")
    known = rough_energy(F.col("pi"), F.col("mission"))
    usual = F.when(known > 0, F.log10(known))
    x = F.when(finite("energy") > 0, F.log10("energy")) - F.coalesce(usual, F.lit(math.log10(USUAL_KEV)))
    found = unit_of_values(rows.withColumns({"x": x, "spread": F.when(usual.isNotNull(), SPREAD).otherwise(WIDE)}), ENERGY_UNITS)
    sure = F.coalesce(F.col("posterior") >= SURE, F.lit(False))
    kev = F.when(sure, in_common_units(finite("energy"), F.col("unit"), ENERGY_UNITS))
    return found.select("event_id", "obs_id", F.when(F.col("energy").isNull(), known).otherwise(kev).alias("energy_kev"), "unit", sure.alias("sure"), F.col("energy").isNull().alias("from_channel"))


def header_times(headers: DataFrame) -> DataFrame:
    """Start and stop of files in seconds.

    ``headers``: file_id, start, stop, time_unit, comment, livetime (seconds), and source if files share their habits (else
    all files are one source).  Every file gets the unit of its posterior in its source's mixture of units (see
    unit_of_values), of the log ratio of the duration to the live time, which is below it and near it; a unit named in
    time_unit, else by words of the comment, is a prior.

    Output: file_id, start_s, stop_s, duration_s, unit (the likeliest), sure.  Times whose unit isn't sure are withheld
    (null, sure false); they are null too where a bound is.  A repeated file_id counts once; null ids are left out.
    """
    declared = F.coalesce(named_unit(F.col("time_unit"), TIME_WORDS, True), named_unit(F.col("comment"), TIME_WORDS, False))
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in headers.columns else F.lit("")
    rows = headers.select("file_id", source.alias("source"), finite("start").alias("start"), finite("stop").alias("stop"), declared.alias("declared"), finite("livetime").alias("livetime")).where("file_id is not null").dropDuplicates(["file_id"])
    span = F.col("stop") - F.col("start")
    x = F.when((span > 0) & (F.col("livetime") > 0), F.log10(span / F.col("livetime")))
    found = unit_of_values(rows.withColumns({"x": x, "spread": F.lit(NARROW)}), TIME_UNITS)
    sure = F.coalesce(F.col("posterior") >= SURE, F.lit(False))
    to = {k: F.when(sure, in_common_units(c, F.col("unit"), TIME_UNITS)) for k, c in (("start_s", F.col("start")), ("stop_s", F.col("stop")), ("duration_s", F.col("stop") - F.col("start")))}
    return found.select("file_id", *[c.alias(k) for k, c in to.items()], "unit", sure.alias("sure"))
