"""The pN_ queries of the core: each runs its operator over the whole tables."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.clocks import utc_instants
from tickloom.operators.drift import canonical_names, schema_changes, stream_names, typed_columns, unified
from tickloom.operators.grid import regular_grid, spacing_of_readings
from tickloom.operators.intervals import periods_and_gaps, to_millis
from tickloom.operators.spikes import implausible
from tickloom.operators.units import header_times, photon_energies
from tickloom.sources.tables import finite, read_table, with_checkpoints


def _cells(t0: str, t1: str, step: str) -> F.Column:
    """Number of whole steps in a span."""
    return F.expr(f"cast(round(({t1} - {t0}) / {step}) as bigint)")


def _series_sources(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Series with their step: timedel, else the dt most of their readings carry, else the spacing of readings."""
    series = read_table(spark, sf_dir, "lc_series").dropDuplicates(["series_id"]).select(F.col("series_id").alias("key"), finite("timedel").alias("timedel"), "tstart", "tstop")
    carried = rows.where("dt > 0").groupBy("key", "dt").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("dt", F.struct("n", -F.col("dt"))).alias("dt"))
    known = series.join(carried, "key", "left").withColumn("step", F.coalesce(F.expr("case when timedel > 0 then timedel end"), "dt"))
    open_ones = known.where("step is null").select("key", "tstart", (F.col("tstop") - F.col("tstart")).alias("span"))
    spaced = spacing_of_readings(rows.select("key", "t").join(open_ones, "key"), "key", "t", "tstart", "span").withColumnRenamed("step", "spacing")
    return known.join(spaced, "key", "left").withColumn("step", F.coalesce("step", "spacing")).select("key", F.col("tstart").alias("t0"), "step", _cells("tstart", "tstop", "step").alias("n_cells"), F.lit(False).alias("counting"))


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series and observation on its grid; empty cells have a predicted value and filled = false."""
    rows = read_table(spark, sf_dir, "lightcurve").select(F.col("series_id").alias("key"), "reading_id", F.col("bin_time").alias("t"), F.col("counts").alias("value"), finite("dt").alias("dt"))
    photons = read_table(spark, sf_dir, "photon").select(F.col("obs_id").alias("key"), F.col("event_id").alias("reading_id"), F.col("event_time").alias("t"), F.lit(1.0).alias("value"))
    observed = read_table(spark, sf_dir, "observation").select(F.col("obs_id").alias("key"), F.col("tstart").alias("t0"), F.col("bin_dt").alias("step"), _cells("tstart", "tstop", "bin_dt").alias("n_cells"), F.lit(True).alias("counting"))
    grid = regular_grid(rows.drop("dt").unionByName(photons), _series_sources(spark, sf_dir, rows).unionByName(observed))
    return grid.select(F.col("key").alias("series_key"), "cell_no", F.round("value", 4).alias("cell_value"), "filled", "n_readings", "origin")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty cells of p1_grid: those that got a prediction, and those of sources without any reading."""
    return p1_grid(spark, sf_dir).where("origin = 'unknown' or (origin = 'predicted' and cell_value is not null)").select("series_key", "cell_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous good periods and gaps of every observation."""
    spans = read_table(spark, sf_dir, "observation").select(F.col("obs_id").alias("key"), to_millis("tstart").alias("span_start"), to_millis("tstop").alias("span_stop"))
    rows = read_table(spark, sf_dir, "gti").where("gti_stop > gti_start").select(F.col("obs_id").alias("key"), to_millis("gti_start").alias("start"), to_millis("gti_stop").alias("stop"))
    out = periods_and_gaps(rows, spans)
    return out.select(F.col("key").alias("obs_id"), "span_kind", F.col("start").alias("start_ms"), F.col("stop").alias("stop_ms"))


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged readings of every series, with the reason."""
    series = read_table(spark, sf_dir, "lc_series").dropDuplicates(["series_id"]).select(F.col("series_id").alias("key"), (F.lower("err_dist") == "poisson").alias("counting"))
    rows = read_table(spark, sf_dir, "lightcurve").select(F.col("series_id").alias("key"), "reading_id", F.col("bin_time").alias("t"), F.col("counts").alias("value"))
    return implausible(rows.join(series, "key", "left")).select(F.col("key").alias("series_id"), "reading_id", "reason")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of flagged readings."""
    return p2_flags(spark, sf_dir).select("reading_id")


def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC instant and status of every header time."""
    # Leap seconds (some dozens since 1972) and the names of the world's zones are small by nature.
    leaps = [(r[0], r[1]) for r in read_table(spark, sf_dir, "leap_second").limit(1000).collect()]
    rows = read_table(spark, sf_dir, "time_stamp").select("stamp_id", F.col("site_code").alias("source"), F.col("raw_stamp").alias("raw"), "mjdref", "timezero", F.col("timesys").alias("system"), F.col("site_zone").alias("zone"), F.col("arrived_at").alias("latest"))
    return utc_instants(rows, leaps, sorted(zoneinfo.available_timezones()))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stamp that denotes exactly one instant."""
    return p4_instants(spark, sf_dir).where("utc_ms is not null").select("stamp_id", "utc_ms")


def p6_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies of all photons in keV, with the unit found for their observation."""
    out = photon_energies(read_table(spark, sf_dir, "photon"), read_table(spark, sf_dir, "observation"))
    return out.withColumn("energy_kev", F.round("energy_kev", 6))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as maps of upper-case keywords to values as text (JSON text for nested ones)."""
    rows = read_table(spark, sf_dir, "file_header").select("file_id", "stream_id", "seq_no", F.from_json("header_json", "map<string,string>").alias("h")).dropDuplicates(["file_id"])
    rows = rows.withColumn("e", F.transform(F.map_entries("h"), lambda e: F.struct(F.upper(e["key"]).alias("k"), e["value"].alias("v"))))
    # Of keywords that differ in case only, the first counts.
    first = F.filter("e", lambda e, i: F.array_position(F.col("e.k"), e["k"]) == i + 1)
    return rows.withColumn("h", F.map_from_entries(first)).drop("e")


def _header_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda k: F.try_element_at("h", F.lit(k))
    rows = header_fields(spark, sf_dir).select("file_id", F.col("stream_id").alias("source"), h("TSTART").try_cast("double").alias("start"), h("TSTOP").try_cast("double").alias("stop"), h("TIMEUNIT").alias("time_unit"), h("COMMENT").alias("comment"), h("LIVETIME").try_cast("double").alias("livetime"))
    return header_times(rows)


def p6_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, stop and duration of all files in seconds, with the unit found."""
    return _header_times(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("start_s", "stop_s", "duration_s")})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photons not recorded in keV in eV, and durations of files not in seconds in milliseconds."""
    photons = photon_energies(read_table(spark, sf_dir, "photon"), read_table(spark, sf_dir, "observation"))
    a = photons.where("energy_kev is not null and (from_channel or unit != 'keV')").select(F.lit("photon").alias("rec_table"), F.col("event_id").alias("rec_id"), F.round(F.col("energy_kev") * 1000.0).cast("long").alias("common_value"))
    b = _header_times(spark, sf_dir).where("unit != 's' and duration_s is not null").select(F.lit("file_header").alias("rec_table"), F.col("file_id").alias("rec_id"), F.round(F.col("duration_s") * 1000.0).cast("long").alias("common_value"))
    return a.dropDuplicates(["rec_id"]).unionByName(b)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "file_header").select("file_id", F.col("stream_id").alias("stream"), F.col("seq_no").alias("seq"), "header_json")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of every file's keywords against the file before it."""
    return schema_changes(_files(spark, sf_dir)).select("file_id", "field_name", "change_kind")


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headers in one consistent table: a typed column for each keyword, renamed ones under one name."""
    files = _files(spark, sf_dir)
    changes = schema_changes(files)
    with_checkpoints(spark)  # the changes are read three times
    changes = changes.checkpoint()
    names = canonical_names(changes)
    out = unified(files, names, stream_names(changes, names))
    out = typed_columns(out.checkpoint())
    return out.withColumnsRenamed({"stream": "stream_id", "seq": "seq_no"}).withColumn("unparsed", F.to_json("unparsed"))
