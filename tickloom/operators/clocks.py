"""Timestamps of mixed forms, systems and zones onto one UTC instant."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.kernels import mixture_shares
from tickloom.operators.blocks import broadcast_if_small
from tickloom.sources.tables import with_checkpoints

#: Modified Julian date of 1970-01-01, and of a Julian date's zero.
UNIX_MJD, JD_MJD = 40587, 2400000.5
DAY_MS = 86_400_000
#: Terrestrial time less atomic time, in milliseconds.
TT_TAI_MS = 32184
#: Posterior from which one reading of an ambiguous form is taken.
SURE = 0.99
#: Likelihoods: of a date behind the stamp's arrival by more than a day; years after which an older date is half as rare;
#: of a two-digit year against the usual century (pivot 69); of a count in a fine unit that stays within 1970.
LATE, AGE_YEARS, CENTURY, FINE = 1e-3, 10.0, 1e-3, 1e-3
#: Level that stands for no likelihood at all.
NEVER = -10_000
#: Years that can be dates, and bare numbers that are years.
YEARS, BARE_YEAR = (1, 9999), (1000, 3000)

#: Minutes by which zone names stand east of Greenwich.
ZONE_MINUTES = {"Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600}
#: Names that stand for different offsets in different zones: {name: {zone: minutes}}.
SHARED_NAMES = {"IST": {"Asia/Kolkata": 330, "Asia/Jerusalem": 120, "Europe/Dublin": 60}, "CST": {"Asia/Shanghai": 480, "America/Havana": -300}, "BST": {"Asia/Dhaka": 360}}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Time systems: astronomic ones, and those of Unix counts.
ASTRONOMIC, UNIX = ("UTC", "TT", "TDB", "TAI"), ("UNIX", "POSIX")

#: Classes of texts with more than one valid parse, and the components of their mixtures.
FORMS = {"date": ["dmy 20", "mdy 20", "dmy 19", "mdy 19"], "count": ["s", "ms", "us", "ns"], "number": ["mjd", "jd", "year"]}

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?: ?(?P<half>[ap]m))?"
_TAG = r"(?: ?(?P<tag>[+-]\d{2}:?\d{2}|[A-Z]{1,5}))?"
_DATES = [
    r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})[-/.](?P<d>\d{1,2})",
    r"(?P<y>\d{4})[-:](?P<doy>\d{3})",
    r"(?P<a>\d{1,2})[-/.](?P<b>\d{1,2})[-/.](?P<yy>\d{4}|\d{2})",
    r"(?:[A-Z][a-z]{2}, )?(?P<d>\d{1,2})[- ](?P<mon>[A-Za-z]{3,9})[- ,]+(?P<y>\d{4})",
    r"(?P<mon>[A-Za-z]{3,9})[- ](?P<d>\d{1,2})[, ]+(?P<y>\d{4})",
]
_TEXTS = [re.compile(rf"{d}(?:[T:]| +){_CLOCK}{_TAG}", re.ASCII) for d in _DATES] + [re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?{_TAG}", re.ASCII)]
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?", re.ASCII)
_DATE_NUMBER = re.compile(r"(M?JD)[ =]*(\d+(?:\.\d+)?)", re.ASCII | re.IGNORECASE)


@dataclass
class _Shape:
    """How texts of one shape are read: which parts stand where. ``kind``: 'text', 'jd', 'mjd', 'number' or '' (none)."""

    kind: str
    parts: dict[str, tuple[int, int]]


def _shape_of(text: str) -> _Shape:
    # AM and PM aren't zone names; letters of a shape are those of the text, only digits are left open.
    low = re.sub(r"(?<=\d)( ?)([AaPp][Mm])(?= |$)", lambda m: m[1] + m[2].lower(), text)
    for form in _TEXTS:
        if m := form.fullmatch(low):
            return _Shape("text", {k: m.span(k) for k, v in m.groupdict().items() if v is not None})
    if m := _DATE_NUMBER.fullmatch(text):
        return _Shape(m[1].lower(), {"number": m.span(2)})
    return _Shape("number" if _NUMBER.fullmatch(text) else "", {})


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of dates, NaN where there is no such date."""
    ok = (y >= YEARS[0]) & (y <= YEARS[1]) & (m >= 1) & (m <= 12) & (d >= 1)
    first = (np.where(ok, y, 2000).astype(np.int64) - 1970).astype("M8[Y]").astype("M8[M]") + (np.where(ok, m, 1).astype(np.int64) - 1)
    day, end = first.astype("M8[D]"), (first + 1).astype("M8[D]")
    ok &= d <= (end - day).astype(np.int64)
    return np.where(ok, day.astype(np.int64) + d - 1.0, np.nan)


def _parsed(texts: np.ndarray, zones: np.ndarray) -> tuple[np.ndarray, ...]:
    """Wall clocks in milliseconds since 1970 as if they were UTC, by text: sole (of forms with one parse), the four of FORMS['date'],
    offset (minutes of the zone in the text, NaN where it isn't known), tagged, JD or MJD as MJD, number, leap (a second 60).

    Texts are grouped by shape, their digits left open; each shape is analysed once, and all texts of it are read as columns
    of characters.
    """
    n = len(texts)
    sole, offset, mjd, number = (np.full(n, np.nan) for _ in range(4))
    dates = np.full((n, 4), np.nan)
    tagged, leap = np.zeros(n, bool), np.zeros(n, bool)
    open_digits = str.maketrans("123456789", "000000000")
    of, shapes = pd.factorize(np.array([t.translate(open_digits) for t in texts], dtype=object))
    order = np.argsort(of, kind="stable")
    for shape, at in zip(shapes, np.split(order, np.searchsorted(of[order], np.arange(1, len(shapes))))):
        plan = _shape_of(str(texts[at[0]]))
        if plan.kind == "":
            continue
        if plan.kind != "text":
            a, z = plan.parts.get("number", (0, None))
            x = np.array([float(t[a:z]) for t in texts[at]])
            if plan.kind == "number":
                number[at] = x
            else:
                mjd[at] = x - JD_MJD if plan.kind == "jd" else x
            continue
        chars = texts[at].astype(f"U{len(shape)}").view("U1").reshape(len(at), len(shape))

        def digits(name: str, default: float = 0.0, plan=plan, chars=chars) -> np.ndarray:
            if name not in plan.parts:
                return np.full(len(chars), default)
            a, z = plan.parts[name]
            return (chars[:, a:z].view(np.uint32) - 48.0) @ 10.0 ** np.arange(z - a - 1, -1, -1)

        def words(name: str, plan=plan, at=at) -> list[str]:
            a, z = plan.parts[name]
            return [t[a:z] for t in texts[at]]

        h, mi, s = digits("h"), digits("mi"), digits("s")
        if "half" in plan.parts:
            late = np.array([w[0] in "pP" for w in words("half")])
            h = np.where((h >= 1) & (h <= 12), h % 12 + 12 * late, np.nan)
        fraction = digits("f") * 10.0 ** -(plan.parts["f"][1] - plan.parts["f"][0]) if "f" in plan.parts else 0.0
        sixty = (s == 60) & (h >= 0)
        ok = (h <= 23) & (mi <= 59) & (s <= 60)
        ms = np.where(ok, (h * 3600 + mi * 60 + s + fraction) * 1000.0, np.nan)
        if "tag" in plan.parts:
            tagged[at] = True
            offset[at] = [_offset(w, z) for w, z in zip(words("tag"), zones[at])]
        if "a" in plan.parts:
            a, b, y = digits("a"), digits("b"), digits("yy")
            if plan.parts["yy"][1] - plan.parts["yy"][0] == 4:
                dates[at, 0], dates[at, 1] = _days(y, b, a) * DAY_MS + ms, _days(y, a, b) * DAY_MS + ms
            else:
                for k, century in ((0, 2000), (2, 1900)):
                    dates[at, k], dates[at, k + 1] = _days(y + century, b, a) * DAY_MS + ms, _days(y + century, a, b) * DAY_MS + ms
        else:
            y = digits("y")
            if "doy" in plan.parts:
                doy = digits("doy")
                day = np.where((doy >= 1) & (_days(y, np.full(len(y), 1), np.full(len(y), 1)) + doy - 1 <= _days(y, np.full(len(y), 12), np.full(len(y), 31))), _days(y, np.full(len(y), 1), np.full(len(y), 1)) + doy - 1, np.nan)
            else:
                months = np.array([MONTHS.index(w[:3].lower()) + 1 if w[:3].lower() in MONTHS else 0 for w in words("mon")], float) if "mon" in plan.parts else digits("m")
                day = _days(y, months, digits("d"))
            sole[at] = day * DAY_MS + ms
        leap[at] = sixty & ~np.isnan(ms)
    return sole, dates, offset, tagged, mjd, number, leap


def _offset(tag: str, zone: str | None) -> float:
    """Minutes east of Greenwich of a zone in a text; NaN if unknown."""
    if tag[0] in "+-":
        minutes = int(tag[1:3]) * 60 + int(tag[-2:])
        return (-1 if tag[0] == "-" else 1) * minutes if minutes <= 1080 and int(tag[-2:]) < 60 else np.nan
    return SHARED_NAMES.get(tag, {}).get(zone or "", ZONE_MINUTES.get(tag, np.nan))


def _local(wall: np.ndarray, zones: np.ndarray, known: frozenset[str]) -> np.ndarray:
    """Instants of wall clocks in their zones; NaN where a zone is unknown or has that time never or twice."""
    out = np.full(len(wall), np.nan)
    for zone in set(zones[~np.isnan(wall)]) & known:
        at = np.flatnonzero((zones == zone) & ~np.isnan(wall))
        seconds = np.floor(wall[at] / 1000)
        there = pd.Series(seconds.astype("int64").astype("M8[s]")).dt.tz_localize(zone, ambiguous="NaT", nonexistent="NaT").dt.tz_convert("UTC")
        instant = there.to_numpy("M8[s]")
        out[at] = np.where(np.isnat(instant), np.nan, instant.astype(np.int64) * 1000.0 + wall[at] - seconds * 1000.0)
    return out


def _to_utc(moment: np.ndarray, system: np.ndarray, leaps: list[tuple[int, int]]) -> np.ndarray:
    """UTC milliseconds of moments given in a time system; NaN before the first leap second of the table for other systems than UTC."""
    tai = np.where(np.isin(system, ("TT", "TDB")), moment - TT_TAI_MS, moment)
    days, seconds = np.array(sorted(leaps), float).reshape(-1, 2).T if leaps else (np.zeros(0), np.zeros(0))
    k = np.searchsorted((days - UNIX_MJD) * DAY_MS + seconds * 1000, tai, side="right") - 1
    offset = np.where(k >= 0, seconds[np.maximum(k, 0)] if len(seconds) else np.nan, np.nan)
    return np.where(system == "UTC", moment, tai - offset * 1000)


def _likelihood(ms: np.ndarray, latest: np.ndarray) -> np.ndarray:
    """Chance of dates before the day after the stamp's arrival, falling with their age; 0 where there is no date."""
    age = np.where(np.isnan(latest)[:, None], 0.0, np.maximum(latest[:, None] - ms, 0.0)) / (365.25 * DAY_MS)
    late = ms > (latest + DAY_MS)[:, None]
    return np.where(np.isnan(ms), 0.0, np.where(late, LATE, 1.0) * (1 + age / AGE_YEARS) ** -3.0)


CANDIDATES = "stamp_id bigint, source string, form string, " + ", ".join(f"u{k} double, w{k} double" for k in range(4)) + ", is_date boolean"


def _candidates(df: pd.DataFrame, leaps: list[tuple[int, int]], zones: frozenset[str]) -> pd.DataFrame:
    """All valid parses of stamps: form (the class of its mixture, or null), instants and likelihoods by component."""
    n = len(df)
    raw = df["raw"].fillna("").to_numpy(object)
    zone = df["zone"].to_numpy(object)
    system = df["system"].fillna("").to_numpy(object)
    ref, zero, latest = (df[c].to_numpy(float) for c in ("mjdref", "timezero", "latest"))
    sole, dates, offset, tagged, date_number, number, leap = _parsed(raw, zone)
    elapsed, astronomic, unix = ~np.isnan(ref), np.isin(system, ASTRONOMIC), np.isin(system, UNIX)
    local = (system == "LOCAL") & ~tagged & ~elapsed
    # A second 60 is only where the table has a leap second at the end of that day.
    ends = {float(d) for d, _ in leaps}
    wrong = leap & ~(np.isin(np.floor(np.nan_to_num(sole - 1) / DAY_MS) + UNIX_MJD + 1, [*ends]) & (np.nan_to_num(sole) % DAY_MS < 1000) & ~tagged & (system == "UTC"))
    sole = np.where(wrong, np.nan, sole)
    dates[leap] = np.nan

    def instants(wall: np.ndarray) -> np.ndarray:
        """Of wall clocks by what their text or system says."""
        own = _to_utc(wall, np.where(astronomic, system, "UTC"), leaps)
        own = np.where(tagged, wall - offset * 60_000.0, np.where(astronomic, own, np.nan))
        return np.where(elapsed, np.nan, np.where(local, _local(np.where(local, wall, np.nan), zone, zones), own))

    one = instants(sole)
    by_ref = (ref - UNIX_MJD) * DAY_MS + (np.nan_to_num(zero) + number) * 1000.0
    one = np.where(elapsed, np.where(astronomic, _to_utc(by_ref, system, leaps), np.nan), one)
    day = np.where(~elapsed & astronomic, _to_utc((date_number - UNIX_MJD) * DAY_MS, system, leaps), np.nan)
    low, high = (_days(np.array([y + 0.0]), np.array([m]), np.array([d]))[0] + UNIX_MJD for y, m, d in ((YEARS[0], 1, 1), (YEARS[1], 12, 31)))
    one = np.where(np.isnan(one), np.where((date_number >= low) & (date_number <= high), day, np.nan), one)

    form = np.full(n, None, dtype=object)
    utc, weight = np.full((n, 4), np.nan), np.zeros((n, 4))
    is_date = ~np.isnan(dates).all(axis=1) & ~elapsed & (tagged | local | astronomic)
    form[is_date] = "date"
    weight[is_date] = (_likelihood(dates, latest) * [1, 1, CENTURY, CENTURY])[is_date]
    # Years from the pivot on are those of the last century by convention.
    two = ~np.isnan(dates[:, 2:]).all(axis=1)
    old = is_date & two & (np.nanmax(np.where(np.isnan(dates[:, 2:]), -np.inf, dates[:, 2:]), axis=1) >= _days(np.array([1969.0]), np.array([1]), np.array([1]))[0] * DAY_MS)
    weight[old] = weight[old] * [CENTURY, CENTURY, 1 / CENTURY, 1 / CENTURY]
    for k in range(4):
        utc[:, k] = np.where(is_date, instants(dates[:, k]), utc[:, k])
    count = unix & ~elapsed & ~np.isnan(number)
    form[count] = "count"
    by_scale = number[:, None] * [1000.0, 1.0, 1e-3, 1e-6]
    by_scale = np.where((by_scale >= (low - UNIX_MJD) * DAY_MS) & (by_scale <= (high - UNIX_MJD) * DAY_MS), by_scale, np.nan)
    fine = np.abs(by_scale) < 365 * DAY_MS
    fine[:, 0] = False
    weight[count] = (_likelihood(by_scale, latest) * np.where(fine, FINE, 1.0))[count]
    utc[count] = by_scale[count]
    plain = astronomic & ~elapsed & ~np.isnan(number)
    form[plain] = "number"
    days = np.stack([number, number - JD_MJD], axis=1)
    days = np.where((days >= low) & (days <= high), days, np.nan)
    as_utc = np.stack([_to_utc((days[:, k] - UNIX_MJD) * DAY_MS, system, leaps) for k in (0, 1)], axis=1)
    bare = (number >= BARE_YEAR[0]) & (number <= BARE_YEAR[1]) & (number == np.floor(number))
    chance = np.concatenate([_likelihood(as_utc, latest), np.where(bare, 1.0, 0.0)[:, None], np.zeros((n, 1))], axis=1)
    chance[bare, :2] *= LATE
    weight[plain] = chance[plain]
    utc[plain, :2] = as_utc[plain]
    mixed = np.array([f is not None for f in form], bool)
    utc[~mixed, 0] = one[~mixed]
    by_component = {f"{name}{k}": x[:, k] for k in range(4) for name, x in (("u", utc), ("w", weight))}
    return pd.DataFrame({"stamp_id": df["stamp_id"], "source": df["source"], "form": form, **by_component, "is_date": ~np.isnan(sole) | is_date})


def form_shares(parsed: DataFrame) -> DataFrame:
    """Mixture of forms of every source and class: source, form, shares (by component), fitted by expectation-maximisation.

    ``parsed``: source, form, weight.  Stamps are first counted by equal evidence (their likelihoods to half a decade), so that
    a source is a handful of rows however many stamps it wrote; the shares are those that the rounds converge to.
    """
    level = F.transform("weight", lambda w: F.when(w > 0, F.round(F.log10(w) * 2).cast("int")).otherwise(NEVER))
    counted = parsed.where("form is not null").groupBy("source", "form", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    evidence = counted.groupBy("source", "form").agg(F.collect_list(F.struct("level", "n")).alias("rows"))

    @F.pandas_udf("array<double>")
    def fit(rows: pd.Series, forms: pd.Series) -> pd.Series:
        out = []
        for own, form in zip(rows, forms):
            k = len(FORMS[form])
            w = 10.0 ** (np.array([list(r["level"]) for r in own], float) / 2)[:, :k]
            shares = mixture_shares(w, np.array([r["n"] for r in own]))
            out.append([*shares.tolist(), *[0.0] * (4 - k)])
        return pd.Series(out, dtype=object)

    return evidence.select("source", "form", fit("rows", "form").alias("shares"))


def utc_instants(stamps: DataFrame, leaps: list[tuple[int, int]], zones: list[str]) -> DataFrame:
    """One UTC instant for every stamp that denotes exactly one.

    ``stamps``: stamp_id, source, raw, mjdref, timezero, system, zone, latest (timestamp after which it can't lie, or
    null).  ``leaps``: (MJD from which valid, TAI - UTC in seconds); ``zones``: the zone names that exist.

    Every text is parsed in all forms it may have.  Where more than one is valid (day and month, the century of two digits,
    the unit of a Unix count, a Julian or modified Julian date or a bare year), a mixture of the forms of each source, fitted
    by expectation-maximisation to convergence, weighs the parses: each stamp adds its likelihood under every valid parse (a
    date can't lie behind the stamp's arrival and is rarer the older it is), the posterior chooses, and below SURE the
    stamp stays marked as ambiguous.  Parses that give the same instant count together.

    Output: stamp_id, utc_ms (null if no single instant), status: 'ok', 'ambiguous' (more than one instant is left, or a
    local time that its zone has twice, never, or no zone), 'unusable' (null, empty, incomplete, impossible or other text,
    unknown system).  A second 60 is the next day's first where ``leaps`` has one, else impossible.  Null ids are kept; a
    repeated id counts once; NaN and infinite mjdref or timezero are as null.
    """
    with_checkpoints(stamps.sparkSession)
    system = F.upper(F.trim("system"))
    latest = F.unix_micros(F.col("latest").cast("timestamp")) / 1000.0
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c).cast("double")).alias(c)
    rows = stamps.select("stamp_id", F.coalesce("source", F.lit("")).alias("source"), F.trim("raw").alias("raw"), number("mjdref"), number("timezero"), F.when(system == "GMT", "UTC").otherwise(system).alias("system"), "zone", latest.alias("latest")).dropDuplicates(["stamp_id"])
    known = frozenset(zones)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _candidates(part, leaps, known)

    parsed = rows.mapInPandas(run, CANDIDATES)
    instant = lambda k: F.when(~F.isnan(k), F.round(k).cast("long"))
    parsed = parsed.select("stamp_id", "source", "form", "is_date", F.array(*[instant(f"u{k}") for k in range(4)]).alias("utc"), F.array(*[f"w{k}" for k in range(4)]).alias("weight"))
    parsed = parsed.checkpoint()  # read by the mixtures and by the choice
    shares = form_shares(parsed).checkpoint()
    rows = parsed.join(broadcast_if_small(shares), ["source", "form"], "left")
    own = F.zip_with("weight", "shares", lambda w, s: w * s)
    rows = rows.withColumn("own", own)
    top = F.get("utc", (F.array_position("own", F.array_max("own")) - 1).cast("int"))
    like_top = F.aggregate(F.filter(F.arrays_zip("utc", "own"), lambda p: p["utc"].eqNullSafe(top)), F.lit(0.0), lambda a, p: a + p["own"])
    posterior = like_top / F.aggregate("own", F.lit(0.0), lambda a, w: a + w)
    utc = F.when(F.col("form").isNull(), F.get("utc", F.lit(0))).when(posterior >= SURE, top)
    maybe = F.col("is_date") | F.exists("utc", lambda u: u.isNotNull())
    return rows.select("stamp_id", utc.alias("utc_ms"), F.when(utc.isNotNull(), "ok").when(maybe, "ambiguous").otherwise("unusable").alias("status"))
