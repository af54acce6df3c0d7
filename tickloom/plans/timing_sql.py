"""Independent SQL (DuckDB) for the timing queries."""

from __future__ import annotations

import math

from tickloom.plans import timing as t

EV = """ev as (select event_id, (epoch_us(ts) - 1704067200000000) / 1e6 as t, value as energy,
  cast(json_extract(props, '$.k') as int) as pi, event_type as instr, user_id % 4 as detector_id, user_id from events)"""
GRID = "hours as (select unnest(range(720)) as bin)"
HOURLY = f"{GRID}, hourly as (select bin, coalesce(n, 0) as counts from hours left join (select cast(floor(t / 3600) as bigint) bin, count(*) n from ev group by 1) using (bin))"
PHASE = "(({x}) - floor({x}))"


def _with(body: str, *parts: str) -> str:
    return "with " + ", ".join([EV, *parts]) + " " + body


def _list(xs) -> str:
    return "[" + ", ".join(repr(float(x)) + "::double" for x in xs) + "]"


def _islands(table: str, cond: str, dt: float = 3600.0, name: str = "g", extra: str = "") -> str:
    """Runs of bins where a condition holds, as table ``name``."""
    return f"""{name}_m as (select bin, bin - row_number() over (order by bin) as isl from {table} where {cond}),
    {name} as (select min(bin) * {dt} as start, (max(bin) + 1) * {dt} as stop from {name}_m group by isl)"""


def _instr_hourly(instr: str, name: str) -> str:
    return f"{name}h as (select bin, coalesce(n, 0) as counts from hours left join (select cast(floor(t / 3600) as bigint) bin, count(*) n from ev where instr = '{instr}' group by 1) using (bin))"


def _dft(where: str = "true", keys: str = "", name: str = "dft") -> str:
    k = keys + ", " if keys else ""
    return f"""{name}_b as (select {k} cast(floor(t / 86400) as bigint) as seg, cast(floor((t - floor(t / 86400) * 86400) / 3600) as bigint) as bin, count(*) as n from ev where {where} group by all),
    {name} as (select {k} seg, k, sum(n * cos(2 * pi() * k * bin / 24)) as re, -sum(n * sin(2 * pi() * k * bin / 24)) as im, sum(n) as n_ph
      from {name}_b, (select unnest(range(1, 12)) as k) group by all)"""


#: Full segments of a day inside the good time.
GTI_SEGMENTS = _islands("hourly", "counts > 0") + ", gs as (select start + i * 86400.0 as start from (select start, unnest(range(cast(floor((stop - start) / 86400) as bigint))) as i from g))"


def _gti_dft(name: str, where: str = "true") -> str:
    """Transforms of the segments in gs."""
    return f"""{name}_b as (select start, cast(floor((t - start) / 3600) as bigint) as bin, count(*) as n from ev join gs on t >= start and t < start + 86400 where {where} group by all),
    {name} as (select start, k, sum(n * cos(2 * pi() * k * bin / 24)) as re, -sum(n * sin(2 * pi() * k * bin / 24)) as im, sum(n) as n_ph from {name}_b, (select unnest(range(1, 12)) as k) group by all)"""


LEAHY = "2 * (re * re + im * im) / n_ph"


def _pds(expr: str, digits: int = 6) -> str:
    return _with(f"""select k, round(k / 86400.0, 12) as freq, round(p, {digits}) as power, round(p / sqrt(m), {digits}) as power_err, m
      from (select k, avg({expr}) as p, count(*) as m from dft group by k)""", _dft())


CROSS = f"""{_dft("instr = 'click'", "", "x")}, {_dft("instr = 'view'", "", "y")},
  cr as (select k, avg(2 * (x.re * y.re + x.im * y.im) / sqrt(x.n_ph * y.n_ph)) as re, avg(2 * (x.im * y.re - x.re * y.im) / sqrt(x.n_ph * y.n_ph)) as im,
    avg(2 * (x.re * x.re + x.im * x.im) / x.n_ph) as p1, avg(2 * (y.re * y.re + y.im * y.im) / y.n_ph) as p2, count(*) as m from x join y using (seg, k) group by k)"""

BY_ENERGY = """be as (select *, case when energy >= 0 and energy < 5 then 0 when energy >= 5 and energy < 10 then 1 when energy >= 10 and energy < 20 then 2 when energy >= 20 and energy < 1000 then 3 end as band from ev),
  cells as (select band, cast(floor(t / 86400) as bigint) seg, cast(floor((t - floor(t / 86400) * 86400) / 3600) as bigint) bin, count(*) n from be where band is not null group by all),
  own as (select band, seg, k, sum(n * cos(2 * pi() * k * bin / 24)) re, -sum(n * sin(2 * pi() * k * bin / 24)) im, sum(n) n_ph from cells, (select unnest(range(1, 12)) as k) group by all),
  tot as (select seg, k, sum(re) re, sum(im) im, sum(n_ph) n_ph from own group by all),
  xx as (select o.band, o.k, o.re, o.im, o.n_ph, t.re - o.re rr, t.im - o.im ri, t.n_ph - o.n_ph rn from own o join tot t using (seg, k)),
  ve as (select band, avg((2 * (re * re + im * im) - 2 * n_ph) * 86400.0 / (n_ph * n_ph)) p, avg(2 / 86400.0 * (re * rr + im * ri)) c, avg(2 / 86400.0 * (im * rr - re * ri)) q,
    avg((2 * (rr * rr + ri * ri) - 2 * rn) / 86400.0) pr, avg(k) kk, max(k) nk from xx group by band)"""


def _trial(freqs, fdots=(0.0,), where: str = "true", key: str = "") -> str:
    k = key + ", " if key else ""
    x = "f * t + d * t * t / 2.0"
    return f"""fr as (select unnest(range({len(freqs)})) as i, unnest({_list(freqs)}) as f), fd as (select unnest(range({len(fdots)})) as j, unnest({_list(fdots)}) as d),
    pr as (select {k} i, j, cast(least(floor({PHASE.format(x=x)} * 16), 15) as bigint) as phbin, count(*) as counts from ev, fr, fd where {where} group by all)"""


def _z2(table: str, keys: str, n: int, nbin: int = 16) -> str:
    terms = " + ".join(f"pow(sum(counts * cos({h} * (phbin + 0.5) * 2 * pi() / {nbin})), 2) + pow(sum(counts * sin({h} * (phbin + 0.5) * 2 * pi() / {nbin})), 2)" for h in range(1, n + 1))
    return f"select {keys}, round(2 / sum(counts) * ({terms}), 6) as stat from {table} group by {keys}"


PREFOLD = f"""pre as (select cast(least(floor(t / (2592000.0 / 32)), 31) as bigint) as prof, cast(least(floor({PHASE.format(x=f"{t.F0!r}::double * (t - 1296000.0)")} * 16), 15) as bigint) as phbin, count(*) as counts from ev where t >= 0 and t < 2592000 group by all)"""
PHG = f"""phg as (select cast(least(floor({PHASE.format(x=f"{t.F0!r}::double * t")} * 8), 7) as bigint) as phbin, cast(floor(t / 259200.0) as bigint) as tbin, count(*) as counts from ev where t >= 0 and t < 2592000 group by all)"""
PRIOR = "prior as (select *, coalesce(least(t - lag(t) over (partition by instr order by t, event_id), 1800.0), 1800.0) as prior from ev)"
LIVE = """live as (select instr, bin, sum(greatest(least(t, (bin + 1) * 3600.0) - greatest(t - prior, bin * 3600.0), 0)) as expo from
  (select *, unnest(range(cast(floor((t - prior) / 3600) as bigint), cast(floor(t / 3600) as bigint) + 1)) as bin from prior where prior > 0) where bin between 0 and 719 group by all)"""
#: Median of chi squared with 15 degrees of freedom, and the level of a mean of 30 powers at a chance of 0.01 over 11 trials.
LEVEL, POWER_LEVEL = 14.339, 3.333922
DELAY = lambda x: f"(12.5 * sin(2 * pi() * ({x} - 1000.0) / (3.7 * 86400)))"
ORBIT = """orb as (select x, p, p * k / 6.0 as z from (select unnest([500.0::double, 2000.0]) x), (select unnest([172800.0::double, 259200.0]) p), (select unnest(range(6)) k)),
  em as (select x, p, z, t - x * sin(2 * pi() * ((t - x * sin(2 * pi() * (t - z) / p)) - z) / p) as e from ev, orb)"""

SQL: dict[str, str] = {
    "lightcurve_hourly": _with("select bin, bin * 3600.0::double + 1800 as time, counts, round(sqrt(counts), 6) as counts_err from hourly", HOURLY),
    "lightcurve_energy_band": _with("select bin, bin * 3600.0::double + 1800 as time, coalesce(n, 0) as counts from hours left join (select cast(floor(t / 3600) as bigint) bin, count(*) n from ev where energy > 5 and energy <= 20 group by 1) using (bin)", GRID),
    "lightcurve_weighted": _with("select bin, bin * 3600.0::double + 1800 as time, round(coalesce(w, 0), 5) as counts, round(coalesce(n * s, 0), 5) as counts_err from hours left join (select cast(floor(t / 3600) as bigint) bin, count(*) n, sum(energy) w, stddev_pop(energy) s from ev group by 1) using (bin)", GRID),
    "filter_energy_closed": _with("select event_id, energy from ev where energy between 3 and 30"),
    "filter_pi": _with("select event_id, pi from ev where pi > 20 and pi <= 60"),
    "rough_calibration": """select event_id, round(case lower(trim(mission)) when 'nustar' then 0.04 * pi + 1.6 when 'xmm' then 0.001 * pi when 'nicer' then 0.01 * pi when 'ixpe' then pi * 0.04 end, 6) as energy_kev
      from (select distinct on (event_id) event_id, obs_id, pi from photon) join observation using (obs_id) where pi is not null and lower(trim(mission)) in ('nustar', 'xmm', 'nicer', 'ixpe')""",
    "calibrate_lookup": _with("select event_id, round(case when pi < 90 then pi * 0.04 + 1.6 else 0 end, 6) as energy from ev"),
    "gti_from_condition": _with("select start, stop from g", HOURLY, _islands("hourly", "counts > 12")),
    "gti_intersect": _with("select greatest(a.start, b.start) as start, least(a.stop, b.stop) as stop from a join b on a.start < b.stop and b.start < a.stop", GRID, _instr_hourly("click", "a"), _islands("ah", "counts > 1", name="a"), _instr_hourly("view", "b"), _islands("bh", "counts > 1", name="b")),
    "gti_complement": _with("select stop as start, nxt as stop from (select stop, lead(start) over (order by start) as nxt from g) where nxt is not null", HOURLY, _islands("hourly", "counts > 12")),
    "gti_safe_minlen": _with("select start + 600 as start, stop - 300 as stop from g where stop - start - 900 >= 7200", HOURLY, _islands("hourly", "counts > 10")),
    "gti_total_exposure": _with("select sum(stop - start) as exposure, count(*) as n_gti from g", HOURLY, _islands("hourly", "counts > 12")),
    "apply_gti": _with("select event_id, t from ev where exists (select 1 from g where t >= start and t < stop)", HOURLY, _islands("hourly", "counts > 12")),
    "photons_in_gti": """with p as (select distinct on (event_id) event_id, obs_id, round(event_time * 1000) as ms from photon where event_time is not null and not isnan(event_time)),
      o as (select obs_id, round(tstart * 1000) lo, round(tstop * 1000) hi from observation),
      g as (select obs_id, round(gti_start * 1000) s, round(gti_stop * 1000) e from gti where gti_stop > gti_start and not isnan(gti_start) and not isnan(gti_stop))
      select obs_id, count(*) as n_photons from p join o using (obs_id) where ms >= lo and ms < hi and exists (select 1 from g where g.obs_id = p.obs_id and ms >= s and ms < e) group by 1""",
    "occultation_gti": _with("select start, stop from g", "two as (select bin, coalesce(n, 0) as counts from (select unnest(range(360)) as bin) left join (select cast(floor(t / 7200) as bigint) bin, count(*) n from ev group by 1) using (bin)), med as (select median(counts) as m from two), tm as (select * from two, med)", _islands("tm", "counts > 0 or m <= 5", 7200.0)),
    "split_overlap_chunks": _with("select chunk, count(*) as n, round(min(t), 6) as first_t, round(max(t), 6) as last_t from ev, (select unnest(range(12)) as chunk) where t >= chunk * 216000 and t < chunk * 216000 + 432000 group by 1"),
    "split_detector_chunks": _with("select detector_id, cast(floor(t / 86400) as bigint) as chunk, count(*) as n from ev group by all"),
    "split_at_mjd": _with("select case when t < 1339200 then 1 else 2 end as part, count(*) as n, round(max(t), 6) as last_t from ev group by 1"),
    "join_events_union": _with("select event_id, round(t, 6) as t, energy, null::int as pi from ev where instr = 'click' union all select event_id, round(t + 86400, 6), null, pi from ev where instr = 'view'"),
    "concatenate_sorted": _with("select event_id, round(t, 6) as t from ev"),
    "scrunch_lightcurves": _with("select bin, sum(n)::bigint as counts from (select instr, cast(floor(t / 3600) as bigint) bin, count(*) n from ev group by all) group by bin having count(*) = (select count(distinct instr) from ev)"),
    "join_lightcurves_instr": _with("select instr, cast(floor(t / 21600) as bigint) as bin, count(*) as counts from ev group by all"),
    "livetime_per_bin": _with("select bin, round(sum(expo), 6) as expo from live group by 1", PRIOR, LIVE),
    "exposure_corrected_lc": _with("select instr, bin, round(case when coalesce(expo, 0) < 60 then 0 else coalesce(n, 0) / expo * 3600 end, 6) as counts from (select * from (select distinct instr from ev), hours) left join (select instr, cast(floor(t / 3600) as bigint) bin, count(*) n from ev group by all) using (instr, bin) left join live using (instr, bin)", PRIOR, LIVE, GRID),
    "deadtime_paralyzable": _with("select event_id from (select event_id, t - lag(t) over (partition by instr order by t, event_id) as gap from ev) where gap is null or gap >= 300"),
    "deadtime_nonparalyzable": "with recursive " + EV + """, nx as materialized (select distinct instr, t, min(t) over (partition by instr order by t range between 300 following and unbounded following) as nt from ev),
      kept(instr, t) as (select instr, min(t) from ev group by 1 union all select instr, nx.nt from kept join nx using (instr, t) where nx.nt is not null)
      select arg_min(event_id, event_id) as event_id from ev join (select distinct instr, t from kept) using (instr, t) group by instr, t""",
    "color_evolution": _with("select seg, n1, n2, round(n2 / nullif(n1, 0), 6) as ratio, round(case when n1 > 0 and n2 > 0 then n2 / n1 * sqrt(1 / n1 + 1 / n2) end, 6) as ratio_err from (select cast(floor(t / 86400) as bigint) seg, count(case when energy between 0 and 10 then 1 end) n1, count(case when energy between 10.5 and 80 then 1 end) n2 from ev group by 1)"),
    "hardness_intensity": _with("select seg, round(n2 / nullif(n1, 0), 9) as ratio, round((n1 + n2) / 86400, 9) as rate from (select cast(floor(t / 86400) as bigint) seg, count(case when energy between 0 and 10 then 1 end) n1, count(case when energy between 10.5 and 80 then 1 end) n2 from ev group by 1)"),
    "excess_variance": _with("select seg, round(v - e, 6) as excvar, round((v - e) / (m * m), 6) as norm_excvar, round(case when v >= e then sqrt((v - e) / (m * m)) end, 6) as fvar from (select seg, count(*) n, avg(counts) m, var_samp(counts) v, avg(counts) e from hourly, (select unnest(range(60)) as seg) where bin >= seg * 12 and bin < seg * 12 + 24 group by seg) where n = 24", HOURLY),
    "rebin_lightcurve": _with("select bin // 7 as bin, sum(counts)::bigint as counts from hourly group by 1 having count(*) = 7", HOURLY),
    "histogram_2d": _with("select cast(floor(t / 259200) as bigint) as b0, cast(floor(energy / 6.25) as bigint) as b1, count(*) as counts from ev where t >= 0 and t < 2592000 and energy >= 0 and energy < 50 group by all"),
    "histogram_3d_weighted": _with("select cast(floor(t / 432000) as bigint) as b0, cast(floor(energy / 10) as bigint) as b1, cast(floor(pi / 25) as bigint) as b2, round(sum(energy), 4) as counts from ev where t >= 0 and t < 2592000 and energy >= 0 and energy < 50 and pi between 0 and 99 group by all"),
    "rate_inversion": _with("select instr, round(r, 12) as detected, round(1 / (1 / r - 30), 12) as incident, round(r, 12) as again from (select instr, count(*) / 2592000 as r from ev group by 1)"),
    "pds_leahy": _pds(LEAHY),
    "pds_fft_arrow": _pds(LEAHY),
    "pds_frac": _pds("2 * (re * re + im * im) * 86400.0 / (n_ph * n_ph)", 3),
    "pds_abs": _pds("2 * (re * re + im * im) / 86400.0", 9),
    "pds_gti": _with("select k, round(k / 86400.0, 12) as freq, round(avg(2 * (re * re + im * im) / n_ph), 6) as power, count(*) as m from gf group by k", HOURLY, GTI_SEGMENTS, _gti_dft("gf")),
    "cospectrum_gti": _with("select x.k, round(avg(2 * (x.re * y.re + x.im * y.im) / sqrt(x.n_ph * y.n_ph)), 6) as cospectrum, round(avg(2 * (x.im * y.re - x.re * y.im) / sqrt(x.n_ph * y.n_ph)), 6) as quadrature, count(*) as m from x join y using (start, k) group by x.k", HOURLY, GTI_SEGMENTS, _gti_dft("x", "instr = 'click'"), _gti_dft("y", "instr = 'view'")),
    "pds_dynamic": _with(f"select seg, k, round({LEAHY}, 6) as power from dft", _dft()),
    "pds_rebin_linear": _with(f"select (k - 1) // 3 as j, round(avg(k / 86400.0), 12) as freq, round(avg(p), 6) as power, round(sqrt(sum(p * p / m)) / 3, 6) as power_err, sum(m)::bigint as m from (select k, avg({LEAHY}) p, count(*) m from dft group by k) group by 1 having count(*) = 3", _dft()),
    "pds_rebin_geom": _with(f"select cast(floor(ln(k) / ln(1.5) + 1e-9) as bigint) as j, round(avg(k / 86400.0), 12) as freq, round(avg(p), 6) as power, sum(m)::bigint as m from (select k, avg({LEAHY}) p, count(*) m from dft group by k) group by 1", _dft()),
    "pds_average_files": _with(f"select k, round(sum(p * m) / sum(m), 6) as power, round(sqrt(sum(p * p / m * m)) / sum(m), 6) as power_err, sum(m)::bigint as m from (select instr, k, avg({LEAHY}) p, count(*) m from dft group by all) group by k", _dft(keys="instr")),
    "xspec_export": _with(f"select round(k / 86400.0 - 0.5 / 86400, 10) as f_lo, round(k / 86400.0 + 0.5 / 86400, 10) as f_hi, round(p / 86400, 10) as flux, round(p / sqrt(m) / 86400, 10) as flux_err from (select k, avg({LEAHY}) p, count(*) m from dft group by k)", _dft()),
    "cospectrum": _with("select k, round(re, 6) as cospectrum, round(im, 6) as quadrature, m from cr", CROSS),
    "coherence": _with("select k, round((re * re + im * im) / (p1 * p2), 7) as coherence from cr", CROSS),
    "time_lags": _with("select k, round(atan2(im, re) / (2 * pi() * k / 86400.0), 2) as lag, round(sqrt((1 - g) / (2 * g * m)) / (2 * pi() * k / 86400.0), 2) as lag_err from (select *, least((re * re + im * im) / (p1 * p2), 1) as g from cr)", CROSS),
    "lomb_scargle": _with("""select i, round((yc * yc / cc + ys * ys / ss) / (2 * v), 5) as power from (select i, sum(y * cos(a)) yc, sum(y * sin(a)) ys, sum(cos(a) * cos(a)) cc, sum(sin(a) * sin(a)) ss, max(v) v from
      (select i, y, v, 2 * pi() * f * (t - tau) as a from yy join (select i, f, atan2(sum(sin(4 * pi() * f * t)), sum(cos(4 * pi() * f * t))) / (4 * pi() * f) as tau from yy, fs group by i, f) on true) group by i)""",
        "yy as (select t, energy - avg(energy) over () as y, var_samp(energy) over () as v from ev), fs as (select i, i / 345600.0 as f from (select unnest(range(1, 31)) as i))"),
    "power_colors": _with(f"""select grp, round(c / a, 6) as pc1, round(b / d, 6) as pc2, round(ang - floor(ang / (2 * pi())) * 2 * pi(), 6) as hue from (select *, 3 * pi() / 4 - atan2(log10(b / d) - log10(0.453724), log10(c / a) - log10(4.51920)) as ang from
      (select seg // 5 as grp, sum(case when k between 1 and 3 then v end) a, sum(case when k between 4 and 6 then v end) b, sum(case when k between 7 and 9 then v end) c, sum(case when k between 10 and 11 then v end) d from (select seg, k, {LEAHY} / 86400 as v from dft) group by 1) where c / a > 0 and b / d > 0)""", _dft()),
    "rms_energy": _with("select band, round(case when p > 0 then sqrt(p * nk / 86400.0) else 0 end, 6) as rms from ve", BY_ENERGY),
    "count_energy": _with("select band, count(*) as counts from be where band is not null group by 1", BY_ENERGY),
    "lag_energy": _with("select band, round(atan2(q, c) / (2 * pi() * kk / 86400.0), 2) as lag from ve", BY_ENERGY),
    "cov_energy": _with("select band, round(case when pr > 0 then sqrt((c * c + q * q) * nk / 86400.0 / pr) end, 7) as cov from ve", BY_ENERGY),
    "fold_profile": _with(f"select cast(least(floor({PHASE.format(x=f'{t.F0!r}::double * t + 1e-14::double * t * t / 2.0')} * 16), 15) as bigint) as phbin, count(*) as counts from ev group by 1"),
    "phase_energy_hist": _with(f"select (energy > q[1])::int + (energy > q[2])::int + (energy > q[3])::int as ebin, cast(least(floor({PHASE.format(x=f'{t.F0!r}::double * t')} * 16), 15) as bigint) as phbin, count(*) as counts from ev, (select quantile_cont(energy, [0.25, 0.5, 0.75]) as q from ev) group by all"),
    "phaseogram": _with("select phbin, tbin, counts from phg", PHG),
    "phaseogram_norm": _with(" union all ".join(f"select phbin, tbin, '{k}' as kind, round({e}, 6) as norm from pw" for k, e in (("to1", "(counts - lo) / (hi - lo)"), ("meansub", "counts - m"), ("meannorm", "(counts - m) / m"), ("mediansub", "counts - md"), ("std", "(counts - m) / s"))), PHG, "pw as (select *, avg(counts) over w m, min(counts) over w lo, max(counts) over w hi, median(counts) over w md, stddev_pop(counts) over w s from phg window w as (partition by tbin))"),
    "ef_search": _with("select i, round(sum(counts * counts) / (sum(counts) / 16.0) - sum(counts), 6) as stat from pr group by i", _trial(t.FREQS)),
    "z2_search": _with(_z2("pr", "i", 2), _trial(t.FREQS)),
    "z2_fdot_search": _with(_z2("pr", "i, j", 2), _trial(t.FREQS[::4], t.FDOTS)),
    "h_test": _with(f"""select instr, round(max(h), 6) as h, arg_min(k, -round(h, 9) + k * 1e-13) as m from (select instr, k, sum(z) over (partition by instr order by k) - 4 * k + 4 as h from
      (select instr, k, 2 * (pow(sum(counts * cos(k * (phbin + 0.5) * 2 * pi() / 64)), 2) + pow(sum(counts * sin(k * (phbin + 0.5) * 2 * pi() / 64)), 2)) / sum(counts) as z from pf, (select unnest(range(1, 21)) as k) group by all)) group by instr""",
        f"pf as (select instr, cast(least(floor({PHASE.format(x=f'{t.F0!r}::double * t')} * 64), 63) as bigint) as phbin, count(*) as counts from ev group by all)"),
    "dyn_search": _with(_z2("pr", "win, i", 1), _trial(t.FREQS[::6], key="cast(floor(t / 864000) as bigint) as win")),
    "qffa_search": _with(_z2("moved", "l, q", 2), PREFOLD, f"moved as (select l, q, ((phbin + cast(round_even(u * l + u * u * q, 0) as bigint)) % 16 + 16) % 16 as phbin, sum(counts) as counts from (select *, prof * (2.0 / 31) - 1 as u from pre), (select unnest({_list(t.SHIFTS)}) as l), (select unnest({_list(t.SHIFTS[::2])}) as q) group by all)"),
    "transient_search": _with(_z2("lv", "level, tbin", 1), PREFOLD, "lv as (select level, prof // (2 ** level)::bigint as tbin, phbin, sum(counts) as counts from pre, (select unnest(range(6))::int as level) group by all)"),
    "top_candidates": _with(f"select i, stat, row_number() over (order by stat desc, i) as rank from ({_z2('pr', 'i', 2)}) order by stat desc, i limit 5", _trial(t.FREQS)),
    "super_threshold_peaks": _with("select arg_max(i, stat) as i, max(stat) as stat from (select *, i - row_number() over (order by i) as isl from ef where stat > " + repr(LEVEL) + ") group by isl", _trial(t.FREQS), "ef as (select i, round(sum(counts * counts) / (sum(counts) / 16.0) - sum(counts), 6) as stat from pr group by i)"),
    "phase_tag": _with(f"select event_id, round(p, 6) as ph, round(p - floor(p + 0.5), 6) as ph_half, round(p - ceil(p) + 1, 6) as ph_one from (select event_id, {PHASE.format(x=f'{t.F0!r}::double * (t - 1296000.0) + 1e-13::double * (t - 1296000.0) * (t - 1296000.0) / 2.0')} as p from ev)"),
    "deorbit_circular": _with(f"select event_id, round(t - {DELAY('(t - ' + DELAY('t') + ')')}, 5) as t_emit from ev"),
    "interpolate_orbit": _with(f"select event_id, round(a + (t / 2592.0 - c) * (b - a), 5) as delay from (select event_id, t, c, 12.5 * sin(c * {2 * math.pi * 2592.0 / (3.7 * 86400)!r}::double) as a, 12.5 * sin((c + 1) * {2 * math.pi * 2592.0 / (3.7 * 86400)!r}::double) as b from (select *, floor(t / 2592.0) as c from ev))"),
    "orbital_search": _with(f"select x, p, max(stat) as max_stat, min(stat) as min_stat from (select x, p, z, round(sum(n * n) / (sum(n) / 8.0) - sum(n), 6) as stat from (select x, p, z, least(floor({PHASE.format(x=f'{t.F0!r}::double * e')} * 8), 7) as b, count(*) as n from em group by all) group by all) group by x, p", ORBIT),
    "scramble_flat": _with("select start, stop, count(*) as n from ev join g on t >= start and t < stop group by all", HOURLY, _islands("hourly", "counts > 12")),
    "ingest_chunks": _with("select start as chunk, count(*) as n, round(min(t), 6) as first_t from ev join (select start + 600 as start, stop - 300 as stop from g where stop - start - 900 >= 7200) on t >= start and t < stop group by start", HOURLY, _islands("hourly", "counts > 10")),
    "occultation_ingest": _with("select start + 7200 as start, stop - 7200 as stop from g where stop - start > 14400", "two as (select bin, coalesce(n, 0) as counts from (select unnest(range(360)) as bin) left join (select cast(floor(t / 7200) as bigint) bin, count(*) n from ev group by 1) using (bin))", _islands("two", "counts > 0", 7200.0)),
    "peak_boundaries": _with("select coalesce((select max(i) from zz where i < 24 and stat <= 1.0) + 1, min(i)) as lo, coalesce((select min(i) from zz where i > 24 and stat <= 1.0) - 1, max(i)) as hi from zz", _trial(t.FREQS), "zz as (" + _z2("pr", "i", 2) + ")"),
    "grid_maxima": _with("select i, j, stat from zz a where not exists (select 1 from zz b where abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and b.stat > a.stat)", _trial(t.FREQS[::4], t.FDOTS), "zz as (" + _z2("pr", "i, j", 2) + ")"),
    "phase_exposure": _with("select phbin, round(e / avg(e) over (), 7) as expo from (select phbin, sum(greatest(least(z, c + (phbin + 1) / 16.0) - greatest(a, c + phbin / 16.0), 0)) as e from (select a, z, unnest(range(cast(floor(a) as bigint), cast(ceil(z) as bigint) + 1)) as c from (select start / 30000.0 as a, stop / 30000.0 as z from g)), (select unnest(range(16)) as phbin) group by phbin)", HOURLY, _islands("hourly", "counts > 12")),
    "pulsed_fraction_energy": _with(f"select ebin, round((max(n) - case when count(*) < 16 then 0 else min(n) end) / max(n), 6) as pulsed_fraction from (select (energy > q[1])::int + (energy > q[2])::int + (energy > q[3])::int as ebin, least(floor({PHASE.format(x=f'{t.F0!r}::double * t')} * 16), 15) as b, count(*) as n from ev, (select quantile_cont(energy, [0.25, 0.5, 0.75]) as q from ev) group by all) group by ebin"),
    "color_color": _with("select cast(floor(t / 86400) as bigint) as seg, round(count(*) filter (energy between 5.01 and 10) / nullif(count(*) filter (energy between 0 and 5), 0), 6) as soft, round(count(*) filter (energy between 20.01 and 80) / nullif(count(*) filter (energy between 10.01 and 20), 0), 6) as hard from ev group by 1"),
    "deadtime_distribution": _with("select cast(floor(dead / 100) as bigint) as b0, count(*) as counts from (select prior - least(prior, 1800.0) as dead from (select coalesce(least(t - lag(t) over (partition by instr order by t, event_id), 7200.0), 7200.0) as prior from ev)) where dead >= 0 and dead < 5400 group by 1"),
    "pds_white_sub": _with(f"select k, round(k / 86400.0 * (p - l), 10) as fp, {POWER_LEVEL!r}::double as detection from (select k, avg({LEAHY}) p from dft group by k), (select avg(p) l from (select avg({LEAHY}) p from dft where k > 8 group by k))", _dft()),
    "instrument_files": "select instr, count(*) over (partition by instr)::int as n_files, row_number() over (partition by instr order by tstart, obs_id) as position, obs_id from (select distinct on (obs_id) * from observation)",
    "observation_summary": "select obs_id, mission, instr, coalesce(n, 0) as n, round(tstart / 86400 + mjdref, 6) as mjd_start, round(tstop / 86400 + mjdref, 6) as mjd_stop, round(coalesce(n, 0) / (tstop - tstart), 6) as rate from observation left join (select obs_id, count(distinct event_id) n from photon group by 1) using (obs_id)",
    "channel_spectrum": "select cast(floor(round(case lower(trim(mission)) when 'nustar' then 0.04 * pi + 1.6 when 'xmm' then 0.001 * pi when 'nicer' then 0.01 * pi when 'ixpe' then pi * 0.04 end, 6) * 2) as bigint) as ebin, count(*) as n from (select distinct on (event_id) event_id, obs_id, pi from photon) join observation using (obs_id) where pi is not null and lower(trim(mission)) in ('nustar', 'xmm', 'nicer', 'ixpe') group by 1",
    "lineitem_lightcurve_weighted": "select l_returnflag, datediff('day', timestamp '1995-01-01', l_shipdate) // 7 as week, count(*) as counts, round(sum(l_extendedprice), 2) as flux from lineitem group by all",
    "lineitem_pds": """with b as (select d // 64 as seg, d % 64 as bin, count(*) n from (select datediff('day', timestamp '1995-01-01', l_shipdate) as d from lineitem) group by all),
      f as (select seg, k, sum(n * cos(2 * pi() * k * bin / 64)) re, sum(n * sin(2 * pi() * k * bin / 64)) im, sum(n) n_ph from b, (select unnest(range(1, 32)) as k) group by all)
      select k, round(p, 6) as power, round(p / sqrt(m), 6) as power_err, m from (select k, avg(2 * (re * re + im * im) / n_ph) p, count(*) m from f group by k)""",
    "observation_spectra": """with p as (select distinct on (event_id) event_id, obs_id, event_time from photon where event_time is not null and not isnan(event_time)),
      e as (select lower(trim(mission)) as mission, obs_id, round(event_time - tstart, 6) as t from p join observation using (obs_id) where mission is not null),
      b as (select mission, obs_id, cast(floor(t / 16) as bigint) seg, cast(floor((t - floor(t / 16) * 16) / 0.5) as bigint) bin, count(*) n from e where t >= 0 group by all),
      f as (select mission, obs_id, seg, k, sum(n * cos(2 * pi() * k * bin / 32)) re, sum(n * sin(2 * pi() * k * bin / 32)) im, sum(n) n_ph from b, (select unnest(range(1, 16)) as k) group by all)
      select mission, k, round(avg(2 * (re * re + im * im) / n_ph), 6) as power, count(*) as m from f group by all""",
}
