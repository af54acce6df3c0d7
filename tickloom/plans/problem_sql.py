"""Independent SQL (DuckDB) for the pN_ queries of the core that SQL can express."""

from __future__ import annotations

P1_FOUND = """
with carried as (
  select series_id, arg_max(dt, n * 1e6 - dt) as dt from (
    select series_id, dt, count(*) n from lightcurve where dt > 0 and not isnan(dt) group by all) group by series_id),
lags as (
  select series_id, round(bin_time - lag(bin_time) over (partition by series_id order by bin_time), 5) as gap
  from (select distinct series_id, bin_time from lightcurve where bin_time is not null)),
spaced as (
  select series_id, arg_max(gap, fit * 1e12 + n * 1e6 - gap) as spacing from (
    select l.series_id, gap, count(*) n,
      max(case when abs((s.tstop - s.tstart) / gap - round((s.tstop - s.tstart) / gap)) < 1e-6 then 1 else 0 end) fit
    from lags l join lc_series s using (series_id) where gap > 0 group by all) group by series_id),
src as (
  select s.series_id as k, tstart as t0, tstop as t1,
    coalesce(case when timedel > 0 and not isnan(timedel) then timedel end, c.dt, p.spacing) as step
  from lc_series s left join carried c using (series_id) left join spaced p using (series_id)
  union all
  select obs_id, tstart, tstop, bin_dt from observation),
cells as (
  select k, unnest(range(0, cast(round((t1 - t0) / step) as bigint))) as cell from src where step > 0),
hits as (
  select series_id as k, bin_time as t from lightcurve where counts is not null and not isnan(counts) and not isinf(counts)
  union all
  select obs_id, event_time from photon),
full_cells as (
  select distinct k, cast(floor((t - t0 + 1e-6) / step) as bigint) as cell from hits join src using (k) where t is not null)
select k as series_key, cell as cell_no from cells anti join full_cells using (k, cell)
"""



def _grid_sql() -> str:
    """p1_grid: normal equations of every candidate number of seasons, solved by elimination without pivots, one step a table."""
    p = range(6)
    upper = [(i, j) for i in p for j in p if j >= i]
    features = "1.0::double as x0, u as x1, cos(2 * pi() * c * u) as x2, sin(2 * pi() * c * u) as x3, cos(4 * pi() * c * u) as x4, sin(4 * pi() * c * u) as x5"
    sums = ", ".join([f"sum(x{i} * x{j})" + (" + 1e-6 * count(*) + 1e-9" if i == j else "") + f" as a{i}{j}" for i, j in upper] + [f"sum(x{i} * val) as b{i}, sum(x{i} * val) as o{i}" for i in p])
    steps = []
    for k in range(5):
        cols = [f"a{i}{j}" if i <= k else f"a{i}{j} - a{k}{i} / a{k}{k} * a{k}{j} as a{i}{j}" for i, j in upper]
        cols += [f"b{i}" if i <= k else f"b{i} - a{k}{i} / a{k}{k} * b{k} as b{i}" for i in p]
        steps.append(f"e{k + 1} as (select k, c, n, yy, {', '.join(f'o{i}' for i in p)}, {', '.join(cols)} from e{k})")
    back = ", ".join(f"(b{i}" + "".join(f" - a{i}{j} * w{j}" for j in range(i + 1, 6)) + f") / a{i}{i} as w{i}" for i in reversed(p))
    rest = " + ".join(f"w{i} * o{i}" for i in p)
    at = lambda u: f"(w0 + w1 * ({u}) + w2 * cos(2 * pi() * c * ({u})) + w3 * sin(2 * pi() * c * ({u})) + w4 * cos(4 * pi() * c * ({u})) + w5 * sin(4 * pi() * c * ({u})))"
    return P1_FOUND.split("full_cells as (")[0].rstrip().rstrip(",").rsplit("hits as (", 1)[0] + f"""
vals as (
  select series_id as k, reading_id as rid, bin_time as t, counts as v, false as counting from lightcurve where counts is not null and not isnan(counts) and not isinf(counts)
  union all
  select obs_id, event_id, event_time, 1, true from photon),
once as (
  select k, cast(floor((t - t0 + 1e-6) / step) as bigint) as cell, rid, max(v) as v, any_value(counting) as counting from vals join src using (k) where t is not null group by all),
many as (select k, cast(round((t1 - t0) / step) as bigint) as m from src where step > 0),
filled as (
  select k, cell, m, count(*) as n, case when any_value(counting) then count(*)::double else avg(v) end as val from once join many using (k) where cell >= 0 and cell < m group by k, cell, m),
design as (select k, c, val, {features} from (select k, val, (cell + 0.5) / m as u from filled), (select unnest([1, 2, 4, 8]) as c)),
e0 as (select k, c, count(*) as n, sum(val * val) as yy, {sums} from design group by k, c),
{", ".join(steps)},
solved as (select *, {back} from e5),
scored as (select *, (greatest(yy - ({rest}), 0) + 1e-6 * yy) * (1 + 0.01 * log2(c)) as score from solved where c = 1 or n >= 16 * c),
fit as (select k, c, w0, w1, w2, w3, w4, w5 from scored qualify row_number() over (partition by k order by score, c) = 1),
ends as (
  select k, m, cell as z, val as vz, lag(cell) over w as a, lag(val) over w as va, lead(cell) over w as after from filled window w as (partition by k order by cell)),
holes as (
  select k, m, coalesce(a, -1) as a, va, z, vz from ends where z - coalesce(a, -1) > 1
  union all
  select k, m, z, vz, m, null from ends where after is null and z < m - 1),
bridged as (
  select *, case when a >= 0 then va - {at("(a + 0.5) / m")} end as r0, case when z < m then vz - {at("(z + 0.5) / m")} end as r1 from holes join fit using (k)),
guessed as (
  select *, unnest(range(a + 1, z)) as cell from bridged)
select k as series_key, cell as cell_no, round(val, 4) as cell_value, true as filled, n as n_readings, 'observed' as origin from filled
union all
select k, cell, round({at("(cell + 0.5) / m")} + coalesce(r0, r1) + (cell - a) / (z - a) * (coalesce(r1, r0) - coalesce(r0, r1)), 4), false, 0, 'predicted' from guessed
union all
select k, unnest(range(0, m)), null, false, 0, 'unknown' from many where k not in (select k from filled)
"""


P1_GRID = _grid_sql()

P3_FOUND = """
with span as (
  select obs_id, cast(round(tstart * 1000) as bigint) lo, cast(round(tstop * 1000) as bigint) hi from observation),
iv as (
  select g.obs_id, greatest(cast(round(gti_start * 1000) as bigint), lo) s, least(cast(round(gti_stop * 1000) as bigint), hi) e
  from gti g join span using (obs_id) where gti_stop > gti_start and not isnan(gti_start) and not isnan(gti_stop)),
ok as (
  select obs_id, s, e from iv where e > s
  union all select obs_id, lo, lo from span union all select obs_id, hi, hi from span),
led as (
  select *, max(e) over (partition by obs_id order by s, e rows between unbounded preceding and 1 preceding) as before from ok),
isl as (
  select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by obs_id order by s, e rows unbounded preceding) as island from led),
merged as (
  select obs_id, island, min(s) s, max(e) e from isl group by all),
nxt as (
  select *, lead(s) over (partition by obs_id order by s) as after from merged)
select obs_id, 'period' as span_kind, s as start_ms, e as stop_ms from merged where e > s
union all
select obs_id, 'gap', e, after from nxt where after > e
"""

P6_FOUND = """
with o as (
  select obs_id, lower(trim(mission)) m,
    coalesce(lower(trim(energy_unit)), case
      when regexp_matches(lower(remark), '(kev|kiloelectronvolt)') then 'kev'
      when regexp_matches(lower(remark), '(mev)') then 'mev'
      when regexp_matches(lower(remark), '(joules)') then 'j'
      when regexp_matches(lower(remark), '(\\berg\\b)') then 'erg'
      when regexp_matches(lower(remark), '(\\bev\\b|electronvolt)') then 'ev' end) u
  from observation),
p as (select distinct on (event_id) * from photon),
c as (
  select event_id, obs_id, energy, u,
    case m when 'nustar' then 0.04 * pi + 1.6 when 'xmm' then 0.001 * pi when 'nicer' then 0.01 * pi when 'ixpe' then pi * (15.0 / 375) end as cal
  from p join o using (obs_id)),
per_obs as (
  select obs_id, median(energy / cal) r from c where energy is not null and not isnan(energy) and cal > 0 group by 1),
k as (
  select event_id, energy, cal, case
      when u in ('kev') then 1.0 when u in ('ev') then 1e3 when u in ('mev') then 1e-3
      when u in ('erg', 'ergs') then 1.602176634e-9 when u in ('j') then 1.602176634e-16
      when r > 30 then 1e3 when r > 0.03 then 1.0 when r > 3e-5 then 1e-3 when r > 1e-12 then 1.602176634e-9 when r is not null then 1.602176634e-16 end as f
  from c left join per_obs using (obs_id)),
h as (
  select distinct on (file_id) file_id, json_extract_string(j, '$.tstart')::double a, json_extract_string(j, '$.tstop')::double z,
    coalesce(lower(trim(json_extract_string(j, '$.timeunit'))), lower(json_extract_string(j, '$.comment'))) w
  from (select file_id, regexp_replace(header_json, '"(tstart|tstop|timeunit|comment)":', '"\\1":', 'gi') as raw,
      json_object('tstart', regexp_extract(header_json, '(?i)"tstart": ([-0-9.eE+]+)', 1), 'tstop', regexp_extract(header_json, '(?i)"tstop": ([-0-9.eE+]+)', 1),
        'timeunit', nullif(regexp_extract(header_json, '(?i)"timeunit": "([^"]*)"', 1), ''), 'comment', nullif(regexp_extract(header_json, '(?i)"comment": "([^"]*)"', 1), '')) as j
    from file_header)),
t as (
  select file_id, z - a as span, case
      when regexp_matches(w, '\\b(ms|msec|milliseconds?)\\b') then 0.001 when regexp_matches(w, '\\b(ks|ksec|kiloseconds?)\\b') then 1000.0
      when regexp_matches(w, '\\b(min|minutes)\\b') then 60.0 when regexp_matches(w, '\\b(h|hr|hours)\\b') then 3600.0
      when regexp_matches(w, '\\b(d|day|days|tagen)\\b') then 86400.0 else 1.0 end as per
  from h)
select 'photon' as rec_table, event_id as rec_id,
  cast(round(case when energy is null then cal else energy / f end * 1000) as bigint) as common_value
from k where (energy is null and cal is not null) or (energy is not null and not isnan(energy) and f <> 1.0)
union all
select 'file_header', file_id, cast(round(span * per * 1000) as bigint) from t where per <> 1.0
"""

_UNITS = {"ms": ("ms|msec|milliseconds?", 1e3), "ks": ("ks|ksec|kiloseconds?", 1e-3), "min": ("min|mins|minutes?", 1 / 60), "h": ("h|hr|hrs|hours?", 1 / 3600), "d": ("d|days?|tagen?", 1 / 86400)}
_CASE = " ".join(f"when regexp_matches(w, '\\b({words})\\b') then '{u}'" for u, (words, _) in _UNITS.items())
_PER = " ".join(f"when '{u}' then {per!r}::double" for u, (_, per) in _UNITS.items())

P6_TIMES = "with " + P6_FOUND[P6_FOUND.index("h as (") : P6_FOUND.index("t as (")].rstrip().rstrip(",") + f""",
u as (select *, case {_CASE} else 's' end as unit from h),
f as (select *, case unit {_PER} else 1.0 end as per from u)
select file_id, round(a / per, 4) as start_s, round(z / per, 4) as stop_s, round((z - a) / per, 4) as duration_s, unit, true as sure from f
"""
