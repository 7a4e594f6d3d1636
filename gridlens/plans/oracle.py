"""DuckDB SQL that says what the queries say, written apart from the operators; only the projection is shared."""

from __future__ import annotations

import re

from gridlens.plans.bridge import PROJECTION

_DUCK = re.sub(r"([0-9]+(\.[0-9]+)?)D", r"\1::double", PROJECTION).replace(" div ", " // ")

_ONE = f"rec as (select * replace (0 as session_id) from ({_DUCK}))"
_DAYS = f"""rec as (select * exclude (session_id, record_index, s), s as session_id, row_number() over (partition by s order by record_index) - 1 as record_index
  from (select *, (day(t_start) - 1) // 6 as s from ({_DUCK})))"""
_ON = "(V_LN_a_avg_V > 50 and V_LN_b_avg_V > 50 and V_LN_c_avg_V > 50)"
_FINITE_P = "(not isnan(P_total_avg_W))"
_I = "((I_a_avg_A + I_b_avg_A + I_c_avg_A) / 3)"
_IMB = "((greatest(V_LN_a_avg_V, V_LN_b_avg_V, V_LN_c_avg_V) - least(V_LN_a_avg_V, V_LN_b_avg_V, V_LN_c_avg_V)) / ((V_LN_a_avg_V + V_LN_b_avg_V + V_LN_c_avg_V) / 3.0) * 100.0)"


def _secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1000000.0)"


def _events(dip=0.9, swell=1.1, sigma=2.0, hz=0.5, imb=2.5, step=0.5, least=1, gap=1, kinds: str | None = None) -> str:
    """CTEs up to ``ev(session_id, id, kind, t_start, t_end, severity, phases)``."""
    only = f"where kind in ({kinds})" if kinds else ""
    over = "\n  union all ".join(f"select session_id, record_index, 'high_current', '{p}' from rowz where o and I_{p}_max_A > lim_{p}" for p in "abc")
    limits = ", ".join(f"avg(I_{p}_max_A) filter (where {_ON}) + {sigma} * stddev_pop(I_{p}_max_A) filter (where {_ON}) as lim_{p}" for p in "abc")
    return f"""
nom as (select session_id, median(v) as nv from (select session_id, unnest([V_LN_a_avg_V, V_LN_b_avg_V, V_LN_c_avg_V]) as v from rec) where v > 50 group by session_id),
base as (select session_id, {limits}, avg(abs(P_total_avg_W)) filter (where {_ON} and {_FINITE_P}) * {step} as step_w from rec group by session_id),
rowz as (select rec.*, nv, lim_a, lim_b, lim_c, step_w, {_ON} as o from rec join nom using (session_id) join base using (session_id)),
mask as (
  select session_id, record_index as ix, 'outage' as kind, '' as phase from rowz where not o
  union all select session_id, record_index, 'dip', '' from rowz where o and (V_LN_a_min_V < nv * {dip} or V_LN_b_min_V < nv * {dip} or V_LN_c_min_V < nv * {dip})
  union all select session_id, record_index, 'swell', '' from rowz where o and (V_LN_a_max_V > nv * {swell} or V_LN_b_max_V > nv * {swell} or V_LN_c_max_V > nv * {swell})
  union all {over}
  union all select session_id, record_index, 'freq_excursion', '' from rowz where o and abs(freq_avg_Hz - 60) > {hz}
  union all select session_id, record_index, 'imbalance_spike', '' from rowz where o and {_IMB} > {imb}
), step1 as (select *, ix - lag(ix) over (partition by session_id, kind, phase order by ix) as d from mask),
step2 as (select *, sum(case when d is null or d > {gap} + 1 then 1 else 0 end) over (partition by session_id, kind, phase order by ix) as run from step1),
runs as (select session_id, kind, phase, min(ix) as lo, max(ix) as hi from step2 group by session_id, kind, phase, run having max(ix) - min(ix) + 1 >= {least}),
red as (
  select r.session_id, r.kind, r.phase, r.lo, arg_min(w.t_start, w.record_index) as t_start, arg_max(w.t_end, w.record_index) as t_end, any_value(nv) as nv,
    min(V_LN_a_min_V) as na, min(V_LN_b_min_V) as nb, min(V_LN_c_min_V) as nc, max(V_LN_a_max_V) as xa, max(V_LN_b_max_V) as xb, max(V_LN_c_max_V) as xc,
    max(I_a_max_A) as ia, max(I_b_max_A) as ib, max(I_c_max_A) as ic, (list(freq_avg_Hz - 60 order by abs(freq_avg_Hz - 60) desc, w.record_index))[1] as fr, max(case when o then {_IMB} end) as im
  from runs r join rowz w on w.session_id = r.session_id and w.record_index between r.lo and r.hi group by r.session_id, r.kind, r.phase, r.lo
), found as (
  select session_id, kind, phase, lo, t_start, t_end,
    case kind when 'outage' then least(na, nb, nc)
      when 'dip' then least(case when na < nv * {dip} then na end, case when nb < nv * {dip} then nb end, case when nc < nv * {dip} then nc end) / nv
      when 'swell' then greatest(case when xa > nv * {swell} then xa end, case when xb > nv * {swell} then xb end, case when xc > nv * {swell} then xc end) / nv
      when 'high_current' then case phase when 'a' then ia when 'b' then ib else ic end
      when 'freq_excursion' then fr else im end as severity,
    case kind when 'dip' then concat_ws('/', case when na < nv * {dip} then 'a' end, case when nb < nv * {dip} then 'b' end, case when nc < nv * {dip} then 'c' end)
      when 'swell' then concat_ws('/', case when xa > nv * {swell} then 'a' end, case when xb > nv * {swell} then 'b' end, case when xc > nv * {swell} then 'c' end)
      when 'high_current' then phase when 'freq_excursion' then '' else 'a/b/c' end as phases
  from red
  union all
  select session_id, 'power_step', '', record_index, t_start, t_end, p - q, 'a/b/c' from (
    select session_id, record_index, t_start, t_end, o, step_w, P_total_avg_W as p, lag(P_total_avg_W) over w as q, lag(o) over w as oq from rowz window w as (partition by session_id order by record_index))
  where o and oq and not isnan(p) and not isnan(q) and step_w > 0 and abs(p - q) > step_w
), ev as (select *, row_number() over (partition by session_id order by t_start, kind, phase, lo) - 1 as id from (select * from found {only}))"""


_EV = "select session_id, id, kind, epoch_us(t_start) as t_start, epoch_us(t_end) as t_end, round(severity, 6) as severity, phases as affected_phases from ev"
_FEW = "session_id, record_index, epoch_us(t_start) as t_start"
_W = "between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-12 00:00:00'"



def _signature(seconds: int) -> str:
    """CTEs up to ``j``: each outage with structs of its leading dip ``l``, its over-current ``h`` and its trailing dip ``t``."""
    after = f"o.t_end and o.t_end + interval {seconds} second"
    part = lambda name, kind, when: f"{name} as (select o.id, arg_min(d, d.id) as {name} from o join ev d on d.kind = '{kind}' and {when} group by 1)"
    return f"""o as (select * from ev where kind = 'outage'), {part("l", "dip", f"d.t_end between o.t_start - interval {seconds} second and o.t_start")}, {part("h", "high_current", f"d.t_start between {after}")}, {part("t", "dip", f"d.t_start between {after}")},
j as (select o.*, l.l, h.h, case when t.t.id is distinct from l.l.id then t.t end as t from o left join l using (id) left join h using (id) left join t using (id))"""


def _hist(source: str, keys: str, of: dict[str, float]) -> str:
    """Quantiles of ``source`` (keys, v, lo, width, bins): a subquery with keys and a column per quantile."""
    cols = ", ".join(f"any_value(lo) + (min(case when reached >= {q} * total then bin end) + 0.5) * any_value(width) as {n}" for n, q in of.items())
    return f"""(select {keys}, {cols} from (
      select *, sum(n) over (partition by {keys} order by bin) as reached, sum(n) over (partition by {keys}) as total from (
        select {keys}, lo, width, greatest(0, least(cast(floor((v - lo) / width) as bigint), bins - 1)) as bin, count(*) as n from ({source}) where not isnan(v) group by {keys}, lo, width, bin)
      ) group by {keys})"""


def _pool(keys: str, pattern: str, hi: float, bins: int = 4000, over: str = "") -> str:
    return " union all ".join(f"select {keys}, {pattern.format(p)} as v, 0.0 as lo, {hi} / {bins}.0 as width, {bins} as bins from src {('where ' + pattern.format(p) + over) if over else ''}" for p in "abc")


_CHANNELS = (
    [(f"V_LN_{p}_avg_V", 0, 400, "V") for p in "abc"] + [(f"I_{p}_avg_A", 0, 1000, "A") for p in "abc"] + [("freq_avg_Hz", 55, 65, "Hz")]
    + [("P_total_avg_W", -2e6, 2e6, "W"), ("S_total_avg_VA", -2e6, 2e6, "VA"), ("Q_total_avg_VAR", -2e6, 2e6, "VAR"), ("PF_total_avg", -1.05, 1.05, "")]
)
_LONG = " union all ".join(f"select session_id, '{c}' as channel, '{u}' as unit, {c} as v, {float(lo)}::double as lo, ({float(hi)}::double - {float(lo)}::double) / 4000 as width, 4000 as bins from rec" for c, lo, hi, u in _CHANNELS)
_VSUM = "sum(" + " + ".join(f"case when V_LN_{p}_avg_V > 50 then V_LN_{p}_avg_V else 0 end" for p in "abc") + ")"
_VN = "sum(" + " + ".join(f"case when V_LN_{p}_avg_V > 50 then 1 else 0 end" for p in "abc") + ")"


def _bucket(expr: str, label: str, mode: str = _ONE, extra: str = "") -> str:
    """The bucket summary; ``expr`` gives the start of a bucket from t."""
    at = lambda t: expr.replace("$t", t)
    return f"""with {mode}, {_events()}{extra},
b as (select *, {at("t_start")} as bs from rec {"join first using (session_id)" if extra else ""}),
e as (select session_id, {at("t_start")} as bs, count(*) filter (where kind = 'outage') as n_outages, count(*) filter (where kind = 'dip') as n_dips, count(*) filter (where kind = 'swell') as n_swells
  from ev {"join first using (session_id)" if extra else ""} group by 1, 2),
g as (select session_id, bs, count(*) as records,
  coalesce(min(least(case when V_LN_a_avg_V > 50 then V_LN_a_avg_V end, case when V_LN_b_avg_V > 50 then V_LN_b_avg_V end, case when V_LN_c_avg_V > 50 then V_LN_c_avg_V end)), 0) as vmin,
  coalesce({_VSUM} / nullif({_VN}, 0), 0) as vavg, max(greatest(V_LN_a_avg_V, V_LN_b_avg_V, V_LN_c_avg_V)) as vmax, greatest(0, max(greatest(I_a_avg_A, I_b_avg_A, I_c_avg_A))) as imax,
  coalesce(avg(P_total_avg_W) filter (where {_FINITE_P}) / 1000 * (count(*) filter (where {_FINITE_P}) / 3600.0), 0) as kwh,
  coalesce((list(PF_total_avg order by abs(PF_total_avg), record_index) filter (where {_ON} and abs(PF_total_avg) < 1))[1], 1.0) as wpf, coalesce(max(P_total_avg_W) filter (where {_FINITE_P}) / 1000, 0) as pk
  from b group by session_id, bs)
select session_id, epoch_us(bs) as bucket_start, {label.replace("$b", "bs")} as bucket, records, round(vmin, 6) as "V_min_V", round(vavg, 6) as "V_avg_V", round(vmax, 6) as "V_max_V", round(imax, 6) as "I_max_A", round(kwh, 6) as "kWh",
  round(wpf, 6) as "worst_PF", round(pk, 6) as "peak_kW", coalesce(n_outages, 0) as n_outages, coalesce(n_dips, 0) as n_dips, coalesce(n_swells, 0) as n_swells
from g left join e using (session_id, bs)"""


_DAY = "date_trunc('day', $t)"
_SIX = "date_trunc('day', $t) + to_hours(cast(hour($t) // 6 * 6 as integer))"


def _shift_case(minute: str, shifts: list[tuple[str, int, int]]) -> str:
    parts = " ".join(f"when {f'{minute} >= {a} and {minute} < {b}' if a < b else f'({minute} >= {a} or {minute} < {b})'} then '{n}'" for n, a, b in shifts)
    return f"case {parts} else 'unassigned' end"


def _minute(t: str, tz: str | None = None) -> str:
    here = f"timezone('{tz}', timezone('UTC', {t}))" if tz else t
    return f"(hour({here}) * 60 + minute({here}))"


_TWO = [("day", 360, 1080), ("night", 1080, 360)]
_THREE = [("A", 360, 840), ("B", 840, 1320), ("C", 1320, 360)]
_PARTIAL = [("early", 300, 750), ("late", 720, 1200)]


def _shifts(shifts: list[tuple[str, int, int]], tz: str | None, minutes: int, mode: str = _ONE) -> str:
    w, names = minutes * 60, ", ".join(f"('{n}', '{a // 60:02d}:{a % 60:02d}-{b // 60:02d}:{b % 60:02d}')" for n, a, b in shifts)
    return f"""with {mode}, {_events()},
src as (select *, {_shift_case(_minute("t_start", tz), shifts)} as shift, {_I} as im from rec),
es as (select session_id, {_shift_case(_minute("t_start", tz), shifts)} as shift, count(*) filter (where kind = 'outage') as n_outages, count(*) filter (where kind = 'dip') as n_dips, count(*) filter (where kind = 'swell') as n_swells,
  coalesce(sum({_secs("t_start", "t_end")}) filter (where kind = 'outage'), 0) / 60 as om from ev group by 1, 2),
g as (select session_id, shift, count(*) as records, count(*) filter (where {_FINITE_P}) as np, coalesce(avg(P_total_avg_W) filter (where {_FINITE_P}), 0) as pa, coalesce(min(P_total_avg_W) filter (where {_FINITE_P}), 0) as pn,
  coalesce(max(P_total_avg_W) filter (where {_FINITE_P}), 0) as px, avg(PF_total_avg) as pf, coalesce({_VSUM} / nullif({_VN}, 0), 0) as va, count(*) filter (where im >= 50) as ar,
  count(*) filter (where im >= 50 and {_FINITE_P}) as an, coalesce(avg(P_total_avg_W) filter (where im >= 50 and {_FINITE_P}), 0) as ap, coalesce(avg(PF_total_avg) filter (where im >= 50), 0) as apf from src group by 1, 2),
hv as {_hist(_pool("session_id, shift", "V_LN_{}_avg_V", 400.0, over=" > 50"), "session_id, shift", {"p5": 0.05, "p95": 0.95})},
ht as {_hist(_pool("session_id, shift", "V_THD_pct_{}_avg", 50.0), "session_id, shift", {"t95": 0.95})},
d as (select session_id, shift, max(case when k >= {w} then s / {w} end) as peak from (
  select session_id, shift, row_number() over x as k, sum(case when {_FINITE_P} then P_total_avg_W else 0 end) over (x rows between {w - 1} preceding and current row) as s from src window x as (partition by session_id, shift order by record_index)) group by 1, 2),
names(shift, win) as (values {names}),
every as (select session_id, shift, win from (select distinct session_id from rec), names union all select distinct session_id, 'unassigned', '—' from src where shift = 'unassigned')
select session_id, shift, win as "window", coalesce(records, 0) as records, round(coalesce(np, 0) / 3600.0, 6) as hours, round(coalesce(pa / 1000 * (np / 3600.0), 0), 6) as "kWh", round(coalesce(pa, 0), 6) as "P_total_avg_W", round(coalesce(pn, 0), 6) as "P_total_min_W", round(coalesce(px, 0), 6) as "P_total_max_W",
  round(round(coalesce(peak, 0), 6) / 1000, 6) as "peak_demand_kW", {w} as peak_demand_window_secs, round(coalesce(pf, 0), 6) as "PF_avg", round(coalesce(va, 0), 6) as "V_LN_avg_V", round(coalesce(p5, 0), 6) as "V_LN_p5_V", round(coalesce(p95, 0), 6) as "V_LN_p95_V", round(coalesce(t95, 0), 6) as "V_THD_p95_pct",
  coalesce(n_outages, 0) as n_outages, coalesce(n_dips, 0) as n_dips, coalesce(n_swells, 0) as n_swells, round(coalesce(om, 0), 6) as outage_minutes, coalesce(ar, 0) as active_records, round(coalesce(ar * 100.0 / records, 0), 6) as active_duty_pct,
  round(coalesce(ap / 1000 * an / 3600.0, 0), 6) as "active_kWh", round(coalesce(apf, 0), 6) as "active_PF_avg"
from every left join g using (session_id, shift) left join hv using (session_id, shift) left join ht using (session_id, shift) left join d using (session_id, shift) left join es using (session_id, shift)"""


def _fit(source: str, keys: str) -> str:
    dx, dy = "var_pop(x)", "var_pop(y)"
    return f"""select {keys}, count(*) as n, round(sum(y), 6) as total, round(max(x) - min(x), 6) as span, round(case when {dx} > 0 then covar_pop(x, y) / {dx} else 0 end, 6) as slope,
  round(case when {dx} > 0 and {dy} > 0 then covar_pop(x, y) / sqrt({dx} * {dy}) else 0 end, 6) as r from ({source}) group by {keys}"""


_FACTS = f"""facts as (select session_id, arg_min(t_start, record_index) as t_first, avg(V_LN_a_avg_V) filter (where {_ON}) as ma, avg(V_LN_b_avg_V) filter (where {_ON}) as mb, avg(V_LN_c_avg_V) filter (where {_ON}) as mc,
  count(*) filter (where {_ON} and abs(PF_total_avg) > 0 and abs(PF_total_avg) < 0.85) / (count(*) filter (where {_ON}))::double as low from rec group by session_id),
fx as (select *, {_secs("first_value(t_first) over (order by session_id)", "t_first")} / 86400 as days from facts)"""
_STIFF = """st as (select e.session_id, e.id, e.severity, (select max(abs(r.freq_avg_Hz - 60)) from rec r where r.session_id = e.session_id and r.record_index between e.lo - 2 and e.lo + 2) as dev from ev e where kind = 'power_step')"""


def _sources(one: str, days: str, ev: str) -> dict[str, str]:
    """What sources and sinks must give back: the projection, with channels as FLOAT."""
    f4 = lambda c: f"round(case when isnan({c}) then -1 else {c}::float::double end, 6) as {c}"
    values = "epoch_us(t_start) as t_start, epoch_us(t_end) as t_end, " + ", ".join(f4(c) for c in ("V_LN_a_avg_V", "freq_avg_Hz", "P_total_avg_W"))
    records = f"{days} select 'S' || session_id as session_id, record_index, {values} from rec"
    six, label = _SIX.replace("$t", "t_start"), "strftime($b, '%Y-%m-%dT%H') || '-' || strftime($b + interval 6 hour, '%H')"
    return {
        "source_strict": records,
        "source_tolerant": records,
        "source_split": f"{records} where session_id = 0",
        "source_open_session": f"{records} where session_id = 1",
        "source_bundle": records,
        "source_csv": f"{one} select 'x' as session_id, record_index, {values} from rec",
        "source_scan_stats": f"{days} select 'S' || session_id as session_id, count(*) + 5 as total_seen, count(*) as good, 5 as bad_magic, 1 as truncated, count(*) filter (where isnan(P_total_avg_W)) as nonfinite from rec group by session_id",
        "source_first_last": f"{days} select 'S' || session_id as session_id, epoch_us(arg_min(t_start, record_index)) as first_start, epoch_us(arg_max(t_end, record_index)) as last_end from rec group by session_id",
        "source_file_facts": f"{days} select 'S' || session_id as session_id, (count(*) * 744 + 45) // 744 as records, true as has_tail from rec group by session_id",
        "source_configs": f"{days} select distinct 'S' || session_id as session_id, 'asset ' || session_id as asset_name, 'night' as team_name, 'demo' as type, null::varchar as firmware_version from rec",
        "source_bundle_configs": f"{days} select distinct 'S' || session_id as session_id, 'asset ' || session_id as asset_name, 'night' as team_name, 'demo' as type, null::varchar as firmware_version from rec",
        "source_marks": "select epoch_us(ts) as time, 'm' || event_id as label from events where event_type <> 'click'",
        "export_every_seventh": f"{one} select record_index, strftime(t_start, '%Y-%m-%dT%H:%M:%S.%f') as timestamp_utc, round(I_a_max_A, 6) as I_a_max_A from rec where record_index % 7 = 0 order by record_index limit 500",
        "export_minutes": f"{one} select record_index, strftime(t_start, '%Y-%m-%dT%H:%M:%S.%f') as timestamp_utc, round(I_a_max_A, 6) as I_a_max_A from rec where record_index % 60 = 0",
        "export_buckets": f"""{one}, {_events()}, r as (select {six} as b, count(*) as records, min(record_index) as first from rec group by 1), e as (select {six} as b, count(*) as events, count(*) filter (where t_end >= {six} + interval 6 hour) as spanning from ev group by 1)
select {label.replace("$b", "b")} as bucket, records, first, coalesce(events, 0) as events, coalesce(spanning, 0) as spanning from r left join e using (b)""",
        "export_events_json": f"""{one}, {_events()}, r as (select ev.*, case when kind = 'outage' then severity / nv * 100 when kind in ('dip', 'swell') then severity * 100 end as p, {_secs("t_start", "t_end")} as s from ev join nom using (session_id))
select id, kind, epoch_us(t_start) as t_start, round(severity, 6) as severity, phases as affected_phases, round(p, 6) as residual_pct, case when p is null then null when p > case when s <= 0.0001 then 500 when s <= 0.003 then 200 when s <= 0.5 then 120 else 110 end then 'prohibited' when p < case when s <= 0.003 then 0 when s <= 0.5 then 70 when s <= 10 then 80 else 90 end then 'no_damage' else 'no_interruption' end as itic_class from r""",
        "export_at_once": f"""{one}, n as (select count(*) as n, count(*) filter (where isnan(P_total_avg_W)) as odd, cast(greatest(1, ceil(count(*) / 5000.0)) as bigint) as every from rec),
k as (select 'session.csv' as sink, record_index, V_LN_a_avg_V as v from rec, n where record_index % every = 0 union all select 'session_1min.csv', record_index, V_LN_a_avg_V from rec where record_index % 60 = 0 union all select 'store', record_index, V_LN_a_avg_V from rec)
select sink, count(*) as n, max(record_index) as last, round(sum(v), 6) as volts, n.n as records, odd as nonfinite from k, n group by sink, n.n, odd""",
        "events_with_notes": f"{ev} select id, kind, 'n' || event_id as note from ev join events on event_type = 'click' and event_id = id",
    }


def oracle_sql() -> dict[str, str]:
    one, days = f"with {_ONE}", f"with {_DAYS}"
    ev, evd = f"{one}, {_events()}", f"{days}, {_events()}"
    kinds = {"outage": "outage", "dip": "dip", "swell": "swell", "high_current": "high_current", "freq_excursion": "freq_excursion", "imbalance": "imbalance_spike", "power_step": "power_step"}
    o: dict[str, str] = {f"events_{k}": f"""{one}, {_events(kinds=f"'{v}'")} {_EV}""" for k, v in kinds.items()}
    out_swell = f"""{one}, {_events(kinds="'outage', 'swell'")}"""
    totals = f"""tot as (select session_id, count(*) as rows, coalesce(sum(Wh_total) filter (where not isnan(Wh_total)), 0) as ws, coalesce(sum(Wh_total) filter (where not isnan(Wh_total) and Wh_total > 0), 0) as wf, coalesce(sum(Wh_total) filter (where not isnan(Wh_total) and Wh_total < 0), 0) as wr,
  greatest(0, max(P_total_avg_W) filter (where {_FINITE_P})) as pp, least(0, min(P_total_avg_W) filter (where {_FINITE_P})) as pn, greatest(0, max(greatest(I_a_avg_A, I_b_avg_A, I_c_avg_A))) as ip,
  count(*) filter (where {_FINITE_P} and P_total_avg_W > 10) as si, count(*) filter (where {_FINITE_P} and P_total_avg_W < -10) as se, count(*) filter (where P_total_avg_W between -10 and 10) as sd from rec group by session_id)"""
    summary = 'select session_id, rows, round(ws / 1000, 6) as net_kwh, round(wf / 1000, 6) as imported_kwh, round(wr / 1000, 6) as exported_kwh, round(pp / 1000, 6) as peak_import_kw, round(pn / 1000, 6) as peak_export_kw, round(ip, 6) as peak_current_a from tot'
    o |= {
        "non_outage_mask": f'{one} select {_FEW}, {_ON} as "on" from rec',
        "mean_phase_current": f"{one} select {_FEW}, round({_I}, 6) as i_mean_a from rec",
        "core_columns": f"{one} select count(*) as n, round(sum(V_LN_a_avg_V), 6) as va, round(sum(I_THD_pct_c_avg), 6) as thd from rec",
        "slim_columns": f'{one} select record_index, round(S_total_avg_VA / 1000, 6) as "S_kVA", round(Q_total_avg_VAR / 1000, 6) as "Q_kVAR", V_THD_pct_a_avg as "V_THD_pct_a_avg" from rec',
        "time_window_filter": f"{one} select {_FEW} from rec where t_start >= timestamp '2024-01-05 00:00:00' and t_end <= timestamp '2024-01-12 00:00:00'",
        "range_scope": f"{one} select {_FEW} from rec where t_start {_W}",
        "index_range": f"{one} select {_FEW} from rec where record_index between 100 and 299",
        "index_gather": f"{one} select {_FEW} from rec where record_index % 77 in (3, 5)",
        "stride_sample": f"{one} select {_FEW} from rec where record_index % 60 = 0",
        "stride_by_place": f"{one} select record_index from (select record_index, row_number() over (order by record_index) - 1 as k from rec where {_ON}) where k % 50 = 0",
        "reverse_cts_all": f'{one} select {_FEW}, round(-Q_total_avg_VAR, 6) as "Q_total_avg_VAR", round(-PF_total_avg, 6) as "PF_total_avg", round(-DPF_total_avg, 6) as "DPF_total_avg", round(S_total_avg_VA, 6) as "S_total_avg_VA" from rec',
        "reverse_cts_phase_a": f'{one} select {_FEW}, round(-Q_total_avg_VAR, 6) as "Q_total_avg_VAR", round(-PF_total_avg, 6) as "PF_total_avg", round(I_a_avg_A, 6) as "I_a_avg_A" from rec',
        "anchor_shift_start": f"{one}, z as (select epoch_us(timestamp '2025-03-01 12:00:00') - epoch_us(arg_min(t_start, record_index)) as s from rec) select record_index, epoch_us(t_start) + s as t_start, epoch_us(t_end) + s as t_end from rec, z",
        "anchor_shift_end": f"{days}, z as (select session_id, epoch_us(timestamp '2025-03-01 12:00:00') - epoch_us(arg_max(t_end, record_index)) as s from rec group by session_id) select session_id, record_index, epoch_us(t_start) + s as t_start, epoch_us(t_end) + s as t_end from rec join z using (session_id)",
        "relative_time": f"{days} select session_id, record_index, round({_secs('min(t_start) over (partition by session_id)', 't_start')}, 6) as rel_s from rec",
        "decimate_minmax": f"""{one}, n as (select count(*) as n from rec), b as (select record_index as i, I_a_max_A as v, t_start, n, (select max(k) from range(200) r(k) where floor(k * (n / 200.0)) <= record_index) as b from rec, n),
p as (select b, arg_min(i, (v, i)) as l, arg_min(i, (-v, i)) as h from b group by b) select i as record_index, round(v, 6) as "I_a_max_A", epoch_us(t_start) as t_start from b where i in (select l from p union select h from p)""",
        "nominal_voltage": f"{evd} select session_id, round(nv, 6) as nominal_v from nom",
        "event_baselines": f"{evd} select session_id, round(lim_a, 6) as limit_a, round(lim_b, 6) as limit_b, round(lim_c, 6) as limit_c, round(step_w, 6) as step_w from base",
        "detect_events": f"{ev} {_EV}",
        "detect_events_sessions": f"{evd} {_EV}",
        "events_custom_rules": f"{one}, {_events(0.95, 1.05, 1.5, 0.1, 3.0, 1.0, 2, 3)} {_EV}",
        "event_counts_by_kind": f"{evd} select session_id, kind, count(*) as n from ev group by 1, 2",
        "event_id_filter": f"{ev} {_EV} where id in (0, 1, 2, 3, 4, 9, 12)",
        "event_zoom_slice": f"{ev} select id as event_id, kind, record_index from ev join rec on rec.t_start between ev.t_start - interval 5 second and ev.t_end + interval 10 second",
        "session_stats": f"""{days}, long as ({_LONG}), h as {_hist("select * from long", "session_id, channel", {"p1": 0.01, "p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99})},
m as (select session_id, channel, unit, count(*) as count, min(v) as min, max(v) as max, avg(v) as mean, stddev_pop(v) as stdev from long where not isnan(v) group by 1, 2, 3)
select session_id, channel, unit, count, round(min, 6) as min, round(p1, 6) as p1, round(p5, 6) as p5, round(median, 6) as median, round(mean, 6) as mean, round(p95, 6) as p95, round(p99, 6) as p99, round(max, 6) as max, round(stdev, 6) as stdev from m join h using (session_id, channel)""",
        "session_cards": f"""{evd}, k as (select session_id, count(*) as event_count from ev group by 1), t as (select session_id, count(*) as rows, coalesce(sum(Wh_total) filter (where Wh_total > 0), 0) as f, coalesce(sum(Wh_total) filter (where Wh_total < 0), 0) as r,
  greatest(0, max(P_total_avg_W) filter (where {_FINITE_P})) as pp, least(0, min(P_total_avg_W) filter (where {_FINITE_P})) as pn, greatest(0, max(greatest(I_a_avg_A, I_b_avg_A, I_c_avg_A))) as i from (select * replace (case when isnan(Wh_total) then null else Wh_total end as Wh_total) from rec) group by 1)
select session_id, rows, round(f / 1000, 6) as imported_kwh, round(r / 1000, 6) as exported_kwh, round(pp / 1000, 6) as peak_import_kw, round(pn / 1000, 6) as peak_export_kw, round(i, 6) as peak_current_a, coalesce(event_count, 0) as event_count from t left join k using (session_id)""",
        "stats_rollup": f"""{days}, tagged as ({_LONG.replace("4000 as bins from", "4000 as bins, strftime(t_start, '%Y-%m-%d') as day from")}), long as (select session_id, channel, day, v, lo, width, bins from tagged union all select session_id, channel, null, v, lo, width, bins from tagged),
h as {_hist("select session_id, channel, coalesce(day, '-') as day, v, lo, width, bins from long", "session_id, channel, day", {"p5": 0.05, "median": 0.5, "p95": 0.95})},
m as (select session_id, channel, coalesce(day, '-') as day, count(*) as n, min(v) as min, max(v) as max, avg(v) as mean, stddev_pop(v) as stdev from long where not isnan(v) group by 1, 2, 3)
select session_id, nullif(day, '-') as day, channel as name, n, round(min, 6) as min, round(max, 6) as max, round(mean, 6) as mean, round(stdev, 6) as stdev, round(p5, 6) as p5, round(median, 6) as median, round(p95, 6) as p95 from m join h using (session_id, channel, day)""",
        "threshold_seconds": f"""{days}, t as (select session_id, count(*) as total_records, count(*) filter (where {_ON} and least(V_LN_a_avg_V, V_LN_b_avg_V, V_LN_c_avg_V) < 275) as u, count(*) filter (where greatest(I_a_avg_A, I_b_avg_A, I_c_avg_A) > 600) as c from rec group by 1)
select session_id, total_records, u as sec_undervoltage, c as sec_overcurrent, round(u * 100.0 / total_records, 6) as pct_undervoltage, round(c * 100.0 / total_records, 6) as pct_overcurrent from t""",
        "ieee519": f"""{days}, src as (select * from rec), l as ({" union all ".join(f"select session_id, '{p}' as phase, V_THD_pct_{p}_avg as v, I_THD_pct_{p}_avg as i from rec" for p in "abc")}),
hv as {_hist("select session_id, phase, v, 0.0::double as lo, 100.0::double / 2000 as width, 2000 as bins from l", "session_id, phase", {"v": 0.95})}, hi as {_hist("select session_id, phase, i as v, 0.0::double as lo, 200.0::double / 2000 as width, 2000 as bins from l", "session_id, phase", {"i": 0.95})}
select session_id, phase, round(v, 6) as v_thd_p95, round(i, 6) as i_thd_p95, v <= 8 as compliant, v > 5 as exceeds_planning, bool_and(v <= 8) over (partition by session_id) as all_compliant from hv join hi using (session_id, phase)""",
        "session_energy": f"""{days} select session_id, round(sum(P_total_avg_W / 3600000.0), 6) as "energy_as_measured_kWh", round(coalesce(sum(P_total_avg_W / 3600000.0) filter (where {_I} >= 50), 0), 6) as "energy_active_kWh",
  round(sum(case when {_I} >= 50 then P_total_avg_W else greatest(P_total_avg_W, 0) end / 3600000.0), 6) as "energy_net_clip_standby_kWh" from rec where {_FINITE_P} group by 1""",
        "session_totals": f"{days}, {totals} select session_id, rows, round(ws, 6) as wh_sum, round(wf, 6) as wh_fwd, round(wr, 6) as wh_rev, round(pp, 6) as p_peak_pos, round(pn, 6) as p_peak_neg, round(ip, 6) as i_peak, si as sec_import, se as sec_export, sd as sec_idle from tot",
        "compare_summary": f"{days}, {totals} {summary}",
        "compare_table": f"""{days}, {totals}, s as ({summary}), u as (unpivot (select session_id, rows::double as rows, net_kwh, imported_kwh, exported_kwh, peak_import_kw, peak_export_kw, peak_current_a from s) on columns(* exclude session_id) into name metric value v)
select metric, {", ".join(f'max(case when session_id = {k} then v end) as "{k}"' for k in range(5))} from u group by metric""",
        "tariff_cost": f"""{days}, w as (select session_id, Wh_total as wh, hour(t_start) in (7, 8, 9, 10, 17, 18, 19, 20, 23, 0) as pk from rec where not isnan(Wh_total)), t as (select session_id, coalesce(sum(wh) filter (where pk and wh > 0), 0) / 1000 as a, coalesce(sum(wh) filter (where pk and wh < 0), 0) / 1000 as b, coalesce(sum(wh) filter (where not pk and wh > 0), 0) / 1000 as c, coalesce(sum(wh) filter (where not pk and wh < 0), 0) / 1000 as d from w group by 1)
select session_id, 'EUR' as currency, round(a + b, 6) as peak_kwh, round(a, 6) as peak_imported_kwh, round(b, 6) as peak_exported_kwh, round(c + d, 6) as offpeak_kwh, round(c, 6) as offpeak_imported_kwh, round(d, 6) as offpeak_exported_kwh, round((a + b) * 0.31, 6) as peak_cost,
  round((c + d) * 0.19, 6) as offpeak_cost, round(a * 0.31 + c * 0.19, 6) as imported_cost, round(b * 0.31 + d * 0.19, 6) as exported_cost, round((a + b) * 0.31 + (c + d) * 0.19, 6) as net_cost from t""",
        "first_last": f"{days} select session_id, epoch_us(arg_min(t_start, record_index)) as first_start, epoch_us(arg_max(t_end, record_index)) as last_end, count(*) as records from rec group by 1",
        "sarfi": f"""{evd}, r as (select session_id, case kind when 'dip' then severity * 100 else severity / nv * 100 end as r from ev join nom using (session_id) where kind in ('dip', 'outage'))
select session_id, round(nv, 6) as nominal_v, {", ".join(f"count(*) filter (where r < {x}) as sarfi_{x}" for x in (90, 80, 70, 50, 10))}, count(r) as events_considered from nom left join r using (session_id) group by session_id, nv""",
        "event_itic": f"""{ev}, r as (select ev.*, case when kind = 'outage' then severity / nv * 100 else severity * 100 end as p, {_secs("t_start", "t_end")} as s from ev join nom using (session_id) where kind in ('dip', 'swell', 'outage'))
select session_id, id, kind, epoch_us(t_start) as t_start, epoch_us(t_end) as t_end, round(severity, 6) as severity, round(p, 6) as residual_pct, round(s, 6) as duration_secs,
  case when p > case when s <= 0.001 then 500 when s <= 0.003 then 200 when s <= 0.5 then 120 else 110 end then 'prohibited' when p < case when s <= 0.003 then 0 when s <= 0.5 then 70 when s <= 10 then 80 else 90 end then 'no_damage' else 'no_interruption' end as itic_class from r""",
        "bucket_hour": _bucket("date_trunc('hour', $t)", "strftime($b, '%Y-%m-%dT%H')"),
        "bucket_day": _bucket(_DAY, "strftime($b, '%Y-%m-%d')"),
        "bucket_6h": _bucket(_SIX, "strftime($b, '%Y-%m-%dT%H') || '-' || strftime($b + interval 6 hour, '%H')"),
        "bucket_week": _bucket("m0 + to_days(cast(date_diff('day', m0, $t) // 7 * 7 as integer))", "strftime($b, '%Y-%m-%d')", _DAYS, ", first as (select session_id, date_trunc('day', min(t_start)) as m0 from rec group by 1)"),
        "bucket_ranges_90m": f"{one} select session_id, epoch_us(date_trunc('day', t_start) + to_seconds((hour(t_start) * 3600 + minute(t_start) * 60 + second(t_start)) // 5400 * 5400)) as bucket_start, min(record_index) as lo, max(record_index) + 1 as hi from rec group by 1, 2",
        "events_in_bucket": f"{ev}, b as (select *, {_SIX.replace('$t', 't_start')} as bs from ev) select id, kind, epoch_us(bs) as bucket_start, t_end >= bs + interval 6 hour as spans_bucket_boundary from b",
        "tod_profile": f"""{one}, b as (select *, {_minute("t_start")} // 15 * 15 as b from rec where {_minute("t_start")} >= 360 and {_minute("t_start")} < 1200)
select session_id, printf('%02d:%02d', b // 60, b % 60) as bin, count(*) as n, count(distinct t_start::date) as n_days, case when bool_or(isnan(P_total_avg_W)) then -1 else round(avg(P_total_avg_W / 1000) filter (where {_FINITE_P}), 6) end as "p_avg_kW", round(min(P_total_avg_W / 1000) filter (where {_FINITE_P}), 6) as "p_min_kW", round(max(P_total_avg_W / 1000) filter (where {_FINITE_P}), 6) as "p_max_kW",
  round(avg(V_LN_a_avg_V), 6) as "v_avg_V", round(min(V_LN_a_avg_V), 6) as "v_min_V", round(max(V_LN_a_avg_V), 6) as "v_max_V", round(avg(I_a_avg_A), 6) as "i_avg_A", round(min(I_a_avg_A), 6) as "i_min_A", round(max(I_a_avg_A), 6) as "i_max_A" from b group by session_id, b""",
        "tod_profile_nan": f"""{one}, b as (select *, hour(t_start) as b from rec) select printf('%02d:00', b) as bin, count(*) as n, count(distinct t_start::date) as n_days, round(min(P_total_avg_W / 1000) filter (where {_FINITE_P}), 6) as "p_min_kW", round(max(P_total_avg_W / 1000) filter (where {_FINITE_P}), 6) as "p_max_kW", bool_or(isnan(P_total_avg_W)) as p_avg_nan from b group by b""",
        "shift_of_records": f"{one} select record_index, {_shift_case(_minute('t_start'), _PARTIAL)} as shift from rec",
        "shift_comparison_utc": _shifts(_TWO, None, 1),
        "shift_comparison_tz": _shifts(_THREE, "America/Chicago", 2),
        "shift_comparison_gaps": _shifts(_PARTIAL, None, 1, _DAYS),
        "shift_occurrences": f"""{one}, s as (select *, {_shift_case(_minute("t_start", "America/Chicago"), _THREE)} as shift from rec), d as (select *, case when shift = lag(shift) over (order by record_index) then 0 else 1 end as new from s), g as (select *, sum(new) over (order by record_index) as g from d)
select session_id, shift, shift || ' ' || strftime(timezone('America/Chicago', timezone('UTC', arg_min(t_start, record_index))), '%Y-%m-%d') as label, min(record_index) as lo, max(record_index) + 1 as hi, epoch_us(arg_min(t_start, record_index)) as t_start, epoch_us(arg_max(t_end, record_index)) as t_end from g group by session_id, shift, g""",
        "events_in_occurrence": f"""{ev}, s as (select *, {_shift_case(_minute("t_start"), _THREE)} as shift from rec), d as (select *, case when shift = lag(shift) over (order by record_index) then 0 else 1 end as new from s), g as (select *, sum(new) over (order by record_index) as g from d),
oc as (select shift, shift || ' ' || strftime(min(t_start), '%Y-%m-%d') as label, min(t_start) as a, arg_max(t_end, record_index) as b from g group by shift, g) select id, kind, shift, label from ev join oc on ev.t_start >= a and ev.t_start < b""",
        "shift_coverage": f"""{days}, m as (select session_id, {_minute("t_start")} as m, count(*) as k from rec group by 1, 2), n as (select *, (m >= 300 and m < 750)::int + (m >= 720 and m < 1200)::int as n from m)
select session_id, count(*) as minutes, sum(k)::bigint as records, count(*) filter (where n = 0) as gap_minutes, coalesce(sum(k) filter (where n = 0), 0)::bigint as gap_records, count(*) filter (where n > 1) as overlap_minutes, coalesce(sum(k) filter (where n > 1), 0)::bigint as overlap_records from n group by 1""",
        "load_state_rows": f"""{days}, src as (select *, case when {_I} >= 50 then 'active' else 'standby' end as state, {_I} as im from rec), g as (select session_id, state, count(*) as records, count(*) filter (where {_FINITE_P}) as np, avg(P_total_avg_W) filter (where {_FINITE_P}) as pa, min(P_total_avg_W) filter (where {_FINITE_P}) as pn, max(P_total_avg_W) filter (where {_FINITE_P}) as px,
  avg(im) as ia, avg(S_total_avg_VA) as sa, avg(PF_total_avg) as pf, {_VSUM} / nullif({_VN}, 0) as va from src group by 1, 2), ht as {_hist(_pool("session_id, state", "V_THD_pct_{}_avg", 50.0), "session_id, state", {"t95": 0.95})},
every as (select session_id, state, n from (select session_id, count(*) as n from rec group by 1), (values ('active'), ('standby')) s(state))
select session_id, state, coalesce(records, 0) as records, round(coalesce(np, 0) / 3600.0, 6) as hours, round(coalesce(records, 0) * 100.0 / n, 6) as duty_pct, round(coalesce(pa / 1000 * (np / 3600.0), 0), 6) as "kWh", round(coalesce(pa / 1000, 0), 6) as "P_avg_kW", round(coalesce(pn / 1000, 0), 6) as "P_min_kW", round(coalesce(px / 1000, 0), 6) as "P_max_kW",
  round(coalesce(ia, 0), 6) as "I_avg_A", round(coalesce(sa / 1000, 0), 6) as "S_avg_kVA", round(coalesce(pf, 0), 6) as "PF_avg", round(coalesce(va, 0), 6) as "V_LN_avg_V", round(coalesce(t95, 0), 6) as "V_THD_p95_pct" from every left join g using (session_id, state) left join ht using (session_id, state)""",
        "demand_peak": f"""{days}, d as (select *, row_number() over x as k, sum(case when {_FINITE_P} then P_total_avg_W else 0 end) over (x rows between 119 preceding and current row) / 120 as d, first_value(t_start) over (x rows between 119 preceding and current row) as ts from rec window x as (partition by session_id order by record_index)),
f as (select * from d where k >= 120), p as (select session_id, (list({{'d': round(d, 6), 's': ts, 'e': t_end}} order by round(d, 6) desc, record_index))[1] as b, avg(d) as m, count(*) as n from f group by 1)
select session_id, 120 as window_secs, b.d as peak_demand_w, round(b.d / 1000, 6) as peak_demand_kw, epoch_us(b.s) as peak_window_start, epoch_us(b.e) as peak_window_end, round(m, 6) as mean_demand_w, n as n_windows from p""",
        "demand_series": f"""{one}, d as (select *, sum(case when {_FINITE_P} then P_total_avg_W else 0 end) over (order by record_index rows between 89 preceding and current row) / 90 as d from rec) select session_id, epoch_us(t_end) as t, round(d, 6) as demand_w from d where record_index >= 89 and (record_index - 89) % 90 = 0""",
        "rolling_stdev": f"""{one}, p as (select record_index, case when {_FINITE_P} then P_total_avg_W else 0 end as p from rec), d as (select record_index, avg(p) over x as m, stddev_pop(p) over x as s from p window x as (order by record_index rows between 59 preceding and current row))
select record_index, case when record_index >= 59 then round(m, 6) end as mean_w, case when record_index >= 59 then round(s, 3) end as stdev_w from d""",
        "snapshot_candidates": f"""{ev}, w as (select record_index, first_value(t_start) over (order by record_index rows between 19 preceding and current row) as ws, t_end as we from rec) select record_index, epoch_us(ws) as t_start, epoch_us(we) as t_end from w where record_index >= 19 and not exists (select 1 from ev where not (we < ev.t_start or ws > ev.t_end))""",
        "marker_nearest": f"""{ev}, mk as (select ts + interval 30 minute as t, 'm' || event_id as label from events), x as (select t, label, id, kind, t_start, row_number() over (partition by label order by abs(epoch_us(t) - epoch_us(t_start)), id) as k from mk, ev)
select epoch_us(t) as marker_time, label, id as event_id, kind as event_kind, epoch_us(t_start) as event_start, round({_secs("t_start", "t")}, 6) as offset_secs from x where k = 1""",
        "outage_signature": f"""{ev}, {_signature(1800)}
select session_id, id as outage_id, epoch_us(t_start) as t_start, cast(floor({_secs("t_start", "t_end")}) as bigint) as duration_s, l.id as lead_dip_id, round(l.severity, 6) as lead_dip_severity, l.phases as lead_dip_phases, h.id as inrush_id, round(h.severity, 6) as inrush_a, h.phases as inrush_phase,
  t.id as trail_dip_id, t.phases as trail_dip_phases, case when floor({_secs("t_start", "t_end")}) >= 60 then 'alert' else 'warn' end as severity from j""",
        "steps_with_frequency": f"{ev}, {_STIFF} select id, round(severity, 6) as severity, round(dev, 6) as max_dev_hz from st where dev > 0.05",
        "phase_asymmetry": f"{days}, {_FACTS} select session_id, round(ma, 6) as mean_a_v, round(mb, 6) as mean_b_v, round(mc, 6) as mean_c_v, round((ma + mb + mc) / 3, 6) as mean_v, round((greatest(ma, mb, mc) - least(ma, mb, mc)) / ((ma + mb + mc) / 3) * 100, 6) as spread_pct from facts",
        "pf_drift": f"""{days}, l as (select *, {_ON} and abs(PF_total_avg) > 0 and abs(PF_total_avg) < 0.85 as low from rec) select session_id, round(count(*) filter (where low) / count(*)::double, 6) as low_fraction, round(avg(abs(Q_total_avg_VAR)) filter (where low) / 1000, 6) as mean_kvar, round(avg(abs(S_total_avg_VA)) filter (where low) / 1000, 6) as mean_kva from l group by 1""",
        "imbalance_sustained": f"""{one}, m as (select record_index as ix, {_IMB} as p from rec where {_ON} and {_IMB} > 1.5), g as (select *, ix - row_number() over (order by ix) as g from m) select 0 as session_id, min(ix) as lo, max(ix) as hi, round(max(p), 6) as peak_pct from g group by g having count(*) >= 60""",
        "freq_source_stiffness": f"{ev}, {_STIFF} select 0 as session_id, 'freq_source_stiffness' as kind, 'warn' as severity, '' as subject, count(*)::double as value, string_agg(id::varchar, '/' order by id) as related_event_ids from st where dev > 0.05 having count(*) >= 3",
        "outage_frequency": f"""{ev}, d as (select {_secs("arg_min(t_start, record_index)", "arg_max(t_end, record_index)")} / 86400 as days from rec), n as (select count(*) as n, string_agg(id::varchar, '/' order by id) as ids from ev where kind = 'outage')
select 0 as session_id, 'outage_frequency' as kind, case when n / days >= 2 then 'alert' else 'warn' end as severity, '' as subject, round(n / days, 6) as value, ids as related_event_ids from d, n where n / days >= 1""",
        "current_spike_ratio": f"{days}, " + "i as (" + " union all ".join(f"select session_id, '{p}' as phase, avg(I_{p}_max_A) as m, max(I_{p}_max_A) as x from rec where {_ON} group by 1" for p in "abc") + ") select session_id, phase, round(m, 6) as mean_a, round(x, 6) as peak_a, round(x / m, 6) as ratio from i where m > 0",
        "breaker_context": f"{one}, " + "i as (" + " union all ".join(f"select '{p}' as phase, avg(I_{p}_max_A) as m, max(I_{p}_max_A) as x from rec where {_ON}" for p in "abc") + ") select 0 as session_id, 'current_spike_ratio' as kind, case when x / 5000 * 100 > 100 then 'alert' when x / 5000 * 100 > 80 then 'warn' else 'info' end as severity, upper(phase) as subject, round(x / m, 6) as value, '' as related_event_ids from i where x / m >= 5",
        "breaker_margin": f"{one}, " + "i as (" + " union all ".join(f"select '{p}' as phase, max(I_{p}_max_A) as x from rec where {_ON}" for p in "abc") + ") select 0 as session_id, 'breaker_margin' as kind, 'alert' as severity, upper(phase) as subject, round(x, 6) as value, '' as related_event_ids from i where x > 1200 order by x desc, phase desc limit 1",
        "stitch_sources": f"""{days}, s as (select session_id as source, arg_min(t_start, record_index) as a, arg_max(t_end, record_index) as b, count(*) as n from rec group by 1) select source, row_number() over w - 1 as place, epoch_us(a) as first_start, epoch_us(b) as last_end, n as records, cast(sum(n) over w - n as bigint) as lo, cast(sum(n) over w as bigint) as hi from s window w as (order by a, source)""",
        "stitch": f"{days} select row_number() over (order by t_start) - 1 as record_index, session_id as source, epoch_us(t_start) as t_start from rec",
        "stitch_gaps": f"""{days}, s as (select session_id as source, min(t_start) as a, max(t_end) as b from rec group by 1), g as (select source, a, lag(source) over (order by a) as p, lag(b) over (order by a) as pb from s) select p as after, source as before, epoch_us(pb) as gap_start, epoch_us(a) as gap_end, round({_secs("pb", "a")}, 6) as gap_s from g where abs({_secs("pb", "a")}) > 2""",
        "voltage_drift": f"{days}, {_FACTS} " + _fit("select days as x, phase, case phase when 'a' then ma when 'b' then mb else mc end as y from fx, (values ('a'), ('b'), ('c')) p(phase)", "phase"),
        "recurring_outages": f"{evd} select {_minute('t_start')} // 15 * 15 as bucket_min, count(*) as outages, count(distinct session_id) as sessions_hit, string_agg(distinct session_id::varchar, '/' order by session_id::varchar) as labels from ev where kind = 'outage' group by 1",
        "pf_degradation": f"{days}, {_FACTS} " + _fit("select 0 as k, days as x, low as y from fx", "k"),
        "stiffness_emergence": f"{evd}, {_FACTS}, {_STIFF}, sf as (select session_id from st where dev > 0.05 group by 1 having count(*) >= 3), p as (select session_id, row_number() over (order by t_first) - 1 as p, count(*) over () // 2 as half from facts) select max(half) as half, count(*) as sessions, count(*) filter (where p < half and sf.session_id is not null) as older_stiff, count(*) filter (where p >= half and sf.session_id is not null) as newer_stiff from p left join sf using (session_id)",
        "event_trend": f"{evd}, {_FACTS} " + _fit("select k.kind, days as x, (select count(*) from ev e where e.session_id = fx.session_id and e.kind = k.kind)::double as y from fx, (select distinct kind from ev) k", "kind"),
    }
    o |= _sources(one, days, ev)
    pick = "select {k} as id, c.* from c where {near} order by round(sd, 6), record_index limit 1"
    far = "abs(epoch_us(c.ce) - (select epoch_us(ce) from {p})) >= 86400000000"
    o["quiet_snapshots"] = f"""{ev}, x as (select record_index, first_value(t_start) over v as ws, t_end as we, stddev_pop(case when {_FINITE_P} then P_total_avg_W else 0 end) over v as sd from rec window v as (order by record_index rows between 19 preceding and current row)),
c as (select *, ws + to_microseconds((epoch_us(we) - epoch_us(ws)) // 2) as ce from x where record_index >= 19 and not exists (select 1 from ev where not (we < ev.t_start or ws > ev.t_end))),
p0 as ({pick.format(k=0, near="true")}), p1 as ({pick.format(k=1, near=far.format(p="p0"))}), p2 as ({pick.format(k=2, near=far.format(p="p0") + " and " + far.format(p="p1"))})
select 0 as session_id, id, epoch_us(ws) as t_start, epoch_us(we) as t_end, epoch_us(ce) as t_center, round(sd, 3) as p_total_stdev_w from (select * from p0 union all select * from p1 union all select * from p2)"""
    rank = "case severity when 'alert' then 0 when 'warn' then 1 else 2 end"
    spikes = " union all ".join(f"select '{p}' as phase, avg(I_{p}_max_A) as m, max(I_{p}_max_A) as x from rec where {_ON}" for p in "abc")
    o["findings"] = f"""{one}, {_events(step=1.5)}, {_signature(600)}, {_FACTS}, {_STIFF}, asy as (select *, (greatest(ma, mb, mc) - least(ma, mb, mc)) / ((ma + mb + mc) / 3) * 100 as pct from facts), lo as (select count(*) filter (where {_ON} and abs(PF_total_avg) > 0 and abs(PF_total_avg) < 0.85) / count(*)::double as f from rec),
im as (select min(ix) as lo, max(ix) as hi from (select ix, ix - row_number() over (order by ix) as g from (select record_index as ix from rec where {_ON} and {_IMB} > 1.5)) group by g having count(*) >= 60), rate as (select (select count(*) from ev where kind = 'outage') / (select {_secs("arg_min(t_start, record_index)", "arg_max(t_end, record_index)")} / 86400 from rec) as r), sp as ({spikes}),
f as (select 'outage_signature' as kind, case when floor({_secs("t_start", "t_end")}) >= 60 then 'alert' else 'warn' end as severity, strftime(t_start, '%Y-%m-%dT%H:%M:%S') as subject, floor({_secs("t_start", "t_end")}) as value, concat_ws('/', id, l.id, h.id, t.id) as ids from j
union all select 'phase_asymmetry', case when pct >= 3 then 'alert' else 'warn' end, case greatest(ma, mb, mc) when ma then 'A' when mb then 'B' else 'C' end, pct, '' from asy where pct >= 2 union all select 'pf_drift', case when f < 0.3 then 'warn' else 'alert' end, '', f, '' from lo where f >= 0.1
union all select 'imbalance_sustained', 'warn', '', sum(hi - lo + 1)::double, '' from im having count(*) > 0 union all select 'freq_source_stiffness', 'warn', '', count(*)::double, string_agg(id::varchar, '/' order by id) from st where dev > 0.05 having count(*) >= 3
union all select 'outage_frequency', case when r >= 2 then 'alert' else 'warn' end, '', r, (select string_agg(id::varchar, '/' order by id) from ev where kind = 'outage') from rate where r >= 1 union all select 'current_spike_ratio', 'info', upper(phase), x / m, '' from sp where x / m >= 5)
select 0 as session_id, kind, severity, subject, round(value, 6) as value, ids as related_event_ids, row_number() over (order by {rank}, kind, subject) - 1 as id from f"""
    v = _fit("select days as x, phase, case phase when 'a' then ma when 'b' then mb else mc end as y from fx, (values ('a'), ('b'), ('c')) p(phase)", "phase")
    o["compare_findings"] = f"""{evd}, {_FACTS}, {_STIFF}, sf as (select session_id from st where dev > 0.05 group by 1 having count(*) >= 3), hv as (select session_id, row_number() over (order by t_first) - 1 as p, count(*) over () // 2 as half from facts), hs as (select max(half) as half, count(*) filter (where p < half and sf.session_id is not null) as a, count(*) filter (where p >= half and sf.session_id is not null) as b from hv left join sf using (session_id)),
ot as (select {_minute("t_start")} // 15 * 15 as b, count(distinct session_id) as n, string_agg(distinct session_id::varchar, '/' order by session_id::varchar) as labels from ev where kind = 'outage' group by 1 having count(distinct session_id) >= 2), vt as ({v}), pt as ({_fit("select 0 as k, days as x, low as y from fx", "k")}), et as ({_fit("select k.kind, days as x, (select count(*) from ev e where e.session_id = fx.session_id and e.kind = k.kind)::double as y from fx, (select distinct kind from ev) k", "kind")}),
f as (select 'voltage_drift' as kind, case when abs(slope) >= 0.0002 then 'alert' else 'warn' end as severity, upper(phase) as subject, slope as value, '' as labels from vt where abs(slope) >= 0.0001
union all select 'recurring_outages', case when n < (select count(*) from facts) then 'warn' else 'alert' end, printf('%02d:%02d', b // 60, b % 60), n::double, labels from ot union all select 'pf_degradation', 'warn', '', slope, '' from pt where n >= 3 and r >= 0.5 and slope > 0
union all select 'source_stiffness_emergence', 'warn', '', b::double, '' from hs where half > 0 and a = 0 and b > 0 union all select 'event_trend_' || kind, case when slope > 0 then 'warn' else 'info' end, kind, slope, '' from et where n >= 3 and total >= 2 and abs(r) >= 0.2 and abs(slope) >= 0.01)
select kind, severity, subject, round(value, 6) as value, labels as session_labels, row_number() over (order by {rank}, kind, subject) - 1 as id from f"""
    for name, flip in (("ct_reversal", ""), ("ct_reversal_flipped", "-")):
        o[name] = f"""with {_DAYS if not flip else _ONE}, r as (select session_id, {_ON} as o, {_I} >= 50 as a, {flip}P_total_avg_W as p, not isnan(P_total_avg_W) as f from rec), g as (select session_id, count(*) filter (where o) as non_outage_records, count(*) filter (where o and f and p < 0) as negative_records, coalesce(avg(p) filter (where o and f), 0) as mp,
  count(*) filter (where o and a) as active_records, count(*) filter (where o and a and f and p < 0) as active_negative_records, coalesce(avg(p) filter (where o and a and f), 0) as amp from r group by 1), h as (select *, coalesce(negative_records / nullif(non_outage_records, 0)::double, 0) as fn, coalesce(active_negative_records / nullif(active_records, 0)::double, 0) as afn from g)
select session_id, non_outage_records, negative_records, round(mp, 6) as mean_p_w, active_records, active_negative_records, round(amp, 6) as active_mean_p_w, round(fn, 6) as frac_negative, round(afn, 6) as active_frac_negative, case when active_records > 0 then 'active' else 'whole_session' end as basis, case when active_records > 0 then afn else fn end >= 0.5 as reversed from h"""
    return o
