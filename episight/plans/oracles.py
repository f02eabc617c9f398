"""The catalog's queries as DuckDB SQL, written from the definitions and not
from the Spark plans."""

from __future__ import annotations

EV = """ev as (
  select user_id as ep, row_number() over (partition by user_id order by ts, event_id) - 1 as step, epoch_us(ts) / 1e6 as t,
    value as a0, cast(json_extract_string(props, '$.k') as double) as s0 from events
)"""

LI = """li as (
  select l_suppkey as ep, row_number() over w - 1 as step, (row_number() over w - 1) * 0.02 as t,
    l_quantity as a0, l_extendedprice as a1, l_discount as a2, l_tax as a3, l_returnflag from lineitem
  window w as (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)
)"""

LONG = "lw as (select ep, step, dim, value from (select ep, step, a0, a1, a2, a3 from li) unpivot (value for dim in (a0, a1, a2, a3)))"

TIMING = """d as (
  select *, t - lag(t) over (partition by ep order by step) as dt from ev
), dm as (
  select *, median(dt) over (partition by ep) as mid from d
), timing as (
  select ep, count(*) as n_steps,
    case when count(*) >= 3 and avg(dt) > 0 then stddev_pop(dt) / avg(dt) end as jitter_cv,
    case when count(*) >= 3 and any_value(mid) > 0 then avg(case when dt is not null then (dt > 3 * mid)::int end) else 0.0 end as dropout,
    coalesce(bool_or(dt <= 0), false) as non_monotonic
  from dm group by ep
)"""


def motion(source: str, dims: tuple[str, ...], name: str = "motion") -> str:
    """CTEs up to ``name`` (ep, n_steps, spike_rate, disc_rate)."""
    d1 = ", ".join(f"{c} - lag({c}) over w as {c}1" for c in dims)
    d2 = ", ".join(f"{c}1 - lag({c}1) over w as {c}2" for c in dims)
    d3 = ", ".join(f"{c}2 - lag({c}2) over w as {c}3" for c in dims)
    n = lambda k: "sqrt(" + " + ".join(f"{c}{k} * {c}{k}" for c in dims) + ")"
    return f"""m1 as (select *, {d1}, t - lag(t) over w as mdt from {source} window w as (partition by ep order by step)),
m2 as (select *, {d2} from m1 window w as (partition by ep order by step)),
m3 as (select *, {d3} from m2 window w as (partition by ep order by step)),
m4 as (select *, {n(1)} as v, {n(2)} as dv, {n(3)} as j from m3),
m5 as (select *, median(j) over (partition by ep) as jm, max(v) over (partition by ep) as vm from m4),
{name} as (
  select ep, count(*) as n_steps,
    case when median(mdt) > 0 and count(*) >= 5 then case when any_value(jm) > 1e-12 then avg(case when j is not null then (j > 5 * jm)::int end) else 0.0 end end as spike_rate,
    case when median(mdt) > 0 and count(*) >= 3 then case when any_value(vm) > 1e-12 then avg(case when dv is not null then (dv > 0.2 * vm)::int end) else 0.0 end end as disc_rate
  from m5 group by ep
)"""


DIMS = ("a0", "a1", "a2", "a3")
FIGURES = f"""{EV}, {TIMING}, {motion('ev', ('a0',))}, ejerk as (
  select ep, count(*) as n, median(mdt) as dt, max_by(t, step) - min_by(t, step) as dur, max(v) as v, sum(j * j) as jj from m4 group by ep
), figures as (
  select t.ep, t.n_steps, jitter_cv, dropout, spike_rate, disc_rate,
    case when n >= 5 and dt > 0 and dur > 0 and v / dt > 1e-12 and jj > 0 then -ln(pow(dur, 3) / pow(v / dt, 2) * (jj / pow(dt, 6)) * dt) end as ldlj
  from timing t join motion using (ep) join ejerk using (ep)
)"""
METRICS = f"""{FIGURES}, m as (
  select ep, 'jitter_cv' as metric, jitter_cv as value from figures union all select ep, 'dropout', dropout from figures
  union all select ep, 'spike_rate', spike_rate from figures union all select ep, 'disc_rate', disc_rate from figures
), spread as (
  select metric, count(value) as n, median(value) as mid, stddev_pop(value) as dev from m group by metric
), spread2 as (
  select s.metric, s.n, s.mid, s.dev, median(abs(m.value - s.mid)) as mad from spread s join m using (metric) group by all
)"""
OUTLIERS = f"""{METRICS}, outl as (
  select ep, metric, value, (value - mid) / (case when mad < 1e-12 then dev else mad end) as deviation from m join spread2 using (metric)
  where value is not null and n >= 5 and (case when mad < 1e-12 then dev else mad end) >= 1e-12
), fired as (
  select ep, metric, value, abs(deviation) as deviation from outl where deviation > 3 and (metric <> 'jitter_cv' or value >= 0.01)
)"""
RANKS = f"""{METRICS}, ranks as (
  select ep, metric, case when value is not null and cnt >= 2 and range >= 1e-9 then upto::double / cnt end as rank from (
    select ep, metric, value, count(value) over (partition by metric) as cnt, max(value) over (partition by metric) - min(value) over (partition by metric) as range,
      count(value) over (partition by metric order by value nulls last range between unbounded preceding and current row) as upto from m)
), zs as (
  select ep, metric, case when n >= 3 and s >= 1e-12 then abs(value - mid) / s end as z from (
    select *, case when mad * 1.4826 < 1e-12 then dev else mad * 1.4826 end as s from m join spread2 using (metric))
)"""
RISK = """risk as (
  select ep, round(0.35 * coalesce(least(spike_rate / 0.10, 1), 0) + 0.35 * coalesce(least(disc_rate / 0.25, 1), 0) + 0.20 * coalesce(least(dropout / 0.10, 1), 0)
    + 0.10 * coalesce(least(greatest((ldlj + 3) / -27, 0), 1), 0), 6) as quality_risk from figures
)"""
GATE = """lim as (
  select 0.25 * (1 + 2 * least(greatest((coalesce(avg(disc_rate), 0) / greatest(coalesce(avg(spike_rate), 0), 0.001) - 3) / 17, 0), 1)) as l from figures
), gate0 as (
  select ep, case when n_steps < 10 then 'length' else concat_ws(',', case when spike_rate > 0.10 then 'spike_rate' end, case when disc_rate > l then 'disc_rate' end,
    case when dropout > 0.10 then 'dropout' end, case when ldlj < -30 then 'ldlj' end) end as reasons, coalesce(spike_rate, disc_rate, dropout, ldlj) is not null as seen from figures, lim
), gate as (
  select ep, reasons, case when reasons <> '' then 'bad' when seen then 'clean' else 'not_evaluated' end as status from gate0
)"""
ASSESSED = f"""{RANKS}, {RISK}, assessed as (
  select ep, coalesce(max(case when (rank <= 0.1 or rank >= 0.9) and z >= 2.5 then abs(rank - 0.5) * 2 end), 0.0) as anomaly,
    sum(coalesce((rank <= 0.1 or rank >= 0.9)::int, 0))::bigint as n_reasons from ranks join zs using (ep, metric) group by ep
)"""
CONTACT = """c0 as (
  select *, (a3 - min(a3) over e) / nullif(max(a3) over e - min(a3) over e, 0) as x, max(a3) over e - min(a3) over e as rng,
    sqrt(pow(a0 - lag(a0) over o, 2) + pow(a1 - lag(a1) over o, 2) + pow(a2 - lag(a2) over o, 2)) as speed from li
  window e as (partition by ep), o as (partition by ep order by step)
), c1 as (
  select *, avg((coalesce(x, 0) > 0.7)::int) over e >= avg((coalesce(x, 0) < 0.3)::int) over e as ishigh, max(speed) over e as top from c0 window e as (partition by ep)
), c2 as (
  select *, rng >= 1e-8 and case when ishigh then x > 0.5 else x < 0.5 end as closed, coalesce(top > 0 and speed < 0.08 * top, false) as slow from c1
), c3 as (select *, closed or slow as contact from c2)"""
NEAR = """f0 as (
  select ep, avg(a0) as m0, avg(a1) as m1, avg(a2) as m2, avg(a3) as m3, stddev_pop(a0) as d0, stddev_pop(a1) as d1, stddev_pop(a2) as d2, stddev_pop(a3) as d3 from li group by ep
), f as (
  select ep, """ + ", ".join(f"case when max({c}) over () > min({c}) over () then ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) else 0.0 end as {c}" for c in ("m0", "m1", "m2", "m3", "d0", "d1", "d2", "d3")) + """ from f0
), nn as (
  select ep, min_by(j, (dd, j)) as neighbour, sqrt(min(dd)) / sqrt(8) as distance from (
    select a.ep, b.ep as j, """ + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in ("m0", "m1", "m2", "m3", "d0", "d1", "d2", "d3")) + """ as dd from f a join f b on a.ep <> b.ep) group by ep
)"""
TENT = """tb as (
  select ep, dim, value, min(value) over (partition by ep, dim) as lo, max(value) over (partition by ep, dim) as hi from lw
), tn as (
  select ep, dim, case when hi > lo then least(floor((value - lo) / ((hi - lo) / 20)), 19) else 0 end as bin, count(*) as n from tb group by all
), tp as (select ep, dim, n / sum(n) over (partition by ep, dim) as p from tn),
te as (select ep, avg(bits) as entropy from (select ep, dim, -sum(p * log2(p)) + 0.0 as bits from tp group by ep, dim) group by ep)"""
CFRAC = "cf as (select ep, case when count(*) >= 2 then avg(contact::int) else 0.0 end as contact from c3 group by ep)"
INFL = f"""{LI}, {LONG}, {NEAR}, {TENT}, {CONTACT}, {CFRAC}, i0 as (
  select ep, distance as novelty, entropy, contact from nn join te using (ep) join cf using (ep)
), infl as (
  select ep, 0.4 * s(novelty) + 0.3 * s(entropy) + 0.3 * s(contact) as influence from i0
)"""
for _c in ("novelty", "entropy", "contact"):
    INFL = INFL.replace(f"s({_c})", f"(case when max({_c}) over () > min({_c}) over () then ({_c} - min({_c}) over ()) / (max({_c}) over () - min({_c}) over ()) else 1.0 end)")
LENGTHS = "ol as (select l_orderkey as ep, count(*) as n_steps from lineitem group by 1)"
HALVES = f"""{LI}, {LONG}, hw as (
  select l.dim, l.value, li.l_returnflag = 'R' as a from lw l join li using (ep, step)
), hr as (select *, min(value) over (partition by dim) as lo, max(value) over (partition by dim) as hi from hw)"""


def binned(bins: int) -> str:
    return f"""hb as (
  select dim, case when hi > lo then least(floor((value - lo) / ((hi - lo) / {bins})), {bins - 1}) else 0 end as bin, sum(a::int) as na, sum((not a)::int) as nb from hr group by all
)"""


SUMMARY = f"""{FIGURES}, f1 as (
  select avg(jitter_cv) as jitter_cv, avg(dropout) as dropout, avg(spike_rate) as spike_rate, avg(disc_rate) as disc_rate from figures
), dev as (select case when stddev_pop(a0) = 0 then 1 else stddev_pop(a0) end as d from ev),
ad0 as (
  select ep, a0, abs(lead(s0) over (partition by ep order by step) - s0) as ds, stddev_pop(s0) over (partition by ep) as own from ev
), ad as (
  select ep, avg(case when ds is not null then (abs(a0) < 0.05 * d and ds > 0.05 * case when own = 0 then 1 else own end)::int end) as action_dropout from ad0, dev group by ep having count(*) >= 2
), eb as (
  select case when hi > lo then least(floor((a0 - lo) / ((hi - lo) / 50)), 49) else 0 end as bin, count(*) as n from ev, (select min(a0) as lo, max(a0) as hi from ev) group by 1
), ent as (select -sum(p * log2(p)) + 0.0 as entropy from (select n / sum(n) over () as p from eb)),
el as (select ep, count(*) as n_steps from ev group by ep),
lc as (select case when avg(n_steps) > 0 then stddev_pop(n_steps) / avg(n_steps) else 0 end as length_cv from el),
sf as (
  select avg((n_steps < fence)::int) as short_fraction from el, (
    select quantile_cont(n_steps, 0.25) - 1.5 * greatest(quantile_cont(n_steps, 0.75) - quantile_cont(n_steps, 0.25), 0.25 * median(n_steps)) as fence from el)
), em as (select ep, avg(a0) as x from ev group by ep), eh as (select x, x > (select median(x) from em) as high from em),
sp as (select 1 - (select sum(v) from (select var_pop(x) * count(*) as v from eh group by high)) / (select var_pop(x) * count(*) from eh) as separation),
summary as (
  select f1.*, (select avg(action_dropout) from ad) as action_dropout, entropy, length_cv, short_fraction, separation from f1, ent, lc, sf, sp
)"""
FLAGS = f"""{SUMMARY}, fl as (
  select metric, value, case when value >= crit then 'CRITICAL' when value >= warn then 'WARNING' else 'OK' end as level from (
    select 'jitter_cv' as metric, jitter_cv as value, 0.15 as warn, 0.30 as crit from summary union all select 'dropout', dropout, 0.01, 0.05 from summary
    union all select 'spike_rate', spike_rate, 0.02, 0.05 from summary union all select 'disc_rate', disc_rate, 0.02, 0.05 from summary
    union all select 'action_dropout', action_dropout, 0.05, 0.15 from summary) where value is not null
)"""


def ramp(c: str, a: float, b: float) -> str:
    return f"coalesce(least(greatest(({c} - {a}) / ({b} - {a}), 0), 1), 0)"


def penalty(c: str, w: float, k: float, a: float, b: float) -> str:
    s = 1 if b > a else -1
    x = f"({s} * ({c} - ({a})) / {abs(b - a)})"
    return f"coalesce(case when {x} >= 1 then {k} when {x} >= 0 then {w} + ({k} - {w}) * {x} end, 0)"


def outcome(source: str, rules: dict[str, tuple[float, float, float, float]]) -> str:
    p = [penalty(c, *v) for c, v in rules.items()]
    return f"""o0 as (
  select greatest(100.0 - ({' + '.join(p)}), 0) as s, {' + '.join(f'({x} > 0)::int' for x in p)} as n from {source}
)
select round(s, 1) as score, case when s >= 80 then 'STRONG' when s >= 60 then 'GOOD' when s >= 40 then 'MARGINAL' when s >= 20 then 'RISKY' else 'UNLIKELY' end as tier, n::int as n_deductions,
  round(greatest(s - least(5 + 2.0 * n, 15), 0), 1) as low, round(least(s + least(5 + 2.0 * n, 15), 100), 1) as high from o0"""


PAIRS = r"""tu as (
  select conv_id, turn, text as instruction, lead(role) over w as nr, role, lead(text) over w as output from conversations window w as (partition by conv_id order by turn)
), pr as (select conv_id, turn, output from tu where role = 'user' and nr = 'assistant')"""


def fingerprint(source: str) -> str:
    opener = r"^(sure,?\s+here(?:''s| is| are)\b|of course[,!]|certainly[,!]|as an ai\b|i''?d be happy to\b|great[,!]\s+here\b|absolutely[,!]|thanks for asking\b|no problem[,!]|i\s+hope\s+this\s+helps\b|hello[,!]|hi[,!]\s+there\b)"
    return rf"""fw as (
  select *, list_filter(regexp_split_to_array(coalesce(output, ''), '\s+'), lambda w: w <> '') as ws, list_filter(regexp_split_to_array(lower(coalesce(output, '')), '\s+'), lambda w: w <> '') as lw,
    regexp_extract(trim(coalesce(output, '')), '{opener}', 1, 'i') as op from {source}
), fp as (
  select * exclude (ws, lw, op, output), case when len(lw) < 4 then 0.0 else 1.0 - len(list_distinct(list_transform(range(1, len(lw)), lambda i: lw[i] || ' ' || lw[i + 1]))) / (len(lw) - 1) end as repetition,
    case when op = '' then 0.0 else len(list_filter(regexp_split_to_array(op, '\s+'), lambda w: w <> ''))::double / greatest(len(ws), 1) end as template, len(ws)::int as words from fw
), ft as (select *, repetition <= 0.40 and template <= 0.50 and words >= 5 as passed from fp)"""


def r(c: str, d: int = 6) -> str:
    return f"round({c}::double, {d}) + 0.0 as {c}"


SQL: dict[str, str] = {
    "episode_timing_metrics": f"with {EV}, {TIMING} select ep, n_steps, {r('jitter_cv')}, {r('dropout')}, non_monotonic from timing",
    "timing_flags": f"""with {EV}, {TIMING}, g as (select avg(jitter_cv) as jitter_cv, avg(dropout) as dropout from timing)
select {r('jitter_cv')}, {r('dropout')}, case when g.jitter_cv >= 0.30 then 'CRITICAL' when g.jitter_cv >= 0.15 then 'WARNING' else 'OK' end as jitter_level,
  case when g.dropout >= 0.05 then 'CRITICAL' when g.dropout >= 0.01 then 'WARNING' else 'OK' end as dropout_level from g""",
    "timing_grid_and_scale": f"""with {EV}, {TIMING}, g as (
  select ep, count(*) as n, max(abs(t - (t0 + step * mid))) as off, any_value(mid) as mid, median(case when dt > 0 then dt end) as median_dt
  from (select *, first_value(t) over (partition by ep order by step) as t0 from dm) group by ep
), c as (select median(median_dt) as centre from g)
select ep, case when n >= 3 then off <= 1e-3 * mid end as on_grid, {r('median_dt')}, coalesce(g.median_dt / centre > 10 or g.median_dt / centre < 0.1, false) as scale_outlier from g, c""",
    "frame_rate_stability": f"""with {EV}, {TIMING}, g as (
  select ep, count(*) as n_frames, case when count(*) < 2 then 0 else avg(case when dt > 0 then 1 / dt end) end as mean_fps, case when count(*) < 2 then 0 else stddev_pop(case when dt > 0 then 1 / dt end) end as std_fps from d group by ep
) select ep, n_frames, {r('mean_fps', 3)}, {r('std_fps', 3)} from g""",
    "clock_lag": f"""with {EV}, x as (select ep, ((t + a0 / 10000) - t) * 1000 as lag from ev), g as (
  select ep, avg(lag) as lag_mean_ms, stddev_pop(lag) as lag_std_ms, max(abs(lag)) as lag_max_ms, avg(case when lag is not null then (abs(lag) > 5)::int end) as misaligned from x group by ep
) select ep, {r('lag_mean_ms', 3)}, {r('lag_std_ms', 3)}, {r('lag_max_ms', 3)}, {r('misaligned', 3)} from g""",
    "action_dropout": f"with {SUMMARY} select ep, {r('action_dropout')} from ad",
    "event_motion": f"with {EV}, {motion('ev', ('a0',))} select ep, n_steps, {r('spike_rate')}, {r('disc_rate')} from motion",
    "line_motion": f"with {LI}, {motion('li', DIMS)} select ep, n_steps, {r('spike_rate')}, {r('disc_rate')} from motion",
    "velocity_discontinuity_filtered": f"""with {LI}, v as (
  select ep, step - 1 as i, """ + ", ".join(f"{c} - lag({c}) over w as {c}" for c in DIMS) + """ from li window w as (partition by ep order by step) qualify step > 0
), vn as (select *, count(*) over (partition by ep) as n from v),
s as (
  select x.ep, x.i, any_value(x.n) as n, """ + ", ".join(f"case when any_value(x.n) >= 5 then sum(y.{c}) / 5 else any_value(x.{c}) end as {c}" for c in DIMS) + """
  from vn x, range(-2, 3) o(k) join v y on y.ep = x.ep and y.i = least(greatest(x.i + o.k, 0), x.n - 1) group by x.ep, x.i
), t as (
  select ep, i, n, sqrt(""" + " + ".join(f"{c} * {c}" for c in DIMS) + """) as v, sqrt(""" + " + ".join(f"pow({c} - lag({c}) over w, 2)" for c in DIMS) + """) as dv from s window w as (partition by ep order by i)
), u as (select *, max(v) over (partition by ep) as vm from t),
g as (select ep, case when count(*) >= 2 then case when any_value(vm) > 1e-12 then avg(case when dv is not null then (dv > 0.2 * vm)::int end) else 0.0 end end as disc_rate from u group by ep)
select ep, """ + r("disc_rate") + " from g",
    "whole_episode_ldlj": f"""with {LI}, {motion('li', DIMS)}, g as (
  select ep, count(*) as n, median(mdt) as dt, max_by(t, step) - min_by(t, step) as dur, max(v) as v, sum(j * j) as jj from m4 group by ep
) select ep, round(case when n >= 5 and dt > 0 and dur > 0 and v / dt > 1e-12 and jj > 0 then -ln(pow(dur, 3) / pow(v / dt, 2) * (jj / pow(dt, 6)) * dt) end, 4) + 0.0 as ldlj from g""".replace("from m4", "from m4"),
    "action_state_divergence": f"with {EV}, g as (select ep, avg(abs(a0 - s0)) as divergence from ev group by ep) select ep, {r('divergence')} from g",
    "gripper_dims": f"""with {LI}, {LONG}, s as (select *, min(value) over (partition by dim) as lo, max(value) over (partition by dim) as hi, count(*) over (partition by dim) as n from lw),
x as (select dim, (value - lo) / (hi - lo) as x from s where hi - lo >= 1e-8 and n >= 10), g as (
  select dim, avg((x < 0.2 or x > 0.8)::int) as near_extremes, avg((x > 0.3 and x < 0.7)::int) as in_middle from x group by dim
) select dim, {r('near_extremes')}, {r('in_middle')}, g.near_extremes >= 0.65 and g.in_middle <= 0.10 as is_gripper from g""",
    "contact_fraction": f"with {LI}, {CONTACT}, {CFRAC} select ep, round(contact, 6) + 0.0 as contact_fraction from cf",
    "grasp_count": f"""with {LI}, {CONTACT}, g as (select ep, closed and not lag(closed) over (partition by ep order by step) as turn from c3)
select ep, case when count(*) >= 3 then sum(coalesce(turn, false)::int)::bigint end as grasps from g group by ep""",
    "phase_fractions": f"""with {LI}, {CONTACT}, v as (
  select ep, step, sum(contact::int) over (partition by ep order by step rows between 1 preceding and 1 following) / 3.0 >= 0.5 as voted from c3
), i as (select ep, step, step - row_number() over (partition by ep order by step) as g from v where voted),
ru as (select ep, min(step) as f, max(step) as l from i group by ep, g having count(*) >= 3),
e as (select ep, count(*) as n from li group by ep), p as (select e.ep, e.n, min(f) as f, max(l) as l from e left join ru using (ep) group by e.ep, e.n)
select ep, round(case when f is null or n < 2 then 1.0 else f / n end, 6) as approach, round(case when f is null or n < 2 then 0.0 else (l - f + 1) / n end, 6) as contact,
  round(case when f is null or n < 2 then 0.0 else (n - l - 1) / n end, 6) as retract from p""",
    "sustained_runs": f"""with {EV}, i as (select ep, step, step - row_number() over (partition by ep order by step) as g from ev where a0 > 20),
ru as (select ep, min(step) as f, max(step) as l, count(*) as k from i group by ep, g)
select e.ep, coalesce(max(k), 0) as longest, min(case when k >= 3 then f end) as first_run, max(case when k >= 3 then l end) as last_run from (select distinct ep from ev) e left join ru using (ep) group by e.ep""",
    "hold_offsets": f"""with {LI}, ho as (select ep, step, t, floor(a1 / 60000) + a2 as a0, 2 * floor(a1 / 60000) + a3 as a1, floor(a1 / 60000) as s0, 2 * floor(a1 / 60000) as s1 from li),
hs as (
  select *, coalesce(sqrt(pow(s0 - lag(s0) over w, 2) + pow(s1 - lag(s1) over w, 2)) < 0.05 * sqrt(2) * case when dev = 0 then 1 else dev end, false) as still from (
    select *, (stddev_pop(s0) over (partition by ep) + stddev_pop(s1) over (partition by ep)) / 2 as dev from ho) window w as (partition by ep order by step)
), hi as (select *, step - row_number() over (partition by ep order by step) as g from hs where still), hk as (select *, count(*) over (partition by ep, g) as run from hi)
select ep, 'a0' as dim, count(*) as n_hold, round(avg(a0 - s0), 9) + 0.0 as mean_offset, round(stddev_pop(a0 - s0), 9) + 0.0 as offset_std from hk where run >= 5 group by ep
union all select ep, 'a1', count(*), round(avg(a1 - s1), 9) + 0.0, round(stddev_pop(a1 - s1), 9) + 0.0 from hk where run >= 5 group by ep""",
    "cure_trim": f"""with {EV}, s as (select ep, step, (abs(a0 - lag(a0) over w) / greatest(t - lag(t) over w, 1e-5) + abs(s0 - lag(s0) over w) / greatest(t - lag(t) over w, 1e-5)) / 2 > 0.02 as mv from ev window w as (partition by ep order by step)),
g as (select ep, count(*) as n, min(case when mv then step - 1 end) as lo, max(case when mv then step - 1 end) as hi from s group by ep),
w as (select *, n < 5 or lo is null or least(hi + 3, n) - greatest(lo - 2, 0) <= 2 as whole from g)
select ep, n, (case when whole then 0 else greatest(lo - 2, 0) end)::bigint as start, (case when whole then n else least(hi + 3, n) end)::bigint as "end" from w""",
    "trajectory_entropy": f"with {LI}, {LONG}, {TENT} select ep, {r('entropy')} from te",
    "action_entropy": f"""with {LI}, {LONG}, s as (select dim, value, min(value) over (partition by dim) as lo, max(value) over (partition by dim) as hi from lw),
b as (select dim, case when hi > lo then least(floor((value - lo) / ((hi - lo) / 50)), 49) else 0 end as bin, count(*) as n from s group by all), p as (select dim, n / sum(n) over (partition by dim) as p from b)
select dim, round(-sum(p * log2(p)) + 0.0, 6) + 0.0 as bits from p group by dim""",
    "direction_entropy": f"""with {LI}, s as (
  select ep, step, """ + " || ',' || ".join(f"sign({c} - lag({c}) over w)::int" for c in DIMS) + """ as k from li window w as (partition by ep order by step)
), n as (select ep, k, count(*) as n from s where step > 0 group by ep, k), p as (select ep, n / sum(n) over (partition by ep) as p from n)
select ep, round(-sum(p * log2(p)) + 0.0, 6) + 0.0 as bits from p group by ep""",
    "episode_length_stats": f"""with {LENGTHS}, s as (select count(*) as n_episodes, avg(n_steps) as mean, stddev_pop(n_steps) as std from ol),
q as (select s.*, (select avg((abs(n_steps - s.mean) < 0.5 * s.std)::int) from ol) as near, case when mean > 0 then std / mean else 0 end as cv from s)
select n_episodes, {r('mean')}, {r('std')}, {r('near')}, {r('cv')}, n_episodes >= 6 and q.cv >= 0.3 and q.near < 0.15 as bimodal from q""",
    "short_episode_fence": f"""with {LENGTHS}, q as (select quantile_cont(n_steps, 0.25) as q1, median(n_steps) as m, quantile_cont(n_steps, 0.75) as q3 from ol),
f as (select q1, q3, q1 - 1.5 * greatest(q3 - q1, 0.25 * m) as fence from q)
select {r('q1')}, {r('q3')}, {r('fence')}, sum((n_steps < f.fence)::int)::bigint as n_short, round(avg((n_steps < f.fence)::int), 6) as short_fraction from ol, f group by all""",
    "episode_features": f"with {LI}, {NEAR} select ep, " + ", ".join(f"round({k}{i}, 5) + 0.0 as {k}_a{i}" for k in "md" for i in range(4)) + " from f",
    "nearest_neighbour": f"with {LI}, {NEAR} select ep, neighbour, {r('distance', 5)} from nn",
    "influence": f"with {INFL} select ep, {r('influence', 4)} from infl",
    "topk_influence": f"with {INFL}, k as (select * from infl order by influence desc, ep limit 20) select ep, {r('influence', 4)} from k",
    "topk_energy": f"""with {LI}, {motion('li', DIMS)}, c as (select quantile_cont(spike_rate, 0.9) as cut, count(*) as n from motion),
k as (select ep, disc_rate as energy, spike_rate as error from motion, c where n <= 10 or spike_rate <= cut order by disc_rate desc, ep limit 20) select ep, {r('energy')}, {r('error')} from k""",
    "diversity_scores": """select a.vec_id as ep, round(sqrt(min(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::double - p[2]::double, 2))))), 4) + 0.0 as distance
from embeddings a, embeddings b where b.vec_id < 20 group by a.vec_id""",
    "mad_outliers": f"with {OUTLIERS} select ep, metric, {r('value', 4)}, {r('deviation', 4)} from fired",
    "firing_rates": f"""with {OUTLIERS} select t.metric, coalesce(k, 0) as n_fired, round(coalesce(k, 0) / n, 6) + 0.0 as rate
from (select metric, count(*) as n from m group by metric) t left join (select metric, count(*) as k from fired group by metric) using (metric)""",
    "outlier_clusters": f"""with {OUTLIERS}, e as (select distinct ep from fired), g as (select ep, ep - row_number() over (order by ep) as g from e)
select min(ep) as first, max(ep) as last, count(*) as size from g group by g""",
    "percentile_ranks": f"with {RANKS} select ep, metric, {r('rank')} from ranks",
    "robust_z": f"with {RANKS} select ep, metric, {r('z', 4)} from zs",
    "episode_assessment": f"with {ASSESSED} select ep, {r('anomaly')}, n_reasons, {r('quality_risk')}, null::double as coverage_value from assessed join risk using (ep)",
    "review_queue": f"""with {ASSESSED}, p as (select ep, 0.5 * quality_risk + 0.5 * anomaly as priority from assessed join risk using (ep))
select ep, {r('priority')} from (select * from p order by round(priority, 9) desc, ep limit 20)""",
    "quality_risk": f"with {FIGURES}, {RISK} select ep, {r('quality_risk')} from risk",
    "quality_gate": f"with {FIGURES}, {GATE} select ep, reasons, status from gate",
    "curator_violations": f"""with {FIGURES}, v as (
  select ep, 'jitter_cv' as metric, jitter_cv as value, 0.9 as threshold, jitter_cv > 0.9 as bad from figures union all select ep, 'dropout', dropout, 0.05, dropout > 0.05 from figures
  union all select ep, 'spike_rate', spike_rate, 0.10, spike_rate > 0.10 from figures union all select ep, 'disc_rate', disc_rate, 0.5, disc_rate > 0.5 from figures
  union all select ep, 'n_steps', n_steps, 60, n_steps < 60 from figures
) select ep, metric, {r('value')}, {r('threshold')} from v where bad""",
    "dispositions": f"""with {FIGURES}, {GATE} select ep, case when status = 'bad' then 'drop' when status = 'not_evaluated' then 'review' when ep % 2 = 0 then 'keep' else 'drop' end as disposition from gate""",
    "annotation_manifest": f"""with {FIGURES}, {GATE}, x as (select case when status = 'bad' then 'drop' when status = 'not_evaluated' then 'review' when ep % 2 = 0 then 'keep' else 'drop' end as disposition from gate)
select disposition, count(*) as n from x group by 1""",
    "composite_score": f"""with {SUMMARY}, s as (
  select 25 - 8.5 * {ramp('jitter_cv', 0.05, 0.20)} - 8.5 * {ramp('dropout', 0.01, 0.05)} - 8.0 * {ramp('action_dropout', 0.05, 0.15)} as temporal,
    20 - 10 * {ramp('spike_rate', 0.02, 0.05)} - 10 * {ramp('disc_rate', 0.02, 0.05)} as smoothness,
    greatest(25 - coalesce(case when entropy <= 1.5 then 20 when entropy <= 2.5 then 20 * (2.5 - entropy) when entropy <= 4 then 10 * (4 - entropy) / 1.5 else 0 end, 0) - 5 * {ramp('length_cv', 0.2, 0.5)}, 0) as coverage,
    greatest(15 - 10 * greatest(1 - separation / 0.4, 0) - case when short_fraction > 0.05 then 5 * least(short_fraction / 0.2, 1) else 0 end, 0) as structure from summary
), g as (select *, (temporal / 25 + smoothness / 20) / 2 as gate from s), h as (select *, round((temporal + smoothness + (coverage + structure) * gate) / 85 * 100, 1) as total from g)
select {r('temporal', 4)}, {r('smoothness', 4)}, {r('coverage', 4)}, {r('structure', 4)}, {r('gate', 4)}, total, case when total >= 90 then 'Excellent' when total >= 75 then 'Good' when total >= 60 then 'Fair' when total >= 40 then 'Poor' else 'Critical' end as category from h""",
    "metric_flags": f"with {FLAGS} select metric, {r('value')}, level from fl",
    "rubric_grade": f"""with {FLAGS}, g as (select case when metric in ('spike_rate', 'disc_rate') then 'smoothness' else 'temporal' end as dimension,
  avg(case level when 'CRITICAL' then 30.0 when 'WARNING' then 65.0 when 'INFO' then 90.0 else 100.0 end) as score from fl group by 1)
select dimension, {r('score')}, case when g.score >= 90 then 'A' when g.score >= 80 then 'B' when g.score >= 70 then 'C' when g.score >= 60 then 'D' else 'F' end as grade from g""",
    "integrity_score": f"""with {FLAGS}, g as (select avg(case level when 'CRITICAL' then 0.0 when 'WARNING' then 0.5 else 1.0 end) * 100 as score from fl)
select {r('score')}, case when g.score >= 90 then 'pass' when g.score >= 70 then 'review' else 'fail' end as verdict from g""",
    "certification": f"""with {FLAGS}, g as (select sum((level = 'CRITICAL')::int)::bigint as n_critical, sum((level = 'WARNING')::int)::bigint as n_warning from fl)
select *, case when n_critical > 0 then 'NOT CERTIFIED' when n_warning > 0 then 'PROVISIONALLY CERTIFIED' else 'CERTIFIED' end as grade from g""",
    "regime_diagnosis": f"""with {SUMMARY} select case when coalesce(spike_rate, 0) < 0.025 and coalesce(disc_rate, 0) < 0.04 then 'low_noise' when coalesce(spike_rate, 0) >= 0.09 or coalesce(disc_rate, 0) >= 0.13 then 'high_noise' else 'moderate_noise' end as regime,
  round(0.5 * least(coalesce(spike_rate, 0) / 0.09, 1) + 0.35 * least(coalesce(disc_rate, 0) / 0.13, 1) + 0.15 * least(coalesce(dropout, 0) / 0.05, 1), 4) as noise_score from summary""",
    "outcome_prediction": f"with {SUMMARY}, " + outcome("summary", {"spike_rate": (8.0, 20.0, 0.02, 0.05), "disc_rate": (8.0, 20.0, 0.02, 0.05), "dropout": (7.0, 18.0, 0.01, 0.05), "jitter_cv": (5.0, 12.0, 0.05, 0.20), "entropy": (10.0, 20.0, 2.5, 1.5)}),
    "kl_marginals": f"""with {HALVES}, {binned(50)}, p as (select dim, na / sum(na) over (partition by dim) + 1e-10 as p, nb / sum(nb) over (partition by dim) + 1e-10 as q from hb)
select dim, round(sum(p * ln(p / q)), 5) + 0.0 as kl from p group by dim""",
    "coverage_overlap": f"with {HALVES}, {binned(20)} select dim, round(avg((na > 0)::int), 6) + 0.0 as overlap from hb where nb > 0 group by dim",
    "range_overlap": f"""with {HALVES}, g as (select dim, min(case when a then value end) as la, max(case when a then value end) as ha, min(case when not a then value end) as lb, max(case when not a then value end) as hb from hw group by dim)
select dim, round(case when greatest(ha, hb) > least(la, lb) then greatest(least(ha, hb) - greatest(la, lb), 0) / (greatest(ha, hb) - least(la, lb)) else 1.0 end, 6) + 0.0 as overlap from g""",
    "transfer_level": f"""with {HALVES}, {binned(20)}, o as (select dim, avg((na > 0)::int) as overlap from hb where nb > 0 group by dim), g as (select min(overlap) as overlap from o)
select {r('overlap')}, case when g.overlap >= 0.8 then 'COMPATIBLE' when g.overlap >= 0.5 then 'ADAPT' else 'INCOMPATIBLE' end as level from g""",
    "exact_leakage": """with t as (select text, min(doc_id) as doc_id from documents where source <> 'src0' group by text)
select d.doc_id as held_id, t.doc_id from documents d join t using (text) where d.source = 'src0'""",
    "duplicate_episodes": """select doc_id, original from (select doc_id, min(doc_id) over (partition by text) as original from documents where text is not null) where doc_id <> original""",
    "resampled_fingerprint": f"""with {EV}, n as (select ep, count(*) as n from ev group by ep), p as (select ep, n, i, i * (n - 1) / 31.0 as place from n, range(0, 32) r(i)),
q as (select *, case when i = 31 then n - 1 else least(floor(place)::bigint, n - 1) end as lo from p)
select q.ep, q.i::int as i, round(a.a0 + coalesce((b.a0 - a.a0) * (q.place - q.lo), 0), 5) + 0.0 as value from q join ev a on a.ep = q.ep and a.step = q.lo left join ev b on b.ep = q.ep and b.step = q.lo + 1""",
    "sft_gate": f"with {PAIRS}, {fingerprint('pr')} select conv_id, turn, {r('repetition')}, {r('template')}, words, passed from ft",
    "document_fingerprint": f"with pr as (select doc_id as conv_id, text as output from documents), {fingerprint('pr')} select conv_id, {r('repetition')}, {r('template')}, words, passed from ft",
    "sft_outcome": f"with {PAIRS}, {fingerprint('pr')}, ag as (select avg(repetition) as repetition, avg(template) as template, avg(words) as words from ft), " + outcome("ag", {"repetition": (10.0, 20.0, 0.25, 0.40), "template": (8.0, 18.0, 0.10, 0.30), "words": (10.0, 20.0, 15.0, 5.0)}),
    "wilson_interval": """with g as (select source, count(*) as n, sum(toxic)::bigint as k from labels join documents using (doc_id) group by source), p as (select *, k / n as p, 1.96 as z from g)
select source, n, k, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 0), 6) + 0.0 as low,
  round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 1), 6) + 0.0 as high from p""",
    "weighted_precision": """with x as (select quality = 0 as bad, n_chars < 1000 as fires, case when n_chars < 1000 then 1.0 else 4.0 end::double as w from labels join documents using (doc_id))
select round(sum(case when fires and bad then w else 0 end) / sum(case when fires then w else 0 end), 6) + 0.0 as precision, round(sum(case when fires and bad then w else 0 end) / sum(case when bad then w else 0 end), 6) + 0.0 as recall from x""",
    "episode_offsets": """with n as (select l_suppkey as old, count(*) as length from lineitem where l_suppkey % 3 <> 0 group by 1)
select old, row_number() over (order by old) - 1 as episode_index, length, (sum(length) over (order by old) - length)::bigint as first, (sum(length) over (order by old))::bigint as "end" from n""",
    "watch_verdicts": f"""with {FIGURES} select ep, case when coalesce(spike_rate >= 0.05, false) or coalesce(disc_rate >= 0.05, false) or coalesce(dropout >= 0.05, false) or coalesce(ldlj <= -15, false) then 'FAIL'
  when coalesce(spike_rate >= 0.02, false) or coalesce(disc_rate >= 0.02, false) or coalesce(dropout >= 0.01, false) or coalesce(ldlj <= -10, false) then 'WARN' else 'PASS' end as verdict,
  coalesce(case when spike_rate >= 0.05 then 'spike_rate' end, case when disc_rate >= 0.05 then 'disc_rate' end, case when dropout >= 0.05 then 'dropout' end, case when ldlj <= -15 then 'ldlj' end,
    case when spike_rate >= 0.02 then 'spike_rate' end, case when disc_rate >= 0.02 then 'disc_rate' end, case when dropout >= 0.01 then 'dropout' end, case when ldlj <= -10 then 'ldlj' end) as metric from figures""",
    "standalone_kinematics": f"""with {EV}, x1 as (select *, s0 - lag(s0) over w as d1 from ev window w as (partition by ep order by step)),
x2 as (select *, d1 - lag(d1) over w as d2 from x1 window w as (partition by ep order by step)), x3 as (select *, abs(d2 - lag(d2) over w) as j from x2 window w as (partition by ep order by step)),
x4 as (select *, avg(j) over (partition by ep) as jm, stddev_pop(j) over (partition by ep) as js from x3)
select ep, round(avg((abs(a0 - s0) > 0.05)::int), 6) + 0.0 as tracking_gap, round(case when max(js) > 0 then avg(case when j is not null then (j > jm + 5 * js)::int end) else 0 end, 6) + 0.0 as jerk_spikes from x4 group by ep""",
    "transition_dynamics": f"""with {EV}, x as (select *, lead(s0) over (partition by ep order by step) - s0 as ds from ev),
s as (select sum(s0 * s0) + 1e-4 as ss, sum(s0 * a0) as sa, sum(a0 * a0) + 1e-4 as aa, sum(s0 * ds) as sd, sum(a0 * ds) as ad from x where ds is not null),
f as (select (sd * aa - ad * sa) / (ss * aa - sa * sa) as ws, (ad * ss - sd * sa) / (ss * aa - sa * sa) as wa from s)
select ep, round(coalesce(avg(abs(ds - ws * s0 - wa * a0)), 0), 4) + 0.0 as error from x, f group by ep""",
    "failure_diagnosis": f"""with {LI}, ft as (select ep, {", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as d_{c}" for c in DIMS)} from li group by ep),
sc as (select ep, {", ".join(f"case when max({c}) over () > min({c}) over () then ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) else 0.0 end as {c}" for k in DIMS for c in (f"m_{k}", f"d_{k}"))} from ft),
ds as (select a.ep, sqrt({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for k in DIMS for c in (f"m_{k}", f"d_{k}"))}) as d from sc a, sc b where a.ep <> 1 and b.ep = 1),
g as (select min(d) as d, arg_min(ep, d) as nearest, sum((d < 0.15)::int)::bigint as n_close, sum((d < 0.30)::int)::bigint as n_near from ds)
select nearest, round(d, 5) + 0.0 as distance, n_close, n_near, case when n_close >= 3 then 'COVERED' when n_near >= 1 then 'PARTIAL' else 'MISSING' end as verdict,
  (case when n_close >= 3 then 0 when n_near >= 1 then greatest(0, 5 - n_close) else 8 end)::bigint as to_collect from g""",
    "cure_interpolate": f"""with {EV}, x as (select *, lead(t) over w as next_t, lead(a0) over w as nxt, min(t) over e as t0, max(t) over e as t1, count(*) over e as n from ev window w as (partition by ep order by step), e as (partition by ep)),
y as (select *, round_even((t1 - t0) * (1.0 / greatest((t1 - t0) / (n - 1), 1e-5)), 0)::bigint + 1 as m from x where n >= 2), z as (select *, (t1 - t0) / (m - 1) as every from y where m >= 2 and t1 > t0),
g as (select *, unnest(case when next_t is null then [m - 1] else range(ceil((t - t0) / every)::bigint, least(ceil((next_t - t0) / every)::bigint, m - 1)) end) as i from z where next_t is null or next_t > t)
select ep, i, round(case when next_t is null then a0 else a0 + (nxt - a0) * (t0 + i * every - t) / (next_t - t) end, 3) + 0.0 as value from g""",
    "corrupt_drop": f"""with {EV}, x as (select ep, step, row_number() over (partition by ep order by md5(ep || '|' || step || '|42'), step) as place, count(*) over (partition by ep) as n from ev)
select ep, step from x where place <= greatest(2, floor(n * (1.0 - 0.2)))""",
}

from .analysis_sql import SQL as _MORE  # noqa: E402  (it is built from the parts above)

SQL |= _MORE

from .extended_sql import SQL as _FURTHER  # noqa: E402

SQL |= _FURTHER

from .reporting_sql import SQL as _REPORTING  # noqa: E402

SQL |= _REPORTING
