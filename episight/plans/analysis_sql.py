"""DuckDB SQL of the queries in ``analysis``, written from the definitions."""

from __future__ import annotations

from .oracles import ASSESSED, CONTACT, DIMS, EV, FIGURES, FLAGS, GATE, HALVES, INFL, LI, LONG, METRICS, NEAR, OUTLIERS, RISK, SUMMARY, TENT, TIMING, binned, motion, outcome, penalty, r

FOLLOW = f"""{LI}, fo as (select *, {", ".join(f"coalesce(lag(a{k}) over (partition by ep order by step), a{k}) as s{k}" for k in range(4))} from li)"""
HOLD = f"""{LI}, ho as (select ep, step, t, floor(a1 / 60000) + a2 as a0, 2 * floor(a1 / 60000) + a3 as a1, floor(a1 / 60000) as s0, 2 * floor(a1 / 60000) as s1 from li),
hs as (
  select *, coalesce(sqrt(pow(s0 - lag(s0) over w, 2) + pow(s1 - lag(s1) over w, 2)) < 0.05 * sqrt(2) * case when dev = 0 then 1 else dev end, false) as still from (
    select *, (stddev_pop(s0) over (partition by ep) + stddev_pop(s1) over (partition by ep)) / 2 as dev from ho) window w as (partition by ep order by step)
), hi as (select *, step - row_number() over (partition by ep order by step) as g from hs where still),
hk as (select *, count(*) over (partition by ep, g) as run from hi), held as (select ep, step, a0 - s0 as off0, a1 - s1 as off1 from hk where run >= 5)"""
REPORTED = f"""{FLAGS}, fn as (select case metric when 'jitter_cv' then 'timestamp_jitter_cv' when 'dropout' then 'timestamp_dropout_rate' when 'spike_rate' then 'jerk_spike_rate'
  when 'disc_rate' then 'velocity_discontinuity_rate' else 'action_dropout_rate' end as metric, value, level from fl)"""
LDLJ_LI = f"""{motion('li', DIMS)}, lj0 as (
  select ep, count(*) as n, median(mdt) as dt, max_by(t, step) - min_by(t, step) as dur, max(v) as v, sum(j * j) as jj from m4 group by ep
), lj as (select ep, case when n >= 5 and dt > 0 and dur > 0 and v / dt > 1e-12 and jj > 0 then -ln(pow(dur, 3) / pow(v / dt, 2) * (jj / pow(dt, 6)) * dt) end as ldlj from lj0)"""
RATES = """dts as (select ep, t - lag(t) over (partition by ep order by step) as dt from li),
rt as (select ep, count(*) as n_steps, case when median(dt) > 0 then 1 / median(dt) end as hz, case when median(case when dt > 0 then dt end) > 0 then 1 / median(case when dt > 0 then dt end) end as hzf from dts group by ep)"""


def checks() -> str:
    rows = []
    spec = {"gr00t": (16, 0, 0.2, 15, 120, "INFO", "ghz"), "pi0": (50, 0.1, None, 10, 100, "WARNING", "mhz"), "openvla": (10, 0.05, None, 3, 30, "WARNING", "mhz"), "octo": (5, 0, 0.5, 5, 100, "WARNING", "mhz")}
    for p, (n, some, many, lo, hi, dim, hz) in spec.items():
        fine, bad = (0.99 if p == "gr00t" else 1.0), ("false" if p == "octo" else "lang < 0.5")
        worse = "false" if many is None else f"s{n} > {many}"
        rows += [
            f"select '{p}' as policy, 'visual' as \"check\", 1.0 as value, 'OK' as level from pc",
            f"select '{p}', 'language', lang, case when lang >= {fine} then 'OK' when {bad} then 'CRITICAL' else 'WARNING' end from pc",
            f"select '{p}', 'episode_length', s{n}, case when {worse} then 'CRITICAL' when s{n} > {some} then 'WARNING' else 'OK' end from pc",
            f"select '{p}', 'frequency', {hz}, case when {hz} is null then 'INFO' when {hz} between {lo} and {hi} then 'OK' else 'WARNING' end from pc",
            f"select '{p}', 'action_dim', 4, '{dim}' from pc",
        ]
    rows += [
        "select 'openvla', 'cameras', 3, 'WARNING' from pc", "select 'octo', 'cameras', 3, 'WARNING' from pc",
        "select 'octo', 'dataset_size', n, case when n < 50 then 'WARNING' else 'OK' end from pc",
        "select 'openvla', 'entropy', bits, case when bits < 2 then 'WARNING' else 'OK' end from pc, pb",
        "select 'pi0', 'ldlj', l, case when l < -15 then 'WARNING' else 'OK' end from pc, pl",
    ]
    return f"""{LI}, {LONG}, {RATES}, {LDLJ_LI}, pe as (select rt.*, s_name as task from rt left join (select * from supplier where s_acctbal > 0) on ep = s_suppkey),
pc as (select count(*) as n, avg((coalesce(trim(task), '') <> '')::int) as lang, median(hz) as ghz, avg(hzf) as mhz, {", ".join(f"avg((n_steps < {n})::int) as s{n}" for n in (16, 50, 10, 5))} from pe),
pl as (select avg(ldlj) as l from lj), ps as (select dim, value, min(value) over (partition by dim) as lo, max(value) over (partition by dim) as hi from lw),
pn as (select dim, case when hi > lo then least(floor((value - lo) / ((hi - lo) / 50)), 49) else 0 end as bin, count(*) as n from ps group by all),
pp as (select dim, n / sum(n) over (partition by dim) as p from pn), pb as (select avg(b) as bits from (select dim, -sum(p * log2(p)) as b from pp group by dim)),
ck as ({" union all ".join(rows)})"""


def near() -> str:
    return f"""{EV.replace("ev as", "ev0 as")}, ev as (select ep, step, t, a0, s0 from ev0 union all select ep + 1000, step, t, case when ep > 10 then a0 * 1.0001 else a0 end, s0 from ev0 where ep between 1 and 20), cnt as (select ep, count(*) as n from ev group by ep), pl as (select ep, n, i, i * (n - 1) / 31.0 as place from cnt, range(0, 32) q(i)),
lo as (select *, case when i = 31 then n - 1 else least(floor(place)::bigint, n - 1) end as k from pl),
fp as (select lo.ep, lo.i, a.a0 + coalesce((b.a0 - a.a0) * (place - k), 0) as x, a.s0 + coalesce((b.s0 - a.s0) * (place - k), 0) as y from lo join ev a on a.ep = lo.ep and a.step = k left join ev b on b.ep = lo.ep and b.step = k + 1),
sides as (select ep, string_agg(coalesce(a0::varchar, 'null') || ',' || coalesce(s0::varchar, 'null'), ';' order by step) as digest, (ep >= 0 and ep < 5) or ep = 33 or (ep >= 1000 and ep < 1030) as h from ev group by ep),
firsts as (select digest, min(ep) as train from sides where not h group by digest),
exact as (select ep as held, train from sides join firsts using (digest) where h),
st as (select avg(x) as mx, stddev_pop(x) as dx, avg(y) as my, stddev_pop(y) as dy from fp join sides using (ep) where not h),
sc as (select ep, i, (x - mx) / case when dx = 0 then 1 else dx end as x, (y - my) / case when dy = 0 then 1 else dy end as y from fp, st),
base as (select * from sc where ep in (select train from firsts)),
tt as (select ep, min(d) as d from (select a.ep, b.ep as j, sqrt(sum(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) / 8 as d from base a join base b on a.i = b.i and a.ep <> b.ep group by 1, 2) group by ep),
vt as (select held, min_by(j, (d, j)) as train, min(d) as distance from (select a.ep as held, b.ep as j, sqrt(sum(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) / 8 as d from sc a join base b on a.i = b.i where a.ep in (select ep from sides where h) group by 1, 2) group by held),
cuts as (select median(d) as mid, quantile_cont(d, 0.01) as low, count(*) as n from tt),
cl as (select held, train, case when distance <= 0.01 * mid then 'near_identical' when distance < low then 'suspicious' end as kind, distance, (select count(*) from tt where tt.d < vt.distance) / n as percentile from vt, cuts where held not in (select held from exact)),
pairs as (select held, train, 'exact' as kind, null::double as distance, null::double as percentile from exact union all select * from cl where kind is not null)"""


def det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def surprise() -> str:
    m = [["zz", "za", "sz"], ["za", "aa", "sa"], ["sz", "sa", "n1"]]
    y = ["zy", "ay", "sy"]
    w = [f"{det([[y[r] if c == k else m[r][c] for c in range(3)] for r in range(3)])} / {det(m)} as w{k}" for k in range(3)]
    return f"""tr as (select ep, a0, s0, lead(s0) over (partition by ep order by step) as s1 from ev), tq as (select * from tr where s1 is not null),
ts as (select avg(s0) as ms, greatest(stddev_pop(s0), 1e-8) as ds, avg(a0) as ma, greatest(stddev_pop(a0), 1e-8) as da from tq),
tn as (select ep, (s0 - ms) / ds as z_s0, (a0 - ma) / da as a_a0, (s1 - ms) / ds as n_s0 from tq, ts),
te_ as (select sum(z_s0 * z_s0) + 1e-3 as zz, sum(z_s0 * a_a0) as za, sum(a_a0 * a_a0) + 1e-3 as aa, sum(z_s0) as sz, sum(a_a0) as sa, count(*) + 1e-3 as n1, sum(z_s0 * n_s0) as zy, sum(a_a0 * n_s0) as ay, sum(n_s0) as sy from tn),
tw as (select {", ".join(w)} from te_),
tm as (select ep, avg(pow(n_s0 - w0 * z_s0 - w1 * a_a0 - w2, 2)) as e from tn, tw group by ep),
tf as (select c.ep, coalesce(e, 0) as e from (select distinct ep from ev) c left join tm using (ep)),
su as (select ep, case when max(e) over () > min(e) over () then (e - min(e) over ()) / (max(e) over () - min(e) over ()) else e end as surprise from tf)"""


VOX = "vx as (select distinct ep, round_even(z_s0 / 0.5, 0)::bigint as a, round_even(a_a0 / 0.5, 0)::bigint as b, round_even(n_s0 / 0.5, 0)::bigint as c from tn), vo as (select a, b, c, count(*) as n, min(ep) as ep from vx group by all), vn as (select ep, count(*) as k from vo where n = 1 group by ep), nov as (select e.ep, coalesce(k, 0) / (select count(*) from vo) as novelty from (select distinct ep from tn) e left join vn using (ep))"
GATE_LI = f"""{motion('li', DIMS)}, gl as (select 0.25 * (1 + 2 * least(greatest((coalesce(avg(disc_rate), 0) / greatest(coalesce(avg(spike_rate), 0), 0.001) - 3) / 17, 0), 1)) as l from motion),
gz as (select ep, case when n_steps < 10 then 'length' else concat_ws(',', case when spike_rate > 0.006 then 'spike_rate' end, case when disc_rate > l then 'disc_rate' end) end as reasons from motion, gl)"""


def two_stage(gate: str, bad: str, score: str, why: str, order: str = "score desc, ep") -> str:
    return f"""pa as (select g.ep, coalesce(s.score, 0) as score from {gate} g left join ({score}) s using (ep) where not ({bad})), kk as (select greatest(1, round_even(0.3 * (select count(*) from {gate}), 0)) as k),
rk as (select ep, row_number() over (order by {order}) as place from pa), ke as (select ep from rk, kk where place <= k or (select count(*) from pa) <= k)
select g.ep, case when {bad} then 'quality_fail' when ke.ep is not null then 'keep' else 'diversity_pruned' end as decision, case when {bad} then reasons when ke.ep is not null then '' else 'not_selected_{why}' end as reasons from {gate} g left join ke on ke.ep = g.ep"""


RECORDS = """rec as (
  select o_custkey % 40 as experiment_id, (o_orderkey % 4 + 1) * 25.0::double as retention_pct, case when o_orderkey % 4 = 3 then 'full' when o_orderpriority < '3' then 'selected' else 'random' end as condition,
    o_orderkey as recorded, o_totalprice / 600000 as success, o_orderstatus as embodiment from orders where o_orderkey % 3 <> 1
)"""
PROTOCOL = "pr as (select * from (values (100.0::double, 'full'), (75.0, 'random'), (75.0, 'selected'), (50.0, 'random'), (50.0, 'selected'), (25.0, 'random'), (25.0, 'selected')) t(retention_pct, condition))"
CAMERA = """cam as (
  select label::bigint as ep, row_number() over (partition by label order by vec_id) - 1 as step, list_transform(embedding, lambda x: x::double) as px from embeddings
), lap as (
  select ep, step, list_transform(flatten(list_transform(range(1, 7), lambda rr: list_transform(range(1, 7), lambda cc: rr * 8 + cc))), lambda i: px[i] + px[i + 2] + px[i - 7] + px[i + 9] - 4.0 * px[i + 1]) as l from cam
), sharp as (select ep, step, list_aggregate(l, 'var_pop') as sharpness from lap),
ct as (select *, lag(px) over (partition by ep order by step) as pv, case when max(list_max(px)) over (partition by ep) <= 1 then 255.0 else 1.0 end as sc from cam),
cd as (select ep, step, px[1] - pv[1] as da, list_transform(list_zip(px, pv), lambda p: abs(p[1] - p[2])) as ch, sc from ct where pv is not null)"""


def transit(tolerance: float, share: float) -> str:
    return f"{CAMERA}, tra as (select ep, step, list_avg(ch) as activity, len(list_filter(ch, lambda x: x * sc > {tolerance})) / 64 < {share} as repeated, abs(da) as motion from cd)"


def episode_frames(tolerance: float, share: float) -> str:
    return f"""{transit(tolerance, share)}, isl as (select ep, step - row_number() over (partition by ep order by step) as g from tra where repeated), mx as (select ep, max(n) as n from (select ep, g, count(*) as n from isl group by ep, g) group by ep),
ef as (select s.ep, s.sharpness, t.dup as duplicate_fraction, case when t.dup is not null then coalesce(mx.n, 0) end as freeze_run from (select ep, avg(sharpness) as sharpness from sharp group by ep) s left join (select ep, avg(repeated::int) as dup from tra group by ep) t using (ep) left join mx using (ep)),
bo as (select ep, sharpness, count(*) over () >= 4 and sharpness < quantile_cont(sharpness, 0.25) over () - 1.5 * (quantile_cont(sharpness, 0.75) over () - quantile_cont(sharpness, 0.25) over ()) as blurry from ef)"""


EGO = "eg as (select ep, case when count(*) >= 5 and stddev_pop(activity) >= 1e-9 and stddev_pop(motion) >= 1e-9 then corr(activity, motion) end as r from tra group by ep)"
LAGS = """zs as (
  select ep, row_number() over (partition by ep order by step) - 1 as i, count(*) over (partition by ep) as n, case when stddev_pop(motion) over (partition by ep) > 1e-9 then (motion - avg(motion) over (partition by ep)) / stddev_pop(motion) over (partition by ep) end as x,
    case when stddev_pop(activity) over (partition by ep) > 1e-9 then (activity - avg(activity) over (partition by ep)) / stddev_pop(activity) over (partition by ep) end as y from tra
), xc as (select a.ep, any_value(a.n) as n, a.i - b.i as k, sum(a.x * b.y) as v from zs a join zs b on a.ep = b.ep group by a.ep, a.i - b.i),
lg as (select ep, case when any_value(n) >= 3 and count(v) = count(*) then min_by(k, (-round(v, 9), k)) end as lag from xc group by ep)"""
U = lambda key: f"((('0x' || substr(md5({key}), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)"


def some(what: str, fraction: float = 0.3) -> str:
    """chosen (ep): so many episodes by a hash."""
    return f"""pick as (select ep, row_number() over (order by md5(ep || '|42|{what}'), ep) as place, count(*) over () as n from (select distinct ep from ev)), chosen as (select ep from pick where place <= greatest(1, floor(n * {fraction})))"""


def savgol() -> str:
    from ..operators.cure import polynomial_weights

    out = "v"
    for size in (3, 5, 7):
        fits = f"n >= {size}" if size == 7 else f"n in ({size}, {size + 1})"
        rows = "[" + ", ".join("[" + ", ".join(f"{x:.12f}" for x in row) + "]" for row in polynomial_weights(size)) + "]"
        first = f"least(greatest(step - {size // 2}, 0), n - {size})"
        out = f"case when {fits} then list_sum(list_transform(range(0, {size}), lambda k: ({rows}::double[][])[(step - {first} + 1)::int][(k + 1)::int] * vs[({first} + k + 1)::int])) else {out} end"
    return out


POSES = """po as (select ep, step, a0 as x, a1 / 1000 as y, a2 as z, a2 / s as qx, (a3 - 0.05) / s as qy, (a0 / 100) / s as qz, 0.5 / s as qw from (select *, sqrt(a2 * a2 + (a3 - 0.05) * (a3 - 0.05) + (a0 / 100) * (a0 / 100) + 0.25) as s from li)),
pn as (select *, lead(x) over w - x as vx, lead(y) over w - y as vy, lead(z) over w - z as vz, lead(qx) over w as bx, lead(qy) over w as bym, lead(qz) over w as bz, lead(qw) over w as bw from po window w as (partition by ep order by step)),
rm as (select ep, step, (1 - 2 * (qy * qy + qz * qz)) * vx + 2 * (qx * qy + qz * qw) * vy + 2 * (qx * qz - qy * qw) * vz as dx, 2 * (qx * qy - qz * qw) * vx + (1 - 2 * (qx * qx + qz * qz)) * vy + 2 * (qy * qz + qx * qw) * vz as dy,
  2 * (qx * qz + qy * qw) * vx + 2 * (qy * qz - qx * qw) * vy + (1 - 2 * (qx * qx + qy * qy)) * vz as dz,
  qw * bx - qx * bw - qy * bz + qz * bym as rx, qw * bym + qx * bz - qy * bw - qz * bx as ry, qw * bz - qx * bym + qy * bx - qz * bw as rz, qw * bw + qx * bx + qy * bym + qz * bz as rw from pn where vx is not null)"""
FORCE = f"""{LI}, f0 as (select *, sqrt(a0 * a0 + a1 * a1 + a2 * a2) as sz from li), f1 as (select *, abs(sz - lag(sz) over (partition by ep order by step)) as sh from f0),
f2 as (select *, median(sh) over (partition by ep) as mid from f1), f3 as (select *, median(abs(sh - mid)) over (partition by ep) as mad from f2),
fc as (select ep, coalesce(avg(case when sh is not null then (sh > mid + 5.0 * 1.4826 * greatest(mad, 1e-4))::int end), 0) as spike_rate, avg((a3 > 0.04)::int) as contact_rate, count(sh) as n_shocks, count(*) as n_steps from f3 group by ep)"""

NEAREST = """np as (select a.vec_id as ep, b.vec_id as j, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::double - p[2]::double, 2))) as dd from embeddings a join embeddings b on a.vec_id <> b.vec_id),
ne as (select ep, min_by(j, (dd, j)) as neighbour, sqrt(min(dd)) / 8 as distance from np group by ep)"""
MEANS = "avg(jitter_cv) as jitter_cv, avg(dropout) as dropout, avg(spike_rate) as spike_rate, avg(disc_rate) as disc_rate"
_UNIT = {"spike_rate": 0.20, "disc_rate": 0.40, "dropout": 0.20, "jitter_cv": 0.50}
SIMILAR = f"""{SUMMARY}, dq as (select ep, sqrt({" + ".join(f"pow(coalesce(least(greatest(figures.{c} / {x}, 0), 1), 0.5) - coalesce(least(greatest(summary.{c} / {x}, 0), 1), 0.5), 2)" for c, x in _UNIT.items())}) as d from figures, summary),
sim as (select ep, d from dq where d <= 0.4 order by round(d, 9), ep limit 5)"""

FIRED = """fired_ as (select ep from (select ep, metric, value, (value - mid) / (case when mad < 1e-12 then dev else mad end) as dv from m join spread2 using (metric) where value is not null and n >= 5 and (case when mad < 1e-12 then dev else mad end) >= 1e-12) where dv > 3 and (metric <> 'jitter_cv' or value >= 0.01))"""
WHAT = "avg(spike_rate) as spike_rate, avg(disc_rate) as disc_rate, avg(dropout) as dropout, avg(jitter_cv) as jitter_cv, avg(ldlj) as ldlj"
REPORT = f"""{SUMMARY}, rg as (select ep, count(*) as n, max(abs(t - (t0 + step * mid))) as off, any_value(mid) as mid from (select *, first_value(t) over (partition by ep order by step) as t0 from dm) group by ep),
rs as (select coalesce(bool_and(case when n >= 3 then off <= 1e-3 * mid end), false) as syn from rg), rn as (select bool_or(non_monotonic) as nm from timing), rl as (select avg(ldlj) as l from figures),
rd as (select avg(v) as v from (select ep, avg(abs(a0 - s0)) as v from ev group by ep)), rf as (select max(abs(s0)) as far from ev),
rb as (select count(*) >= 6 and stddev_pop(n_steps) / avg(n_steps) >= 0.3 and (select avg((abs(n_steps - q.m) < 0.5 * q.s)::int) from el, (select avg(n_steps) as m, stddev_pop(n_steps) as s from el) q) < 0.15 as bi from el),
rep as (select * from (
  select 'timestamp_jitter_cv' as metric, jitter_cv as value, case when syn then 'INFO' when jitter_cv >= 0.30 then 'CRITICAL' when jitter_cv >= 0.15 then 'WARNING' else 'OK' end as level from summary, rs
  union all select 'timestamp_dropout_rate', dropout, case when syn then 'INFO' when dropout >= 0.05 then 'CRITICAL' when dropout >= 0.01 then 'WARNING' else 'OK' end from summary, rs
  union all select 'timestamp_non_monotonic', nm::int, case when nm then 'CRITICAL' else 'OK' end from rn
  union all select 'action_dropout_rate', action_dropout, case when action_dropout >= 0.15 then 'CRITICAL' when action_dropout >= 0.05 then 'WARNING' else 'OK' end from summary
  union all select 'jerk_spike_rate', spike_rate, case when spike_rate >= 0.05 then 'CRITICAL' when spike_rate >= 0.02 then 'WARNING' else 'OK' end from summary
  union all select 'velocity_discontinuity_rate', disc_rate, case when disc_rate >= 0.05 then 'CRITICAL' when disc_rate >= 0.02 then 'WARNING' else 'OK' end from summary
  union all select 'ldlj', l, case when l <= -15 then 'CRITICAL' when l <= -10 then 'WARNING' else 'OK' end from rl
  union all select 'action_state_divergence', v, case when far > 2 * pi() then 'INFO' when v >= 0.35 then 'CRITICAL' when v >= 0.15 then 'WARNING' else 'OK' end from rd, rf
  union all select 'action_entropy', entropy, case when entropy <= 1.5 then 'CRITICAL' when entropy <= 2.5 then 'WARNING' else 'OK' end from summary
  union all select 'short_episode_fraction', short_fraction, case when short_fraction >= 0.15 then 'CRITICAL' when short_fraction >= 0.05 then 'WARNING' else 'OK' end from summary
  union all select 'episode_length_distribution', length_cv, case when bi then 'WARNING' else 'OK' end from summary, rb) where value is not null)"""

SQL: dict[str, str] = {
    "nearest_embedding": f"with {NEAREST} select ep, neighbour, round(distance, 4) + 0.0 as distance from ne",
    "embedding_outliers": f"""with {NEAREST}, q as (select median(distance) as mid, stddev_pop(distance) as dev, count(*) as n from ne), w as (select any_value(mid) as mid, any_value(dev) as dev, any_value(n) as n, median(abs(distance - mid)) as mad from ne, q),
v as (select ep, distance, (distance - mid) / case when mad < 1e-12 then dev else mad end as z from ne, w where n >= 5 and case when mad < 1e-12 then dev else mad end >= 1e-12)
select ep, 'distance' as metric, round(distance, 4) + 0.0 as value, round(abs(z), 4) + 0.0 as deviation from v where z > 3""",
    "outlier_concentration": f"""with {OUTLIERS}, p as (select ep, count(*) as n from fired group by ep), t as (select sum(n) as top from (select n from p order by n desc, ep limit 5)), c as (select count(*) as k from figures),
g as (select count(*) as n_episodes, sum(n)::bigint as n_flags, count(*) filter (ep <= floor(k * 0.10)) as s, count(*) filter (ep >= floor(k * 0.90)) as e from p, c)
select n_episodes, n_flags, round(top / n_flags, 6) + 0.0 as top5_share, case when s >= 2 and s / n_episodes >= 0.3 then 'start' when e >= 2 and e / n_episodes >= 0.3 then 'end' else 'spread' end as position from g, t""",
    "similar_outcomes": f"with {SIMILAR} select ep, round(d, 5) + 0.0 as distance from sim",
    "outcome_blend": f"""with {SIMILAR}, g as (select count(*) as n, min(d) as near, sum(1 / (d + 1e-6) * (ep % 10) / 10.0 * 100) / sum(1 / (d + 1e-6)) as seen from sim), w as (select *, case when n = 0 then 0 else 0.6 * least(1, n / 5.0) * greatest(0, 1 - near / 0.4) end as w from g)
select case when n = 0 then 62.5 else round(least(greatest((1 - w) * 62.5 + w * seen, 0), 100), 1) end as blended, round(w, 3) as weight from w""",
    "scripted_outcome": f"with {SUMMARY}, " + outcome("summary", {"spike_rate": (3.2, 8.0, 0.02, 0.05), "disc_rate": (3.2, 8.0, 0.02, 0.05), "dropout": (7.0, 18.0, 0.01, 0.05), "jitter_cv": (5.0, 12.0, 0.05, 0.20), "entropy": (10.0, 20.0, 2.5, 1.5)}),
    "corruption_report": f"""with b as (with {EV}, {TIMING}, {motion('ev', ('a0',))} select {MEANS} from timing join motion using (ep)),
c as (with {EV.replace("ev as", "ev0 as")}, ev as (select * exclude (n) from (select *, count(*) over (partition by ep) as n from ev0) where step < greatest(2, floor(n * 0.8))), {TIMING}, {motion('ev', ('a0',))} select {MEANS} from timing join motion using (ep)),
u as ({" union all ".join(f"select '{m}' as metric, b.{m} as x, c.{m} as y from b, c" for m in ("jitter_cv", "dropout", "spike_rate", "disc_rate"))})
select metric, round(x, 6) + 0.0 as before, round(y, 6) + 0.0 as after, round(y - x, 6) + 0.0 as delta from u""",
    "standalone_figures": f"""with {LI}, {LONG}, d0 as (select *, t - lag(t) over (partition by ep order by step) as dt from li), d1 as (select *, median(dt) over (partition by ep) as every from d0),
d2 as (select *, {", ".join(f"({c} - lag({c}) over w) / every as v_{c}" for c in DIMS)} from d1 window w as (partition by ep order by step)), d3 as (select *, {", ".join(f"(v_{c} - lag(v_{c}) over w) / every as a_{c}" for c in DIMS)} from d2 window w as (partition by ep order by step)),
d4 as (select *, {", ".join(f"(a_{c} - lag(a_{c}) over w) / every as j_{c}" for c in DIMS)} from d3 window w as (partition by ep order by step)),
g as (select ep, count(*) as n, max(every) as every, max(sqrt({" + ".join(f"v_{c} * v_{c}" for c in DIMS)})) as top, sum({" + ".join(f"j_{c} * j_{c}" for c in DIMS)}) as jj, stddev_pop(dt) / avg(dt) as cv, avg(case when dt is not null then (dt > 3 * every)::int end) as dr, avg(dt) as mean from d4 group by ep),
b0 as (select ep, dim, value, min(value) over (partition by ep, dim) as lo, max(value) over (partition by ep, dim) as hi from lw), b1 as (select ep, dim, case when hi > lo then least(floor((value - lo) / ((hi - lo) / 50)), 49) else 0 end as bin, count(*) as n from b0 group by all),
b2 as (select ep, dim, n / sum(n) over (partition by ep, dim) as p from b1), b3 as (select ep, avg(b) as entropy from (select ep, dim, -sum(p * log2(p)) as b from b2 group by ep, dim) group by ep)
select ep, round(case when n >= 5 and every > 0 and top > 1e-12 and jj > 0 then -ln(pow(n * every, 3) / (top * top) * jj * every) end, 4) + 0.0 as ldlj, round(entropy, 4) + 0.0 as entropy, round(case when n >= 2 and mean > 0 then cv end, 4) + 0.0 as jitter_cv, round(case when n >= 2 and every > 0 then dr else 0 end, 4) + 0.0 as dropout from g join b3 using (ep)""",
    "calibration_drift": f"""with {HOLD}, o as (select count(*) as n_stable, avg(off0) as m0, avg(off1) as m1, stddev_pop(off0) as d0, stddev_pop(off1) as d1 from held),
g as (select max(s0) - min(s0) as r0, max(s1) - min(s1) as r1 from ho where ep in (select ep from held)), x as (select 'a0' as dim, n_stable, m0 as m, d0 as d, r0 as rg from o, g union all select 'a1', n_stable, m1, d1, r1 from o, g)
select dim, n_stable, round(m, 6) + 0.0 as mean_offset, round(abs(m) / case when rg < 1e-9 then 1 else rg end, 6) + 0.0 as fraction, abs(m) / greatest(d, 1e-9) >= 2 as systematic,
  case when n_stable < 20 then 'INFO' when abs(m) / greatest(d, 1e-9) >= 2 and abs(m) / case when rg < 1e-9 then 1 else rg end >= 0.03 then 'WARNING' else 'OK' end as level from x""",
    "action_dropout_vector": f"""with {FOLLOW}, sc as (select (stddev_pop(a2) + stddev_pop(a3)) / 2 as d from fo),
x as (select ep, sqrt(a2 * a2 + a3 * a3) as m, sqrt(pow(lead(s0) over w - s0, 2) + pow(lead(s1) over w - s1, 2)) as ds, (stddev_pop(s0) over (partition by ep) + stddev_pop(s1) over (partition by ep)) / 2 as own from fo window w as (partition by ep order by step))
select ep, round(avg(case when ds is not null then (m < 0.05 * case when d = 0 then 1 else d end * sqrt(2) and ds > 0.05 * case when own = 0 then 1 else own end * sqrt(2))::int end), 6) + 0.0 as action_dropout from x, sc group by ep having count(*) >= 2""",
    "divergence_flag": f"""with {FOLLOW}, e as (select ep, avg(sqrt(pow(a2 - s2, 2) + pow(a3 - s3, 2))) as v from fo group by ep)
select round(avg(v), 6) as divergence, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, null::double as relative, case when avg(v) >= 0.35 then 'CRITICAL' when avg(v) >= 0.15 then 'WARNING' else 'OK' end as level from e""",
    "divergence_units": f"""with {EV}, e as (select ep, avg(abs(a0 - s0)) as v from ev group by ep), s as (select max(abs(s0)) as far, max(s0) - min(s0) as span from ev)
select round(avg(v), 6) as divergence, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, case when any_value(far) > 2 * pi() and any_value(span) > 0 then round(avg(v) / any_value(span), 6) end as relative,
  case when any_value(far) > 2 * pi() then 'INFO' when avg(v) >= 0.35 then 'CRITICAL' when avg(v) >= 0.15 then 'WARNING' else 'OK' end as level from e, s""",
    "accelerations_summed": f"""with {LI}, d as (select *, t - lag(t) over (partition by ep order by step) as dt from li), m as (select *, median(dt) over (partition by ep) as every from d)
select ep, step, round(sum(a2) over (partition by ep order by step) * every, 6) + 0.0 as a2, round(sum(a3) over (partition by ep order by step) * every, 6) + 0.0 as a3 from m""",
    "force_contact": f"""with {FORCE} select ep, round(spike_rate, 6) + 0.0 as spike_rate, round(contact_rate, 6) + 0.0 as contact_rate, n_shocks, n_steps from fc""",
    "force_flags": f"""with {FORCE}, g as (select sum(spike_rate * n_shocks) / sum(n_shocks) as s, sum(contact_rate * n_steps) / sum(n_steps) as c from fc)
select 'force_spike_rate' as metric, round(s, 6) + 0.0 as value, case when s > 0.01 then 'WARNING' else 'OK' end as level from g union all select 'contact_dropout', round(c, 6) + 0.0, case when c < 0.01 then 'CRITICAL' else 'OK' end from g""",
    "grasp_summary": f"""with {LI}, {CONTACT}, g as (select ep, closed and not lag(closed) over (partition by ep order by step) as turn from c3), n as (select ep, case when count(*) >= 3 then sum(coalesce(turn, false)::int) end as k from g group by ep),
s as (select count(k) as n_episodes, avg(k) as mean_grasps, avg((k = 0)::int) as zero_share from n)
select n_episodes, {r('mean_grasps')}, {r('zero_share')}, case when n_episodes = 0 then 'INFO' when s.zero_share > 0.5 then 'WARNING' else 'OK' end as level from s""",
    "synthetic_clock_flags": f"""with {LI}, ev as (select * from li), {TIMING}, g as (
  select ep, count(*) as n, max(abs(t - (t0 + step * mid))) as off, any_value(mid) as mid from (select *, first_value(t) over (partition by ep order by step) as t0 from dm) group by ep
), sy as (select coalesce(bool_and(case when n >= 3 then off <= 1e-3 * mid end), false) as s from g), m as (select avg(jitter_cv) as jc, avg(dropout) as dr from timing)
select 'jitter_cv' as metric, round(jc, 6) + 0.0 as value, case when s then 'INFO' when jc >= 0.30 then 'CRITICAL' when jc >= 0.15 then 'WARNING' else 'OK' end as level from m, sy
union all select 'dropout', round(dr, 6) + 0.0, case when s then 'INFO' when dr >= 0.05 then 'CRITICAL' when dr >= 0.01 then 'WARNING' else 'OK' end from m, sy""",
    "policy_compatibility": f'with {checks()} select policy, "check", round(value, 4) + 0.0 as value, level from ck',
    "policy_hints": f"""with {checks()} select policy, case when bool_or(level = 'CRITICAL') then 'not_recommended' when bool_or(level = 'WARNING') then 'review' else 'recommended' end as hint from ck group by policy""",
    "near_leakage": f"with {near()} select held, train, kind, {r('distance', 5)}, {r('percentile', 5)} from pairs",
    "near_leakage_summary": f"""with {near()}, g as (select count(*) filter (kind = 'exact') as n_exact, count(*) filter (kind = 'near_identical') as n_near, count(*) filter (kind = 'suspicious') as n_suspicious from pairs),
c as (select count(*) filter (not h) as n_train, count(*) filter (h) as n_held from sides), z as (select *, n_held - n_exact as nt from g, c),
p as (select z.*, case when n_suspicious = 0 then 1.0 else greatest(0, 1 - (select sum(exp(lgamma(nt + 1) - lgamma(i + 1) - lgamma(nt - i + 1) + i * ln(0.01) + (nt - i) * ln(0.99))) from range(0, 1000) q(i) where i < n_suspicious)) end as p from z)
select n_train, n_held, n_exact, n_near, n_suspicious, round(mid, 5) + 0.0 as median_distance, round(p, 5) + 0.0 as p_value, case when n_exact + n_near > 0 then 'critical' when p < 0.01 then 'warning' else 'ok' end as status from p, cuts""",
    "permutation_drift": f"""with {METRICS}, b as (select metric, ep, value, case when ep % 2 = 0 then 'a' else 'b' end as side from m where value is not null),
s as (select metric, count(*) filter (side = 'a') as na, count(*) filter (side = 'b') as nb, avg(value) filter (side = 'b') - avg(value) filter (side = 'a') as delta from b group by metric),
o as (select b.*, draw, row_number() over (partition by metric, draw order by md5('42|' || draw || '|' || side || '|' || ep), ep) as place from b, range(0, 199) q(draw)),
x as (select o.metric, draw, avg(value) filter (place > na) - avg(value) filter (place <= na) as x, any_value(delta) as delta from o join s using (metric) group by o.metric, draw),
p as (select metric, avg((abs(x) >= abs(delta) - 1e-12)::int) as p from x group by metric), f as (select s.metric, coalesce(delta, 0) as delta, case when na >= 4 and nb >= 4 then p else 1.0 end as p from s join p using (metric)),
w as (select *, case when round(delta, 9) = 0 then 'ambiguous' when delta > 0 then 'degraded' else 'improved' end as direction from f)
select metric, {r('delta')}, round(p, 6) + 0.0 as p_value, direction, case when p >= 0.05 then 'INFO' when direction = 'improved' then 'OK' when direction = 'degraded' then 'WARNING' else 'INFO' end as level from w""",
    "grouped_assessment": f"""with {METRICS}, {RISK}, mt as (select *, ep % 3 as task from m),
gs as (select metric, task, count(value) as n, median(value) as mid, stddev_pop(value) as dev, max(value) - min(value) as rg from mt group by all),
gm as (select gs.metric, gs.task, any_value(n) as n, any_value(mid) as mid, any_value(dev) as dev, any_value(rg) as rg, median(abs(value - mid)) as mad from gs join mt using (metric, task) group by gs.metric, gs.task),
rk as (select mt.ep, case when value is not null and n >= 2 and rg >= 1e-9 then count(value) over (partition by metric, task order by value nulls last range between unbounded preceding and current row)::double / n end as rank,
  case when n >= 3 and case when mad * 1.4826 < 1e-12 then dev else mad * 1.4826 end >= 1e-12 then abs(value - mid) / case when mad * 1.4826 < 1e-12 then dev else mad * 1.4826 end end as z from mt join gm using (metric, task)),
g as (select ep, coalesce(max(case when (rank <= 0.1 or rank >= 0.9) and z >= 2.5 then abs(rank - 0.5) * 2 end), 0.0) as anomaly, sum(coalesce((rank <= 0.1 or rank >= 0.9)::int, 0))::bigint as n_reasons from rk group by ep)
select ep, {r('anomaly')}, n_reasons, {r('quality_risk')}, null::double as coverage_value from g join risk using (ep)""",
    "assessment_summary": f"with {ASSESSED} select count(*) as n, round(avg(quality_risk), 6) + 0.0 as quality_risk, round(avg(anomaly), 6) + 0.0 as anomaly, null::double as coverage_value from assessed join risk using (ep)",
    "headline_scores": f"with {FIGURES}, {RISK} select ep, round(100 * (1 - quality_risk), 1) + 0.0 as score, null::double as redundancy from risk",
    "coreset_influence": f"with {INFL}, {GATE_LI}, " + two_stage("gz", "reasons <> ''", "select ep, round(influence, 9) as score from infl", "influence"),
    "coreset_energy": f"""with {LI}, {GATE_LI}, pa as (select gz.ep, coalesce(disc_rate, 0) as score, spike_rate as error from gz join motion using (ep) where reasons = ''), kk as (select greatest(1, round_even(0.3 * (select count(*) from gz), 0)) as k, (select count(*) from pa) as n, (select quantile_cont(error, 0.9) from pa) as cut),
rk as (select ep, row_number() over (order by score desc, ep) as place from pa, kk where n <= 10 or error <= cut), ke as (select ep from rk, kk where place <= k and n > k union select ep from pa, kk where n <= k)
select gz.ep, case when reasons <> '' then 'quality_fail' when ke.ep is not null then 'keep' else 'diversity_pruned' end as decision, case when reasons <> '' then reasons when ke.ep is not null then '' else 'not_selected_energy' end as reasons from gz left join ke on ke.ep = gz.ep""",
    "coreset_novelty": f"with {FIGURES}, {GATE}, {surprise()}, {VOX}, " + two_stage("gate", "status = 'bad'", "select ep, novelty as score from nov", "novelty"),
    "feature_weights": f"""with {LI}, {motion('li', DIMS)}, f as (select li.ep, avg(a0) as m_a0, stddev_pop(a0) as d_a0, coalesce(any_value(spike_rate), 0) as spike_rate, coalesce(any_value(disc_rate), 0) as disc_rate, any_value(n_steps) / 1000 as length from li join motion using (ep) group by li.ep)
select ep, """ + ", ".join(f"round(case when max({c}) over () > min({c}) over () then ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) else 0 end * {w}, 6) + 0.0 as {c}" for c, w in (("m_a0", 0.7), ("d_a0", 0.7), ("spike_rate", 0.3), ("disc_rate", 0.3), ("length", 0.3))) + " from f",
    "entropy_ranking": f"with {LI}, {LONG}, {TENT} select ep, {r('entropy')}, row_number() over (order by -round(te.entropy, 9), ep) as rank from te",
    "evenly_spaced": "with e as (select distinct l_suppkey as ep from lineitem), o as (select ep, row_number() over (order by ep) as k, count(*) over () as n from e) select ep from o where n <= 7 or k in (select round_even(i * (n - 1) / 6.0, 0) + 1 from range(0, 7) q(i))",
    "cure_smooth": f"with {EV}, l as (select ep, list(a0 order by step) as vs, count(*) as n from ev group by ep), x as (select ev.ep, step, a0 as v, vs, n from ev join l using (ep)) select ep, step, round({savgol()}, 5) + 0.0 as value from x",
    "corrupt_jitter": f"""with {EV}, n as (select ep, step, (t - 1000 * floor(t / 1000)) + 0.02 * sqrt(-2 * ln({U("ep || '|' || step || '|42|u'")})) * cos(2 * pi() * {U("ep || '|' || step || '|42|v'")}) as t from ev)
select ep, row_number() over (partition by ep order by t, step) - 1 as step, round(t, 5) + 0.0 as t from n""",
    "corrupt_spikes": f"""with recursive {EV}, x as (select ep, step, a0, count(*) over (partition by ep) as n from ev),
c as (select *, row_number() over (partition by ep order by md5(ep || '|' || step || '|42'), step) as place, greatest(2, n // 10) as gap from x where n >= 4 and step between 1 and n - 2),
k as (select *, greatest(0, step - gap) as l, greatest(0, n - 1 - step - gap) as r from c where place <= least(greatest(1, floor(n * 0.1)), n // 4)),
d as (select *, floor({U("ep || '|' || step || '|42|partner'")} * (l + r))::bigint as u from k where l + r > 0),
sw as (select ep, row_number() over (partition by ep order by place) as q, step as i, case when u < l then u else step + gap + 1 + u - l end as j from d),
st as (select ep, 0::bigint as q, list(step order by step) as l from x group by ep union all
  select s.ep, s.q + 1, list_transform(s.l, lambda y, p: case when p = w.i + 1 then s.l[w.j + 1] when p = w.j + 1 then s.l[w.i + 1] else y end) from st s join sw w on w.ep = s.ep and w.q = s.q + 1),
fin as (select ep, arg_max(l, q) as l from st group by ep)
select x.ep, x.step, y.a0 as value from x join fin f on f.ep = x.ep join x y on y.ep = x.ep and y.step = f.l[x.step + 1]""",
    "corrupt_delay": f"""with {EV}, {some("late")} select e.ep, step, round((t - 1000 * floor(t / 1000)) + case when c.ep is null then 0 else 0.05 + 0.15 * {U("e.ep || '|42|delay'")} end, 5) + 0.0 as t from ev e left join chosen c on c.ep = e.ep""",
    "corrupt_truncate": f"""with {EV}, {some("short")}, n as (select *, count(*) over (partition by ep) as n from ev) select n.ep, step, a0 from n left join chosen c on c.ep = n.ep where c.ep is null or step < greatest(2, floor(n * 0.8))""",
    "transfer_ladder": f"""with {LI}, {LONG}, {RATES}, {LDLJ_LI}, s as (select ep % 2 as side, avg(hzf) as hz, avg(n_steps) as len from rt group by 1), l as (select ep % 2 as side, avg(ldlj) as ldlj from lj group by 1),
z as (select a.hz as ah, b.hz / 2 as bh, a.len as al, b.len as bl, c.ldlj as ax, d.ldlj as bx from s a, s b, l c, l d where a.side = 0 and b.side = 1 and c.side = 0 and d.side = 1),
ra as (select dim, min(case when ep % 2 = 0 then value end) as sl, max(case when ep % 2 = 0 then value end) as sh, min(case when ep % 2 = 1 then value end) as tl, max(case when ep % 2 = 1 then value end) as th from lw group by dim),
rc as (select coalesce(avg(greatest(0, least(th, sh) - greatest(tl, sl)) / (th - tl)) filter (th > tl), 0) as c from ra),
q as (select 'frequency' as aspect, greatest(ah, bh) / greatest(least(ah, bh), 0.1) as v, 1.5 as lo, 3 as hi from z union all select 'smoothness', abs(ax - bx), 3, 8 from z union all select 'episode_length', greatest(al, bl) / greatest(least(al, bl), 1), 2, 5 from z union all select 'action_dims', 0, 1, 2 union all select 'action_range', -c, -0.7999999999, -0.4999999999 from rc),
k as (select aspect, case when v is null then 1 when v < lo then 0 when v < hi then 1 else 2 end as g from q), u as (select * from k union all select 'overall', max(g) from k)
select aspect, case g when 0 then 'DIRECT' when 1 then 'ADAPT' else 'DIFFICULT' end as level from u""",
    "linear_surprise": f"with {EV}, {surprise()} select ep, {r('surprise')} from su",
    "surprise_verdicts": f"""with {EV}, {motion('ev', ('a0',))}, {surprise()}, v as (select su.ep, round(surprise, 9) as surprise, coalesce(spike_rate, 0) as jerk from su left join motion using (ep))
select ep, {r('surprise')}, {r('jerk')}, case when v.surprise >= 0.6 and v.jerk < 0.04 then 'NOVEL' when v.surprise >= 0.6 then 'CORRUPTED' else 'REDUNDANT' end as verdict from v""",
    "surprising_episodes": f"""with {FIGURES}, {GATE}, {surprise()}, dd as (select *, a0 - lag(a0) over (partition by ep order by step) as d1 from ev), d2 as (select *, d1 - lag(d1) over (partition by ep order by step) as dd from dd),
sg as (select ep, avg(abs(a0)) as energy, coalesce(avg(abs(dd)), 0) as jerkiness, max(s0) - min(s0) as state_range, count(*)::double as length from d2 group by ep),
zz as (select ep, unnest([{", ".join(f"{{'z': case when stddev_pop({c}) over () >= 1e-8 then round(abs(({c} - avg({c}) over ()) / stddev_pop({c}) over ()), 9) else 0 end, 'i': {i}, 'n': '{c}'}}" for i, c in enumerate(("energy", "jerkiness", "state_range", "length")))}]) as q from sg),
rs as (select ep, case when max(q.z) >= 1 then min_by(q.n, (-q.z, q.i)) else 'dynamics' end as reason from zz group by ep)
select su.ep, round(surprise, 6) + 0.0 as surprise, reason from su join gate using (ep) join rs using (ep) where status <> 'bad' and round(surprise, 9) >= 0.3""",
    "voxel_novelty": f"with {EV}, {surprise()}, {VOX} select ep, {r('novelty', 9)} from nov",
    "voxel_redundancy": f"with {EV}, {surprise()}, {VOX} select round(1 - (select count(*) from vo) / (select count(*) from tn), 6) + 0.0 as redundancy",
    "transition_entropy_2d": f"""with {EV}, {surprise()}, g as (select least(floor((z_s0 - min(z_s0) over ()) / (max(z_s0) over () - min(z_s0) over ()) * 20), 19) as i, least(floor((a_a0 - min(a_a0) over ()) / (max(a_a0) over () - min(a_a0) over ()) * 20), 19) as j from tn),
n as (select count(*) as n from g group by i, j), p as (select n / sum(n) over () as p from n) select round(-sum(p * log2(p)), 6) + 0.0 as bits from p""",
    "knn_density": """with s as (select vec_id, embedding from embeddings order by md5('42|' || vec_id), vec_id limit 2000),
d as (select a.vec_id, list_sort(list(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::double - p[2]::double, 2)))))) as ds from s a, s b where a.vec_id <> b.vec_id group by a.vec_id)
select round(avg(ds[5]), 5) + 0.0 as density from d""",
    "retention_table": f"with {RECORDS} select experiment_id, retention_pct, condition, max(recorded) as record_id, round(max_by(success, recorded), 6) + 0.0 as success from rec group by 1, 2, 3",
    "missing_cells": f"with {RECORDS}, {PROTOCOL}, x as (select * from rec where recorded % 7 = 0) select e.experiment_id, pr.retention_pct, pr.condition from (select distinct experiment_id from x) e, pr where not exists (select 1 from x where x.experiment_id = e.experiment_id and x.retention_pct = pr.retention_pct and x.condition = pr.condition)",
    "matrix_coverage": f"""with {RECORDS}, {PROTOCOL}, x as (select * from rec where recorded % 101 = 0), c as (select embodiment, count(distinct experiment_id) as n_experiments, count(distinct (retention_pct, condition)) as n_records from x group by 1),
m as (select embodiment, count(distinct (x.retention_pct, x.condition)) as met from x join pr on pr.retention_pct = x.retention_pct and pr.condition = x.condition group by 1)
select embodiment, n_experiments, n_records, 7 - coalesce(met, 0) as n_missing, coalesce(met, 0) = 7 as complete from c left join m using (embodiment)""",
    "treatment_deltas": f"""with {RECORDS}, l as (select experiment_id, retention_pct, condition, max_by(success, recorded) as s from rec where retention_pct <> 100 group by 1, 2, 3)
select experiment_id, retention_pct, round(max(case when condition = 'selected' then s end) - max(case when condition = 'random' then s end), 6) + 0.0 as delta from l group by 1, 2""",
    "nearest_retention": f"""with {RECORDS}, w as (select * from (values (25.4, 'random'), (49.0, 'selected'), (60.0, 'random'), (99.5, 'full')) t(target_pct, condition)),
j as (select w.target_pct::double as target_pct, w.condition, rec.retention_pct, rec.success, row_number() over (partition by w.target_pct, w.condition order by abs(rec.retention_pct - w.target_pct), recorded desc) as k from w left join rec on rec.condition = w.condition and abs(rec.retention_pct - w.target_pct) <= 1)
select target_pct, condition, retention_pct, round(success, 6) + 0.0 as success from j where k = 1""",
    "precision_table": """with f as (select source as detector, lang as dataset, case when toxic = 1 then 'a' when quality = 0 then 'c' else 'v' end as k from labels join documents using (doc_id))
select detector, count(*) as n_reviewed, round(avg((k = 'c')::int), 6) + 0.0 as true_corruption_rate, round(avg((k = 'v')::int), 6) + 0.0 as unusual_valid_rate, round(avg((k = 'a')::int), 6) + 0.0 as ambiguous_rate, string_agg(distinct dataset, ',' order by dataset) as datasets from f group by detector""",
    "baseline_lookup": """with p as (select c_mktsegment as detector, c_nationkey % 10 as dataset, c_nationkey % 3 as family, c_acctbal as rate, c_custkey as n from customer),
w as (select distinct ['BUILDING', 'NOTHING', 'MACHINERY'][s_suppkey % 3 + 1] as detector, s_nationkey as dataset, s_nationkey % 4 as task_family from supplier),
a as (select detector, dataset, max_by(rate, n) as own from p group by 1, 2), b as (select detector, family as task_family, max_by(rate, n) as fam from p group by 1, 2)
select w.detector, w.dataset, w.task_family, round(coalesce(own, fam), 6) + 0.0 as rate, case when own is not null then 'dataset' when fam is not null then 'task_family' end as source from w left join a using (detector, dataset) left join b on b.detector = w.detector and b.task_family = w.task_family""",
    "blind_sample": """with i as (select lang as dataset, doc_id as ep, n_chars < 400 as flagged, n_chars as priority, md5('0|' || lang || '|' || doc_id) as item_key from documents),
f as (select *, row_number() over (partition by dataset order by item_key) as k, count(*) over (partition by dataset) as n from i where flagged),
q as (select *, row_number() over (partition by dataset order by priority desc, ep) as rk, count(*) over (partition by dataset) as n from i where not flagged),
c as (select *, row_number() over (partition by dataset order by item_key) as k from q where rk > 5)
select dataset, ep, 'flagged' as stratum, round(least(n, 8) / n, 6) + 0.0 as inclusion_prob, item_key from f where k <= 8 union all select dataset, ep, 'review_top', 1.0, item_key from q where rk <= 5 union all select dataset, ep, 'control', round(least(10, n - 5) / (n - 5), 6) + 0.0, item_key from c where k <= 10""",
    "detector_scores": """with l as (select doc_id, quality = 0 as bad, n_chars, case when n_chars < 1000 then 1.0 else 4.0 end as w from labels join documents using (doc_id) where not (quality <> 0 and toxic = 1)),
x as (select 'short' as detector, n_chars < 800 as fires, * from l union all select 'long', n_chars > 4000, * from l)
select detector, count(*) as n, round(case when sum(case when fires then w else 0 end) > 0 then sum(case when fires and bad then w else 0 end) / sum(case when fires then w else 0 end) end, 6) + 0.0 as precision,
  round(case when sum(case when bad then w else 0 end) > 0 then sum(case when fires and bad then w else 0 end) / sum(case when bad then w else 0 end) end, 6) + 0.0 as recall from x group by detector""",
    "annotation_sidecar": f"""with {ASSESSED}, {GATE}, ou as (select ep, metric, value, (value - mid) / (case when mad < 1e-12 then dev else mad end) as dv from m join spread2 using (metric) where value is not null and n >= 5 and (case when mad < 1e-12 then dev else mad end) >= 1e-12),
fo as (select ep, string_agg(distinct metric, ',' order by metric) as f from ou where dv > 3 and (metric <> 'jitter_cv' or value >= 0.01) group by ep)
select g.ep as episode_id, case when status = 'bad' then 'drop' when status = 'not_evaluated' then 'review' when g.ep % 2 = 0 then 'keep' else 'drop' end as disposition, {r('quality_risk')}, {r('anomaly')}, null::double as coverage_value, coalesce(f, '') as integrity_flags
from gate g join assessed using (ep) join risk using (ep) left join fo using (ep)""",
    "dimension_scores": f"""with {REPORTED}, k as (select * from (values ('temporal_integrity', 0.3), ('motion_quality', 0.3), ('behavioral_coverage', 0.2), ('task_integrity', 0.2)) t(dimension, weight)),
g as (select case when metric in ('jerk_spike_rate', 'velocity_discontinuity_rate') then 'motion_quality' else 'temporal_integrity' end as dimension, avg(case level when 'CRITICAL' then 30.0 when 'WARNING' then 65.0 when 'INFO' then 90.0 else 100.0 end) as score, count(*) as n from fn group by 1)
select k.dimension, weight::double as weight, round(coalesce(score, 100), 6) + 0.0 as score, coalesce(n, 0) as n_flags from k left join g using (dimension)""",
    "overall_score": f"""with {REPORTED}, g as (select case when metric in ('jerk_spike_rate', 'velocity_discontinuity_rate') then 'm' else 't' end as d, avg(case level when 'CRITICAL' then 30.0 when 'WARNING' then 65.0 else 100.0 end) as s from fn group by 1), x as (select 0.3 * sum(s) + 0.3 * (2 - count(*)) * 100 + 40 as s from g)
select round(s, 6) + 0.0 as score, case when s >= 90 then 'A' when s >= 80 then 'B' when s >= 70 then 'C' when s >= 60 then 'D' else 'F' end as grade from x""",
    "health_score": f"""with {REPORTED}, c as (select *, case when metric in ('jerk_spike_rate', 'velocity_discontinuity_rate', 'action_dropout_rate') then 'quality' else 'synchrony' end as category from fn),
k as (select unnest(['overall', 'quality', 'synchrony', 'coverage', 'integrity']) as category), o as (select 'overall' as category, sum(case level when 'CRITICAL' then 12 when 'WARNING' then 4 else 0 end) as x from c union all select category, sum(case level when 'CRITICAL' then 20 when 'WARNING' then 8 else 0 end) from c group by category)
select category, greatest(0, 100 - coalesce(x, 0))::bigint as score from k left join o using (category)""",
    "flag_actions": f"""with {REPORTED} select metric, level, true as integrity, case when level = 'OK' then 'informational' when level = 'WARNING' then 'inspect' when metric in ('timestamp_jitter_cv', 'jerk_spike_rate', 'velocity_discontinuity_rate') then 'inspect' else 'block' end as action from fn""",
    "ci_verdict": f"""with {REPORTED}, g as (select count(*) filter (level = 'CRITICAL') as n_critical, count(*) filter (level = 'CRITICAL' and metric not in ('jerk_spike_rate', 'velocity_discontinuity_rate')) as n_blocking from fn)
select case when n_blocking > 0 then 'Failed' else 'Passed' end as result, n_critical, n_blocking from g""",
    "audit_confidence": f"with {METRICS}, g as (select avg(value) as v, quantile_cont(value, 0.25) as lo, quantile_cont(value, 0.75) as hi from m where value is not null group by metric) select round(coalesce(avg(greatest(0, 1 - (hi - lo) / (abs(v) + 1e-9))), 0.9), 3) as confidence from g",
    "scripted_signature": f"with {FIGURES}, g as (select avg(spike_rate) as spike, avg(disc_rate) as disc from figures) select {r('spike')}, {r('disc')}, g.spike > 0.10 and g.disc < 0.015 as scripted from g",
    "community_ranks": """with q as (select quantile_cont(n_chars, 0.25) as a, quantile_cont(n_chars, 0.5) as b, quantile_cont(n_chars, 0.75) as c, quantile_cont(n_chars, 0.9) as e from documents), s as (select source, avg(n_chars) as v from documents group by source)
select source, round(100 - case when v <= a then case when a <> 0 then greatest(0, 25 * v / a) else 25 end when v <= b then 25 + 25 * (v - a) / greatest(b - a, 1e-9) when v <= c then 50 + 25 * (v - b) / greatest(c - b, 1e-9) when v <= e then 75 + 15 * (v - c) / greatest(e - c, 1e-9) else 90 end, 4) + 0.0 as rank,
  round(case when v / 100 > 1 and v / 100 <= 100 then v / 100 / 100 else v / 100 end, 4) + 0.0 as rate from s, q""",
    "frame_sharpness": f"with {CAMERA} select ep, step, {r('sharpness', 9)} from sharp",
    "frame_transitions": f"with {transit(400.0, 0.9)} select ep, step, {r('activity', 9)}, repeated from tra",
    "episode_frames": f"with {episode_frames(400.0, 0.9)} select ep, {r('sharpness')}, {r('duplicate_fraction')}, freeze_run from ef",
    "blur_outliers": f"with {episode_frames(2.0, 5e-4)} select ep, {r('sharpness')}, blurry from bo",
    "frame_flags": f"""with {episode_frames(400.0, 0.9)}, g as (select (select avg(blurry::int) from bo) as b, avg(duplicate_fraction) as d, avg((freeze_run >= 5)::int) filter (freeze_run is not null) as f from ef)
select 'blurry_episode_fraction' as metric, round(b, 6) + 0.0 as value, case when b >= 0.15 then 'CRITICAL' when b >= 0.05 then 'WARNING' else 'OK' end as level from g
union all select 'duplicate_frame_rate', round(d, 6) + 0.0, case when d >= 0.15 then 'CRITICAL' when d >= 0.05 then 'WARNING' else 'OK' end from g union all select 'camera_freeze_events', round(f, 6) + 0.0, case when f >= 0.10 then 'CRITICAL' when f > 0 then 'WARNING' else 'OK' end from g""",
    "egomotion": f"with {transit(2.0, 5e-4)}, {EGO} select ep, {r('r')} from eg",
    "camera_mismatch": f"""with {transit(2.0, 5e-4)}, {EGO}, c as (select ['observation.images.wrist_cam', 'camera_top', 'images.laptop'][ep % 3 + 1] as camera, r from eg where r is not null),
g as (select camera, median(r) as m, case when camera like '%wrist%' then 'moving' when camera = 'camera_top' then 'static' else 'unknown' end as declared from c group by camera having count(*) >= 3),
e as (select max(m) filter (declared = 'static') as ts, min(m) filter (declared = 'moving') as lm from g)
select camera, declared, round(m, 6) + 0.0 as median_r, case when coalesce(ts > lm + 0.1 and ((declared = 'static' and m = ts) or (declared = 'moving' and m = lm)), false) or (declared = 'static' and m >= 0.5) then 'WARNING' when (declared = 'unknown' and m >= 0.5) or (declared = 'moving' and m <= 0.15) then 'INFO' else 'OK' end as level from g, e""",
    "visual_lag": f"with {transit(2.0, 5e-4)}, {LAGS} select ep, lag from lg",
    "physics_drift": f"with {transit(2.0, 5e-4)}, {LAGS}, g as (select trunc(median(lag))::bigint as drift from lg) select drift, case when abs(drift) >= 5 then 'CRITICAL' when abs(drift) >= 2 then 'WARNING' when drift is not null then 'OK' else 'INFO' end as level from g",
    "episode_digests": f"with {EV} select ep, substr(sha256(string_agg(printf('%.6f', t) || ',' || printf('%.6f', a0), ';' order by step)), 1, 16) as digest from ev group by ep",
    "batch_fingerprint": f"""with {EV}, d as (select ep, substr(sha256(string_agg(printf('%.6f', t) || ',' || printf('%.6f', a0), ';' order by step)), 1, 16) as digest from ev group by ep),
g as (select floor(ep / 4096) as g, sha256(string_agg(ep || ':' || digest, ',' order by ep)) as h from d group by 1) select substr(sha256(string_agg(h, ',' order by g) || '|pi0'), 1, 24) as fingerprint from g""",
    "relative_poses": f"""with {LI}, {POSES} select ep, step, {r('dx', 5)}, {r('dy', 5)}, {r('dz', 5)}, round(atan2(2 * (rw * rx + ry * rz), 1 - 2 * (rx * rx + ry * ry)), 5) + 0.0 as droll, round(asin(greatest(-1, least(1, 2 * (rw * ry - rz * rx)))), 5) + 0.0 as dpitch,
  round(atan2(2 * (rw * rz + rx * ry), 1 - 2 * (ry * ry + rz * rz)), 5) + 0.0 as dyaw from rm""",
    "pair_coherence": """with p as (select vec_id, embedding as a, lead(embedding) over (partition by label order by vec_id) as b from embeddings), d as (select vec_id, list_sum(list_transform(list_zip(a, b), lambda p: p[1]::double * p[2]::double)) as ab, list_sum(list_transform(a, lambda x: x::double * x::double)) as aa, list_sum(list_transform(b, lambda x: x::double * x::double)) as bb from p where b is not null)
select vec_id, round(case when aa > 0 and bb > 0 then ab / (sqrt(aa) * sqrt(bb)) else 0 end, 6) + 0.0 as coherence from d""",
    "limit_violations": f"""with {LI}, d as (select *, t - lag(t) over (partition by ep order by step) as dt from li), m as (select *, median(dt) over (partition by ep) as every from d),
v as (select *, abs(a0 - lag(a0) over w) / every as v0, abs(a2 - lag(a2) over w) / every as v2 from m window w as (partition by ep order by step))
select ep, 'lift' as joint, round(avg((a0 < 3)::int), 6) + 0.0 as under, round(avg((a0 > 45)::int), 6) + 0.0 as over, round(avg((v0 > 1500)::int), 6) + 0.0 as too_fast from v group by ep
union all select ep, 'turn', round(avg((a2 < 0.01)::int), 6) + 0.0, round(avg((a2 > 0.09)::int), 6) + 0.0, round(avg((v2 > 2.5)::int), 6) + 0.0 from v group by ep""",
    "canonical_keys": """with k as (select distinct 'obs/' || event_type as key from events union all select unnest(['images.top', 'images.left_arm', 'image.x', 'obs/thing', 'robot0_eef_pos', 'robot0_base', 'joint_pos', 'camera_rgb', 'depth']))
select key, case key when 'images.top' then 'camera_top' when 'robot0_eef_pos' then 'eef_position' when 'joint_pos' then 'joint_position' when 'depth' then 'camera_depth' else
  case when key like 'images.%' then 'camera_' || substr(key, 8) when key like 'image.%' then 'camera_' || substr(key, 7) when key like 'obs/%' then substr(key, 5) when key like 'robot0%' then substr(key, 8) else key end end as name,
  case when key like '%joint%' or key like '%eef%' or key like '%obs%' then 'proprioception' when key like '%image%' or key like '%camera%' or key like '%depth%' then 'vision' end as kind,
  case when key in ('images.top', 'images.left_arm', 'robot0_base') then 'static' else 'unknown' end as view from k""",
    "rows_by_offsets": """with m as (select max(event_id) as n from events), e as (select id as ep, floor((n + 1) * id * id / 121.0)::bigint as hi, floor((n + 1) * (id - 1) * (id - 1) / 121.0)::bigint as lo from m, range(1, 12) q(id))
select ep, count(*) as n, max(event_id - lo) as last, round(sum(value), 3) as total from events join e on event_id >= lo and event_id < hi group by ep""",
    "kept_renumbered": "with n as (select distinct l_suppkey as k from lineitem where l_suppkey % 3 <> 0), o as (select k, row_number() over (order by k) - 1 as i from n) select i as episode_index, s_name from o join supplier on s_suppkey = k",
    "full_report": f"with {REPORT} select metric, round(value, 5) + 0.0 as value, level from rep",
    "findings": f"""with {REPORT} select metric, round(value, 5) + 0.0 as value, level, case when metric like 'timestamp%' or metric like '%dropout%' then 'temporal_integrity' when metric in ('ldlj', 'jerk_spike_rate', 'velocity_discontinuity_rate', 'action_state_divergence') then 'motion_quality' when metric = 'action_entropy' then 'behavioral_coverage' else 'task_integrity' end as dimension,
  metric not in ('ldlj', 'action_state_divergence', 'action_entropy', 'episode_length_distribution') as integrity, case when level = 'WARNING' then 'inspect' when metric in ('jerk_spike_rate', 'velocity_discontinuity_rate') then 'inspect' else 'block' end as action from rep where level <> 'OK'""",
    "headline_metrics": f"with {REPORT} select " + ", ".join(f"round(max(case when metric = '{n}' then value end), 5) + 0.0 as {n}" for n in ("ldlj", "action_entropy", "timestamp_jitter_cv", "timestamp_dropout_rate", "jerk_spike_rate", "velocity_discontinuity_rate")) + " from rep",
    "detector_spread": f"""with {OUTLIERS}, n as (select count(*) as n from figures), g as (select metric, count(distinct ep) as n_fired, min(ep) as lo, max(ep) as hi from fired group by metric)
select metric, n_fired, case when n_fired = 1 then 'spread' when hi - lo <= greatest(3, floor(n * 0.1)) then 'clustered' when hi >= floor(n * 0.85) then 'endpoint' else 'spread' end as concentration from g, n""",
    "outlier_labels": f"""with {OUTLIERS}, n as (select count(*) as n from figures), e as (select distinct ep from fired), g as (select ep, ep - row_number() over (order by ep) as g from e), r as (select min(ep) as first, max(ep) as last, count(*) as size from g group by g),
c as (select first, last, size, coalesce(bool_or(metric = 'jitter_cv'), false) as j, coalesce(bool_or(metric = 'dropout'), false) as d from r left join fired on ep between first and last group by 1, 2, 3)
select first, last, size, case when size >= 3 and (j or d) then 'sync_loss_or_interruption' when size >= 3 then 'fatigue_or_artifact' when last >= floor(n * 0.9) then 'end_of_dataset' when first <= floor(n * 0.05) then 'start_of_dataset' when j then 'sync_loss' when d then 'frame_drop' else 'investigate' end as label from c, n""",
    "most_isolated": f"with {LI}, {NEAR} select ep, round(distance, 5) + 0.0 as distance from (select ep, round(distance, 9) as distance from nn order by 2, 1 limit 1)",
    "drift_thresholds": f"with {transit(2.0, 5e-4)}, {LAGS} select greatest(ceil(quantile_cont(abs(lag), 0.9)), 1)::bigint as warning, greatest(ceil(quantile_cont(abs(lag), 0.99)), 2)::bigint as critical from lg where lag is not null",
    "leaderboard": "with b as (select o_custkey % 50 as dataset, max(o_totalprice / 10000) as score from orders where o_orderstatus <> 'F' group by 1) select row_number() over (order by b.score desc, dataset) as rank, dataset, round(b.score, 6) + 0.0 as score from b",
    "not_audited": "select distinct o_custkey % 50 as dataset, o_orderkey % 5 as revision from orders except select o_custkey % 50, o_orderkey % 5 from orders where o_orderkey % 61 = 0 and o_custkey % 4 <> 0",
    "audit_snapshot": f"with {ASSESSED}, {FIRED} select 'events' as dataset, 'r1' as revision, a.ep, f.ep is not null as flagged, round(0.5 * quality_risk + 0.5 * anomaly, 6) + 0.0 as priority from assessed a join risk using (ep) left join (select distinct ep from fired_) f on f.ep = a.ep",
    "what_if": f"""with {FIGURES}, {GATE}, ch as (select ep from gate where status <> 'bad'), k as (select count(*) as k from ch), n as (select count(*) as n from figures), ra as (select ep from figures order by md5('42|' || ep), ep limit (select k from k)),
mm as (select 'full' as condition, n as n_episodes, {WHAT} from figures, n group by n union all select 'selected', k, {WHAT} from figures, k where ep in (select ep from ch) group by k union all select 'random', k, {WHAT} from figures, k where ep in (select ep from ra) group by k),
sc as (select *, round(greatest(100 - ({" + ".join(penalty(*x) for x in (("spike_rate", 8.0, 20.0, 0.02, 0.05), ("disc_rate", 8.0, 20.0, 0.02, 0.05), ("dropout", 7.0, 18.0, 0.01, 0.05), ("jitter_cv", 5.0, 12.0, 0.05, 0.20), ("ldlj", 10.0, 25.0, -10.0, -15.0)))}), 0), 1) as s from mm)
select condition, n_episodes, round(12.0 * n_episodes / n, 4) + 0.0 as hours, s + 0.0 as success, false as measured from sc, n""",
}
