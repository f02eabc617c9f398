"""DuckDB SQL of the queries in ``extended``, written from the definitions."""

from __future__ import annotations

import numpy as np

from .analysis_sql import CAMERA, FOLLOW
from .analysis_sql import SQL as ANALYSIS
from .oracles import EV, FIGURES, GATE, LI, PAIRS, SUMMARY, fingerprint
from .oracles import METRICS as METRICS_SQL


def projected(dims: tuple[str, ...], size: int = 64) -> str:
    """emb (ep, j, x)."""
    k = len(dims)
    p = np.random.default_rng(42 + k).normal(size=(k, size))
    values = ", ".join(f"({j}, {', '.join(repr(float(x)) for x in p[:, j])})" for j in range(size))
    mean = " + ".join(f"p{i} * m{i}" for i in range(k))
    cov = " + ".join(f"p{i} * p{j} * c{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k))
    sums = ", ".join([f"avg({c}) as m{i}" for i, c in enumerate(dims)] + [f"covar_pop({dims[i]}, {dims[j]}) as c{i}_{j}" for i in range(k) for j in range(i, k)])
    return f"""pj as (select * from (values {values}) t(j, {", ".join(f"p{i}" for i in range(k))})), mo as (select ep, {sums} from li group by ep),
raw as (select ep, j, {mean} + sqrt(greatest(0, {cov})) as v from mo, pj), emb as (select ep, j, v / sqrt(sum(v * v) over (partition by ep)) as x from raw)"""


EMB = projected(("a2", "a3"))
NEAREST = """vec as (select ep, list(x order by j) as v from emb group by ep), pr as (select a.ep, b.ep as neighbour, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 2 as d from vec a join vec b on a.ep <> b.ep),
nov as (select ep, min_by(neighbour, (d, neighbour)) as neighbour, min(d) as distance from pr group by ep)"""
CENTROID = """ce as (select j, avg(x) as c from emb group by j), cu as (select j, c / sqrt(sum(c * c) over ()) as c from ce), cd as (select ep, 1 - sum(x * c) as distance from emb join cu using (j) group by ep),
cm as (select median(distance) as mid from cd), cx as (select greatest(median(abs(distance - mid)), 1e-6) as mad from cd, cm), co as (select ep, distance, distance > mid + 3 * 1.4826 * mad as outlier from cd, cm, cx)"""
CLAIMS = """cl as (select o_orderkey as claim_id, ['velocity_discontinuity_rate', 'action_entropy', 'jitter_cv'][o_orderkey % 3 + 1] as metric, case when o_custkey % 5 = 0 then 'any' else o_orderpriority end as class,
  case o_orderstatus when 'F' then 'validated' when 'O' then 'active_hypothesis' else 'retired' end as status from orders)"""


def risk(value: str, scale: float, medium: float, high: float, critical: float) -> str:
    return f"case when {value} * {scale} >= {critical} then 'CRITICAL' when {value} * {scale} >= {high} then 'HIGH' when {value} * {scale} >= {medium} then 'MEDIUM' else 'LOW' end"


def clip(x: str) -> str:
    return f"greatest(0, least(100, 100 * ({x})))"


WEIGHTS = "(sd * (aa + 1e-4) - ad * sa) / ((ss + 1e-4) * (aa + 1e-4) - sa * sa) as ws, (ad * (ss + 1e-4) - sd * sa) / ((ss + 1e-4) * (aa + 1e-4) - sa * sa) as wa"
ERROR = "sqrt((r.dd - 2 * (w.ws * r.sd + w.wa * r.ad) + w.ws * w.ws * r.ss + 2 * w.ws * w.wa * r.sa + w.wa * w.wa * r.aa) / r.n)"
GAP = f"""with {FIGURES}, hz as (select ep, case when median(dt) filter (dt > 0) > 0 then 1 / median(dt) filter (dt > 0) end as hz from (select ep, t - lag(t) over (partition by ep order by step) as dt from ev) group by ep),
fs as (select ep % 2 as side, avg(ldlj) as l, avg(spike_rate) as s, avg(jitter_cv) as j, avg(hz) as h from figures join hz using (ep) group by 1), fp as (select a.l as al, b.l as bl, a.s as sa, b.s as sb, a.j as aj, b.j as bj, a.h as ah, b.h as bh from fs a, fs b where a.side = 0 and b.side = 1),
sp as (select min(a0) as lo, max(a0) as hi, (max(a0) - min(a0)) / 50 as w from ev), kb as (select least(floor((a0 - lo) / w), 49) as bin, sum((ep % 2 = 0)::int) as na, sum((ep % 2 = 1)::int) as nb from ev, sp group by 1),
kt as (select sum(na) as ta, sum(nb) as tb from kb), kp as (select (na / (ta * w) + 1e-10) / (1 / w + 50e-10) as p, (nb / (tb * w) + 1e-10) / (1 / w + 50e-10) as q from kb, kt, sp), kl as (select sum(p * ln(p / q)) as kl from kp),
rp as (select min(a0) as lo, max(a0) as hi, (max(a0) - min(a0)) / 20 as w from ev where ep % 2 = 1), rb as (select least(floor((a0 - lo) / w), 19) as bin, sum((ep % 2 = 0)::int) as na, sum((ep % 2 = 1)::int) as nb from ev, rp where a0 between lo and hi group by 1),
cv as (select avg((na > 0)::int) as cov from rb where nb > 0),
tr as (select ep, s0, a0, lead(s0) over (partition by ep order by step) - s0 as ds from ev), mm as (select ep % 2 as side, count(*) as n, sum(s0 * s0) as ss, sum(s0 * a0) as sa, sum(a0 * a0) as aa, sum(s0 * ds) as sd, sum(a0 * ds) as ad, sum(ds * ds) as dd from tr where ds is not null group by 1),
wt as (select side, {WEIGHTS} from mm), er as (select w.side, {ERROR} as e from wt w, mm r where r.side = 1), dy as (select greatest(0, a.e - b.e) as g from er a, er b where a.side = 0 and b.side = 1),
rows_ as (
  select 'ldlj_gap' as gap, al as sim, bl as real, round(abs(al - bl), 3) as value, {risk("abs(al - bl)", 1, 3, 8, 15)} as risk from fp
  union all select 'spike_rate_gap', sa, sb, round(abs(sa - sb), 4), {risk("abs(sa - sb)", 20, 1, 2, 4)} from fp
  union all select 'jitter_cv_gap', aj, bj, round(abs(aj - bj), 5), {risk("abs(aj - bj)", 10, 0.5, 1.5, 3)} from fp
  union all select 'action_kl_divergence', null, null, round(kl, 4), {risk("kl", 1, 0.5, 1.5, 3)} from kl
  union all select 'sim_coverage_of_real', null, null, round(cov, 3), case when cov >= 0.7 then 'LOW' when cov >= 0.4 then 'MEDIUM' else 'HIGH' end from cv
  union all select 'transition_dynamics_gap', null, null, round(g, 4), {risk("g", 10, 0.2, 0.5, 1)} from dy
  union all select 'control_frequency_gap', ah, bh, round(abs(ah - bh), 1), {risk("abs(ah - bh)", 1, 5, 15, 30)} from fp
), v as (select {", ".join(f"max(value) filter (gap = '{g}') as {n}" for n, g in (("k", "action_kl_divergence"), ("f", "control_frequency_gap"), ("c", "sim_coverage_of_real"), ("d", "transition_dynamics_gap")))} from rows_),
al as (select * from rows_ where value is not null union all select 'overall_risk', null, null, null, arg_max(risk, case risk when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 else 3 end) from rows_ where value is not null
  union all select 'alignment_index', null, null, round(({clip("1 - (k - 0.1) / 2.9")} + {clip("1 - f / 30")} + 100 * c + {clip("1 - d")} + 50) / 5, 1), null from v)
select gap, round(sim, 6) + 0.0 as sim, round(real, 6) + 0.0 as real, round(value, 6) + 0.0 as value, risk from al"""

SQL = {
    "episode_directory": f"""with {LI} select ep as episode_index, count(*) as n, max(step) as last, round(max(t), 6)::double as seconds, round(sum(a0), 3)::double as action, count(*) as states, 'episode_index,frame_index,timestamp,action,obs_state' as columns from li group by ep""",
    "session_counters": f"""with {FIGURES}, v as (select 's' || (ep % 3) as session, case when coalesce(spike_rate >= 0.05, false) or coalesce(disc_rate >= 0.05, false) or coalesce(dropout >= 0.05, false) or coalesce(ldlj <= -15, false) then 'FAIL'
  when coalesce(spike_rate >= 0.02, false) or coalesce(disc_rate >= 0.02, false) or coalesce(dropout >= 0.01, false) or coalesce(ldlj <= -10, false) then 'WARN' else 'PASS' end as verdict from figures)
select session, count(*) filter (verdict = 'PASS') as n_pass, count(*) filter (verdict = 'WARN') as n_warn, count(*) filter (verdict = 'FAIL') as n_fail from v group by session""",
    "dataset_gap": GAP,
    "projected_embeddings": f"with {LI}, {EMB} select ep, j, round(x, 6) + 0.0 as value from emb",
    "projected_novelty": f"with {LI}, {EMB}, {NEAREST} select ep, neighbour, round(distance, 7) + 0.0 as distance from nov",
    "projected_outliers": f"with {LI}, {EMB}, {CENTROID} select ep, round(distance, 7) + 0.0 as distance, outlier from co",
    "projected_flags": f"""with {LI}, {EMB}, {NEAREST}, {CENTROID} select 'ssl_trajectory_outliers' as metric, round(avg(outlier::int), 7) + 0.0 as value, case when avg(outlier::int) > 0.05 then 'WARNING' else 'OK' end as level from co
union all select 'ssl_dataset_sparsity', round(avg(distance), 7) + 0.0, case when avg(distance) > 0.6 then 'WARNING' else 'OK' end from nov""",
    "mean_nearest": """with s as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings order by md5('42|' || vec_id), vec_id limit 2000), p as (select a.vec_id, min(list_distance(a.v, b.v)) as d from s a join s b on a.vec_id <> b.vec_id group by 1)
select round(coalesce(avg(d), 0), 6) + 0.0 as distance from p""",
    "distance_walk": f"""with recursive {FOLLOW}, far as (select sqrt((s0 - lag(s0) over w) * (s0 - lag(s0) over w) + (s1 - lag(s1) over w) * (s1 - lag(s1) over w)) as x from fo window w as (partition by ep order by step)), ep_ as (select 3 * median(x) as eps from far),
wk as (
  select ep, step, s0 as z0, s1 as z1, step as start, a2 as total, 1::bigint as n, false as hit, null::bigint as o_start, null::double as o_z0, null::double as o_z1, null::double as o_a, null::double as d0, null::double as d1 from fo where step = 0
  union all
  select ep, step, case when hit then s0 else z0 end, case when hit then s1 else z1 end, case when hit then step else start end, case when hit then a2 else total + a2 end, case when hit then 1 else n + 1 end, hit, start, z0, z1, total / n, s0 - z0, s1 - z1
  from (select f.ep, f.step, f.s0, f.s1, f.a2, w.z0, w.z1, w.start, w.total, w.n, sqrt((f.s0 - w.z0) * (f.s0 - w.z0) + (f.s1 - w.z1) * (f.s1 - w.z1)) > eps as hit from wk w join fo f on f.ep = w.ep and f.step = w.step + 1, ep_)
)
select ep, o_start as start, step as "end", round(o_z0, 6) + 0.0 as z0, round(o_z1, 6) + 0.0 as z1, round(o_a, 6) + 0.0 as a, round(d0, 6) + 0.0 as d0, round(d1, 6) + 0.0 as d1 from wk where hit""",
    "regime_selection": f"""with {SUMMARY}, rl as (select case when coalesce(spike_rate, 0) < 0.025 and coalesce(disc_rate, 0) < 0.04 then 'low_noise' when coalesce(spike_rate, 0) >= 0.09 or coalesce(disc_rate, 0) >= 0.13 then 'high_noise' else 'moderate_noise' end as regime from summary),
lm as (select * from (values ('low_noise', 0.15, 0.30, 0.10, -35.0), ('moderate_noise', 0.25, 0.40, 0.15, -40.0), ('high_noise', 0.08, 0.15, 0.08, -25.0)) t(regime, ms, md, mo, ml) join rl using (regime)),
dl as (select any_value(md) * (1 + 2 * least(greatest((coalesce(avg(disc_rate), 0) / greatest(coalesce(avg(spike_rate), 0), 0.001) - 3) / 17, 0), 1)) as l from figures, lm),
rg as (select ep, n_steps, case when n_steps < 10 then 'length' else concat_ws(',', case when spike_rate > ms then 'spike_rate' end, case when disc_rate > l then 'disc_rate' end, case when dropout > mo then 'dropout' end, case when ldlj < ml then 'ldlj' end) end as reasons from figures, lm, dl),
pa as (select ep, row_number() over (order by n_steps desc, ep) as place from rg where reasons = ''), kk as (select greatest(1, round_even(0.3 * (select count(*) from rg), 0)) as k)
select g.ep, case when reasons <> '' then 'quality_fail' when place <= k then 'keep' else 'diversity_pruned' end as decision, case when reasons <> '' then reasons when place <= k then '' else 'not_selected_influence' end as reasons from rg g left join pa on pa.ep = g.ep, kk""",
    "claim_confidence": f"""with {CLAIMS}, e as (select l_orderkey as claim_id, count(*) as n, count(*) filter (l_returnflag <> 'R') as s from lineitem group by 1)
select claim_id, coalesce(n, 0) as n_evidence, coalesce(s, 0) as n_supporting, case when coalesce(s, 0) = 0 then 'NOT VALIDATED' when s = 1 then 'LOW-MODERATE' when s <= 4 then 'MODERATE' when s <= 9 then 'HIGH' else 'STRONG' end as confidence from cl left join e using (claim_id)""",
    "active_claims": f"with {CLAIMS} select claim_id, metric, class, status, class = '1-URGENT' as specific from cl where metric = 'velocity_discontinuity_rate' and status in ('active_hypothesis', 'validated', 'provisional') and class in ('1-URGENT', 'any')",
    "study_status": "select case when bool_and(o_orderstatus <> 'P') then 'validated' when bool_or(o_orderstatus <> 'P') then 'partial' else 'simulated' end as status from orders",
    "resolved_state": f"""with {EV} select ep % 4 as dataset, case ep % 4 when 0 then 'proprio' when 1 then 'joint_state' when 2 then 'obs' end as state_key,
  count(*) filter (ep % 4 in (0, 2) or (ep % 4 = 1 and ep % 3 <> 0)) as n, round(sum(s0) filter (ep % 4 in (0, 2) or (ep % 4 = 1 and ep % 3 <> 0)), 3) + 0.0 as total from ev group by 1, 2""",
    "shaped_state": f"with {EV} select distinct ep, case when ep % 4 = 0 then 'state' when ep % 4 = 1 and ep % 3 <> 0 then 'joint_position' end as state_key from ev",
    "first_camera": """with f as (select label::bigint as ep, vec_id % 4 as k, case when vec_id % 4 = 1 and label % 3 = 0 then 2 else 3 + label % 2 end as dims from embeddings), g as (select ep, k, count(*) as n, max(dims) as dims from f where k > 0 group by ep, k)
select ep, ['rgb_static', 'wrist_image', 'depth'][min(k)] as camera from g where n >= 2 and dims in (3, 4) group by ep""",
    "video_span_problems": """with s as (select l_orderkey * 8 + l_linenumber as ep, printf('videos/top/chunk-%03d/file-%03d.mp4', l_orderkey // 1000, l_orderkey) as path, l_linenumber * 2 - l_discount * 20 as b, l_linenumber * 2 - l_discount * 20 + l_quantity / 25 + case when l_tax > 0.065 then 0.5 else 0 end as e, l_quantity as n from lineitem),
w as (select *, max(e) over (partition by path order by b, e, ep rows between unbounded preceding and 1 preceding) as r from s),
p as (select ep, path, 'empty' as problem, b - e as seconds from w where e <= b union all select ep, path, 'overlap', r - b from w where b - r < -0.04 union all select ep, path, 'gap', b - r from w where b - r > 0.04 union all select ep, path, 'length', abs(e - b - n / 25) from w where abs(e - b - n / 25) > 0.04)
select ep, 'top' as camera, path, problem, round(seconds, 6) + 0.0 as seconds from p""",
    "video_files": f"""with {LI}, n as (select ep, count(*) as length from li group by ep) select ep, camera, printf('videos/chunk-%03d/%s/episode_%06d.mp4', ep // 10, camera, ep) as path, length from n, (values ('top'), ('wrist')) c(camera)""",
    "proprio_latents": f"with {LI}, g as (select ep, [avg(a0), avg(a2), stddev_pop(a0), stddev_pop(a2)] as l from li group by ep) select ep, i::int as i, round(l[i + 1], 6) + 0.0 as value from g, range(0, 4) t(i)",
    "visual_latents": f"""with {CAMERA}, f as (select ep, list_avg(px) as m, list_aggregate(px, 'stddev_pop') as s from cam), g as (select ep, [avg(m), avg(s), stddev_pop(s)] as l from f group by ep) select ep, i::int as i, round(l[i + 1], 6) + 0.0 as value from g, range(0, 3) t(i)""",
    "bulk_audit": f"""with {FIGURES}, f as (select 'd' || (ep % 5) as dataset, * from figures join (select ep, non_monotonic as bad from timing) using (ep) where ep % 5 <> 3),
g as (select dataset, count(*) as n_episodes, avg(jitter_cv) as j, avg(dropout) as o, avg(spike_rate) as s, avg(disc_rate) as d, avg(ldlj) as l, bool_or(bad) as bad from f group by dataset),
m as (select dataset, j as v, j >= 0.30 as c, j >= 0.15 as w from g union all select dataset, o, o >= 0.05, o >= 0.01 from g union all select dataset, s, s >= 0.05, s >= 0.02 from g union all select dataset, d, d >= 0.05, d >= 0.02 from g
  union all select dataset, l, l <= -15, l <= -10 from g union all select dataset, bad::int, bad, false from g),
q as (select dataset, 100 * avg(case when c then 0 when w then 0.5 else 1 end) as score, count(*) filter (c) as n_critical, count(*) filter (w and not c) as n_warning from m where v is not null group by dataset)
select row_number() over (order by round(score, 6) desc, dataset) as rank, dataset, 'r1' as revision, n_episodes, round(score, 6) + 0.0 as score, n_critical, n_warning, case when score >= 90 then 'pass' when score >= 70 then 'review' else 'fail' end as verdict from q join g using (dataset)""",
    "state_direction_entropy": f"""with {FOLLOW}, x as (select ep, step, {", ".join(f"sign(s{k} - lag(s{k}) over (partition by ep order by step)) as g{k}" for k in range(4))} from fo), n as (select ep, g0, g1, g2, g3, count(*) as n from x where step > 0 group by all),
p as (select ep, n / sum(n) over (partition by ep) as p from n) select ep, round(-sum(p * log2(p)), 6) + 0.0 as bits from p group by ep""",
    "standalone_vectors": f"""with {FOLLOW}, x1 as (select *, s2 - lag(s2) over w as p1, s3 - lag(s3) over w as q1 from fo window w as (partition by ep order by step)), x2 as (select *, p1 - lag(p1) over w as p2, q1 - lag(q1) over w as q2 from x1 window w as (partition by ep order by step)),
x3 as (select *, sqrt((p2 - lag(p2) over w) * (p2 - lag(p2) over w) + (q2 - lag(q2) over w) * (q2 - lag(q2) over w)) as j from x2 window w as (partition by ep order by step)),
x4 as (select *, avg(j) over (partition by ep) as jm, stddev_pop(j) over (partition by ep) as js from x3)
select ep, round(avg((sqrt((a2 - s2) * (a2 - s2) + (a3 - s3) * (a3 - s3)) > 0.05)::int), 6) + 0.0 as tracking_gap, round(case when max(js) > 0 then avg(case when j is not null then (j > jm + 5 * js)::int end) else 0 end, 6) + 0.0 as jerk_spikes from x4 group by ep""",
    "approved_rows": f"with {FIGURES}, {GATE} select event_id, user_id as ep from events join gate on gate.ep = user_id where status = 'clean'",
    "reference_metrics": """select l_returnflag || l_linestatus as name, round(avg(l_tax), 9)::double as jitter_cv, null::double as dropout_rate, case when l_returnflag <> 'A' then -round(avg(l_quantity), 9)::double end as ldlj,
  round(avg(l_discount), 9)::double as spike_rate, null::double as vel_disc_rate, null::double as action_entropy from lineitem group by l_returnflag, l_linestatus""",
    "coherent_gate": f"""with {PAIRS}, {fingerprint("pr")}, n as (select count(*) as n from embeddings), c as (select ft.conv_id, ft.turn, passed, list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) as coherence
  from ft, n join embeddings a on a.vec_id = ft.conv_id % n.n join embeddings b on b.vec_id = (ft.conv_id * 7 + ft.turn) % n.n)
select conv_id, turn, round(coherence, 6) + 0.0 as coherence, passed and round(coherence, 12) >= 0.10 as passed from c""",
    "report_drift": f"""with t as ({ANALYSIS["permutation_drift"]}), n as (select * from (values ('jitter_cv', 'timestamp_jitter_cv', 0.15, 0.30), ('dropout', 'timestamp_dropout_rate', 0.01, 0.05), ('spike_rate', 'jerk_spike_rate', 0.02, 0.05), ('disc_rate', 'velocity_discontinuity_rate', 0.02, 0.05)) v(metric, name, warn, crit)),
g as (with {METRICS_SQL} select metric, avg(value) filter (ep % 2 = 0) as a, avg(value) filter (ep % 2 = 1) as b from m group by metric),
z as (select name, a, b, b - a as d, p_value, p_value < 0.05 as sig, case when round(b - a, 9) = 0 then 'ambiguous' when b > a then 'degraded' else 'improved' end as way, case when b >= crit then 'CRITICAL' when b >= warn then 'WARNING' else 'OK' end as lv from g join n using (metric) join t using (metric) where a is not null and b is not null)
select name as metric, round(a, 6) + 0.0 as baseline, round(b, 6) + 0.0 as candidate, round(d, 6) + 0.0 as delta, round(case when abs(a) > 1e-12 then d / abs(a) end, 6) + 0.0 as relative_change, p_value, sig as significant, way as direction,
  case when not sig then 'INFO' when way = 'improved' then 'OK' when way = 'degraded' then lv else 'INFO' end as level from z""",
    "corruption_reactions": f"""with c as ({ANALYSIS["corruption_report"]}) select *, case when abs(delta) < l then 'none' when delta <= 0 then 'better' when abs(delta) > 5 * l then 'strong' else 'worse' end as reaction from (select *, case metric when 'jitter_cv' then 0.001 else 0.005 end as l from c)""".replace("select *, case when abs", "select metric, before, after, delta, case when abs"),
}
