"""DuckDB SQL of the queries in ``reporting``, written from the definitions."""

from __future__ import annotations

from .analysis_sql import SIMILAR
from .analysis_sql import SQL as ANALYSIS
from .oracles import DIMS, EV, FIGURES, GATE, LI, PAIRS, SUMMARY, TIMING, fingerprint, outcome
from .oracles import SQL as CORE

DOUBLED = f"""{EV}, db as (select ep, step, a0, s0 from ev union all select ep + 1000000, step, case when ep % 2 = 1 then a0 + 1 else a0 end, s0 from ev),
dg as (select ep, string_agg(step || ',' || coalesce(a0::varchar, 'null') || ',' || coalesce(s0::varchar, 'null'), ';' order by step) as digest from db group by ep),
cp as (select * from (select ep, min(ep) over (partition by digest) as original from dg) where ep <> original)"""
ALL_FLAGS = f"""{DOUBLED}, af as (select metric, value, level from ({ANALYSIS["full_report"]})
union all select 'duplicate_episode_fraction', (select count(*) from cp) / (select count(*) from dg), case when (select count(*) from cp) > 0 then 'CRITICAL' else 'OK' end),
names as (select * from (values {", ".join(f"('{c}', '{m}')" for c, ms in {
    "Timestamps & sync": "timestamp_jitter_cv timestamp_dropout_rate timestamp_non_monotonic timestamp_scale_mismatch action_obs_misalignment camera_physics_drift",
    "Episode structure": "action_dropout_rate short_episode_fraction duplicate_episode_fraction",
    "Camera feed": "duplicate_frame_rate camera_freeze_events blurry_episode_fraction camera_view_name_mismatch",
    "Motion & control": "jerk_spike_rate velocity_discontinuity_rate joint_offset_max_abs",
}.items() for m in ms.split())}) t(category, metric))"""

#: spikes: 9 at warning, 9 * 20 / 8 at critical.
PENALTIES = {"spike_rate": (9.0, 22.5), "disc_rate": (8.0, 20.0), "dropout": (7.0, 18.0), "jitter_cv": (5.0, 12.0), "entropy": (10.0, 20.0)}
BOUNDS = {
    "act": {"spike_rate": (0.005, 0.01), "disc_rate": (0.04, 0.08)},
    "diffusion_policy": {"spike_rate": (0.05, 0.10), "disc_rate": (0.15, 0.30)},
    "octo": {"spike_rate": (0.05, 0.10), "disc_rate": (0.05, 0.15)},
}
SAME = {"dropout": (0.01, 0.05), "jitter_cv": (0.05, 0.20), "entropy": (2.0, 1.0)}


def rules(policy: str, **other) -> dict:
    return {m: (*(other.get(m) or p), *(SAME | BOUNDS[policy])[m]) for m, p in PENALTIES.items()}


def unrounded(policy: str) -> str:
    """o0 (s, n): the heuristic of a policy with the published penalties."""
    return outcome("summary", rules(policy, spike_rate=(8.0, 20.0))).split("\nselect")[0]


FEATURES = [f"{k}_{c}" for c in ("a2", "a3") for k in ("m", "d")]


def features(where: str) -> str:
    return f"select ep, {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as d_{c}' for c in ('a2', 'a3'))} from li where {where} group by ep"


def clipped(x: str, lo: str, hi: str) -> str:
    return f"least(greatest(case when {hi} > {lo} then ({x} - {lo}) / ({hi} - {lo}) else {x} - {lo} end, 0), 1)"


OWN = [f"{f}(m_a2, d_a2, m_a3, d_a3)" for f in ("least", "greatest")]
DIAGNOSED = f"""{LI}, fr as ({features("l_returnflag <> 'R'")}), fq as ({features("l_returnflag = 'R'")}),
sp as (select {", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in FEATURES)} from fr),
tr as (select ep, {", ".join(f"case when hi_{c} > lo_{c} then ({c} - lo_{c}) / (hi_{c} - lo_{c}) else 0.0 end as {c}" for c in FEATURES)} from fr, sp),
fa as (select 'own' as scale, ep, {", ".join(f"{clipped(c, *OWN)} as {c}" for c in FEATURES)} from fq
  union all select 'training', ep, {", ".join(f"{clipped(c, f'lo_{c}', f'hi_{c}')} as {c}" for c in FEATURES)} from fq, sp),
ds as (select scale, a.ep, sqrt({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATURES)}) as d from fa a, tr b),
g as (select scale, ep, min(d) as distance, sum((d < 0.15)::int)::bigint as n_close, sum((d < 0.30)::int)::bigint as n_near from ds group by all),
v as (select *, case when n_close >= 3 then 'COVERED' when n_near >= 1 then 'PARTIAL' else 'MISSING' end as verdict, (case when n_close >= 3 then 0 when n_near >= 1 then greatest(0, 5 - n_close) else 8 end)::bigint as to_collect from g)"""

SQL = {
    "phase_flags": f"""with p as ({CORE["phase_fractions"]}), g as (select avg(contact) as c, avg(approach) as a from p)
select 'contact_phase_fraction' as metric, round(c, 6) + 0.0 as value, case when c <= 0.05 then 'CRITICAL' when c <= 0.10 then 'WARNING' else 'OK' end as level from g
union all select 'approach_phase_dominance', round(a, 6) + 0.0, case when a > 0.80 then 'INFO' else 'OK' end from g""",
    "copied_episodes": f"with {DOUBLED} select ep, original from cp",
    "integrity_categories": f"""with {ALL_FLAGS} select category, count(level) as n_flags, case when bool_or(level = 'CRITICAL') then 'CRITICAL' when bool_or(level = 'WARNING') then 'WARNING' when bool_or(level = 'OK') then 'OK' end as level
from names left join af using (metric) group by category""",
    "one_shot_analysis": f"""with {ALL_FLAGS}, rd as ({ANALYSIS["voxel_redundancy"]}),
sc as (select coalesce(round_even(100 * avg(case level when 'OK' then 1.0 when 'WARNING' then 0.5 when 'CRITICAL' then 0.0 end), 0), 100)::bigint as score from af join names using (metric)),
ct as (select sum((level = 'CRITICAL')::int)::bigint as n_critical, sum((level = 'WARNING')::int)::bigint as n_warning from af), ne as (select count(distinct ep) as n_episodes from ev)
select n_episodes, n_critical, n_warning, score, case when score >= 90 then 'Healthy' when score >= 70 then 'Warning' else 'Critical' end as status, case when n_episodes >= 5 then redundancy end as redundancy,
  case when n_episodes >= 5 and redundancy is not null then round_even(least(greatest(1 - redundancy, 0.15), 0.85), 2) else 0.5 end as keep_fraction from ne, ct, sc, rd""",
    "policy_outcomes": " union all ".join(f"select '{p}' as policy, * from (with {SUMMARY}, {outcome('summary', rules(p))})" for p in BOUNDS),
    "predicted_outcome": f"""with {SIMILAR}, {unrounded("act")},
se as (select count(*) as k, min(d) as d, sum((ep % 10) / 10 * 100 / (d + 1e-6)) / sum(1 / (d + 1e-6)) as seen from sim),
w as (select s, n, k, seen, case when k = 0 then 0 else 0.6 * least(1, k / 5) * greatest(0, 1 - d / 0.4) end as w from o0, se),
x as (select s, w, case when k = 0 then s else round(least(greatest((1 - w) * s + w * seen, 0), 100), 1) end as m, least(5 + 2.0 * n, 15) * (1 - 0.5 * round(w, 3)) as margin from w)
select round(s, 1) as heuristic, round(m, 1) as score, round(w, 3) as weight, case when m >= 80 then 'STRONG' when m >= 60 then 'GOOD' when m >= 40 then 'MARGINAL' when m >= 20 then 'RISKY' else 'UNLIKELY' end as tier,
  round(greatest(m - margin, 0), 1) as low, round(least(m + margin, 100), 1) as high from x""",
    "frame_rate_summary": f"""with {EV}, {TIMING}, g as (
  select ep, count(*) as n_frames, avg(case when dt > 0 then 1 / dt end) as f, stddev_pop(case when dt > 0 then 1 / dt end) as fs, avg(dt) as m, stddev_pop(dt) as s, any_value(mid) as mid, avg(case when dt is not null then (dt > 3 * mid)::int end) as gaps from dm group by ep
) select ep, n_frames, round(case when n_frames < 2 then 0 else f end, 3) + 0.0 as mean_fps, round(case when n_frames < 2 then 0 else fs end, 3) + 0.0 as std_fps,
  round(case when m > 0 then s / m else 0 end, 3) + 0.0 as cv, round(case when mid > 0 then gaps else 0 end, 3) + 0.0 as dropout_rate from g""",
    "diagnosed_failures": f"""with {DIAGNOSED} select scale, ep, round(distance, 5) + 0.0 as distance, n_close, n_near, verdict, to_collect,
  round(case when to_collect > 0 then least(61.5 + least(0.5, to_collect * 0.03) * 10 / 1.5, 100) else 61.5 end, 1) as success_after from v""",
    "collection_focus": f"""with {LI}, f as (select ep, {", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as d_{c}" for c in DIMS)} from li where l_returnflag = 'R' group by ep),
""" + " union all ".join(f"select ep, '{c}' as dim, round(m_{c} - 1.5 * greatest(d_{c}, 0.05), 9) + 0.0 as low, round(m_{c} + 1.5 * greatest(d_{c}, 0.05), 9) + 0.0 as high from f" for c in DIMS).join(("x as (", ") select * from x")),
    "transition_flag": f"""{CORE["transition_dynamics"].split("select ep, round")[0]} select 'dynamics_prediction_rmse' as metric, round(sqrt(avg(pow(ds - ws * s0 - wa * a0, 2))), 4) + 0.0 as value, 'INFO' as level from x, f""",
    "characterised_episodes": f"""with {FIGURES}, {GATE}, ea as ({CORE["episode_assessment"]}), inf as ({CORE["influence"]})
select g.ep, case when status = 'bad' then 'drop' when status = 'not_evaluated' then 'review' when g.ep % 2 = 0 then 'keep' else 'drop' end as disposition, n_steps, round(100 * (1 - quality_risk), 1) as score,
  quality_risk, anomaly, round(influence, 4) as coverage_value, round(1 - round(influence, 4), 4) + 0.0 as redundancy, case when status = 'bad' then reasons else '' end as integrity_flags
from gate g join figures using (ep) left join ea using (ep) left join inf using (ep)""",
    "fault_detectors": f"""with {DOUBLED}, ea as ({CORE["episode_assessment"]}), gt as ({CORE["quality_gate"]}), n as (select ep, count(*) as n_steps from ev group by ep),
q as (select quantile_cont(n_steps, 0.25) as q1, median(n_steps) as m, quantile_cont(n_steps, 0.75) as q3 from n),
s as (select n.ep, coalesce(status = 'bad', false) as stage1, cp.ep is not null as copy, coalesce(n_steps < q1 - 1.5 * greatest(q3 - q1, 0.25 * m), false) as short, quality_risk, anomaly
  from n cross join q join gt using (ep) join ea using (ep) left join cp on cp.ep = n.ep + 1000000)
select ep, stage1 or copy or short as flagged, stage1 or copy as blocked, copy as duplicate, short as short_outlier, stage1 as stage1_fail, false as video_fault, coalesce(quality_risk >= 0.4, false) as quality_risk, coalesce(anomaly >= 0.9, false) as anomaly from s""",
    "whole_sft_outcome": f"""with {PAIRS}, {fingerprint("pr")}, n as (select count(*) as n from embeddings), v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
c as (select ft.*, conv_id * 1000 + turn as key, a.v as point, round(list_cosine_similarity(a.v, b.v), 12) as coherence from ft, n join v a on a.vec_id = ft.conv_id % n.n join v b on b.vec_id = (ft.conv_id * 7 + ft.turn) % n.n),
kept as (select * from c where passed and coalesce(coherence >= 0.10, true)), sm as (select key, point from kept order by md5('42|' || key), key limit 2000),
nn as (select a.key, min(list_distance(a.point, b.point)) as d from sm a join sm b on a.key <> b.key group by 1),
ag as (select avg(coherence) as coherence, avg(repetition) as repetition, avg(template) as template, avg(words) as words, (select coalesce(avg(d), 0) from nn) as diversity from kept), """ + outcome("ag", {"coherence": (15.0, 30.0, 0.15, 0.05), "repetition": (10.0, 20.0, 0.25, 0.40), "template": (8.0, 18.0, 0.10, 0.30), "words": (10.0, 20.0, 15.0, 5.0), "diversity": (12.0, 22.0, 0.15, 0.05)}),
}
