"""Versions, policies, adaptation tables and reports over scores and flags derived from the events."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import lattice as A, policies as V, reports as R_
from tidemark.operators.distribution import feature_vote
from tidemark.operators.streams import confirm, ddm
from tidemark.plans.ordered import with_each, with_reference
from tidemark.workload.base import EV, R, error_events, events, query, rounded
from tidemark.workload.stream_queries import AUC_V, DDM, F1, FLAGS, raw_flags

# --- score tables ------------------------------------------------------------------------------------------------

def version_scores(spark, d):
    """Every event scored by the versions trained through each week but the last: the older the version, the less it knows."""
    ev = events(spark, d).filter("week > 0").select(F.col("event_id").alias("row_id"), "week", (F.col("event_type") == "error").cast("int").alias("label"), "user_id")
    last = ev.agg(F.coalesce(F.max("week"), F.lit(1)).cast("long")).first()[0]
    rows = ev.withColumn("version", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last - 1))))
    knows = F.greatest(F.lit(0.0), F.lit(0.5) - 0.06 * (F.col("week") - F.col("version")))
    noise = (F.col("user_id") * 31 + F.col("version") * 7 + F.col("row_id")) % 97 / F.lit(97.0)
    return rows.select("row_id", "version", "week", "label", (noise * (1 - knows) + F.col("label") * knows).alias("score"), (F.lit(0.5) + 0.01 * F.col("version")).alias("threshold"))


VS = EV + f""",
 vs0 AS (SELECT event_id AS row_id, week, (event_type = 'error')::INT AS label, user_id, v AS version, greatest(0.0::DOUBLE, 0.5::DOUBLE - 0.06::DOUBLE * (week - v)) AS k FROM ev, (SELECT unnest(range((SELECT max(week) FROM ev))) AS v) WHERE week > 0),
 vs AS (SELECT row_id, version, week, label, ((user_id * 31 + version * 7 + row_id) % 97 / 97.0::DOUBLE) * (1 - k) + label * k AS score, 0.5::DOUBLE + 0.01::DOUBLE * version AS threshold FROM vs0),
 pm1 AS (SELECT version, week, sum(CASE WHEN label = 1 THEN rk END) AS rs, sum(label) AS p, sum(1 - label) AS q FROM (SELECT version, week, label,
   rank() OVER (PARTITION BY version, week ORDER BY score) + (count(*) OVER (PARTITION BY version, week, score) - 1) / 2.0::DOUBLE AS rk FROM vs WHERE week > version) GROUP BY ALL),
 pm2 AS (SELECT version, week, sum((score >= threshold AND label = 1)::INT) AS tp, sum((score >= threshold AND label = 0)::INT) AS fp, sum((score < threshold AND label = 1)::INT) AS fn FROM vs WHERE week > version GROUP BY ALL),
 pm AS (SELECT version, week, {AUC_V} AS auc, {F1} AS f1 FROM pm1 JOIN pm2 USING (version, week))"""

RT = FLAGS + """, rt AS (SELECT method, week FROM (SELECT method, week, sum(raw_flag::INT) OVER (PARTITION BY method ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 AS c FROM fl) WHERE c)"""


def retrains(spark, d):
    """(method, week) at which a flag sequence was confirmed."""
    return confirm(raw_flags(spark, d)).filter("confirmed_flag").select("method", "week")


def week_list(spark, d):
    return events(spark, d).filter("week > 0").select("week").distinct()


def method_list(spark, d):
    return events(spark, d).select(F.col("event_type").alias("method")).distinct()


@query("missing_versions", f"WITH {RT} SELECT DISTINCT week AS trained_through_week FROM rt WHERE week NOT IN (SELECT week FROM fl WHERE week % 3 = 0)")
def _(spark, d):
    have = week_list(spark, d).filter("week % 3 = 0").select(F.col("week").alias("trained_through_week"))
    return V.missing_versions(retrains(spark, d), have)


@query("adoption_log", f"""WITH {RT} SELECT method, week, coalesce(lag(week) OVER w, 0) AS from_version, week AS to_version, 'confirmed' AS reason, row_number() OVER w::INT AS retrain_count FROM rt WINDOW w AS (PARTITION BY method ORDER BY week)""".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def _(spark, d):
    return V.adopt(retrains(spark, d).withColumn("reason", F.lit("confirmed")))


@query("version_in_force", f"""WITH {RT}, w AS (SELECT DISTINCT week FROM fl), m AS (SELECT DISTINCT method FROM ev, (SELECT DISTINCT event_type AS method FROM events))
SELECT m.method, w.week, coalesce((SELECT max(rt.week) FROM rt WHERE rt.method = m.method AND rt.week < w.week), 0)::BIGINT AS version FROM m, w""".replace("SELECT DISTINCT method FROM ev, (SELECT DISTINCT event_type AS method FROM events)", "SELECT DISTINCT event_type AS method FROM events"))
def _(spark, d):
    return V.version_in_force(V.adopt(retrains(spark, d).withColumn("reason", F.lit("confirmed"))), week_list(spark, d), method_list(spark, d))


@query("sharing_summary", f"WITH {RT}, s AS (SELECT count(DISTINCT week) + 1 AS a, count(*) + 5 AS b FROM (SELECT DISTINCT method, week FROM rt)) SELECT a AS distinct_models, b AS naive_models, {R('b::DOUBLE / a', 'reduction_ratio')} FROM s")
def _(spark, d):
    return rounded(V.sharing_summary(V.adopt(retrains(spark, d).withColumn("reason", F.lit("confirmed"))), 5), "reduction_ratio")


@query("performance_matrix", f"WITH {VS} SELECT version, week, {R('auc', 'auc')}, {R('f1', 'f1')} FROM pm")
def _(spark, d):
    return rounded(V.performance_matrix(version_scores(spark, d)), "auc", "f1")


@query("performance_pivot", f"WITH {VS}, v AS (SELECT DISTINCT version FROM pm), w AS (SELECT DISTINCT week FROM pm) SELECT version, week, {R('auc', 'auc')} FROM v CROSS JOIN w LEFT JOIN pm USING (version, week)")
def _(spark, d):
    """The pivoted table as rows (version, week, auc), null where a version has no cell."""
    wide = V.pivot_matrix(V.performance_matrix(version_scores(spark, d)))
    cells = wide.unpivot(["version"], [c for c in wide.columns if c != "version"], "week", "auc")
    return rounded(cells.withColumn("week", F.col("week").cast("long")), "auc")


PF = f"""WITH {VS}, fl AS (SELECT event_type AS method, week, avg(value) > 50 AS raw_flag FROM ev WHERE week > 0 GROUP BY ALL),
 rt AS (SELECT method AS policy, week FROM (SELECT method, week, sum(raw_flag::INT) OVER (PARTITION BY method ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 AS c FROM fl) WHERE c),
 ww AS (SELECT DISTINCT week FROM fl), pp AS (SELECT DISTINCT event_type AS policy FROM events),
 pf AS (SELECT policy, week, coalesce((SELECT max(rt.week) FROM rt WHERE rt.policy = pp.policy AND rt.week < ww.week), 0)::BIGINT AS version FROM pp, ww
   UNION ALL SELECT 'never_retrain', week, 0 FROM ww UNION ALL SELECT 'always_retrain', week, week - 1 FROM ww),
 pe AS (SELECT policy, count(DISTINCT CASE WHEN version > 0 THEN version END) AS n_retrains, avg(auc) AS mean_auc, min(auc) AS min_auc, avg(f1) AS mean_f1, min(f1) AS min_f1, count(auc) AS weeks_evaluated, sum((pm.version IS NULL)::INT)::BIGINT AS weeks_unavailable
   FROM pf LEFT JOIN pm USING (version, week) GROUP BY policy)"""
PF = PF.replace("sum((pm.version IS NULL)::INT)", "sum((auc IS NULL)::INT)")


def policies(spark, d):
    """(policy, week, version) of every flag sequence and the two reference policies."""
    weeks = week_list(spark, d)
    grid = with_each(method_list(spark, d).withColumnRenamed("method", "policy"), weeks)
    own = V.policy_from_retrains(retrains(spark, d).withColumnRenamed("method", "policy"), grid)
    return own.unionByName(V.reference_policies(weeks))


@query("policy_versions", PF + " SELECT policy, week, version FROM pf")
def _(spark, d):
    return policies(spark, d)


@query("evaluate_policies", PF + f" SELECT policy, n_retrains, {R('mean_auc', 'mean_auc')}, {R('min_auc', 'min_auc')}, {R('mean_f1', 'mean_f1')}, {R('min_f1', 'min_f1')}, weeks_evaluated, weeks_unavailable FROM pe")
def _(spark, d):
    return rounded(V.evaluate_policies(policies(spark, d), V.performance_matrix(version_scores(spark, d))), "mean_auc", "min_auc", "mean_f1", "min_f1")


@query("random_control", PF + f""", dr AS (SELECT s AS sample, week, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || week || ':42'), week) AS pos FROM ww, (SELECT unnest(range(50)) AS s)),
 dp AS (SELECT policy, sample, week FROM dr JOIN pe ON pos <= n_retrains), dg AS (SELECT policy, sample, ww.week FROM (SELECT DISTINCT policy, sample FROM dp), ww),
 df AS (SELECT policy, sample, week, coalesce((SELECT max(dp.week) FROM dp WHERE dp.policy = dg.policy AND dp.sample = dg.sample AND dp.week < dg.week), 0) AS version FROM dg),
 ds AS (SELECT policy, sample, round(avg(auc), 9) AS r FROM df LEFT JOIN pm USING (version, week) GROUP BY ALL)
SELECT pe.policy, {R('avg((round(mean_auc, 9) >= r)::INT)', 'random_control_percentile')}, {R('avg(r)', 'random_control_mean_auc')}, count(r) AS n_samples, avg((round(mean_auc, 9) >= r)::INT) >= 0.95 AS beats_random_control
FROM pe LEFT JOIN ds ON ds.policy = pe.policy GROUP BY pe.policy""")
def _(spark, d):
    matrix = V.performance_matrix(version_scores(spark, d))
    out = V.random_control(V.evaluate_policies(policies(spark, d), matrix), matrix, week_list(spark, d), 50)
    return rounded(out, "random_control_percentile", "random_control_mean_auc")


@query("agreement_jaccard", f"""WITH {FLAGS}, h AS (SELECT DISTINCT method, week FROM fl WHERE raw_flag), m AS (SELECT DISTINCT method FROM fl),
 c AS (SELECT a.method AS method_a, b.method AS method_b, (SELECT count(*) FROM h x JOIN h y ON x.week = y.week WHERE x.method = a.method AND y.method = b.method) AS i, (SELECT count(*) FROM h WHERE h.method = a.method) AS na, (SELECT count(*) FROM h WHERE h.method = b.method) AS nb FROM m a, m b)
SELECT method_a, method_b, round(CASE WHEN method_a = method_b THEN 1.0::DOUBLE ELSE i::DOUBLE / nullif(na + nb - i, 0) END, 6) AS jaccard FROM c""")
def _(spark, d):
    return rounded(V.agreement_jaccard(raw_flags(spark, d), "raw_flag"), "jaccard")


@query("gain_decomposition", PF + f""", n AS (SELECT CASE policy WHEN 'click' THEN 'adwin' WHEN 'view' THEN 'eddm' WHEN 'error' THEN 'always_partial_update' WHEN 'signup' THEN 'rl_agent_greedy' ELSE policy END AS policy, mean_auc FROM pe),
 g AS (SELECT max(CASE WHEN policy IN ('adwin', 'eddm') THEN mean_auc END) AS b, max(CASE WHEN policy = 'always_partial_update' THEN mean_auc END) AS c, max(CASE WHEN policy = 'rl_agent_greedy' THEN mean_auc END) AS l FROM n)
SELECT {R('b', 'best_classical')}, {R('c - b', 'action_gain')}, {R('l - c', 'policy_gain')}, {R('l - b', 'total_gain')}, {R('coalesce(100 * (c - b) / nullif(l - b, 0), 0)', 'action_share_pct', 3)} FROM g""")
def _(spark, d):
    pe = V.evaluate_policies(policies(spark, d), V.performance_matrix(version_scores(spark, d)))
    name = F.create_map(*[F.lit(x) for p in (("click", "adwin"), ("view", "eddm"), ("error", "always_partial_update"), ("signup", "rl_agent_greedy")) for x in p])
    out = V.gain_decomposition(pe.withColumn("policy", F.coalesce(F.try_element_at(name, F.col("policy")), F.col("policy"))))
    return rounded(rounded(out, "best_classical", "action_gain", "policy_gain", "total_gain"), "action_share_pct", digits=3)


# --- adaptation lattice ------------------------------------------------------------------------------------------

STATES = ((0, None), (0, 2), (0, 5), (3, None), (3, 5), (5, None))


def state_scores(spark, d):
    """(full_week, partial_week, week, row_id, label, score) of six adaptation states."""
    ev = events(spark, d).filter("week > 0").select(F.col("event_id").alias("row_id"), "week", (F.col("event_type") == "error").cast("int").alias("label"), "user_id")
    states = F.array(*[F.struct(F.lit(f).cast("long").alias("full_week"), F.lit(p).cast("long").alias("partial_week")) for f, p in STATES])
    rows = ev.withColumn("_s", F.explode(states)).select("row_id", "week", "label", "user_id", "_s.*")
    last = F.coalesce("partial_week", "full_week")
    knows = F.greatest(F.lit(0.0), F.lit(0.4) - 0.05 * (F.col("week") - last))
    noise = (F.col("user_id") * 13 + last * 5 + F.col("row_id")) % 89 / F.lit(89.0)
    return rows.select("full_week", "partial_week", "week", "row_id", "label", (noise * (1 - knows) + F.col("label") * knows).alias("score"))


_VALUES = ", ".join(f"({f}::BIGINT, {'NULL' if p is None else p}::BIGINT)" for f, p in STATES)
LT = EV + f""",
 ls0 AS (SELECT event_id AS row_id, week, (event_type = 'error')::INT AS label, user_id, f AS full_week, p AS partial_week, coalesce(p, f) AS lw FROM ev, (VALUES {_VALUES}) s(f, p) WHERE week > 0),
 ls1 AS (SELECT *, greatest(0.0::DOUBLE, 0.4::DOUBLE - 0.05::DOUBLE * (week - lw)) AS k, (user_id * 13 + lw * 5 + row_id) % 89 / 89.0::DOUBLE AS n FROM ls0),
 ls AS (SELECT full_week, partial_week, week, row_id, label, n * (1 - k) + label * k AS score FROM ls1),
 lb AS (SELECT a.full_week, a.partial_week, a.week, a.row_id, a.label, al AS alpha, al * a.score + (1 - al) * b.score AS score FROM ls a JOIN ls b ON b.full_week = 0 AND b.partial_week IS NULL AND b.row_id = a.row_id,
   (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS al) WHERE a.week > a.full_week AND a.week > coalesce(a.partial_week, -1)),
 lp1 AS (SELECT full_week, partial_week, alpha, week, sum(CASE WHEN label = 1 THEN rk END) AS rs, sum(label) AS p, sum(1 - label) AS q FROM (SELECT *, rank() OVER (PARTITION BY full_week, partial_week, alpha, week ORDER BY score)
   + (count(*) OVER (PARTITION BY full_week, partial_week, alpha, week, score) - 1) / 2.0::DOUBLE AS rk FROM lb) GROUP BY ALL),
 lp2 AS (SELECT full_week, partial_week, alpha, week, sum((score >= 0.5 AND label = 1)::INT) AS tp, sum((score >= 0.5 AND label = 0)::INT) AS fp, sum((score < 0.5 AND label = 1)::INT) AS fn FROM lb GROUP BY ALL),
 lp AS (SELECT a.full_week, a.partial_week, a.alpha, a.week, round({AUC_V}, 6) AS auc, round({F1}, 6) AS f1 FROM lp1 a JOIN lp2 b ON b.full_week = a.full_week AND b.partial_week IS NOT DISTINCT FROM a.partial_week AND b.alpha = a.alpha AND b.week = a.week)"""


def lattice(spark, d):
    return rounded(A.lattice_performance(A.blend_scores(state_scores(spark, d), nested=True)), "auc", "f1")


@query("blend_scores", f"WITH {LT} SELECT full_week, partial_week, week, alpha, count(*) AS n, {R('avg(score)', 'mean_score')} FROM lb GROUP BY ALL")
def _(spark, d):
    out = A.blend_scores(state_scores(spark, d)).groupBy("full_week", "partial_week", "week", "alpha").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return rounded(out, "mean_score")


@query("lattice_performance", f"WITH {LT} SELECT full_week, partial_week, alpha, week, auc + 0.0 AS auc, f1 + 0.0 AS f1 FROM lp")
def _(spark, d):
    return lattice(spark, d)


@query("forgetting_cost", f"""WITH {LT}, b AS (SELECT full_week, partial_week, week, max(auc) AS m, max(CASE WHEN alpha = 1 THEN auc END) AS o FROM lp GROUP BY ALL)
SELECT b.full_week, b.partial_week, b.week, {R('m - o', 'cost')}, (SELECT min(alpha) FROM lp WHERE lp.full_week = b.full_week AND lp.partial_week IS NOT DISTINCT FROM b.partial_week AND lp.week = b.week AND lp.auc = b.m) AS best_alpha, {R('m', 'best_auc')} FROM b WHERE m - o > 0""")
def _(spark, d):
    return rounded(A.forgetting_cost(lattice(spark, d)), "cost", "best_auc")


def action_log(spark, d):
    """(policy, week, action): an action per event type and week, chosen by its mean value."""
    v = events(spark, d).filter("week > 0").groupBy(F.col("event_type").alias("policy"), "week").agg(F.floor(F.avg("value")).alias("v"))
    act = F.when(F.col("v") % 4 == 0, "full").when(F.col("v") % 4 == 1, "partial").when(F.col("v") % 4 == 2, "hedge").otherwise("none")
    return v.select("policy", "week", act.alias("action"))


ACT = """ ac AS (SELECT event_type AS policy, week, CASE floor(avg(value))::BIGINT % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'hedge' ELSE 'none' END AS action FROM ev WHERE week > 0 GROUP BY ALL),
 rs0 AS (SELECT *, coalesce((SELECT max(x.week) FROM ac x WHERE x.policy = ac.policy AND x.week <= ac.week AND x.action = 'full'), 0) AS full_week FROM ac),
 rs AS (SELECT policy, week, action, full_week, (SELECT max(x.week) FROM ac x WHERE x.policy = rs0.policy AND x.week <= rs0.week AND x.week > rs0.full_week AND x.action = 'partial') AS partial_week,
   greatest(0.0::DOUBLE, 1 - 0.25::DOUBLE * (SELECT count(*) FROM ac x WHERE x.policy = rs0.policy AND x.week <= rs0.week AND x.week > rs0.full_week AND x.action = 'hedge')) AS alpha FROM rs0)"""


@query("replay_actions", f"WITH {EV}, {ACT} SELECT policy, week, action, full_week, partial_week, alpha FROM rs")
def _(spark, d):
    return A.replay_actions(action_log(spark, d))


OUT = """ oc0 AS (SELECT *, lead(week) OVER (PARTITION BY policy ORDER BY week) AS nw FROM rs),
 oc AS (SELECT o.policy, o.week AS acted_week, o.nw AS week, o.action, o.full_week, o.partial_week, o.alpha, coalesce(b.auc, 0.5::DOUBLE) AS base, coalesce(x.auc, y.auc, b.auc, 0.5::DOUBLE) AS auc, CASE WHEN x.auc IS NOT NULL THEN x.f1 WHEN y.auc IS NOT NULL THEN y.f1 ELSE 0 END AS f1,
   CASE o.action WHEN 'partial' THEN 0.001::DOUBLE WHEN 'full' THEN 0.004::DOUBLE ELSE 0 END AS cost FROM oc0 o LEFT JOIN lp x ON x.full_week = o.full_week AND x.partial_week IS NOT DISTINCT FROM o.partial_week AND x.alpha = o.alpha AND x.week = o.nw
   LEFT JOIN lp y ON y.full_week = o.full_week AND y.partial_week IS NULL AND y.alpha = o.alpha AND y.week = o.nw LEFT JOIN lp b ON b.full_week = 0 AND b.partial_week IS NULL AND b.alpha = 1 AND b.week = o.nw WHERE o.nw IS NOT NULL),
 su AS (SELECT policy, sum(100 * (auc - base - cost)) AS total_reward, avg(auc) AS mean_auc, min(auc) AS min_auc, avg(f1) AS mean_f1, sum((action = 'full')::INT)::BIGINT AS full_retrains, sum((action = 'partial')::INT)::BIGINT AS partial_updates, sum((action = 'hedge')::INT)::BIGINT AS hedges FROM oc GROUP BY policy)"""


@query("policy_reward", f"""WITH {LT}, {ACT}, {OUT} SELECT policy, acted_week, week, action, full_week, partial_week, alpha, {R('auc', 'auc')}, {R('f1', 'f1')}, {R('auc - base', 'auc_delta')}, {R('100 * (auc - base - cost)', 'reward', 4)} FROM oc""")
def _(spark, d):
    out = A.score_actions(action_log(spark, d), lattice(spark, d))
    return rounded(rounded(out, "auc", "f1", "auc_delta"), "reward", digits=4)


@query("reward_summary", f"WITH {LT}, {ACT}, {OUT} SELECT policy, {R('total_reward', 'total_reward', 4)}, {R('mean_auc', 'mean_auc')}, {R('min_auc', 'min_auc')}, {R('mean_f1', 'mean_f1')}, full_retrains, partial_updates, hedges FROM su")
def _(spark, d):
    out = A.summarise_rewards(A.score_actions(action_log(spark, d), lattice(spark, d)))
    return rounded(rounded(out, "mean_auc", "min_auc", "mean_f1"), "total_reward", digits=4)


@query("fixed_schedules", f"""WITH {RT}, w AS (SELECT DISTINCT week FROM fl) SELECT 'fixed_schedule_every_2w' AS policy, week, CASE WHEN week % 2 = 0 THEN 'full' ELSE 'none' END AS action FROM w
UNION ALL SELECT 'always_partial_update', week, 'partial' FROM w UNION ALL SELECT m.method, w.week, CASE WHEN rt.week IS NULL THEN 'none' ELSE 'full' END FROM (SELECT DISTINCT method FROM fl) m CROSS JOIN w LEFT JOIN rt ON rt.method = m.method AND rt.week = w.week""")
def _(spark, d):
    weeks = week_list(spark, d)
    grid = with_each(method_list(spark, d).withColumnRenamed("method", "policy"), weeks)
    own = A.detector_actions(retrains(spark, d).withColumnRenamed("method", "policy"), grid)
    return A.fixed_schedule(weeks, 2).unionByName(A.constant_action(weeks, "partial", "always_partial_update")).unionByName(own)


def _again(sql: str) -> str:
    """The same CTEs under other names, for the random logs."""
    return re.sub(r"\b(ac|rs0|rs|oc0|oc|su)\b", r"\1_r", sql)


RANDOM = f"""WITH {LT}, {ACT}, {OUT},
 wk2 AS (SELECT DISTINCT week FROM ac), dr AS (SELECT s AS sample, week, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || week || ':42'), week) AS pos FROM wk2, (SELECT unnest(range(50)) AS s)),
 dp AS (SELECT policy, sample, week, CASE WHEN pos <= full_retrains THEN 'full' ELSE 'partial' END AS act FROM dr JOIN su ON pos <= full_retrains + partial_updates),
 ac_r AS (SELECT g.policy || '#' || g.sample AS policy, wk2.week, coalesce(dp.act, 'none') AS action FROM (SELECT DISTINCT policy, sample FROM dp) g CROSS JOIN wk2 LEFT JOIN dp ON dp.policy = g.policy AND dp.sample = g.sample AND dp.week = wk2.week),
 {_again(ACT[ACT.index(' rs0 AS'):].strip())}, {_again(OUT)}"""


@query("random_action_control", RANDOM + f""" SELECT su.policy, {R('avg((round(su.mean_auc, 9) >= round(su_r.mean_auc, 9))::INT)', 'random_control_pct')}, {R('avg(su_r.mean_auc)', 'random_control_mean_auc')}, count(*) AS n_samples
FROM su JOIN su_r ON split_part(su_r.policy, '#', 1) = su.policy GROUP BY su.policy""")
def _(spark, d):
    lat = lattice(spark, d)
    out = A.random_action_control(A.summarise_rewards(A.score_actions(action_log(spark, d), lat)), lat, week_list(spark, d), 50)
    return rounded(out, "random_control_pct", "random_control_mean_auc")


# --- reports -----------------------------------------------------------------------------------------------------

METHODS = ("ks_stats", "psi", "kl_divergence", "shap")
BARS = {"ks_stats": 0.10, "psi": 0.15, "kl_divergence": 0.20, "shap": 0.12}


def tracked(spark, d):
    """(week, feature, value): relative distance of a group's weekly mean from its reference mean."""
    ev = events(spark, d).withColumn("feature", F.concat_ws("_", "event_type", (F.col("user_id") % 3).cast("string")))
    means = ev.groupBy("feature", "week").agg(F.avg("value").alias("m"))
    return with_reference(means, ["feature"], "week", {"m": "r"}).select("week", "feature", (F.abs(F.col("m") - F.col("r")) / F.col("r")).alias("value"))


def votes(spark, d):
    bars = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(b).alias("bar")) for m, b in BARS.items()])
    return tracked(spark, d).withColumn("_b", F.explode(bars)).select("week", "feature", "_b.method", "value", (F.col("value") > F.col("_b.bar")).alias("drift"))


TK = EV + """, tm AS (SELECT event_type || '_' || (user_id % 3) AS feature, week, avg(value) AS m FROM ev GROUP BY ALL), tk AS (SELECT a.week, a.feature, abs(a.m - r.m) / r.m AS value FROM tm a JOIN tm r ON r.feature = a.feature AND r.week = 0 WHERE a.week > 0),
 vt AS (SELECT week, feature, b.m AS method, value, value > b.x AS drift FROM tk, (VALUES ('ks_stats', 0.10::DOUBLE), ('psi', 0.15::DOUBLE), ('kl_divergence', 0.20::DOUBLE), ('shap', 0.12::DOUBLE)) b(m, x)),
 rf AS (SELECT week, method, sum(drift::INT)::DOUBLE / count(*) >= CASE WHEN any_value(method) = 'psi' THEN 0.6 ELSE 0.3 END AS raw_flag FROM vt GROUP BY ALL),
 cf AS (SELECT *, sum(raw_flag::INT) OVER (PARTITION BY method ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 AS confirmed_flag FROM rf),
 mx AS (SELECT cf.week, cf.method, cf.week // 3 AS model_version, raw_flag, confirmed_flag, confirmed_flag AS retrained_this_week, count(*) AS features_total, sum(drift::INT)::BIGINT AS features_crossed, round(sum(drift::INT)::DOUBLE / count(*), 6) + 0.0 AS features_crossed_fraction,
   coalesce(string_agg(CASE WHEN drift THEN feature END, ';' ORDER BY feature), '') AS drifted_feature_names, NULL::DOUBLE AS key_metric_value, NULL::DOUBLE AS key_metric_threshold FROM cf JOIN vt USING (week, method) GROUP BY ALL)"""


def flags(spark, d):
    return confirm(feature_vote(votes(spark, d)).select("week", "method", "raw_flag")).withColumn("model_version", F.floor(F.col("week") / 3))


def matrix(spark, d):
    f = flags(spark, d)
    none = f.filter("false").select("week", "method", F.lit(0.0).alias("value"), F.lit(0.0).alias("threshold"))
    return rounded(R_.week_method_matrix(f, votes(spark, d), none, f.filter("confirmed_flag").select("week", "method")), "features_crossed_fraction")


@query("week_method_matrix", f"WITH {TK} SELECT * FROM mx")
def _(spark, d):
    return matrix(spark, d)


@query("weekly_flat_report", f"""WITH {TK} SELECT week, 'Inference' AS event, bool_or(confirmed_flag) AS overall_drift, """ + ", ".join(f"bool_or(confirmed_flag AND method = '{m}') AS {m}_drift, max(CASE WHEN method = '{m}' THEN model_version END) AS {m}_version" for m in METHODS) + """,
 sum(retrained_this_week::INT)::BIGINT AS retrain_count, coalesce(string_agg(CASE WHEN retrained_this_week THEN method END, ';' ORDER BY method), '') AS triggered_methods, max(retrained_this_week::INT)::INT AS models_trained_this_week FROM mx GROUP BY week""")
def _(spark, d):
    return R_.weekly_flat_report(matrix(spark, d), METHODS)


@query("recompute_features", f"WITH {TK} SELECT week, feature, value >= 0.2 AS drift, value >= 0.1 AND value < 0.2 AS warning FROM tk")
def _(spark, d):
    return R_.recompute_features(tracked(spark, d).withColumnRenamed("value", "psi"), "psi").select("week", "feature", "drift", "warning")


@query("recompute_ddm", DDM + """, g AS (SELECT stream, week, avg(err) AS m, coalesce(arg_max(p_min, n), avg(err)) AS pm, coalesce(arg_max(s_min, n), 0) AS sm FROM d6 GROUP BY ALL) SELECT stream, week, m > pm + 2.5::DOUBLE * sm AS drift, m > pm + 1.5::DOUBLE * sm AS warning FROM g""")
def _(spark, d):
    return R_.recompute(ddm(error_events(spark, d), ["stream"]), "ddm", ddm_drift=2.5, ddm_warning=1.5).select("stream", "week", "drift", "warning")


@query("recompute_rules", f"""WITH {TK}, s AS (SELECT week, max(value) AS a, avg(value) AS b FROM tk GROUP BY week)
SELECT week, 'adwin' AS method, a * 20 > 3.0902323061678132 AS drift, false AS warning FROM s UNION ALL SELECT week, 'eddm', b > 0 AND a / 3 < 0.9::DOUBLE * b, b > 0 AND a / 3 < 0.95::DOUBLE * b AND NOT a / 3 < 0.9::DOUBLE * b FROM s
UNION ALL SELECT week, 'clustering', a * 5 >= 1.5 OR b >= 0.2, (a * 5 >= 1.5::DOUBLE * 0.8::DOUBLE OR b >= 0.1) AND NOT (a * 5 >= 1.5 OR b >= 0.2) FROM s UNION ALL SELECT week, 'autoencoder', a * 10 > 3, a * 10 > 3::DOUBLE * 0.67::DOUBLE AND NOT a * 10 > 3 FROM s
UNION ALL SELECT week, 'champion_vs_challenger', b / 2 > 0.05 OR a / 10 > 0.03, (b / 2 > 0.025 OR a / 10 > 0.015) AND NOT (b / 2 > 0.05 OR a / 10 > 0.03) FROM s""")
def _(spark, d):
    s = tracked(spark, d).groupBy("week").agg(F.max("value").alias("a"), F.avg("value").alias("b"))
    s = s.select("week", (F.col("a") * 20).alias("z_score"), (F.col("a") / 3).alias("metric_value"), F.col("b").alias("max_metric"), (F.col("a") * 5).alias("distance_ratio"),
                 F.col("b").alias("cluster_psi"), (F.col("a") * 10).alias("mse_z_score"), (F.col("b") / 2).alias("auc_degradation"), (F.col("a") / 10).alias("auc_gap"))
    out = None
    for m in ("adwin", "eddm", "clustering", "autoencoder", "champion_vs_challenger"):
        rows = R_.recompute(s, m).select("week", F.lit(m).alias("method"), "drift", "warning")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("weekly_gate_log", f"""WITH {TK}, g AS (SELECT week, {R('max(value)', 'max_value', 4)}, sum((value > 0.1)::INT) AS c, count(*) AS t FROM tk GROUP BY week), r AS (SELECT week, week // 2 AS retrain_count FROM g WHERE week % 2 = 0),
 j AS (SELECT g.*, retrain_count, c || '/' || t AS ct, round(c::DOUBLE / t * 100)::INT || '%' AS pct FROM g LEFT JOIN r USING (week))
SELECT week, max_value, ct AS features_drifted, c::DOUBLE / t >= 0.3 AS gate_met, retrain_count IS NOT NULL AS retrained, CASE WHEN retrain_count IS NOT NULL THEN ct || ' features (' || pct || ') drifted, 30% gate met, retrained (#' || retrain_count || ')'
 WHEN c::DOUBLE / t >= 0.3 THEN ct || ' features (' || pct || ') drifted, gate met, no retrain recorded' ELSE 'Only ' || ct || ' features (' || pct || ') drifted, below the 30% gate' END AS explanation FROM j""")
def _(spark, d):
    t = tracked(spark, d).withColumn("drift", F.col("value") > 0.1)
    again = week_list(spark, d).filter("week % 2 = 0").withColumn("retrain_count", F.floor(F.col("week") / 2))
    return R_.weekly_gate_log(t, again, 0.3)


@query("method_summary", f"""WITH {TK}, p AS (SELECT method, sum((week <= 6)::INT)::BIGINT AS retrains, max(week) AS last_retrain FROM mx WHERE retrained_this_week GROUP BY method)
SELECT mx.method, coalesce(p.retrains, 0) AS retrains, CASE WHEN confirmed_flag THEN 'DRIFT' ELSE 'OK' END AS status, last_retrain, features_crossed_fraction AS auc, features_crossed_fraction AS f1 FROM mx LEFT JOIN p ON p.method = mx.method WHERE week = 6""")
def _(spark, d):
    m = matrix(spark, d)
    sc = m.select("method", "week", F.col("features_crossed_fraction").alias("auc"), F.col("features_crossed_fraction").alias("f1"))
    return R_.method_summary(m, m.filter("retrained_this_week"), sc, 6)


@query("feature_method_grid", f"WITH {TK} SELECT feature, " + ", ".join(f"max(CASE WHEN method = '{m}' THEN drift::INT END)::INT AS {m}" for m in METHODS) + ", (SELECT max((event_type = 'error')::INT) FROM ev WHERE week = 5)::INT AS ddm FROM vt WHERE week = 5 GROUP BY feature")
def _(spark, d):
    shared = events(spark, d).filter("week = 5").agg((F.max((F.col("event_type") == "error").cast("int")) == 1).alias("confirmed_flag")).withColumn("method", F.lit("ddm")).withColumn("week", F.lit(5).cast("long"))
    return R_.feature_method_grid(votes(spark, d), shared, 5, [*METHODS, "ddm"])


@query("week_method_grid", f"WITH {TK}, m AS (SELECT DISTINCT method FROM mx), w AS (SELECT DISTINCT week FROM mx) SELECT method, week, (CASE WHEN confirmed_flag THEN 2 WHEN raw_flag THEN 1 ELSE 0 END)::INT AS cell FROM m CROSS JOIN w LEFT JOIN mx USING (method, week)")
def _(spark, d):
    """The grid as rows (method, week, cell)."""
    grid = R_.week_method_grid(matrix(spark, d))
    cells = grid.unpivot(["method"], [c for c in grid.columns if c != "method"], "week", "cell")
    return cells.select("method", F.substring("week", 2, 9).cast("long").alias("week"), "cell")


@query("alarm_counts", f"WITH {TK} SELECT method, sum(confirmed_flag::INT)::BIGINT AS alarms FROM mx GROUP BY method")
def _(spark, d):
    return R_.alarm_counts(matrix(spark, d))


@query("retrain_counts", f"WITH {TK} SELECT method, sum(retrained_this_week::INT)::BIGINT AS retrains FROM mx GROUP BY method")
def _(spark, d):
    m = matrix(spark, d)
    return R_.retrain_counts(m.filter("retrained_this_week"), m)


_TOP = "SELECT feature, count(*) AS times FROM vt WHERE drift GROUP BY feature"


@query("top_drifting_features", f"WITH {TK}, c AS ({_TOP}) SELECT feature, times, (row_number() OVER (ORDER BY times DESC, feature))::INT AS rank FROM c QUALIFY row_number() OVER (ORDER BY times DESC, feature) <= 12")
def _(spark, d):
    return R_.top_drifting_features(matrix(spark, d))


@query("top_drifting_by_method", f"WITH {TK}, c AS (SELECT method, feature, count(*) AS times FROM vt WHERE drift GROUP BY ALL) SELECT method, feature, times, (row_number() OVER (PARTITION BY method ORDER BY times DESC, feature))::INT AS rank FROM c QUALIFY row_number() OVER (PARTITION BY method ORDER BY times DESC, feature) <= 6")
def _(spark, d):
    return R_.top_drifting_features(matrix(spark, d), 6, True)


@query("contributor_frequency", f"""WITH {TK}, t AS (SELECT week, feature, value FROM tk QUALIFY row_number() OVER (PARTITION BY week ORDER BY value DESC, feature DESC) <= 5), c AS (SELECT feature, count(*) AS times, round(sum(value), 6) AS shift_sum FROM t GROUP BY feature)
SELECT feature, times, shift_sum, (row_number() OVER (ORDER BY times DESC, shift_sum DESC, feature))::INT AS rank FROM c QUALIFY row_number() OVER (ORDER BY times DESC, shift_sum DESC, feature) <= 10""")
def _(spark, d):
    t = tracked(spark, d).groupBy("week").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("value").alias("shift"), "feature")))), 1, 5).alias("contributors"))
    return rounded(R_.contributor_frequency(t), "shift_sum")


@query("feature_agreement_cosine", f"""WITH {TK}, c AS (SELECT method, feature, count(*)::DOUBLE AS n FROM vt WHERE drift GROUP BY ALL), m AS (SELECT DISTINCT method FROM vt), z AS (SELECT method, sqrt(sum(n * n)) AS nn FROM c GROUP BY method)
SELECT a.method AS method_a, b.method AS method_b, {R('coalesce((SELECT sum(x.n * y.n) FROM c x JOIN c y ON x.feature = y.feature WHERE x.method = a.method AND y.method = b.method) / nullif(za.nn * zb.nn, 0), 0)', 'cosine')} FROM m a CROSS JOIN m b LEFT JOIN z za ON za.method = a.method LEFT JOIN z zb ON zb.method = b.method""")
def _(spark, d):
    v = votes(spark, d)
    return rounded(R_.feature_agreement_cosine(v.filter("drift").select("method", "feature"), v), "cosine")


@query("cluster_composition", f"WITH {EV} SELECT week, event_type AS cluster, count(*) AS rows, {R('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY week)', 'share')} FROM ev GROUP BY week, event_type")
def _(spark, d):
    return rounded(R_.cluster_composition(events(spark, d).withColumnRenamed("event_type", "cluster")), "share")


@query("metric_trend", f"WITH {TK} SELECT week, {R('avg(value)', 'mean_value')}, {R('max(value)', 'max_value')} FROM tk GROUP BY week")
def _(spark, d):
    return rounded(R_.metric_trend(tracked(spark, d), "value"), "mean_value", "max_value")


@query("mean_abs_shift", f"WITH {TK} SELECT feature, {R('avg(abs(value))', 'mean_shift')} FROM tk GROUP BY feature ORDER BY avg(abs(value)) DESC, feature LIMIT 10")
def _(spark, d):
    return rounded(R_.mean_abs_shift(tracked(spark, d), "value"), "mean_shift")


@query("challenger_gap_counts", f"WITH {EV}, g AS (SELECT week, avg(value) - 50 AS auc_gap FROM ev WHERE week > 0 GROUP BY week) SELECT sum((auc_gap > 0)::INT)::BIGINT AS would_help, sum((auc_gap < 0)::INT)::BIGINT AS would_hurt FROM g")
def _(spark, d):
    return R_.challenger_gap_counts(events(spark, d).filter("week > 0").groupBy("week").agg((F.avg("value") - 50).alias("auc_gap")))


@query("feature_display_map", f"WITH {TK}, c AS (SELECT feature, avg(value) AS v FROM tk GROUP BY feature) SELECT feature, 'Feature ' || row_number() OVER (ORDER BY v DESC, feature) AS label FROM c")
def _(spark, d):
    ranked = tracked(spark, d).groupBy("feature").agg((-F.avg("value")).alias("rank"))
    return R_.feature_display_map(ranked).select("feature", "label")


@query("prettify_names", f"""WITH {TK}, m AS (SELECT feature, 'Feature ' || row_number() OVER (ORDER BY feature) AS label FROM (SELECT DISTINCT feature FROM tk))
SELECT week, method, coalesce(string_agg(CASE WHEN drift THEN label END, ';' ORDER BY vt.feature), '') AS drifted_feature_names FROM vt JOIN m ON m.feature = vt.feature GROUP BY ALL""")
def _(spark, d):
    display = R_.feature_display_map(tracked(spark, d).select("feature").distinct().withColumn("rank", F.lit(0)))
    return R_.prettify(matrix(spark, d), "drifted_feature_names", display).select("week", "method", "drifted_feature_names")
