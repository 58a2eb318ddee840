"""Error-stream detectors, ranking quality and challenger comparison over the given tables."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from tidemark.operators import performance as P, streams as S
from tidemark.workload.base import ERR, EV, SCORED, R, error_events, events, query, rounded, scored_events

# --- error streams -----------------------------------------------------------------------------------------------


@query("error_stream_balanced", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY week, label ORDER BY md5(seq || ':42'), seq) AS rk,
  sum(label) OVER (PARTITION BY week) AS p, sum(1 - label) OVER (PARTITION BY week) AS q FROM sc)
SELECT seq, week, ((score >= 0.5)::INT <> label)::INT::DOUBLE AS err FROM r WHERE label = 1 OR rk <= p OR p = 0 OR q = 0""")
def _(spark, d):
    return S.error_stream(scored_events(spark, d), "label", "score", "balanced", by=["week"]).select("seq", "week", "err")


@query("error_stream_modes", f"""WITH {SCORED} SELECT week, {R('avg(((score >= 0.5)::INT <> label)::INT::DOUBLE)', 'zero_one')},
  {R('avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (label - score) * (label - score))))', 'brier')} FROM sc GROUP BY week""")
def _(spark, d):
    sc = scored_events(spark, d)
    one = S.error_stream(sc, "label", "score", "zero_one").withColumnRenamed("err", "e1")
    both = S.error_stream(one, "label", "score", "brier")
    return rounded(both.groupBy("week").agg(F.avg("e1").alias("zero_one"), F.avg("err").alias("brier")), "zero_one", "brier")


DDM = f"""WITH {ERR},
 d1 AS (SELECT *, row_number() OVER w AS n, sum(err) OVER w AS se FROM er WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 d2 AS (SELECT *, se::DOUBLE / n AS p, sqrt(greatest(0.0::DOUBLE, (se::DOUBLE / n) * (1 - se::DOUBLE / n)) / n) AS s FROM d1),
 d3 AS (SELECT *, CASE WHEN n >= 30 THEN min(CASE WHEN n >= 30 THEN p + s END) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS ps_min FROM d2),
 d4 AS (SELECT stream, p + s AS ps, min(n) AS n, arg_min(p, n) AS p_min, arg_min(s, n) AS s_min FROM d2 WHERE n >= 30 GROUP BY stream, p + s),
 d5 AS (SELECT d3.*, d4.p_min, d4.s_min FROM d3 LEFT JOIN d4 ON d4.stream = d3.stream AND d4.ps = d3.ps_min),
 d6 AS (SELECT *, coalesce(p + s > p_min + 3.0::DOUBLE * s_min, false) AS drift, coalesce(p + s > p_min + 2.0::DOUBLE * s_min AND NOT (p + s > p_min + 3.0::DOUBLE * s_min), false) AS warning FROM d5)"""


@query("ddm_rows", DDM + f" SELECT stream, seq, {R('p', 'p')}, {R('s', 's')}, {R('p_min', 'p_min')}, {R('s_min', 's_min')}, drift, warning FROM d6")
def _(spark, d):
    out = S.ddm_rows(error_events(spark, d), ["stream"]).select("stream", "seq", "p", "s", "p_min", "s_min", "drift", "warning")
    return rounded(out, "p", "s", "p_min", "s_min")


@query("ddm", DDM + f""", g AS (SELECT stream, week, sum(drift::INT)::BIGINT AS drift_occurrences, sum(warning::INT) > 0 AS warning_detected, avg(err) AS m, arg_max(p_min, n) AS pm, arg_max(s_min, n) AS sm FROM d6 GROUP BY ALL)
SELECT stream, week, drift_occurrences, drift_occurrences > 0 AS drift_detected, warning_detected, {R('m', 'mean_error_rate')}, {R('coalesce(pm, m)', 'p_min')}, {R('coalesce(sm, 0)', 's_min')},
 {R('coalesce(pm, m) + 3 * coalesce(sm, 0)', 'drift_threshold')}, {R('coalesce(pm, m) + 2 * coalesce(sm, 0)', 'warning_threshold')} FROM g""")
def _(spark, d):
    return rounded(S.ddm(error_events(spark, d), ["stream"]), "mean_error_rate", "p_min", "s_min", "drift_threshold", "warning_threshold")


EDDM = f"""WITH {ERR},
 e1 AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n FROM er),
 e2 AS (SELECT *, (n - lag(n) OVER (PARTITION BY stream ORDER BY seq))::DOUBLE AS gap FROM e1 WHERE err = 1),
 e3 AS (SELECT *, count(*) OVER w AS k, sum(gap) OVER w AS s1, sum(gap * gap) OVER w AS s2 FROM e2 WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 e4 AS (SELECT *, s1 / k + 2 * sqrt(greatest(0.0::DOUBLE, s2 / k - (s1 / k) * (s1 / k))) AS metric FROM e3),
 e5 AS (SELECT *, max(metric) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS max_metric FROM e4),
 e6 AS (SELECT *, k >= 10 AND max_metric > 0 AND metric < 0.9::DOUBLE * max_metric AS drift, k >= 10 AND max_metric > 0 AND metric >= 0.9::DOUBLE * max_metric AND metric < 0.95::DOUBLE * max_metric AS warning FROM e5)"""


@query("eddm_rows", EDDM + f" SELECT stream, seq, k, gap, {R('metric', 'metric')}, {R('max_metric', 'max_metric')}, drift, warning FROM e6")
def _(spark, d):
    out = S.eddm_rows(error_events(spark, d), ["stream"]).select("stream", "seq", "k", "gap", "metric", "max_metric", "drift", "warning")
    return rounded(out, "metric", "max_metric")


@query("eddm", EDDM + f""", b AS (SELECT stream, week, avg(err) AS m FROM er GROUP BY ALL),
 a AS (SELECT stream, week, bool_or(drift) AS d, bool_or(warning) AS w, arg_max(metric, n) AS mt, arg_max(max_metric, n) AS mx FROM e6 GROUP BY ALL),
 f AS (SELECT b.*, coalesce(a.d, false) AS d, coalesce(a.w, false) AS w, last_value(mt IGNORE NULLS) OVER o AS mt, last_value(mx IGNORE NULLS) OVER o AS mx FROM b LEFT JOIN a USING (stream, week) WINDOW o AS (PARTITION BY stream ORDER BY week ROWS UNBOUNDED PRECEDING))
SELECT stream, week, d AS drift_detected, w AND NOT d AS warning_detected, d::BIGINT AS drift_occurrences, {R('m', 'mean_error_rate')}, {R('coalesce(mt, 0)', 'metric_value')}, {R('coalesce(mx, 0)', 'max_metric')},
 {R('0.9 * coalesce(mx, 0)', 'drift_threshold')}, {R('0.95 * coalesce(mx, 0)', 'warning_threshold')} FROM f""")
def _(spark, d):
    return rounded(S.eddm(error_events(spark, d), ["stream"]), "mean_error_rate", "metric_value", "max_metric", "drift_threshold", "warning_threshold")


LD, LW = math.log(2 / 0.001), math.log(2 / 0.005)
HDDM = f"""WITH {ERR},
 h1 AS (SELECT *, row_number() OVER w AS n, sum(err) OVER w AS se FROM er WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 h2 AS (SELECT *, se::DOUBLE / n AS mean, se::DOUBLE / n + sqrt({LD!r}::DOUBLE / (2.0::DOUBLE * n)) AS b FROM h1),
 h3 AS (SELECT *, min(b) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bm FROM h2),
 h4 AS (SELECT *, max(CASE WHEN b = bm THEN n END) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n_min FROM h3),
 h5 AS (SELECT h4.*, q.mean AS mean_min FROM h4 JOIN h2 q ON q.stream = h4.stream AND q.n = h4.n_min),
 h6 AS (SELECT *, mean - mean_min > sqrt({LD!r}::DOUBLE / (2.0::DOUBLE * n_min)) + sqrt({LD!r}::DOUBLE / (2.0::DOUBLE * n)) AS drift, mean - mean_min > sqrt({LW!r}::DOUBLE / (2.0::DOUBLE * n_min)) + sqrt({LW!r}::DOUBLE / (2.0::DOUBLE * n)) AS w FROM h5)"""


@query("hddm_rows", HDDM + f" SELECT stream, seq, {R('mean', 'mean')}, {R('mean_min', 'mean_min')}, drift, w AND NOT drift AS warning FROM h6")
def _(spark, d):
    out = S.hddm_rows(error_events(spark, d), ["stream"]).select("stream", "seq", "mean", "mean_min", "drift", "warning")
    return rounded(out, "mean", "mean_min")


@query("hddm", HDDM + f""", g AS (SELECT stream, week, sum(drift::INT)::BIGINT AS o, bool_or(w AND NOT drift) AS w, avg(err) AS m, arg_max(mean_min, n) AS r, max(n) AS n FROM h6 GROUP BY ALL)
SELECT stream, week, o AS drift_occurrences, o > 0 AS drift_detected, w AND o = 0 AS warning_detected, {R('m', 'mean_error_rate')}, {R('r', 'reference_mean')}, {R(f'sqrt({LD!r}::DOUBLE / (2.0 * n))', 'hoeffding_bound')} FROM g""")
def _(spark, d):
    return rounded(S.hddm(error_events(spark, d), ["stream"]), "mean_error_rate", "reference_mean", "hoeffding_bound")


CUT = NormalDist().inv_cdf(1 - 0.002 / 2)
Z_OUT = f"""{R('m2', 'estimation')}, {R('z', 'z_score')}, {R(repr(CUT), 'z_threshold')}, z > {CUT!r} AS drift_detected, z > {CUT * 0.8!r} AND NOT z > {CUT!r} AS warning_detected"""


@query("two_sample_z", f"""WITH {EV}, s AS (SELECT event_type, week, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM ev GROUP BY ALL),
 z AS (SELECT c.event_type, c.week, c.m AS m2, abs(r.m - c.m) / sqrt(r.v / r.n + c.v / c.n) AS z FROM s c JOIN s r ON r.event_type = c.event_type AND r.week = 0 WHERE c.week > 0)
SELECT event_type, week, {Z_OUT} FROM z""")
def _(spark, d):
    return rounded(S.two_sample_z(events(spark, d), ["event_type"]), "estimation", "z_score", "z_threshold")


@query("adwin_reference", f"""WITH {ERR}, s AS (SELECT stream, week, count(err) AS n, avg(err) AS m, var_samp(err) AS v FROM er GROUP BY ALL),
 z AS (SELECT c.stream, c.week, c.m AS m2, abs(r.m - c.m) / sqrt(r.v / r.n + c.v / c.n) AS z FROM s c JOIN s r ON r.stream = c.stream AND r.week = 0 WHERE c.week > 0)
SELECT stream, week, {Z_OUT}, (z > {CUT!r})::BIGINT AS drift_occurrences FROM z""")
def _(spark, d):
    return rounded(S.adwin(error_events(spark, d), ["stream"], value="err"), "estimation", "z_score", "z_threshold")


@query("adwin_halves", f"""WITH {EV}, r AS (SELECT event_type, week, value, row_number() OVER (PARTITION BY event_type, week ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY event_type, week) AS n FROM ev),
 z AS (SELECT event_type, week, avg(CASE WHEN pos > n // 2 THEN value END) AS m2, abs(avg(CASE WHEN pos <= n // 2 THEN value END) - avg(CASE WHEN pos > n // 2 THEN value END)) /
   sqrt(var_samp(CASE WHEN pos <= n // 2 THEN value END) / count(CASE WHEN pos <= n // 2 THEN value END) + var_samp(CASE WHEN pos > n // 2 THEN value END) / count(CASE WHEN pos > n // 2 THEN value END)) AS z FROM r GROUP BY ALL)
SELECT event_type, week, {Z_OUT}, (z > {CUT!r})::BIGINT AS drift_occurrences FROM z""")
def _(spark, d):
    return rounded(S.adwin(events(spark, d), ["event_type"], order="event_id", has_reference=False), "estimation", "z_score", "z_threshold")


FLAGS = f"""{EV}, fl AS (SELECT event_type AS method, week, avg(value) > 50 AS raw_flag FROM ev WHERE week > 0 GROUP BY ALL)"""


def raw_flags(spark, d):
    """(method, week, raw_flag): one flag sequence per event type."""
    return events(spark, d).filter("week > 0").groupBy(F.col("event_type").alias("method"), "week").agg((F.avg("value") > 50).alias("raw_flag"))


@query("confirm", f"WITH {FLAGS} SELECT method, week, raw_flag, sum(raw_flag::INT) OVER (PARTITION BY method ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS confirmed_flag FROM fl")
def _(spark, d):
    return S.confirm(raw_flags(spark, d), 2, 3)


@query("confirm_with_reset", f"""WITH RECURSIVE {FLAGS},
 o AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY week) AS i FROM fl),
 f AS (SELECT method, week, i, raw_flag, raw_flag AS held, false AS confirmed_flag FROM o WHERE i = 1
   UNION ALL SELECT o.method, o.week, o.i, o.raw_flag, o.raw_flag AND NOT (f.held AND o.raw_flag), f.held AND o.raw_flag FROM f JOIN o ON o.method = f.method AND o.i = f.i + 1)
SELECT method, week, raw_flag, confirmed_flag FROM f""")
def _(spark, d):
    return S.confirm(raw_flags(spark, d), 2, 2, reset=True)


@query("combine_flags", f"""WITH {FLAGS}, g AS (SELECT DISTINCT week FROM fl), m AS (SELECT unnest(['click', 'error', 'view', 'idle']) AS method),
 x AS (SELECT m.method, g.week, coalesce(fl.raw_flag, false) AS raw_flag FROM g CROSS JOIN m LEFT JOIN fl ON fl.method = m.method AND fl.week = g.week)
SELECT week, method, raw_flag, sum(raw_flag::INT) OVER (PARTITION BY method ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 AS confirmed_flag FROM x""")
def _(spark, d):
    flags = raw_flags(spark, d)
    return S.combine_flags(flags, flags, ["click", "error", "view", "idle"])


METHODS = list(S.TRIGGERS)
NAMES = {m: [n for _, n, _ in S.slots(t) if n not in ("", "names")] for m, t in S.TRIGGERS.items()}


def _said(template: str, number) -> str:
    """A trigger's sentence as a DuckDB expression."""
    parts = []
    for text, name, form in S.slots(template):
        parts.append("'" + text + "'")
        if name == "names":
            parts.append("'a, b'")
        elif name:
            x = number(name)
            parts.append({"f": f"printf('%.4f', {x})", "d": f"trunc({x})::BIGINT::VARCHAR", "%": f"printf('%.1f', 100.0::DOUBLE * {x}) || '%'"}[form])
    return " || ".join(parts)


def _cases() -> str:
    return " ".join(f"WHEN '{m}' THEN {_said(t, lambda n, m=m: f'(v * {NAMES[m].index(n) + 1})')}" for m, t in S.TRIGGERS.items())


@query("explain_trigger", f"""WITH {FLAGS}, c AS (SELECT *, sum(raw_flag::INT) OVER (PARTITION BY method ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS fired,
   least(2, row_number() OVER (PARTITION BY method ORDER BY week)) AS len FROM fl), x AS (SELECT event_type AS method, week, avg(value) AS v FROM ev GROUP BY ALL),
 r AS (SELECT c.method AS stream, c.week, v, fired, len, unnest({METHODS}) AS method FROM c JOIN x USING (method, week) WHERE fired >= 2)
SELECT stream, week, method, (CASE method {_cases()} END) || {_said(S.GATE, lambda n: {'fired': 'fired', 'window_len': 'len'}[n])} AS reason,
 CASE method {" ".join(f"WHEN '{m}' THEN {len(NAMES[m])}" for m in METHODS)} END::INT AS n_metrics FROM r""")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("stream").orderBy("week").rowsBetween(-1, 0)
    vals = events(spark, d).filter("week > 0").groupBy(F.col("event_type").alias("stream"), "week").agg(F.avg("value").alias("v"))
    df = vals.withColumn("fired", F.sum((F.col("v") > 50).cast("int")).over(w)).withColumn("window_len", F.count(F.lit(1)).over(w)).filter("fired >= 2")
    df = df.withColumn("method", F.explode(F.array(*map(F.lit, METHODS))))
    numbers = F.create_map().cast("map<string,double>")
    for m in METHODS:
        numbers = F.when(F.col("method") == m, F.create_map(*[c for i, n in enumerate(NAMES[m]) for c in (F.lit(n), F.col("v") * (i + 1))])).otherwise(numbers)
    df = df.withColumn("numbers", numbers).withColumn("names", F.array(F.lit("a"), F.lit("b")))
    return S.explain_trigger(df).select("stream", "week", "method", "reason", F.size("metrics").alias("n_metrics"))


# --- ranking quality ---------------------------------------------------------------------------------------------

AUC = """ au AS (SELECT week, sum(CASE WHEN label = 1 THEN rk END) AS rs, sum(label) AS p, sum(1 - label) AS q FROM (
   SELECT week, label, rank() OVER (PARTITION BY week ORDER BY {s}) + (count(*) OVER (PARTITION BY week, {s}) - 1) / 2.0::DOUBLE AS rk FROM sc) GROUP BY week)"""
AUC_V = "(rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q)"


@query("auc", f"WITH {SCORED}, {AUC.format(s='score')} SELECT week, {R(AUC_V, 'auc')}, p::BIGINT AS n_pos, q::BIGINT AS n_neg FROM au")
def _(spark, d):
    return rounded(P.auc(scored_events(spark, d), ["week"]), "auc")


@query("auc_labels", f"""WITH s AS (SELECT lang, quality AS y, n_chars AS x FROM documents JOIN labels USING (doc_id)), r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0::DOUBLE AS rk FROM s),
 a AS (SELECT lang, sum(CASE WHEN y = 1 THEN rk END) AS rs, sum(y) AS p, sum(1 - y) AS q FROM r GROUP BY lang)
SELECT lang, p::BIGINT AS n_pos, q::BIGINT AS n_neg, CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE round({AUC_V}, 6) END::DOUBLE AS auc FROM a""")
def _(spark, d):
    from tidemark.sources.tables import load
    s = load(spark, d, "documents").select("doc_id", "lang", "n_chars").join(load(spark, d, "labels"), "doc_id")
    return rounded(P.auc(s, ["lang"], "quality", "n_chars"), "auc")


@query("bootstrap_auc_se", f"WITH {SCORED} SELECT week, true AS se_plausible FROM sc GROUP BY week")
def _(spark, d):
    """Errors come from hashes: no negative number, and within the largest variance of an AUC, A(1 - A) / min(n)."""
    scores = scored_events(spark, d)
    both = P.bootstrap_auc_se(scores, ["week"], "seq", n_boot=100).join(P.auc(scores, ["week"]), "week")
    limit = 1.5 * F.sqrt(F.col("auc") * (1 - F.col("auc")) / F.least("n_pos", "n_neg")) + 1e-12
    return both.select("week", ((F.col("auc_se") >= 0) & (F.col("auc_se") <= limit)).alias("se_plausible"))


@query("prequential_auc", f"""WITH {SCORED}, {AUC.format(s='score')}, x AS (SELECT week, p, {AUC_V} AS auc FROM au)
SELECT a.week, {R('r.auc', 'reference_auc')}, {R('a.auc', 'current_auc')}, {R('r.auc - a.auc', 'auc_drop')}, a.p::BIGINT AS n_positives, true AS se_plausible, true AS consistent FROM x a, x r WHERE r.week = 0 AND a.week > 0""")
def _(spark, d):
    """The bootstrap error comes from hashes: within the largest variance of an AUC, A(1 - A) / min(n), and what the flag follows."""
    out = P.prequential_auc(scored_events(spark, d), "seq", n_boot=100)
    limit = 1.5 * F.sqrt(F.col("current_auc") * (1 - F.col("current_auc")) / F.col("n_positives")) + 1e-12
    agree = F.col("drift_detected") == ((F.col("auc_drop") > 0.02) & (F.col("auc_drop") > 2.0 * F.col("auc_se")))
    return rounded(out.select("week", "reference_auc", "current_auc", "auc_drop", "n_positives", ((F.col("auc_se") >= 0) & (F.col("auc_se") <= limit)).alias("se_plausible"), agree.alias("consistent")),
                   "reference_auc", "current_auc", "auc_drop")


@query("champion_challenger", f"""WITH {SCORED}, {AUC.format(s='score')}, {AUC.format(s='rival').replace(' au AS', ' av AS')}
SELECT au.week, {R(AUC_V.replace('rs', 'au.rs').replace('p', 'au.p').replace('q', 'au.q'), 'champion_auc')}, {R(AUC_V.replace('rs', 'av.rs').replace('p', 'av.p').replace('q', 'av.q'), 'challenger_auc')},
 {R('0.9::DOUBLE - ' + AUC_V.replace('rs', 'au.rs').replace('p', 'au.p').replace('q', 'au.q'), 'auc_degradation')}, true AS se_plausible, true AS consistent FROM au JOIN av USING (week) WHERE au.week > 0""")
def _(spark, d):
    out = P.champion_challenger(scored_events(spark, d).filter("week > 0"), "seq", champion="score", challenger="rival", baseline_auc=0.9, n_boot=100)
    agree = (F.col("auc_gap") == F.col("challenger_auc") - F.col("champion_auc")) & (
        F.col("drift_detected") == ((F.col("auc_degradation") > 0.05) | ((F.col("auc_gap") > 0.03) & (F.col("auc_gap") > F.col("auc_gap_se")))))
    return rounded(out.select("week", "champion_auc", "challenger_auc", "auc_degradation", ((F.col("auc_gap_se") >= 0) & (F.col("auc_gap_se") < 0.2)).alias("se_plausible"), agree.alias("consistent")),
                   "champion_auc", "challenger_auc", "auc_degradation")


GRID = "SELECT unnest(range(91)) AS i"
F1 = """coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"""


@query("tune_threshold", f"""WITH {SCORED}, g AS (SELECT i, 0.05::DOUBLE + i * (0.95::DOUBLE - 0.05::DOUBLE) / 90 AS t FROM ({GRID})),
 c AS (SELECT week, i, t, sum((score >= t AND label = 1)::INT) AS tp, sum((score >= t AND label = 0)::INT) AS fp, sum((score < t AND label = 1)::INT) AS fn FROM sc, g GROUP BY ALL),
 f AS (SELECT *, {F1} AS f1 FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY f1 DESC, i) AS r FROM f)
SELECT week, {R('t', 'threshold')}, {R('f1', 'f1')} FROM b WHERE r = 1""")
def _(spark, d):
    return rounded(P.tune_threshold(scored_events(spark, d), ["week"]), "threshold", "f1")


@query("f1_at", f"""WITH {SCORED}, c AS (SELECT week, sum((score >= 0.6 AND label = 1)::INT)::BIGINT AS tp, sum((score >= 0.6 AND label = 0)::INT)::BIGINT AS fp, sum((score < 0.6 AND label = 1)::INT)::BIGINT AS fn FROM sc GROUP BY week)
SELECT week, tp, fp, fn, {R('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)', 'precision')}, {R('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)', 'recall')}, {R(F1, 'f1')} FROM c""")
def _(spark, d):
    return rounded(P.f1_at(scored_events(spark, d), ["week"], threshold=0.6), "precision", "recall", "f1")


@query("evaluate", f"""WITH {SCORED}, {AUC.format(s='score')}, c AS (SELECT week, sum((score >= 0.5 AND label = 1)::INT) AS tp, sum((score >= 0.5 AND label = 0)::INT) AS fp, sum((score < 0.5 AND label = 1)::INT) AS fn FROM sc GROUP BY week)
SELECT week, {R(AUC_V, 'auc')}, {R(F1, 'f1')} FROM au JOIN c USING (week)""")
def _(spark, d):
    return rounded(P.evaluate(scored_events(spark, d), ["week"]), "auc", "f1")


@query("confusion_counts", f"WITH {SCORED} SELECT week, label, (score >= 0.5)::INT AS predicted, count(*) AS n FROM sc GROUP BY ALL")
def _(spark, d):
    return P.confusion_counts(scored_events(spark, d), ["week"])
