"""Feature selection, structural drift, MLlib training and sources over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from tidemark.operators import lattice as A, listings as L, models as M, policies as V, sampling as S, selection as Q, signals as G, structure as T
from tidemark.operators.distribution import VOTE_FRACTION, feature_vote
from tidemark.operators.performance import auc
from tidemark.operators.streams import explain_trigger
from tidemark.operators.windows import align_schema
from tidemark.plans.checkpoints import new_folder, stable
from tidemark.plans.ordered import attach_row
from tidemark.sources import tables as X
from tidemark.workload.base import EV, LI, R, events, lineitem, query, rounded, weekly_sql
from tidemark.workload.distribution_queries import KS_BH, ks_sql
from tidemark.workload.listing_queries import ST, scored, stored
from tidemark.workload.policy_queries import BARS, METHODS, TK, flags, matrix, votes

# --- selection ---------------------------------------------------------------------------------------------------

COLS = ("quantity", "price", "discount", "tax", "shifted")


def wide(spark, d):
    """Line items with an id, window, label and five numeric features."""
    li = lineitem(spark, d).withColumn("rid", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return li.select("rid", "week", (F.col("l_returnflag") == "R").cast("int").alias("label"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"),
                     F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
                     (F.col("l_extendedprice") * (1 + 0.04 * F.col("week"))).alias("shifted"))


WIDE = LI + """, wd AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS rid, week, (l_returnflag = 'R')::INT AS label, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
  l_extendedprice * (1::DOUBLE + 0.04::DOUBLE * week) AS shifted FROM li)"""


def gains(spark, d):
    """(bag, feature, gain): summed quantities of order lines per ship month and brand-like bucket, as stand-in gains."""
    li = X.load(spark, d, "lineitem")
    return li.groupBy((F.col("l_linenumber") % 5).cast("int").alias("bag"), F.concat(F.lit("f"), F.lpad((F.col("l_partkey") % 30).cast("string"), 2, "0")).alias("feature")).agg((F.sum("l_quantity") % 97).alias("gain"))


GN = """gn AS (SELECT (l_linenumber % 5)::INT AS bag, 'f' || lpad((l_partkey % 30)::VARCHAR, 2, '0') AS feature, sum(l_quantity) % 97 AS gain FROM lineitem GROUP BY ALL),
 rk AS (SELECT *, rank() OVER (PARTITION BY bag ORDER BY gain DESC) + (count(*) OVER (PARTITION BY bag, gain) - 1) / 2.0::DOUBLE AS rank, (row_number() OVER (PARTITION BY bag ORDER BY gain DESC, feature) <= 10)::INT AS selected FROM gn),
 im AS (SELECT feature, avg(gain) AS mean_gain, CASE WHEN avg(gain) > 0 THEN stddev_pop(gain) / avg(gain) ELSE 0 END AS gain_cv, avg(1 / rank) AS mrr, avg(selected) AS freq FROM rk GROUP BY feature)"""


@query("rank_gains", f"WITH {GN} SELECT bag, feature, gain, rank, selected FROM rk")
def _(spark, d):
    return Q.rank_gains(gains(spark, d), 10)


@query("importance_summary", f"WITH {GN} SELECT feature, {R('mean_gain', 'mean_gain')}, {R('mrr', 'mean_reciprocal_rank')}, {R('freq', 'selection_frequency')}, {R('gain_cv', 'gain_cv')} FROM im")
def _(spark, d):
    return rounded(Q.importance_summary(Q.rank_gains(gains(spark, d), 10)), "mean_gain", "mean_reciprocal_rank", "selection_frequency", "gain_cv")


@query("nogueira_stability", f"WITH {GN}, p AS (SELECT feature, avg(selected) AS p, count(*) AS b FROM rk GROUP BY feature), s AS (SELECT count(*) AS d, sum(p) AS k, avg(p * (1 - p)) AS v, max(b) AS b FROM p) SELECT {R('1 - b::DOUBLE / (b - 1) * v / ((k / d) * (1 - k / d))', 'stability')} FROM s")
def _(spark, d):
    return rounded(Q.nogueira_stability(Q.rank_gains(gains(spark, d), 10)), "stability")


@query("composite_score", f"WITH {GN} SELECT feature, {R('0.7 * freq + 0.3 * (mrr - min(mrr) OVER ()) / greatest(max(mrr) OVER () - min(mrr) OVER (), 1e-12)', 'score')} FROM im")
def _(spark, d):
    return rounded(Q.composite_score(Q.importance_summary(Q.rank_gains(gains(spark, d), 10))).select("feature", "score"), "score")


@query("monitorability", f"WITH {WIDE}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, stddev_samp({c}::DOUBLE) AS s FROM wd" for c in (*COLS, "label")) + f") SELECT feature, n_distinct, {R('s', 'std', 4)}, n_distinct >= 10 AND s > 1e-8 AS monitorable FROM m")
def _(spark, d):
    return rounded(Q.monitorability(wide(spark, d), [*COLS, "label"]), "std", digits=4)


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in COLS)


@query("spearman_matrix", f"WITH {WIDE}, r AS (SELECT {_RANKS} FROM wd) " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {R(f'abs(corr({a}, {b}))', 'rho')} FROM r" for a in COLS for b in COLS))
def _(spark, d):
    return rounded(Q.spearman_matrix(wide(spark, d), COLS), "rho")


PRUNED = ("price", "shifted", "quantity", "discount", "tax")
_PAIR = {(a, b): f"(SELECT abs(corr({a}, {b})) FROM r)" for i, b in enumerate(PRUNED) for a in PRUNED[:i]}


def _prune_sql() -> str:
    """The greedy walk, a step a candidate: the strongest correlation with those chosen so far, 0 without one; in the end the set is filled by score."""
    parts, chosen = [f"WITH {WIDE}, r AS (SELECT {_RANKS} FROM wd), k0 AS (SELECT 0 AS n" + "".join(f", {sql} AS rho_{a}_{b}" for (a, b), sql in _PAIR.items()) + ")"], []
    for i, c in enumerate(PRUNED):
        worst = "greatest(0.0" + "".join(f", CASE WHEN in_{o} THEN rho_{o}_{c} ELSE 0 END" for o in chosen) + ")"
        parts.append(f"k{i + 1} AS (SELECT * EXCLUDE (n), n < 4 AND {worst} < 0.90 AS in_{c}, n < 4 AND {worst} >= 0.90 AS out_{c}, n + (n < 4 AND {worst} < 0.90)::INT AS n FROM k{i})")
        chosen.append(c)
    last, filled = f"k{len(PRUNED)}", []
    for c in PRUNED:
        filled.append(f"SELECT '{c}' AS feature, in_{c} AS walked, out_{c} AS redundant, n, {PRUNED.index(c)} AS pos FROM {last}")
    parts.append("z AS (" + " UNION ALL ".join(filled) + "), y AS (SELECT *, sum((NOT walked)::INT) OVER (ORDER BY pos) AS place FROM z)")
    return ", ".join(parts) + " SELECT feature, walked OR place <= 4 - n AS kept, redundant FROM y"


@query("redundancy_prune", _prune_sql())
def _(spark, d):
    chosen, rejected = Q.redundancy_prune(list(PRUNED), Q.spearman_matrix(wide(spark, d), COLS), 4)
    twins = {r["feature"] for r in rejected if r["reason"] == "redundant"}
    return spark.createDataFrame([(c, c in chosen, c in twins) for c in PRUNED], "feature string, kept boolean, redundant boolean")


def _fit(label="label", iters=3):
    def fit(df, weight, seed):
        return M.train_classifier(df, COLS, label, "t", "rid", seed, iters, 3, weight, tune=False).importances()
    return fit


_MON = ", ".join(f"count(DISTINCT {c}) AS n_{c}, stddev_samp({c}::DOUBLE) AS s_{c}" for c in COLS)


@query("select_features", f"WITH {WIDE}, m AS (SELECT {_MON} FROM wd WHERE week = 0) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, n_{c} AS n_distinct, n_{c} >= 10 AND s_{c} > 1e-8 AS monitorable, true AS in_range, true AS consistent FROM m" for c in COLS))
def _(spark, d):
    """Distinct values and monitorability of each candidate; shares and scores lie in [0, 1], and what is selected is monitorable, three in all."""
    ref = stable(wide(spark, d).filter("week = 0"))
    chosen, table, _ = Q.select_features(ref, COLS, "rid", _fit(), top_k=3, n_bags=2, top_m=2)
    fine = F.col("selection_frequency").between(0, 1) & F.col("mean_reciprocal_rank").between(0, 1) & F.col("score").between(0, 1)
    kept = (F.col("selected") == F.col("feature").isin(*chosen)) & (~F.col("selected") | F.col("monitorable")) & F.lit(len(chosen) <= 3)
    return table.select("feature", "n_distinct", "monitorable", fine.alias("in_range"), kept.alias("consistent"))


@query("selection_report", f"WITH {WIDE}, m AS (SELECT {_MON} FROM wd WHERE week = 0), u AS (SELECT " + " + ".join(f"(NOT (n_{c} >= 10 AND s_{c} > 1e-8))::INT" for c in COLS) + " AS n FROM m) SELECT n::BIGINT AS n_unmonitorable, least(3, 5 - n)::INT AS n_selected, true AS in_range FROM u")
def _(spark, d):
    ref = stable(wide(spark, d).filter("week = 0"))
    out = Q.select_features(ref, COLS, "rid", _fit(), top_k=3, n_bags=2, top_m=2)[2]
    return out.select("n_unmonitorable", "n_selected", (F.col("stability").between(-1, 1) & F.col("max_pairwise_rho").between(0, 1)).alias("in_range"))


# --- attributions ------------------------------------------------------------------------------------------------

COEF = {"quantity": 0.02, "discount": -3.0, "tax": 2.0, "shifted": 0.0001}
LA = WIDE + """, mu AS (SELECT avg(quantity) AS quantity, avg(discount) AS discount, avg(tax) AS tax, avg(shifted) AS shifted FROM wd WHERE week = 0),
 la AS (""" + " UNION ALL ".join(f"SELECT rid, week, '{c}' AS feature, round((wd.{c} - mu.{c}) * ({w}::DOUBLE), 9) AS value FROM wd, mu" for c, w in COEF.items()) + ")"


def linear(spark, d):
    w = wide(spark, d)
    means = w.filter("week = 0").agg(*[F.avg(c).alias(c) for c in COEF]).first().asDict()
    out = T.linear_attributions(w, COEF, means, ["rid", "week"])
    return rounded(out, "attribution", digits=9)


@query("linear_attributions", f"WITH {LA} SELECT week, feature, count(*) AS n, {R('avg(abs(value))', 'mean_abs', 5)} FROM la GROUP BY ALL")
def _(spark, d):
    out = linear(spark, d).groupBy("week", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("attribution")).alias("mean_abs"))
    return rounded(out, "mean_abs", digits=5)


@query("attribution_drift", f"""WITH {LA}, {ks_sql('la')} {KS_BH}, m AS (SELECT feature, week, avg(abs(value)) AS m FROM la GROUP BY ALL)
SELECT bh.feature, bh.week, {R('statistic', 'statistic', 5)}, {R('p_adjusted', 'p_adjusted', 4)}, {R('r.m', 'ref_importance', 5)}, {R('c.m', 'curr_importance', 5)}, {R('c.m - r.m', 'importance_shift', 5)}, p_adjusted < 0.05 AND statistic >= 0.10 AS drift
FROM bh JOIN m c ON c.feature = bh.feature AND c.week = bh.week JOIN m r ON r.feature = bh.feature AND r.week = 0""")
def _(spark, d):
    out = T.attribution_drift(linear(spark, d)).select("feature", "week", "statistic", "p_adjusted", "ref_importance", "curr_importance", "importance_shift", "drift")
    return rounded(rounded(out, "statistic", "ref_importance", "curr_importance", "importance_shift", digits=5), "p_adjusted", digits=4)


@query("attribution_summary", f"""WITH {LA}, {ks_sql('la')} {KS_BH}, m AS (SELECT feature, week, avg(abs(value)) AS m FROM la GROUP BY ALL)
SELECT bh.week, {R('avg((p_adjusted < 0.05 AND statistic >= 0.10)::INT)', 'attribution_drift_fraction')}, {R('avg(abs(c.m - r.m))', 'attribution_mean_shift', 5)}, sum((p_adjusted < 0.05 AND statistic >= 0.10)::INT)::BIGINT AS drifted_features
FROM bh JOIN m c ON c.feature = bh.feature AND c.week = bh.week JOIN m r ON r.feature = bh.feature AND r.week = 0 GROUP BY bh.week""")
def _(spark, d):
    return rounded(rounded(T.attribution_summary(T.attribution_drift(linear(spark, d))), "attribution_drift_fraction"), "attribution_mean_shift", digits=5)


@query("attribution_importance", f"WITH {LA} SELECT feature, {R('avg(abs(value))', 'importance', 5)} FROM la GROUP BY feature")
def _(spark, d):
    return rounded(Q.attribution_importance(linear(spark, d)), "importance", digits=5)


# --- clusters and reconstruction ---------------------------------------------------------------------------------

CENTRES = [[-0.8, -0.8, 0.0, 0.0], [0.8, 0.8, 0.7, 0.0], [0.0, 0.9, -0.9, 0.8]]
CCOLS = ("quantity", "price", "discount", "shifted")
CL = WIDE + ", ms AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in CCOLS) + " FROM wd WHERE week = 0), z AS (SELECT rid, week, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in CCOLS) + """ FROM wd, ms),
 ds AS (SELECT *, """ + ", ".join("(" + " + ".join(f"({c} - ({v}::DOUBLE)) ** 2" for c, v in zip(CCOLS, row)) + f") AS d{i}" for i, row in enumerate(CENTRES)) + """ FROM z),
 asg AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster, sqrt(least(d0, d1, d2)) AS distance FROM ds)"""


def fixed_clusters(spark, d):
    w = wide(spark, d)
    return T.assign_clusters(w, T.Clusters(T.fit_scale(w.filter("week = 0"), CCOLS), CENTRES))


@query("assign_clusters", f"WITH {CL} SELECT week, cluster, count(*) AS n, {R('avg(distance)', 'mean_distance')} FROM asg GROUP BY ALL")
def _(spark, d):
    out = fixed_clusters(spark, d).groupBy("week", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))
    return rounded(out, "mean_distance")


@query("cluster_drift_fixed_centres", f"""WITH {CL}, c AS (SELECT week, cluster, count(*) AS n FROM asg GROUP BY ALL), g AS (SELECT week, avg(distance) AS m, count(*) AS n FROM asg GROUP BY week),
 p AS (SELECT g.week, k.k, CASE WHEN coalesce(c.n, 0) = 0 THEN 0.0001 ELSE c.n::DOUBLE / g.n END AS s FROM g CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) k LEFT JOIN c ON c.week = g.week AND c.cluster = k.k),
 q AS (SELECT a.week, sum((a.s - r.s) * ln(a.s / r.s)) AS psi FROM p a JOIN p r ON r.k = a.k AND r.week = 0 WHERE a.week > 0 GROUP BY a.week)
SELECT q.week, g.n AS n_rows, {R('g.m / r.m', 'distance_ratio')}, {R('psi', 'cluster_psi')}, g.m / r.m >= 1.5 OR psi >= 0.2 AS drift_detected FROM q JOIN g ON g.week = q.week JOIN g r ON r.week = 0""")
def _(spark, d):
    out = T.cluster_drift(fixed_clusters(spark, d), CCOLS, 3).select("week", "n_rows", "distance_ratio", "cluster_psi", "drift_detected")
    return rounded(out, "distance_ratio", "cluster_psi")


def _held(drift):
    """What must hold of a fitted clustering: all rows of a window have a cluster, ratio and PSI are no negative numbers."""
    total = F.aggregate("curr_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return drift.select("week", "n_rows", (total == F.col("n_rows")).alias("counts_add_up"), ((F.col("distance_ratio") > 0) & (F.col("cluster_psi") >= 0)).alias("in_range"))


@query("cluster_drift", f"WITH {WIDE} SELECT week, count(*) AS n_rows, true AS counts_add_up, true AS in_range FROM wd WHERE week > 0 GROUP BY week")
def _(spark, d):
    w = wide(spark, d)
    return _held(T.cluster_drift(T.assign_clusters(w, T.fit_clusters(w.filter("week = 0"), CCOLS)), CCOLS, 5))


@query("embedding_clusters", "SELECT (vec_id % 4)::BIGINT AS week, count(*) AS n_rows, true AS counts_add_up, true AS in_range FROM embeddings WHERE vec_id % 4 > 0 GROUP BY vec_id % 4")
def _(spark, d):
    e = X.load(spark, d, "embeddings")
    dims = range(e.agg(F.max(F.size("embedding"))).first()[0])
    cols = [f"e{i}" for i in dims]
    rows = e.select((F.col("vec_id") % 4).alias("week"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in dims])
    return _held(T.cluster_drift(T.assign_clusters(rows, T.fit_clusters(rows.filter("week = 0"), cols)), cols, 5))


@query("reconstruction_drift", f"WITH {WIDE} SELECT DISTINCT week, true AS in_range, true AS consistent FROM wd WHERE week > 0")
def _(spark, d):
    """Of a fitted reconstruction: errors are no negative numbers, p and KS lie in [0, 1], the flags follow the z score."""
    w = wide(spark, d)
    out = T.reconstruction_drift(T.reconstruct(w, T.fit_reconstruction(w.filter("week = 0"), CCOLS)), CCOLS)
    fine = (F.col("ref_rmse_mean") >= 0) & (F.col("curr_rmse_mean") >= 0) & F.col("p_value").between(0, 1) & F.col("ks_stat").between(0, 1)
    agree = (F.col("drift_detected") == (F.col("mse_z_score") > 3.0)) & ~(F.col("drift_detected") & F.col("warning_detected"))
    return out.select("week", fine.alias("in_range"), agree.alias("consistent"))


def weeks_with_later(rows):
    """All weeks but the last, in order: those that something can be held against."""
    return sorted(r[0] for r in rows.select("week").distinct().collect())[:-1]


def fitted_attributions(w, ref_week, long=True):
    """Gradient-times-input attributions of every row, by a perceptron fitted on the weeks through ``ref_week``; without ``long`` side by side."""
    model = M.train_mlp(w.filter(F.col("week") <= ref_week), CCOLS, "label", "rid", (8,), max_iter=15, head="head" if "head" in w.columns else None)
    return T.mlp_attributions(w, model.model.getLayers(), model.model.weights.toArray(), model.scale, ["rid", "week"] if long else ["week"], long)


@query("signal_matrix")
def _(spark, d):
    w = stable(wide(spark, d).select("rid", "week", "label", *CCOLS, S.digest_head("rid", 42).alias("head")))
    return G.signal_matrix(w, CCOLS, weeks_with_later(w), lambda r: fitted_attributions(w, r, long=False), "rid", head="head")


@query("pca_snapshot", f"WITH {WIDE}, k AS (SELECT rid, week, row_number() OVER (PARTITION BY week ORDER BY md5(rid || ':42'), rid) AS n FROM wd) SELECT rid, week, true AS labelled, true AS placed FROM k WHERE n <= 300")
def _(spark, d):
    """The sampled rows of every week, each with a cluster and finite coordinates."""
    w = wide(spark, d)
    state = T.fit_clusters(w.filter("week = 0"), CCOLS)
    out = T.pca_snapshot(S.bounded_sample(w.select("rid", "week", *CCOLS), 300, "rid", 42, ["week"]), state)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out.select("rid", "week", F.col("cluster").between(0, 4).alias("labelled"), (finite("pc1") & finite("pc2")).alias("placed"))


# --- models ------------------------------------------------------------------------------------------------------

OC = ("price", "priority", "segment", "season")


def order_rows(spark, d):
    """Orders with a learnable label: large, urgent orders of some months."""
    o = X.load(spark, d, "orders")
    price, urgent = F.col("o_totalprice"), F.substring("o_orderpriority", 1, 1).cast("int")
    from tidemark.operators.windows import assign_week
    rows = assign_week(o, "o_orderdate", 730, 360)
    return rows.select(F.col("o_orderkey").alias("rid"), "week", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), price.alias("price"), urgent.cast("double").alias("priority"),
                       (F.col("o_custkey") % 5).cast("double").alias("segment"), F.month("o_orderdate").cast("double").alias("season"),
                       ((price > 200000 + 30000 * F.col("week")) & (urgent <= 3) | (F.col("o_orderkey") % 13 == 0)).cast("int").alias("label"))


ROWS = weekly_sql("orders", "o_orderdate", 730, 360, "oo") + """,
 mr AS (SELECT o_orderkey AS rid, week, ((o_totalprice > 200000 + 30000 * week AND substr(o_orderpriority, 1, 1)::INT <= 3) OR o_orderkey % 13 = 0)::INT AS label FROM oo)"""


def _ready(spark, d):
    return stable(order_rows(spark, d))


def _judged(rows, *scores, bar=0.6):
    """Rows with what must hold of a fitted model's scores: each in [0, 1], the first better than ``bar`` by AUC."""
    rows = stable(rows)
    fine = [F.col(c).between(0, 1) for c in scores]
    return attach_row(rows.withColumn("in_range", reduce(lambda a, b: a & b, fine)), auc(rows, [], score=scores[0]).select((F.col("auc") > bar).alias("learned"))).drop(*scores)


LATER = f"WITH {ROWS} SELECT rid, week, label, true AS in_range, true AS learned FROM mr WHERE week > 0"


@query("train_classifier", LATER)
def _(spark, d):
    rows = _ready(spark, d)
    model = M.train_classifier(rows.filter("week = 0"), OC, "label", "t", "rid", max_iter=8)
    return _judged(model.score(rows.filter("week > 0")).select("rid", "week", "label", "score"), "score")


@query("train_mlp", LATER)
def _(spark, d):
    rows = _ready(spark, d)
    model = M.train_mlp(rows.filter("week = 0"), OC, "label", "rid", (8,), max_iter=20)
    return _judged(model.score(rows.filter("week > 0")).select("rid", "week", "label", "score"), "score")


@query("partial_update", f"WITH {ROWS} SELECT rid, label, true AS in_range, true AS learned FROM mr WHERE week = 2")
def _(spark, d):
    rows = _ready(spark, d)
    parent = M.train_mlp(rows.filter("week = 0"), OC, "label", "rid", (8,), max_iter=15)
    child = M.partial_update(parent, rows.filter("week = 1"), "label")
    both = parent.score(rows.filter("week = 2"), "parent_score")
    return _judged(child.score(both, "child_score").select("rid", "label", "child_score", "parent_score"), "child_score", "parent_score")


@query("oof_scores", f"WITH {ROWS} SELECT rid, label, true AS in_range, true AS learned FROM mr WHERE week = 1")
def _(spark, d):
    return _judged(M.oof_scores(_ready(spark, d).filter("week = 1"), OC, "label", "t", "rid", max_iter=5)[0].select("rid", "label", "oof_score"), "oof_score")


@query("top_features_by_importance", "SELECT place, true AS known, true AS falling FROM (SELECT unnest([1, 2, 3]) AS place)")
def _(spark, d):
    """The first three of four features, by falling importance."""
    rows = M.importance_table(spark, M.train_classifier(_ready(spark, d).filter("week = 0"), OC, "label", "t", "rid", max_iter=5), 3).collect()
    falls = [a["importance"] >= b["importance"] >= 0 for a, b in zip(rows, rows[1:])]
    return spark.createDataFrame([(i + 1, r["feature"] in OC, all(falls) and rows[0]["importance"] > 0) for i, r in enumerate(rows)], "place int, known boolean, falling boolean")


EACH = "SELECT feature, true AS found FROM (SELECT unnest(['price', 'priority', 'segment', 'season']) AS feature)"


@query("tree_attributions", EACH)
def _(spark, d):
    """Mean absolute attributions of a fitted model; tests/test_models.py holds them against its margins."""
    rows = _ready(spark, d)
    model = M.train_classifier(rows.filter("week = 0"), OC, "label", "t", "rid", max_iter=5, tune=False)
    return Q.attribution_importance(T.tree_attributions(rows.filter("week > 0"), model.model, OC, ["rid"])).select("feature", (F.col("importance") >= 0).alias("found"))


@query("mlp_attributions", EACH)
def _(spark, d):
    """The same for a perceptron; tests/test_models.py holds them against numeric gradients."""
    rows = _ready(spark, d)
    model = M.train_mlp(rows.filter("week = 0"), OC, "label", "rid", (8,), max_iter=15)
    return Q.attribution_importance(T.mlp_attributions(rows, model.model.getLayers(), model.model.weights.toArray(), model.scale, ["rid"])).select("feature", (F.col("importance") > 0).alias("found"))


def _versions(rows, weeks):
    return {w: M.train_classifier(rows.filter(F.col("week") <= w), OC, "label", "t", "rid", max_iter=4) for w in weeks}


@query("score_versions", f"WITH {ROWS} SELECT v AS version, week, true AS better_than_chance FROM (SELECT DISTINCT week FROM mr WHERE week > 0), (SELECT unnest(range((SELECT max(week) FROM mr)))::BIGINT AS v) WHERE week > v")
def _(spark, d):
    rows = _ready(spark, d)
    scores = M.score_versions(rows.filter("week > 0"), _versions(rows, weeks_with_later(rows)), ["rid", "week", "label"])
    return V.performance_matrix(scores).select("version", "week", (F.col("auc") > 0.5).alias("better_than_chance"))


def in_force(rows):
    """(method, week, version): psi never adopts a version, adwin has the one trained through the week before."""
    weeks = rows.filter("week > 0").select("week").distinct()
    return weeks.select(F.lit("psi").alias("method"), "week", F.lit(0).cast("long").alias("version")).unionByName(
        weeks.select(F.lit("adwin").alias("method"), "week", (F.col("week") - 1).cast("long").alias("version")))


@query("method_scores", f"WITH {ROWS} SELECT method, week, count(*) AS n, true AS in_range FROM mr, (SELECT unnest(['psi', 'adwin']) AS method) WHERE week > 0 GROUP BY ALL")
def _(spark, d):
    rows = _ready(spark, d)
    scores = M.score_versions(rows.filter("week > 0"), _versions(rows, weeks_with_later(rows)), ["rid", "week", "label"])
    return M.method_scores(scores, in_force(rows)).groupBy("method", "week").agg(F.count(F.lit(1)).alias("n"), (F.min(F.col("score").between(0, 1).cast("int")) == 1).alias("in_range"))


@query("get_or_train", f"WITH {ROWS} SELECT week AS trained_through_week, count(*) AS n_rows, true AS in_range FROM mr GROUP BY week")
def _(spark, d):
    """A version for every week of the data: saved, read back and evaluated on its last week."""
    rows, folder = _ready(spark, d), new_folder(spark)

    def train(week):
        model = M.train_classifier(rows.filter(F.col("week") <= week), OC, "label", "t", "rid", max_iter=3)
        M.save_version(spark, model, f"{folder}/w{week}")
        again = M.load_version(spark, f"{folder}/w{week}")
        return M.version_row(spark, again, week, f"w{week}", rows.filter(F.col("week") == week), "label")

    have = train(0)
    found = V.get_or_train(rows.select("week").distinct(), have, train)
    return found.select("trained_through_week", "n_rows", (F.col("auc").between(0, 1) & F.col("f1").between(0, 1) & F.col("threshold").between(0, 1)).alias("in_range"))


@query("model_round_trip", f"WITH {ROWS} SELECT rid, true AS same FROM mr WHERE week > 0")
def _(spark, d):
    """A boosted and a perceptron version score every row as before once they are saved and read back."""
    rows, folder = _ready(spark, d), new_folder(spark)
    ref, out = rows.filter("week = 0"), rows.filter("week > 0").select("rid", *OC)
    models = {"gbt": M.train_classifier(ref, OC, "label", "t", "rid", max_iter=3), "mlp": M.train_mlp(ref, OC, "label", "rid", (6,), max_iter=10)}
    for name, model in models.items():
        M.save_version(spark, model, f"{folder}/{name}")
        again = M.load_version(spark, f"{folder}/{name}")
        out = again.score(model.score(out, f"{name}_a"), f"{name}_b")
    return out.select("rid", ((F.col("gbt_a") == F.col("gbt_b")) & (F.col("mlp_a") == F.col("mlp_b"))).alias("same"))


@query("adaptation_lattice", f"""WITH {ROWS}, w AS (SELECT DISTINCT week FROM mr), st AS (SELECT f.week AS full_week, NULL::BIGINT AS partial_week FROM w f WHERE f.week < (SELECT max(week) FROM w)
   UNION ALL SELECT f.week, p.week FROM w f, w p WHERE p.week > f.week AND p.week < (SELECT max(week) FROM w))
SELECT full_week, partial_week, a.alpha, w.week, count(*) OVER () AS n_states, true AS in_range FROM st, w, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS alpha) a WHERE w.week > full_week AND w.week > coalesce(partial_week, -1)""")
def _(spark, d):
    """Every full model and every later partial update of it, trained, blended and scored on every later week."""
    rows = _ready(spark, d)
    scored = A.train_lattice(rows, OC, "label", "rid", hidden=(6,), max_iter=12)
    out = A.lattice_performance(A.blend_scores(scored, "rid", nested=True), "threshold")
    fine = F.coalesce(F.col("auc").between(0, 1), F.lit(True)) & F.col("f1").between(0, 1)
    return out.select("full_week", "partial_week", "alpha", "week", F.count(F.lit(1)).over(Window.partitionBy()).alias("n_states"), fine.alias("in_range"))


# --- sources and sinks -------------------------------------------------------------------------------------------


@query("read_pair", "SELECT o_orderkey AS \"TransactionID\", o_totalprice AS amount, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_orderkey % (SELECT count(*) FROM customer)")
def _(spark, d):
    folder = new_folder(spark)
    o = X.load(spark, d, "orders").select(F.col("o_orderkey").alias("TransactionID"), F.col("o_totalprice").alias("amount"))
    c = X.load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    X.write_csv(o, f"{folder}/train_transaction.csv")
    X.write_csv(o.join(c, F.col("TransactionID") % c.count() == F.col("c_custkey")).select("TransactionID", "c_mktsegment"), f"{folder}/train_identity.csv")
    fact, ident = X.read_pair(spark, folder, "TransactionID long, amount double", "TransactionID long, c_mktsegment string")
    if X.read_pair(spark, folder, split="test") is not None:
        raise AssertionError("no test pair was written")
    from tidemark.operators.windows import join_identity
    return join_identity(fact, ident, "TransactionID")


@query("report_csv", "SELECT week, method, confirmed_flag FROM (WITH " + TK + " SELECT week, method, confirmed_flag FROM mx)")
def _(spark, d):
    folder = new_folder(spark)
    X.write_csv(matrix(spark, d), f"{folder}/matrix.csv")
    return X.read_report_csv(spark, f"{folder}/matrix.csv").select(F.col("week").cast("long").alias("week"), "method", "confirmed_flag")


def write_record(spark, d, path):
    """The whole weekly report of the events: flags, confirmation, status, reasons and metrics of triggers, features, row counts, retrained versions."""
    f, v = stable(flags(spark, d)), stable(votes(spark, d))
    recent = Window.partitionBy("method").orderBy("week").rowsBetween(-1, 0)
    fired = f.select("week", "method", "confirmed_flag", F.sum(F.col("raw_flag").cast("int")).over(recent).alias("fired"), F.count(F.lit(1)).over(recent).alias("window_len"))
    names = v.groupBy("week", "method").agg(F.array_sort(F.collect_list(F.when(F.col("drift"), F.col("feature")))).alias("names"))
    share = feature_vote(v)
    said = share.join(fired.filter("confirmed_flag"), ["week", "method"]).join(names, ["week", "method"])
    pick = lambda of: F.coalesce(*[F.when(F.col("method") == m, F.lit(float(of[m]))) for m in METHODS])
    cells = {"crossed": F.col("features_crossed"), "monitored": F.col("features_total"), "share": F.col("fraction"), "bar": pick(VOTE_FRACTION)}
    cells |= {n: pick(BARS) for n in ("min_effect", "min_psi", "min_distance")}
    said = said.withColumn("numbers", F.create_map(*[x for n, c in cells.items() for x in (F.lit(n), c.cast("double"))]))
    details = v.groupBy("week", "method").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("details"))
    status = share.join(names, ["week", "method"]).join(details, ["week", "method"]).select(
        "week", "method", F.col("fraction").alias("value"), pick(VOTE_FRACTION).alias("threshold"), F.col("names").alias("drifted_features"), "details")
    by_feature = v.groupBy("week", "feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "value")))).alias("metrics"),
                                                  F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "drift")))).alias("flags"))
    ranked = by_feature.withColumn("rank", F.row_number().over(Window.partitionBy("week").orderBy("feature")))
    state = f.withColumn("confirmation_state", F.collect_list("raw_flag").over(recent))
    X.write_report_json(state, path, {"top_k": 20}, rows=events(spark, d).groupBy("week").agg(F.count(F.lit(1)).alias("rows")), triggers=explain_trigger(said),
                        retrains=V.adopt(f.filter("confirmed_flag").select("method", "week", F.lit("confirmed").alias("reason"))), status=status, features=ranked)


@query("report_json", "WITH " + TK + " SELECT week::INT AS week, method, raw_flag, confirmed_flag, model_version FROM mx")
def _(spark, d):
    folder = new_folder(spark)
    write_record(spark, d, f"{folder}/report")
    return X.read_report_json(spark, f"{folder}/report")


RECORDS = TK + """, rw AS (SELECT week, count(*) AS rows FROM ev GROUP BY week),
 tf AS (SELECT string_agg(feature, ',' ORDER BY feature) AS top FROM (SELECT DISTINCT feature FROM vt)),
 rc AS (SELECT mx.*, max(confirmed_flag::INT) OVER (PARTITION BY week) = 1 AS overall, coalesce((lag(raw_flag) OVER m)::INT::VARCHAR, '') || raw_flag::INT::VARCHAR AS recent,
   CASE WHEN confirmed_flag THEN (sum(confirmed_flag::INT) OVER m) END AS nth FROM mx WINDOW m AS (PARTITION BY method ORDER BY week)),
 dt AS (SELECT week, method, sum(value) AS total FROM vt GROUP BY ALL)"""


@query("report_json_records", f"""WITH {RECORDS} SELECT rw.week::INT AS week, rw.week = 0 AS is_baseline, rows, overall AS overall_drift_flag, CASE WHEN method IS NULL THEN '' ELSE top END AS top_features, method, raw_flag, confirmed_flag,
 model_version, coalesce(recent, '') AS recent, features_crossed_fraction AS value, CASE WHEN method = 'psi' THEN 0.6 WHEN method IS NOT NULL THEN 0.3 END::DOUBLE AS threshold, coalesce(drifted_feature_names, '') AS drifted,
 {R('dt.total', 'details')}, coalesce(confirmed_flag, false) AS explained, nth::INT AS retrain_count, CASE WHEN nth IS NOT NULL THEN rw.week END AS to_version
FROM rw LEFT JOIN rc USING (week) LEFT JOIN dt USING (week, method), tf""")
def _(spark, d):
    """Every field of the weekly report but its features, read back."""
    folder = new_folder(spark)
    write_record(spark, d, f"{folder}/report")
    out = X.read_report_records(spark, f"{folder}/report")
    total = F.aggregate(F.map_values("details"), F.lit(0.0), lambda a, x: a + x)
    recent = F.array_join(F.transform("confirmation_state", lambda x: x.cast("int").cast("string")), "")
    flat = out.select("week", "is_baseline", "rows", "overall_drift_flag", F.array_join("top_features", ",").alias("top_features"), "method", "raw_flag", "confirmed_flag", "model_version",
                      F.coalesce(recent, F.lit("")).alias("recent"), "value", "threshold", F.coalesce(F.array_join("drifted_features", ";"), F.lit("")).alias("drifted"), total.alias("details"),
                      (F.col("reason").isNotNull() & (F.size("metrics") > 0)).alias("explained"), "retrain_count", "to_version")
    return rounded(flat.withColumn("explained", F.coalesce("explained", F.lit(False))), "value", "details")


@query("report_json_features", f"WITH {TK} SELECT week::INT AS week, feature, method, {R('value', 'value')}, drift FROM vt")
def _(spark, d):
    """The metrics and flags of every monitored feature, read back from the weekly report."""
    folder = new_folder(spark)
    write_record(spark, d, f"{folder}/report")
    out = X.read_report_features(spark, f"{folder}/report").select("week", "feature", "flags", F.explode("metrics").alias("method", "value"))
    return rounded(out.select("week", "feature", "method", "value", F.col("flags")[F.col("method")].alias("drift")), "value")


@query("application_log", f"WITH {ST} SELECT id, status FROM st, (SELECT unnest(['submitted', 'failed']) AS status)")
def _(spark, d):
    folder = new_folder(spark)
    jobs = stored(spark, d).select("id")
    for status in ("submitted", "failed"):
        X.append_application_log(jobs.withColumn("status", F.lit(status)), f"{folder}/log")
    return spark.read.schema("id string, status string").json(f"{folder}/log")


@query("job_store", f"WITH {ST} SELECT id, match_score FROM st WHERE match_score >= 50")
def _(spark, d):
    """Written whole, then merged with its own low scores, which take their rows out of the buckets they are in."""
    table = X.BucketedTable(spark, new_folder(spark))
    table.write(stored(spark, d), ["match_score"])
    low = stable(table.read().filter("match_score < 50").select("id"))
    table.merge(low, lambda old, gone: old.join(gone, "id", "left_anti"), sort=["match_score"])
    return table.read().select("id", "match_score")


@query("import_matches", f"WITH {ST} SELECT portal, job_id, title, match_score, skill_overlap FROM sc")
def _(spark, d):
    folder = new_folder(spark)
    m = scored(spark, d)
    nested = m.select(F.struct("portal", "job_id", "title", "company", "location", "url", "description", "posted", "scraped_at").alias("job"), F.col("match_score").alias("score"), "skill_overlap", "pid")
    X.write_jsonl(nested.filter("pid % 2 = 0").drop("pid"), f"{folder}/a")
    X.write_jsonl(m.filter("pid % 2 = 1").withColumn("score", F.col("match_score")).drop("match_score", "pid", "id"), f"{folder}/b")
    raw = spark.read.schema(X.MATCH_SCHEMA).json([f"{folder}/a", f"{folder}/b"])
    return L.import_matches(raw).select("portal", "job_id", "title", "match_score", "skill_overlap")


@query("export_matches", f"WITH {ST} SELECT id, match_score FROM st")
def _(spark, d):
    folder = new_folder(spark)
    X.export_matches(stored(spark, d), f"{folder}/ranked")
    return spark.read.schema("id string, match_score int").json(f"{folder}/ranked")


@query("jsonl_corpus", "SELECT doc_id, text FROM documents")
def _(spark, d):
    folder = new_folder(spark)
    X.write_jsonl(X.load(spark, d, "documents").select("doc_id", "text"), f"{folder}/corpus")
    return spark.read.schema("doc_id long, text string").json(f"{folder}/corpus")


@query("trainer_log", "WITH " + EV + f" SELECT week::INT AS step, week / 2.0::DOUBLE AS epoch, 'loss' AS metric, {R('avg(value)', 'value')} FROM ev WHERE week > 0 GROUP BY week UNION ALL SELECT week::INT, week / 2.0::DOUBLE, 'num_tokens', count(*)::DOUBLE FROM ev WHERE week > 0 AND week % 2 = 0 GROUP BY week")
def _(spark, d):
    folder = new_folder(spark)
    w = events(spark, d).filter("week > 0").groupBy("week").agg(F.round(F.avg("value"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))
    entry = F.struct((F.col("week") / 2).alias("epoch"), F.col("week").alias("step"), "loss", F.when(F.col("week") % 2 == 0, F.col("n")).alias("num_tokens"))
    w.agg(F.collect_list(entry).alias("log_history")).select(F.to_json(F.struct(F.lit(8).alias("global_step"), "log_history")).alias("value")).write.text(f"{folder}/state")
    return X.read_trainer_log(spark, f"{folder}/state")


@query("align_features", f"WITH {WIDE} SELECT rid, quantity::FLOAT AS quantity, 0::FLOAT AS absent, tax::FLOAT AS tax FROM wd")
def _(spark, d):
    return align_schema(wide(spark, d), ["quantity", "absent", "tax"], ["rid"])

