"""Windows, sampling and distribution drift over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import distribution as D, sampling as S, windows as W
from tidemark.operators.profiles import week_profile
from tidemark.operators.signals import pair_statistics
from tidemark.plans.ordered import attach_row
from tidemark.sources.tables import load
from tidemark.workload.base import DAY_US, EV, LONG, ORD, R, events, feature_long, orders, query, rounded

# --- windows -----------------------------------------------------------------------------------------------------


@query("join_attributes", """
SELECT o_orderkey, o_custkey, c_mktsegment, n_name, o_totalprice
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    o = load(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = load(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    out = W.join_identity(W.join_identity(o, c, "c_custkey"), load(spark, d, "nation"), "n_nationkey")
    return out.select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name", "o_totalprice")


@query("natural_left_join", "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return W.natural_left_join(docs, load(spark, d, "labels"))


@query("downcast_types", """
WITH b AS (SELECT min(l_linenumber) a1, max(l_linenumber) b1, min(l_orderkey) a2, max(l_orderkey) b2, min(l_extendedprice) a3, max(l_extendedprice) b3 FROM lineitem)
SELECT 'l_linenumber' AS column_name, CASE WHEN a1 > -128 AND b1 < 127 THEN 'tinyint' WHEN a1 > -32768 AND b1 < 32767 THEN 'smallint' WHEN a1 > -2147483648 AND b1 < 2147483647 THEN 'int' ELSE 'bigint' END AS type,
  (SELECT sum(l_linenumber)::DOUBLE FROM lineitem) AS total FROM b
UNION ALL SELECT 'l_orderkey', CASE WHEN a2 > -128 AND b2 < 127 THEN 'tinyint' WHEN a2 > -32768 AND b2 < 32767 THEN 'smallint' WHEN a2 > -2147483648 AND b2 < 2147483647 THEN 'int' ELSE 'bigint' END,
  (SELECT sum(l_orderkey)::DOUBLE FROM lineitem) FROM b
UNION ALL SELECT 'l_quantity', 'float', (SELECT sum(l_quantity::FLOAT::DOUBLE) FROM lineitem) FROM b""")
def _(spark, d):
    li = load(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_quantity")
    small = W.downcast(li)
    types = dict(small.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"), F.col(f"_{c}").alias("total")) for c in li.columns])
    return small.agg(*[F.sum(F.col(c).cast("double")).alias(f"_{c}") for c in li.columns]).select(F.explode(rows).alias("r")).select("r.*")


@query("time_bounds", f"""
SELECT min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us,
  greatest(0, ceil((max(epoch_us(ts)) - min(epoch_us(ts)) - {14 * DAY_US}) / {2 * DAY_US}.0))::BIGINT AS n_windows FROM events""")
def _(spark, d):
    return W.time_bounds(load(spark, d, "events"), "ts", 14, 2)


@query("assign_week", f"WITH {EV} SELECT event_id, week FROM ev")
def _(spark, d):
    return events(spark, d).select("event_id", "week")


@query("window_sizes", f"WITH {ORD} SELECT week, count(*) AS n, sum(o_totalprice > 250000)::BIGINT AS n_large FROM od GROUP BY week")
def _(spark, d):
    return orders(spark, d).groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("n_large"))


@query("cumulative_and_recent", f"""
WITH {EV}, mx AS (SELECT max(week) AS w FROM ev), g AS (SELECT unnest(range(1, (SELECT w + 1 FROM mx))) AS upto)
SELECT g.upto::BIGINT AS upto, sum((ev.week <= g.upto)::INT)::BIGINT AS n_cumulative, sum((ev.week BETWEEN greatest(1, g.upto - 3) AND g.upto)::INT)::BIGINT AS n_recent
FROM g, ev GROUP BY g.upto""")
def _(spark, d):
    return W.window_counts(events(spark, d).select("week"), 4)


@query("align_schema", """
SELECT event_id, user_id::FLOAT AS user_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0)::FLOAT AS k, coalesce(try_cast(event_type AS DOUBLE), 0)::FLOAT AS event_type,
  0::FLOAT AS absent, value::FLOAT AS value FROM events""")
def _(spark, d):
    ev = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return W.align_schema(ev, ["user_id", "k", "event_type", "absent", "value"], ["event_id"])


# --- sampling ----------------------------------------------------------------------------------------------------

_H = "md5(event_id || ':42')"


@query("bounded_sample", f"""
WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_H}, event_id) AS rk FROM ev) SELECT event_id, event_type, value FROM r WHERE rk <= 200""")
def _(spark, d):
    return S.bounded_sample(events(spark, d), 200, "event_id", 42, ["event_type"]).select("event_id", "event_type", "value")


@query("null_split", f"""
WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_H}, event_id) AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM ev)
SELECT event_id, CASE WHEN rk <= greatest(floor(n * (1 / 12.0::DOUBLE)), 50) THEN 'small' ELSE 'big' END AS part FROM r""")
def _(spark, d):
    return S.null_split(events(spark, d), 1 / 12, "event_id", 42, ["event_type"]).select("event_id", "part")


@query("temporal_split", """
WITH r AS (SELECT *, (o_orderstatus = 'F')::INT AS label, row_number() OVER (ORDER BY epoch_us(o_orderdate), o_orderkey) AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, label, pos > floor(n * 0.8::DOUBLE) AS is_valid FROM r""")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("_t"))
    return S.temporal_split(o, "_t", "o_orderkey", "label").select("o_orderkey", "label", "is_valid")


@query("temporal_split_fallback", """
WITH b AS (SELECT min(o_orderdate) AS t0 FROM orders), r0 AS (SELECT o_orderkey, (o_orderdate < t0 + INTERVAL 300 DAY)::INT AS label FROM orders, b),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS rk, count(*) OVER (PARTITION BY label) AS n FROM r0)
SELECT o_orderkey, label, rk > floor(n * 0.8::DOUBLE) AS is_valid FROM r""")
def _(spark, d):
    o = load(spark, d, "orders")
    first = o.agg(F.min("o_orderdate").alias("_t0"))
    o = attach_row(o, first).select("o_orderkey", (F.col("o_orderdate") < F.col("_t0") + F.expr("INTERVAL 300 DAYS")).cast("int").alias("label"),
                                               F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("_t"))
    return S.temporal_split(o, "_t", "o_orderkey", "label").select("o_orderkey", "label", "is_valid")


@query("stratified_folds", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS rk FROM orders)
SELECT o_orderkey, o_orderstatus, ((rk - 1) % 3)::INT AS fold FROM r""")
def _(spark, d):
    return S.stratified_folds(load(spark, d, "orders"), "o_orderstatus", 3, "o_orderkey", 42).select("o_orderkey", "o_orderstatus", "fold")


@query("shuffle_split", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) AS rk, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rk <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'eval' END AS split FROM r""")
def _(spark, d):
    return S.shuffle_split(load(spark, d, "documents"), 0.9, "doc_id", 7).select("doc_id", "split")


@query("bootstrap_bags", f"""
WITH b AS (SELECT unnest([0, 1, 2]) AS bag), u AS (SELECT b.bag, (('0x' || substr(md5(event_id || ':bag:' || b.bag || ':42'), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM events, b)
SELECT bag, w AS copies, count(*) AS n FROM (SELECT bag, {" + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in S.POISSON_CDF)} AS w FROM u) GROUP BY bag, w""")
def _(spark, d):
    bags = S.bootstrap_bags(load(spark, d, "events").select("event_id"), 3, "event_id", 42)
    long = bags.unpivot([], ["bag_0", "bag_1", "bag_2"], "_b", "copies")
    return long.groupBy(F.substring("_b", 5, 9).cast("int").alias("bag"), "copies").agg(F.count(F.lit(1)).alias("n"))


# --- distribution ------------------------------------------------------------------------------------------------

P_SQL = """CASE WHEN lam < 0.04 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0::DOUBLE * k * k * lam * lam))))) END"""


def ks_sql(source: str, by: str = "feature") -> str:
    """CTEs ending in ``ks`` ({by}, week, statistic, p_value, n_ref, n_curr), by the textbook definition."""
    return f"""
 ks_c AS (SELECT {by}, week, value, count(*) AS n FROM {source} WHERE value IS NOT NULL GROUP BY ALL),
 ks_t AS (SELECT {by}, week, sum(n)::BIGINT AS t FROM ks_c GROUP BY ALL),
 ks_g AS (SELECT DISTINCT {by}, week FROM {source} WHERE week > 0),
 ks_j AS (SELECT {', '.join('g.' + b.strip() for b in by.split(','))}, g.week, c.value, sum(CASE WHEN c.week = 0 THEN c.n ELSE 0 END) AS r, sum(CASE WHEN c.week > 0 THEN c.n ELSE 0 END) AS k
   FROM ks_g g JOIN ks_c c ON {' AND '.join(f'c.{b.strip()} = g.{b.strip()}' for b in by.split(','))} AND (c.week = 0 OR c.week = g.week) GROUP BY ALL),
 ks_s AS (SELECT {by}, week, sum(r) OVER w AS cr, sum(k) OVER w AS ck, sum(r) OVER v AS n_ref, sum(k) OVER v AS n_curr FROM ks_j
   WINDOW w AS (PARTITION BY {by}, week ORDER BY value), v AS (PARTITION BY {by}, week)),
 ks_d AS (SELECT {by}, week, max(abs(cr::DOUBLE / n_ref - ck::DOUBLE / n_curr)) AS statistic, max(n_ref)::BIGINT AS n_ref, max(n_curr)::BIGINT AS n_curr FROM ks_s GROUP BY ALL),
 ks_l AS (SELECT *, statistic * sqrt(n_ref::DOUBLE * n_curr / (n_ref + n_curr)) AS lam FROM ks_d),
 ks AS (SELECT {by}, week, statistic, {P_SQL} AS p_value, n_ref, n_curr FROM ks_l)"""


KS_BH = """,
 bh0 AS (SELECT *, p_value * count(*) OVER (PARTITION BY week) / row_number() OVER (PARTITION BY week ORDER BY p_value, feature) AS raw,
   row_number() OVER (PARTITION BY week ORDER BY p_value, feature) AS rk FROM ks),
 bh AS (SELECT *, greatest(0.0, least(1.0, min(raw) OVER (PARTITION BY week ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS p_adjusted FROM bh0)"""


@query("ks_stat", f"""WITH {EV}, s AS (SELECT event_type, week, value FROM ev), {ks_sql('s', 'event_type')}
SELECT event_type, week, {R('statistic', 'statistic')}, {R('p_value', 'p_value')}, n_ref, n_curr, p_value < 0.05 AS drift FROM ks""")
def _(spark, d):
    return rounded(D.ks_stat(events(spark, d), ["event_type"]), "statistic", "p_value")


@query("ks_test", f"""WITH {LONG}, {ks_sql('lo')}
SELECT feature, week, {R('statistic', 'statistic')}, {R('p_value', 'p_value')}, n_ref, n_curr, {R('1.358::DOUBLE * sqrt((n_ref + n_curr) / (n_ref::DOUBLE * n_curr))', 'd_critical')},
 0.1::DOUBLE AS min_effect, p_value < 0.05 AS significant, statistic >= 0.10 AS practically_significant, p_value < 0.05 AND statistic >= 0.10 AS drift FROM ks""")
def _(spark, d):
    return rounded(D.ks_test(feature_long(spark, d)), "statistic", "p_value", "d_critical")


@query("benjamini_hochberg", f"""WITH {LONG}, {ks_sql('lo')} {KS_BH}
SELECT feature, week, {R('p_adjusted', 'p_adjusted')}, p_adjusted < 0.05 AS rejected FROM bh""")
def _(spark, d):
    return rounded(D.benjamini_hochberg(D.ks_stat(feature_long(spark, d))).select("feature", "week", "p_adjusted", "rejected"), "p_adjusted")


EDGES = """
 q_s AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM lo WHERE week = 0 AND value IS NOT NULL),
 q_p AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS p),
 q_h AS (SELECT DISTINCT feature, p, p * (n - 1) AS h FROM q_s, q_p),
 q_e AS (SELECT h.feature, p, a.value + (b.value - a.value) * (h - floor(h)) AS edge FROM q_h h JOIN q_s a ON a.feature = h.feature AND a.i = floor(h)
   JOIN q_s b ON b.feature = h.feature AND b.i = ceil(h)),
 q_u AS (SELECT feature, edge, row_number() OVER (PARTITION BY feature ORDER BY edge) AS k, count(*) OVER (PARTITION BY feature) AS m FROM (SELECT DISTINCT feature, edge FROM q_e)),
 q_b AS (SELECT feature, k AS bin, CASE WHEN k = 1 THEN '-inf'::DOUBLE ELSE edge END AS lo_edge, coalesce(CASE WHEN k + 1 = m THEN 'inf'::DOUBLE ELSE lead(edge) OVER (PARTITION BY feature ORDER BY k) END) AS hi_edge, m
   FROM q_u QUALIFY k < m)"""

PSI = EDGES + """,
 p_g AS (SELECT DISTINCT feature, week FROM lo),
 p_c AS (SELECT g.feature, g.week, b.bin, count(l.value) AS c FROM p_g g JOIN q_b b ON b.feature = g.feature
   LEFT JOIN lo l ON l.feature = g.feature AND l.week = g.week AND l.value >= b.lo_edge AND l.value < b.hi_edge GROUP BY ALL),
 p_n AS (SELECT feature, week, sum(c) AS n FROM p_c GROUP BY ALL),
 p_s AS (SELECT c.feature, c.week, c.bin, CASE WHEN c = 0 THEN 0.0001::DOUBLE ELSE c::DOUBLE / n END AS s FROM p_c c JOIN p_n n ON n.feature = c.feature AND n.week = c.week),
 ps AS (SELECT a.feature, a.week, sum((a.s - r.s) * ln(a.s / r.s)) AS psi FROM p_s a JOIN p_s r ON r.feature = a.feature AND r.bin = a.bin AND r.week = 0 WHERE a.week > 0 GROUP BY ALL)"""


@query("reference_edges", f"WITH {LONG}, {EDGES} SELECT feature, k AS position, {R('edge', 'edge')} FROM q_u")
def _(spark, d):
    e = D.reference_edges(feature_long(spark, d)).select("feature", F.posexplode("edges").alias("_i", "edge"))
    return rounded(e.select("feature", (F.col("_i") + 1).cast("long").alias("position"), "edge"), "edge")


@query("psi", f"WITH {LONG}, {PSI} SELECT feature, week, {R('psi', 'psi')}, psi >= 0.2 AS drift FROM ps")
def _(spark, d):
    return rounded(D.psi(feature_long(spark, d)).select("feature", "week", "psi", "drift"), "psi")


@query("psi_null", f"""WITH {LONG}, {PSI}, c AS (SELECT feature, week, count(value) AS n FROM lo GROUP BY ALL)
SELECT feature, ps.week, r.n AS n_ref, c.n AS n_curr, {R('psi', 'psi')}, {R('9.0::DOUBLE / c.n', 'chi2_expected_psi')}, psi >= 0.2 AS exceeds_threshold, true AS null_drawn, true AS consistent
FROM ps JOIN c USING (feature, week) JOIN c r USING (feature) WHERE r.week = 0""")
def _(spark, d):
    """The null quantile is a random draw: positive, near its chi-square size, and what the flags follow."""
    out = D.psi_null(feature_long(spark, d))
    near = (F.col("psi_null_q") > 0.3 * F.col("chi2_expected_psi")) & (F.col("psi_null_q") < 10 * F.col("chi2_expected_psi"))
    agree = (F.col("drift") == (F.col("exceeds_threshold") & (F.col("psi") > F.col("psi_null_q"))))
    return rounded(out.select("feature", "week", "n_ref", "n_curr", "psi", "chi2_expected_psi", "exceeds_threshold", near.alias("null_drawn"), agree.alias("consistent")), "psi", "chi2_expected_psi")


def joint_sql(bins: int, t: str) -> str:
    """CTEs ending in ``{t}h``: reference and window counts per joint equal-width bin."""
    return f"""
 {t}m AS (SELECT feature, week, min(value) AS lo_v, max(value) AS hi_v, count(value) AS n FROM lo GROUP BY ALL),
 {t}j AS (SELECT a.feature, a.week, least(a.lo_v, r.lo_v) AS lo_v, greatest(a.hi_v, r.hi_v) AS hi_v, a.n AS n_curr, r.n AS n_ref FROM {t}m a JOIN {t}m r ON r.feature = a.feature AND r.week = 0 WHERE a.week > 0),
 {t}b AS (SELECT j.*, i, lo_v + i * ((hi_v - lo_v) / {bins}.0::DOUBLE) AS lo_edge, CASE WHEN i = {bins - 1} THEN 'inf'::DOUBLE ELSE lo_v + (i + 1) * ((hi_v - lo_v) / {bins}.0::DOUBLE) END AS hi_edge,
   (hi_v - lo_v) / {bins}.0::DOUBLE AS width FROM {t}j j, (SELECT unnest(range({bins})) AS i)),
 {t}v AS (SELECT feature, week, value, count(*) AS c FROM lo WHERE value IS NOT NULL GROUP BY ALL),
 {t}h AS (SELECT b.feature, b.week, b.i, b.width, any_value(b.n_curr) AS n_curr, any_value(b.n_ref) AS n_ref, coalesce(sum(CASE WHEN l.week > 0 THEN l.c END), 0) AS cc, coalesce(sum(CASE WHEN l.week = 0 THEN l.c END), 0) AS rc
   FROM {t}b b LEFT JOIN {t}v l ON l.feature = b.feature AND (l.week = 0 OR l.week = b.week) AND l.value >= b.lo_edge AND l.value < b.hi_edge GROUP BY ALL)"""


JS = joint_sql(20, "s") + """,
 js0 AS (SELECT feature, week, cc::DOUBLE / n_curr AS p, rc::DOUBLE / n_ref AS q FROM sh),
 js AS (SELECT feature, week, sqrt(greatest(0.0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / (0.5::DOUBLE * (p + q))) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / (0.5::DOUBLE * (p + q))) ELSE 0 END))) AS js_distance
   FROM js0 GROUP BY ALL)"""
KL = joint_sql(10, "k") + """,
 kl0 AS (SELECT feature, week, CASE WHEN cc = 0 THEN 0.0001::DOUBLE ELSE cc / (n_curr * width) END AS p, CASE WHEN rc = 0 THEN 0.0001::DOUBLE ELSE rc / (n_ref * width) END AS q FROM kh),
 kl1 AS (SELECT feature, week, p / sum(p) OVER (PARTITION BY feature, week) AS p, q / sum(q) OVER (PARTITION BY feature, week) AS q FROM kl0),
 kl AS (SELECT feature, week, sum(p * ln(p / q)) AS kl_div FROM kl1 GROUP BY ALL)"""


@query("js_distance", f"WITH {LONG}, {JS} SELECT feature, week, {R('js_distance', 'js_distance')}, js_distance >= 0.10 AS drift FROM js")
def _(spark, d):
    return rounded(D.js_distance(feature_long(spark, d)), "js_distance")


@query("kl_divergence", f"WITH {LONG}, {KL} SELECT feature, week, {R('kl_div', 'kl_div')}, kl_div >= 0.5 AS drift FROM kl")
def _(spark, d):
    return rounded(D.kl_divergence(feature_long(spark, d)), "kl_div")


CHI_TAIL = 21.666  # 0.99 quantile of chi-square with 9 degrees: divided by the window's rows, the size of PSI under no change
VOTES = f"""WITH {LONG}, {ks_sql('lo')} {KS_BH}, {PSI}, {JS},
 vt AS (SELECT week, feature, 'ks_stats' AS method, p_adjusted < 0.05 AND statistic >= 0.10 AS drift FROM bh UNION ALL SELECT week, feature, 'psi', psi >= 0.2 AND psi > {CHI_TAIL} / (SELECT count(value) FROM lo l WHERE l.feature = ps.feature AND l.week = ps.week) FROM ps
   UNION ALL SELECT week, feature, 'kl_divergence', js_distance >= 0.10 FROM js)"""


def vote_rows(spark, d):
    """(week, feature, method, drift) of the three per-feature votes, from one scan; PSI votes where it passes both its band and its null."""
    p = week_profile(feature_long(spark, d))
    return (D.ks_votes(p).select("week", "feature", F.lit("ks_stats").alias("method"), "drift")
            .unionByName(D.psi_null(p).select("week", "feature", F.lit("psi").alias("method"), "drift"))
            .unionByName(D.js_distance(p).select("week", "feature", F.lit("kl_divergence").alias("method"), "drift")))


@query("drift_votes", VOTES + f"""
SELECT week, method, count(*) AS features_total, sum(drift::INT)::BIGINT AS features_crossed, {R('sum(drift::INT)::DOUBLE / count(*)', 'fraction')},
 sum(drift::INT)::DOUBLE / count(*) >= CASE any_value(method) WHEN 'psi' THEN 0.6 ELSE 0.3 END AS raw_flag FROM vt GROUP BY ALL""")
def _(spark, d):
    return rounded(D.feature_vote(vote_rows(spark, d)), "fraction")


def nulls_sql(trials: int) -> str:
    """CTEs ending in ``na``: one row per (trial, feature), by splitting the reference events as often as there are trials."""
    return f"""{EV}, tr AS (SELECT unnest(range({trials})) AS trial),
 s0 AS (SELECT event_id, trial, row_number() OVER (PARTITION BY trial ORDER BY md5(event_id || ':' || trial || ':7'), event_id, trial) AS rk, count(*) OVER (PARTITION BY trial) AS n FROM ev, tr WHERE week = 0),
 lo AS (SELECT trial || '/' || f.feature AS feature, CASE WHEN rk <= greatest(floor(n * (1 / 12.0::DOUBLE)), 50) THEN 1 ELSE 0 END AS week, CASE f.feature WHEN 'value' THEN e.value ELSE e.user_id::DOUBLE END AS value
   FROM s0 JOIN ev e USING (event_id), (SELECT unnest(['value', 'user_id']) AS feature) f), {ks_sql('lo')}, {PSI},
 na AS (SELECT split_part(feature, '/', 1)::INT AS trial, split_part(feature, '/', 2) AS feature, statistic, p_value < 0.05 AS ks_p_only, p_value < 0.05 AND statistic >= 0.10 AS ks_with_effect, psi, psi >= 0.2 AS psi_fixed
   FROM ks JOIN ps USING (feature))"""


def _null(spark, d, trials):
    ev = events(spark, d).filter("week = 0").select("event_id", "value", "user_id")
    return D.null_alarm_rates(W.to_long(ev, ["event_id"], ["value", "user_id"]), "event_id", trials=trials)


@query("null_alarms", f"WITH {nulls_sql(3)} SELECT trial, feature, {R('statistic', 'ks_statistic')}, ks_p_only, ks_with_effect, {R('psi', 'psi')}, psi_fixed FROM na")
def _(spark, d):
    return rounded(_null(spark, d, 3).drop("psi_calibrated"), "ks_statistic", "psi")


@query("null_alarm_summary", f"""WITH {nulls_sql(5)} SELECT trial, count(*) AS n_testable, {R('avg(ks_p_only::INT)', 'ks_pvalue_only')}, {R('avg(ks_with_effect::INT)', 'ks_with_effect_size')},
 {R('avg(psi_fixed::INT)', 'psi_fixed_threshold')}, coalesce(string_agg(CASE WHEN ks_with_effect THEN feature END, ',' ORDER BY round(statistic, 3) DESC, feature DESC), '') AS offenders, avg(ks_with_effect::INT) <= 0.05 AS passed FROM na GROUP BY trial""")
def _(spark, d):
    """Without the calibrated PSI share, which is drawn at random."""
    out = D.alarm_summary(_null(spark, d, 5)).drop("psi_calibrated_null")
    named = out.withColumn("offenders", F.array_join(F.transform("offenders", lambda o: o["feature"]), ","))
    return rounded(named, "ks_pvalue_only", "ks_with_effect_size", "psi_fixed_threshold")


@query("calibrate_consensus", f"""WITH {nulls_sql(10)}, x AS (SELECT trial, avg(ks_with_effect::INT) AS x FROM na GROUP BY trial), s AS (SELECT avg(x) AS m, max(x) AS h, quantile_cont(x, 0.99) AS t, count(*) AS n FROM x)
SELECT {R('m', 'mean')}, {R('h', 'max')}, {R('t', 'tail')}, n AS n_trials, h = 0 AS degenerate, CASE WHEN h > 0 THEN least(0.95::DOUBLE, ceil(t * 20) / 20) END AS suggested FROM s""")
def _(spark, d):
    """By the KS rule; the PSI rule's null is drawn at random."""
    return rounded(D.calibrate_consensus(_null(spark, d, 10), rules=("ks",)), "mean", "max", "tail")


PAIRS = LONG.replace(" lo AS (", " lo0 AS (") + f""", rw AS (SELECT unnest(range((SELECT max(week) FROM lo0))) AS r),
 lo AS (SELECT r || '/' || feature AS feature, CASE WHEN week <= r THEN 0 ELSE r * 1000 + week END AS week, value FROM lo0, rw), {ks_sql('lo')} {KS_BH}, {PSI}, {JS}"""


@query("signal_pairs", f"""WITH {PAIRS} SELECT (bh.week // 1000)::BIGINT AS ref_week, (bh.week % 1000)::BIGINT AS week, {R('avg((p_adjusted < 0.05 AND statistic >= 0.10)::INT)', 'ks_drift_fraction')}, {R('avg(statistic)', 'ks_mean_statistic')},
 {R('avg(psi)', 'psi_mean')}, {R('avg(js_distance)', 'js_mean_distance')}, {R('bh.week % 1000 - bh.week // 1000', 'weeks_since_reference')}
FROM bh JOIN ps ON ps.feature = bh.feature AND ps.week = bh.week JOIN js ON js.feature = bh.feature AND js.week = bh.week GROUP BY bh.week""")
def _(spark, d):
    """The signals of the signal matrix that nothing random enters, for every reference week and later week."""
    long = feature_long(spark, d)
    weeks = sorted(r[0] for r in long.select("week").distinct().collect())
    each = pair_statistics(week_profile(long, ref_weeks=weeks[:-1]))
    out = each.groupBy("ref_week", "week").agg(F.avg(F.col("ks_drift").cast("double")).alias("ks_drift_fraction"), F.avg("ks_statistic").alias("ks_mean_statistic"),
                                               F.avg("psi").alias("psi_mean"), F.avg("js_distance").alias("js_mean_distance"))
    return rounded(out.withColumn("weeks_since_reference", (F.col("week") - F.col("ref_week")).cast("double")), "ks_drift_fraction", "ks_mean_statistic", "psi_mean", "js_mean_distance")


@query("feature_signal_summary", VOTES + f""", m AS (SELECT week, avg((p_adjusted < 0.05 AND statistic >= 0.10)::INT) AS a, avg(statistic) AS b FROM bh GROUP BY week),
 p AS (SELECT week, avg((psi >= 0.2)::INT) AS a, avg(least(psi * 10, 20.0)) AS b FROM ps GROUP BY week), j AS (SELECT week, avg(js_distance) AS a FROM js GROUP BY week)
SELECT 0::BIGINT AS ref_week, week, {R('m.a', 'ks_drift_fraction')}, {R('m.b', 'ks_mean_statistic')}, {R('p.a', 'psi_drift_fraction')}, {R('p.b', 'psi_mean_ratio')}, {R('j.a', 'js_mean_distance')}
FROM m JOIN p USING (week) JOIN j USING (week)""")
def _(spark, d):
    long = week_profile(feature_long(spark, d))
    ks = D.ks_votes(long).select("feature", "week", F.col("statistic").alias("ks_statistic"), F.col("drift").alias("ks_drift"))
    ps = D.psi(long).select("feature", "week", (F.col("psi") * 10).alias("psi_ratio"), F.col("drift").alias("psi_drift"))
    js = D.js_distance(long).select("feature", "week", "js_distance")
    both = ks.join(ps, ["feature", "week"]).join(js, ["feature", "week"]).withColumn("ref_week", F.lit(0).cast("long"))
    return rounded(D.feature_signal_summary(both), "ks_drift_fraction", "ks_mean_statistic", "psi_drift_fraction", "psi_mean_ratio", "js_mean_distance")
