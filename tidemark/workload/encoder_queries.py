"""Feature encoders over orders with customer attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.labels import FAMILIES, LABELS, feature_label
from tidemark.operators import encoders as E
from tidemark.operators.windows import assign_week
from tidemark.sources.tables import load
from tidemark.plans.checkpoints import stable
from tidemark.plans.ordered import attach_row
from tidemark.workload.base import R, query, rounded, weekly_sql


def transactions(spark, d):
    """Orders in the shape of card transactions: offsets in seconds, attributes with gaps, small counters."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    gap = lambda m, col: F.when(F.col("o_orderkey") % m != 0, col)
    t = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"), (days * 86400 + F.col("o_orderkey") % 86400).alias("t"), F.col("o_custkey").alias("entity"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("product"), gap(5, F.col("c_mktsegment")).alias("email"),
        F.col("c_nationkey").alias("addr"), gap(7, F.col("o_orderkey") % 50).alias("d1"), gap(3, F.col("o_orderkey") % 400).cast("double").alias("dist1"),
        (F.col("o_orderkey") % 900).cast("double").alias("dist2"), (F.col("o_orderkey") % 4).alias("c1"), gap(6, F.col("o_orderkey") % 3).alias("c2"),
        (F.col("o_custkey") % 100 == 0).cast("long").alias("c3"), gap(4, F.col("o_orderstatus")).alias("m1"), gap(9, F.lit("T")).alias("m2"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_orderdate").alias("ts"))
    return assign_week(t, "ts", 730, 180)


TX = """tx0 AS (SELECT o_orderkey AS id, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 86400 + o_orderkey % 86400 AS t, o_custkey AS entity, o_totalprice AS amount,
   o_orderpriority AS product, CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END AS email, c_nationkey AS addr, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 END AS d1,
   CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 400)::DOUBLE END AS dist1, (o_orderkey % 900)::DOUBLE AS dist2, o_orderkey % 4 AS c1, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 3 END AS c2,
   (o_custkey % 100 = 0)::BIGINT AS c3, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS m1, CASE WHEN o_orderkey % 9 <> 0 THEN 'T' END AS m2, (o_orderstatus = 'F')::INT AS label, o_orderdate AS ts
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey), """ + weekly_sql("tx0", "ts", 730, 180, "tx")


@query("entity_keys", f"""WITH {TX}, k AS (SELECT *, coalesce((t // 86400 - d1)::VARCHAR, 'nan') || '__' || coalesce(email, 'nan') AS uid1 FROM tx)
SELECT id, uid1, coalesce(entity::VARCHAR, 'nan') || '__' || coalesce(addr::VARCHAR, 'nan') || '__' || uid1 AS uid2 FROM k""")
def _(spark, d):
    out = E.entity_keys(transactions(spark, d), "t", "d1", "email", "entity", "addr")
    return out.select("id", F.col("_uid1").alias("uid1"), F.col("_uid2").alias("uid2"))


@query("sequence_features", f"""WITH {TX}
SELECT id, t - lag(t) OVER w AS lag_seconds, {R('abs(amount / nullif(lag(amount) OVER w, 0) - 1)', 'abs_pct_change')}, row_number() OVER w - 1 AS sequence_index FROM tx WINDOW w AS (PARTITION BY entity ORDER BY t, id)""")
def _(spark, d):
    out = E.sequence_features(transactions(spark, d), "entity", "t", "id", "amount")
    return rounded(out.select("id", "lag_seconds", "abs_pct_change", "sequence_index"), "abs_pct_change")


@query("log_distance", f"WITH {TX} SELECT id, {R('ln(1 + coalesce(dist1, dist2))', 'log_dist')} FROM tx")
def _(spark, d):
    return rounded(transactions(spark, d).select("id", E.log_distance("dist1", "dist2").alias("log_dist")), "log_dist")


@query("date_parts", f"""WITH {TX}, p AS (SELECT id, t, TIMESTAMP '2017-11-30' + to_seconds(t) AS moment FROM tx)
SELECT id, t // 86400 AS days, hour(moment)::INT AS hour, (isodow(moment) - 1)::VARCHAR || '_' || hour(moment)::VARCHAR AS weekday_hour FROM p""")
def _(spark, d):
    out = E.date_parts(transactions(spark, d), "t")
    return out.select("id", F.col("_days").alias("days"), F.col("_hour").alias("hour"), F.col("_weekday__hour").alias("weekday_hour"))


@query("cyclic_encode", f"WITH {TX}, h AS (SELECT id, (t % 86400) // 3600 AS hour FROM tx) SELECT id, {R('cos(2 * pi() * hour / 23.0::DOUBLE)', 'hour_cos')}, {R('sin(2 * pi() * hour / 23.0::DOUBLE)', 'hour_sin')} FROM h")
def _(spark, d):
    h = transactions(spark, d).select("id", F.floor(F.col("t") % 86400 / 3600).alias("hour"))
    return rounded(E.cyclic_encode(h, "hour", 23.0), "hour_cos", "hour_sin")


@query("cyclic_fitted_period", f"""WITH {TX}, p AS (SELECT max(c1)::DOUBLE AS p FROM tx WHERE week = 0) SELECT id, {R('cos(2 * pi() * c1 / p)', 'c1_cos')}, {R('sin(2 * pi() * c1 / p)', 'c1_sin')} FROM tx, p""")
def _(spark, d):
    t = transactions(spark, d)
    return rounded(E.cyclic_encode(t.select("id", "c1"), "c1", E.fit_period(t.filter("week = 0"), "c1")), "c1_cos", "c1_sin")


@query("combine_keys", f"WITH {TX} SELECT id, coalesce(email, 'nan') || '__' || coalesce(product, 'nan') AS pair FROM tx")
def _(spark, d):
    return transactions(spark, d).select("id", E.combine_keys("email", "product").alias("pair"))


@query("amount_features", f"""WITH {TX} SELECT id, trunc((amount - trunc(amount)) * 1000)::INT AS fraction, length(split_part(amount::VARCHAR, '.', 2))::INT AS decimals, {R('ln(1 + greatest(amount, 0))', 'log_amount')} FROM tx""")
def _(spark, d):
    out = transactions(spark, d).select("id", E.amount_fraction("amount").alias("fraction"), E.decimal_length("amount").alias("decimals"), E.log_amount("amount").alias("log_amount"))
    return rounded(out, "log_amount")


@query("group_aggregate_encode", f"""WITH {TX}, k AS (SELECT *, coalesce(email, 'nan') || '__' || coalesce(product, 'nan') || '__' || (entity % 300) AS pair FROM tx),
 g AS (SELECT pair, max(amount) AS a, avg(amount) AS b, var_samp(amount) AS c FROM k WHERE week = 0 GROUP BY pair), o AS (SELECT max(amount) AS a, avg(amount) AS b, var_samp(amount) AS c FROM k WHERE week = 0)
SELECT id, {R('coalesce(g.a, o.a)', '_max_amount_pair', 4)}, {R('coalesce(g.b, o.b)', '_mean_amount_pair', 4)}, {R('coalesce(g.c, o.c) / 1e6', '_var_amount_pair', 4)} FROM k LEFT JOIN g USING (pair), o WHERE week > 0""")
def _(spark, d):
    k = transactions(spark, d).withColumn("pair", F.concat_ws("__", E.combine_keys("email", "product"), (F.col("entity") % 300).cast("string")))
    state = E.fit_group_aggregates(k.filter("week = 0"), "pair", "amount")
    out = E.group_aggregate_encode(k.filter("week > 0"), state, "pair", "amount")
    out = out.select("id", "_max_amount_pair", "_mean_amount_pair", (F.col("_var_amount_pair") / 1e6).alias("_var_amount_pair"))
    return rounded(out, "_max_amount_pair", "_mean_amount_pair", "_var_amount_pair", digits=4)


@query("frequency_encode", f"""WITH {TX}, n AS (SELECT count(*)::DOUBLE AS n FROM tx WHERE week = 0), a AS (SELECT c2, count(*) AS k FROM tx WHERE week = 0 GROUP BY c2), b AS (SELECT email, count(*) AS k FROM tx WHERE week = 0 GROUP BY email)
SELECT id, {R('coalesce((SELECT k FROM a WHERE a.c2 IS NOT DISTINCT FROM tx.c2) / n, 0)::FLOAT::DOUBLE', '_freq_ref_c2')}, {R('coalesce((SELECT k FROM b WHERE b.email IS NOT DISTINCT FROM tx.email) / n, 0)::FLOAT::DOUBLE', '_freq_ref_email')} FROM tx, n WHERE week > 0""")
def _(spark, d):
    t = transactions(spark, d)
    out = E.frequency_encode(t.filter("week > 0"), E.fit_frequency(t.filter("week = 0"), ["c2", "email"]), ["c2", "email"])
    out = out.select("id", *[F.col(c).cast("double").alias(c) for c in ("_freq_ref_c2", "_freq_ref_email")])
    return rounded(out, "_freq_ref_c2", "_freq_ref_email")


@query("unseen_flag", f"WITH {TX} SELECT id, (entity NOT IN (SELECT entity FROM tx WHERE week = 0))::INT AS unseen FROM tx WHERE week > 0")
def _(spark, d):
    t = transactions(spark, d)
    return E.unseen_flag(t.filter("week > 0"), E.fit_known_groups(t.filter("week = 0"), "entity"), "entity", "unseen").select("id", "unseen")


@query("row_null_count", f"WITH {TX} SELECT id, (email IS NULL)::INT + (d1 IS NULL)::INT + (dist1 IS NULL)::INT + (c2 IS NULL)::INT + (m1 IS NULL)::INT + (m2 IS NULL)::INT AS missing FROM tx")
def _(spark, d):
    return transactions(spark, d).select("id", E.row_null_count(["email", "d1", "dist1", "c2", "m1", "m2"]).alias("missing"))


@query("counter_summary", f"""WITH {TX} SELECT id, (coalesce(c1, 0) <> 0)::INT + (coalesce(c2, 0) <> 0)::INT + (coalesce(c3, 0) <> 0)::INT AS _ccols_nonzero, (coalesce(c1, 0) + coalesce(c2, 0) + coalesce(c3, 0))::FLOAT AS _ccols_sum,
  coalesce((c1 = 0)::INT, 0)::VARCHAR || coalesce((c2 = 0)::INT, 0)::VARCHAR || coalesce((c3 = 0)::INT, 0)::VARCHAR AS _ccols_0_bin FROM tx""")
def _(spark, d):
    return E.counter_summary(transactions(spark, d).select("id", "c1", "c2", "c3"), ["c1", "c2", "c3"])


@query("timedelta_summary", f"""WITH {TX} SELECT id, coalesce(d1, 0) AS d1, coalesce(dist1, 0) AS dist1, (d1 IS NULL)::INT + (dist1 IS NULL)::INT AS _dcol_na, (d1 IS NULL)::INT::VARCHAR || (dist1 IS NULL)::INT::VARCHAR AS _dcols_na_bin FROM tx""")
def _(spark, d):
    return E.timedelta_summary(transactions(spark, d).select("id", "d1", "dist1"), ["d1", "dist1"])


@query("match_flag_pattern", f"WITH {TX} SELECT id, (m1 IS NULL)::INT::VARCHAR || (m2 IS NULL)::INT::VARCHAR AS _mcols_na_bin FROM tx")
def _(spark, d):
    return E.match_flag_pattern(transactions(spark, d).select("id", "m1", "m2"), ["m1", "m2"]).select("id", "_mcols_na_bin")


@query("redundancy_filter", f"""WITH {TX}, l AS (SELECT 'c1' AS c, c1::VARCHAR AS v FROM tx WHERE week = 0 UNION ALL SELECT 'c3', c3::VARCHAR FROM tx WHERE week = 0 UNION ALL SELECT 'm2', m2 FROM tx WHERE week = 0 UNION ALL SELECT 'product', product FROM tx WHERE week = 0),
 k AS (SELECT c, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL) SELECT c AS "column", {R('max(n)::DOUBLE / sum(n)', 'modal_share')}, max(n)::DOUBLE / sum(n) >= 0.98 AS redundant FROM k GROUP BY c""")
def _(spark, d):
    s = E.modal_shares(transactions(spark, d).filter("week = 0"), ["c1", "c3", "m2", "product"])
    return rounded(s.withColumn("redundant", F.col("modal_share") >= 0.98), "modal_share")


@query("ordinal_encode", f"""WITH {TX}, f AS (SELECT entity, min(t * 1000000 + id) AS o FROM tx WHERE week = 0 GROUP BY entity), r AS (SELECT entity, row_number() OVER (ORDER BY o) - 1 AS code FROM f),
 g AS (SELECT email, min(t * 1000000 + id) AS o FROM tx WHERE week = 0 AND email IS NOT NULL GROUP BY email), s AS (SELECT email, row_number() OVER (ORDER BY o) - 1 AS code FROM g)
SELECT id, coalesce(r.code, -1)::INT AS entity, (CASE WHEN tx.email IS NULL THEN -2 ELSE coalesce(s.code, -1) END)::INT AS email FROM tx LEFT JOIN r USING (entity) LEFT JOIN s ON s.email = tx.email WHERE week > 0""")
def _(spark, d):
    t = transactions(spark, d)
    state = E.fit_ordinal(t.filter("week = 0"), ["entity", "email"], "t", "id")
    return E.ordinal_encode(t.filter("week > 0"), state, ["entity", "email"]).select("id", "entity", "email")


@query("refit_per_window", f"""WITH {TX}, n AS (SELECT week, count(*)::DOUBLE AS n FROM tx GROUP BY week), a AS (SELECT week, c2, count(*) AS k FROM tx GROUP BY ALL),
 g AS (SELECT week, product, min(t * 1000000 + id) AS o FROM tx GROUP BY ALL), s AS (SELECT week, product, row_number() OVER (PARTITION BY week ORDER BY o) - 1 AS code FROM g)
SELECT id, week, {R('(k / n)::FLOAT::DOUBLE', '_freq_ref_c2')}, s.code::INT AS product FROM tx JOIN n USING (week) JOIN a ON a.week = tx.week AND a.c2 IS NOT DISTINCT FROM tx.c2 JOIN s ON s.week = tx.week AND s.product = tx.product""")
def _(spark, d):
    out = E.refit_per_window(transactions(spark, d), "week", ["c2"], ["product"], "t", "id")
    return rounded(out.select("id", "week", F.col("_freq_ref_c2").cast("double").alias("_freq_ref_c2"), "product"), "_freq_ref_c2")


_LOOK = "CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
_FAM = "CASE " + " ".join(f"WHEN regexp_matches({{x}}, '^{k}[0-9]+$') THEN '{v}' || substr({{x}}, 2)" for k, v in FAMILIES.items()) + " WHEN starts_with({x}, 'id_') THEN 'Identity/device attribute ' || substr({x}, 4) ELSE {x} END"
_BASE = f"coalesce({_LOOK}, {_FAM})"


@query("feature_label", f"""WITH n AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'C' || (o_orderkey % 14 + 1) WHEN 1 THEN '_freq_ref_C' || (o_orderkey % 14 + 1) WHEN 2 THEN '_mean_TransactionAmt__P_emaildomain__ProductCD'
   WHEN 3 THEN 'id_' || (o_orderkey % 38) WHEN 4 THEN '_ccols_sum' ELSE o_orderstatus END AS name, count(*) AS n FROM orders GROUP BY 1)
SELECT name, n, coalesce({_LOOK.format(x='name')}, CASE WHEN starts_with(name, '_freq_ref_') THEN 'How common this value of "' || {_BASE.format(x='substr(name, 11)')} || '" was in training'
  WHEN starts_with(name, '_mean_') THEN 'Mean of "Transaction amount" per "email domain x product"' END, {_BASE.format(x='name')}) AS label FROM n""")
def _(spark, d):
    k = F.col("o_orderkey")
    name = (F.when(k % 6 == 0, F.concat(F.lit("C"), (k % 14 + 1).cast("string"))).when(k % 6 == 1, F.concat(F.lit("_freq_ref_C"), (k % 14 + 1).cast("string")))
            .when(k % 6 == 2, "_mean_TransactionAmt__P_emaildomain__ProductCD").when(k % 6 == 3, F.concat(F.lit("id_"), (k % 38).cast("string")))
            .when(k % 6 == 4, "_ccols_sum").otherwise(F.col("o_orderstatus")))
    return load(spark, d, "orders").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", feature_label(F.col("name")))


@query("block_pca", """
SELECT vec_id, 0 AS nulls, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE))::FLOAT::DOUBLE, 3) + 0.0 AS total, true AS centred, true AS uncorrelated, true AS falling FROM embeddings""")
def _(spark, d):
    """All dimensions as one block. Signs and near-equal axes are free, so of the projections their moments are given."""
    e = load(spark, d, "embeddings")
    names = [f"V{i + 1}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0])]
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    out = E.block_pca(wide, E.fit_block_pca(wide, names))
    x, y = "_vcols_dec0", "_vcols_dec1"
    moments = out.agg(((F.abs(F.avg(x)) < 1e-6) & (F.abs(F.avg(y)) < 1e-6)).alias("centred"), (F.abs(F.corr(x, y)) < 1e-6).alias("uncorrelated"),
                      (F.var_pop(x) >= F.var_pop(y)).alias("falling"))
    return attach_row(out.select("vec_id", F.col("_vcols_na").cast("int").alias("nulls"), (F.round(F.col("_vcols_sum").cast("double"), 3) + 0.0).alias("total")), moments)


def card_shape(spark, d):
    """The same orders under the column names of the card-transaction table, with a small wide block."""
    t = transactions(spark, d)
    v = [((F.col("id") * (7 + i)) % (11 + i)).cast("double").alias(f"V{i + 1}") for i in range(6)]
    return t.select("week", F.col("id").alias("TransactionID"), F.col("t").alias("TransactionDT"), F.col("label").alias("isFraud"), F.col("amount").alias("TransactionAmt"),
                    F.col("product").alias("ProductCD"), F.col("entity").alias("card1"), (F.col("entity") % 5).alias("card3"), (F.col("entity") % 7).alias("card5"), F.col("addr").alias("addr1"),
                    "dist1", "dist2", F.col("email").alias("P_emaildomain"), F.col("c1").alias("C1"), F.col("c2").alias("C2"), F.col("c3").alias("C3"), F.col("d1").alias("D1"), F.col("m1").alias("M1"), F.col("m2").alias("M2"), *v)


def fitted_encoder(spark, d):
    """(encoder fitted on the reference, prepared rows)."""
    enc = E.FrozenEncoder(E.EncoderColumns(dropped=["_days", "TransactionDT", "TransactionID", "_uid1", "_uid2", "week"]))
    rows = stable(enc.prepare(card_shape(spark, d)))  # ordered once: every stage of the fit and the replay read it
    return enc.fit(rows.filter("week = 0")), rows


@query("frozen_encoder")
def _(spark, d):
    enc, rows = fitted_encoder(spark, d)
    return enc.transform(rows.filter("week > 0"), ["TransactionID", "week"])


@query("frozen_encoder_rows", f"""WITH {TX} SELECT id AS "TransactionID", week, true AS no_identifiers, true AS no_text, ln(1 + amount) IS NOT NULL AS has_amount FROM tx WHERE week > 0""")
def _(spark, d):
    """What must hold of the encoder's output: every later row, no identifier column among the features, numbers only."""
    enc, rows = fitted_encoder(spark, d)
    out = enc.transform(rows.filter("week > 0"), ["TransactionID", "week"])
    features = list(enc.feature_schema)
    text = [c for c, t in out.dtypes if t == "string" and c in features]
    return out.select("TransactionID", "week", F.lit(not {*enc.cols.dropped, enc.cols.label} & set(features)).alias("no_identifiers"), F.lit(not text).alias("no_text"), F.col("_log_amount").isNotNull().alias("has_amount"))
