"""Shared views of the given tables and the query registry.

Each query is a Spark function of (spark, folder) and, where SQL can say it, the same result as SQL text over the raw
tables. The SQL is written from the definition of the statistic, not from the Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.windows import assign_week, to_long
from tidemark.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round result columns; a sum in another order differs in the last bits only."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def R(expr: str, name: str, digits: int = 6) -> str:
    """The SQL twin of ``rounded``."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name}"


DAY_US = 86_400_000_000


def weekly_sql(table: str, ts: str, ref_days: int, window_days: int, name: str) -> str:
    """CTEs that give ``name``: the table with a ``week`` column."""
    ref, width = ref_days * DAY_US, window_days * DAY_US
    return f"""
 {name}_b AS (SELECT min(epoch_us({ts})) AS t0 FROM {table}),
 {name}_r AS (SELECT t.*, CASE WHEN epoch_us({ts}) - t0 - {ref} < 0 THEN 0 ELSE (epoch_us({ts}) - t0 - {ref}) // {width} + 1 END AS raw_week
              FROM {table} t, {name}_b),
 {name}_w AS (SELECT raw_week, dense_rank() OVER (ORDER BY raw_week) AS week FROM (SELECT DISTINCT raw_week FROM {name}_r WHERE raw_week > 0)),
 {name} AS (SELECT r.* EXCLUDE (raw_week), coalesce(w.week, 0)::BIGINT AS week FROM {name}_r r LEFT JOIN {name}_w w USING (raw_week))"""


EV = weekly_sql("events", "ts", 14, 2, "ev")
LI = weekly_sql("lineitem", "l_shipdate", 730, 180, "li")
ORD = weekly_sql("orders", "o_orderdate", 730, 90, "od")


def events(spark: SparkSession, d: str) -> DataFrame:
    return assign_week(load(spark, d, "events"), "ts", 14, 2)


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return assign_week(load(spark, d, "lineitem"), "l_shipdate", 730, 180)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return assign_week(load(spark, d, "orders"), "o_orderdate", 730, 90)


FEATURES = ("quantity", "price", "discount", "tax", "shifted")


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """(week, five features): four columns as they are and one whose level rises by 4 % a window."""
    li = lineitem(spark, d)
    return li.select("week", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
                     F.col("l_tax").alias("tax"), (F.col("l_extendedprice") * (1 + 0.04 * F.col("week"))).alias("shifted"))


def feature_long(spark: SparkSession, d: str) -> DataFrame:
    return to_long(feature_table(spark, d), ["week"], FEATURES)


LONG = LI + """,
 ft AS (SELECT week, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
               l_extendedprice * (1::DOUBLE + 0.04::DOUBLE * week) AS shifted FROM li),
 lo AS (""" + " UNION ALL ".join(f"SELECT week, '{f}' AS feature, {f} AS value FROM ft" for f in FEATURES) + ")"


def scored_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a label (an error) and a score that knows the label less and less from window to window."""
    ev = events(spark, d)
    label = (F.col("event_type") == "error").cast("int")
    noise = F.col("user_id") % 97 / F.lit(97.0)
    knows = F.greatest(F.lit(0.0), F.lit(0.5) - 0.05 * F.col("week"))
    return ev.select(F.col("event_id").alias("seq"), "week", label.alias("label"), noise.alias("_n"), knows.alias("_k")).select(
        "seq", "week", "label", (F.col("_n") * (1 - F.col("_k")) + F.col("label") * F.col("_k")).alias("score"),
        (F.col("_n") * F.lit(0.5) + F.col("label") * F.lit(0.5)).alias("rival"))


SCORED = EV + """,
 sc0 AS (SELECT event_id AS seq, week, (event_type = 'error')::INT AS label, (user_id % 97) / 97.0::DOUBLE AS n,
                greatest(0.0::DOUBLE, 0.5::DOUBLE - 0.05::DOUBLE * week) AS k FROM ev),
 sc AS (SELECT seq, week, label, n * (1 - k) + label * k AS score, n * 0.5::DOUBLE + label * 0.5::DOUBLE AS rival FROM sc0)"""


def error_events(spark: SparkSession, d: str) -> DataFrame:
    """(stream, week, seq, err): one error stream per event type, wrong more often as windows pass."""
    ev = events(spark, d)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("e"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.lit(0.10) + 0.06 * F.greatest(F.lit(0), F.col("week") - 3)
    return ev.select(F.col("event_type").alias("stream"), "week", F.col("event_id").alias("seq"), (draw < rate).cast("int").alias("err"))


ERR = EV + """,
 er AS (SELECT event_type AS stream, week, event_id AS seq,
   ((('0x' || substr(md5('e' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < 0.10::DOUBLE + 0.06::DOUBLE * greatest(0, week - 3))::INT AS err FROM ev)"""
