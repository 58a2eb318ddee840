"""The streaming forms over the given tables: all files of a table at once, against the batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import distribution as D, encoders as E
from tidemark.plans.checkpoints import new_folder
from tidemark.sources.tables import BucketedTable, load
from tidemark.streaming import monitors as W
from tidemark.workload.base import ERR, SQL, error_events, query
from tidemark.workload.encoder_queries import transactions
from tidemark.workload.listing_queries import now, scored, stored
from tidemark.workload.stream_queries import DDM, EDDM, HDDM, raw_flags


def as_stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of ``df`` as files in the shared folder, read as a stream."""
    folder = new_folder(spark)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def drained(stream: DataFrame) -> DataFrame:
    """What the stream gives until its source is empty."""
    folder = new_folder(stream.sparkSession)
    running = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
               .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_confirm", SQL["confirm_with_reset"])
def _(spark, d):
    return drained(W.stream_confirm(as_stream(spark, raw_flags(spark, d).withColumn("week", F.col("week").cast("long"))), 2, 2))


def _alarms(with_sql: str, rows: str, detector: str) -> str:
    return with_sql + f" SELECT stream AS method, seq, '{detector}' AS detector FROM {rows} WHERE drift"


def detections(spark, d):
    errors = error_events(spark, d).select(F.col("stream").alias("method"), F.lit(0).cast("long").alias("version"), F.col("seq").cast("long").alias("seq"), "err")
    return drained(W.stream_detectors(as_stream(spark, errors)))


@query("stream_ddm", _alarms(DDM, "d6", "ddm"))
def _(spark, d):
    return detections(spark, d).filter("detector = 'ddm' AND drift").select("method", "seq", "detector")


ALL_THREE = DDM + "," + ",".join(x.removeprefix(f"WITH {ERR},") for x in (EDDM, HDDM)) + """
SELECT stream AS method, seq, 'ddm' AS detector, drift, warning FROM d6 WHERE drift OR warning
UNION ALL SELECT stream, seq, 'eddm', drift, warning FROM e6 WHERE drift OR warning
UNION ALL SELECT stream, seq, 'hddm', drift, w AND NOT drift FROM h6 WHERE drift OR w"""


@query("stream_detectors", ALL_THREE)
def _(spark, d):
    """All warnings and alarms of the three detectors."""
    return detections(spark, d).select("method", "seq", "detector", "drift", "warning")


@query("stream_encode", SQL["frequency_encode"])
def _(spark, d):
    t = transactions(spark, d).select("id", "week", "t", "c2", "email")
    ref = t.filter("week = 0")
    live = as_stream(spark, t.filter("week > 0").select("id", "c2", "email"))
    out = drained(W.stream_encode(live, E.fit_frequency(ref, ["c2", "email"]), ["c2", "email"], E.fit_ordinal(ref, ["email"], "t", "id"), ["email"]))
    return out.select("id", *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in ("_freq_ref_c2", "_freq_ref_email")])


@query("stream_upsert", SQL["upsert_matches"])
def _(spark, d):
    table = BucketedTable(spark, new_folder(spark))
    first = stored(spark, d)
    table.write(first, ["match_score"])
    W.stream_upsert(as_stream(spark, scored(spark, d)), table, first.schema, now, "pid", new_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return table.read()


WEEK_S = 2 * 86_400


@query("stream_weekly_counts", f"""
WITH b AS (SELECT min(epoch_us(ts)) // 1000000 + 14 * 86400 AS cutoff, max(epoch_us(ts)) AS last FROM events),
 w AS (SELECT (epoch_us(ts) - cutoff * 1000000) // ({WEEK_S} * 1000000::BIGINT) AS k, value, cutoff, last FROM events, b WHERE epoch_us(ts) >= cutoff * 1000000)
SELECT (k + 1)::BIGINT AS week, count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, count(value) AS binned FROM w
GROUP BY k, cutoff, last HAVING (cutoff + (k + 1) * {WEEK_S} + 86400) * 1000000::BIGINT <= last""")
def _(spark, d):
    """Windows that the watermark has closed, in the weeks of the batch form."""
    ev = load(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("value").alias("feature"), "value")
    cutoff = ev.agg(F.unix_timestamp(F.min("ts"))).first()[0] + 14 * 86_400
    late = ev.filter(F.col("ts") >= F.timestamp_seconds(F.lit(cutoff)))
    edges = D.reference_edges(ev.filter(F.col("ts") < F.timestamp_seconds(F.lit(cutoff))).withColumn("week", F.lit(0)))
    out = drained(W.weekly_bin_counts(as_stream(spark, late), edges, window=f"{WEEK_S} seconds", cutoff=cutoff % WEEK_S))
    week = ((F.unix_timestamp("start") - cutoff) / WEEK_S + 1).cast("long").alias("week")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(week, "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), total.alias("binned"))
