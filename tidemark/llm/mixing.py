"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. The keys are cut into equal ranges, sums over (source, range) give the prefix sums
of whole ranges, and a running sum within a range places the document. A source's budget is whole epochs of all its
documents plus the first words in key order, so the cut is exact to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.batches import only
from tidemark.plans.checkpoints import stable

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 4_096
MAX_EPOCHS = 3
HEAD = 2 ** 32


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Weights are 1, 2, 3, repeating in code point order, null last. The sources whose share is above ``max_epochs`` times
    their size are those with the smallest size per weight; they get that cap, and the others share the rest by weight.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.select("*", ((F.row_number().over(named) - 1) % 3 + 1).alias("_weight"))
    ratio = Window.orderBy((F.col("source_size") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    earlier = ratio.rowsBetween(Window.unboundedPreceding, -1)
    size, weight = F.col("source_size").cast("double"), F.col("_weight").cast("double")
    free = weighed.select("*", size.alias("_s"), weight.alias("_w")).select(
        "*", F.sum("_s").over(everything).alias("_all"), F.sum("_w").over(everything).alias("_weights"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s_before"), F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)).alias("_w_before"))
    capped = free.select("*", (max_epochs * F.col("_s") * (F.col("_weights") - F.col("_w_before"))
                               <= F.col("_w") * (F.col("_all") - max_epochs * F.col("_s_before"))).alias("_capped"))
    rest = F.col("_all") - max_epochs * F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_s"))).over(everything), F.lit(0.0))
    shared = F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everything)
    target = F.when(F.col("_capped"), max_epochs * F.col("_s")).otherwise(rest / shared * F.col("_w"))
    return capped.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = MAX_EPOCHS,
        range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; null and empty texts have size 0 and take nothing.

    A null source is a source of its own. Repeated rows each count; rows of one id are ordered by size and text hash, and
    rows equal in all of these are interchangeable. An empty table gives no rows. The windows that run over all rows see one
    row per source; those over documents see one (source, key range).
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    sized = stable(only(docs, doc_id=doc_id, text=text, source=source).select(
        "doc_id", "source", words(F.col("text")).alias("size"), digest.alias("_key"), head.alias("_head"), F.xxhash64("text").alias("_tie")))
    ranges = max(1, -(-sized.count() // range_rows))
    sized = sized.select("*", F.floor(F.col("_head") * ranges / F.lit(HEAD)).cast("int").alias("_range"))
    sums = stable(sized.groupBy("source", "_range").agg(F.sum("size").alias("_sum")))
    goals = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), max_epochs)
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_source")
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (sums.select("*", name).select("_source", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
            .join(goals.select(name, "source_size", "target"), "_source"))
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.select("*", name).select("*", F.sum("size").over(inside).alias("_upto")).join(cuts, ["_source", "_range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    start = F.col("_before") + F.col("_upto") - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_budget") - F.col("_epochs") * F.col("source_size") - start))
    return (placed.select("*", budget.cast("long").alias("_budget"), epochs.cast("long").alias("_epochs"))
            .select("doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken")))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS k, hash(text) AS tie FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size::DOUBLE AS s FROM s),
 f AS (SELECT *, sum(s) OVER () AS a, sum(w) OVER () AS ww, coalesce(sum(s) OVER o, 0) AS sb, coalesce(sum(w) OVER o, 0) AS wb FROM w
       WINDOW o AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, 3 * s * (ww - wb) <= w * (a - 3 * sb) AS capped FROM f),
 t AS (SELECT source, source_size, CASE WHEN capped THEN 3 * s ELSE
         (a - 3 * coalesce(sum(CASE WHEN capped THEN s END) OVER (), 0)) / (sum(CASE WHEN NOT capped THEN w END) OVER ()) * w END AS target FROM c),
 p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size, tie ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d),
 j AS (SELECT p.doc_id, p.size, t.source_size, t.target, p.upto, floor(t.target)::BIGINT AS budget,
              CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
       FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, budget - epochs * source_size - (upto - size))))::BIGINT AS taken FROM j
"""
