"""Ordered computations that survive a group holding a third of all rows.

A plain window puts a whole group in one task. Here the order key is first cut into chunks at quantile
edges; each (group, chunk) is scanned on its own, and the totals of the earlier chunks of the group are
added afterwards. The chunk totals are one row per (group, chunk). Small inputs are one chunk and go the same way.
Null order keys form a chunk before the others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.sizing import chunk_count

CHUNK = "_chunk"
NULLS = -1  # the chunk of null order keys


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Puts the columns of a one-row aggregate beside every row."""
    return df.crossJoin(F.broadcast(one))


def with_each(df: DataFrame, small: DataFrame) -> DataFrame:
    """Repeats each row of a result table for every row of ``small`` (weeks or method names: a few dozen rows)."""
    listed = small.agg(F.collect_list(F.struct(*small.columns)).alias("_each"))
    return attach_row(df, listed).withColumn("_each", F.explode("_each")).select(*df.columns, "_each.*")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` where null equals null; the key columns of ``left`` are kept."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    if not keys:  # one group: the right side is a single row
        return attach_row(left, renamed)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def with_reference(stats: DataFrame, by: Sequence[str], week: str, cols: dict[str, str]) -> DataFrame:
    """Puts the week-0 values of ``cols`` (column -> new name) beside every later week.

    For tables of one row per (group, week): a window over the group's weeks, so the statistics under it are computed
    once, where a self join would compute them twice.
    """
    ref = F.max(F.when(F.col(week) == 0, F.struct(*cols))).over(Window.partitionBy(*by))
    out = stats.withColumn("_ref", ref).filter(F.col(week) > 0)
    return out.select("*", *[F.col(f"_ref.{c}").alias(n) for c, n in cols.items()]).drop("_ref")


class Chunked:
    """Rows with a ``_chunk`` column that is a monotone function of the order key."""

    def __init__(self, df: DataFrame, heavy: Sequence[float] = ()):
        self.df = df
        self.heavy = tuple(heavy)  # keys that alone fill more than one chunk

    def with_df(self, df: DataFrame) -> "Chunked":
        return Chunked(df, self.heavy)


def chunk_by_value(df: DataFrame, key: str, chunks: int | None = None, source: DataFrame | None = None) -> Chunked:
    """Cut at approximate quantiles of the numeric column ``key``; equal keys share a chunk.

    ``source`` is where the quantiles are read when ``df`` is an aggregate of it: a scan of one column instead of the
    whole aggregation.

    The edges are computed once and then are constants of the plan, so every branch and every retried task
    sees the same chunks. Their accuracy only affects balance, never results.
    """
    count = chunk_count(df) if chunks is None else chunks
    place, heavy = F.lit(0), []
    if count > 1:
        column = (df if source is None else source).select(F.col(key).cast("double").alias("v"))
        found = column.approxQuantile("v", [i / count for i in range(1, count)], 1.0 / (4 * count))
        edges = sorted(set(found))
        heavy = [v for v, times in Counter(found).items() if times > 1]
        if edges:
            splits = [float("-inf"), *edges, float("inf")]
            keyed = df.withColumn("_order_key", F.col(key).cast("double"))
            df = Bucketizer(splits=splits, inputCol="_order_key", outputCol="_bucket", handleInvalid="keep").transform(keyed).drop("_order_key")
            place = F.col("_bucket").cast("int")
    cut = df.withColumn(CHUNK, F.when(F.col(key).isNull(), NULLS).otherwise(F.coalesce(place, F.lit(0))))
    return Chunked(cut.drop("_bucket"), heavy)


def chunk_by_hash(df: DataFrame, digest: str, chunks: int | None = None) -> Chunked:
    """Cut by the leading hex digits of a digest column: evenly filled chunks without looking at the data."""
    count = chunk_count(df) if chunks is None else chunks
    head = F.conv(F.substring(F.col(digest), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
    return Chunked(df.withColumn(CHUNK, F.floor(head * F.lit(count)).cast("int") if count > 1 else F.lit(0)))


EDGE_ROWS = 200  # sampled per chunk to find edges


def chunk_by_pair(df: DataFrame, first: str, second: str, chunks: int | None = None) -> Chunked:
    """Cut at sampled pairs of the numeric column ``first`` and of ``second``, so one value of ``first`` may fill several chunks.

    The sample, ``EDGE_ROWS`` pairs a chunk, only affects balance; its edges are constants of the plan. Null ``first`` is the chunk
    before the others.
    """
    count = chunk_count(df) if chunks is None else chunks
    place = F.lit(0)
    if count > 1:
        pairs = df.select(F.col(first).cast("double").alias("a"), F.col(second).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        n = pairs.count()
        found = sorted(tuple(r) for r in pairs.sample(min(1.0, 2.0 * EDGE_ROWS * count / max(n, 1)), 7).limit(4 * EDGE_ROWS * count).collect())
        edges = sorted({found[i * len(found) // count] for i in range(1, count)}) if found else []
        if edges:
            seconds: dict[float, list] = {}
            for a, b in edges:
                seconds.setdefault(a, []).append(b)
            values = sorted(seconds)
            before = [0, *accumulate(len(seconds[a]) for a in values)]
            key = F.col(first).cast("double")
            # The number of edge values below or equal, and among edges that share the row's value those with a smaller or equal partner.
            at = F.size(F.filter(F.array(*[F.lit(a) for a in values]), lambda v: v <= key))
            partner = F.try_element_at(F.array(*[F.array(*[F.lit(b) for b in seconds[a]]) for a in values]), at)
            level = F.try_element_at(F.array(*[F.lit(a) for a in values]), at) == key
            tied = F.when(level, F.size(F.filter(partner, lambda b: b <= F.col(second))) - F.size(partner)).otherwise(0)
            place = F.when(at == 0, 0).otherwise(F.get(F.array(*[F.lit(b) for b in before]), at) + F.coalesce(tied, F.lit(0)))
    return Chunked(df.withColumn(CHUNK, F.when(F.col(first).isNull(), NULLS).otherwise(place.cast("int"))))


KEY = "_key_"


def _join_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Non-null stand-ins for nullable group columns.

    The scan's window and the join with the chunk totals then hash the same plain columns, so the rows are
    shuffled once; a null-safe join would hash other expressions and shuffle them again.
    """
    names = []
    for c in by:
        if not df.schema[c].nullable:
            names.append(c)
            continue
        names.append(KEY + c)
        if KEY + c not in df.columns:
            df = df.withColumn(KEY + c, F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")))
    return df, names


def plain(df: DataFrame) -> DataFrame:
    """Without the columns that ordered scans add for themselves."""
    return df.drop(*[c for c in df.columns if c == CHUNK or c.startswith(KEY)])


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "min":
        return F.least(carried, local)
    return F.greatest(carried, local)


@dataclass(frozen=True)
class Pass:
    """One ordered scan: running ``aggs`` within ``by`` in ``order``.

    ``aggs`` maps an output name to (``sum`` | ``count`` | ``min`` | ``max``, column). With ``ties`` the frame is by
    value, so rows with an equal single order column share one result; such rows share a chunk. ``totals`` adds
    ``<name>_total``, the aggregate of the whole group. A running sum over no non-null value is 0.
    """

    by: Sequence[str]
    order: Sequence[str | Column]
    aggs: dict[str, tuple[str, Column]]
    ties: bool = False
    totals: bool = False


CALLS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
MERGE_OVER = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _frame(p: Pass, keys: Sequence[str]):
    window = Window.partitionBy(*keys, CHUNK).orderBy(*p.order)
    return (window.rangeBetween if p.ties else window.rowsBetween)(Window.unboundedPreceding, Window.currentRow)


def running_all(data: Chunked, passes: Sequence[Pass]) -> Chunked:
    """Several inclusive running scans over the same rows.

    The chunk totals of every pass come straight from the input, so no pass repeats the windows of another.
    """
    base, keys = data.df, []
    for p in passes:
        base, names = _join_keys(base, p.by)
        keys.append(names)
    out = base
    for p, names in zip(passes, keys):
        window = _frame(p, names)
        out = out.select("*", *[CALLS[kind](col).over(window).alias(f"_l_{n}") for n, (kind, col) in p.aggs.items()])
    for p, names in zip(passes, keys):
        whole = Window.partitionBy(*names)
        before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        ends = [MERGE_OVER[kind](f"_t_{n}").over(whole).alias(f"{n}_total") for n, (kind, _) in p.aggs.items()] if p.totals else []
        parts = (base.groupBy(*names, CHUNK).agg(*[CALLS[kind](col).alias(f"_t_{n}") for n, (kind, col) in p.aggs.items()])
                 .select(*names, CHUNK, *ends, *[MERGE_OVER[kind](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (kind, _) in p.aggs.items()]))
        out = out.join(parts, [*names, CHUNK], "left")
    cells = [c for p in passes for n, (kind, _) in p.aggs.items() for c in
             [_merge(kind, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n), *([F.col(f"{n}_total")] if p.totals else [])]]
    return data.with_df(out.select(*base.columns, *cells))


def running(data: Chunked, by: Sequence[str], order: Sequence[str | Column], aggs: dict[str, tuple[str, Column]],
            ties: bool = False, totals: bool = False) -> Chunked:
    """One ordered scan; see ``Pass``."""
    return running_all(data, [Pass(list(by), order, aggs, ties, totals)])


def previous(data: Chunked, by: Sequence[str], order: Sequence[str | Column], cols: dict[str, str]) -> Chunked:
    """The value of ``cols[name]`` on the preceding row of the group (null on the first row)."""
    by = list(by)
    base, keys = _join_keys(data.df, by)
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    out = base.select("*", *[F.lag(c).over(window).alias(n) for n, c in cols.items()])
    last = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    tail = (base.groupBy(*keys, CHUNK)
            .agg(*[F.max_by(F.struct(F.col(c).alias("v")), last).alias(f"_t_{n}") for n, c in cols.items()]))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK)
    tail = tail.select(*keys, CHUNK, *[F.lag(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in cols])
    joined = out.withColumn("_row", F.row_number().over(window)).join(tail, [*keys, CHUNK], "left")
    return data.with_df(joined.select(*base.columns, *[
        F.when(F.col("_row") == 1, F.col(f"_c_{n}.v")).otherwise(F.col(n)).alias(n) for n in cols]))


def followed(data: Chunked, by: Sequence[str], order: Sequence[str], lags: dict[str, str], index: str) -> Chunked:
    """The value of ``lags[name]`` on the preceding row of the group, and the 1-based position ``index``, in one scan.

    What a chunk hands on, its last row and its size, is one short row per (group, chunk), counted in the map tasks. The scan and the
    join with it share one partitioning, so the rows are shuffled once.
    """
    base, keys = _join_keys(data.df, by)
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    out = base.select("*", *[F.lag(c).over(window).alias(n) for n, c in lags.items()], F.row_number().over(window).alias("_row"))
    tail = base.groupBy(*keys, CHUNK).agg(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in lags.items()]), F.struct(*order)).alias("_end"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK)
    tail = tail.select(*keys, CHUNK, F.lag("_end").over(earlier).alias("_carry"), F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = out.join(tail, [*keys, CHUNK], "left")
    return data.with_df(joined.select(*base.columns, *[F.when(F.col("_row") == 1, F.col(f"_carry.{n}")).otherwise(F.col(n)).alias(n) for n in lags],
                                      (F.col("_row") + F.col("_before")).alias(index)))


def row_index(data: Chunked, by: Sequence[str], order: Sequence[str | Column], name: str) -> Chunked:
    """1-based position within ``by``."""
    return running(data, by, order, {name: ("count", F.lit(1))})


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
              name: str = "edges", chunks: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as one array column.

    Values are counted before they are ordered, so a group is never gathered: only the rows at the wanted
    positions reach the final aggregate (two per probability).
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    data = chunk_by_value(counts, value, chunks, df)
    placed = running(data, by, [value], {"_upto": ("sum", F.col("_n"))}, totals=True).df
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_upto_total") - 1)).alias("h"))
                       for i, p in enumerate(probs)])
    first, end = F.col("_upto") - F.col("_n"), F.col("_upto")
    hits = F.filter(wanted, lambda w: (F.ceil(w["h"]) >= first) & (F.floor(w["h"]) < end))
    points = placed.withColumn("_w", F.explode(hits))
    low = (F.floor("_w.h") >= first) & (F.floor("_w.h") < end)
    high = (F.ceil("_w.h") >= first) & (F.ceil("_w.h") < end)
    pairs = points.groupBy(*by, F.col("_w.i").alias("_i"), F.col("_w.h").alias("_h")).agg(
        F.max(F.when(low, F.col(value))).alias("_lo"), F.max(F.when(high, F.col(value))).alias("_hi"))
    cell = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
    return (pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", cell.alias("q")))).alias("_cells"))
            .select(*by, F.transform("_cells", lambda c: c["q"]).alias(name)))
