"""Sampling and splitting by the rank of a seeded hash: reproducible in any engine and partitioning.

Where only the first so many ranks are wanted, the digest at that position is found by counting and the rows are compared
with it; nothing is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.checkpoints import stable
from tidemark.plans.ordered import Chunked, chunk_by_hash, chunk_by_pair, null_safe_join, plain, row_index


def digest(key: str | Sequence[str | Column], seed: int) -> Column:
    """md5 of the key fields and the seed joined by ':'."""
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed))))


HEAD = 15  # leading hex digits of a digest that a whole number holds


def digest_head(key: str | Sequence[str | Column], seed: int) -> Column:
    """The first ``HEAD`` digits of the digest as a number, in the same order; stored once, it spares later passes the digests."""
    return F.conv(F.substring(digest(key, seed), 1, HEAD), 16, 10).cast("long")


def uniform(key: Column, *salt: object) -> Column:
    """A hash-derived number in [0, 1) from the first 52 bits of an md5."""
    text = F.concat_ws(":", key.cast("string"), *[s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salt])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def _ranked(df: DataFrame, key: str | Sequence[str], seed: int, by: Sequence[str], chunks: int | None) -> Chunked:
    keys = [key] if isinstance(key, str) else list(key)
    data = chunk_by_hash(df.withColumn("_digest", digest(keys, seed)), "_digest", chunks)
    return row_index(data, by, ["_digest", *keys], "_rank")


def hash_rank(df: DataFrame, key: str | Sequence[str], seed: int, by: Sequence[str] = (),
              name: str = "rank", chunks: int | None = None) -> DataFrame:
    """1-based rank of each row's digest within ``by``."""
    return plain(_ranked(df, key, seed, by, chunks).df.withColumnRenamed("_rank", name).drop("_digest"))


HEX = 3  # digits of a digest that a round of counting refines by
BOUNDARY = 65_536  # distinct keys of a group that may share the last counted cell
MOST_HEX = HEAD


def digest_cuts(df: DataFrame, key: str | Sequence[str], seed: int, by: Sequence[str], wanted: Column, head: str | None = None) -> DataFrame:
    """(by, _total, _cut): per group the ``wanted``-th smallest (digest, key), null where none is wanted.

    ``wanted`` is an expression over ``_total``, the group's size. Rows are counted by the leading digits of their digest, the
    cell that holds the wanted position is refined by more digits until few keys share it, and only those are ordered. So
    what is shuffled is counts, at most 4096 a group and round. A key that many rows repeat is one cut. ``head`` names a column that
    holds ``digest_head`` of the same key and seed; whole digests are then made for the last few rows only.
    """
    keys, by = [key] if isinstance(key, str) else list(key), list(by)
    rows = df.select(*by, (digest(keys, seed) if head is None else F.col(head)).alias("_digest"), F.struct(*keys).alias("_key"))

    def leading(size: int) -> Column:
        return F.substring("_digest", 1, size) if head is None else F.lower(F.lpad(F.hex(F.shiftright("_digest", 4 * (HEAD - size))), size, "0"))
    running = Window.partitionBy(*by).orderBy("_cell")
    hit = (F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want"))
    cell = F.max(F.when(hit, F.struct("_cell", (F.col("_upto") - F.col("_n")).alias("below"), "_n")))
    counts = rows.groupBy(*by, leading(HEX).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.select("*", F.sum("_n").over(running).alias("_upto"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    known = placed.withColumn("_want", F.least(wanted, F.col("_total")).cast("long")).groupBy(*by).agg(F.max("_total").alias("_total"), F.max("_want").alias("_want"), cell.alias("_hit"))
    known, size = stable(known), HEX
    while size < MOST_HEX and (known.agg(F.max("_hit._n")).first()[0] or 0) > BOUNDARY:
        inside = null_safe_join(rows, known, by).filter(F.col("_hit").isNotNull() & (leading(size) == F.col("_hit._cell")))
        size += HEX
        counts = inside.groupBy(*by, leading(size).alias("_cell"), "_total", "_want", F.col("_hit.below").alias("_below")).agg(F.count(F.lit(1)).alias("_n"))
        placed = counts.withColumn("_upto", F.col("_below") + F.sum("_n").over(running))
        finer = placed.groupBy(*by).agg(cell.alias("_finer"))
        known = stable(null_safe_join(known, finer, by, "left").select(*by, "_total", "_want", F.col("_finer").alias("_hit")))
    last = null_safe_join(rows, known, by).filter(F.col("_hit").isNotNull() & (leading(size) == F.col("_hit._cell")))
    whole = F.col("_digest") if head is None else digest([F.col(f"_key.{k}") for k in keys], seed)
    last = last.select("*", F.struct(whole.alias("_digest"), "_key").alias("_at"))
    few = last.groupBy(*by, "_at", "_want", F.col("_hit.below").alias("_below")).agg(F.count(F.lit(1)).alias("_n"))
    few = few.withColumn("_upto", F.col("_below") + F.sum("_n").over(Window.partitionBy(*by).orderBy("_at")))
    cuts = few.filter(F.col("_upto") >= F.col("_want")).groupBy(*by).agg(F.min("_at").alias("_cut"))
    return stable(null_safe_join(known.select(*by, "_total"), cuts, by, "left"))


def _within(df: DataFrame, key: str | Sequence[str], seed: int, by: Sequence[str], wanted: Column, head: str | None = None) -> DataFrame:
    """``df`` with ``_in``: whether the row's digest is among the ``wanted`` smallest of its group. The rows are not shuffled
    where the cuts, a row a group, are small enough to be broadcast."""
    keys = [key] if isinstance(key, str) else list(key)
    at = F.struct(digest(keys, seed).alias("_digest"), F.struct(*keys).alias("_key"))
    cuts, inside = digest_cuts(df, keys, seed, by, wanted, head), at <= F.col("_cut")
    if head is not None:
        cuts = cuts.withColumn("_head", F.conv(F.substring("_cut._digest", 1, HEAD), 16, 10).cast("long"))
        inside = (F.col(head) < F.col("_head")) | (F.col(head) == F.col("_head")) & inside
    marked = null_safe_join(df, cuts, list(by), "left")
    return marked.withColumn("_in", F.coalesce(inside, F.lit(False))).drop("_cut", "_total", "_head")


def bounded_sample(df: DataFrame, n: int, key: str | Sequence[str], seed: int, by: Sequence[str] = (), head: str | None = None) -> DataFrame:
    """``n`` rows per group without replacement (all rows when the group is smaller). ``key`` names a row; see ``digest_cuts`` for ``head``."""
    return _within(df, key, seed, by, F.lit(n), head).filter("_in").drop("_in")


def even_classes(df: DataFrame, label: str, key: str | Sequence[str], seed: int, head: str | None = None) -> DataFrame:
    """As many rows of label 1 as of label 0, by smallest digests; all rows when one of them has none. No row is moved."""
    n = df.agg(F.least(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0))).first()[0]
    return _within(df, key, seed, [label], F.lit(n), head).filter("_in").drop("_in") if n else df


def null_split(df: DataFrame, fraction: float, key: str | Sequence[str], seed: int, by: Sequence[str] = (), floor: int = 50) -> DataFrame:
    """Random two-way split: ``part`` is 'small' for max(int(n * fraction), floor) rows, else 'big'."""
    cut = F.greatest(F.floor(F.col("_total") * F.lit(fraction)), F.lit(floor))
    return _within(df, key, seed, by, cut).withColumn("part", F.when(F.col("_in"), "small").otherwise("big")).drop("_in")


def shuffle_split(df: DataFrame, fraction: float, key: str | Sequence[str], seed: int) -> DataFrame:
    """Train/eval by shuffled position: the first int(n * fraction) ranks train."""
    return _within(df, key, seed, (), F.floor(F.col("_total") * F.lit(fraction))).withColumn("split", F.when(F.col("_in"), "train").otherwise("eval")).drop("_in")


def stratified_folds(df: DataFrame, label: str, k: int, key: str | Sequence[str], seed: int,
                     chunks: int | None = None) -> DataFrame:
    """Fold 0..k-1 with every label spread evenly."""
    ranked = plain(_ranked(df, key, seed, [label], chunks).df)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_digest")


AROUND = 0.002  # share of the rows beside the wanted position that is ordered first


def order_cut(df: DataFrame, order: str, key: str, fraction: float, chunks: int | None = None) -> tuple[float, object] | None:
    """The int(n * fraction)-th smallest (order, key), null orders before all others; None where that is before the first row.

    Approximate quantiles give two values around the position; only rows between them are ordered, all of them where the position
    turns out to be outside.
    """
    at = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    narrow = df.select(at.alias("_o"), F.col(key).alias("_k"))
    near = F.percentile_approx("_o", F.array(*[F.lit(min(1.0, max(0.0, fraction + d))) for d in (-AROUND, AROUND)]), 10_000)
    n, ends = narrow.agg(F.count(F.lit(1)), near).first()
    wanted = int(n * fraction)
    if wanted < 1:
        return None
    low, high = ends
    below, upto = narrow.agg(F.count_if(F.col("_o") < low), F.count_if(F.col("_o") <= high)).first()
    if below < wanted <= upto:
        narrow = narrow.filter(F.col("_o").between(low, high))
    else:
        below = 0
    data = row_index(chunk_by_pair(narrow, "_o", "_k", chunks), [], ["_o", "_k"], "_pos")
    return tuple(data.df.filter(F.col("_pos") == wanted - below).select("_o", "_k").first())


def temporal_split(df: DataFrame, order: str, key: str, label: str, fraction: float = 0.8,
                   seed: int = 42, chunks: int | None = None) -> DataFrame:
    """The first int(n * fraction) rows by (order, key) train, the rest validate.

    When either side has a single label the split falls back to a stratified hash split with the same share, which is only
    worked out then. ``order`` must be numeric; either way the split is a comparison with a cut, no row is moved.
    """
    cut = order_cut(df, order, key, fraction, chunks)
    if cut is not None:
        at = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
        late = F.coalesce((at > cut[0]) | ((at == cut[0]) & (F.col(key) > F.lit(cut[1]))), F.lit(False))
        sides = [f(F.when(side, F.col(label))) for side in (~late, late) for f in (F.min, F.max)]
        a, b, c, d = df.agg(*sides).first()
        if a is not None and c is not None and a != b and c != d:
            return df.withColumn("is_valid", late)
    return _within(df, key, seed, [label], F.floor(F.col("_total") * F.lit(fraction))).withColumn("is_valid", ~F.col("_in")).drop("_in")


def bootstrap_bags(df: DataFrame, n_bags: int, key: str, seed: int) -> DataFrame:
    """One Poisson(1) weight column per bag (``bag_0`` ...): a bootstrap without copying a row.

    The weight of a row is the inverse Poisson CDF at a hash-derived uniform, so it does not depend on
    partitioning.
    """
    return df.select("*", *[poisson_weight(F.col(key), b, seed).alias(f"bag_{b}") for b in range(n_bags)])


def poisson_cdf() -> tuple[float, ...]:
    """Poisson(1) probabilities of at most 0, 1, ... copies, up to the last that a double tells from 1."""
    out, term, k = [], exp(-1.0), 0
    total = term
    while 1.0 - total >= 2.0 ** -53:
        out.append(total)
        k += 1
        term /= k
        total += term
    return tuple(out)


POISSON_CDF = poisson_cdf()


def poisson_weight(key: Column, bag: int | Column, seed: int) -> Column:
    u = uniform(key, "bag", bag, seed)
    cdf = F.array(*[F.lit(c) for c in POISSON_CDF])
    return F.size(F.filter(cdf, lambda c: c <= u))
