"""Alignment of two tables, event-time windows, schema alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

DAY = 86_400


def join_identity(fact: DataFrame, attributes: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left-outer attach of optional attributes; the planner picks broadcast or sort-merge by size."""
    return fact.join(attributes, on, "left")


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two sides share."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("the two sides share no column")
    return left.join(right, shared, "left")


def downcast(df: DataFrame) -> DataFrame:
    """Narrow numeric columns to the smallest type that strictly holds their range, in one pass.

    Spark has no half-precision type, so fractional columns narrow to float only. Values in [-128, 127] and
    so on are compared with strict inequalities, as a value equal to a bound widens the column.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    targets = [(c, t) for c, t in df.dtypes if t in whole or t in ("float", "double")]
    bounds = df.agg(*[f(c).alias(f"{tag}_{c}") for c, _ in targets for tag, f in (("lo", F.min), ("hi", F.max))]).first()
    steps = [("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64)]
    casts = {}
    for c, t in targets:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if lo is None:
            continue
        if t in whole:
            casts[c] = next((n for n, b in steps if lo > -(2 ** (b - 1)) and hi < 2 ** (b - 1) - 1), t)
        else:
            limit = 3.4028234663852886e38
            casts[c] = "float" if lo > -limit and hi < limit else "double"
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def seconds_of(ts: str | Column) -> Column:
    """Microsecond-exact event time in seconds, for any timestamp type."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp")) / F.lit(1_000_000)


def time_bounds(df: DataFrame, ts: str, ref_days: float, window_days: float) -> DataFrame:
    """First and last event time and how many windows follow the reference."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    out = df.agg(F.min(micros).alias("start_us"), F.max(micros).alias("end_us"))
    span = F.col("end_us") - F.col("start_us") - F.lit(int(ref_days * DAY * 1_000_000))
    weeks = F.ceil(span / F.lit(int(window_days * DAY * 1_000_000)))
    return out.withColumn("n_windows", F.greatest(weeks, F.lit(0)).cast("long"))


def assign_week(df: DataFrame, ts: str, ref_days: float, window_days: float, name: str = "week") -> DataFrame:
    """0 for the reference, then 1, 2, ... over the non-empty half-open windows.

    The start and the list of non-empty windows (one number per window) are found first, by one pass over the time
    column; the assignment itself is then a projection, which no later branch of a plan has to repeat as a join. The pass
    keeps the first and the last time of every stretch of a window's width: two windows at most overlap it, and their rows
    hold one of the two.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width, ref = int(window_days * DAY * 1_000_000), int(ref_days * DAY * 1_000_000)
    ends = df.select(micros.alias("t")).filter("t IS NOT NULL").groupBy(F.floor(F.col("t") / F.lit(width))).agg(F.min("t"), F.max("t")).collect()
    if not ends:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = min(r[1] for r in ends) + ref
    since = micros - F.lit(start)
    raw = F.floor(since / F.lit(width)).cast("long")
    found = sorted({(t - start) // width for r in ends for t in r[1:] if t >= start})
    number = F.lit(None).cast("long")
    if found == list(range(len(found))):
        number = raw + 1
    elif found:
        number = F.array_position(F.lit(found), raw)
    return df.withColumn(name, F.when(since < 0, F.lit(0)).otherwise(number).cast("long"))


def cumulative_window(df: DataFrame, week: int, name: str = "week") -> DataFrame:
    """Reference plus everything through ``week``: one filter, which prunes when ``week`` is a partition."""
    return df.filter(F.col(name) <= week)


def recent_window(df: DataFrame, week: int, n: int, name: str = "week") -> DataFrame:
    """The last ``n`` monitored windows ending at ``week``."""
    return df.filter(F.col(name).between(max(1, week - n + 1), week))


def window_counts(df: DataFrame, n: int, name: str = "week") -> DataFrame:
    """(upto, n_cumulative, n_recent) for every monitored week: the sizes of its cumulative and its recent window, from one count per week."""
    weeks = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy().orderBy(name)  # one row per week
    later = F.when(F.col(name) > 0, F.col("_n")).otherwise(0)
    sums = weeks.select(F.col(name).cast("long").alias("upto"), F.sum("_n").over(order).alias("n_cumulative"), F.sum(later).over(order.rangeBetween(1 - n, 0)).alias("n_recent"))
    return sums.filter("upto > 0")


def stack_windows(*frames: DataFrame) -> DataFrame:
    """Vertical union by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def align_schema(df: DataFrame, schema: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric float columns in the frozen order: bad or missing values become 0, extra columns go."""
    have = dict(df.dtypes)

    def cell(name: str) -> Column:
        if name not in have:
            return F.lit(0.0).cast("float")
        source = F.col(name)
        value = source.try_cast("double") if have[name] == "string" else source.cast("double")
        return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0)).cast("float")

    return df.select(*keep, *[cell(c).alias(c) for c in schema])


def to_long(df: DataFrame, keys: Sequence[str], features: Sequence[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (key, feature); NaN and infinite-free doubles, null meaning missing."""
    cols = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features]
    return df.select(*keys, *cols).unpivot(list(keys), list(features), name, value)


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN means missing; turn it into null at the edge of the system."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])
