"""Feature encoders that are fitted once on a reference window and replayed unchanged.

Learned state is a set of small tables (value -> code, value -> frequency, group -> aggregate). Replay joins them;
a table is broadcast only when its size is known to be under the limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.plans.checkpoints import stable
from tidemark.plans.ordered import attach_row, chunk_by_pair, chunk_by_value, followed, null_safe_join, plain, row_index

UNSEEN, MISSING = -1, -2
NULL_TOKEN = "nan"  # fixed token for a missing key part


def _text(col: str | Column) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(NULL_TOKEN))


def combine_keys(a: str | Column, b: str | Column) -> Column:
    """a__b with a fixed token for missing parts."""
    return F.concat_ws("__", _text(a), _text(b))


def entity_keys(df: DataFrame, seconds: str = "TransactionDT", since: str = "D1", email: str = "P_emaildomain",
                card: str = "card1", addr: str = "addr1") -> DataFrame:
    """``_uid1`` = (day - since)__email and ``_uid2`` = card__addr__uid1."""
    day = F.floor(F.col(seconds) / 86400)
    return (df.withColumn("_uid1", F.concat_ws("__", _text(day - F.col(since)), _text(email)))
            .withColumn("_uid2", F.concat_ws("__", _text(card), _text(addr), F.col("_uid1"))))


def sequence_features(df: DataFrame, entity: str, order: str, key: str, amount: str,
                      names: tuple[str, str, str] = ("lag_seconds", "abs_pct_change", "sequence_index"),
                      chunks: int | None = None) -> DataFrame:
    """Causal features over the full history: time since the entity's previous row, relative amount change,
    0-based position. ``order`` is numeric seconds; equal times are ordered by ``key``.

    An entity holding a large share of the rows is scanned in chunks of (order, key), so one time may fill several.
    """
    data = followed(chunk_by_pair(df, order, key, chunks), [entity], [order, key], {"_pt": order, "_pa": amount}, "_pos")
    change = F.abs(F.try_divide(F.col(amount), F.col("_pa")) - 1)
    return plain(data.df.withColumn(names[0], F.col(order) - F.col("_pt")).withColumn(names[1], change)
            .withColumn(names[2], F.col("_pos") - 1).drop("_pt", "_pa", "_pos"))


def log_distance(first: str, second: str) -> Column:
    return F.log1p(F.coalesce(F.col(first), F.col(second)))


def date_parts(df: DataFrame, seconds: str, start: str = "2017-11-30") -> DataFrame:
    """Offset seconds -> day index, hour, weekday_hour (Monday is 0)."""
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(f"{start} 00:00:00")) + F.col(seconds))
    return (df.withColumn("_days", F.floor(F.col(seconds) / 86400)).withColumn("_hour", F.hour(ts))
            .withColumn("_weekday__hour", F.concat_ws("_", F.weekday(ts).cast("string"), F.hour(ts).cast("string"))))


def cyclic_encode(df: DataFrame, col: str, period: float, drop: bool = True) -> DataFrame:
    """cos/sin at a frozen period. A period of 23 puts 23:00 on 00:00; 24 keeps them apart."""
    angle = F.lit(2 * math.pi) * F.col(col) / F.lit(float(period))
    out = df.withColumn(f"{col}_cos", F.cos(angle)).withColumn(f"{col}_sin", F.sin(angle))
    return out.drop(col) if drop else out


def fit_period(df: DataFrame, col: str) -> float:
    """The largest value of the reference (1 when it is not positive)."""
    top = df.agg(F.max(col)).first()[0]
    return float(top) if top and top > 0 else 1.0


def amount_fraction(amount: str) -> Column:
    """Thousandths of the amount, truncated."""
    whole = F.col(amount).cast("long")
    return ((F.col(amount) - whole) * 1000).cast("int")


def decimal_length(amount: str) -> Column:
    """Digits after the point of the plain decimal form (a whole number has one, ".0")."""
    tail = F.regexp_extract(F.col(amount).cast("decimal(38,12)").cast("string"), r"\.(\d*?)0*$", 1)
    return F.when(F.col(amount).isNull(), 0).otherwise(F.greatest(F.lit(1), F.length(tail)))


def log_amount(amount: str) -> Column:
    return F.log1p(F.greatest(F.col(amount), F.lit(0.0)))


def fit_group_aggregates(df: DataFrame, key: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """max / mean / sample variance of ``col`` per key, and over everything in the row with a null ``_group``."""
    aggs = [F.max(col).cast("double").alias("max"), F.avg(col).alias("mean"), F.var_samp(col).alias("var")]
    groups = df.filter(F.col(key).isNotNull()).groupBy(*by, F.col(key).alias("_group")).agg(*aggs)
    # The overall row keeps a null group. Variance of a single row is null, as for a group.
    overall = df.groupBy(*by).agg(*aggs).withColumn("_group", F.lit(None).cast(dict(df.dtypes)[key]))
    return groups.unionByName(overall)


def group_aggregate_encode(df: DataFrame, state: DataFrame, key: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Learned aggregates by key; a missing group or missing value takes the overall one (else 0)."""
    names = {a: f"_{a}_{col}_{key}" for a in ("max", "mean", "var")}
    known = state.filter(F.col("_group").isNotNull()).select(*by, F.col("_group").alias(key), *[F.col(a).alias(f"_k_{a}") for a in names])
    overall = state.filter(F.col("_group").isNull()).select(*by, *[F.col(a).alias(f"_o_{a}") for a in names])
    both = null_safe_join(df, known, [*by, key], "left")
    both = null_safe_join(both, F.broadcast(overall), list(by), "left") if by else attach_row(both, overall)
    out = both.select(*df.columns, *[F.coalesce(f"_k_{a}", f"_o_{a}", F.lit(0.0)).alias(n) for a, n in names.items()])
    return out


def fit_frequency(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(column, value, freq): share of rows, nulls counted as a value. Counts are combined before the shuffle."""
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    long = df.select(*by, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(list(by), list(cols), "column", "value")
    counts = long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("_c"))
    return null_safe_join(counts, F.broadcast(total), list(by)).select(*by, "column", "value", (F.col("_c") / F.col("_n")).alias("freq"))


SIDE_ROWS = 100_000  # of a column's state that is sent to every task; a larger one goes by a join on its values


def _sides(state: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """The state of each column, marked for broadcast where its counted rows are few; so columns with few values move no rows, however many they are."""
    sizes = {r["column"]: r["count"] for r in state.groupBy("column").count().collect()}
    own = {c: state.filter(F.col("column") == c) for c in cols}
    return {c: F.broadcast(side) if sizes.get(c, 0) <= SIDE_ROWS else side for c, side in own.items()}


def frequency_encode(df: DataFrame, state: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``_freq_ref_<col>``; an unseen value is 0."""
    state, out = stable(state), df
    for c, side in _sides(state, cols).items():
        side = side.select(*by, F.col("value").alias("_v"), F.col("freq").alias(f"_freq_ref_{c}"))
        keyed = out.withColumn("_v", F.col(c).cast("string"))
        out = null_safe_join(keyed, side, [*by, "_v"], "left").drop("_v")
        out = out.withColumn(f"_freq_ref_{c}", F.coalesce(f"_freq_ref_{c}", F.lit(0.0)).cast("float"))
    return out


def fit_known_groups(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def unseen_flag(df: DataFrame, known: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """1 when the key was absent from the reference."""
    name = name or f"_unseen_{key}"
    marked = known.select(key).withColumn("_seen", F.lit(True))
    out = null_safe_join(df, marked, [key], "left")
    return out.withColumn(name, F.col("_seen").isNull().cast("int")).drop("_seen")


def row_null_count(cols: Sequence[str]) -> Column:
    """Missing fields over a fixed list of columns."""
    return sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))


def counter_summary(df: DataFrame, cols: Sequence[str], prefix: str = "_ccols", drop: bool = True) -> DataFrame:
    """Non-zero count, sum and zero-pattern bits ('1' for a zero) of the counter block."""
    nonzero = sum((F.coalesce((F.col(c) != 0).cast("int"), F.lit(0)) for c in cols), F.lit(0))
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    bits = F.concat(*[F.when(F.col(c) == 0, "1").otherwise("0") for c in cols])
    out = df.withColumn(f"{prefix}_nonzero", nonzero).withColumn(f"{prefix}_sum", total.cast("float")).withColumn(f"{prefix}_0_bin", bits)
    return out.drop(*cols) if drop else out


def null_bits(cols: Sequence[str]) -> Column:
    """'1' for each missing column."""
    return F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])


def timedelta_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count and null bits of the timedelta block; nulls become 0, values are left as they are."""
    out = df.withColumn("_dcol_na", row_null_count(cols)).withColumn("_dcols_na_bin", null_bits(cols))
    return out.fillna(0, list(cols))


def match_flag_pattern(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumn("_mcols_na_bin", null_bits(cols))


@dataclass
class BlockProjection:
    """A frozen rotation of a wide block: one row of numbers per column of the schema."""

    cols: list[str]
    low: list[float]
    span: list[float]
    centre: list[float]
    loadings: list[list[float]]
    sum_cols: list[str]
    explained: list[float]


# Columns of the wide block left out of its plain sum; fixed values.
NOT_SUMMED = ("V144", "V145", "V150", "V151", "V159", "V160", "V307")


def fit_block_pca(df: DataFrame, cols: Sequence[str], k: int = 2) -> BlockProjection:
    """Min-max scaling and a centred PCA on the reference; missing is -1; the largest loading is positive."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in cols])
    stats = filled.agg(*[f(c).alias(f"{t}_{i}") for i, c in enumerate(cols) for t, f in (("lo", F.min), ("hi", F.max), ("mu", F.avg))]).first()
    low = [stats[f"lo_{i}"] for i in range(len(cols))]
    span = [(stats[f"hi_{i}"] - low[i]) or 1.0 for i in range(len(cols))]
    centre = [(stats[f"mu_{i}"] - low[i]) / span[i] for i in range(len(cols))]
    scaled = filled.select(*[((F.col(c) - low[i]) / span[i] - centre[i]).alias(c) for i, c in enumerate(cols)])
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(VectorAssembler(inputCols=list(cols), outputCol="_x").transform(scaled))
    parts = model.pc.toArray().T.tolist()
    parts = [[v * (1.0 if p[max(range(len(p)), key=lambda j: abs(p[j]))] >= 0 else -1.0) for v in p] for p in parts]
    return BlockProjection(list(cols), low, span, centre, parts, [c for c in cols if c not in NOT_SUMMED],
                           model.explainedVariance.toArray().tolist())


def block_pca(df: DataFrame, state: BlockProjection, prefix: str = "_vcols", drop: bool = True) -> DataFrame:
    """Projection, null count and sum of the block with the frozen state."""
    have = set(df.columns)
    cell = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) if c in have else F.lit(-1.0)
    x = F.array(*[(cell(c) - state.low[i]) / state.span[i] - state.centre[i] for i, c in enumerate(state.cols)])
    dot = lambda w: F.aggregate(F.zip_with("_x", F.array(*[F.lit(v) for v in w]), lambda a, b: a * b),
                                F.lit(0.0), lambda acc, v: acc + v)
    present = [c for c in state.cols if c in have]
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in state.sum_cols if c in have), F.lit(0.0))
    out = df.withColumn("_x", x)
    for i, w in enumerate(state.loadings):
        out = out.withColumn(f"{prefix}_dec{i}", dot(w))
    out = out.withColumn(f"{prefix}_na", row_null_count(present)).withColumn(f"{prefix}_sum", total.cast("float")).drop("_x")
    return out.drop(*present) if drop else out


HEAVY = 256  # values that a summary of a column keeps


def heavy_values(df: DataFrame, cols: Sequence[str], keep: int = HEAVY) -> DataFrame:
    """(column, value, low, error, n): values of each column that may be frequent, from one pass that moves no rows.

    A task keeps counts of at most 4 * ``keep`` values a column; when there are more, the count of the ``keep``-th largest is taken off all and what
    is left of none goes. So a value occurs at least ``low`` and at most ``low + error`` times, one that is missing at most ``error`` times, and
    ``error`` is at most n / ``keep``, n being the column's non-null rows.
    """
    names = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict] = [{} for _ in names]
        rows, error = [0] * len(names), [0] * len(names)
        for batch in batches:
            for i in range(len(names)):
                own = batch.column(i).drop_null()
                rows[i] += len(own)
                found = own.value_counts()
                for value, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                    counts[i][value] = counts[i].get(value, 0) + n
                if len(counts[i]) > 4 * keep:
                    cut = sorted(counts[i].values(), reverse=True)[keep - 1]
                    counts[i] = {v: n - cut for v, n in counts[i].items() if n > cut}
                    error[i] += cut
        for i, own in enumerate(counts):
            lines = [*own.items(), (None, 0)]  # the last one brings the error and the rows where no value is left
            yield pa.RecordBatch.from_pydict({"col": pa.array([i] * len(lines), pa.int32()), "value": pa.array([v for v, _ in lines], pa.string()), "low": pa.array([n for _, n in lines], pa.int64()),
                                              "error": pa.array([0] * len(own) + [error[i]], pa.int64()), "n": pa.array([0] * len(own) + [rows[i]], pa.int64())})
    parts = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, "col int, value string, low long, error long, n long")
    totals = Window.partitionBy("col")
    summed = parts.groupBy("col", "value").agg(F.sum("low").alias("low"), F.sum("error").alias("_e"), F.sum("n").alias("_n"))
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("col") + 1)
    return summed.select(named.alias("column"), "value", "low", F.sum("_e").over(totals).alias("error"), F.sum("_n").over(totals).alias("n")).filter("n > 0")


def _counted(df: DataFrame, values: DataFrame) -> DataFrame:
    """(column, value, count) of the few (column, value) rows in ``values``, exactly; rows meet them in the map tasks."""
    names = [r["column"] for r in values.select("column").distinct().collect()]
    if not names:
        return values.sparkSession.createDataFrame([], "column string, value string, count long")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "column", "value")
    return long.join(F.broadcast(values.select("column", "value")), ["column", "value"]).groupBy("column", "value").count()


def modal_shares(df: DataFrame, cols: Sequence[str], keep: int = HEAVY) -> DataFrame:
    """(column, modal_share) among non-null values.

    Candidates come from ``heavy_values`` and are counted again. Only columns without any frequent value, where a missing one might be the
    commonest, are counted value by value.
    """
    heavy = stable(heavy_values(df, cols, keep))
    top = Window.partitionBy("column")
    marked = stable(heavy.withColumn("_top", F.max("low").over(top)))
    sure = marked.filter((F.col("_top") > 0) & (F.col("_top") >= F.col("error")))
    exact = _counted(df, sure.filter((F.col("value").isNotNull()) & (F.col("low") + F.col("error") >= F.col("_top"))))
    shares = exact.groupBy("column").agg(F.max("count").alias("_c")).join(sure.groupBy("column").agg(F.max("n").alias("n")), "column").select("column", (F.col("_c") / F.col("n")).alias("modal_share"))
    flat = [r["column"] for r in marked.filter(~((F.col("_top") > 0) & (F.col("_top") >= F.col("error")))).select("column").distinct().collect()]
    if not flat:
        return shares
    long = df.select(*[F.col(c).cast("string").alias(c) for c in flat]).unpivot([], flat, "column", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c"))
    return shares.unionByName(counts.groupBy("column").agg((F.max("_c") / F.sum("_c")).alias("modal_share")))


def redundant_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.98, keep: int = HEAVY) -> list[str]:
    """Near-constant columns of the reference (a list no longer than the schema). Columns that can't reach the threshold are not counted again."""
    if threshold <= 2 / keep:
        drop = {r["column"] for r in modal_shares(df, cols, keep).filter(F.col("modal_share") >= threshold).collect()}
        return [c for c in cols if c in drop]
    may = stable(heavy_values(df, cols, keep).filter(F.col("value").isNotNull() & (F.col("low") + F.col("error") >= F.lit(threshold) * F.col("n"))))
    found = _counted(df, may).join(may.select("column", "value", "n"), ["column", "value"]).filter(F.col("count") >= F.lit(threshold) * F.col("n"))
    drop = {r["column"] for r in found.select("column").distinct().collect()}
    return [c for c in cols if c in drop]


def fit_ordinal(df: DataFrame, cols: Sequence[str], order: str, key: str, by: Sequence[str] = (),
                chunks: int | None = None) -> DataFrame:
    """(column, value, code): codes by first appearance in (order, key)."""
    long = df.select(*by, order, key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [*by, order, key], list(cols), "column", "value")
    firsts = (long.filter(F.col("value").isNotNull()).groupBy(*by, "column", "value")
              .agg(F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("k"))).alias("_f"))
              .select(*by, "column", "value", F.col("_f.o").alias("_o"), F.col("_f.k").alias("_k")))
    coded = row_index(chunk_by_value(firsts, "_o", chunks), [*by, "column"], ["_o", "_k"], "_code").df
    return coded.select(*by, "column", "value", (F.col("_code") - 1).cast("int").alias("code"))


def ordinal_encode(df: DataFrame, state: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Codes replace the values; unseen is -1 and missing is -2."""
    state, out = stable(state), df
    for c, side in _sides(state, cols).items():
        side = side.select(*by, F.col("value").alias("_v"), F.col("code").alias("_code"))
        keyed = out.withColumn("_v", F.col(c).cast("string"))
        out = null_safe_join(keyed, side, [*by, "_v"], "left")
        out = out.withColumn(c, F.when(F.col("_v").isNull(), MISSING).otherwise(F.coalesce("_code", F.lit(UNSEEN))).cast("int")).drop("_v", "_code")
    return out


def refit_per_window(df: DataFrame, week: str, freq_cols: Sequence[str], ordinal_cols: Sequence[str], order: str, key: str) -> DataFrame:
    """Every window fitted on itself: the contrast arm that shows what freezing prevents."""
    freq = fit_frequency(df, freq_cols, [week])
    codes = fit_ordinal(df, ordinal_cols, order, key, [week])
    return ordinal_encode(frequency_encode(df, freq, freq_cols, [week]), codes, ordinal_cols, [week])


@dataclass
class EncoderColumns:
    """Which columns play which part; the defaults are those of the card-transaction table."""

    order: str = "TransactionDT"
    key: str = "TransactionID"
    amount: str = "TransactionAmt"
    label: str = "isFraud"
    counters: list[str] = field(default_factory=lambda: [f"C{i}" for i in range(1, 15)])
    deltas: list[str] = field(default_factory=lambda: [f"D{i}" for i in range(1, 16)])
    flags: list[str] = field(default_factory=lambda: ["M1", "M2", "M3", "M5", "M6", "M7", "M8", "M9"])
    block: list[str] = field(default_factory=lambda: [f"V{i}" for i in range(1, 340)])
    dropped: list[str] = field(default_factory=lambda: ["_days", "TransactionDT", "TransactionID", "_uid1", "_uid2"])
    group_key: str = "_P_emaildomain__ProductCD"
    hour_period: float = 23.0


class FrozenEncoder:
    """Fits every stage on the reference once and replays it; output columns are ``feature_schema``.

    The input already carries the entity keys and causal sequence features (``prepare``), which run over the full
    history. State tables are written to reliable storage at fit, so that replay never recomputes the reference.
    """

    def __init__(self, cols: EncoderColumns | None = None, redundancy: float = 0.98, components: int = 2):
        self.cols, self.redundancy, self.components = cols or EncoderColumns(), redundancy, components
        self.feature_schema: list[str] | None = None

    def prepare(self, df: DataFrame, chunks: int | None = None) -> DataFrame:
        c = self.cols
        keyed = entity_keys(df, c.order)
        return sequence_features(keyed, "_uid2", c.order, c.key, c.amount,
                                 ("_day_lag_uid2", "_amount_lag_pct_uid2", "_uid2_seq_index"), chunks)

    def _stateless(self, df: DataFrame) -> DataFrame:
        c = self.cols
        out = df.withColumn("_log_dist_1_2", log_distance("dist1", "dist2"))
        out = cyclic_encode(date_parts(out, c.order), "_hour", c.hour_period)
        out = out.withColumn(c.group_key, combine_keys("P_emaildomain", "ProductCD")).withColumn("_card3__card5", combine_keys("card3", "card5"))
        return (out.withColumn("_amount_decimal", amount_fraction(c.amount)).withColumn("_amount_decimal_len", decimal_length(c.amount))
                .withColumn("_log_amount", log_amount(c.amount)))

    def _stages(self, df: DataFrame) -> DataFrame:
        c = self.cols
        out = group_aggregate_encode(self._stateless(df), self.groups, c.group_key, c.amount)
        out = unseen_flag(out, self.known_entities, "_uid2")
        out = unseen_flag(out, self.known_groups, c.group_key)
        out = frequency_encode(out, self.freq, self.freq_cols)
        out = out.withColumn("_all_na", row_null_count([x for x in out.columns if x != c.label]))
        counters, deltas, flags = ([x for x in block if x in out.columns] for block in (c.counters, c.deltas, c.flags))
        if counters:
            out = counter_summary(out, counters)
        if deltas:
            out = timedelta_summary(out, deltas)
        if flags:
            out = match_flag_pattern(out, flags)
        return block_pca(out, self.block) if self.block else out

    def fit(self, ref: DataFrame) -> "FrozenEncoder":
        c = self.cols
        plain = self._stateless(ref)
        self.groups = stable(fit_group_aggregates(plain, c.group_key, c.amount))
        self.known_entities = stable(fit_known_groups(plain, "_uid2"))
        self.known_groups = stable(fit_known_groups(plain, c.group_key))
        self.freq_cols = [x for x in c.counters if x in plain.columns] + [c.group_key]
        self.freq = stable(fit_frequency(plain, self.freq_cols))
        present = [x for x in c.block if x in plain.columns]
        self.block = fit_block_pca(plain, present, self.components) if present else None
        staged = stable(self._stages(ref))
        self.redundant = redundant_columns(staged, [x for x in staged.columns if x != c.label], self.redundancy)
        kept = [x for x in staged.columns if x not in {*self.redundant, *c.dropped, c.label}]
        self.text_cols = [x for x, t in staged.dtypes if t == "string" and x in kept]
        self.codes = stable(fit_ordinal(staged, self.text_cols, c.order, c.key)) if self.text_cols else None
        self.feature_schema = kept
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Exactly ``feature_schema`` plus the label when present and the ``keep`` columns of the input."""
        if self.feature_schema is None:
            raise RuntimeError("transform called before fit")
        held = df.select("*", *[F.col(k).alias(f"_keep_{k}") for k in keep])
        # The carried copies are not features, so they must not count as missing fields.
        staged = self._stages(held.fillna(0, [f"_keep_{k}" for k in keep]) if keep else held)
        out = ordinal_encode(staged, self.codes, self.text_cols) if self.codes is not None else staged
        label = [self.cols.label] if self.cols.label in out.columns else []
        return out.select(*[F.col(f"_keep_{k}").alias(k) for k in keep],
                          *[F.col(x) for x in self.feature_schema], *[x for x in label if x not in keep])

    def save(self, path: str) -> None:
        """State tables as parquet, scalars as one JSON row."""
        spark = self.groups.sparkSession
        tables = {"groups": self.groups, "known_entities": self.known_entities, "known_groups": self.known_groups, "freq": self.freq}
        if self.codes is not None:
            tables["codes"] = self.codes
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        import json
        meta = {"cols": self.cols.__dict__, "freq_cols": self.freq_cols, "redundant": self.redundant, "text_cols": self.text_cols,
                "feature_schema": self.feature_schema, "block": self.block.__dict__ if self.block else None}
        spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FrozenEncoder":
        import json
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        out = cls(EncoderColumns(**meta["cols"]))
        out.groups, out.known_entities, out.known_groups, out.freq = (
            spark.read.parquet(f"{path}/{n}") for n in ("groups", "known_entities", "known_groups", "freq"))
        out.codes = spark.read.parquet(f"{path}/codes") if meta["text_cols"] else None
        out.block = BlockProjection(**meta["block"]) if meta["block"] else None
        out.freq_cols, out.redundant, out.text_cols, out.feature_schema = (
            meta[k] for k in ("freq_cols", "redundant", "text_cols", "feature_schema"))
        return out
