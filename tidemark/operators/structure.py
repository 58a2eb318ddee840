"""Structural drift: attributions, clusters and reconstruction error."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import EPSILON
from tidemark.operators.distribution import benjamini_hochberg, ks_stat
from tidemark.plans.ordered import with_reference

SPREAD_FLOOR = 1e-8


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


@dataclass
class Scale:
    """Reference mean and population deviation of each column (1 where it is constant)."""

    cols: list[str]
    mean: list[float]
    std: list[float]

    def scaled(self) -> Column:
        return F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - self.mean[i]) / self.std[i] for i, c in enumerate(self.cols)])


def fit_scale(ref: DataFrame, cols: Sequence[str]) -> Scale:
    """One pass; the result has two numbers per column."""
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    row = ref.agg(*[f(x(c)).alias(f"{t}{i}") for i, c in enumerate(cols) for t, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    std = [row[f"s{i}"] for i in range(len(cols))]
    return Scale(list(cols), [row[f"m{i}"] for i in range(len(cols))], [s if s >= SPREAD_FLOOR else 1.0 for s in std])


# --- attributions -----------------------------------------------------------------------------------------------

def linear_attributions(df: DataFrame, coefficients: dict[str, float], means: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """Exact attribution of a linear score: coefficient * (x - reference mean), long form."""
    cells = df.select(*keys, *[((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - means[c]) * w).alias(c) for c, w in coefficients.items()])
    return cells.unpivot(list(keys), list(coefficients), "feature", "attribution")


def tree_nodes(model) -> list[dict[str, np.ndarray]]:
    """Node arrays of every tree of a fitted ensemble (model metadata, bounded by trees x 2^depth)."""
    trees = []
    for tree in model.trees:
        feature, cut, left, right, value, catg = [], [], [], [], [], []
        stack = [(tree._java_obj.rootNode(), None, None)]
        while stack:
            node, parent, side = stack.pop()
            i = len(feature)
            if parent is not None:
                (left if side == "l" else right)[parent] = i
            value.append(float(node.prediction()))
            internal = node.getClass().getSimpleName() == "InternalNode"
            feature.append(node.split().featureIndex() if internal else -1)
            cut.append(float(node.split().threshold()) if internal else 0.0)
            left.append(-1)
            right.append(-1)
            if internal:
                stack += [(node.leftChild(), i, "l"), (node.rightChild(), i, "r")]
        trees.append({"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "right": np.array(right), "value": np.array(value)})
    return trees


def tree_attributions(df: DataFrame, model, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per feature, the change of the node value along each row's path, summed over the weighted trees.

    The node arrays travel with the function; rows are walked together, one array step per tree level.
    """
    trees, weights = tree_nodes(model), list(model.treeWeights)
    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{c}` double" for c in cols])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(cols)].to_numpy(dtype=float)
            out = np.zeros_like(x)
            rows = np.arange(len(x))
            for tree, weight in zip(trees, weights):
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = tree["feature"][at]
                    go = f >= 0
                    if not go.any():
                        break
                    r, here = rows[go], at[go]
                    nxt = np.where(x[r, f[go]] <= tree["cut"][here], tree["left"][here], tree["right"][here])
                    np.add.at(out, (r, f[go]), weight * (tree["value"][nxt] - tree["value"][here]))
                    at[go] = nxt
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(out, columns=list(cols))], axis=1)

    base = df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return base.mapInPandas(walk, schema).unpivot(list(keys), list(cols), "feature", "attribution")


def mlp_attributions(df: DataFrame, layers: Sequence[int], weights: Sequence[float], scale: Scale, keys: Sequence[str], long: bool = True) -> DataFrame:
    """Gradient of the class-1 logit margin times the scaled input, per feature.

    ``weights`` is the flat parameter vector of a multilayer perceptron with sigmoid hidden layers: per layer the
    column-major matrix, then the intercepts. Without ``long`` the features stay side by side, a column each.
    """
    mats, flat, at = [], np.asarray(weights, dtype=float), 0
    for n_in, n_out in zip(layers[:-1], layers[1:]):
        w = flat[at:at + n_in * n_out].reshape((n_out, n_in), order="F")
        at += n_in * n_out
        mats.append((w, flat[at:at + n_out]))
        at += n_out
    cols, mean, std = scale.cols, np.array(scale.mean), np.array(scale.std)
    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{c}` double" for c in cols])

    def grads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (np.stack([batch.column(c).to_numpy() for c in cols], axis=1) - mean) / std
            hidden = [x]
            for w, b in mats[:-1]:
                hidden.append(1.0 / (1.0 + np.exp(-(hidden[-1] @ w.T + b))))
            g = np.tile(mats[-1][0][1] - mats[-1][0][0], (len(x), 1))
            for (w, _), h in zip(reversed(mats[:-1]), reversed(hidden[1:])):
                g = (g * h * (1 - h)) @ w
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(a, from_pandas=True) for a in (g * x).T]], names=[*keys, *cols])

    base = df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    out = base.mapInArrow(grads, schema)
    return out.unpivot(list(keys), cols, "feature", "attribution") if long else out


def attribution_drift(attributions: DataFrame, week: str = "week", alpha: float = 0.05, min_effect: float = 0.10,
                      chunks: int | None = None, by: Sequence[str] = (), cols: Sequence[str] = ()) -> DataFrame:
    """KS of each feature's attributions against week 0, FDR-corrected, gated on effect size; mean |a| before and after.

    ``by`` are columns that keep several models apart. With ``cols`` the attributions of one model stand side by side in these columns.
    """
    tested = ks_stat(attributions, ["feature", *by], week, "attribution", alpha, chunks, cols).drop("drift")
    judged = benjamini_hochberg(tested, [*by, week], alpha=alpha)
    if cols:
        size = attributions.groupBy(week).agg(*[F.avg(F.abs(c)).alias(c) for c in cols]).unpivot([week], list(cols), "feature", "_m")
    else:
        size = attributions.groupBy("feature", *by, week).agg(F.avg(F.abs("attribution")).alias("_m"))
    size = with_reference(size.withColumnRenamed("_m", "curr_importance"), ["feature", *by], week, {"curr_importance": "ref_importance"})
    out = judged.join(size, ["feature", *by, week])
    return (out.withColumn("importance_shift", F.col("curr_importance") - F.col("ref_importance"))
            .withColumn("drift", F.col("rejected") & (F.col("statistic") >= min_effect)))


def attribution_summary(drift: DataFrame, week: str = "week", by: Sequence[str] = ()) -> DataFrame:
    """Share of drifting features and mean |shift| per window."""
    return drift.groupBy(*by, week).agg(F.avg(F.col("drift").cast("double")).alias("attribution_drift_fraction"),
                                        F.avg(F.abs("importance_shift")).alias("attribution_mean_shift"), F.count_if("drift").alias("drifted_features"))


# --- clusters ----------------------------------------------------------------------------------------------------

@dataclass
class Clusters:
    scale: Scale
    centres: list[list[float]]


def fit_clusters(ref: DataFrame, cols: Sequence[str], k: int = 5, seed: int = 42) -> Clusters:
    """K-Means on the standardised reference."""
    scale = fit_scale(ref, cols)
    x = scale.scaled()
    frame = ref.select(*[x[i].alias(f"x{i}") for i in range(len(cols))])
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="features").transform(frame).select("features")
    model = KMeans(k=k, seed=seed, maxIter=20).fit(vectors)
    return Clusters(scale, [c.tolist() for c in model.clusterCenters()])


def assign_clusters(df: DataFrame, state: Clusters) -> DataFrame:
    """Adds ``cluster``, ``distance`` and the squared deviation per column, as column expressions over the centres."""
    out = df.withColumn("_x", state.scale.scaled())
    dist = [_sum(F.transform(F.zip_with("_x", F.array(*[F.lit(v) for v in c]), lambda a, b: a - b), lambda d: d * d)) for c in state.centres]
    ranked = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(dist)]))
    out = out.withColumn("_near", ranked)
    centres = F.array(*[F.array(*[F.lit(v) for v in c]) for c in state.centres])
    dev = F.transform(F.zip_with("_x", F.element_at(centres, F.col("_near.i") + 1), lambda a, b: a - b), lambda d: d * d)
    return (out.withColumn("cluster", F.col("_near.i")).withColumn("distance", F.sqrt(F.col("_near.d"))).withColumn("sqdev", dev).drop("_x", "_near"))


def cluster_drift(assigned: DataFrame, cols: Sequence[str], k: int, week: str = "week", distance_threshold: float = 1.5,
                  psi_threshold: float = 0.2, top: int = 5) -> DataFrame:
    """Distance ratio and assignment PSI per window, with the features whose deviation grew most.

    One aggregate per window holds the mean distance, the cluster counts and the mean deviations.
    """
    stats = assigned.groupBy(week).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("distance").alias("mean_dist"), F.array(*[F.count_if(F.col("cluster") == i) for i in range(k)]).alias("counts"),
        F.array(*[F.avg(F.get("sqdev", F.lit(i))) for i in range(len(cols))]).alias("dev"))
    both = with_reference(stats, [], week, {"n_rows": "ref_n_rows", "mean_dist": "ref_mean_dist", "counts": "ref_counts", "dev": "_rdev"})
    share = lambda c, n: F.when(c == 0, F.lit(EPSILON)).otherwise(c / n)
    moved = _sum(F.zip_with("counts", "ref_counts", lambda c, r: (share(c, F.col("n_rows")) - share(r, F.col("ref_n_rows")))
                            * F.ln(share(c, F.col("n_rows")) / share(r, F.col("ref_n_rows")))))
    names = F.array(*[F.lit(c) for c in cols])
    shifts = F.transform(F.arrays_zip(names.alias("f"), F.col("_rdev").alias("r"), F.col("dev").alias("c")),
                         lambda z: F.struct((z["c"] - z["r"]).alias("shift"), z["f"].alias("feature"), z["r"].alias("ref_sqdev"), z["c"].alias("curr_sqdev")))
    out = both.withColumn("distance_ratio", F.col("mean_dist") / F.greatest("ref_mean_dist", F.lit(1e-6))).withColumn("cluster_psi", moved)
    return (out.withColumn("drift_detected", (F.col("distance_ratio") >= distance_threshold) | (F.col("cluster_psi") >= psi_threshold))
            .withColumn("warning_detected", ~F.col("drift_detected") & ((F.col("distance_ratio") >= distance_threshold * 0.8) | (F.col("cluster_psi") >= psi_threshold * 0.5)))
            .withColumn("top_contributing_features", F.slice(F.reverse(F.array_sort(shifts)), 1, top))
            .select(week, "n_rows", "distance_ratio", "ref_mean_dist", F.col("mean_dist").alias("curr_mean_dist"), "cluster_psi", "ref_n_rows",
                    "ref_counts", F.col("counts").alias("curr_counts"), "drift_detected", "warning_detected", "top_contributing_features"))


# --- reconstruction ----------------------------------------------------------------------------------------------

@dataclass
class Autoencoder:
    """A linear bottleneck: standardise, project on max(2, n // 2) components and back."""

    scale: Scale
    components: list[list[float]]


def fit_reconstruction(ref: DataFrame, cols: Sequence[str]) -> Autoencoder:
    scale = fit_scale(ref, cols)
    x = scale.scaled()
    frame = ref.select(*[x[i].alias(f"x{i}") for i in range(len(cols))])
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="features").transform(frame)
    model = PCA(k=min(len(cols), max(2, len(cols) // 2)), inputCol="features", outputCol="p").fit(vectors)
    return Autoencoder(scale, model.pc.toArray().T.tolist())


def reconstruct(df: DataFrame, state: Autoencoder) -> DataFrame:
    """Adds ``rmse`` and the squared error per column."""
    projector = (np.array(state.components).T @ np.array(state.components)).tolist()
    out = df.withColumn("_x", state.scale.scaled())
    back = F.array(*[_sum(F.zip_with("_x", F.array(*[F.lit(v) for v in row]), lambda a, b: a * b)) for row in projector])
    out = out.withColumn("sqerr", F.zip_with("_x", back, lambda a, b: (a - b) * (a - b)))
    return out.withColumn("rmse", F.sqrt(_sum(F.col("sqerr")) / len(state.scale.cols))).drop("_x")


def reconstruction_drift(errors: DataFrame, cols: Sequence[str], week: str = "week", z_threshold: float = 3.0, top: int = 5,
                         chunks: int | None = None) -> DataFrame:
    """z of each window's mean RMSE against the reference's mean and deviation; KS on the errors is reported only."""
    stats = errors.groupBy(week).agg(F.avg("rmse").alias("_m"), F.stddev_pop("rmse").alias("_s"),
                                     F.array(*[F.avg(F.get("sqerr", F.lit(i))) for i in range(len(cols))]).alias("_e"))
    both = with_reference(stats, [], week, {"_m": "ref_rmse_mean", "_s": "_rs", "_e": "_re"})
    names = F.array(*[F.lit(c) for c in cols])
    shifts = F.transform(F.arrays_zip(names.alias("f"), F.col("_re").alias("r"), F.col("_e").alias("c")),
                         lambda z: F.struct((z["c"] - z["r"]).alias("shift"), z["f"].alias("feature"), z["r"].alias("ref_mse"), z["c"].alias("curr_mse")))
    ks = ks_stat(errors.withColumn("_one", F.lit(1)), ["_one"], week, "rmse", chunks=chunks).select(week, F.col("statistic").alias("ks_stat"), "p_value")
    out = both.withColumn("mse_z_score", (F.col("_m") - F.col("ref_rmse_mean")) / F.greatest("_rs", F.lit(1e-6))).join(ks, week)
    return (out.withColumn("drift_detected", F.col("mse_z_score") > z_threshold)
            .withColumn("warning_detected", (F.col("mse_z_score") > z_threshold * 0.67) & ~F.col("drift_detected"))
            .withColumn("top_contributing_features", F.slice(F.reverse(F.array_sort(shifts)), 1, top))
            .select(week, "ref_rmse_mean", F.col("_m").alias("curr_rmse_mean"), "mse_z_score", "ks_stat", "p_value", "drift_detected", "warning_detected", "top_contributing_features"))


def pca_snapshot(sample: DataFrame, state: Clusters) -> DataFrame:
    """Two-dimensional coordinates and cluster label of a bounded sample per window (see sampling.bounded_sample)."""
    cols = state.scale.cols
    labelled = assign_clusters(sample, state).withColumn("_x", state.scale.scaled())
    ref = labelled.filter("week = 0").select(*[F.get("_x", F.lit(i)).alias(f"x{i}") for i in range(len(cols))])
    model = PCA(k=2, inputCol="v", outputCol="p").fit(VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="v").transform(ref))
    parts = model.pc.toArray().T.tolist()
    dot = lambda w: _sum(F.zip_with("_x", F.array(*[F.lit(v) for v in w]), lambda a, b: a * b))
    return labelled.withColumn("pc1", dot(parts[0])).withColumn("pc2", dot(parts[1])).drop("_x", "sqdev")


