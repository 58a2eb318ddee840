"""Classifier training and scoring as MLlib jobs.

Gradient-boosted trees stand in for the leaf-wise boosting library and MLlib's perceptron for the dense network;
hyper-parameters are this library's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassificationModel,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.performance import evaluate, tune_threshold
from tidemark.operators.sampling import even_classes, stratified_folds, temporal_split
from tidemark.operators.structure import Scale, fit_scale
from tidemark.plans.checkpoints import drop_stable, stable
from tidemark.plans.ordered import attach_row, null_safe_join
from tidemark.sources.tables import exists


def features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds the ``features`` vector; missing values are 0."""
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(cols)]
    wide = df.select("*", *cells)
    names = [f"_f{i}" for i in range(len(cols))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


def balance_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight rows so that both classes weigh the same in total."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    weight = F.when(F.col(label) == 1, (F.col("_p") + F.col("_q")) / (2 * F.greatest("_p", F.lit(1)))).otherwise((F.col("_p") + F.col("_q")) / (2 * F.greatest("_q", F.lit(1))))
    return attach_row(df, n).withColumn("_weight", weight).drop("_p", "_q")


@dataclass
class Classifier:
    """A fitted model with its columns and decision threshold."""

    model: GBTClassificationModel | MultilayerPerceptronClassificationModel
    cols: list[str]
    threshold: float = 0.5
    scale: Scale | None = None

    def _input(self, df: DataFrame) -> DataFrame:
        if self.scale is None:
            return features(df, self.cols)
        return standardised(df, self.scale)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the class-1 probability."""
        out = self.model.transform(self._input(df))
        extra = [c for c in ("features", "rawPrediction", "probability", "prediction") if c in out.columns]
        return out.withColumn(name, vector_to_array("probability")[1]).drop(*extra)

    def importances(self) -> list[float]:
        return self.model.featureImportances.toArray().tolist()


def standardised(df: DataFrame, scale: Scale) -> DataFrame:
    x = scale.scaled()
    names = [f"_z{i}" for i in range(len(scale.cols))]
    wide = df.select("*", *[x[i].alias(n) for i, n in enumerate(names)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


def train_classifier(df: DataFrame, cols: Sequence[str], label: str, order: str, key: str, seed: int = 42, max_iter: int = 20,
                     max_depth: int = 4, weight: str | None = None, tune: bool = True) -> Classifier:
    """Boosted trees, class-balanced, early-stopped and thresholded on the last fifth by time."""
    split = temporal_split(df, order, key, label, 0.8, seed)
    ready = balance_weights(split, label).withColumn("_y", F.col(label).cast("double"))
    if weight is not None:
        ready = ready.withColumn("_weight", F.col("_weight") * F.col(weight)).filter(F.col("_weight") > 0)
    # Boosting reads its rows many times; weights drawn by digests and the split are worked out once.
    held = stable(ready.select(*[F.col(c).cast("double").alias(c) for c in cols], "_y", "_weight", "is_valid"))
    ready = features(held, cols).select("features", "_y", "_weight", "is_valid")
    model = GBTClassifier(featuresCol="features", labelCol="_y", weightCol="_weight", validationIndicatorCol="is_valid", seed=seed,
                          maxIter=max_iter, maxDepth=max_depth, stepSize=0.1, subsamplingRate=0.7, featureSubsetStrategy="all").fit(ready)
    out = Classifier(model, list(cols))
    if tune:
        scored = model.transform(ready.filter("is_valid")).select(F.col("_y").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))
        out.threshold = tune_threshold(scored, []).first()["threshold"]
    drop_stable(held)
    return out


def train_mlp(df: DataFrame, cols: Sequence[str], label: str, key: str, hidden: Sequence[int] = (256, 128, 64), seed: int = 42, max_iter: int = 60,
              head: str | None = None) -> Classifier:
    """Perceptron on standardised inputs. It takes no weights, so the classes are balanced by sampling (``even_classes``, also for ``head``)."""
    scale = fit_scale(df, cols)
    ready = standardised(even_classes(df, label, key, seed, head), scale).select("features", F.col(label).cast("double").alias("_y"))
    model = MultilayerPerceptronClassifier(layers=[len(cols), *hidden, 2], labelCol="_y", seed=seed, maxIter=max_iter, blockSize=128).fit(ready)
    return Classifier(model, list(cols), scale=scale)


def partial_update(parent: Classifier, recent: DataFrame, label: str, max_iter: int = 5, min_rows: int = 32) -> Classifier:
    """A child continued from the parent's weights and scaling; fewer than 32 rows or one class copies the parent."""
    seen = recent.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k")).first()
    if seen["n"] < min_rows or seen["k"] < 2:
        return Classifier(parent.model.copy(), parent.cols, parent.threshold, parent.scale)
    ready = standardised(recent, parent.scale).select("features", F.col(label).cast("double").alias("_y"))
    model = MultilayerPerceptronClassifier(layers=parent.model.getLayers(), labelCol="_y", maxIter=max_iter, initialWeights=parent.model.weights).fit(ready)
    return Classifier(model, parent.cols, parent.threshold, parent.scale)


def oof_scores(df: DataFrame, cols: Sequence[str], label: str, order: str, key: str, k: int = 2, seed: int = 42, **kw) -> tuple[DataFrame, Classifier]:
    """Every row scored by a model that did not see it, and the first fold's model.

    With one class, or fewer than 2k rows, a single model scores its own rows.
    """
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("c")).first()
    if seen["c"] < 2 or seen["n"] < 2 * k:
        model = train_classifier(df, cols, label, order, key, seed, **kw)
        return model.score(df, "oof_score"), model
    folded, parts, first = stratified_folds(df, label, k, key, seed), [], None
    for fold in range(k):
        model = train_classifier(folded.filter(F.col("fold") != fold), cols, label, order, key, seed, **kw)
        first = first or model
        parts.append(model.score(folded.filter(F.col("fold") == fold), "oof_score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, first


def importance_table(spark: SparkSession, model: Classifier, top: int | None = None) -> DataFrame:
    """(feature, importance), best first: one row per model column."""
    rows = sorted(zip(model.cols, model.importances()), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(f, float(v)) for f, v in rows][:top], "feature string, importance double")


def score_versions(df: DataFrame, versions: dict[int, Classifier], keep: Sequence[str]) -> DataFrame:
    """(version, keep columns, score, threshold): each distinct version scores the rows once, for all methods."""
    out = None
    for v, model in versions.items():
        rows = model.score(df).select(F.lit(v).cast("long").alias("version"), *keep, "score", F.lit(float(model.threshold)).alias("threshold"))
        out = rows if out is None else out.unionByName(rows)
    return out


def method_scores(scores: DataFrame, in_force: DataFrame) -> DataFrame:
    """Scores of the version each method has in force: join (method, week, version) to the version scores."""
    return scores.join(F.broadcast(in_force), ["version", "week"])


def version_row(spark: SparkSession, model: Classifier, week: int, path: str, df: DataFrame, label: str) -> DataFrame:
    """(trained_through_week, path, n_rows, auc, f1, threshold) of a fitted version."""
    scored = model.score(df).select(F.col(label).cast("int").alias("label"), "score")
    stats = evaluate(scored, [], threshold=float(model.threshold))
    rows = scored.agg(F.count(F.lit(1)).alias("n_rows"))
    return null_safe_join(stats, rows, []).select(F.lit(week).cast("long").alias("trained_through_week"), F.lit(path).alias("path"), "n_rows", "auc", "f1", F.lit(float(model.threshold)).alias("threshold"))


def save_version(spark: SparkSession, model: Classifier, path: str) -> None:
    model.model.write().overwrite().save(f"{path}/model")
    scale = model.scale
    row = (model.cols, float(model.threshold), scale.mean if scale else None, scale.std if scale else None)
    spark.createDataFrame([row], "cols array<string>, threshold double, mean array<double>, std array<double>").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_version(spark: SparkSession, path: str) -> Classifier | None:
    """The saved version, or None when there is none."""
    if not exists(spark, f"{path}/meta"):
        return None
    meta = spark.read.schema("cols array<string>, threshold double, mean array<double>, std array<double>").json(f"{path}/meta").first()
    if meta["mean"] is None:
        return Classifier(GBTClassificationModel.load(f"{path}/model"), list(meta["cols"]), meta["threshold"])
    scale = Scale(list(meta["cols"]), list(meta["mean"]), list(meta["std"]))
    return Classifier(MultilayerPerceptronClassificationModel.load(f"{path}/model"), list(meta["cols"]), meta["threshold"], scale)
