"""Classifiers over feature tables: building, tuning, feature selection, inference on pixels."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.scalars import all_of, finite
from terrace.operators.accuracy import confusion, overall_accuracy
from terrace.operators.trees import ExtraTrees, SoftmaxBoosting


def build_classifier(name: str, *, label: str = "label", features: str = "features", seed: int = 42, **params):
    """random_forest; extra_trees (see ExtraTrees); xgboost, lightgbm (see SoftmaxBoosting); gbt (one-vs-rest boosted trees). params are the kind's own."""
    kind = "".join(c for c in name.lower() if c.isalnum())
    if kind in ("randomforest", "rf"):
        return RandomForestClassifier(labelCol=label, featuresCol=features, seed=seed, **params)
    if kind in ("extratrees", "et"):
        return ExtraTrees(label=label, features=features, seed=seed, **params)
    if kind in ("xgboost", "lightgbm", "xgb", "lgbm", "softmaxboosting"):
        return SoftmaxBoosting(label=label, features=features, **params)
    if kind == "gbt":
        return OneVsRest(classifier=GBTClassifier(labelCol=label, featuresCol=features, seed=seed, **params), labelCol=label, featuresCol=features)
    raise ValueError(f"unknown classifier {name}")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """df with fold: each label dealt out evenly."""
    return df.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)), F.lit(folds)))


def at_once(run: Callable, calls: list[tuple], many: int) -> list:
    """What run gives for each call's arguments, in order; each is a distributed job, and so many go on together."""
    with ThreadPoolExecutor(max(1, many)) as pool:
        return list(pool.map(lambda args: run(*args), calls))


#: Names of scores and the measures of overall_accuracy that they stand for.
SCORES = {"balanced_accuracy": "balanced_accuracy", "accuracy": "oa", "f1_macro": "f1_macro", "f1_weighted": "f1_weighted", "f1_micro": "f1_micro", "kappa": "kappa", "matthews_corrcoef": "mcc"}


def score_of(predictions: DataFrame, label: str = "label", scoring: str | Callable[[DataFrame], float] = "balanced_accuracy") -> float:
    """A score by name, or what a function makes of the predictions."""
    if callable(scoring):
        return float(scoring(predictions))
    if scoring not in SCORES:
        raise ValueError(f"unknown score {scoring}")
    return float(overall_accuracy(confusion(predictions, label, "prediction")).first()[SCORES[scoring]] or 0.0)


def balanced_accuracy(predictions: DataFrame, label: str = "label") -> float:
    return score_of(predictions, label)


def tune(
    df: DataFrame, name: str | Callable[..., object], grid: dict[str, list], *, label: str = "label", key: str = "id", folds: int = 5, fold_col: str | None = None, scoring: str | Callable[[DataFrame], float] = "balanced_accuracy", n_iter: int | None = None, seed: int = 42, parallelism: int = 4,
) -> tuple[DataFrame, Model]:
    """(params with their mean score, named by scoring, the best first; the model fitted on all rows with the best). df has features. n_iter: a random sample of the grid.

    name: of a classifier, or a function that makes an estimator of the params; fold_col: a column that deals the rows out, instead of stratified folds.
    parallelism: fits that run at once.
    """
    if n_iter is not None and n_iter < 1:
        raise ValueError("n_iter is at least 1")
    make = name if callable(name) else lambda **params: build_classifier(name, label=label, seed=seed, **params)
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    if n_iter is not None and n_iter < len(every):
        every = random.Random(seed).sample(every, n_iter)
    dealt = (df.withColumn("fold", F.col(fold_col)) if fold_col else stratified_folds(df, label, key, folds, seed)).cache()
    parts = sorted(r[0] for r in dealt.select("fold").distinct().collect())

    def one(params: dict, k: int) -> float:
        return score_of(make(**params).fit(dealt.where(F.col("fold") != k)).transform(dealt.where(F.col("fold") == k)), label, scoring)

    scores = at_once(one, [(params, k) for params in every for k in parts], parallelism)
    rows = [(str(sorted(params.items())), sum(scores[i * len(parts) : (i + 1) * len(parts)]) / len(parts)) for i, params in enumerate(every)]
    dealt.unpersist()
    best = max(range(len(rows)), key=lambda k: rows[k][1])
    title = scoring if isinstance(scoring, str) else "score"
    table = df.sparkSession.createDataFrame(rows, f"params string, {title} double").orderBy(F.desc(title), "params")
    return table, make(**every[best]).fit(df)


def select_features(
    df: DataFrame, features: list[str], *, label: str = "label", key: str = "id", folds: int = 3, step: int = 1, least: int = 1, scoring: str | Callable[[DataFrame], float] = "balanced_accuracy", seed: int = 42, parallelism: int = 4, **params,
) -> tuple[list[str], DataFrame]:
    """(the features kept, a table of n_features and score): drops the least important ones step by step and keeps the number that scores best."""
    left, tried = list(features), []
    while True:
        own = stratified_folds(assemble(df.drop("features"), left), label, key, folds, seed).cache()

        def one(k: int, own: DataFrame = own) -> float:
            return score_of(build_classifier("rf", label=label, seed=seed, **params).fit(own.where(F.col("fold") != k)).transform(own.where(F.col("fold") == k)), label, scoring)

        score = sum(at_once(one, [(k,) for k in range(folds)], parallelism)) / folds
        tried.append((list(left), score))
        if len(left) <= least:
            break
        weight = build_classifier("rf", label=label, seed=seed, **params).fit(own).featureImportances.toArray()
        own.unpersist()
        drop = set(sorted(range(len(left)), key=lambda k: (weight[k], k))[: min(step, len(left) - least)])
        left = [f for k, f in enumerate(left) if k not in drop]
    best = max(tried, key=lambda t: (t[1], -len(t[0])))
    return best[0], df.sparkSession.createDataFrame([(len(f), s) for f, s in tried], "n_features int, score double")


def check_manifest(manifest: dict, n_features: int, bands: list[str]) -> None:
    """The manifest's features (feature_names or features), the model's and the raster's bands are as many."""
    names = manifest.get("feature_names") or manifest.get("features") or []
    if not len(names) == n_features == len(bands):
        raise ValueError(f"{len(names)} features in the manifest, {n_features} in the model, {len(bands)} bands")


def classify_pixels(pixels: DataFrame, bands: list[str], model, *, mode: str = "hard", scale: int = 10000, nodata: int = 0, selector=None, dtype: str = "int") -> DataFrame:
    """row, col and cls (hard, of type dtype) or p (proba: probabilities times scale, half even). Pixels with a band that isn't finite are nodata (or null p).

    selector: names of the bands that the model takes, in its order, or an object with get_support or transform (dense or sparse
    result), for callables. A class that dtype can't hold stops the query. model: a fitted pyspark.ml model with features, or a callable on a pandas table of bands that returns classes (hard)
    or an array of rows of probabilities (proba); a callable runs on batches.
    """
    if mode not in ("hard", "proba"):
        raise ValueError(f"unknown mode {mode}")
    valid = pixels.where(all_of([finite(F.col(b)) for b in bands]))
    if selector is not None and hasattr(selector, "get_support"):
        selector = [b for b, keep in zip(bands, selector.get_support(), strict=True) if keep]
    if isinstance(selector, (list, tuple)):
        bands, selector = list(selector), None
    if isinstance(model, Model):
        if selector is not None:
            raise ValueError("a pyspark.ml model takes a list of bands as its selector")
        done = model.transform(assemble(valid.select("row", "col", *bands), bands))
        made = F.col("prediction").cast("int").alias("cls") if mode == "hard" else F.transform(vector_to_array("probability"), lambda x: F.greatest(F.lit(0), F.least(F.lit(scale), F.bround(x * scale).cast("int")))).alias("p")
        done = done.select("row", "col", made)
    else:
        kind = "cls int" if mode == "hard" else "p array<int>"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = b[bands] if selector is None else selector.transform(b[bands])
                out = model(x.toarray() if hasattr(x, "toarray") else x)
                if mode == "hard":
                    yield b[["row", "col"]].assign(cls=[int(x) for x in out])
                else:
                    yield b[["row", "col"]].assign(p=[[min(scale, max(0, round(float(x) * scale))) for x in row] for row in out])

        done = valid.select("row", "col", *bands).mapInPandas(run, f"row {dict(pixels.dtypes)['row']}, col {dict(pixels.dtypes)['col']}, {kind}")
    joined = pixels.select("row", "col").join(done, ["row", "col"], "left")
    if mode == "proba":
        return joined
    cls = F.coalesce("cls", F.lit(nodata))
    return joined.withColumn("cls", cls if dtype == "int" else cls.cast("int").cast(dtype))


def feature_importances(model, features: list[str]) -> dict[str, float]:
    """A fitted forest's importances by feature, the largest first."""
    return dict(sorted(zip(features, (float(x) for x in model.featureImportances.toArray()), strict=True), key=lambda kv: (-kv[1], kv[0])))


def class_values(samples: DataFrame, label: str = "label") -> list[int]:
    """The labels that occur, ascending (a class each)."""
    return [r[0] for r in samples.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]


def train_probability_model(samples: DataFrame, *, label: str = "label", seed: int = 42, **params) -> Model:
    """A forest fitted on all rows, for probabilities of all classes."""
    return build_classifier("rf", label=label, seed=seed, **params).fit(samples)


def cohen_kappa(predictions: DataFrame, label: str = "label") -> float:
    row = overall_accuracy(confusion(predictions, label, "prediction")).first()
    return float(row["kappa"] or 0.0)


def tune_forest(df: DataFrame, trees: list[int], subsets: list[str], *, label: str = "label", key: str = "id", fraction: float = 0.3, seed: int = 42, parallelism: int = 4) -> tuple[DataFrame, dict]:
    """(trees, subset, oa and kappa on held-out rows of each setting, the best first; the best setting). A forest is fitted for each on the same split."""
    split = df.withColumn("_test", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)).cache()

    def one(n: int, s: str) -> tuple[int, str, float, float]:
        done = build_classifier("rf", label=label, seed=seed, numTrees=n, featureSubsetStrategy=s).fit(split.where("NOT _test")).transform(split.where("_test"))
        row = overall_accuracy(confusion(done, label, "prediction")).first()
        return n, s, float(row["oa"] or 0.0), float(row["kappa"] or 0.0)

    rows = at_once(one, list(itertools.product(trees, subsets)), parallelism)
    split.unpersist()
    best = max(rows, key=lambda r: (r[2], r[3], -r[0]))
    table = df.sparkSession.createDataFrame(rows, "trees int, subset string, oa double, kappa double").orderBy(F.desc("oa"), F.desc("kappa"), "trees")
    return table, {"numTrees": best[0], "featureSubsetStrategy": best[1]}


def forest_pipeline(features: list[str], **params) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), build_classifier("rf", **params)])


def evaluate(model: Model, test: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overall measures, measures by class, confusion matrix) of a fitted model on rows with features."""
    from terrace.operators.accuracy import class_accuracy

    matrix = confusion(model.transform(test), label, "prediction")
    return overall_accuracy(matrix), class_accuracy(matrix), matrix


def one_vs_rest_scores(train: DataFrame, pixels: DataFrame, *, label: str = "label", keys: tuple[str, ...] = ("row", "col"), seed: int = 42, **params) -> DataFrame:
    """keys, scores (array of 100 times the probability of each class against the rest, in order of class), cls, confidence."""
    classes = sorted(r[0] for r in train.select(label).distinct().collect())  # a class each
    done = pixels
    for c in classes:
        model = build_classifier("rf", label="_is", seed=seed, **params).fit(train.withColumn("_is", (F.col(label) == c).cast("double")))
        done = model.transform(done).withColumn(f"_p{c}", F.bround(vector_to_array("probability")[1] * 100).cast("int")).drop("rawPrediction", "probability", "prediction")
    scores = F.array(*[F.col(f"_p{c}") for c in classes])
    return done.select(*keys, scores.alias("scores")).withColumn("cls", F.element_at(F.array(*map(F.lit, classes)), F.array_position("scores", F.array_max("scores")).cast("int"))).withColumn("confidence", F.array_max("scores"))
