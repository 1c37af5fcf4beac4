"""Queries that fit models; their rows can't be said in SQL."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import learning, sampling

def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The whole table with all components as features, and their names."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    many = e.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"f{k}" for k in range(many)]
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") / 25).cast("long").alias("row"), (F.col("vec_id") % 25).alias("col"), "label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)]), names


def _model(df: DataFrame, names: list[str]):
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=20, seed=42).fit(learning.assemble(df, names))


def rf_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _features(spark, sf_dir)
    return learning.classify_pixels(df, names, _model(df, names))


def rf_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _features(spark, sf_dir)
    return learning.classify_pixels(df, names, _model(df, names), mode="proba")


def rf_grid_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _features(spark, sf_dir)
    return learning.tune(learning.assemble(df, names), "random_forest", {"numTrees": [5, 15], "maxDepth": [4]}, folds=3)[0]


def rfecv_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _features(spark, sf_dir)
    return learning.select_features(df.select("id", "label", *names), names, folds=3, step=max(1, len(names) // 4), numTrees=10)[1]


def rf_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _features(spark, sf_dir)
    split = sampling.stratified_split(df, "label", "id").cache()
    return learning.evaluate(_model(split.where("NOT is_test"), names), learning.assemble(split.where("is_test"), names))[0]


def rf_one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _features(spark, sf_dir)
    made = learning.assemble(df, names)
    return learning.one_vs_rest_scores(made, made, numTrees=5)


def extra_trees_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _features(spark, sf_dir)
    model = learning.build_classifier("extra_trees", trees=10, max_depth=6).fit(learning.assemble(df, names))
    return learning.classify_pixels(df, names, model, mode="proba")


def softmax_boosting_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _features(spark, sf_dir)
    model = learning.build_classifier("xgboost", rounds=3, max_depth=2, bins=16).fit(learning.assemble(df, names))
    return learning.classify_pixels(df, names, model, mode="proba")


QUERIES = {"extra_trees_proba": extra_trees_proba, "softmax_boosting_proba": softmax_boosting_proba, "rf_evaluate": rf_evaluate, "rf_one_vs_rest": rf_one_vs_rest, "rf_classify": rf_classify, "rf_proba": rf_proba, "rf_grid_tune": rf_grid_tune, "rfecv_select": rfecv_select}
ORACLES: dict[str, str] = {}
