"""Fitting and comparing value models with Spark's estimators, and their histories as tables.

Deep nets are scored here (``search.evaluated`` takes any scorer), not trained.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.scoring import bounded
from plyforge.operators import metrics


@dataclass(frozen=True)
class Experiment:
    """One arm of a sweep: what differs from the base settings, and why."""

    name: str
    rationale: str = ""
    params: dict = field(default_factory=dict)


def estimator(features: list[str], target: str, kind: str = "linear", **params) -> Pipeline:
    parts = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    model = {"linear": LinearRegression, "trees": GBTRegressor}[kind]
    return Pipeline(stages=[parts, model(labelCol=target, featuresCol="features", **params)])


def train(rows: DataFrame, features: list[str], target: str, kind: str = "linear", **params) -> PipelineModel:
    return estimator(features, target, kind, **params).fit(rows.filter(F.col(target).isNotNull()))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    p = bounded(F.col("prediction"), 1.0)
    return model.transform(rows).withColumn("prediction", p).drop("features")


def sweep(train_rows: DataFrame, val_rows: DataFrame, features: list[str], target: str, arms: list[Experiment], kind: str = "linear") -> DataFrame:
    """(name, rationale, params, metrics) of every arm on the validation rows, best first.

    The rows are read once per arm; each arm's fit is itself distributed.
    """
    out = None
    for arm in arms:
        model = train(train_rows, features, target, kind, **arm.params)
        got = metrics.evaluate(predict(model, val_rows), "prediction", target)
        got = got.select(F.lit(arm.name).alias("name"), F.lit(arm.rationale).alias("rationale"), F.lit(json.dumps(arm.params, sort_keys=True)).alias("params"), "*")
        out = got if out is None else out.unionByName(got)
    return out.orderBy(F.asc_nulls_last("rmse"), "name")


EPOCHS = "array<struct<epoch:int,train_loss:double,val_rmse:double,val_mae:double,val_mae_cp:double,val_sign_agreement:double,val_spearman:double,seconds:double,learning_rate:double>>"


def histories(spark: SparkSession, path: str) -> DataFrame:
    """One row per epoch of training histories kept as JSON files (run_name, epochs)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json("value", f"struct<run_name:string,epochs:{EPOCHS}>").alias("h")).select("h.run_name", F.inline("h.epochs"))


def best_epochs(epochs: DataFrame) -> DataFrame:
    """Each run's epoch of least validation RMSE, the first of equals."""
    return epochs.groupBy("run_name").agg(F.min_by(F.struct("epoch", "val_rmse"), F.struct("val_rmse", "epoch")).alias("b")).select("run_name", "b.*")


def overfit_ratios(epochs: DataFrame) -> DataFrame:
    """Every epoch with squared validation RMSE over training loss; null where the loss is zero."""
    return epochs.withColumn("ratio", F.try_divide(F.pow("val_rmse", F.lit(2.0)), F.col("train_loss")))


def diagnosis(epochs: DataFrame) -> DataFrame:
    """Each run's last epoch: squared validation RMSE over training loss, and a verdict."""
    last = epochs.groupBy("run_name").agg(F.max_by(F.struct("epoch", "train_loss", "val_rmse"), "epoch").alias("l")).select("run_name", "l.*")
    ratio = F.try_divide(F.pow("val_rmse", F.lit(2.0)), F.col("train_loss"))
    verdict = F.when(ratio < 1.4, "fits").when(ratio < 2.5, "overfits somewhat").when(ratio.isNotNull(), "overfits")
    return last.withColumn("ratio", ratio).withColumn("verdict", verdict).orderBy("ratio")


def scaling(results: DataFrame) -> DataFrame:
    """RMSE at growing volumes with the change from the volume before."""
    from pyspark.sql import Window

    before = F.lag("rmse").over(Window.orderBy("volume"))
    return results.withColumn("improvement", F.col("rmse") / before - 1)
