"""Metrics of predicted against actual values, and baselines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge import session
from plyforge.functions.scoring import CLIP, SCALE, bounded, value_to_cp
from plyforge.operators.ranks import average_ranks

DEADBAND = 0.05


def rmse(p: Column, a: Column) -> Column:
    return F.sqrt(F.avg(F.pow(p - a, F.lit(2.0))))


def mae(p: Column, a: Column) -> Column:
    return F.avg(F.abs(p - a))


def sign_agreement(p: Column, a: Column, deadband: float = DEADBAND) -> Column:
    """Share of rows beyond the dead band in which the signs agree; null without any."""
    return F.avg(F.when(F.abs(a) > deadband, (F.signum(p) == F.signum(a)).cast("int")))


def huber(p: Column, a: Column, delta: float = 0.1) -> Column:
    e = F.abs(p - a)
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def saturated_share(a: Column, threshold: float = 0.99) -> Column:
    return F.avg((F.abs(a) >= threshold).cast("int"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of rows with both values; null where a side is constant (``corr`` divides by zero then)."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0)))


def evaluate(df: DataFrame, predicted: str, actual: str, by: list[str] | None = None, scale: float = SCALE, clip: int = CLIP) -> DataFrame:
    """n, rmse, mae, mae_cp, sign_agreement, spearman for each group; rows with a null in either are left out.

    A null ``by`` is a group of its own. Spearman is null for fewer than two rows or a constant side.
    """
    by = by or []
    rows = df.select(*by, F.col(predicted).cast("double").alias("p"), F.col(actual).cast("double").alias("a"))
    # cut before the filter, which would be pushed below the prediction and evaluate it twice
    rows = session.cut(rows, "evaluated").filter("p is not null and a is not null")
    ranked = average_ranks(rows, ["p", "a"], by)
    p, a = F.col("p"), F.col("a")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rmse(p, a).alias("rmse"),
        mae(p, a).alias("mae"),
        F.avg(F.abs(value_to_cp(p, scale, clip) - value_to_cp(a, scale, clip))).alias("mae_cp"),
        sign_agreement(p, a).alias("sign_agreement"),
        correlation(F.col("rank_p"), F.col("rank_a")).alias("spearman"),
    )


def evaluation_text(metrics: DataFrame) -> DataFrame:
    """The metrics of ``evaluate`` as one line each."""
    part = F.format_string("rmse %.4f  mae %.4f (%.1f cp)  sign %.2f %%  rho %.4f  n %d", "rmse", "mae", "mae_cp", F.col("sign_agreement") * 100, "spearman", "n")
    return metrics.select(*[c for c in metrics.columns if c not in ("n", "rmse", "mae", "mae_cp", "sign_agreement", "spearman")], part.alias("summary"))


def score_text(name: str, scores: DataFrame) -> DataFrame:
    """A baseline's scores (rmse, mae) as one line."""
    return scores.select(F.format_string(f"{name}: rmse %.4f  mae %.4f", "rmse", "mae").alias("summary"))


def rmse_map(**baselines: DataFrame) -> dict[str, float]:
    """The RMSE of each named baseline (one-row tables) as a number."""
    return {name: float(scores.first()["rmse"]) for name, scores in baselines.items()}


def rank_agreement(models: DataFrame, error: str, strength: str) -> DataFrame:
    """One row: rank correlation over models of an error against playing strength, and what it says of the error as a guide.

    ``follows``: the smaller the error the stronger (correlation of at most -0.8); ``partly`` up to -0.3; else ``does not``.
    """
    rows = models.select(F.col(error).cast("double").alias("e"), F.col(strength).cast("double").alias("s")).filter("e is not null and s is not null")
    ranked = average_ranks(rows, ["e", "s"], [])
    rho = ranked.agg(F.count(F.lit(1)).alias("models"), correlation(F.col("rank_e"), F.col("rank_s")).alias("rho"))
    return rho.withColumn("verdict", F.when(F.col("rho") <= -0.8, "follows").when(F.col("rho") <= -0.3, "partly").when(F.col("rho").isNotNull(), "does not"))


def throughput(times: DataFrame) -> DataFrame:
    """(model, batch, positions_per_second, best) of timed batches (model, batch, seconds): totals over all repetitions."""
    t = times.filter("seconds > 0").groupBy("model", "batch").agg(F.sum("batch").alias("_n"), F.sum("seconds").alias("_s"))
    t = t.select("model", "batch", (F.col("_n") / F.col("_s")).alias("positions_per_second"))
    top = t.groupBy("model").agg(F.max("positions_per_second").alias("_top"))
    return t.join(top, "model").select("model", "batch", "positions_per_second", (F.col("positions_per_second") == F.col("_top")).alias("best"))


def r_squared(rmse_col: Column, floor: Column) -> Column:
    return 1 - F.pow(rmse_col / floor, F.lit(2.0))


def mean_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """One row: RMSE and MAE on ``test`` of predicting the mean of ``train``."""
    mean = train.agg(F.avg(F.col(target).cast("double"))).first()[0]
    p, a = F.lit(mean).cast("double"), F.col(target).cast("double")
    return test.agg(rmse(p, a).alias("rmse"), mae(p, a).alias("mae"))


def material_baseline(train: DataFrame, test: DataFrame, features: list[str], target: str):
    """Least squares on material differences: (scores on ``test``, weights with the bias last). Predictions are clipped to +-1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    parts = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    fit = LinearRegression(solver="normal", labelCol=target, featuresCol="features").fit(parts.transform(train).filter(F.col(target).isNotNull()))
    guess = fit.transform(parts.transform(test).filter(F.col(target).isNotNull()))
    p, a = bounded(F.col("prediction"), 1.0), F.col(target)
    scores = guess.agg(rmse(p, a).alias("rmse"), mae(p, a).alias("mae"))
    return scores, [*fit.coefficients, fit.intercept]


def describe_weights(weights: list[float], names: tuple[str, ...] = ("pawn", "knight", "bishop", "rook", "queen", "king")) -> str:
    """The weights as text, relative to the pawn's where that is positive."""
    pawn = weights[0]
    lines = [f"{n:<8}{w:>10.4f}" + (f"{w / pawn:>8.2f}" if pawn > 1e-9 else f"{'-':>8}") for n, w in zip(names, weights)]
    return "\n".join([*lines, f"{'bias':<8}{weights[-1]:>10.4f}"])


def reconstruction(df: DataFrame, cp: str, value: str) -> DataFrame:
    """Largest and mean error of centipawns got back from values."""
    err = F.abs(F.col(cp) - value_to_cp(F.col(value)))
    return df.agg(F.max(err).alias("max_error"), F.avg(err).alias("mean_error"))


def coverage(df: DataFrame, predicted: str) -> DataFrame:
    """Share of predictions within [-1, 1], least and largest."""
    p = F.col(predicted)
    return df.agg(F.avg((F.abs(p) <= 1).cast("int")).alias("within"), F.min(p).alias("least"), F.max(p).alias("largest"))


def distinguishable(mean1: float, se1: float, mean2: float, se2: float) -> bool:
    """Whether two means differ by at least two combined standard errors."""
    return abs(mean1 - mean2) >= 2 * math.sqrt(se1**2 + se2**2)
