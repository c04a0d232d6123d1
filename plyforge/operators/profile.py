"""Profiles of a table: counts with shares, histograms, percentiles, bands, survival, yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge import session
from plyforge.operators import ranks
from plyforge.operators.metrics import correlation

# Bands of the absolute value, and thresholds of depth.
BANDS = ((0.0, 0.05), (0.05, 0.20), (0.20, 0.50), (0.50, 1.01))
DEPTHS = (0, 12, 16, 20, 25, 30)


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows and share of all rows for each value (null included)."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return with_share(n)


def with_share(counts: DataFrame, n: str = "n", name: str = "share") -> DataFrame:
    """Add each row's share of the sum of ``n``; the sum is a table of one row, so the counts stay where they are."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn(name, F.col(n) / F.col("_total")).drop("_total")


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by, bin, n): bins from 0, the last one closed; values outside and nulls are not counted."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(col).cast("double") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = df.filter(F.col(col).between(low, high))
    return inside.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, col: str, pcts: tuple[int, ...] = (1, 5, 25, 50, 75, 95, 99)) -> DataFrame:
    """(pct, value) by linear interpolation, exact; from counts of the distinct values (``ranks``)."""
    return ranks.percentiles(df, col, list(pcts), [])


def band(value: Column) -> Column:
    """Which band of BANDS the absolute value lies in; null outside all."""
    out = None
    for k, (low, high) in enumerate(BANDS):
        hit = (F.abs(value) >= low) & (F.abs(value) < high)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def by_turn(df: DataFrame, value: str) -> DataFrame:
    """Mean, population spread, median and mean absolute value for each side to move."""
    v = F.col(value).cast("double")
    got = df.groupBy("turn_white").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg(F.abs(v)).alias("mean_abs"))
    middle = ranks.renamed(ranks.percentiles(df, value, [50], ["turn_white"]), ["turn_white"])
    return got.join(middle, ranks.matching(["turn_white"]), "left").select("turn_white", "n", "mean", "std", F.col("value").alias("median"), "mean_abs")


def by_ply(df: DataFrame, value: str, width: int = 10, least: int = 30) -> DataFrame:
    """Mean absolute value in buckets of ply with at least ``least`` rows."""
    return (
        df.filter(F.col("ply").isNotNull())
        .groupBy(F.floor(F.col("ply") / width).cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(value).cast("double"))).alias("mean_abs"))
        .filter(F.col("n") >= least)
    )


def cumulative_share(df: DataFrame, col: str) -> DataFrame:
    """Rows of each value and the share of rows with at least that value."""
    counts = session.cut(ranks.running_counts(df, [col], []), "cumulative")
    total = counts.agg(F.max("_upto").alias("_total"))
    least = (F.col("_total") - F.col("_upto") + F.col("_n")) / F.col("_total")
    return counts.crossJoin(F.broadcast(total)).select(F.col("_v").cast(df.schema[col].dataType).alias(col), F.col("_n").alias("n"), least.alias("from_top"))


def survival(df: DataFrame, col: str, thresholds: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Share of rows at or above each threshold, in one pass."""
    rows = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(col) >= t).alias("kept"), F.count(F.lit(1)).alias("n")) for t in thresholds]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).withColumn("share", F.try_divide(F.col("kept").cast("double"), F.col("n")))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows for each pair of values, with totals of both margins (the cube's nulls are named by the flags)."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).cast("int").alias("all_a"), F.grouping(b).cast("int").alias("all_b"))


def duplicate_rate(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, share repeated."""
    n, d = F.count(key), F.count_distinct(key)
    return df.agg(n.alias("n"), d.alias("n_distinct"), F.coalesce(F.lit(1.0) - F.try_divide(d.cast("double"), n), F.lit(0.0)).alias("rate"))


def material_band(balance: Column) -> Column:
    """How clear a material balance is: 0 below 1, 1 below 3, 2 below 5, 3 below 9, 4 from 9."""
    b = F.abs(balance)
    return F.when(b < 1, 0).when(b < 3, 1).when(b < 5, 2).when(b < 9, 3).when(b.isNotNull(), 4)


def label_convention(df: DataFrame, material: str, value: str, least: int = 3, by: tuple[str, ...] = ("turn_white",)) -> DataFrame:
    """For each side to move (or other ``by``, as shard and material band): how often the value's sign agrees with a
    clear material balance, and their correlation."""
    clear = F.abs(F.col(material)) >= least
    agree = F.when(clear, (F.signum(F.col(material)) == F.signum(F.col(value))).cast("int"))
    return df.groupBy(*by).agg(
        F.count_if(clear).alias("n_clear"), F.avg(agree).alias("agreement"), correlation(F.col(material).cast("double"), F.col(value).cast("double")).alias("correlation")
    )


def yield_projection(stats: DataFrame, games_per_month: float, per_game: int, target: float) -> DataFrame:
    """Positions a month would give at the acceptance rate of ``stats``, and months needed for ``target``."""
    monthly = F.col("acceptance_rate") * F.lit(games_per_month) * F.lit(per_game)
    return stats.withColumn("positions_per_month", monthly).withColumn("months_needed", F.ceil(F.try_divide(F.lit(target), monthly)))


def shard_yield(rows: DataFrame, per_shard_games: int, per_game: int = 4) -> DataFrame:
    """Rows of each shard of ``game_seq`` and their share of what that many games could give."""
    shard = F.floor((F.col("game_seq") - 1) / per_shard_games).cast("int").alias("shard")
    n = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n_positions"), F.count_distinct("game_seq").alias("n_games"))
    return n.withColumn("share_of_ceiling", F.col("n_positions") / F.lit(float(per_shard_games * per_game)))
