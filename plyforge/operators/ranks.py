"""Ranks and exact percentiles of columns with any number of distinct values, without sorting a group in one task.

The distinct values are counted with map-side combining and partitioned by value range; within a range counts are
summed up, and a small table of range totals says where each range begins. So neither a group nor a value that a third
of all rows share is gathered in one place, and no aggregation buffer holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge import session
from plyforge.operators.skew import hot_join


def renamed(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the columns under other names, for ``matching``."""
    return df.withColumnsRenamed({c: f"_same_{c}" for c in cols})


def matching(cols: list[str]) -> Column:
    """The join condition that columns equal the ``renamed`` ones, nulls being equal to each other."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    return out


def running_counts(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """(by, _col, _v, _n, _upto): each value of each numeric column with its rows and those up to it; nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols])
    long = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*").filter("_v is not null")
    n = long.groupBy(*by, "_col", "_v").agg(F.count(F.lit(1)).alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = session.cut(n.repartitionByRange(parts, "_col", *by, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    keys = ["_part", "_col", *by]
    totals = ranged.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy("_col", *by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_upto", F.sum("_n").over(inner))
    return local.join(renamed(shifts, keys), matching(keys)).select(*by, "_col", "_v", "_n", (F.col("_upto") + F.col("_shift")).alias("_upto"))


def average_ranks(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Ranks with ties averaged within each group (a null ``by`` is a group), as ``rank_<col>``; null for null values.

    Rows get their ranks by a join in which values that many rows share are joined where the rows lie.
    """
    ranks = session.cut(running_counts(df, cols, by), "ranks")
    total = df.count()
    out = df
    for c in cols:
        # a struct is equal where its fields are, nulls included
        key = lambda v: F.struct(*[F.col(b) for b in by], v.alias("_v"))
        table = ranks.filter(F.col("_col") == c).select(key(F.col("_v")).alias("_key"), "_n", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"rank_{c}"))
        out = hot_join(out.withColumn("_key", key(F.col(c).cast("double"))), table, "_key", "_n", total, how="left").drop("_key", "_n")
    return out


def percentiles(df: DataFrame, col: str, pcts: list[float], by: list[str]) -> DataFrame:
    """(by, pct, value): exact percentiles by linear interpolation between the two nearest ranks; nulls are not counted."""
    counts = running_counts(df, [col], by)
    # the row that has a group's largest value says how many rows the group has; it is needed before the ranks are sought
    counts = session.cut(counts, "percentile-counts")
    total = renamed(counts.groupBy(*by).agg(F.max("_upto").alias("_total")), by)
    both = counts.join(total, matching(by)).select(*by, "_v", "_upto", "_total")
    found = []
    for k, p in enumerate(pcts):
        place = (F.col("_total") - 1) * F.lit(p / 100)
        found += [F.min(F.when(F.col("_upto") > F.floor(place), F.col("_v"))).alias(f"_a{k}"), F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_v"))).alias(f"_z{k}")]
    got = both.groupBy(*by, "_total").agg(*found)
    rows = []
    for k, p in enumerate(pcts):
        place = (F.col("_total") - 1) * F.lit(p / 100)
        rows.append(F.struct(F.lit(p).alias("pct"), (F.col(f"_a{k}") + (F.col(f"_z{k}") - F.col(f"_a{k}")) * (place - F.floor(place))).alias("value")))
    return got.select(*by, F.inline(F.array(*rows)))
