"""Joins and ranks that a key with a large share of all rows does not send to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in HOT_SHARE; there are fewer such keys than that, so they may be broadcast.
HOT_SHARE = 500


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table``, unique on ``key``, where ``table[count]`` says how many rows have the key.

    Hot keys (above ``total / HOT_SHARE`` rows, so fewer than ``HOT_SHARE`` of them) are joined where the rows lie,
    by broadcast; all others by an ordinary shuffled join. No row is dropped; null keys match nothing.
    """
    limit = max(1, total // HOT_SHARE)
    hot = table.filter(F.col(count) > limit)
    near = rows.join(F.broadcast(hot), key, "inner")
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col(count) <= limit), key, how)
    return near.unionByName(far.select(near.columns))


def bucket_count(rows: int, per_bucket: int = 100_000, least: int = 64) -> int:
    """Over how many buckets to spread ``rows`` so that none is large, even if one group has them all."""
    return max(least, -(-rows // per_bucket))


def numbered(
    df: DataFrame, groups: list[str], order: list[Column], buckets: int, salt: Column, name: str = "place", starts: DataFrame | None = None, start: str = ""
) -> DataFrame:
    """Number the rows of each group from 0, in an order that is random by ``salt`` and fixed by ``order``.

    ``salt`` (a uniform long) spreads a group over ``buckets``; each (group, bucket) is numbered by itself and shifted
    by the sizes of the buckets before it. The table of sizes has at most groups x buckets rows. With ``starts``
    (groups and a column ``start``) a group's numbers begin there.
    """
    spread = df.withColumn("_bucket", F.pmod(salt, F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*groups, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    if starts is not None:
        shifts = shifts.join(starts, groups).select(*groups, "_bucket", (F.col("_shift") + F.col(start)).alias("_shift"))
    inner = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    ranked = spread.withColumn("_local", F.row_number().over(inner) - 1)
    on = [ranked[c].eqNullSafe(shifts[c]) for c in [*groups, "_bucket"]]
    return (
        ranked.join(shifts, on, "inner")
        .select(*[ranked[c] for c in df.columns], (F.col("_shift") + F.col("_local")).alias(name))
    )


def sequenced(df: DataFrame, col: str, name: str = "rank", block: int = 4096) -> DataFrame:
    """Number rows from 1 in the order of the whole number ``col`` (ties in any order); rows without one are left out.

    Blocks of ``block`` successive values are numbered apart and shifted by the sizes of those before, so a sequence
    without large gaps is never sorted as a whole; the table of blocks has a row for each ``block`` values that occur.
    """
    cut = df.filter(F.col(col).isNotNull()).withColumn("_block", F.floor(F.col(col) / block))
    sizes = cut.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inner = F.row_number().over(Window.partitionBy("_block").orderBy(col))
    return cut.withColumn("_local", inner).join(shifts, "_block").withColumn(name, F.col("_shift") + F.col("_local")).select(*df.columns, name)


def placed_by_value(df: DataFrame, groups: list[str], value: str, salt: Column, tie: list[Column], name: str = "place") -> DataFrame:
    """Number the rows of each group from 0 in the order of ``value``, rows of one value in an order random by ``salt``.

    The distinct values of a group are counted and their counts summed up; rows of one value are numbered in buckets
    (``numbered``), so neither a group nor a value is ever sorted as a whole. ``groups`` and ``value`` are not null.
    """
    keys = [*groups, value]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), "_n")
    most = sizes.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    local = numbered(df, keys, [salt, *tie], bucket_count(most, least=1), salt, "_within", starts.drop("_n"), "_start")
    return local.withColumnRenamed("_within", name)
