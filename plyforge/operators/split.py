"""Leakage-free splits by game: a hash of the game decides for all its rows."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.config import SplitConfig
from plyforge.functions.keys import unit_hash
from plyforge.operators import profile


def game_position(game_id: str, seed: int) -> float:
    """The game's place in [0, 1) by blake2b, as earlier datasets have it."""
    data = hashlib.blake2b(f"{seed}:{game_id}".encode(), digest_size=8).digest()
    return int.from_bytes(data, "big") / 2.0**64


def _by_place(place: Column, cfg: SplitConfig) -> Column:
    first, second = cfg.bounds
    return F.when(place < first, "train").when(place < second, "val").when(place.isNotNull(), "test")


def keyed_split(game: Column, cfg: SplitConfig | None = None) -> Column:
    """The split by blake2b (leaves the JVM); null for a null game."""
    cfg = cfg or SplitConfig()

    @F.pandas_udf(T.DoubleType())
    def place(ids: pd.Series) -> pd.Series:
        known = {g: game_position(g, cfg.seed) for g in ids.dropna().unique()}
        return ids.map(known).astype(float)

    return _by_place(place(game), cfg)


def hashed_split(game: Column, cfg: SplitConfig | None = None) -> Column:
    """The split by SHA-256, JVM-side and the same in any SQL engine; null for a null game."""
    cfg = cfg or SplitConfig()
    return F.when(game.isNotNull(), _by_place(unit_hash(cfg.seed, game), cfg))


def describe_split(df: DataFrame, split: str = "split", game: str = "game_id") -> DataFrame:
    """Rows, share and games of each split."""
    n = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(game).alias("n_games"))
    return profile.with_share(n)


def split_masks(split: Column, name: str = "masks") -> Column:
    """A struct of three flags, in_train, in_val and in_test; a null split is in none."""
    return F.struct(*[F.coalesce(split == s, F.lit(False)).alias(f"in_{s}") for s in ("train", "val", "test")]).alias(name)


def leaked_games(df: DataFrame, split: str = "split", game: str | list[str] = "game_id") -> DataFrame:
    """Games (or combinations of several columns, as seed and game) with rows in more than one split; must be empty."""
    both = df.filter(F.col(split).isNotNull()).groupBy(game).agg(F.min(split).alias("_a"), F.max(split).alias("_b"))
    return both.filter("_a != _b").select(game)


def block_split(seq: Column, block: int = 1000, cycle: int = 20) -> Column:
    """Systematic split of numbered rows: of each ``cycle`` blocks the first is val, the second test."""
    part = F.pmod(F.floor(seq / block), F.lit(cycle))
    return F.when(part == 1, "test").when(part == 0, "val").otherwise("train")


def nested_samples(df: DataFrame, key: str, volumes: list[int], seed: int) -> DataFrame:
    """Rows of a fixed random order with the smallest volume each belongs to: smaller samples lie within larger ones.

    The order is by hash; the hashes below which the volumes end are found from counts of hash slots, so rows are
    ranked only inside the slots where a volume ends.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    rows = df.withColumn("_h", h).withColumn("_slot", F.shiftright(h, 48))
    # 65,536 slots at most, whatever the number of rows
    slots = rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    def volume(rank: Column) -> Column:
        out = F.lit(None).cast("bigint")
        for v in sorted(volumes, reverse=True):
            out = F.when(rank <= v, F.lit(v).cast("bigint")).otherwise(out)
        return out

    # a slot in which no volume ends lies in one sample as a whole
    slots = slots.withColumn("_first", volume(F.col("_before") + 1)).withColumn("_last", volume(F.col("_before") + F.col("_n")))
    placed = rows.join(F.broadcast(slots.filter("_first is not null")), "_slot")
    whole = placed.filter("_first <=> _last").select(*df.columns, F.col("_first").alias("volume"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_slot").orderBy("_h", key))
    part = placed.filter("not (_first <=> _last)").withColumn("volume", volume(rank)).select(*df.columns, "volume")
    return whole.unionByName(part).filter("volume is not null")
