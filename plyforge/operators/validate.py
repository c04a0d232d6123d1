"""Integrity checks and description of a dataset, each in one pass over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge import session
from plyforge.config import DatasetConfig
from plyforge.functions import rules
from plyforge.sources.shards import SCHEMA

CHECKS = (
    "no_duplicate_positions", "colour_balance", "label_range", "no_nulls", "elo_threshold", "sign_invariant", "mate_flags",
)


def check_rows(dataset: DataFrame, cfg: DatasetConfig | None = None) -> DataFrame:
    """(name, passed, violations) of every check that columns can express.

    ``violations`` is the number of rows (for the balance: of rows beyond the limit; for nulls: of values) that break
    the check. An empty table fails balance, label range and ratings, having nothing to show.
    """
    cfg = cfg or DatasetConfig()
    n = F.count(F.lit(1))
    cp = F.when(F.col("turn_white"), F.col("cp_stm")).otherwise(-F.col("cp_stm"))
    value = F.when(F.col("turn_white"), F.col("value_stm")).otherwise(-F.col("value_stm"))
    known = F.col("turn_white").isNotNull()
    in_range = [F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(-1, 1) for c in ("value_white", "value_stm")]
    white = F.count_if("turn_white")
    counts = dataset.agg(
        n.alias("n"),
        (n - F.count_distinct("pos_key")).alias("no_duplicate_positions"),
        F.greatest(white, n - white).alias("larger"),
        F.count_if(~(in_range[0] & in_range[1])).alias("label_range"),
        sum((F.count_if(F.col(c).isNull()) for c in SCHEMA.names), F.lit(0)).alias("no_nulls"),
        F.count_if((F.col("white_elo") < cfg.filter.min_elo) | (F.col("black_elo") < cfg.filter.min_elo)).alias("low_elo"),
        F.least(F.count("white_elo"), F.count("black_elo")).alias("elos"),
        F.count_if(~F.coalesce(known & (F.col("cp_white") == cp) & (F.abs(F.col("value_white") - value) < 1e-6), F.lit(False))).alias("sign_invariant"),
        F.count_if(
            ~F.coalesce((F.col("is_mate") == (F.col("mate_in") != 0)), F.lit(False))
            | F.coalesce(F.col("is_mate") & (F.abs("cp_white") != cfg.normalization.cp_clip), F.lit(False))
        ).alias("mate_flags"),
    )
    limit = cfg.validation.max_turn_share
    counts = counts.select(
        "*",
        F.greatest(F.lit(0), F.ceil(F.col("larger") - F.lit(limit) * F.col("n"))).alias("colour_balance"),
        F.col("low_elo").alias("elo_threshold"),
    )
    empty = F.col("n") == 0
    passed = {name: F.col(name) == 0 for name in CHECKS}
    passed["colour_balance"] = ~empty & (F.col("larger") <= F.lit(limit) * F.col("n"))
    passed["label_range"] = ~empty & passed["label_range"]
    passed["elo_threshold"] = (F.col("elos") > 0) & passed["elo_threshold"]
    rows = [F.struct(F.lit(c).alias("name"), passed[c].alias("passed"), F.col(c).cast("bigint").alias("violations")) for c in CHECKS]
    return counts.select(F.inline(F.array(*rows)))


def legality(dataset: DataFrame, fen: str = "fen") -> DataFrame:
    """One row: positions checked, unparseable and terminal ones. Every row is checked, none sampled."""
    state = session.spread(dataset.select(fen)).select(rules.status(F.col(fen)).alias("s"))
    return state.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("s").isNull() | (F.col("s") == "unparseable")).alias("unparseable"),
        F.count_if(F.col("s").isin(*rules.ENDED)).alias("terminal"),
    )


def validate(dataset: DataFrame, cfg: DatasetConfig | None = None) -> DataFrame:
    """All checks, legality included: (name, passed, violations)."""
    legal = legality(dataset).select(
        F.lit("fen_legality").alias("name"),
        ((F.col("checked") > 0) & (F.col("unparseable") + F.col("terminal") == 0)).alias("passed"),
        (F.col("unparseable") + F.col("terminal")).alias("violations"),
    )
    return check_rows(dataset, cfg).unionByName(legal)


def summary(report: DataFrame) -> DataFrame:
    """One row: whether all passed, and the failed checks' names."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return report.agg(F.bool_and("passed").alias("passed"), F.array_join(failed, ", ").alias("failures"))


def describe(dataset: DataFrame) -> DataFrame:
    """One row of descriptive figures; the spread is that of the population, shares of an empty table are null."""
    n = F.count(F.lit(1))
    return dataset.agg(
        n.alias("n_positions"),
        F.count_distinct("game_id").alias("n_games"),
        F.try_divide(F.count_if("turn_white").cast("double"), n).alias("white_to_move_share"),
        F.try_divide(F.count_if("is_mate").cast("double"), n).alias("mate_share"),
        F.avg("value_white").alias("value_mean"),
        F.stddev_pop("value_white").alias("value_std"),
        F.min("value_white").alias("value_min"),
        F.max("value_white").alias("value_max"),
        F.avg("white_elo").alias("mean_white_elo"),
        F.avg("black_elo").alias("mean_black_elo"),
        F.avg("ply").alias("mean_ply"),
    )
