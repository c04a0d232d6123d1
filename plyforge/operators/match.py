"""Statistics of matches: points, Elo differences, a rating pooled over opponents, move quality, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.operators import ranks

# Games end at the latest after so many half-moves; a move losing more centipawns than this is a blunder.
MAX_PLIES, BLUNDER = 400, 300.0
UNFINISHED = ("max_plies", "interrupted")


def match_stats(games: DataFrame, by: list[str]) -> DataFrame:
    """Per group of games (score 1, 0.5 or 0; termination; plies): record, rate, standard error, Elo difference.

    A clean sweep has an infinite difference; the error of fewer than two games is null.
    """
    n, rate = F.count("score"), F.avg("score")
    stats = games.groupBy(*by).agg(
        n.alias("n"),
        F.count_if(F.col("score") == 1).alias("won"),
        F.count_if(F.col("score") == 0.5).alias("drawn"),
        F.count_if((F.col("score") != 1) & (F.col("score") != 0.5)).alias("lost"),
        F.count_if(F.col("termination").isin(*UNFINISHED)).alias("unfinished"),
        rate.alias("score_rate"),
        (F.stddev_samp("score") / F.sqrt(n)).alias("margin"),
        F.avg("plies").alias("mean_plies"),
    )
    r = F.col("score_rate")
    diff = F.when(r >= 1, F.lit(float("inf"))).when(r <= 0, F.lit(float("-inf"))).when(r.isNotNull(), 400 * F.log10(r / (1 - r)))
    return stats.withColumn("elo_difference", diff)


def draws_by_termination(games: DataFrame) -> DataFrame:
    return games.filter("score = 0.5").groupBy("termination").agg(F.count(F.lit(1)).alias("n"))


def pooled_elo(results: DataFrame, by: list[str] | None = None, margin: float = 2000.0, step: float = 1.0) -> DataFrame:
    """The rating most likely to give the scores against opponents of known rating, for each group.

    ``results`` has by, opponent_elo, n and score_rate. ``sigma`` is half the width of the ratings whose log-likelihood
    is within 0.5 of the best. A sweep, or a best at the grid's end, is infinite with a null sigma. The grid is a
    sequence per group, so its size depends on the ratings' range, not on the games.
    """
    by = by or []
    rows = results.filter("n > 0")
    span = rows.groupBy(*by).agg(
        F.min("opponent_elo").cast("double").alias("lo"), F.max("opponent_elo").cast("double").alias("hi"),
        F.sum("n").alias("games"), F.min("score_rate").alias("worst"), F.max("score_rate").alias("top"),
        F.collect_list(F.struct(F.col("opponent_elo").cast("double").alias("o"), F.col("n").cast("double").alias("n"), "score_rate")).alias("rivals"),
    )
    steps = F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo") + 2 * margin) / step).cast("int"))
    grid = span.withColumn("k", F.explode(steps)).withColumn("rating", F.col("lo") - margin + F.col("k") * step)

    def term(total, r):
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.pow(F.lit(10.0), (r["o"] - F.col("rating")) / 400))))
        return total + r["n"] * (r["score_rate"] * F.ln(p) + (1 - r["score_rate"]) * F.ln(1 - p))

    like = grid.withColumn("ll", F.aggregate("rivals", F.lit(0.0), term))
    w = Window.partitionBy(*by)
    like = like.withColumn("best", F.max("ll").over(w))
    fit = like.groupBy(*by).agg(
        F.first("games").alias("games"), F.first("worst").alias("worst"), F.first("top").alias("top"), F.max("rating").alias("end"), F.min("rating").alias("start"),
        F.min(F.when(F.col("ll") == F.col("best"), F.col("rating"))).alias("at"),
        ((F.max(F.when(F.col("ll") >= F.col("best") - 0.5, F.col("rating"))) - F.min(F.when(F.col("ll") >= F.col("best") - 0.5, F.col("rating")))) / 2).alias("half"),
    )
    up = (F.col("worst") >= 1) | (F.col("at") == F.col("end"))
    down = (F.col("top") <= 0) | (F.col("at") == F.col("start"))
    rating = F.when(up, F.lit(float("inf"))).when(down, F.lit(float("-inf"))).otherwise(F.col("at"))
    return fit.select(*by, "games", rating.alias("rating"), F.when(~up & ~down, F.col("half")).alias("sigma"))


def pairings(openings: DataFrame) -> DataFrame:
    """Every opening with either colour."""
    return openings.withColumn("engine_white", F.explode(F.array(F.lit(True), F.lit(False))))


def move_quality(moves: DataFrame, by: list[str], threshold: float = BLUNDER) -> DataFrame:
    """ACPL with its error, median loss, agreement and blunder rate of moves (loss_cp, agrees)."""
    loss = F.col("loss_cp")
    got = moves.groupBy(*by).agg(
        F.count(loss).alias("n"),
        F.avg(loss).alias("acpl"),
        (F.stddev_samp(loss) / F.sqrt(F.count(loss))).alias("acpl_se"),
        F.avg(F.col("agrees").cast("int")).alias("agreement"),
        F.avg((loss > threshold).cast("int")).alias("blunder_rate"),
    )
    middle = ranks.renamed(ranks.percentiles(moves, "loss_cp", [50], by), by)
    return got.join(middle, ranks.matching(by), "left").select(*got.columns, F.col("value").alias("median_loss"))


def latency(times: DataFrame, by: list[str], limit_ms: float = 5000.0) -> DataFrame:
    """Median, 99th percentile and longest time of each group, and how often the limit holds the 99th percentile."""
    at = lambda p: F.max(F.when(F.col("pct") == p, F.col("value")))
    p = ranks.percentiles(times, "ms", [50, 99, 100], by).groupBy(*by).agg(at(50).alias("p50"), at(99).alias("p99"), at(100).alias("longest"))
    return p.withColumn("headroom", F.lit(limit_ms) / F.col("p99"))


def match_text(stats: DataFrame, by: list[str]) -> DataFrame:
    """The record of ``match_stats`` as one line for each group."""
    diff = F.when(F.col("elo_difference") == float("inf"), "+inf").when(F.col("elo_difference") == float("-inf"), "-inf")
    line = F.concat(
        F.format_string("%d games: +%d =%d -%d (%.1f %% / %.1f %% / %.1f %%), rate %.3f", "n", "won", "drawn", "lost", *[100 * F.col(c) / F.col("n") for c in ("won", "drawn", "lost")], "score_rate"),
        F.when(F.col("margin").isNotNull(), F.format_string(" +- %.3f", "margin")).otherwise(""), F.lit(", Elo "),
        F.coalesce(diff, F.when(F.col("elo_difference").isNotNull(), F.format_string("%+.0f", "elo_difference")), F.lit("unknown")),
        F.when(F.col("unfinished") > 0, F.format_string(", %d unfinished", "unfinished")).otherwise(""),
    )
    return stats.select(*by, F.when(F.col("n") > 0, line).otherwise("no games").alias("summary"))


def elo_text(pooled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The rating of ``pooled_elo`` as one line; without bounds where every game was won or lost."""
    free = F.format_string("Elo %.0f +- %.0f (%d games)", "rating", "sigma", "games")
    line = F.when(F.col("sigma").isNotNull(), free).otherwise(F.format_string("Elo %s all opponents (%d games)", F.when(F.col("rating") > 0, "above").otherwise("below"), "games"))
    return pooled.select(*(by or []), line.alias("summary"))


def quality_text(quality: DataFrame, by: list[str]) -> DataFrame:
    """The move quality of each group as one line."""
    line = F.format_string(
        "ACPL %.1f +- %.1f (median %.1f), agreement %.1f %%, blunders %.1f %%, n %d", "acpl", F.coalesce("acpl_se", F.lit(0.0)), "median_loss",
        100 * F.col("agreement"), 100 * F.col("blunder_rate"), "n",
    )
    return quality.select(*by, line.alias("summary"))


def coherence(df: DataFrame, predicted_cp: str, actual_cp: str, clear: int = 100) -> DataFrame:
    """How many clear positions have the right sign, and how many even ones are seen as even."""
    p, a = F.col(predicted_cp), F.col(actual_cp)
    decided = F.abs(a) >= clear
    return df.agg(
        F.count_if(decided).alias("n_clear"), F.count_if(decided & (F.signum(p) == F.signum(a))).alias("right_sign"),
        F.count_if(~decided).alias("n_even"), F.count_if(~decided & (F.abs(p) < clear)).alias("seen_even"),
    )


def estimated_seconds(openings: int, seconds_per_move: float, plies: int = 80) -> float:
    return openings * 2 * plies * seconds_per_move
