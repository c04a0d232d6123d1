"""Header predicate over games, scan statistics, extracts, first occurrences, sampled positions."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.config import FilterConfig, SamplingConfig
from plyforge.functions import keys, refs, rules
from plyforge.operators.skew import bucket_count, numbered


def elo(text: Column) -> Column:
    """A rating written as a whole number; null for ``?`` and anything else."""
    word = refs.stripped(text)
    return F.when(word.rlike(r"^[+-]?\d{1,9}$"), word).cast("int")


def accepts(cfg: FilterConfig | None = None) -> Column:
    """Whether a game passes by its headers alone (columns event_text, time_control, ratings, termination); never null.

    A missing termination passes, a missing rating or category does not.
    """
    cfg = cfg or FilterConfig()
    event = F.coalesce("event_text", F.lit(""))
    category = refs.header_category(event, F.coalesce("time_control", F.lit("")))
    keep = category.isin(*cfg.time_controls) & (elo(F.col("white_elo")) >= cfg.min_elo) & (elo(F.col("black_elo")) >= cfg.min_elo)
    keep = keep & ~F.coalesce("termination", F.lit("")).isin(*cfg.excluded_terminations)
    if cfg.rated_only:
        keep = keep & F.startswith(event, F.lit("Rated"))
    return F.coalesce(keep, F.lit(False))


def scan_stats(games: DataFrame, cfg: FilterConfig | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Games seen and accepted and the rate, for each ``by``: the survey of a dump, no movetext read."""
    n = games.groupBy(*by).agg(F.count(F.lit(1)).alias("games_seen"), F.count_if(accepts(cfg)).alias("games_accepted"))
    return n.withColumn("acceptance_rate", F.coalesce(F.try_divide(F.col("games_accepted").cast("double"), F.col("games_seen")), F.lit(0.0)))


def survey_text(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return stats.select(*by, F.format_string("%d of %d games accepted (%.2f %%)", "games_accepted", "games_seen", F.col("acceptance_rate") * 100).alias("summary"))


def extract(games: DataFrame, path: str, cfg: FilterConfig | None = None) -> DataFrame:
    """Write the accepted games as Parquet and read them back."""
    games.filter(accepts(cfg)).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return games.sparkSession.read.parquet(path)


def first_of_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; rows with a null key are all kept.

    By an aggregate with map-side combining, not a window: a key with a third of all rows is reduced where its rows lie.
    """
    rest = [c for c in df.columns if c != key]
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*").select(df.columns).unionByName(df.filter(F.col(key).isNull()))


#: Most keys that are broadcast to a history, so that it is read but not shuffled (8 bytes a key).
PROBED_KEYS = 1_000_000


def unseen(df: DataFrame, seen: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Rows whose key is not in ``seen``; null keys are unseen.

    Where ``df`` (best a written table) is known to have few ``rows``, its keys are broadcast to ``seen``, which may be
    any history: only the keys they have in common are joined back. Otherwise both sides are shuffled.
    """
    known = seen.select(key).filter(F.col(key).isNotNull())
    if rows is not None and rows <= PROBED_KEYS:
        known = known.join(F.broadcast(df.select(key).filter(F.col(key).isNotNull()).distinct()), key, "left_semi")
    return df.join(known.distinct(), key, "left_anti").select(df.columns)


def shard_of(seq: Column, games_per_shard: int) -> Column:
    return F.floor((seq - 1) / games_per_shard).cast("int")


def game_rng(game_id: str, seed: int) -> random.Random:
    return random.Random(int.from_bytes(hashlib.blake2b(f"{seed}:{game_id}".encode(), digest_size=8).digest(), "big"))


def sample_plies(n: int, cfg: SamplingConfig, rng: random.Random) -> list[int]:
    """Plies to sample of a game of ``n``: half with each side to move, an odd one by coin, a short side filled from the other."""
    want = min(cfg.positions_per_game, max(n, 0))
    if not want:
        return []
    if not cfg.balance_by_turn:
        return sorted(rng.sample(range(n), want))
    sides = [range(0, n, 2), range(1, n, 2)]
    take = [want // 2, want - want // 2]
    if want % 2 and rng.random() < 0.5:
        take.reverse()
    take = [min(t, len(s)) for t, s in zip(take, sides)]
    for k in (0, 1):
        take[k] = min(len(sides[k]), want - take[1 - k])
    return sorted(p for side, t in zip(sides, take) for p in rng.sample(list(side), t))


POSITION = "game_id string, game_seq bigint, n_plies int, ply smallint, fen string, pos_key bigint, turn_white boolean"


def sampled_positions(games: DataFrame, sampling: SamplingConfig | None = None, min_plies: int = 20) -> DataFrame:
    """POSITION rows of games (game_id, game_seq, movetext): the positions before the sampled moves.

    Games without moves or with fewer than ``min_plies`` give none. The draw depends on the game's id and the seed only.
    """
    cfg = sampling or SamplingConfig()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for game_id, seq, text in zip(batch["game_id"], batch["game_seq"], batch["movetext"]):
                line = rules.mainline(text or "")
                if not line or len(line) < min_plies:
                    continue
                for ply in sample_plies(len(line), cfg, game_rng(game_id or "", cfg.seed)):
                    at = line[ply][0]
                    fen = at.fen()
                    out.append((game_id or "", seq, len(line), ply, fen, keys.digest64(" ".join(fen.split(" ")[:4])), at.white))
            yield pd.DataFrame(out, columns=["game_id", "game_seq", "n_plies", "ply", "fen", "pos_key", "turn_white"])

    return games.select("game_id", "game_seq", "movetext").mapInPandas(run, POSITION)


def numbered_batches(df: DataFrame, seed: int, epoch: int, key: str, size: int) -> DataFrame:
    """Rows with ``batch`` and ``place``: an order shuffled by (seed, epoch) and cut into batches of exactly ``size`` (the last
    may be smaller); within a batch rows are placed from 0 in the order of ``key``, as a reader likes them.

    The shuffled order is a distributed numbering; only a batch is ever sorted as a whole.
    """
    salt = F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key))
    shuffled = numbered(df.withColumns({"_all": F.lit(0), "_salt": salt}), ["_all"], [F.col("_salt"), F.col(key)], bucket_count(df.count()), F.col("_salt"), "_at")
    cut = shuffled.withColumn("batch", F.floor(F.col("_at") / size))
    place = F.row_number().over(Window.partitionBy("batch").orderBy(key)) - 1
    return cut.withColumn("place", place).drop("_all", "_salt", "_at")


def top_by(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank (a top-k report)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def random_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of the smallest seeded hashes: uniform, without replacement, the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def openings(positions: DataFrame, n: int, max_ply: int = 16, seed: int = 0) -> DataFrame:
    """``n`` random early positions (ply up to ``max_ply``) to start games from."""
    return random_rows(positions.filter(F.col("ply").between(0, max_ply)), "fen", n, seed)


def every_kth(df: DataFrame, order: str, k: int) -> DataFrame:
    """Every k-th row of a numbered table."""
    return df.filter(F.pmod(F.col(order), F.lit(k)) == 0)
