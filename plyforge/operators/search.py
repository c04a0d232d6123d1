"""Search over game trees as tables: expand level by level, score the leaves in batches, fold the levels back.

The tree of all roots is one table; a level is one vectorised function (legal moves of every node) and folding it one
aggregation by parent. No tree is ever held in one place.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge import session
from plyforge.config import LabelingConfig
from plyforge.functions import rules
from plyforge.functions.scoring import CLIP, DRAW, LOSS, MATE, MATE_STEP
from plyforge.operators.label import Engine, EngineNotAvailableError

Scorer = Callable[[list[str]], np.ndarray]
NODE = "root bigint, path array<int>, move string, fen string, exact double, ply int"


def material_scorer(fens: list[str]) -> np.ndarray:
    """A simple scorer: tanh of material over 400, from the side to move's view."""
    worth = {"p": 100, "n": 300, "b": 300, "r": 500, "q": 900}
    out = []
    for fen in fens:
        board, side = fen.split(" ")[:2]
        total = sum(worth.get(c.lower(), 0) * (1 if c.isupper() else -1) for c in board)
        out.append(np.tanh((total if side == "w" else -total) / 400))
    return np.array(out)


def terminal_value(at: rules.Position, claim_draws: bool = True) -> float | None:
    """Exact value for the side to move of an ended game; fifty moves may be claimed as a draw."""
    state = at.status()
    if state == "checkmate":
        return LOSS
    if state != "ongoing" or (claim_draws and at.half >= 100):
        return DRAW
    return None


def _exact(at: rules.Position, ply: int, claim_draws: bool) -> float | None:
    decided = terminal_value(at, claim_draws)
    return -(MATE - ply * MATE_STEP) if decided == LOSS else decided


def expand(nodes: DataFrame, claim_draws: bool = True) -> DataFrame:
    """The children of every node that is not decided, numbered in move order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for root, path, fen, ply in zip(batch["root"], batch["path"], batch["fen"], batch["ply"]):
                at = rules.Position.read(fen)
                for k, move in enumerate(at.legal()):
                    child = at.play(move)
                    out.append((root, [*path, k], rules.uci(move), child.fen(), _exact(child, ply + 1, claim_draws), ply + 1))
            yield pd.DataFrame(out, columns=["root", "path", "move", "fen", "exact", "ply"])

    return nodes.filter("exact is null").select("root", "path", "fen", "ply").mapInPandas(run, NODE)


def evaluated(nodes: DataFrame, scorer: Scorer, fen: str = "fen") -> DataFrame:
    """Add ``value``: ``exact`` where the rules decide, else the scorer's, called once per Arrow batch."""
    out = T.StructType([*nodes.schema.fields, T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = batch["exact"].to_numpy(float, copy=True)
            open_ = np.isnan(value)
            if open_.any():
                value[open_] = scorer(batch.loc[open_, fen].tolist())
            yield batch.assign(value=value)

    return nodes.mapInPandas(run, out)


def scored_positions(df: DataFrame, scorer: Scorer, claim_draws: bool = True) -> DataFrame:
    """(root, fen) with ``exact`` by the rules and ``value`` from the side to move's view."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(exact=[terminal_value(rules.Position.read(f), claim_draws) for f in batch["fen"]]).astype({"exact": float})

    return evaluated(df.select("root", "fen").mapInPandas(run, "root bigint, fen string, exact double"), scorer)


def search(roots: DataFrame, scorer: Scorer, depth: int = 1, beam: int | None = None, claim_draws: bool = True, ties_seed: int | None = None) -> DataFrame:
    """(root, rank, move, value, leaves): the root's moves by value for the side that moves, best first.

    ``roots`` has root and fen. ``depth`` counts half-moves; ``beam`` keeps only the best moves of a search of depth
    one. Ties keep the order of moves, or with ``ties_seed`` a random one. A root whose game is over has no rows.
    """
    if depth < 1:
        raise ValueError(f"depth must be at least 1, not {depth}")
    start = roots.select("root", F.array().cast("array<int>").alias("path"), "fen", F.lit(None).cast("double").alias("exact"), F.lit(0).alias("ply"))
    level = session.cut(expand(start, claim_draws), "tree")
    if beam is not None and depth > 1:
        first = search(roots, scorer, 1, None, claim_draws).filter(F.col("rank") <= beam).select("root", "move")
        level = session.cut(level.join(first, ["root", "move"], "left_semi").select(*level.columns), "tree")
    levels = [level]
    for _ in range(depth - 1):
        levels.append(session.cut(expand(levels[-1], claim_draws), "tree"))
    values = evaluated(levels[-1], scorer).select("root", "path", "value")
    leaves = [levels[-1].filter("exact is null").select("root", F.element_at("path", 1).alias("top"))]
    for upper in reversed(levels[:-1]):
        parent = F.slice("path", 1, F.size("path") - 1)
        folded = values.groupBy("root", parent.alias("path")).agg(F.max(-F.col("value")).alias("value"))
        decided = upper.filter("exact is not null").select("root", "path", F.col("exact").alias("value"))
        values = folded.unionByName(decided)
    own = values.withColumn("value", -F.col("value")).join(levels[0].select("root", "path", "move"), ["root", "path"])
    count = leaves[0].groupBy("root").agg(F.count(F.lit(1)).alias("leaves"))
    order = F.element_at("path", 1) if ties_seed is None else F.xxhash64(F.lit(ties_seed), "root", "move")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("value"), order))
    return own.withColumn("rank", rank).join(count, "root", "left").select("root", "rank", "move", "value", F.coalesce("leaves", F.lit(0)).alias("leaves"))


def best_moves(roots: DataFrame, scorer: Scorer, **options) -> DataFrame:
    return search(roots, scorer, **options).filter("rank = 1").drop("rank")


def move_values(at: rules.Position, scorer: Scorer, depth: int = 1) -> tuple[list[rules.Move], np.ndarray]:
    """The legal moves and their values for the side that moves, by a search of ``depth`` half-moves within one task.

    All leaves of the tree are scored in one call; ``search`` does the same for many roots as tables.
    """
    leaves: list[str] = []

    def grow(node: rules.Position, ply: int) -> float | int | list:
        exact = _exact(node, ply, True)
        if exact is not None:
            return exact
        if ply == depth:
            leaves.append(node.fen())
            return len(leaves) - 1
        return [grow(node.play(m), ply + 1) for m in node.legal()]

    moves = list(at.legal())
    tree = [grow(at.play(m), 1) for m in moves]
    scores = scorer(leaves) if leaves else np.zeros(0)

    def fold(node: float | int | list) -> float:
        if isinstance(node, list):
            return max(-fold(child) for child in node)
        return float(scores[node]) if isinstance(node, int) else node

    return moves, np.array([-fold(node) for node in tree])


@dataclass(frozen=True)
class ScorerPlayer:
    """Plays the best move of a search with a scorer; of equal moves the first, or with ``random_ties`` any."""

    scorer: Scorer
    depth: int = 1
    random_ties: bool = False

    def seat(self, seed: int) -> Callable[[rules.Position], rules.Move]:
        coin = np.random.default_rng(seed)

        def choose(at: rules.Position) -> rules.Move:
            moves, values = move_values(at, self.scorer, self.depth)
            best = np.flatnonzero(values == values.max())
            return moves[int(coin.choice(best)) if self.random_ties else int(best[0])]

        return choose


@dataclass(frozen=True)
class EnginePlayer:
    """Plays a UCI engine's move, at full strength or limited to a rating, for so many seconds or to a depth."""

    cfg: LabelingConfig
    rating: int | None = None
    seconds_per_move: float | None = 0.05

    def seat(self, seed: int) -> Callable[[rules.Position], rules.Move]:
        engine = Engine(self.cfg)
        engine.strength(self.rating)
        limit = f"depth {self.cfg.depth}" if self.seconds_per_move is None else f"movetime {max(1, round(1000 * self.seconds_per_move))}"

        def choose(at: rules.Position) -> rules.Move:
            text = engine.best(at.fen(), limit)
            move = next((m for m in at.legal() if rules.uci(m) == text), None)
            if move is None:
                raise EngineNotAvailableError(f"{text} is no legal move in {at.fen()}")
            return move

        choose.close = engine.close
        return choose


Player = ScorerPlayer | EnginePlayer
GAME = "opening_id bigint, engine_white boolean, score double, plies int, outcome string, termination string, seconds_per_move double"


def play(pairings: DataFrame, engine: Player | Scorer, opponent: Player | Scorer, max_plies: int = 400, seed: int = 0) -> DataFrame:
    """One game for each row (opening_id, fen, engine_white); the score is the engine's.

    A bare scorer plays at depth one. Threefold repetition and fifty moves are draws. A game in which a player fails ends
    as ``interrupted``, drawn. ``seconds_per_move`` is the engine's mean. Games are independent, one after another
    within a task, which seats each player once.
    """
    players = [p if isinstance(p, (ScorerPlayer, EnginePlayer)) else ScorerPlayer(p) for p in (engine, opponent)]

    def one(fen: str, white: bool, seats: list) -> tuple[float, int, str, str, float | None]:
        at, seen, plies, end, spent, own = rules.Position.read(fen), {}, 0, None, 0.0, 0
        while end is None:
            key = " ".join(at.fen().split(" ")[:4])
            seen[key] = seen.get(key, 0) + 1
            state = at.status()
            if state != "ongoing":
                end = state
            elif seen[key] >= 3:
                end = "repetition"
            elif at.half >= 100:
                end = "fifty"
            elif plies >= max_plies:
                end = "max_plies"
            else:
                mine, began = at.white == white, time.perf_counter()
                try:
                    at = at.play(seats[0 if mine else 1](at))
                except EngineNotAvailableError:
                    end = "interrupted"
                    break
                if mine:
                    spent, own = spent + time.perf_counter() - began, own + 1
                plies += 1
        score = 0.5 if end != "checkmate" else (0.0 if at.white == white else 1.0)
        outcome = "1/2-1/2" if score == 0.5 else ("1-0" if (score == 1.0) == white else "0-1")
        return score, plies, outcome, end, spent / own if own else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seats: list = []
        try:
            for batch in batches:
                out = []
                for opening, fen, white in zip(batch["opening_id"], batch["fen"], batch["engine_white"]):
                    seats = seats or [p.seat(seed + k) for k, p in enumerate(players)]
                    got = one(fen, white, seats)
                    out.append((opening, white, *got))
                    if got[3] == "interrupted":
                        _leave(seats)
                        seats = []
                yield pd.DataFrame(out, columns=["opening_id", "engine_white", "score", "plies", "outcome", "termination", "seconds_per_move"])
        finally:
            _leave(seats)

    cores = pairings.sparkSession.sparkContext.defaultParallelism
    return pairings.select("opening_id", "fen", "engine_white").repartition(cores).mapInPandas(run, GAME)


def _leave(seats: list) -> None:
    for seat in seats:
        if hasattr(seat, "close"):
            seat.close()


def move_losses(chosen: DataFrame, cfg: LabelingConfig, clip: int = CLIP) -> DataFrame:
    """(root, move, best, loss_cp, agrees) of moves (root, fen, move) judged by an engine at its depth.

    The loss is what the engine's value of the position falls by after the move, from the mover's view, at least 0;
    mates count as the clip. A position whose game is over, or a move that is none, has nulls.
    """

    def points(engine: Engine, at: rules.Position) -> tuple[float, str | None]:
        decided = terminal_value(at, False)
        if decided is not None:
            return (-float(clip) if decided == LOSS else 0.0), None
        cp, mate, best = engine.analyse(at.fen(), f"depth {cfg.depth}")
        return (float(clip if mate > 0 else -clip) if mate is not None else float(max(-clip, min(clip, cp)))), best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        try:
            for batch in batches:
                out = []
                for root, fen, move in zip(batch["root"], batch["fen"], batch["move"]):
                    engine = engine or Engine(cfg)
                    try:
                        at = rules.Position.read(fen)
                        step = next(m for m in at.legal() if rules.uci(m) == move)
                        before, best = points(engine, at)
                        after, _ = points(engine, at.play(step))
                        out.append((root, move, best, max(0.0, before + after), best == move))
                    except (ValueError, AttributeError, StopIteration):
                        out.append((root, move, None, None, None))
                yield pd.DataFrame(out, columns=["root", "move", "best", "loss_cp", "agrees"]).astype({"loss_cp": float, "agrees": object})
        finally:
            if engine is not None:
                engine.close()

    spread = chosen.select("root", "fen", "move").repartition(cfg.workers or chosen.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, "root bigint, move string, best string, loss_cp double, agrees boolean")


def mate_in_one(df: DataFrame, fen: str = "fen") -> DataFrame:
    """Add ``mates``: whether the side to move mates at once, and ``mated``: whether any move lets the other side do so."""

    def mates(at: rules.Position) -> bool:
        return any(at.play(m).status() == "checkmate" for m in at.legal())

    out = T.StructType([*df.schema.fields, T.StructField("mates", T.BooleanType()), T.StructField("mated", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for text in batch[fen]:
                try:
                    at = rules.Position.read(text)
                    moves = list(at.legal())
                    got.append((mates(at), bool(moves) and all(mates(at.play(m)) for m in moves)))
                except (ValueError, AttributeError):
                    got.append((None, None))
            yield batch.assign(mates=[g[0] for g in got], mated=[g[1] for g in got])

    return df.mapInPandas(run, out)


def verdict(gap: Column) -> Column:
    """How far two values of one position lie apart, in words."""
    return F.when(F.abs(gap) < 0.10, "close").when(F.abs(gap) < 0.30, "apart").when(gap.isNotNull(), "far apart")


def panel(positions: DataFrame, scorers: dict[str, Scorer], reference: str) -> DataFrame:
    """(root, model, move, value, same, gap, verdict): each model's choice at each position against the reference's."""
    out = None
    for name, scorer in scorers.items():
        best = best_moves(positions, scorer).select("root", F.lit(name).alias("model"), "move", "value")
        out = best if out is None else out.unionByName(best)
    out = session.cut(out, "panel")
    ref = out.filter(F.col("model") == reference).select("root", F.col("move").alias("_move"), F.col("value").alias("_value"))
    both = out.join(ref, "root", "left").withColumn("gap", F.col("value") - F.col("_value")).withColumn("same", F.col("move") == F.col("_move"))
    return both.select("root", "model", "move", "value", "same", "gap", verdict(F.col("gap")).alias("verdict"))
