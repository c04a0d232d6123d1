"""Labelling positions with an external engine that speaks UCI; any program that does may be plugged in."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.config import LabelingConfig, NormalizationConfig
from plyforge.functions import scoring


class EngineNotAvailableError(RuntimeError):
    """The engine cannot be started."""


class Engine:
    """One engine process."""

    def __init__(self, cfg: LabelingConfig):
        try:
            self.process = subprocess.Popen(cfg.engine_path.split(), stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        except OSError as e:
            raise EngineNotAvailableError(cfg.engine_path) from e
        self.name = ""
        self.send("uci")
        for line in self.until("uciok"):
            if line.startswith("id name "):
                self.name = line[8:]
        self.option("Threads", cfg.threads_per_engine)
        self.option("Hash", cfg.hash_mb)
        self.send("isready")
        list(self.until("readyok"))

    def send(self, line: str) -> None:
        self.process.stdin.write(line + "\n")
        self.process.stdin.flush()

    def until(self, word: str) -> Iterator[str]:
        for line in self.process.stdout:
            yield line.rstrip()
            if line.startswith(word):
                return
        raise EngineNotAvailableError("the engine ended")

    def option(self, key: str, value) -> None:
        self.send(f"setoption name {key} value {value}")

    def strength(self, rating: int | None) -> None:
        """Limit the engine to a rating, or lift the limit."""
        self.option("UCI_LimitStrength", "false" if rating is None else "true")
        if rating is not None:
            self.option("UCI_Elo", rating)

    def analyse(self, fen: str, limit: str) -> tuple[int | None, int | None, str]:
        """(centipawns, mate, best move) from the side to move's view."""
        self.send(f"position fen {fen}")
        self.send(f"go {limit}")
        cp = mate = None
        for line in self.until("bestmove"):
            got = re.search(r"\bscore (cp|mate) (-?\d+)", line)
            if got and "bound" not in line:
                cp, mate = (int(got[2]), None) if got[1] == "cp" else (None, int(got[2]))
            if line.startswith("bestmove"):
                if cp is None and mate is None:
                    raise ValueError(f"no score for {fen}")
                return cp, mate, line.split()[1]
        raise EngineNotAvailableError("the engine ended")

    def best(self, fen: str, limit: str) -> str:
        """The move the engine plays, whether it tells a score or not."""
        self.send(f"position fen {fen}")
        self.send(f"go {limit}")
        *_, last = self.until("bestmove")
        return last.split()[1]

    def close(self) -> None:
        try:
            self.send("quit")
            self.process.wait(5)
        except (OSError, subprocess.TimeoutExpired):
            self.process.kill()


def engine_version(cfg: LabelingConfig) -> str:
    engine = Engine(cfg)
    try:
        return engine.name
    finally:
        engine.close()


def scored(fens: DataFrame, cfg: LabelingConfig) -> DataFrame:
    """(fen, cp, mate, best): side-to-move scores of a column ``fen``; positions failing twice have nulls.

    One engine for each task, started once; it is started anew after a failure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        try:
            for batch in batches:
                out = []
                for fen in batch["fen"]:
                    row = (fen, None, None, None)
                    for _ in range(2):
                        try:
                            engine = engine or Engine(cfg)
                            row = (fen, *engine.analyse(fen, f"depth {cfg.depth}"))
                            break
                        except EngineNotAvailableError:
                            if engine is None:
                                raise
                            engine.close()
                            engine = None
                        except ValueError:
                            continue
                    out.append(row)
                frame = pd.DataFrame(out, columns=["fen", "cp", "mate", "best"])
                yield frame.astype({"cp": "Int32", "mate": "Int32"})
        finally:
            if engine is not None:
                engine.close()

    spread = fens.select("fen").distinct().repartition(cfg.workers or fens.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, "fen string, cp int, mate int, best string")


def attach(pending: DataFrame, scores: DataFrame, norm: NormalizationConfig | None = None) -> DataFrame:
    """``pending`` (fen, turn_white, ...) with the label's columns; rows without a score are dropped."""
    norm = norm or NormalizationConfig()
    good = scores.filter("cp is not null or mate is not null")
    both = pending.join(good.select("fen", "cp", "mate"), "fen")
    sign = F.when(F.col("turn_white"), 1).otherwise(-1)
    # a mate in 0 is the side to move's loss: the sign is the score's, so it is taken before the side is turned
    cp = scoring.score_cp(F.col("cp"), F.col("mate"), norm.cp_clip) * sign
    label = scoring.label(cp, F.lit(None).cast("int"), F.col("turn_white"), norm.scale, norm.cp_clip)
    mate = scoring.bounded(F.col("mate") * sign, scoring.MATE_CLAMP)
    return both.withColumn("_l", label).select(
        *pending.columns, "_l.cp_white", "_l.cp_stm", "_l.value_white", "_l.value_stm",
        F.col("mate").isNotNull().alias("is_mate"), F.coalesce(mate, F.lit(0)).cast("smallint").alias("mate_in"),
    )
