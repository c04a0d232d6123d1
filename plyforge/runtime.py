"""What a run has at hand: cores, memory, an accelerator, the engine; and what to mind before a long phase."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

PHASES = ("labelling", "training", "playing")


@dataclass(frozen=True)
class RuntimeInfo:
    hosted: bool
    cores: int
    accelerator: bool
    engine_path: str | None
    phase: str = "labelling"
    shared: str | None = field(default=None)

    @property
    def warnings(self) -> list[str]:
        """What stands against the phase, worst first; nothing if all is well."""
        out = []
        if self.phase in ("labelling", "playing") and self.engine_path is None:
            out.append("no engine was found: positions cannot be labelled, nor moves judged")
        if self.shared is None:
            out.append("spark.checkpoint.dir is not set: only local runs can go on")
        if self.phase == "labelling" and self.cores < 4:
            out.append(f"{self.cores} cores label few positions a second")
        if self.phase == "training" and self.accelerator:
            out.append("the accelerator is not used: training here is on processors")
        return out

    def summary(self) -> str:
        parts = [f"{self.cores} cores", "accelerator" if self.accelerator else "no accelerator", f"engine {self.engine_path or 'missing'}"]
        return "; ".join([f"{self.phase}: {', '.join(parts)}", *self.warnings])


def in_hosted_notebook() -> bool:
    return any(name in os.environ for name in ("COLAB_RELEASE_TAG", "KAGGLE_KERNEL_RUN_TYPE"))


def has_accelerator() -> bool:
    return shutil.which("nvidia-smi") is not None or os.path.exists("/dev/nvidia0")


def secret(name: str) -> str | None:
    """A credential from the environment; none where it is unset or empty."""
    return os.environ.get(name) or None


def describe_runtime(spark: SparkSession, engine: str = "stockfish", phase: str = "labelling") -> RuntimeInfo:
    if phase not in PHASES:
        raise ValueError(f"{phase!r} is none of {PHASES}")
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or None
    return RuntimeInfo(in_hosted_notebook(), spark.sparkContext.defaultParallelism, has_accelerator(), shutil.which(engine.split()[0]), phase, shared)
