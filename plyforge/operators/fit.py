"""Training of a small value network over encoded positions: local gradient steps, averaged once an epoch.

Every partition begins an epoch with the same weights, goes over its rows in batches (shuffled by seed, epoch and
partition) with momentum and decoupled weight decay, and hands back its weights; their mean, weighted by rows and taken
in two levels, begins the next. So an epoch is one job, rows are never shuffled again after the first distribution, and the
driver sees one set of weights. State is a versioned control file: a run goes on after its last whole epoch.

Rows with a null in planes or target are left out. A table without rows is an error, as nothing can be fitted.
"""

from __future__ import annotations

import base64
import json
import math
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge import session
from plyforge.operators import metrics
from plyforge.operators.encode import BYTES

LOSSES = ("mse", "huber")
HUBER_DELTA = 0.1
HISTORY = "epoch int, train_loss double, val_rmse double, val_mae double, val_mae_cp double, val_sign_agreement double, val_spearman double, seconds double, learning_rate double"


class UnknownLossError(ValueError):
    """A loss that is not one of LOSSES."""


@dataclass(frozen=True)
class FitConfig:
    """A network of one hidden layer (none for ``hidden`` 0) with a bounded output, and how it is trained."""

    hidden: int = 32
    epochs: int = 10
    warmup_epochs: int = 1
    batch_size: int = 256
    learning_rate: float = 0.002
    weight_decay: float = 1e-4
    momentum: float = 0.9
    loss: str = "mse"
    seed: int = 20260911

    def __post_init__(self) -> None:
        if self.loss not in LOSSES:
            raise UnknownLossError(f"{self.loss!r} is none of {LOSSES}")

    def describe(self) -> str:
        shape = f"{self.hidden} hidden units" if self.hidden else "linear"
        return f"{shape}, {describe_loss(self.loss)}, {self.epochs} epochs, batches of {self.batch_size}, rate {self.learning_rate:g} after {self.warmup_epochs} of warm-up"


def describe_loss(name: str) -> str:
    if name not in LOSSES:
        raise UnknownLossError(f"{name!r} is none of {LOSSES}")
    return "mean squared error" if name == "mse" else f"Huber loss (delta {HUBER_DELTA:g})"


def loss_and_slope(name: str, error: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed loss of errors and its derivative by each."""
    if name == "mse":
        return float((error**2).sum()), 2 * error
    small = np.abs(error) <= HUBER_DELTA
    loss = np.where(small, 0.5 * error**2, HUBER_DELTA * (np.abs(error) - 0.5 * HUBER_DELTA))
    return float(loss.sum()), np.where(small, error, HUBER_DELTA * np.sign(error))


def rate_at(cfg: FitConfig, at: float) -> float:
    """The learning rate at a time in epochs: linear warm-up, then half a cosine down to zero."""
    if at < cfg.warmup_epochs:
        return cfg.learning_rate * (at + 1e-9) / cfg.warmup_epochs
    rest = max(1e-9, cfg.epochs - cfg.warmup_epochs)
    return cfg.learning_rate * 0.5 * (1 + math.cos(math.pi * min(1.0, (at - cfg.warmup_epochs) / rest)))


def begin(cfg: FitConfig) -> list[np.ndarray]:
    """Seeded first weights."""
    coin = np.random.default_rng(cfg.seed)
    sizes = [BYTES, cfg.hidden, 1] if cfg.hidden else [BYTES, 1]
    out = []
    for a, b in zip(sizes, sizes[1:]):
        out += [coin.normal(scale=math.sqrt(1 / a), size=(a, b)).astype(np.float32), np.zeros(b, np.float32)]
    return out


def inputs(planes: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), BYTES).astype(np.float32)
    x[:, -64:] /= 100
    return x


def forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Values in (-1, 1) and the hidden layer."""
    hidden = None
    if len(weights) == 4:
        hidden = np.maximum(x @ weights[0] + weights[1], 0)
        x = hidden
    return np.tanh(x @ weights[-2] + weights[-1])[:, 0], hidden


def gradients(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, loss: str) -> tuple[float, list[np.ndarray]]:
    """Summed loss and the gradient of the mean loss of a batch."""
    p, hidden = forward(weights, x)
    total, slope = loss_and_slope(loss, p - y)
    g = ((slope * (1 - p**2)) / len(y)).astype(np.float32)[:, None]
    top = x if hidden is None else hidden
    out = [top.T @ g, g.sum(0)]
    if hidden is not None:
        below = (g @ weights[2].T) * (hidden > 0)
        out = [x.T @ below, below.sum(0), *out]
    return total, out


def _packed(weights: list[np.ndarray]) -> bytes:
    return b"".join(w.astype("<f4").tobytes() for w in weights)


def _unpacked(data: bytes, like: list[np.ndarray]) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), [], 0
    for w in like:
        out.append(flat[at : at + w.size].reshape(w.shape).copy())
        at += w.size
    return out


def _epoch(rows: DataFrame, weights: list[np.ndarray], cfg: FitConfig, epoch: int) -> tuple[list[np.ndarray], float]:
    """The averaged weights after an epoch, and its mean loss."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coin = np.random.default_rng([cfg.seed, epoch, part])
        mine = [w.copy() for w in shared.value]
        speed = [np.zeros_like(w) for w in mine]
        seen, total = 0, 0.0
        for frame in batches:
            x, y = inputs(frame["planes"]), frame["target"].to_numpy(np.float32)
            order = coin.permutation(len(y))
            for start in range(0, len(y), cfg.batch_size):
                some = order[start : start + cfg.batch_size]
                loss, grads = gradients(mine, x[some], y[some], cfg.loss)
                rate = rate_at(cfg, epoch + min(1.0, seen / max(1, int(frame["rows"].iloc[0]))))
                for w, v, g in zip(mine, speed, grads):
                    v *= cfg.momentum
                    v += g
                    w *= 1 - rate * cfg.weight_decay
                    w -= rate * v
                seen, total = seen + len(some), total + loss
        if seen:
            yield pd.DataFrame({"part": [part], "n": [seen], "loss": [total], "weights": [_packed(mine)]})

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["n"].to_numpy(float)
        flat = sum(np.frombuffer(d, "<f4").astype(float) * k for d, k in zip(frame["weights"], n)) / n.sum()
        return pd.DataFrame({"part": [int(frame["part"].min())], "n": [int(n.sum())], "loss": [frame["loss"].sum()], "weights": [flat.astype("<f4").tobytes()]})

    schema = "part int, n bigint, loss double, weights binary"
    made = rows.mapInPandas(run, schema)
    for slots in (16, 1):  # two levels, so that no task holds the weights of all partitions
        made = made.groupBy(F.pmod("part", F.lit(slots)).alias("slot")).applyInPandas(mean, schema)
    got = made.first()
    shared.unpersist()
    if got is None:
        raise ValueError("no rows to train on")
    return _unpacked(bytes(got.weights), weights), got.loss / got.n


@dataclass(frozen=True)
class EpochRecord:
    epoch: int
    train_loss: float
    val_rmse: float
    val_mae: float
    val_mae_cp: float
    val_sign_agreement: float | None
    val_spearman: float | None
    seconds: float
    learning_rate: float


@dataclass(frozen=True)
class TrainingHistory:
    run_name: str
    epochs: tuple[EpochRecord, ...] = ()

    def __post_init__(self) -> None:
        if [e.epoch for e in self.epochs] != sorted({e.epoch for e in self.epochs}):
            raise ValueError("epochs must be in order, each once")

    @property
    def best(self) -> EpochRecord | None:
        """The epoch of least validation error, the first of equals."""
        return min(self.epochs, key=lambda e: (e.val_rmse, e.epoch), default=None)

    def to_json(self) -> str:
        """As ``learn.histories`` reads it."""
        return json.dumps({"run_name": self.run_name, "epochs": [asdict(e) for e in self.epochs]})

    @classmethod
    def from_json(cls, text: str) -> TrainingHistory:
        raw = json.loads(text)
        return cls(raw["run_name"], tuple(EpochRecord(**e) for e in raw["epochs"]))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(e).values()) for e in self.epochs], HISTORY)


@dataclass
class TrainingRun:
    """A run as far as it got: its weights, the best ones, the history."""

    cfg: FitConfig
    weights: list[np.ndarray]
    best_weights: list[np.ndarray]
    history: TrainingHistory

    def summary(self) -> str:
        best = self.history.best
        end = f"best epoch {best.epoch}: val rmse {best.val_rmse:.4f}, mae {best.val_mae_cp:.1f} cp" if best else "no epoch yet"
        return f"{self.history.run_name}: {self.cfg.describe()}; {len(self.history.epochs)} epochs done; {end}"

    def scorer(self):
        """The best weights as a scorer of texts for ``search``."""
        from plyforge.functions import rules

        weights = self.best_weights
        return lambda fens: forward(weights, inputs(pd.Series([rules.planes(f).tobytes() for f in fens])))[0].astype(float)


def save_checkpoint(spark: SparkSession, path: str, run: TrainingRun) -> None:
    """A new version of the run's control file; the one before stays until this one is complete."""
    coded = {k: base64.b64encode(_packed(getattr(run, k))).decode("ascii") for k in ("weights", "best_weights")}
    session.write_text(spark, path, json.dumps({"cfg": asdict(run.cfg), "history": run.history.to_json()} | coded))


def load_checkpoint(spark: SparkSession, path: str) -> TrainingRun | None:
    text = session.read_text(spark, path)
    if text is None:
        return None
    raw = json.loads(text)
    cfg = FitConfig(**raw["cfg"])
    like = begin(cfg)
    both = [_unpacked(base64.b64decode(raw[k]), like) for k in ("weights", "best_weights")]
    return TrainingRun(cfg, *both, TrainingHistory.from_json(raw["history"]))


def predict(weights: list[np.ndarray], rows: DataFrame, name: str = "prediction") -> DataFrame:
    """``rows`` (with planes) and the network's value; null for null planes."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def value(planes: pd.Series) -> pd.Series:
        out = np.full(len(planes), np.nan)
        have = planes.notna().to_numpy()
        if have.any():
            out[have] = forward(shared.value, inputs(planes[have]))[0]
        return pd.Series(out).where(have, None).astype("Float64")

    return rows.withColumn(name, value("planes"))


def train(train_rows: DataFrame, val_rows: DataFrame, cfg: FitConfig, target: str = "value_stm", path: str | None = None, name: str = "run") -> TrainingRun:
    """Train on rows with planes and ``target``, validating after each epoch; goes on from the checkpoint at ``path``.

    A checkpoint of other settings (but the number of epochs) is an error. Epochs done are not repeated, and the same
    batches follow as in a run without a break, since each epoch's shuffle is its own.
    """
    spark = train_rows.sparkSession
    run = load_checkpoint(spark, path) if path else None
    if run is None:
        run = TrainingRun(cfg, begin(cfg), begin(cfg), TrainingHistory(name))
    elif replace(run.cfg, epochs=cfg.epochs) != cfg:
        raise ValueError(f"the checkpoint at {path} has other settings")
    run.cfg = cfg
    good = train_rows.select("planes", F.col(target).cast("float").alias("target")).filter("planes is not null and target is not null")
    parts = spark.sparkContext.defaultParallelism
    dealt = session.cut(good.repartition(parts, F.xxhash64(F.lit(cfg.seed), "planes", "target")), "fit")
    rows = dealt.withColumn("rows", F.lit(max(1, dealt.count() // parts)))
    for epoch in range(len(run.history.epochs), cfg.epochs):
        began = time.perf_counter()
        run.weights, loss = _epoch(rows, run.weights, cfg, epoch)
        got = evaluate_split(run.weights, val_rows, target).first()
        record = EpochRecord(epoch, loss, got.rmse, got.mae, got.mae_cp, got.sign_agreement, got.spearman, time.perf_counter() - began, rate_at(cfg, epoch + 1))
        before = run.history.best
        if before is None or record.val_rmse < before.val_rmse:
            run.best_weights = run.weights
        run.history = TrainingHistory(run.history.run_name, (*run.history.epochs, record))
        if path:
            save_checkpoint(spark, path, run)
    session.release(dealt)
    return run


def evaluate_split(weights: list[np.ndarray], rows: DataFrame, target: str = "value_stm") -> DataFrame:
    """The metrics of a network on a split's rows."""
    return metrics.evaluate(predict(weights, rows), "prediction", target)


@dataclass(frozen=True)
class FitArm:
    """One arm of a sweep: what it changes of the base settings, and why."""

    name: str
    rationale: str = ""
    changes: dict = field(default_factory=dict)

    def config(self, base: FitConfig) -> FitConfig:
        return replace(base, **self.changes)


def sweep(train_rows: DataFrame, val_rows: DataFrame, base: FitConfig, arms: list[FitArm], target: str = "value_stm", path: str | None = None) -> tuple[DataFrame, dict[str, TrainingRun]]:
    """Every arm trained (with a checkpoint of its own under ``path``): the table by validation error, and the runs."""
    if len({a.name for a in arms}) != len(arms):
        raise ValueError("arms must have different names")
    runs = {a.name: train(train_rows, val_rows, a.config(base), target, f"{path}/{a.name}.json" if path else None, a.name) for a in arms}
    rows = [(a.name, a.rationale, json.dumps(a.changes, sort_keys=True), runs[a.name].history.best.epoch, runs[a.name].history.best.val_rmse) for a in arms]
    table = train_rows.sparkSession.createDataFrame(rows, "name string, rationale string, changes string, best_epoch int, val_rmse double")
    return table.orderBy("val_rmse", "name"), runs
