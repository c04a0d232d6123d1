"""Settings of a dataset build, with the defaults that define its semantics."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


# Names, order and defaults of the settings below define the semantics of a build and its YAML files.


@dataclass(frozen=True)
class SourceConfig:
    base_url: str = ""
    dumps: tuple[str, ...] = ()
    local_dir: str | None = None
    name: str = "rated_{dump}"

    def dump_name(self, dump: str) -> str:
        return self.name.format(dump=dump)

    def dump_url(self, dump: str) -> str:
        """Where a dump lies: in the local folder if one is given, else under the base address."""
        return f"{(self.local_dir or self.base_url).rstrip('/')}/{self.dump_name(dump)}.pgn.zst"


@dataclass(frozen=True)
class FilterConfig:
    min_elo: int = 2200
    time_controls: tuple[str, ...] = ("Blitz", "Rapid", "Classical")
    rated_only: bool = True
    min_plies: int = 20
    excluded_terminations: tuple[str, ...] = ("Abandoned", "Rules infraction", "Unterminated")


@dataclass(frozen=True)
class SamplingConfig:
    positions_per_game: int = 4
    balance_by_turn: bool = True
    seed: int = 20260909


@dataclass(frozen=True)
class LabelingConfig:
    engine_path: str = "stockfish"
    depth: int = 12
    threads_per_engine: int = 1
    hash_mb: int = 64
    workers: int | None = None


@dataclass(frozen=True)
class NormalizationConfig:
    scale: float = 400.0
    cp_clip: int = 2000


@dataclass(frozen=True)
class OutputConfig:
    games_per_shard: int = 5000
    local_dir: str = "dataset"
    extract_dir: str = "extracts"
    state_path: str = "state.json"


@dataclass(frozen=True)
class ValidationConfig:
    max_turn_share: float = 0.55


class SplitConfigError(ValueError):
    """The shares of a split do not make a partition."""


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.90
    val: float = 0.05
    test: float = 0.05
    seed: int = 20260911

    def __post_init__(self) -> None:
        shares = (self.train, self.val, self.test)
        if any(not 0 <= s <= 1 for s in shares) or abs(sum(shares) - 1) > 1e-9:
            raise SplitConfigError(f"shares must lie in [0, 1] and sum to 1: {shares}")
        if not (self.val and self.test):
            raise SplitConfigError("val and test must not be empty")

    @property
    def bounds(self) -> tuple[float, float]:
        return self.train, self.train + self.val


@dataclass(frozen=True)
class TrainingConfig:
    split_train: float = 0.90
    split_val: float = 0.05
    split_test: float = 0.05
    split_seed: int = 20260911
    batch_size: int = 1024
    epochs: int = 30
    learning_rate: float = 0.001
    weight_decay: float = 0.0001
    loss: str = "mse"

    def split_config(self) -> SplitConfig:
        return SplitConfig(self.split_train, self.split_val, self.split_test, self.split_seed)


@dataclass(frozen=True)
class DatasetConfig:
    version: str = "v1"
    source: SourceConfig = field(default_factory=SourceConfig)
    filter: FilterConfig = field(default_factory=FilterConfig)
    sampling: SamplingConfig = field(default_factory=SamplingConfig)
    labeling: LabelingConfig = field(default_factory=LabelingConfig)
    normalization: NormalizationConfig = field(default_factory=NormalizationConfig)
    output: OutputConfig = field(default_factory=OutputConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> DatasetConfig:
        """Sections by name; a key a section does not know raises, an unknown section is left out."""
        values: dict[str, Any] = {}
        for f in dataclasses.fields(cls):
            if f.name not in raw:
                continue
            value = raw[f.name]
            if f.default_factory is not dataclasses.MISSING:
                section = f.default_factory
                known = {x.name for x in dataclasses.fields(section)}
                unknown = set(value or {}) - known
                if unknown:
                    raise ValueError(f"section {f.name}: unknown keys {sorted(unknown)}")
                value = section(**{k: tuple(v) if isinstance(v, list) else v for k, v in (value or {}).items()})
            values[f.name] = value
        return cls(**values)

    @classmethod
    def from_yaml(cls, path: str | Path) -> DatasetConfig:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
