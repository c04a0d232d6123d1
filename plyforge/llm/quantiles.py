"""Percentiles of very large numeric columns from mergeable sketches with relative rank error.

A sketch is a stack of relative-rank compactors: level i holds values that stand for 2**i each. A full compactor keeps
the values of the protected tail and halves some sections of the rest (every second value, odd or even by a coin, goes
one level up); which sections follows a counter as in a binary schedule, and sections get more and smaller as it grows.
So the error in rank is proportional to the distance from the protected tail: percentiles up to the 50th are read
from a sketch that protects low values, others from one that protects high values. Sketches of partitions or days are
merged level by level, with the same bound.

Nulls are not counted. A group without values has no sketch, hence no row. Repeated values count as often as they occur.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTION = 48
SECTIONS = 3
FAN_IN = 64
#: One standard deviation of the relative rank error is sqrt(SPREAD / SECTIONS) / SECTION; bounds take SIGMAS of them.
SPREAD, SIGMAS = 0.06, 6.0


class Sketch:
    """One relative-rank sketch; ``high`` protects the largest values, otherwise the smallest."""

    def __init__(self, high: bool = False, seed: int = 1):
        self.high, self.n = high, 0
        self.levels: list[list] = []  # [values, counter, sections, section size]
        self.coin = np.random.default_rng(seed)

    def _level(self, i: int) -> list:
        while len(self.levels) <= i:
            self.levels.append([np.zeros(0), 0, SECTIONS, SECTION])
        return self.levels[i]

    def update(self, values: np.ndarray) -> None:
        level = self._level(0)
        level[0] = np.concatenate([level[0], values])
        self.n += len(values)
        self._compress()

    def merge(self, other: Sketch) -> None:
        for i, (values, counter, sections, size) in enumerate(other.levels):
            level = self._level(i)
            level[0] = np.concatenate([level[0], values])
            level[1] |= counter
            if sections > level[2]:
                level[2], level[3] = sections, size
        self.n += other.n
        self._compress()

    def _compress(self) -> None:
        i = 0
        while i < len(self.levels):
            while len(self.levels[i][0]) >= 2 * self.levels[i][2] * self.levels[i][3]:
                self._compact(i)
            i += 1

    def _compact(self, i: int) -> None:
        level = self.levels[i]
        values, counter, sections, size = level
        values = np.sort(values)
        if self.high:
            values = values[::-1]
        trailing = 0
        while counter >> trailing & 1:
            trailing += 1
        kept = sections * size + max(0, sections - 1 - trailing) * size
        kept += (len(values) - kept) % 2
        upper = values[kept:]
        level[0], level[1] = values[:kept], counter + 1
        if level[1] >= 1 << (sections - 1) and size > 8:
            level[2], level[3] = sections * 2, max(8, int(size / math.sqrt(2)) // 2 * 2)
        up = self._level(i + 1)
        up[0] = np.concatenate([up[0], upper[int(self.coin.integers(2)) :: 2]])

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate([lv[0] for lv in self.levels]) if self.levels else np.zeros(0)
        weights = np.concatenate([np.full(len(lv[0]), 1 << i, np.int64) for i, lv in enumerate(self.levels)]) if self.levels else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    @property
    def exact(self) -> bool:
        return len(self.levels) <= 1 or not any(len(lv[0]) for lv in self.levels[1:])

    def quantile(self, pct: float) -> tuple[float, float, float]:
        """The nearest-rank percentile with a lower and an upper bound."""
        values, ends = self._weighted()
        rank = max(1, math.ceil(pct * self.n / 100))
        far = self.n - rank + 1 if self.high else rank
        error = 0 if self.exact else SIGMAS * math.sqrt(SPREAD / SECTIONS) / SECTION * far + 1

        def at(r: float) -> float:
            return float(values[min(len(values) - 1, int(np.searchsorted(ends, min(max(r, 1), self.n), "left")))])

        return at(rank), at(math.floor(rank - error)), at(math.ceil(rank + error))

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<?qi", self.high, self.n, len(self.levels))]
        for values, counter, sections, size in self.levels:
            parts.append(struct.pack("<qqiii", counter, self.n, sections, size, len(values)) + values.astype("<f8").tobytes())
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, seed: int = 1) -> Sketch:
        high, n, count = struct.unpack_from("<?qi", data)
        sketch, at = cls(high, seed), struct.calcsize("<?qi")
        sketch.n = n
        for _ in range(count):
            counter, _, sections, size, length = struct.unpack_from("<qqiii", data, at)
            at += struct.calcsize("<qqiii")
            sketch.levels.append([np.frombuffer(data, "<f8", length, at).copy(), counter, sections, size])
            at += 8 * length
        return sketch


#: Sketches a task holds before it hands them on and begins others: bounds its memory where groups are many.
HELD_SKETCHES = 20_000


def _sketch_partition(keys: list[str], fields: list[str]):
    kinds = [pa.string()] * (len(keys) + 1) + [pa.bool_(), pa.int32(), pa.binary()]

    def handed_on(sketches: dict[tuple, Sketch], part: int) -> pa.RecordBatch:
        rows = [(*(None if g is None or g != g else g for g in k[:-2]), k[-2], k[-1], part, s.to_bytes()) for k, s in sketches.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*keys, "field", "high", "part", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        sketches: dict[tuple, Sketch] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for group, rows in frame.groupby(keys, sort=False, dropna=False).indices.items():
                group = group if isinstance(group, tuple) else (group,)
                for f in fields:
                    values = frame[f].to_numpy(float, na_value=np.nan)[rows]
                    values = values[~np.isnan(values)]
                    if len(values):
                        for high in (False, True):
                            key = (*group, f, high)
                            if key not in sketches:
                                sketches[key] = Sketch(high, seed=part + 1)
                            sketches[key].update(values)
            if len(sketches) > HELD_SKETCHES:
                yield handed_on(sketches, part)
                sketches = {}
        if sketches:
            yield handed_on(sketches, part)

    return run


def _merge(names: list[str], slot: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        merged = Sketch.from_bytes(rows["sketch"].iloc[0], seed=len(rows))
        for data in rows["sketch"].iloc[1:]:
            merged.merge(Sketch.from_bytes(data))
        first = rows.iloc[[0]][names].copy()
        first["part"] = int(rows["part"].iloc[0]) % FAN_IN if slot else 0
        first["sketch"] = [merged.to_bytes()]
        return first

    return run


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch for each (keys, field, high): of partitions first in ``FAN_IN`` parts, then of these."""
    names = [*keys, "field", "high"]
    schema = ", ".join(f"{k} string" for k in keys) + ", field string, high boolean, part int, sketch binary"
    once = sketches.select(*names, "part", "sketch").withColumn("_slot", F.pmod("part", F.lit(FAN_IN)))
    some = once.groupBy(*names, "_slot").applyInPandas(_merge(names, True), schema)
    return some.groupBy(*names).applyInPandas(_merge(names, False), schema)


def sketch(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, high, part, sketch): sketches of each numeric column of ``fields`` per group of string ``keys``."""
    schema = ", ".join(f"{k} string" for k in keys) + ", field string, high boolean, part int, sketch binary"
    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields])
    return merged(rows.mapInArrow(_sketch_partition(keys, fields), schema), keys)


def percentiles(sketches: DataFrame, keys: list[str], pcts: list[int]) -> DataFrame:
    """(keys, field, n, pct, value, lower, upper) from sketches; the true nearest-rank value lies within the bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                s = Sketch.from_bytes(row["sketch"])
                for pct in pcts:
                    if s.high == (pct > 50):
                        value, low, high = s.quantile(pct)
                        out.append((*(row[k] for k in keys), row["field"], s.n, pct, value, low, high))
            yield pd.DataFrame(out, columns=[*keys, "field", "n", "pct", "value", "lower", "upper"])

    schema = ", ".join(f"{k} string" for k in keys) + ", field string, n bigint, pct int, value double, lower double, upper double"
    return sketches.mapInPandas(run, schema)


def outside_bands(df: DataFrame, bands: DataFrame, min_rows: int, day: str = "src_dump", category: str = "time_control") -> DataFrame:
    """(day, category, field, pct) of percentiles outside their band, for groups with at least ``min_rows`` values.

    ``df`` has day, category and the fields as columns (nulls are not counted); ``bands`` has category, field, pct,
    low, high. Where a sketch's bounds leave no doubt it decides; otherwise the values below the band and up to its
    end are counted, which settles it: the percentile of rank k is below ``low`` if at least k values are. Rows without
    a day are a group of their own, as in SQL's GROUP BY.
    """
    from plyforge import session

    keys = [day, category]
    wanted = bands.select(category, "field", F.col("pct").cast("int").alias("pct"), "low", "high")
    spec = [(r.field, r.pct) for r in wanted.select("field", "pct").distinct().collect()]
    fields = sorted({f for f, _ in spec})
    got = percentiles(sketch(df, keys, fields), keys, sorted({p for _, p in spec})).filter(F.col("n") >= min_rows)
    judged = got.join(F.broadcast(wanted) if wanted.limit(10_001).count() <= 10_000 else wanted, [category, "field", "pct"])
    off = (F.col("upper") < F.col("low")) | (F.col("lower") > F.col("high"))
    fine = (F.col("lower") >= F.col("low")) & (F.col("upper") <= F.col("high"))
    judged = session.cut(judged.withColumn("off", F.when(off, True).when(fine, False)), "bands-judged")
    open_ = judged.filter("off is null").select(day, category, "field", "pct", "n", "low", "high")
    value: Column = F.lit(None).cast("double")
    for f in fields:
        value = F.when(F.col("field") == f, F.col(f)).otherwise(value)
    open_ = open_.withColumnsRenamed({day: "_day", category: "_category"})
    same = F.col(day).eqNullSafe(F.col("_day")) & (F.col(category) == F.col("_category"))
    counted = df.select(*keys, *fields).join(F.broadcast(open_) if open_.limit(10_001).count() <= 10_000 else open_, same).withColumn("_v", value)
    counted = counted.groupBy(day, category, "field", "pct", "n", "low", "high").agg(
        F.count_if(F.col("_v") < F.col("low")).alias("below"), F.count_if(F.col("_v") <= F.col("high")).alias("upto")
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("n") / 100))
    settled = counted.filter((F.col("below") >= rank) | (F.col("upto") < rank))
    names = [day, category, "field", "pct"]
    return judged.filter("off").select(*names).unionByName(settled.select(*names))
