"""A log-structured store of sorted runs on the shared folder.

A run holds rows (h, key, payload...), h being 32 bits of a hash of the 64-bit key, in immutable Parquet files: each run
has as many files as its own size asks for, each with an equal range of h (the file fences, told by its number), sorted
by h and cut into blocks whose smallest and largest h stand in the file's footer (the block fences). A flush writes a
run of level 0; ``fan_out`` runs of a level are merged into one of the next. Nothing of the store is kept in memory.
Which runs count is said by a manifest of which every change is a new version (``session.write_text``), so a crash at
any point leaves the state before or after a change; a run that no manifest names is written over.

A probe is partitioned and sorted by h like a run and merged with each: fences choose the files and blocks to read, only
column h of these is read, and full keys and payload only of blocks where a hash was hit. History is never shuffled
again. Rows of one run that have equal keys lie side by side, so pairs of them (``twins``) are found without a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge import session

#: Rows below which a run's file is not worth a task of its own.
LEAST_ROWS = 50_000
#: Names that Hadoop and Arrow give to one file system.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def hash32(key: Column) -> Column:
    return F.shiftright(F.xxhash64(key), 32).cast("int")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.FileSystem.from_uri(f"file://{path}")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def _place(h: Column, parts: int) -> Column:
    """Which of ``parts`` equal ranges of h a row falls into."""
    return F.shiftright((h.cast("bigint") + F.lit(1 << 31)) * F.lit(parts), 32).cast("int")


def _places(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h.astype(np.int64) + (1 << 31)) * parts) >> 32


@dataclass
class Run:
    """One run: its folder, number of files and rows, and what its files' names have after their number."""

    name: str
    files: int
    rows: int
    suffix: str

    def file(self, k: int) -> str:
        return f"{self.name}/part-{k:05d}{self.suffix}"


class RunReader:
    """The blocks of one run, read in order and only where a probe falls between their fences."""

    def __init__(self, base: str, run: Run, payload: list[str]):
        self.fs, self.base = _open(base)
        self.run, self.payload = run, payload
        self.at, self.file, self.fences = -1, None, []
        self.block, self.hashes, self.rows = -1, None, None

    def open(self, k: int) -> pq.ParquetFile | None:
        """File ``k``; one that no row fell into does not exist."""
        try:
            return pq.ParquetFile(self.fs.open_input_file(f"{self.base}/{self.run.file(k)}"))
        except FileNotFoundError:
            return None

    def _turn_to(self, k: int) -> None:
        if self.at == k:
            return
        self.at, self.file, self.fences = k, self.open(k), []
        self.block, self.hashes, self.rows = -1, None, None
        if self.file is not None:
            column = self.file.schema_arrow.get_field_index("h")
            for g in range(self.file.num_row_groups):
                stats = self.file.metadata.row_group(g).column(column).statistics
                known = stats is not None and stats.has_min_max
                self.fences.append((stats.min if known else -(1 << 31), stats.max if known else (1 << 31) - 1))

    def match(self, h: np.ndarray, key: np.ndarray, hit: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table]]:
        """For the probes (h sorted): set ``hit`` where a hash is stored; yield (probe, stored rows) of equal keys."""
        files = _places(h, self.run.files)
        edges = np.flatnonzero(np.diff(files)) + 1
        for low, high in zip([0, *edges], [*edges, len(h)]):
            if low == high:
                continue
            self._turn_to(int(files[low]))
            for g, (least, most) in enumerate(self.fences):
                a, b = low + np.searchsorted(h[low:high], least, "left"), low + np.searchsorted(h[low:high], most, "right")
                if a != b:
                    yield from self._match_block(g, a, b, h, key, hit)

    def _match_block(self, g: int, a: int, b: int, h: np.ndarray, key: np.ndarray, hit: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table]]:
        if self.block != g:
            self.block, self.rows = g, None
            self.hashes = self.file.read_row_group(g, columns=["h"]).column(0).to_numpy()
        left, right = np.searchsorted(self.hashes, h[a:b], "left"), np.searchsorted(self.hashes, h[a:b], "right")
        at = np.flatnonzero(right > left)
        if not len(at):
            return
        hit[a + at] = True
        if self.rows is None:
            self.rows = self.file.read_row_group(g, columns=["key", *self.payload])
        count = (right - left)[at]
        probe = np.repeat(at, count)
        stored = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left[at], count)
        same = self.rows.column("key").to_numpy()[stored] == key[a + probe]
        if same.any():
            yield a + probe[same], self.rows.select(self.payload).take(pa.array(stored[same]))


def _prober(base: str, runs: list[Run], payload: list[str], out: pa.Schema):
    kept = [n for n in out.names if n not in ("hit", "found", *(f"old_{p}" for p in payload))]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [RunReader(base, run, payload) for run in runs]
        for batch in batches:
            h, key = batch.column("h").to_numpy(), batch.column("key").to_numpy()
            hit = np.zeros(len(h), bool)
            index, stored = [], []
            for reader in readers:
                for where, rows in reader.match(h, key, hit):
                    index.append(where)
                    stored.append(rows)
            matched = np.concatenate(index) if index else np.zeros(0, np.int64)
            rest = np.setdiff1d(np.arange(len(h)), matched)
            order = pa.array(np.concatenate([matched, rest]))
            columns = [batch.column(n).take(order) for n in kept]
            columns += [pa.array(hit).take(order), pa.array(np.arange(len(order)) < len(matched))]
            for p in payload:
                kind = out.field(f"old_{p}").type
                have = [chunk.cast(kind) for rows in stored for chunk in rows.column(p).chunks]
                columns.append(pa.concat_arrays([*have, pa.nulls(len(rest), kind)]))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "hit", "found", *(f"old_{p}" for p in payload)])

    return probe


def _twin_finder(base: str, run: Run, payload: list[str], out: pa.Schema):
    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, apart = rows.column("key").to_numpy(), 1
        while apart < len(key):
            left = np.flatnonzero(key[apart:] == key[:-apart])
            if not len(left):
                return
            for start in range(0, len(left), 100_000):
                some = left[start : start + 100_000]
                sides = [rows.select(payload).take(pa.array(some + d)) for d in (0, apart)]
                columns = [c.combine_chunks() for side in sides for c in side.columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)
            apart += 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RunReader(base, run, payload)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                file = reader.open(k)
                if file is None:
                    continue
                rest = None
                for g in range(file.num_row_groups):
                    rows = file.read_row_group(g, columns=["key", *payload])
                    rows = pa.concat_tables([rest, rows]) if rest is not None else rows
                    key = rows.column("key").to_numpy()
                    differs = np.flatnonzero(key != key[-1])
                    whole = int(differs[-1]) + 1 if len(differs) else 0  # the last key's rows may go on in the next block
                    yield from pairs(rows.slice(0, whole))
                    rest = rows.slice(whole)
                if rest is not None:
                    yield from pairs(rest)

    return find


@dataclass
class RunStore:
    """Levelled runs under ``path`` with columns ``payload`` (DDL) beside the key.

    With ``least`` a key's rows are merged in compaction into one with the smallest payload. With ``dictionary``, the
    columns that have few values, no dictionaries are tried for the others. A store with an ``owner``
    leaves commits to it: ``state`` is what to keep, and ``clean`` removes the runs that no longer count.
    """

    spark: SparkSession
    path: str
    payload: str = ""
    rows_per_file: int = 2_000_000
    fan_out: int = 4
    block_bytes: int = 1 << 20
    least: bool = False
    owned: bool = False
    dictionary: tuple[str, ...] | None = None
    levels: list[list[Run]] = field(default_factory=list)
    made: int = 0
    stale: list[str] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> RunStore:
        """The store whose manifest lies at ``path``, else a new one with ``options``."""
        text = session.read_text(spark, f"{path}/manifest.json")
        store = cls(spark, path, **options)
        if text:
            store.restore(json.loads(text))
        return store

    def restore(self, state: dict) -> None:
        self.levels = [[Run(**run) for run in level] for level in state["levels"]]
        self.payload, self.made = state["payload"], state["made"]

    @property
    def state(self) -> dict:
        return {"payload": self.payload, "made": self.made, "levels": [[vars(run) for run in level] for level in self.levels]}

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.payload) if self.payload else T.StructType()

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    @property
    def rows(self) -> int:
        return sum(run.rows for run in self.runs)

    def _commit(self) -> None:
        if not self.owned:
            session.write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))
            self.clean()

    def clean(self) -> None:
        """Remove the runs that were merged into others; only after a commit."""
        for name in self.stale:
            session.remove(self.spark, f"{self.path}/{name}")
        self.stale = []

    def _sorted(self, keyed: DataFrame, parts: int) -> DataFrame:
        """With h, each range of h in a task of its own, sorted."""
        h = hash32(F.col("key"))  # made anew after the shuffle rather than sent
        return keyed.repartitionById(parts, _place(h, parts)).withColumn("h", h).sortWithinPartitions("h", "key")

    def _write(self, rows: DataFrame, count: int) -> Run:
        self.made += 1
        cores = self.spark.sparkContext.defaultParallelism
        files = max(1, -(-count // self.rows_per_file), min(cores, -(-count // LEAST_ROWS)))
        name = f"run-{self.made:06d}"
        out = self._sorted(rows, files).select("h", "key", *self.schema.names)
        options = {"parquet.block.size": self.block_bytes, "parquet.writer.version": "v2"}
        if self.dictionary is not None:
            options |= {f"parquet.enable.dictionary#{c}": False for c in out.columns if c not in self.dictionary}
        out.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return Run(name, files, count, self._suffix(name))

    def _suffix(self, name: str) -> str:
        hpath, fs, _ = session._hadoop(self.spark, f"{self.path}/{name}")
        names = sorted(f.getPath().getName() for f in fs.listStatus(hpath))
        return next((n[len("part-00000") :] for n in names if n.startswith("part-")), "")

    def flush(self, rows: DataFrame, level: int = 0, compact: bool = True, about: int | None = None) -> Run | None:
        """Add rows (key and payload) as a run; none for no rows. They are counted first unless ``about`` how many is known."""
        count = rows.count() if about is None else about
        if not count:
            return None
        while len(self.levels) <= level:
            self.levels.append([])
        run = self._write(rows, count)
        self.levels[level].append(run)
        self._commit()
        if compact:
            self.compact()
        return run

    def scan(self, runs: list[Run] | None = None) -> DataFrame:
        """All rows (key and payload) of the runs."""
        schema = T.StructType([T.StructField("key", T.LongType()), *self.schema.fields])
        paths = [f"{self.path}/{run.name}" for run in (self.runs if runs is None else runs)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """Merge the runs of every level that has ``fan_out`` of them into one run of the next level."""
        level = 0
        while level < len(self.levels):
            old = self.levels[level]
            if len(old) >= self.fan_out:
                rows = self.scan(old)
                if self.least:
                    rows = rows.groupBy("key").agg(*[F.min(c).alias(c) for c in self.schema.names])
                merged = self._write(rows, sum(run.rows for run in old))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                self.levels[level] = []
                self.stale += [run.name for run in old]
                self._commit()  # the new run counts from here; a crash before leaves the old ones in force
            level += 1

    def probe(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a key, not null) with ``hit`` (its hash is stored), ``found`` (the key is) and the payload.

        A key stored in several rows gives as many rows; one that isn't stored gives one with nulls. Payload columns
        are named ``old_...``.
        """
        from pyspark.sql.pandas.types import to_arrow_schema

        out = T.StructType([*rows.schema.fields, T.StructField("hit", T.BooleanType()), T.StructField("found", T.BooleanType())])
        out = T.StructType([*out.fields, *(T.StructField(f"old_{f.name}", f.dataType) for f in self.schema.fields)])
        parts = max([self.spark.sparkContext.defaultParallelism, *(run.files for run in self.runs)])
        probing = self._sorted(rows, parts).select(*rows.columns, "h")
        return probing.mapInArrow(_prober(self.path, self.runs, self.schema.names, to_arrow_schema(out)), out)

    def twins(self, run: Run) -> DataFrame:
        """Each two rows of a run that have one key: the payload of the one, and of the other as ``old_...``."""
        from pyspark.sql.pandas.types import to_arrow_schema

        out = T.StructType([T.StructField(prefix + f.name, f.dataType) for prefix in ("", "old_") for f in self.schema.fields])
        files = self.spark.range(run.files, numPartitions=run.files)
        return files.mapInArrow(_twin_finder(self.path, run, self.schema.names, to_arrow_schema(out)), out)


class Rounds:
    """Results of rounds, each written to a folder of its own under ``path``, read as one table however many they are."""

    def __init__(self, spark: SparkSession, path: str, schema: str, done: int = 0):
        self.spark, self.path, self.schema, self.done = spark, path, schema, done

    def add(self, rows: DataFrame) -> DataFrame:
        at = f"{self.path}/round-{self.done:06d}"
        rows.select(*T.StructType.fromDDL(self.schema).names).write.mode("overwrite").parquet(at)
        self.done += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def read(self, first: int = 0) -> DataFrame:
        """The rounds from ``first`` on."""
        if first >= self.done:
            return self.spark.createDataFrame([], self.schema)
        if first == 0:
            return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round-{k:06d}" for k in range(first, self.done)])


def rounds(batches: DataFrame, flush_batches: int) -> list[tuple[int, int]]:
    """Ranges of rec_id, each of ``flush_batches`` batches; batches whose ranges overlap share one."""
    spans = batches.groupBy("batch_no").agg(F.min("rec_id").alias("a"), F.max("rec_id").alias("z")).filter("a is not null").collect()
    merged: list[list[int]] = []
    for a, z in sorted((r.a, r.z) for r in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    parts = [merged[i : i + flush_batches] for i in range(0, len(merged), flush_batches)]
    return [(part[0][0], part[-1][1]) for part in parts]
