"""Game dumps as tables: a Python data source for PGN, plain or zstd, and the writer.

A game begins where a header line follows movetext. Lines are read forward once. With header conditions (``accept``)
the reader decides on a game when its movetext begins: of a rejected game no movetext is kept, joined or sent on, its
row has headers only. A zstd file cannot be split and is one partition; a plain local file is read in parts of
``split_bytes``, each of which has the games that begin in it.
"""

from __future__ import annotations

import glob
import io
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plyforge import session
from plyforge.config import FilterConfig
from plyforge.functions.refs import BLANKS, CATEGORIES, CLOCK_BOUNDS

#: Headers kept of a game.
HEADERS = ("Event", "Site", "Result", "WhiteElo", "BlackElo", "TimeControl", "Termination")
SCHEMA = "source string, game_seq bigint, headers map<string,string>, movetext string"

#: How far before a part its reader begins, to know whether movetext precedes it.
LOOK_BACK = 1 << 16
_HEADER = re.compile(r'\[(\w+)\s+"(.*)"\]\s*')


def header_rating(text: str | None) -> int | None:
    """A rating written as a whole number, as ``ingest.elo`` reads it."""
    word = (text or "").strip(BLANKS)
    return int(word) if re.fullmatch(r"[+-]?[0-9]{1,9}", word) else None


def headers_accepted(headers: dict[str, str], cfg: FilterConfig) -> bool:
    """What ``ingest.accepts`` says of a game, on its headers in Python."""
    event = headers.get("Event") or ""
    if cfg.rated_only and not event.startswith("Rated"):
        return False
    if (headers.get("Termination") or "") in cfg.excluded_terminations:
        return False
    ratings = [header_rating(headers.get(k)) for k in ("WhiteElo", "BlackElo")]
    if any(r is None or r < cfg.min_elo for r in ratings):
        return False
    named = next((c for c in CATEGORIES if c in event), None)
    if named is None:
        clock = (headers.get("TimeControl") or "").strip(BLANKS)
        parts = re.fullmatch(r"([0-9]{1,9})[+]([0-9]{1,9})", clock)
        if clock == "-":
            named = "Correspondence"
        elif parts:
            seconds = int(parts[1]) + 40 * int(parts[2])
            named = next((name for bound, name in CLOCK_BOUNDS if seconds <= bound), "Classical")
    return named in cfg.time_controls


def games(lines: Iterable[str], wanted: Callable[[dict[str, str]], bool] | None = None) -> Iterator[tuple[dict[str, str], str | None]]:
    """(headers, movetext) of every game in the lines of a dump; no movetext where the headers are not ``wanted``."""
    for _, headers, moves in placed_games(((0, line) for line in lines), wanted):
        yield headers, moves


def placed_games(lines: Iterable[tuple[int, str]], wanted: Callable[[dict[str, str]], bool] | None = None) -> Iterator[tuple[int, dict[str, str], str | None]]:
    """(place of its first line, headers, movetext) of every game in the placed lines of a dump."""
    headers: dict[str, str] = {}
    moves: list[str] = []
    begun, keep, at = False, True, -1  # whether movetext has come; whether it is kept; where the game began
    for place, line in lines:
        if line.startswith("["):
            if begun:
                yield at, headers, "".join(moves) if keep else None
                headers, moves, begun, at = {}, [], False, -1
            at = place if at < 0 else at
            got = _HEADER.fullmatch(line.rstrip("\r\n"))
            if got and got[1] in HEADERS:
                headers[got[1]] = got[2]
        elif line.strip():
            if not begun:
                begun, keep = True, wanted is None or wanted(headers)
                at = place if at < 0 else at
            if keep:
                moves.append(line)
    if begun:
        yield at, headers, "".join(moves) if keep else None


def games_of_part(path: str, start: int, end: int, wanted: Callable[[dict[str, str]], bool] | None = None) -> Iterator[tuple[int, dict[str, str], str | None]]:
    """The games of a plain file whose first line begins in [start, end), with that place."""

    def lines() -> Iterator[tuple[int, str]]:
        with open(path, "rb") as file:
            at = max(0, start - LOOK_BACK)
            file.seek(at)
            moves = False  # whether movetext stands between this line and the header line before
            if at:
                skipped = file.readline()
                at += len(skipped)
                if at > start:  # a line longer than the look-back is movetext
                    yield start - 1, "-\n"
                    moves = True
            for raw in file:
                text = raw.decode("utf-8", "replace")
                head = text.startswith("[")
                if at >= end and head and moves:
                    return  # the next part's first game
                moves = (moves and not head) or (not head and bool(text.strip()))
                yield at, text
                at += len(raw)

    for place, headers, moves in placed_games(lines(), wanted):
        if start <= place < end:
            yield place, headers, moves


def open_text(path: str) -> io.TextIOBase:
    """The dump as text, decoded leniently; ``http(s)`` and other file systems by their scheme."""
    if path.startswith(("http://", "https://")):
        from urllib.request import Request, urlopen

        raw = urlopen(Request(path, headers={"User-Agent": "plyforge"}), timeout=60)
    elif "://" in path:
        import pyarrow.fs as pafs

        fs, inner = pafs.FileSystem.from_uri(path)
        raw = fs.open_input_stream(inner, compression=None)
    else:
        raw = open(path, "rb")
    if path.endswith(".zst"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    elif path.endswith(".gz"):
        import gzip

        raw = gzip.GzipFile(fileobj=raw)
    return io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n")


class _Part(InputPartition):
    """A file, or with ``end`` the part of it in which games begin."""

    def __init__(self, path: str, start: int = 0, end: int = 0):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


class PgnReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for part in options["path"].split(",") for p in (sorted(glob.glob(part)) if "://" not in part and glob.has_magic(part) else [part])]
        self.scanned, self.limit, self.split = int(options.get("maxScanned", 0)), int(options.get("maxGames", 0)), int(options.get("splitBytes", 1 << 26))
        accept = options.get("accept")
        self.filter = FilterConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(accept).items()}) if accept else None

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path in self.paths:
            whole = "://" in path or path.endswith((".zst", ".gz")) or self.scanned or self.limit or os.path.getsize(path) <= self.split
            parts += [_Part(path)] if whole else [_Part(path, at, at + self.split) for at in range(0, os.path.getsize(path), self.split)]
        return parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        wanted = (lambda headers: headers_accepted(headers, self.filter)) if self.filter else None
        if partition.end:
            for place, headers, moves in games_of_part(partition.path, partition.start, partition.end, wanted):
                yield partition.path, place + 1, headers, moves
            return
        kept = 0
        with open_text(partition.path) as text:
            for n, (headers, moves) in enumerate(games(text, wanted), 1):
                if self.scanned and n > self.scanned:
                    return
                yield partition.path, n, headers, moves
                kept += moves is not None
                if self.limit and kept >= self.limit:
                    return


class PgnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PgnReader(self.options)


def read(spark: SparkSession, *paths: str, max_games: int = 0, max_scanned: int = 0, accept: FilterConfig | None = None, split_bytes: int = 1 << 26) -> DataFrame:
    """(source, game_seq, headers, movetext) of dumps, one partition a file or part of one.

    With ``accept`` games that its header conditions reject have no movetext. Of each file reading ends after
    ``max_scanned`` games, or after ``max_games`` that have movetext (0 for all). ``game_seq`` follows the file's order:
    it counts games from 1, or in a plain file larger than ``split_bytes`` is the byte a game begins with, from 1.
    """
    spark.dataSource.register(PgnSource)
    reader = spark.read.format("pgn").option("maxGames", max_games).option("maxScanned", max_scanned).option("splitBytes", split_bytes)
    if accept is not None:
        reader = reader.option("accept", json.dumps(asdict(accept)))
    return reader.load(",".join(paths))


def files(spark: SparkSession, folder: str) -> list[str]:
    """The dump files in a folder of any file system, in order of their names."""
    hpath, fs, _ = session._hadoop(spark, folder)
    names = [str(f.getPath().toString()) for f in fs.listStatus(hpath) if not f.getPath().getName().startswith(("_", "."))]
    return sorted(n.removeprefix("file://").replace("file:/", "/") if n.startswith("file:") else n for n in names)


def flat(df: DataFrame) -> DataFrame:
    """Headers as columns of their own."""
    h = F.col("headers")
    names = {"Event": "event_text", "Site": "site", "Result": "result", "WhiteElo": "white_elo", "BlackElo": "black_elo", "TimeControl": "time_control", "Termination": "termination"}
    return df.select("source", "game_seq", *[h[k].alias(v) for k, v in names.items()], "movetext")


def as_text(headers: Column, movetext: Column) -> Column:
    """A game as PGN text; a header's value is one line, line breaks in it becoming blanks."""
    one_line = lambda v: F.regexp_replace(v, r"[\r\n]+", " ")
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(F.lit("["), e["key"], F.lit(' "'), one_line(e["value"]), F.lit('"]')))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), F.rtrim(movetext), F.lit("\n"))


def write_text(df: DataFrame, path: str) -> None:
    """Write games as gzip-compressed PGN text."""
    df.select(as_text(F.col("headers"), F.col("movetext")).alias("value")).write.option("compression", "gzip").text(path)
