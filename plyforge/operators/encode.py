"""Positions as planes: bytes in Parquet in place of a tensor file, and JVM-side features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.functions import board, rules

PLANES, BYTES = 18, 18 * 64
PIECES = ("pawn", "knight", "bishop", "rook", "queen", "king")


_BLANK = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_LETTERS = "PNBRQKpnbrqk"


@F.pandas_udf(T.BinaryType())
def _packed(own: pd.Series, rights: pd.Series, half: pd.Series, square: pd.Series, fen: pd.Series) -> pd.Series:
    """The planes of a batch at once, as numpy arrays; only texts with an en passant square are read by the rules."""
    have = own.notna().to_numpy()
    n = int(have.sum())
    out = np.zeros((n, PLANES, 64), np.uint8)
    if n:
        squares = np.frombuffer("".join(own[have]).encode("ascii"), np.uint8).reshape(n, 1, 64)
        out[:, :12] = squares == np.frombuffer(_LETTERS.encode("ascii"), np.uint8).reshape(1, 12, 1)
        out[:, 12:16] = (np.frombuffer("".join(rights[have]).encode("ascii"), np.uint8).reshape(n, 4) - 48)[:, :, None]
        out[:, 17] = half[have].to_numpy(np.uint8)[:, None]
        marks = square[have].to_numpy()
        for k in np.flatnonzero(~pd.isna(marks)):
            if rules.Position.read(fen[have].iloc[k]).legal_ep():
                out[k, 16, int(marks[k])] = 1
    data, rows = out.tobytes(), np.cumsum(have) - 1
    return pd.Series([data[BYTES * r : BYTES * (r + 1)] if ok else None for r, ok in zip(rows, have)], dtype=object)


def with_planes(df: DataFrame, fen: str = "fen", name: str = "planes") -> DataFrame:
    """Add 1152 bytes (18 planes, see ``rules.planes``) for each position; null for null and for no position.

    The text is taken apart JVM-side into 64 squares from the mover's view, four rights, the clock and the en passant
    square; an Arrow batch of these becomes planes in a few array operations (measured faster than ``translate`` on strings,
    whose code is too large to be compiled, and than a board for each row).
    """
    names = ("_p", "_side", "_rights", "_ep", "_half", "_grid", "_legal")
    text = F.btrim(F.regexp_replace(F.col(fen), _BLANK, " "))
    t = df.withColumn("_p", F.split(text, " "))
    part = lambda k, default: F.coalesce(F.get("_p", F.lit(k)), F.lit(default))
    t = t.withColumns({"_side": part(1, "w"), "_rights": part(2, "-"), "_ep": part(3, "-"), "_half": part(4, "0"), "_grid": board.expanded(F.get("_p", F.lit(0)))})
    side, rights, ep, half, grid = (F.col(c) for c in ("_side", "_rights", "_ep", "_half", "_grid"))
    legal = (F.size("_p") <= 6) & ~F.get("_p", F.lit(0)).rlike("[0-9]{2}|[^1-8pnbrqkPNBRQK/]") & (F.length(grid) == 71)
    legal = legal & grid.rlike("^(?:[pnbrqkPNBRQK.]{8}/){7}[pnbrqkPNBRQK.]{8}$") & side.isin("w", "b")
    legal = legal & rights.rlike("^(?:-|(?=.)[KQA-H]{0,2}[kqa-h]{0,2})$") & ep.rlike("^(?:-|[a-h][1-8])$") & half.rlike("^[0-9]+$") & part(5, "1").rlike("^[0-9]+$")
    white = side == "w"
    at = lambda k: F.substr(grid, F.lit(k), F.lit(1))

    def right(letters: str, king: int, rook: int, pieces: str) -> Column:
        given = F.contains(rights, F.lit(letters[0])) | F.contains(rights, F.lit(letters[1]))
        return given & (at(king) == pieces[0]) & (at(rook) == pieces[1])

    held = [right("KH", 68, 71, "KR"), right("QA", 68, 64, "KR"), right("kh", 5, 8, "kr"), right("qa", 5, 1, "kr")]
    ranks = [F.substr(grid, F.lit(9 * r + 1), F.lit(8)) for r in range(7, -1, -1)]
    # the mover's first rank comes first, the mover's pieces in capitals
    turned = F.translate(F.replace(grid, F.lit("/"), F.lit("")), _LETTERS, _LETTERS.swapcase())
    t = t.withColumn("_legal", F.coalesce(legal, F.lit(False)))
    legal = F.col("_legal")
    flags = [F.when(F.when(white, held[k]).otherwise(held[k ^ 2]), "1").otherwise("0") for k in range(4)]
    file, rank = F.ascii(ep) - 97, F.ascii(F.substr(ep, F.lit(2), F.lit(1))) - 49
    square = F.when(legal & (ep != "-"), F.when(white, rank * 8 + file).otherwise((7 - rank) * 8 + file))
    short = F.ltrim(half, F.lit("0"))
    clock = F.when(F.length(short) > 2, F.lit(100)).otherwise(F.coalesce(F.when(short.rlike("^[0-9]+$"), short).cast("int"), F.lit(0)))
    own = F.when(legal, F.when(white, F.concat(*ranks)).otherwise(turned))
    planes = _packed(own, F.concat(*flags), F.when(legal, clock), square, F.when(square.isNotNull(), F.col(fen)))
    return t.withColumn(name, planes).drop(*names)


def decoded(data: bytes) -> np.ndarray:
    """(18, 8, 8) of float32, the clock scaled to [0, 1]."""
    out = np.frombuffer(data, np.uint8).reshape(PLANES, 8, 8).astype(np.float32)
    out[17] /= 100
    return out


def cached(df: DataFrame, path: str, fen: str = "fen") -> DataFrame:
    """Write the rows with ``planes`` once and read them back; the commit is atomic, so a broken write leaves nothing."""
    with_planes(df, fen).write.option("compression", "zstd").parquet(path)
    return load_cache(df.sparkSession, path)


class CacheMismatchError(ValueError):
    """A cache does not hold the rows it should."""


def load_cache(spark, path: str, expected_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if expected_rows is not None and (n := df.count()) != expected_rows:
        raise CacheMismatchError(f"{path} has {n} rows, not {expected_rows}")
    return df


def cache_size(rows: int) -> int:
    return rows * BYTES


def cache_path(folder: str, split: str, version: str = "v1") -> str:
    """Where the encoded rows of a split are kept."""
    return f"{folder.rstrip('/')}/planes-{version}-{split}.parquet"


def mirrored(squares: Column) -> Column:
    """The 64 squares seen from the other side: ranks in reverse, colours exchanged."""
    ranks = [F.substr(squares, F.lit(8 * r + 1), F.lit(8)) for r in range(7, -1, -1)]
    return F.translate(F.concat(*ranks), "PNBRQKpnbrqk", "pnbrqkPNBRQK")


def material_features(df: DataFrame, fen: str = "fen") -> DataFrame:
    """Add own minus opponent's count of each piece type, ``d_pawn`` to ``d_king``, JVM-side; null for no side to move."""
    side = board.side_to_move(F.col(fen))
    t = df.withColumn("_squares", board.placement(F.col(fen))).withColumn("_own", F.when(side, 1).when(~side, -1))
    cols = {}
    for piece, letter in zip(PIECES, "PNBRQK"):
        diff = board.material(F.col("_squares"), letter) - board.material(F.col("_squares"), letter.lower())
        cols[f"d_{piece}"] = F.col("_own") * diff
    return t.withColumns(cols).drop("_squares", "_own")


def encoding_sanity(df: DataFrame) -> DataFrame:
    """One row: encoded rows, wrong lengths, and rows without exactly one king on each side."""
    ones = lambda k: F.length(F.translate(F.hex(F.substr("planes", F.lit(64 * k + 1), F.lit(64))), "0", ""))
    return df.agg(
        F.count("planes").alias("encoded"),
        F.count_if(F.length("planes") != BYTES).alias("wrong_length"),
        F.count_if((ones(5) != 1) | (ones(11) != 1)).alias("not_one_king"),
    )
