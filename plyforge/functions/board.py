"""Position text (FEN) as columns: fields, usual form, side to move, material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields(fen: Column) -> Column:
    """The blank-separated fields, whatever stands between them (blanks, tabs, underscores)."""
    return F.split(F.regexp_replace(fen, r"^[\s_\u00a0]+|[\s_\u00a0]+$", ""), r"[\s_\u00a0]+")


def side_to_move(fen: Column) -> Column:
    """True for White, False for Black, null where the second field is neither."""
    side = F.lower(F.get(fields(fen), F.lit(1)))
    return F.when(side == "w", True).when(side == "b", False)


def expanded(placement: Column) -> Column:
    """Placement with each empty square written as a dot: eight ranks of eight, slashes between (71 characters)."""
    out = placement
    for n in range(1, 9):
        out = F.replace(out, F.lit(str(n)), F.lit("." * n))
    return out


def collapsed(squares: Column) -> Column:
    """The reverse of ``expanded``: every run of dots as one digit."""
    out = squares
    for n in range(8, 0, -1):
        out = F.replace(out, F.lit("." * n), F.lit(str(n)))
    return out


def placement(fen: Column) -> Column:
    """The first field: the pieces, rank by rank."""
    return F.get(fields(fen), F.lit(0))


def squares64(fen: Column) -> Column:
    """The 64 squares from a8 to h1 as one string, dots for empty."""
    return F.replace(expanded(F.get(fields(fen), F.lit(0))), F.lit("/"), F.lit(""))


def _at(squares: Column, place) -> Column:
    return F.substr(squares, place if isinstance(place, Column) else F.lit(place), F.lit(1))


def with_usual(df: DataFrame, fen: str = "fen", name: str = "usual") -> DataFrame:
    """Add the first four fields in their usual form, blank-separated; null for a null text or one that is no position.

    Runs of empty squares are one digit; the side is lower case; castling rights stand in the order KQkq, given as
    such or by the rook's usual file, and need king and rook on their home squares; the en passant square stays only
    if the pawn that just moved is there and a pawn of the side to move stands beside it. Each intermediate value is
    a column of its own, so that it is computed once.
    """
    names = ("_part", "_grid", "_side", "_rights", "_ep", "_file", "_start")
    t = df.withColumn("_part", fields(F.col(fen)))
    t = t.withColumns(
        {
            "_grid": expanded(F.get("_part", F.lit(0))),
            "_side": F.lower(F.get("_part", F.lit(1))),
            "_rights": F.coalesce(F.get("_part", F.lit(2)), F.lit("-")),
            "_ep": F.lower(F.coalesce(F.get("_part", F.lit(3)), F.lit("-"))),
        }
    )
    t = t.withColumns({"_file": F.ascii("_ep") - 96, "_start": F.when(F.col("_side") == "w", 27).otherwise(36)})
    grid, side, ep, file, start = (F.col(c) for c in ("_grid", "_side", "_ep", "_file", "_start"))

    def right(letters: str, king: int, rook: int, pieces: str, sign: str) -> Column:
        given = F.contains(F.col("_rights"), F.lit(letters[0])) | F.contains(F.col("_rights"), F.lit(letters[1]))
        return F.when(given & (_at(grid, king) == pieces[0]) & (_at(grid, rook) == pieces[1]), F.lit(sign)).otherwise(F.lit(""))

    castling = F.concat(
        right("KH", 68, 71, "KR", "K"), right("QA", 68, 64, "KR", "Q"), right("kh", 5, 8, "kr", "k"), right("qa", 5, 1, "kr", "q")
    )
    # the pushed pawn's rank begins one place after _start; a slash before it and after it is no pawn
    pushed, own = F.when(side == "w", "p").otherwise("P"), F.when(side == "w", "P").otherwise("p")
    beside = (_at(grid, start + file - 1) == own) | (_at(grid, start + file + 1) == own)
    counts = (ep != "-") & ep.rlike("^[a-h][36]$") & (F.substr(ep, F.lit(2), F.lit(1)) == F.when(side == "w", "6").otherwise("3"))
    counts = counts & (_at(grid, start + file) == pushed) & beside
    legal = (F.length(grid) == 71) & side.isin("w", "b") & grid.rlike("^(?:[pnbrqkPNBRQK.]{8}/){7}[pnbrqkPNBRQK.]{8}$")
    text = F.concat_ws(" ", collapsed(grid), side, F.coalesce(F.nullif(castling, F.lit("")), F.lit("-")), F.when(counts, ep).otherwise(F.lit("-")))
    return t.withColumn(name, F.when(legal, text)).drop(*names)


def material(squares: Column, piece: str) -> Column:
    """How many of one piece letter stand on the board (64 squares or a placement; best a column of its own)."""
    return F.length(squares) - F.length(F.replace(squares, F.lit(piece), F.lit("")))


def material_balance(squares: Column) -> Column:
    """White minus Black in pawns at 1, 3, 3, 5, 9."""
    out = F.lit(0)
    for piece, worth in (("P", 1), ("N", 3), ("B", 3), ("R", 5), ("Q", 9)):
        out = out + worth * (material(squares, piece) - material(squares, piece.lower()))
    return out
