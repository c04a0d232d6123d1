"""Evaluations as columns: centipawns, bounded values, labels, mate distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the evaluation scale and of search scores.
SCALE, CLIP = 400.0, 2000
MATE_CLAMP = 32000
MATE, MATE_STEP, DRAW, LOSS = 2.0, 0.01, 0.0, -1.0


def bounded(col: Column, top) -> Column:
    """``col`` within +-top; null stays null (greatest and least alone would pass it over)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(-top), F.least(F.lit(top), col)))


def clip_cp(cp: Column, clip: int = CLIP) -> Column:
    """Centipawns within the clip, cut to whole numbers towards zero."""
    return bounded(cp, clip).cast("int")


def cp_to_value(cp: Column, scale: float = SCALE, clip: int = CLIP) -> Column:
    return F.tanh(clip_cp(cp, clip) / F.lit(scale))


def value_to_cp(value: Column, scale: float = SCALE, clip: int = CLIP) -> Column:
    """The reverse; values beyond what clipped centipawns reach count as the clip."""
    top = math.tanh(clip / scale)
    return F.lit(scale) * F.atanh(bounded(value.cast("double"), top))


def score_cp(cp: Column, mate: Column, clip: int = CLIP) -> Column:
    """One-sided score as centipawns: a mate counts as the clip of its sign (mate in 0 is a loss)."""
    return F.when(mate.isNotNull(), F.when(mate > 0, F.lit(clip)).otherwise(F.lit(-clip))).otherwise(clip_cp(cp, clip))


def label(cp_white: Column, mate_white: Column, turn_white: Column, scale: float = SCALE, clip: int = CLIP) -> Column:
    """Struct of the label in both points of view; the side to move's is derived from White's."""
    white = score_cp(cp_white, mate_white, clip)
    stm = F.when(turn_white, white).otherwise(-white)
    mate = F.coalesce(bounded(mate_white, MATE_CLAMP), F.lit(0)).cast("smallint")
    return F.struct(
        white.alias("cp_white"),
        stm.alias("cp_stm"),
        F.tanh(white / F.lit(scale)).cast("float").alias("value_white"),
        F.tanh(stm / F.lit(scale)).cast("float").alias("value_stm"),
        mate_white.isNotNull().alias("is_mate"),
        mate.alias("mate_in"),
    )


def white_view(value: Column, turn_white: Column) -> Column:
    return F.when(turn_white, value).otherwise(-value)


def mate_in(value: Column) -> Column:
    """Moves to mate that a search value stands for, signed; null if it is no mate."""
    plies = F.bround((F.lit(MATE) - F.abs(value)) / F.lit(MATE_STEP))
    moves = F.greatest(F.lit(1), F.floor((plies + 1) / 2)).cast("int")
    return F.when(F.abs(value) >= MATE - 64 * MATE_STEP, F.when(value > 0, moves).otherwise(-moves))
