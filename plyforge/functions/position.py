"""The usual form of a position's text in plain Python, for operators that leave the JVM anyway."""

from __future__ import annotations

import re
from functools import lru_cache
from operator import itemgetter

_DOTS = [(str(n), "." * n) for n in range(1, 9)]
_RUN = re.compile(r"\.+")
_LEGAL = re.compile(r"(?:[pnbrqkPNBRQK.]{8}/){7}[pnbrqkPNBRQK.]{8}")
_SPLIT_DIGITS = re.compile(r"\d\d")
# Sign, letters that give the right, places of king and rook in the 71 characters, their letters.
_RIGHTS = (("K", "KH", 67, 70, "K", "R"), ("Q", "QA", 67, 63, "K", "R"), ("k", "kh", 4, 7, "k", "r"), ("q", "qa", 4, 0, "k", "r"))
# Where kings and rooks stand for rights.
_HOMES = (0, 4, 7, 63, 67, 70)
_at_home = itemgetter(*_HOMES)


def squares(placement: str) -> str:
    """A placement with its digits written as so many dots."""
    for digit, dots in _DOTS:  # several times as fast as str.translate
        placement = placement.replace(digit, dots)
    return placement


@lru_cache(maxsize=1 << 14)
def _kept_rights(rights: str, home: tuple[str, ...]) -> str:
    at = dict(zip(_HOMES, home))
    return "".join(s for s, by, k, r, king, rook in _RIGHTS if (by[0] in rights or by[1] in rights) and at[k] == king and at[r] == rook) or "-"


def usual_parts(fen: str | None) -> tuple[str, str, str] | None:
    """Placement, its squares, and the fields after it of ``usual_text``; None for no position."""
    if fen is None:
        return None
    part = fen.replace("_", " ").split()
    if len(part) < 2:
        return None
    placement, side = part[0], part[1].lower()
    grid = squares(placement)
    if side not in ("w", "b") or len(grid) != 71 or not _LEGAL.fullmatch(grid):
        return None
    if _SPLIT_DIGITS.search(placement):
        placement = _RUN.sub(lambda m: str(len(m[0])), grid)
    rights = part[2] if len(part) > 2 else "-"
    if rights != "-":
        rights = _kept_rights(rights, _at_home(grid))
    ep = part[3].lower() if len(part) > 3 else "-"
    if ep != "-":
        white = side == "w"
        good = len(ep) == 2 and ep[0] in "abcdefgh" and ep[1] == ("6" if white else "3")
        if good:
            at = (27 if white else 36) + ord(ep[0]) - 97
            own = "P" if white else "p"
            good = grid[at] == ("p" if white else "P") and (grid[at - 1] == own or grid[at + 1] == own)
        if not good:
            ep = "-"
    return placement, grid, f"{side} {rights} {ep}"


def usual_text(fen: str | None) -> str | None:
    """What ``board.with_usual`` gives: the first four fields in their usual form, or None for no position."""
    parts = usual_parts(fen)
    return None if parts is None else f"{parts[0]} {parts[2]}"
