"""The rules of the game in plain Python: positions, legal moves, game notation, ends of games.

Used inside vectorised functions only. Squares count from a1 = 0 to h8 = 63; a move is (from, to, promotion letter or "").
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
ENDED = ("checkmate", "stalemate", "insufficient", "seventyfive")

Move = tuple[int, int, str]

_KNIGHT = ((1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2))
_DIAGONAL = ((1, 1), (1, -1), (-1, -1), (-1, 1))
_STRAIGHT = ((1, 0), (0, -1), (-1, 0), (0, 1))
_SLIDES = {"b": _DIAGONAL, "r": _STRAIGHT, "q": _DIAGONAL + _STRAIGHT}
_FEN_RIGHTS = re.compile(r"-|(?=.)[KQA-H]{0,2}[kqa-h]{0,2}")


def _walks(steps) -> list[list[list[int]]]:
    """For each square and step, the squares met on the way to the edge."""
    out = []
    for s in range(64):
        f, r = s % 8, s // 8
        lines = []
        for df, dr in steps:
            line, x, y = [], f + df, r + dr
            while 0 <= x < 8 and 0 <= y < 8:
                line.append(y * 8 + x)
                x, y = x + df, y + dr
            lines.append(line)
        out.append(lines)
    return out


_LINES = {piece: _walks(steps) for piece, steps in _SLIDES.items()}
_JUMPS = {"n": [[w[0] for w in ws if w] for ws in _walks(_KNIGHT)], "k": [[w[0] for w in ws if w] for ws in _walks(_DIAGONAL + _STRAIGHT)]}
_STRIKES = {True: [[w[0] for w in ws if w] for ws in _walks(((-1, 1), (1, 1)))], False: [[w[0] for w in ws if w] for ws in _walks(((-1, -1), (1, -1)))]}


def square(name: str) -> int:
    return ord(name[0]) - 97 + 8 * (int(name[1]) - 1)


def name(s: int) -> str:
    return "abcdefgh"[s % 8] + str(s // 8 + 1)


class Position:
    """A position; ``play`` gives a new one."""

    __slots__ = ("board", "white", "rights", "ep", "half", "full")

    def __init__(self, board: list[str], white: bool, rights: str, ep: int, half: int, full: int):
        self.board, self.white, self.rights, self.ep, self.half, self.full = board, white, rights, ep, half, full

    @classmethod
    def read(cls, fen: str) -> Position:
        """From FEN of one to six blank-separated fields; ValueError for what is none."""
        part = fen.split()
        if not 1 <= len(part) <= 6:
            raise ValueError(f"fields: {fen!r}")
        ranks = part[0].split("/")
        if len(ranks) != 8 or re.search(r"\d\d|[^1-8pnbrqkPNBRQK/]", part[0]):
            raise ValueError(f"placement: {fen!r}")
        board: list[str] = []
        for rank in reversed(ranks):
            row = "".join("." * int(c) if c.isdigit() else c for c in rank)
            if len(row) != 8:
                raise ValueError(f"rank: {fen!r}")
            board += row
        part += ["w", "-", "-", "0", "1"][len(part) - 1 :]
        if part[1] not in ("w", "b") or not _FEN_RIGHTS.fullmatch(part[2]) or not re.fullmatch("-|[a-h][1-8]", part[3]):
            raise ValueError(f"side, rights or en passant: {fen!r}")
        if not (part[4].isdecimal() and part[5].isdecimal()):
            raise ValueError(f"counters: {fen!r}")
        rights = part[2].translate(str.maketrans("AHah", "QKqk"))
        home = {"K": (4, 7, "KR"), "Q": (4, 0, "KR"), "k": (60, 63, "kr"), "q": (60, 56, "kr")}
        rights = "".join(c for c in "KQkq" if c in rights and board[home[c][0]] == home[c][2][0] and board[home[c][1]] == home[c][2][1])
        return cls(board, part[1] == "w", rights, square(part[3]) if part[3] != "-" else -1, int(part[4]), max(1, int(part[5])))

    def fen(self) -> str:
        """Six fields; the en passant square only if the capture is legal."""
        ranks = ["".join(self.board[r * 8 : r * 8 + 8]) for r in range(7, -1, -1)]
        placement = re.sub(r"\.+", lambda m: str(len(m[0])), "/".join(ranks))
        ep = name(self.ep) if self.ep >= 0 and self.legal_ep() else "-"
        return f"{placement} {'w' if self.white else 'b'} {self.rights or '-'} {ep} {self.half} {self.full}"

    def mine(self, piece: str) -> bool:
        return piece != "." and piece.isupper() == self.white

    def attacked(self, s: int, by_white: bool) -> bool:
        """Whether a piece of that side strikes square ``s``."""
        b = self.board
        own = str.upper if by_white else str.lower
        if any(b[x] == own("n") for x in _JUMPS["n"][s]) or any(b[x] == own("k") for x in _JUMPS["k"][s]):
            return True
        if any(b[x] == own("p") for x in _STRIKES[not by_white][s]):
            return True
        for kind in ("b", "r"):
            for line in _LINES[kind][s]:
                for x in line:
                    if b[x] != ".":
                        if b[x] in (own(kind), own("q")):
                            return True
                        break
        return False

    def check(self, white: bool | None = None) -> bool:
        white = self.white if white is None else white
        king = "K" if white else "k"
        return king in self.board and self.attacked(self.board.index(king), not white)

    def _pseudo(self) -> Iterator[Move]:
        b, ahead = self.board, 8 if self.white else -8
        last, first = (7, 1) if self.white else (0, 6)
        for s, piece in enumerate(b):
            if not self.mine(piece):
                continue
            kind = piece.lower()
            if kind == "p":
                targets = []
                if 0 <= s + ahead < 64 and b[s + ahead] == ".":
                    targets.append(s + ahead)
                    if s // 8 == first and b[s + 2 * ahead] == ".":
                        targets.append(s + 2 * ahead)
                targets += [x for x in _STRIKES[self.white][s] if (b[x] != "." and not self.mine(b[x])) or (x == self.ep and b[x] == ".")]
                for x in targets:
                    for promoted in ("qrbn" if x // 8 == last else ("",)):
                        yield s, x, promoted
            elif kind in _JUMPS:
                for x in _JUMPS[kind][s]:
                    if not self.mine(b[x]):
                        yield s, x, ""
            else:
                for line in _LINES[kind][s]:
                    for x in line:
                        if b[x] == ".":
                            yield s, x, ""
                        else:
                            if not self.mine(b[x]):
                                yield s, x, ""
                            break
        base = 0 if self.white else 56
        for right, free, path in (("K", (5, 6), (4, 5, 6)), ("Q", (1, 2, 3), (4, 3, 2))):
            if (right if self.white else right.lower()) in self.rights and all(b[base + x] == "." for x in free):
                if not any(self.attacked(base + x, not self.white) for x in path):
                    yield base + 4, base + path[2], ""

    def play(self, move: Move) -> Position:
        a, z, promoted = move
        b = self.board.copy()
        piece, taken = b[a], b[z]
        b[a], b[z] = ".", (promoted.upper() if self.white else promoted) if promoted else piece
        kind, ep = piece.lower(), -1
        if kind == "p":
            if z == self.ep and taken == "." and (z - a) % 8:
                b[z - 8 if self.white else z + 8] = "."
            if abs(z - a) == 16:
                ep = (a + z) // 2
        if kind == "k" and abs(z - a) == 2 and a in (4, 60):
            rook = (z + 1, z - 1) if z > a else (z - 2, z + 1)
            b[rook[1]], b[rook[0]] = b[rook[0]], "."
        lost = {0: "Q", 7: "K", 4: "KQ", 56: "q", 63: "k", 60: "kq"}
        gone = lost.get(a, "") + lost.get(z, "")
        rights = "".join(c for c in self.rights if c not in gone) if gone else self.rights
        half = 0 if kind == "p" or taken != "." else self.half + 1
        return Position(b, not self.white, rights, ep, half, self.full + (not self.white))

    def legal(self) -> Iterator[Move]:
        for move in self._pseudo():
            if not self.play(move).check(self.white):
                yield move

    def legal_ep(self) -> bool:
        return self.ep >= 0 and any(z == self.ep and self.board[a].lower() == "p" and (z - a) % 8 for a, z, _ in self.legal())

    def status(self) -> str:
        """ongoing, or how the game has ended: checkmate, stalemate, insufficient, seventyfive."""
        if next(self.legal(), None) is None:
            return "checkmate" if self.check() else "stalemate"
        if self.insufficient():
            return "insufficient"
        return "seventyfive" if self.half >= 150 else "ongoing"

    def insufficient(self) -> bool:
        """Neither side could mate: no pawns, rooks or queens, and only kings, or a single knight, or bishops of one colour."""
        rest = [(p.lower(), (s + s // 8) % 2) for s, p in enumerate(self.board) if p not in ".kK"]
        if any(p in "prq" for p, _ in rest):
            return False
        knights = sum(p == "n" for p, _ in rest)
        if knights:
            return len(rest) == 1
        return len({shade for _, shade in rest}) <= 1

    def san(self, move: Move) -> str:
        """The move in short algebraic notation."""
        a, z, promoted = move
        piece = self.board[a].lower()
        if piece == "k" and abs(z - a) == 2:
            text = "O-O" if z > a else "O-O-O"
        else:
            takes = self.board[z] != "." or (piece == "p" and (z - a) % 8)
            if piece == "p":
                text = name(a)[0] + "x" if takes else ""
            else:
                others = [m for m in self.legal() if m[1] == z and m[0] != a and self.board[m[0]] == self.board[a]]
                mark = ""
                if others:
                    if all(m[0] % 8 != a % 8 for m in others):
                        mark = name(a)[0]
                    elif all(m[0] // 8 != a // 8 for m in others):
                        mark = name(a)[1]
                    else:
                        mark = name(a)
                text = piece.upper() + mark + ("x" if takes else "")
            text += name(z) + (f"={promoted.upper()}" if promoted else "")
        after = self.play(move)
        if after.check():
            text += "#" if next(after.legal(), None) is None else "+"
        return text

    def parse_san(self, text: str) -> Move | None:
        """The legal move a token of game text means, or None."""
        core = text.rstrip("+#!?")
        if core.replace("0", "O") in ("O-O", "O-O-O"):
            a = 4 if self.white else 60
            z = a + (2 if core.count("-") == 1 else -2)
            return next((m for m in self.legal() if m[0] == a and m[1] == z and self.board[a].lower() == "k"), None)
        got = re.fullmatch(r"([NBRQK])?([a-h])?([1-8])?[x-]?([a-h][1-8])(?:=?([NBRQnbrq]))?", core)
        if not got:
            return None
        piece, file, rank, target, promoted = got.groups()
        want = (piece or "P") if self.white else (piece or "p").lower()
        z = square(target)
        for m in self.legal():
            if m[1] == z and self.board[m[0]] == want and m[2] == (promoted or "").lower():
                if (file is None or name(m[0])[0] == file) and (rank is None or name(m[0])[1] == rank):
                    return m
        return None


def uci(move: Move) -> str:
    return name(move[0]) + name(move[1]) + move[2]


_TOKENS = re.compile(r"\{[^}]*\}?|;[^\n]*|\(|\)|\$\d+|\d+\.(?:\.\.)?|1-0|0-1|1/2-1/2|\*|[^\s{}();]+")


def mainline(movetext: str, fen: str | None = None) -> list[tuple[Position, Move]]:
    """(position, move played) of a game's main line; comments and variations are passed over, and so are tokens that
    are no legal move, so that a damaged text gives a shorter game, not none."""
    at = Position.read(fen or START)
    out, depth = [], 0
    for token in _TOKENS.findall(movetext):
        if token == "(":
            depth += 1
        elif token == ")":
            depth = max(0, depth - 1)
        elif depth or token[0] in "{;$" or token[0].isdigit() and token[-1] == ".":
            continue
        elif token in ("1-0", "0-1", "1/2-1/2", "*"):
            break
        else:
            move = at.parse_san(re.sub(r"^\d+\.+", "", token))
            if move is not None:
                out.append((at, move))
                at = at.play(move)
    return out


def status_of(fen: str | None) -> str | None:
    if fen is None:
        return None
    try:
        return Position.read(fen).status()
    except ValueError:
        return "unparseable"


@F.pandas_udf(T.StringType())
def status(fen: pd.Series) -> pd.Series:
    """ongoing, one of ENDED, or unparseable; null for null."""
    return fen.map(status_of, na_action="ignore")


def planes(fen: str) -> np.ndarray:
    """The position as 18 planes of 8 x 8 bytes, from the side to move's point of view.

    0-5 own pieces in the order PNBRQK, 6-11 the opponent's, 12-13 own castling rights (king's, queen's side), 14-15 the
    opponent's, 16 the en passant square if the capture is legal, 17 the half-move clock, at most 100. Row 0 is the
    mover's first rank. The last plane divided by 100 gives the scaled form.
    """
    at = Position.read(fen)
    out = np.zeros((18, 8, 8), np.uint8)
    for s, piece in enumerate(at.board):
        if piece != ".":
            rank = s // 8 if at.white else 7 - s // 8
            out["PNBRQK".index(piece.upper()) + (0 if at.mine(piece) else 6), rank, s % 8] = 1
    for k, right in enumerate("KQkq" if at.white else "kqKQ"):
        if right in at.rights:
            out[12 + k] = 1
    if at.legal_ep():
        out[16, at.ep // 8 if at.white else 7 - at.ep // 8, at.ep % 8] = 1
    out[17] = min(at.half, 100)
    return out
