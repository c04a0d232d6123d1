import numpy as np
import pytest

from plyforge.functions import rules
from plyforge.functions.rules import START, Position, mainline


def perft(at, depth):
    return 1 if depth == 0 else sum(perft(at.play(m), depth - 1) for m in at.legal())


# published move counts
@pytest.mark.parametrize(
    "fen, counts",
    [
        (START, [20, 400, 8902]),
        ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]),
        ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", [44, 1486]),
    ],
)
def test_move_counts(fen, counts):
    assert [perft(Position.read(fen), d + 1) for d in range(len(counts))] == counts


def test_status():
    assert rules.status_of("7k/5Q2/6K1/8/8/8/8/8 b - - 0 1") == "stalemate"
    assert rules.status_of("R5k1/5ppp/8/8/8/8/8/4K3 b - - 0 1") == "checkmate"
    assert rules.status_of("8/8/4k3/8/8/3NK3/8/8 w - - 0 1") == "insufficient"
    assert rules.status_of("8/8/4k3/8/8/3RK3/8/8 w - - 150 99") == "seventyfive"
    assert rules.status_of(START) == "ongoing" and rules.status_of("nonsense") == "unparseable" and rules.status_of(None) is None


def test_game_text():
    line = mainline("1. e4 {best} e5 2. Nf3 (2. f4 exf4) Nc6 3. Bb5 a6 $1 4. O-O Zz9 Nf6 1-0")
    assert [rules.uci(m) for _, m in line] == ["e2e4", "e7e5", "g1f3", "b8c6", "f1b5", "a7a6", "e1g1", "g8f6"]
    assert line[-1][0].fen().split(" ")[2] == "kq"
    assert [at.san(m) for at, m in line][:5] == ["e4", "e5", "Nf3", "Nc6", "Bb5"]
    assert mainline("") == [] and mainline("*") == []


def test_en_passant_only_where_legal():
    at = mainline("1. e4 a6 2. e5 d5 *")[-1]
    after = at[0].play(at[1])
    assert after.fen() == "rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6 0 3"
    assert mainline("1. e4 e5 *")[1][0].fen().split(" ")[3] == "-"


def test_planes_are_seen_by_the_mover():
    white = rules.planes("4k3/8/8/8/8/8/4P3/R3K3 w Q - 7 9")
    black = rules.planes("r3k3/4p3/8/8/8/8/8/4K3 b q - 7 9")
    assert (white == black).all() and white.shape == (18, 8, 8)
    assert white[0, 1, 4] == 1 and white[3, 0, 0] == 1 and white[13].all() and not white[12].any() and (white[17] == 7).all()
    assert rules.planes("rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6 0 3")[16].sum() == 1
    assert np.sum(rules.planes(START)[:12]) == 32
