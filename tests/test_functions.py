import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plyforge.functions import board, keys, refs, scoring
from plyforge.functions.position import usual_text


def values(df, *cols):
    return [tuple(r) if len(cols) != 1 else r[0] for r in df.select(*cols).collect()]


def test_game_ref(spark):
    forms = ["AbCd1234", " AbCd1234\n", "\tAbCd1234 ", "https://x.example/AbCd1234", "http://x.example/AbCd1234?pov=black", "x.example/AbCd1234",
             "https://x.example/AbCd1234/white", "https://x.example/AbCd1234/black#12", "https://x.example/AbCd1234/", "https://x.example/AbCd1234#3"]
    none = [None, "", " ", "?", "abc", "AbCd12345", "https://x.example/", "https://x.example/abc"]
    df = spark.createDataFrame([(x,) for x in forms + none], "g string")
    assert values(df, refs.game_ref(F.col("g"))) == ["AbCd1234"] * len(forms) + [None] * len(none)


def test_categories(spark):
    cases = {"Blitz": "Blitz", "BLITZ ": "Blitz", "rated-rapid": "Rapid", "Rated UltraBullet game": "UltraBullet", "Blitz (600+0)": "Blitz", "300+0": "Blitz",
             "600+5": "Rapid", " 60+0\t": "Bullet", "15+0": "UltraBullet", "29+0": "UltraBullet", "30+0": "Bullet", "179+0": "Bullet", "180+0": "Blitz", "479+0": "Blitz",
             "480+0": "Rapid", "1499+0": "Rapid", "1500+0": "Classical", "-": "Correspondence", "?": "Unknown", "": "Unknown", None: "Unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert values(df, refs.label_category(F.col("t"))) == list(cases.values())
    df = spark.createDataFrame([("Rated blitz", "60+0"), ("Rated Blitz game", "-"), ("x", "-"), ("x", "?")], "e string, c string")
    assert values(df, refs.header_category(F.col("e"), F.col("c"))) == ["Bullet", "Blitz", "Correspondence", None]


def test_parse_key(spark):
    n = -1234567890123456789
    unsigned = n % (1 << 64)
    same = [str(n), str(unsigned), f"0x{unsigned:016x}", f"0X{unsigned:016X}", f"{unsigned:016x}", f" {unsigned} ", f"0{unsigned}"]
    df = spark.createDataFrame([(x,) for x in [*same, "12", "0x12", "1234567890123456", None, "", "zz", "99999999999999999999", "ff" * 9]], "k string")
    got = values(df, keys.parse_key(F.col("k")))
    assert got[:7] == [n] * 7
    assert got[7:] == [12, 18, 1234567890123456, None, None, None, None, None]


def test_digest(spark):
    text = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"
    want = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)
    df = spark.createDataFrame([(text + " 0 1",), (None,)], "f string")
    assert values(df, keys.digest(keys.first_four_as_written(F.col("f")))) == [want, None]


ODD = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "rnbqkbnr/pppppppp/11111111/8/8/8/PPPPPPPP/RNBQKBNR W qkQK -",
    "rnbqkbnr_pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR_w_KQkq_-_0_1",
    "\trnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR  w HAha - 0 1",
    "rnbqkbnr/ppp1pppp/8/8/3pP3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 3",
    "rnbqkbnr/ppp1pppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 3",
    "4k2r/8/8/8/8/8/8/R3K3 w KQkq - 0 1", "8/8/8 w - -", "", None, "nonsense", "4k3/8/8/8/8/8/8/4K3 x - - 0 1", "4k3/8/8/8/8/8/8/4K3 w",
]


def test_usual_form_agrees_with_python(spark):
    df = board.with_usual(spark.createDataFrame([(x,) for x in ODD], "fen string"))
    got = values(df, "usual")
    assert got == [usual_text(x) for x in ODD]
    assert got[0] == got[1].replace("b", "b") == got[3]
    assert got[4].endswith(" e3") and got[5].endswith(" -") and got[6].split(" ")[2] == "Qk"
    assert got[7:12] == [None] * 5


def test_scoring(spark):
    df = spark.createDataFrame([(0, None, True), (150, None, False), (99999, None, True), (None, 3, True), (None, -2, False), (None, 0, True)], "cp int, mate int, w boolean")
    rows = df.select(scoring.label(F.col("cp"), F.col("mate"), F.col("w")).alias("l")).select("l.*").collect()
    assert [r.cp_white for r in rows] == [0, 150, 2000, 2000, -2000, -2000]
    assert [r.cp_stm for r in rows] == [0, -150, 2000, 2000, 2000, -2000]
    assert [r.is_mate for r in rows] == [False, False, False, True, True, True] and [r.mate_in for r in rows] == [0, 0, 0, 3, -2, 0]
    assert rows[1].value_white == pytest.approx(math.tanh(150 / 400), abs=1e-7)
    v = spark.createDataFrame([(1.0,), (-1.0,), (0.25,)], "v double")
    assert values(v, scoring.value_to_cp(F.col("v"))) == pytest.approx([2000, -2000, 400 * math.atanh(0.25)])
    m = spark.createDataFrame([(1.99,), (-1.98,), (0.5,), (1.95,)], "v double")
    assert values(m, scoring.mate_in(F.col("v"))) == [1, -1, None, 3]


@settings(max_examples=40, deadline=None)
@given(st.floats(-5000, 5000))
def test_round_trip_of_values(cp):
    top = math.tanh(5)
    v = math.tanh(max(-2000, min(2000, int(cp))) / 400)
    assert abs(400 * math.atanh(max(-top, min(top, v))) - max(-2000, min(2000, int(cp)))) < 0.02
