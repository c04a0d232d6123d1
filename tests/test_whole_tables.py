"""Queries that cover their whole table, on small tables written for the purpose."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__

TEXTS = ["4k3/8/8/8/8/8/PP6/4K3 w - - 0 1", "4k3/8/8/8/8/8/PQ6/4K3\tw - - 0 1", "_4k3/8/8/8/8/8/PR6/4K3_B_-_-_0_1", " 4k3/qq6/8/8/8/8/8/4K3  b - -", "4k3/8/8/8/8/8/PN6/4K3 B - - 0 1", None]


def test_leaked_games_of_every_seed(spark, tmp_path):
    log = [(1, "aaaaaaaa", "train"), (1, "aaaaaaaa", " Dev "), (1, "bbbbbbbb", "test"), (417, "bbbbbbbb", "val"), (417, "bbbbbbbb", "tr"),
           (2, "cccccccc", "val"), (2, "cccccccc", "valid"), (3, "cccccccc", "tst"), (None, "dddddddd", "val"), (None, "dddddddd", "tr"), (1, None, "val"), (1, None, "tr")]
    spark.createDataFrame(log, "seed bigint, game_id string, split string").write.parquet(f"{tmp_path}/split_log.parquet")
    got = __spark_entry__.queries()["leaked_games"](spark, str(tmp_path)).collect()
    assert sorted((r.seed, r.game_id) for r in got) == [(1, "aaaaaaaa"), (417, "bbbbbbbb")]


@pytest.fixture(scope="module")
def unusual(spark, tmp_path_factory):
    """Positions whose texts are written in several ways."""
    path = str(tmp_path_factory.mktemp("unusual"))
    rows = spark.createDataFrame([(i, t, [0.5, 0.9, 0.8, -0.9, 0.4, 0.1][i]) for i, t in enumerate(TEXTS)], "rec_id bigint, fen string, value_white float")
    rows.withColumns({"turn_white": F.lit(True), "time_control": F.lit("Blitz")}).write.parquet(f"{path}/positions.parquet")
    return path


@pytest.mark.parametrize("name", ["evaluation", "evaluation_by_band"])
def test_metrics_count_every_text(spark, unusual, name):
    assert sum(r.n for r in __spark_entry__.queries()[name](spark, unusual).collect()) == 5


def test_features_of_every_text(spark, unusual):
    got = {r.rec_id: (r.d_pawn, r.d_knight, r.d_rook, r.d_queen) for r in __spark_entry__.queries()["material_features"](spark, unusual).collect()}
    assert got == {0: (2, 0, 0, 0), 1: (1, 0, 0, 1), 2: (-1, 0, -1, 0), 3: (0, 0, 0, 2), 4: (-1, -1, 0, 0)}


def test_convention_of_every_text(spark, unusual):
    got = __spark_entry__.queries()["label_convention"](spark, unusual).first()
    assert got.n_clear == 4 and got.agreement == 1
