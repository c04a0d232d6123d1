import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_operators import FAKE, game_text, row

from plyforge import cli
from plyforge.functions import rules
from plyforge.operators import nets, search
from plyforge.sources import evals, shards


def test_parameter_counts():
    assert nets.count_parameters(nets.ResNetConfig()) == 2_913_345
    assert nets.count_parameters(nets.TransformerConfig()) == 2_735_361
    with pytest.raises(ValueError):
        nets.TransformerConfig(d_model=10, heads=3)


def test_convolution_by_hand():
    coin = np.random.default_rng(0)
    x, k = coin.normal(size=(2, 3, 8, 8)), coin.normal(size=(4, 3, 3, 3))
    got = nets._conv(k, x)
    want = np.zeros((2, 4, 8, 8))
    for i in range(8):
        for j in range(8):
            for a in range(3):
                for b in range(3):
                    if 0 <= i + a - 1 < 8 and 0 <= j + b - 1 < 8:
                        want[:, :, i, j] += x[:, :, i + a - 1, j + b - 1] @ k[:, :, a, b].T
    assert np.allclose(got, want)


@pytest.mark.parametrize("config", [nets.ResNetConfig(8, 2, 4, 16), nets.TransformerConfig(16, 2, 4, 32, 8), nets.TransformerConfig(16, 1, 4, 32, 8, pooling="mean")])
def test_nets_score_positions(spark, tmp_path, config):
    weights = nets.random_weights(config)
    np.savez(tmp_path / "w.npz", **weights)
    scorer = nets.NetScorer.load(str(tmp_path / "w.npz"), batch_size=2, heads=getattr(config, "heads", 8))
    fens = [rules.START, "4k3/8/8/8/8/8/4P3/R3K3 w Q - 7 9", "r3k3/4p3/8/8/8/8/8/4K3 b q - 7 9"]
    values = scorer(fens)
    assert values.shape == (3,) and (abs(values) < 1).all() and values[1] == pytest.approx(values[2])
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fens)], "root bigint, fen string")
    got = {r.root: r.value for r in search.scored_positions(df, scorer).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(list(values))


def test_unknown_weights():
    with pytest.raises(nets.UnknownArchitectureError):
        nets.NetScorer({"x": np.zeros(1)})


def test_mates_and_panel(spark):
    fens = [(0, "6k1/5ppp/8/8/8/8/8/R3K3 w - - 0 1"), (1, rules.START), (2, None)]
    df = spark.createDataFrame(fens, "root bigint, fen string")
    got = {r.root: (r.mates, r.mated) for r in search.mate_in_one(df).collect()}
    assert got == {0: (True, False), 1: (False, False), 2: (None, None)}
    rows = search.panel(df.filter("fen is not null"), {"a": search.material_scorer, "b": lambda f: -search.material_scorer(f)}, "a").collect()
    assert len(rows) == 4 and all(r.same and r.verdict == "close" for r in rows if r.model == "a")


def test_beam_keeps_the_best(spark):
    roots = spark.createDataFrame([(0, "4k3/8/8/3q4/4P3/8/8/4K3 w - - 0 1")], "root bigint, fen string")
    rows = search.search(roots, search.material_scorer, depth=2, beam=1).collect()
    assert [r.move for r in rows] == ["e4d5"]


def test_evaluation_profiles(spark, tmp_path):
    line = json.dumps({"fen": "a w - -", "evals": [{"depth": 20, "pvs": [{"cp": 10}, {"cp": 5}]}]})
    rec = evals.parse(spark.createDataFrame([(line,), (line,), ("x",)], "value string"))
    freq = {(r.what, r.value): r.n for r in evals.frequencies(rec).collect()}
    assert freq == {("depth", 20): 2, ("evals", 1): 2, ("lines", 2): 2, ("fields", 4): 2}
    assert evals.looks_like_evals(spark, line) and not evals.looks_like_evals(spark, '{"a": 1}')
    flat = evals.flat(rec)
    evals.write(flat, f"{tmp_path}/e", rows_per_file=1)
    assert spark.read.parquet(f"{tmp_path}/e").count() == 2
    need = {r.target: r.lines for r in evals.projection(evals.quality(rec), flat, [2, 20]).collect()}
    assert need == {2: 3, 20: 30}
    v = spark.createDataFrame([(100, None, True), (None, -2, True), (None, -2, False)], "cp int, mate int, w boolean")
    assert [round(r[0], 4) for r in v.select(evals.target(F.col("cp"), F.col("mate"), F.col("w"))).collect()] == [0.2449, -0.9999, 0.9999]


def test_command_line(spark, tmp_path, capsys):
    import sys

    dump = tmp_path / "d.pgn.zst"
    dump.write_bytes(zstandard.compress("".join(game_text(n) for n in range(3)).encode()))
    (tmp_path / "fake.py").write_text(FAKE)
    (tmp_path / "c.yaml").write_text(f"labeling: {{engine_path: '{sys.executable} {tmp_path}/fake.py', depth: 3}}\n")
    config = ["--config", str(tmp_path / "c.yaml")]
    assert cli.main([*config, "survey", f"2025-01={dump}"]) == 0 and "3 of 3" in capsys.readouterr().out
    assert cli.main([*config, "survey", f"2025-01={dump}", "--min-elo", "9000"]) == 0 and "0 of 3" in capsys.readouterr().out
    assert cli.main([*config, "build", f"2025-01={dump}", "--out", str(tmp_path / "o")]) == 0
    assert cli.main(["validate", str(tmp_path / "o" / "shards")]) in (0, 1)
    assert "sign_invariant" in capsys.readouterr().out
    assert cli.main(["validate", str(tmp_path / "none")]) == 2 and cli.main(["survey"]) == 2
    assert cli.main(["best", "6k1/5ppp/8/8/8/8/8/R3K3 w - - 0 1", "--top", "1"]) == 0 and "a1a8" in capsys.readouterr().out


def test_shards_are_replaced_not_repeated(spark, tmp_path):
    df = spark.createDataFrame([row(pos_key=k) for k in range(3)], shards.SCHEMA).withColumn("shard", F.lit(0))
    for _ in range(2):
        shards.write(df, f"{tmp_path}/s")
    shards.write(df.withColumn("shard", F.lit(1)), f"{tmp_path}/s")
    assert shards.read(spark, f"{tmp_path}/s").count() == 6
