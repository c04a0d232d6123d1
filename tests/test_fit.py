"""Training with resume, copies at a second place, the runtime's description."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge import runtime, session
from plyforge.functions import rules
from plyforge.operators import encode, fit, learn, nets, search
from plyforge.sources import remote, shards


@pytest.fixture(scope="module")
def rows(spark):
    """Positions whose value is material, from the mover's view."""
    coin, texts = random.Random(6), []
    for _ in range(60):
        at = rules.Position.read(rules.START)
        for _ in range(50):
            moves = list(at.legal())
            if not moves:
                break
            at = at.play(coin.choice(moves))
            texts.append(at.fen())
    values = search.material_scorer(texts)
    df = encode.with_planes(spark.createDataFrame([(t, float(v)) for t, v in zip(texts, values)] + [(None, 0.5), ("nothing", 0.1), (rules.START, None)], "fen string, value_stm double"))
    return session.cut(df, "rows")


def test_training_learns_and_resumes(spark, rows, tmp_path):
    cfg = fit.FitConfig(hidden=8, epochs=8, batch_size=8, learning_rate=0.004)
    part = F.pmod(F.xxhash64("fen"), F.lit(5)) > 0
    held = rows.filter(~part)
    whole = fit.train(rows.filter(part), held, cfg, path=f"{tmp_path}/a.json")
    floor = held.agg(F.stddev_pop("value_stm")).first()[0]
    losses = [e.train_loss for e in whole.history.epochs]
    assert losses[-1] < 0.8 * losses[0] and whole.history.best.val_rmse < 0.92 * floor and [e.epoch for e in whole.history.epochs] == list(range(8))
    first = fit.train(rows.filter(part), held, fit.FitConfig(hidden=8, epochs=8, batch_size=8, learning_rate=0.004), path=f"{tmp_path}/a.json")
    assert first.history == whole.history  # nothing is done again
    with pytest.raises(ValueError):
        fit.train(rows, held, fit.FitConfig(hidden=4, epochs=4), path=f"{tmp_path}/a.json")
    again = fit.load_checkpoint(spark, f"{tmp_path}/a.json")
    assert all(np.array_equal(a, b) for a, b in zip(again.best_weights, whole.best_weights)) and "best epoch" in again.summary()
    assert fit.TrainingHistory.from_json(again.history.to_json()) == again.history and again.history.table(spark).count() == 8
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text(again.history.to_json())
    assert learn.best_epochs(learn.histories(spark, f"{tmp_path}/h")).first().epoch == again.history.best.epoch
    got = fit.predict(whole.best_weights, rows)
    assert got.filter("planes is null and prediction is not null").count() == 0 and got.filter("prediction is null").count() == 2
    assert abs(whole.scorer()([rules.START])[0] - got.filter(F.col("fen") == rules.START).first().prediction) < 1e-6


def test_a_break_changes_nothing(spark, rows, tmp_path, monkeypatch):
    cfg = fit.FitConfig(hidden=0, epochs=2, batch_size=64, loss="huber")
    straight = fit.train(rows, rows, cfg)
    monkeypatch.setattr(fit, "evaluate_split", lambda w, r, t, real=fit.evaluate_split, left=[1]: real(w, r, t) if left and left.pop() is not None else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        fit.train(rows, rows, cfg, path=f"{tmp_path}/b.json")
    monkeypatch.undo()
    resumed = fit.train(rows, rows, cfg, path=f"{tmp_path}/b.json")
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(straight.weights, resumed.weights))


def test_gradients_and_schedule():
    coin = np.random.default_rng(1)
    x, y = coin.random((5, encode.BYTES)).astype(np.float32), coin.uniform(-1, 1, 5).astype(np.float32)
    for loss in fit.LOSSES:
        cfg = fit.FitConfig(hidden=3, loss=loss)
        w = [a.astype(float) for a in fit.begin(cfg)]
        _, grads = fit.gradients(w, x.astype(float), y, loss)
        for k in range(4):
            at = (0,) * w[k].ndim
            step = 1e-5
            w[k][at] += step
            up, _ = fit.gradients(w, x.astype(float), y, loss)
            w[k][at] -= 2 * step
            down, _ = fit.gradients(w, x.astype(float), y, loss)
            w[k][at] += step
            assert abs((up - down) / (2 * step * len(y)) - grads[k][at]) < 1e-4
    cfg = fit.FitConfig(epochs=10, warmup_epochs=2, learning_rate=1.0)
    rates = [fit.rate_at(cfg, t) for t in (0, 1, 2, 6, 10)]
    assert rates[0] < 1e-6 and abs(rates[1] - 0.5) < 1e-6 and rates[2] == 1.0 and abs(rates[3] - 0.5) < 1e-9 and rates[4] < 1e-12
    with pytest.raises(fit.UnknownLossError):
        fit.FitConfig(loss="other")
    with pytest.raises(ValueError):
        fit.TrainingHistory("x", (fit.EpochRecord(1, 0, 0, 0, 0, 0, 0, 0, 0),) * 2)


def test_sweep_of_arms(rows):
    arms = [fit.FitArm("base"), fit.FitArm("none", "nothing is learned", {"learning_rate": 0.0})]
    table, runs = fit.sweep(rows, rows, fit.FitConfig(hidden=0, epochs=1, batch_size=8), arms)
    assert [r.name for r in table.collect()] == ["base", "none"] and set(runs) == {"base", "none"}


def test_copies_at_a_second_place(spark, tmp_path):
    names = shards.SCHEMA.names
    one = spark.createDataFrame([("g", 1, rules.START, 5, True, 1, 1, 0.1, 0.1, False, 0, 2400, 2400, "1-0", "Blitz", 12, "S", "2025-01")], ",".join(f"{f.name} {'string' if f.dataType.typeName() == 'string' else 'boolean' if f.dataType.typeName() == 'boolean' else 'double' if f.dataType.typeName() == 'float' else 'int'}" for f in shards.SCHEMA.fields))
    here, there, fresh = (f"{tmp_path}/{x}" for x in ("here", "there", "fresh"))
    shards.write(one.select(*names).withColumn("shard", F.explode(F.array(F.lit(0), F.lit(1)))), here)
    for shard in remote.shard_folders(spark, here):
        remote.push_shard(spark, here, shard, there)
    assert remote.sync(spark, fresh, there) == ["src_dump=2025-01/shard=0", "src_dump=2025-01/shard=1"] and remote.sync(spark, fresh, there) == []
    assert shards.read(spark, fresh).count() == 2
    assert not remote.copy(spark, f"{tmp_path}/none", f"{tmp_path}/x") and not remote.exists(spark, f"{tmp_path}/x")
    with pytest.raises(FileNotFoundError):
        remote.push_shard(spark, here, "src_dump=2025-01/shard=9", there)
    session.write_text(spark, f"{there}/state.json", "published")
    assert remote.fetch_text(spark, f"{here}/state.json", f"{there}/state.json") == "published" and remote.fetch_text(spark, f"{here}/a", f"{here}/b") is None
    make = lambda path: lambda: spark.range(3).write.parquet(path)
    steps = [remote.ensure_extract(spark, f"{tmp_path}/{a}", f"{tmp_path}/pub", make(f"{tmp_path}/{a}")) for a in ("e1", "e1", "e2")]
    assert steps == ["built", "local", "remote"] and spark.read.parquet(f"{tmp_path}/e2").count() == 3


def test_runtime_and_nets_are_described(spark, monkeypatch):
    info = runtime.describe_runtime(spark, engine="/no/such/engine")
    assert info.cores == spark.sparkContext.defaultParallelism and any("no engine" in w for w in info.warnings) and "missing" in info.summary()
    monkeypatch.setenv("PLYFORGE_TOKEN", "")
    assert runtime.secret("PLYFORGE_TOKEN") is None
    with pytest.raises(ValueError):
        runtime.describe_runtime(spark, phase="sleeping")
    assert "2,913,345 parameters" in nets.describe_config(nets.ResNetConfig()) and "2,735,361 parameters" in nets.describe_config(nets.TransformerConfig())
    assert nets.config_from({"d_model": 64, "heads": 4}) == nets.TransformerConfig(d_model=64, heads=4)
    with pytest.raises(nets.UnknownArchitectureError):
        nets.config_from({"width": 3})
