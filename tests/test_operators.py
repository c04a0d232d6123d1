import json
import math
import os
import random
import sys

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from plyforge.config import DatasetConfig, LabelingConfig, OutputConfig, SamplingConfig, SplitConfig, SplitConfigError
from plyforge.functions import keys, rules
from plyforge.operators import encode, ingest, label, learn, match, metrics, profile, search, skew, split, validate
from plyforge.plans import build
from plyforge.sources import evals, pgn, shards
from plyforge.streaming import build as stream

FAKE = '''import sys
for line in sys.stdin:
    w = line.split()
    if w[:1] == ["uci"]: print("id name Fake 1", flush=True); print("uciok", flush=True)
    elif w[:1] == ["isready"]: print("readyok", flush=True)
    elif w[:1] == ["position"]: fen = w[2:]
    elif w[:1] == ["go"]:
        if fen[0].startswith("7k"): print("info depth 3 score mate 2", flush=True)
        elif fen[0].startswith("4k"): pass
        else: print("info depth 3 score cp %d" % (len(fen[0]) % 50), flush=True)
        print("bestmove e2e4", flush=True)
    elif w[:1] == ["quit"]: break
'''


def game_text(n, event="Rated Blitz game", white=2300, black=2400, plies=30, end="Normal", seed=1):
    """A legal random game as PGN."""
    coin = random.Random(seed * 1000 + n)
    at, moves = rules.Position.read(rules.START), []
    while len(moves) < plies:
        legal = list(at.legal())
        if not legal:
            break
        move = coin.choice(legal)
        moves.append((f"{len(moves) // 2 + 1}. " if len(moves) % 2 == 0 else "") + at.san(move))
        at = at.play(move)
    head = {"Event": event, "Site": f"https://games.example/game{n:04d}", "Date": "2025.01.01", "Result": "1-0", "WhiteElo": white, "BlackElo": black, "TimeControl": "300+0", "Termination": end}
    return "".join(f'[{k} "{v}"]\n' for k, v in head.items()) + "\n" + " ".join(moves) + " 1-0\n\n"


SPECS = [dict() for _ in range(8)] + [dict(event="Rated Rapid game", white=2200, black=2200)] * 2 + [
    dict(white=2100), dict(black="?"), dict(event="Rated Bullet game"), dict(event="Casual Blitz game"), dict(end="Abandoned"), dict(plies=12)
]


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "a.pgn.zst"
    path.write_bytes(zstandard.compress("".join(game_text(n, **s) for n, s in enumerate(SPECS)).encode()))
    return str(path)


@pytest.fixture(scope="module")
def engine(tmp_path_factory):
    path = tmp_path_factory.mktemp("engine") / "fake.py"
    path.write_text(FAKE)
    return LabelingConfig(engine_path=f"{sys.executable} {path}", depth=3, workers=2)


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("filter: {min_elo: 2000, time_controls: [Rapid]}\nnot_a_section: 1\n")
    cfg = DatasetConfig.from_yaml(path)
    assert cfg.filter.min_elo == 2000 and cfg.filter.time_controls == ("Rapid",) and cfg.labeling.depth == 12
    with pytest.raises(ValueError):
        DatasetConfig.from_dict({"filter": {"elo": 1}})
    with pytest.raises(SplitConfigError):
        SplitConfig(0.5, 0.4, 0.2)


def test_dump_is_read_and_filtered(spark, dump):
    raw = pgn.read(spark, dump)
    flat = pgn.flat(raw)
    assert flat.count() == 16
    stats = ingest.scan_stats(flat).first()
    assert (stats.games_seen, stats.games_accepted) == (16, 11)
    assert pgn.read(spark, dump, max_games=5).count() == 5
    text = raw.filter("game_seq = 1").select(pgn.as_text(F.col("headers"), F.col("movetext"))).first()[0]
    assert text.startswith("[") and '[Site "https://games.example/game0000"]' in text and text.rstrip().endswith("1-0")
    assert list(pgn.games(text.splitlines(keepends=True)))[0][0]["WhiteElo"] == "2300"
    assert ingest.scan_stats(flat.limit(0)).first().acceptance_rate == 0


def test_header_predicate_edges(spark):
    rows = [("Rated Blitz game", "300+0", "2200", "2200", None), ("Rated Blitz game", "300+0", "2200", " 2200 ", "Normal"), (None, "300+0", "2500", "2500", ""),
            ("Rated game", "600+0", "2500", "2500", ""), ("Rated game", None, "2500", "2500", ""), ("Rated game", "300+0", "2199", "2500", "")]
    df = spark.createDataFrame(rows, "event_text string, time_control string, white_elo string, black_elo string, termination string")
    assert [r[0] for r in df.select(ingest.accepts()).collect()] == [True, True, False, True, False, False]


def test_sampling_is_balanced_and_reproducible(spark, dump):
    games = build.games_of(pgn.read(spark, dump))
    rows = ingest.sampled_positions(games).collect()
    again = ingest.sampled_positions(games.repartition(3)).collect()
    assert sorted(rows) == sorted(again) and len(rows) == 15 * 4
    assert sum(r.turn_white for r in rows) == 30 and all(r.turn_white == (r.ply % 2 == 0) for r in rows)
    assert all(r.pos_key == keys.digest64(" ".join(r.fen.split(" ")[:4])) for r in rows)
    for n in range(1, 9):
        got = ingest.sample_plies(n, SamplingConfig(), random.Random(3))
        assert len(got) == min(4, n) == len(set(got)) and all(0 <= p < n for p in got)
    assert ingest.sample_plies(0, SamplingConfig(), random.Random(3)) == []


def test_first_and_unseen(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 4), (None, 1), (None, 2)], "k int, o int")
    assert sorted(tuple(r) for r in ingest.first_of_key(df, "k", ["o"]).filter("k is not null").collect()) == [(1, 3), (2, 4)]
    assert ingest.first_of_key(df, "k", ["o"]).count() == 4
    seen = spark.createDataFrame([(1,), (None,)], "k int")
    assert sorted(r.o for r in ingest.unseen(df, seen, "k").collect()) == [1, 2, 4]


def test_labelling_with_an_engine(spark, engine):
    df = spark.createDataFrame([("rnbqkbnr/8/8/8/8/8/8/RNBQKBNR w - - 0 1", True), ("7k/8/8/8/8/8/8/K6R b - - 0 1", False), ("4k3/8/8/8/8/8/8/K7 w - - 0 1", True)], "fen string, turn_white boolean")
    rows = {r.fen[:2]: r for r in label.attach(df, label.scored(df, engine)).collect()}
    assert set(rows) == {"rn", "7k"} and label.engine_version(engine) == "Fake 1"
    assert rows["7k"].is_mate and rows["7k"].mate_in == -2 and rows["7k"].cp_white == -2000 and rows["7k"].cp_stm == 2000
    with pytest.raises(label.EngineNotAvailableError):
        label.engine_version(LabelingConfig(engine_path="/no/such/engine"))


def test_build_resumes(spark, dump, engine, tmp_path):
    cfg = DatasetConfig(output=OutputConfig(games_per_shard=4, local_dir=f"{tmp_path}/out", extract_dir=f"{tmp_path}/ex", state_path=f"{tmp_path}/state.json"), labeling=engine)
    run = lambda **k: build.run_build(spark, cfg, lambda d: label.scored(d, engine), "Fake 1", {"2025-01": dump}, **k)
    first = run(max_shards=1).collect()
    assert [r.shard for r in first] == [0]
    rest = run().collect()
    assert [r.shard for r in rest] == [1, 2] and run().collect() == []
    rows = shards.read(spark, cfg.output.local_dir)
    n = rows.count()
    assert rows.select("pos_key").distinct().count() == n == build.PipelineState.load(spark, cfg.output.state_path).total_positions
    assert rows.select("game_id").distinct().count() == 10
    report = {r.name: r.passed for r in validate.validate(rows.select(*shards.SCHEMA.names)).collect()}
    assert report["no_duplicate_positions"] and report["sign_invariant"] and report["no_nulls"] and report["fen_legality"]
    assert shards.seen_keys(spark, f"{tmp_path}/none").count() == 0


def test_stream_build_is_exactly_once(spark, dump, engine, tmp_path):
    cfg = DatasetConfig(output=OutputConfig(local_dir=f"{tmp_path}/out", extract_dir=f"{tmp_path}/ex"), labeling=engine)
    games = build.games_of(pgn.read(spark, dump)).filter(ingest.accepts())
    games.repartition(2).write.parquet(cfg.output.extract_dir)
    for _ in range(2):
        q = stream.stream_build(spark, cfg, games.schema, "2025-01", lambda d: label.scored(d, engine), "Fake 1", f"{tmp_path}/ck")
        q.awaitTermination()
    rows = shards.read(spark, cfg.output.local_dir)
    assert rows.count() == rows.select("pos_key").distinct().count() > 30


def row(**change):
    base = dict(game_id="abc", ply=10, fen=rules.START, pos_key=1, turn_white=True, cp_white=50, cp_stm=50, value_white=math.tanh(0.125), value_stm=math.tanh(0.125), is_mate=False,
                mate_in=0, white_elo=2400, black_elo=2350, result="1-0", time_control="Blitz", sf_depth=12, sf_version="S", src_dump="2025-06")
    return base | change


def black(**change):
    return row(pos_key=2, turn_white=False, cp_stm=-50, value_stm=-math.tanh(0.125), fen=rules.START.replace(" w ", " b ")) | change


@pytest.mark.parametrize(
    "bad, check",
    [
        (dict(pos_key=2), "no_duplicate_positions"), (dict(value_white=1.5), "label_range"), (dict(value_stm=float("nan")), "label_range"), (dict(black_elo=1500), "elo_threshold"),
        (dict(cp_stm=-50, value_stm=-math.tanh(0.125)), "sign_invariant"), (dict(fen="R5k1/5ppp/8/8/8/8/8/4K3 b - - 0 1"), "fen_legality"), (dict(fen="x"), "fen_legality"),
        (dict(is_mate=True), "mate_flags"), (dict(is_mate=True, mate_in=3), "mate_flags"), (dict(result=None), "no_nulls"), (dict(turn_white=None), "sign_invariant"),
    ],
)
def test_each_check_finds_its_fault(spark, bad, check):
    good = spark.createDataFrame([row(), black()], shards.SCHEMA)
    assert all(r.passed for r in validate.validate(good).collect())
    got = {r.name: r.passed for r in validate.validate(spark.createDataFrame([row(**bad), black()], shards.SCHEMA)).collect()}
    assert not got[check]


def test_checks_of_an_empty_table_and_balance(spark):
    empty = {r.name: r.passed for r in validate.validate(spark.createDataFrame([], shards.SCHEMA)).collect()}
    assert not empty["colour_balance"] and not empty["label_range"] and not empty["fen_legality"] and empty["no_nulls"]
    white = {r.name: r.passed for r in validate.check_rows(spark.createDataFrame([row(), row(pos_key=3)], shards.SCHEMA)).collect()}
    assert not white["colour_balance"]
    text = validate.summary(validate.check_rows(spark.createDataFrame([row(), row(pos_key=3)], shards.SCHEMA))).first()
    assert not text.passed and text.failures == "colour_balance"
    with pytest.raises(shards.SchemaMismatchError):
        shards.conform(spark.createDataFrame([(1,)], "x int"))


def test_metrics_against_numpy(spark):
    coin = np.random.default_rng(4)
    a, p = np.round(coin.uniform(-1, 1, 300), 1), np.round(coin.uniform(-1, 1, 300), 1)
    got = metrics.evaluate(spark.createDataFrame(list(zip(p.tolist(), a.tolist())), "p double, a double"), "p", "a").first()
    ranks = lambda x: np.array([(x < v).sum() + ((x == v).sum() - 1) / 2 for v in x])
    assert got.n == 300 and got.rmse == pytest.approx(np.sqrt(np.mean((p - a) ** 2))) and got.mae == pytest.approx(np.mean(abs(p - a)))
    assert got.spearman == pytest.approx(np.corrcoef(ranks(p), ranks(a))[0, 1])
    far = abs(a) > 0.05
    assert got.sign_agreement == pytest.approx(np.mean(np.sign(p[far]) == np.sign(a[far])))
    flat = metrics.evaluate(spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "p double, a double"), "p", "a").first()
    assert flat.spearman is None and flat.sign_agreement is None


def test_splits(spark):
    ids = spark.createDataFrame([(f"game{n:04d}",) for n in range(2000) for _ in range(2)] + [(None,)], "game_id string")
    for column in (split.hashed_split(F.col("game_id")), split.keyed_split(F.col("game_id"))):
        s = ids.withColumn("split", column)
        assert split.leaked_games(s).count() == 0
        share = {r.split: r.n_games / 2000 for r in split.describe_split(s).collect()}
        assert abs(share["train"] - 0.9) < 0.03 and None in share
    leaky = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "val")], "game_id string, split string")
    assert [r.game_id for r in split.leaked_games(leaky).collect()] == ["g"]
    nested = split.nested_samples(spark.range(5000), "id", [100, 1000], 3)
    assert {r.volume: r["count"] for r in nested.groupBy("volume").count().collect()} == {100: 100, 1000: 900}


def test_profiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, -0.5, 0, 0.5, 1)] + [(None,)], "v double")
    assert sum(r.n for r in profile.histogram(df, "v", -1, 1, 4).collect()) == 5
    assert {r.bin: r.n for r in profile.histogram(df, "v", -1, 1, 4).collect()}[3] == 2
    assert [r.band for r in df.select(profile.band(F.col("v")).alias("band")).collect()] == [3, 3, 0, 3, 3, None]
    top = {r.v: r.from_top for r in profile.cumulative_share(df, "v").collect()}
    assert top[1.0] == pytest.approx(0.2) and top[-1.0] == pytest.approx(1.0)


def test_match_statistics(spark):
    games = [(1320, 1.0, "checkmate"), (1320, 0.5, "repetition"), (1320, 1.0, "checkmate"), (1500, 0.0, "max_plies"), (1500, 1.0, "checkmate"), (1700, 1.0, "checkmate")]
    df = spark.createDataFrame([(o, s, t, 40) for o, s, t in games], "opponent_elo int, score double, termination string, plies int")
    got = {r.opponent_elo: r for r in match.match_stats(df, ["opponent_elo"]).collect()}
    assert (got[1320].won, got[1320].drawn, got[1320].lost) == (2, 1, 0) and got[1500].unfinished == 1 and got[1500].elo_difference == 0
    assert math.isinf(got[1700].elo_difference) and got[1700].margin is None
    even = spark.createDataFrame([(1500, 100, 0.5)], "opponent_elo int, n int, score_rate double")
    fit = match.pooled_elo(even).first()
    assert fit.rating == 1500 and 30 < fit.sigma < 40
    sweep = match.pooled_elo(spark.createDataFrame([(1500, 10, 1.0)], "opponent_elo int, n int, score_rate double")).first()
    assert math.isinf(sweep.rating) and sweep.sigma is None
    q = match.move_quality(spark.createDataFrame([(0.0, True), (400.0, False)], "loss_cp double, agrees boolean"), []).first()
    assert q.acpl == 200 and q.blunder_rate == 0.5 and q.agreement == 0.5 and q.median_loss == 200


def negamax(at, depth, ply=0):
    exact = search._exact(at, ply, True)
    if exact is not None:
        return exact
    if depth == 0:
        return float(search.material_scorer([at.fen()])[0])
    return max(-negamax(at.play(m), depth - 1, ply + 1) for m in at.legal())


def test_search_against_brute_force(spark):
    fens = ["6k1/5ppp/8/8/8/8/8/R3K3 w - - 0 1", "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3", "4k3/8/8/3q4/4P3/8/8/4K3 w - - 0 1"]
    roots = spark.createDataFrame(list(enumerate(fens)), "root bigint, fen string")
    for depth in (1, 2):
        got = {(r.root, r.move): r.value for r in search.search(roots, search.material_scorer, depth=depth).collect()}
        for k, fen in enumerate(fens):
            at = rules.Position.read(fen)
            want = {(k, rules.uci(m)): -negamax(at.play(m), depth - 1, 1) for m in at.legal()}
            assert {x: v for x, v in got.items() if x[0] == k} == pytest.approx(want)
    best = {r.root: r for r in search.best_moves(roots, search.material_scorer, depth=1).collect()}
    assert best[0].move == "a1a8" and best[0].value == pytest.approx(1.99) and 1 not in best and best[2].move == "e4d5"


def test_play(spark):
    pairs = match.pairings(spark.createDataFrame([(1, "6k1/5ppp/8/8/8/8/8/R3K3 w - - 0 1")], "opening_id bigint, fen string"))
    rows = {r.engine_white: r for r in search.play(pairs, search.material_scorer, search.material_scorer, max_plies=20).collect()}
    assert rows[True].score == 1.0 and rows[True].plies == 1 and rows[False].score == 0.0


def test_encoding(spark, tmp_path):
    df = spark.createDataFrame([(rules.START,), ("x",), (None,)], "fen string")
    out = encode.cached(df, f"{tmp_path}/cache")
    assert encode.encoding_sanity(out).first() == (1, 0, 0)
    data = out.filter("planes is not null").first().planes
    assert len(data) == encode.cache_size(1) and encode.decoded(data).shape == (18, 8, 8)
    with pytest.raises(encode.CacheMismatchError):
        encode.load_cache(spark, f"{tmp_path}/cache", 7)
    f = encode.material_features(spark.createDataFrame([("4k3/pp6/8/8/8/8/8/R3K3 b - - 0 1",)], "fen string")).first()
    assert (f.d_pawn, f.d_rook, f.d_king) == (2, -1, 0)


def test_evaluations_are_flattened(spark):
    lines = [json.dumps({"fen": "a w - -", "evals": [{"depth": 12, "pvs": [{"cp": 10}]}, {"depth": 30, "pvs": [{"mate": -3}]}, {"depth": 30, "pvs": [{"cp": 9}]}]}),
             json.dumps({"fen": "b w - -", "evals": [{"depth": 5, "pvs": [{"cp": 1}]}]}), "not json", json.dumps({"fen": "c", "evals": [{"depth": 20, "pvs": []}]})]
    rec = evals.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert evals.quality(rec).first().unreadable == 1
    assert [tuple(r) for r in evals.flat(rec).collect()] == [("a w - -", None, -3, 30)]


def test_learning(spark, tmp_path):
    coin = np.random.default_rng(1)
    rows = [(float(x), float(y), float(0.5 * x - 0.2 * y)) for x, y in coin.uniform(-1, 1, (200, 2))]
    df = spark.createDataFrame(rows, "x double, y double, t double")
    arms = [learn.Experiment("plain"), learn.Experiment("shrunk", params={"regParam": 5.0})]
    table = learn.sweep(df, df, ["x", "y"], "t", arms).collect()
    assert [r.name for r in table] == ["plain", "shrunk"] and table[0].rmse < 1e-6
    learn.save(learn.train(df, ["x", "y"], "t"), f"{tmp_path}/m")
    assert learn.predict(learn.load(f"{tmp_path}/m"), df).count() == 200
    (tmp_path / "h.json").write_text(json.dumps({"run_name": "r", "epochs": [{"epoch": 1, "train_loss": 0.1, "val_rmse": 0.4}, {"epoch": 2, "train_loss": 0.05, "val_rmse": 0.3}]}))
    epochs = learn.histories(spark, str(tmp_path / "h.json"))
    assert learn.best_epochs(epochs).first().epoch == 2 and learn.diagnosis(epochs).first().verdict == "overfits somewhat"


def test_hot_keys_and_numbering(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    joined = skew.hot_join(rows, table, "k", "n", 3000)
    assert joined.count() == 3000 and joined.filter("k = 7 and first = 0 and n = 1500").count() == 1500
    placed = skew.numbered(rows.withColumn("g", F.lit(None).cast("int")), ["g"], [F.col("v")], 8, F.xxhash64("v"))
    assert sorted(r.place for r in placed.collect()) == list(range(3000))
