"""Dumps read in parts and by their headers, builds of all pending shards, ranks and percentiles, matches with engines."""

import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SPECS, dump, engine, game_text  # noqa: F401 - fixtures

from plyforge import session
from plyforge.config import DatasetConfig, FilterConfig, LabelingConfig, OutputConfig
from plyforge.functions import rules
from plyforge.operators import encode, ingest, label, match, metrics, ranks, search, skew
from plyforge.plans import build
from plyforge.sources import pgn, shards

# Dumps ------------------------------------------------------------------------------------------------------------


def test_rejected_games_have_no_movetext(spark, dump):  # noqa: F811
    raw = pgn.read(spark, dump, accept=FilterConfig())
    flat = pgn.flat(raw)
    assert raw.count() == 16 and raw.filter("movetext is not null").count() == 11
    assert flat.filter(ingest.accepts()).filter("movetext is null").count() == 0 and flat.filter(~ingest.accepts()).filter("movetext is not null").count() == 0
    assert ingest.scan_stats(flat).first().games_seen == 16
    assert pgn.read(spark, dump, accept=FilterConfig(), max_games=3).filter("movetext is not null").count() == 3
    assert pgn.read(spark, dump, accept=FilterConfig(), max_scanned=12).count() == 12


def test_headers_are_judged_as_columns_are(spark):
    values = {
        "Event": [None, "", "Rated Blitz game", "Rated game", "Casual Blitz game", "Rated UltraBullet", "rated Rapid"], "WhiteElo": ["2200", " 2300 ", "2199", "?", None, "+2400"],
        "TimeControl": [None, "-", "300+0", "15+0", "600+5", "x", " 1800+0 "], "Termination": [None, "", "Normal", "Abandoned", "Unterminated"],
    }
    coin = random.Random(2)
    rows = [{k: coin.choice(v) for k, v in values.items()} | {"BlackElo": coin.choice(["2500", "2100"])} for _ in range(600)]
    df = spark.createDataFrame([(r["Event"], r["TimeControl"], r["WhiteElo"], r["BlackElo"], r["Termination"]) for r in rows], "event_text string, time_control string, white_elo string, black_elo string, termination string")
    got = [r[0] for r in df.coalesce(1).select(ingest.accepts()).collect()]
    assert got == [pgn.headers_accepted({k: v for k, v in r.items() if v is not None}, FilterConfig()) for r in rows] and any(got)


@pytest.mark.parametrize("size", [300, 1000, 5000])
def test_parts_of_a_plain_file_have_each_game_once(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(pgn, "LOOK_BACK", 512)
    text = "".join(game_text(n, plies=12 + 40 * (n % 5), **{k: v for k, v in s.items() if k != "plies"}) for n, s in enumerate(SPECS * 2))
    path = tmp_path / "plain.pgn"
    path.write_text("\n\n" + text.rstrip("\n"))
    want = [(h["Site"], m.strip()) for h, m in pgn.games(path.read_text().splitlines(keepends=True))]
    got = []
    for at in range(0, path.stat().st_size, size):
        got += [(h["Site"], m.strip()) for _, h, m in pgn.games_of_part(str(path), at, at + size)]
    assert got == want and len(want) == 32
    df = pgn.read(spark, str(path), split_bytes=size)
    assert df.rdd.getNumPartitions() == -(-path.stat().st_size // size)
    assert [r.site for r in pgn.flat(df).orderBy("game_seq").collect()] == [site for site, _ in want]


# Builds -----------------------------------------------------------------------------------------------------------


def built(spark, dump, engine, tmp_path, name, **options):  # noqa: F811
    out = OutputConfig(games_per_shard=2, local_dir=f"{tmp_path}/{name}/out", extract_dir=f"{tmp_path}/{name}/ex", state_path=f"{tmp_path}/{name}/state.json")
    cfg = DatasetConfig(output=out, labeling=engine)
    return cfg, build.run_build(spark, cfg, lambda d: label.scored(d, engine), "Fake 1", {"2025-01": dump, "2025-02": dump}, **options).collect()


def test_a_build_is_the_same_however_it_is_cut(spark, dump, engine, tmp_path):  # noqa: F811
    cfg, whole = built(spark, dump, engine, tmp_path, "whole")
    parts, first = built(spark, dump, engine, tmp_path, "parts", max_shards=2, shards_per_commit=1)
    _, rest = built(spark, dump, engine, tmp_path, "parts", shards_per_commit=3)
    assert sorted(first + rest) == sorted(whole) and len(first) == 4
    rows = lambda c: sorted(shards.read(spark, c.output.local_dir).select("src_dump", "shard", "game_id", "ply", "pos_key").collect())
    assert rows(cfg) == rows(parts) and len(rows(cfg)) == sum(r.n_positions for r in whole)
    # the second dump repeats the first: all of it is left out as duplicates
    again = [r for r in whole if r.dump == "2025-02"]
    assert sum(r.n_positions for r in again) == 0 and sum(r.n_duplicates for r in again) == 10 * 4
    assert build.summary(spark.createDataFrame(whole)).first().summary == f"{len(whole)} shards, {len(rows(cfg))} positions, {sum(r.n_duplicates for r in whole)} duplicates left out"


def test_a_build_ends_at_its_target(spark, dump, engine, tmp_path):  # noqa: F811
    cfg, report = built(spark, dump, engine, tmp_path, "target", target_positions=9, shards_per_commit=1)
    state = build.PipelineState.load(spark, cfg.output.state_path)
    assert 9 <= state.total_positions == sum(r.n_positions for r in report) < 9 + 8 and state.dumps["2025-01"].games_seen == 16


def test_state_survives_a_broken_write(spark, tmp_path):
    path = f"{tmp_path}/state.json"
    for k in range(4):
        session.write_text(spark, path, str(k))
    newest, _ = session._versions(spark, path)[0]
    (tmp_path / f"state.json.v{newest + 1:08d}").write_text("4")  # without its last line: the writer died
    assert session.read_text(spark, path) == "3" and session.read_text(spark, f"{tmp_path}/none.json") is None


@pytest.mark.parametrize("rows", [None, 5, 2_000_000])
def test_unseen_by_broadcast_or_shuffle(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (9, "e")], "k bigint, v string")
    seen = spark.createDataFrame([(2,), (None,), (5,), (2,)], "k bigint")
    assert sorted(r.v for r in ingest.unseen(df, seen, "k", rows).collect()) == ["a", "d", "e"]
    assert ingest.unseen(df.limit(0), seen, "k", rows).count() == 0 and ingest.unseen(df, seen.limit(0), "k", rows).count() == 5


# Ranks and percentiles --------------------------------------------------------------------------------------------


def test_ranks_with_ties_nulls_and_a_null_group(spark):
    coin = random.Random(4)
    rows = [(coin.choice(["a", "b", None]), coin.choice([None, 0.0, 0.0, 0.0, float(coin.randrange(40))])) for _ in range(700)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, v double")
    got = {r.i: r.rank_v for r in ranks.average_ranks(df, ["v"], ["g"]).collect()}
    for g in ("a", "b", None):
        values = sorted(v for h, v in rows if h == g and v is not None)
        for i, (h, v) in enumerate(rows):
            if h == g:
                assert got[i] == (None if v is None else values.index(v) + (values.count(v) + 1) / 2)
    assert ranks.average_ranks(df.limit(0), ["v"], ["g"]).count() == 0


def test_percentiles_are_those_of_numpy(spark):
    coin = np.random.default_rng(5)
    values = [float(x) for x in coin.normal(size=501)] + [0.0] * 300
    df = spark.createDataFrame([("x" if i % 3 else None, v) for i, v in enumerate(values)] + [("y", 7.0), ("z", None)], "g string, v double")
    got = {(r.g, r.pct): r.value for r in ranks.percentiles(df, "v", [0, 12.5, 50, 99, 100], ["g"]).collect()}
    for g in ("x", None):
        mine = [v for i, v in enumerate(values) if (i % 3 > 0) == (g == "x")]
        assert all(abs(got[g, p] - np.percentile(mine, p)) < 1e-12 for p in (0, 12.5, 50, 99, 100))
    assert got["y", 50] == 7.0 and ("z", 50) not in got


def test_evaluation_keeps_the_null_group(spark):
    df = spark.createDataFrame([(None, 0.1, 0.2), (None, 0.3, 0.1), (None, 0.2, 0.3), ("a", 0.5, 0.4), ("a", 0.6, None)], "g string, p double, a double")
    got = {r.g: r for r in metrics.evaluate(df, "p", "a", by=["g"]).collect()}
    assert got[None].n == 3 and abs(got[None].spearman + 0.5) < 1e-12 and got["a"].n == 1 and got["a"].spearman is None


def test_places_by_value_and_sequences(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", (i * 7) % 5) for i in range(200)], "i bigint, g string, v int")
    rows = skew.placed_by_value(df, ["g"], "v", F.xxhash64("i"), [F.col("i")]).collect()
    for g in "ab":
        mine = sorted((r.place, r.v) for r in rows if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    seq = spark.createDataFrame([(x,) for x in (5, 70_000, 3, 1 << 40, 9000, None)], "s bigint")
    assert {r.s: r.rank for r in skew.sequenced(seq, "s").collect()} == {3: 1, 5: 2, 9000: 3, 70_000: 4, 1 << 40: 5}


def test_batches_of_an_epoch(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    one, two = [ingest.numbered_batches(df, 7, e, "k", 64).collect() for e in (1, 2)]
    of = lambda rows: {b: [r.k for r in sorted(rows, key=lambda r: r.place) if r.batch == b] for b in {r.batch for r in rows}}
    assert sorted(map(len, of(one).values())) == [40] + [64] * 15 and all(v == sorted(v) for v in of(one).values())
    assert of(one) != of(two) and sorted(r.k for r in one) == list(range(1000))


def test_planes_of_odd_texts(spark):
    texts = ["8/8/8/8/8/8/8/K1k5 b - - 007 3", "8/8/8/8/8/8/8/K1k5 b - - 150 3", "8/8/8/8/8/8/8/K1k5 x - - 1 3", "", None, "44/8/8/8/8/8/8/K1k5 w - - 0 1", rules.START, rules.START.split(" ")[0],
             "rnbqkbnr/ppp1p1pp/8/3pPp2/8/8/PPPP1PPP/RNBQKBNR w HAha f6 0 3", "r3k2r/8/8/8/3Pp3/8/8/R3K2R\tb Kq d3 12", "x" * 50_000]
    for r in encode.with_planes(spark.createDataFrame([(t,) for t in texts], "fen string")).collect():
        try:
            want = None if r.fen is None else rules.planes(r.fen).tobytes()
        except ValueError:
            want = None
        assert (None if r.planes is None else bytes(r.planes)) == want


# Matches ----------------------------------------------------------------------------------------------------------

PLAYS = '''import sys
sys.path.insert(0, {root!r})
from plyforge.functions import rules
for line in sys.stdin:
    w = line.split()
    if w[:1] == ["uci"]: print("id name First 1", flush=True); print("uciok", flush=True)
    elif w[:1] == ["isready"]: print("readyok", flush=True)
    elif w[:1] == ["position"]: at = rules.Position.read(" ".join(w[2:]))
    elif w[:1] == ["go"]:
        worth = sum({{"p": 1, "n": 3, "b": 3, "r": 5, "q": 9}}.get(c.lower(), 0) * (1 if at.mine(c) else -1) for c in at.board if c != ".")
        print("info depth 1 score cp %d" % (100 * worth), flush=True)
        print("bestmove " + rules.uci(next(at.legal())), flush=True)
    elif w[:1] == ["quit"]: break
'''


@pytest.fixture(scope="module")
def first_mover(tmp_path_factory):
    from pathlib import Path

    path = tmp_path_factory.mktemp("player") / "first.py"
    path.write_text(PLAYS.format(root=str(Path(__file__).resolve().parent.parent)))
    return LabelingConfig(engine_path=f"{sys.executable} {path}", depth=1, workers=2)


def test_a_match_against_an_engine(spark, first_mover):
    pairs = match.pairings(spark.createDataFrame([(1, rules.START), (2, "4k3/8/8/8/8/8/4P3/4K3 w - - 0 1")], "opening_id bigint, fen string"))
    games = search.play(pairs, search.ScorerPlayer(search.material_scorer, depth=2, random_ties=True), search.EnginePlayer(first_mover, rating=1320), max_plies=16, seed=3).collect()
    assert len(games) == 4 and all(g.termination in ("max_plies", "checkmate", "repetition", "stalemate", "insufficient") for g in games)
    assert all(g.seconds_per_move > 0 for g in games if g.plies > 1)
    broken = search.play(pairs, search.material_scorer, search.EnginePlayer(LabelingConfig(engine_path=f"{sys.executable} -c pass")), max_plies=4)
    with pytest.raises(Exception, match="EngineNotAvailable|engine"):
        broken.collect()


def test_search_within_a_task_equals_the_one_by_tables(spark):
    fens = ["4k3/8/8/3q4/4P3/8/8/4K3 w - - 0 1", "r3k3/8/8/8/8/8/4R3/4K3 b - - 0 1", "7k/5Q2/6K1/8/8/8/8/8 w - - 0 1"]
    roots = spark.createDataFrame(list(enumerate(fens)), "root bigint, fen string")
    for depth in (1, 2):
        table = {(r.root, r.move): r.value for r in search.search(roots, search.material_scorer, depth=depth).collect()}
        for k, fen in enumerate(fens):
            moves, values = search.move_values(rules.Position.read(fen), search.material_scorer, depth)
            assert {(k, rules.uci(m)): v for m, v in zip(moves, values)} == pytest.approx({key: v for key, v in table.items() if key[0] == k})
    ranked = [[(r.root, r.move) for r in search.search(roots, search.material_scorer, ties_seed=s).orderBy("root", "rank").collect()] for s in (1, 2, 2)]
    assert ranked[0] != ranked[1] == ranked[2] and sorted(ranked[0]) == sorted(ranked[1])


def test_move_losses(spark, first_mover):
    fen = "4k3/8/8/3q4/4P3/8/8/4K3 w - - 0 1"
    first = rules.uci(next(rules.Position.read(fen).legal()))
    rows = [(1, fen, "e4d5"), (2, fen, "e1e2"), (3, fen, "e1e8"), (4, None, "e2e4"), (5, fen, first), (6, "7k/5Q2/6K1/8/8/8/8/8 w - - 0 1", "f7g7")]
    got = {r.root: r for r in search.move_losses(spark.createDataFrame(rows, "root bigint, fen string, move string"), first_mover).collect()}
    # the engine counts material: -800 before; after taking the queen White is a pawn up, which is no loss; a king's move loses nothing
    assert got[1].loss_cp == 0 and got[2].loss_cp == 0 and got[3].loss_cp is None and got[4].loss_cp is None and got[5].agrees
    assert got[6].loss_cp == 900 + 2000 or got[6].loss_cp == 0
    stats = match.move_quality(spark.createDataFrame([(1, 0.0, True), (1, 400.0, False), (None, 10.0, False)], "g int, loss_cp double, agrees boolean"), ["g"])
    rows = {r.g: r for r in stats.collect()}
    assert rows[1].median_loss == 200 and rows[1].blunder_rate == 0.5 and rows[None].n == 1
    lines = {r.g: r.summary for r in match.quality_text(stats, ["g"]).collect()}
    assert lines[1] == "ACPL 200.0 +- 200.0 (median 200.0), agreement 50.0 %, blunders 50.0 %, n 2"


def test_texts_of_reports(spark):
    games = spark.createDataFrame([(1, 1.0, 30, "checkmate"), (1, 0.5, 400, "max_plies"), (2, 1.0, 20, "checkmate")], "g int, score double, plies int, termination string")
    lines = {r.g: r.summary for r in match.match_text(match.match_stats(games, ["g"]), ["g"]).collect()}
    assert lines[1].startswith("2 games: +1 =1 -0") and lines[1].endswith("1 unfinished") and "+inf" in lines[2]
    pooled = match.pooled_elo(spark.createDataFrame([(1500, 10, 0.5)], "opponent_elo int, n bigint, score_rate double"))
    assert match.elo_text(pooled).first().summary.startswith("Elo 1500 +- ")
    swept = match.pooled_elo(spark.createDataFrame([(1500, 10, 1.0)], "opponent_elo int, n bigint, score_rate double"))
    assert match.elo_text(swept).first().summary == "Elo above all opponents (10 games)"
    scores = spark.createDataFrame([(0.5, 0.25)], "rmse double, mae double")
    assert metrics.rmse_map(mean=scores) == {"mean": 0.5} and metrics.score_text("mean", scores).first().summary == "mean: rmse 0.5000  mae 0.2500"
    models = spark.createDataFrame([("a", 0.3, 1000.0), ("b", 0.25, 1400.0), ("c", 0.2, 1700.0)], "m string, e double, s double")
    assert tuple(metrics.rank_agreement(models, "e", "s").first()) == (3, pytest.approx(-1.0), "follows")
    speeds = {(r.model, r.batch): (r.positions_per_second, r.best) for r in metrics.throughput(spark.createDataFrame([("a", 10, 1.0), ("a", 10, 3.0), ("a", 20, 2.0), ("a", 5, 0.0)], "model string, batch int, seconds double")).collect()}
    assert speeds == {("a", 10): (5.0, False), ("a", 20): (10.0, True)} and math.isfinite(speeds["a", 20][0])
