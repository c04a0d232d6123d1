"""Near-duplicate classes of the record linkage against brute force over all pairs of a placement."""

import dataclasses
import itertools
import math
import random

import duckdb
import pytest
from compare import DATA, needs_data
from pyspark.sql import functions as F

import __spark_entry__
from plyforge import session
from plyforge.functions import keys, position, rules
from plyforge.functions.position import usual_text
from plyforge.llm import linkage, queries, tables

#: Above the threshold of 0.6 one field may differ: two records that agree in two of three fields score 2, others -2 or less.
#: Board and origin say nothing.
WEIGHTS, THRESHOLD = linkage.Weights((0.5, 0.8, 0.8, 0.8, 0.5, 0.5, 0.5), (0.5, 0.2, 0.2, 0.2, 0.5, 0.5, 0.5), 0.5), 0.6


def board_of(n):
    """The n-th of 64 placements that keep all castling rights, each a text to be given side and rights."""
    return "r3k2r/8/" + "8/8/8/8/" + "".join("P" if n >> k & 1 else "1" for k in range(6)).replace("111111", "6") + "2/R3K2R"


def fen(n, side, rights):
    return usual_text(f"{board_of(n)} {side} {rights} -")


def recs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "rec_id bigint, batch_no int, fen string, pos_key bigint")
    return linkage.records(df, F.col("pos_key"), F.col("batch_no")).coalesce(2)


def classes(texts):
    """Identity -> smallest identity of its class, over all pairs of the texts."""
    texts = set(texts)
    up = {keys.digest64(t): keys.digest64(t) for t in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for s, t in itertools.combinations(sorted(texts), 2):
        a, b = s.split(), t.split()
        if a[0] == b[0]:
            score = math.log2(WEIGHTS.prior / (1 - WEIGHTS.prior))
            score += sum(math.log2(m / u) if x == y else math.log2((1 - m) / (1 - u)) for x, y, m, u in zip(a[1:], b[1:], WEIGHTS.m[1:], WEIGHTS.u[1:]))
            if score >= math.log2(THRESHOLD / (1 - THRESHOLD)):
                x, y = find(keys.digest64(s)), find(keys.digest64(t))
                up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.fixture
def weights(monkeypatch):
    monkeypatch.setattr(linkage, "learn_weights", lambda *_: WEIGHTS)


def given(spark, batches, history=()):
    rows = [(1000 * (k + 1) + i, k, t, None) for k, batch in enumerate(batches) for i, t in enumerate(batch)]
    return recs(spark, [(i, None, t, None) for i, t in enumerate(history)]), recs(spark, rows)


def test_chains_recurring_identities_and_moves_over_rounds(spark, weights):
    """Each class comes one state a round, in an order in which every link but the last is to the state before."""
    path = [("w", "K"), ("b", "K"), ("b", "Q"), ("w", "Q"), ("w", "k"), ("b", "k")]
    texts = [[fen(n, *step) for step in (path if n % 2 else path[::-1])] for n in range(1, 9)]
    batches = [[t[k] for t in texts] for k in range(len(path))] + [[t[0] for t in texts], [t[3] for t in texts]]
    want = classes([t for batch in batches for t in batch])
    assert len(set(want.values())) == 8
    got = linkage.link(*given(spark, batches[1:], batches[0]), flush_batches=1, threshold=THRESHOLD, near=False).clusters.collect()
    assert len(got) == len(want) and {r.ident: r.rep for r in got} == want


@pytest.mark.parametrize("flush", [1, 4])
def test_all_states_of_a_placement_are_compared(spark, weights, flush):
    """A first state that is unlike two that are alike, in history, in a round and over rounds; a member that is no head."""
    coin = random.Random(7)
    steps = [(side, rights) for side in "wb" for rights in ("K", "Q", "k", "q", "KQ")]
    texts = [[fen(n, *step) for step in coin.sample(steps, 4)] for n in range(1, 41)]
    history = [t for some in texts[:20] for t in some[:3]]
    batches = [[t for some in texts for t in some[k::4]] for k in range(4)] + [[t for some in texts for t in some[:1]]]
    want = classes(t for some in texts for t in some)
    got = linkage.link(*given(spark, batches, history), flush_batches=flush, threshold=THRESHOLD, near=False).clusters.collect()
    assert len(got) == len(want) and {r.ident: r.rep for r in got} == want


@pytest.mark.parametrize("flush", [1, 4])
def test_a_key_whose_text_arrives_later_is_compared(spark, weights, flush):
    a, b, c = fen(1, "w", "K"), fen(1, "w", "Q"), fen(1, "w", "k")
    key = keys.digest64
    history = recs(spark, [(1, None, None, key(a))])
    batches = recs(spark, [(100, 1, None, key(b)), (200, 2, a, None), (300, 3, b, None), (400, 4, a, None), (500, 5, c, None)])
    got = linkage.link(history, batches, flush_batches=flush, threshold=THRESHOLD, near=False).clusters.collect()
    assert {r.ident: r.rep for r in got} == {key(t): min(map(key, (a, b, c))) for t in (a, b, c)}


def test_weights_are_learned_from_all_pairs_of_history(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(linkage, "learn_weights", lambda patterns, *_: counted.extend(patterns) or WEIGHTS)
    texts = [fen(1, "w", "K")] * 3 + [fen(1, "b", "K")] * 2 + [fen(1, "b", "Q")] + [fen(3, "w", "K")]
    linkage.link(*given(spark, [], texts))
    # each two identities once, their repeats left out; the two boards are a pawn apart with the same side and rights
    of = {}
    for flags, n in counted:
        of[flags[:4]] = of.get(flags[:4], 0) + n
    assert of == {(True, False, True, True): 1, (True, True, False, True): 1, (True, False, False, True): 1, (False, True, True, True): 1}


@needs_data
def test_every_record_has_its_class(spark):
    """The query gives one row for each record with an identity; records that show one position share a class."""
    want = {}
    con = duckdb.connect()
    for table in ("openings", "positions", "arrivals"):
        for rec, fen_, key in con.sql(f"SELECT rec_id, fen, pos_key FROM '{DATA}/{table}.parquet'").fetchall():
            if fen_ is not None or key is not None:
                want[rec] = None if fen_ is None else keys.digest64(usual_text(fen_) or " ".join(fen_.split(" ")[:4]))
    got = __spark_entry__.queries()["p5_clusters"](spark, str(DATA)).collect()
    assert sorted(r.rec_id for r in got) == sorted(want)
    reps = {}
    for r in got:
        if want[r.rec_id] is not None:
            reps.setdefault(want[r.rec_id], set()).add(r.rep)
    assert all(len(x) == 1 for x in reps.values())


def test_members_of_history_and_batches(spark, weights):
    a, b, c, d = fen(1, "w", "K"), fen(1, "b", "Q"), fen(1, "w", "Q"), fen(2, "w", "K")
    out = linkage.link(*given(spark, [[b, d], [c, None]], [a, d, a, None]), flush_batches=1, threshold=THRESHOLD, near=False)
    of = classes([a, b, c, d])
    shown = {0: a, 1: d, 2: a, 1000: b, 1001: d, 2000: c}
    assert sorted(tuple(r) for r in out.members.collect()) == sorted((rec, of[keys.digest64(t)]) for rec, t in shown.items())


def test_links_reach_through_clusters_of_earlier_rounds(spark, weights):
    """A link to a member, to a representative that was moved before, and two clusters that a later record ties."""
    one, two, three = [[fen(n, *step) for step in (("w", "K"), ("b", "K"), ("b", "Q"), ("w", "Q"))] for n in (1, 2, 3)]
    history, batches = [one[0], two[3]], [[one[2], two[0]], [one[1], two[2]], [two[1], one[3], three[0]]]
    want = classes([*history, *(t for b in batches for t in b)])
    for flush in (1, 3):
        got = linkage.link(*given(spark, batches, history), flush_batches=flush, threshold=THRESHOLD, near=False).clusters.collect()
        assert {r.ident: r.rep for r in got} == {keys.digest64(t): want[keys.digest64(t)] for b in batches for t in b}


def test_a_second_call_reads_no_history(spark, weights):
    """The tables, weights and representatives at the path are gone on with."""
    path = session.new_path(spark, "linker")
    first, second = [[fen(n, "w", "K") for n in range(1, 9)]], [[fen(n, "b", "K") for n in range(1, 9)] + [fen(20, "w", "K")]]
    history, batches = given(spark, first, [fen(1, "b", "Q"), fen(9, "w", "K")])
    linkage.link(history, batches, threshold=THRESHOLD, path=path, near=False).clusters.collect()
    rows = recs(spark, [(9000 + i, 7, t, None) for i, t in enumerate(second[0] + first[0])])
    out = linkage.link(None, rows, threshold=THRESHOLD, path=path, near=False)
    assert out.linker.weights == WEIGHTS
    assert sorted(tuple(r) for r in out.found.collect()) == [(1000 + i, 9009 + i) for i in range(8)]
    want = classes([fen(1, "b", "Q"), fen(9, "w", "K"), *first[0], *second[0]])
    assert {r.ident: r.rep for r in out.clusters.collect()} == {keys.digest64(t): want[keys.digest64(t)] for t in first[0] + second[0]}


def damaged(coin, fen_, kind):
    """A text with one piece or one character changed, which may make it no position, or one right lost."""
    placement, side, rights, *rest = fen_.split(" ")
    at = [i for i, c in enumerate(placement) if c.isalpha() and c.lower() != "k"]
    if kind == "piece":
        i = coin.choice(at)
        placement = placement[:i] + coin.choice([p for p in "pnbrqPNBRQ" if p != placement[i]]) + placement[i + 1 :]
    elif kind == "lost":
        i = coin.choice(at)
        placement = position.usual_text(f"{placement[:i]}1{placement[i + 1:]} {side} - -").split(" ")[0]
    elif kind == "digit":
        places = [i for i, c in enumerate(placement) if c in "234567"]
        i = coin.choice(places or at)
        placement = placement[:i] + (str(int(placement[i]) - 1) if places else "") + placement[i + 1 :]
    else:
        rights = rights[1:] or "-"
    return " ".join([placement, side, rights, *rest])


def test_damaged_copies_are_found(spark):
    """Copies of positions of played games, each damaged in one place and delivered again; the next position of a game,
    and positions of other games, are not taken for copies. At least nine of ten copies join their original's class."""
    coin = random.Random(11)
    old, copies, decoys = [], [], []
    for game in range(90):
        at, line = rules.Position.read(rules.START), []
        while len(line) < 40:
            moves = list(at.legal())
            if not moves:
                break
            at = at.play(coin.choice(moves))
            line.append(at.fen())
        for ply in coin.sample(range(8, len(line) - 1), 5):
            old.append((game, ply, line[ply]))
        ply, text = old[-1][1], old[-1][2]
        kinds = ["piece", "lost", "digit"] + (["right"] if text.split(" ")[2] != "-" else [])
        copies.append((game, ply, text, damaged(coin, text, kinds[game % len(kinds)])))
        if all(p != ply + 1 for g, p, _ in old if g == game):
            decoys.append((game, ply, text, line[ply + 1]))
    table = [(i, None, g, p, t) for i, (g, p, t) in enumerate(old)]
    table += [(10_000 + i, i // 20, g, p, t) for i, (g, p, _, t) in enumerate(copies)]
    table += [(20_000 + i, 50, g, p + 1, t) for i, (g, p, _, t) in enumerate(decoys)]
    df = spark.createDataFrame(table, "rec_id bigint, batch_no int, game string, ply int, fen string")
    rows = linkage.records(df, F.lit(None).cast("bigint"), F.col("batch_no"), F.col("game"), F.col("ply"), F.lit("2025-01"))
    out = linkage.link(rows.filter("batch_no is null"), rows.filter("batch_no is not null"))
    of = {r.rec_id: r.rep for r in out.members.collect()}
    home = {(g, p): i for i, (g, p, _) in enumerate(old)}
    found = sum(of[10_000 + i] == of[home[g, p]] for i, (g, p, _, _) in enumerate(copies))
    wrong = sum(of[20_000 + i] == of[home[g, p]] for i, (g, p, _, _) in enumerate(decoys))
    print(f"recall {found}/{len(copies)}, decoys linked {wrong}/{len(decoys)}")
    assert found >= 0.9 * len(copies) and wrong <= 0.02 * len(decoys) and len({of[i] for i in range(len(old))}) >= 0.97 * len({t for *_, t in old})


def test_repeats_go_through_all_steps(spark, monkeypatch):
    """p5_found keeps every blocking table, scores each repeat, and takes it from a cluster of the stored mapping."""
    made, link = [], linkage.link
    monkeypatch.setattr(linkage, "link", lambda *args, **options: made.append(link(*args, **options)) or made[-1])
    monkeypatch.setattr(tables, "accepted_records", lambda *_, **o: recs(spark, [(1, None, fen(1, "w", "K"), None), (2, None, fen(2, "w", "K"), None)]))
    monkeypatch.setattr(tables, "arriving_records", lambda *_, **o: recs(spark, [(11, 0, fen(1, "w", "K"), None), (12, 1, fen(9, "b", "Q"), None), (13, 1, fen(9, "b", "Q"), None)]))
    assert sorted(tuple(r) for r in queries.p5_found(spark, "").collect()) == [(1, 11), (12, 13)]
    out = made[0]
    assert out.linker.stores["near"].rows and out.linker.merged == out.linker.links.done
    assert {r.rec_id for r in out.repeated.filter(F.col("score") >= out.weights.limit(0.9)).collect()} == {11, 13}
    assert {keys.digest64(fen(1, "w", "K")), keys.digest64(fen(9, "b", "Q"))} <= {r.key for r in out.linker.stores["reps"].scan().collect()}
    # without a cluster there is no repeat
    fewer = dataclasses.replace(out, reps=out.reps.filter(F.col("ident") != keys.digest64(fen(9, "b", "Q"))))
    assert [tuple(r) for r in fewer.found.collect()] == [(1, 11)]


def test_a_shared_origin_loses_no_repeat(spark, monkeypatch):
    """Where repeats share their dump less often than other records do, a repeat of one dump is one all the same."""
    rare = linkage.Weights((0.9,) * 4 + (0.5, 0.5, 0.1), (0.2,) * 4 + (0.5, 0.5, 0.6), 0.05)
    monkeypatch.setattr(linkage, "learn_weights", lambda *_: rare)
    rows = [(1, None, fen(1, "w", "K"), "2025-01"), (11, 0, fen(1, "w", "K"), "2025-01"), (12, 0, fen(1, "w", "K"), "2025-02")]
    df = spark.createDataFrame(rows, "rec_id bigint, batch_no int, fen string, src_dump string")
    given_ = linkage.records(df, F.lit(None).cast("bigint"), F.col("batch_no"), dump=F.col("src_dump"), near=False)
    out = linkage.link(given_.filter("batch_no is null"), given_.filter("batch_no is not null"), near=False)
    assert sorted(tuple(r) for r in out.found.collect()) == [(1, 11), (1, 12)]
