import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge import session
from plyforge.llm import linkage, mixing, proportions, quantiles, runs, seen_keys, splits, union_find
from plyforge.functions import keys


# Seen keys --------------------------------------------------------------------------------------------------------


def seen_by_hand(history, batches):
    known, out = {k for k in history if k is not None}, []
    for rec, _, k in sorted(batches):
        if k is not None:
            if k in known:
                out.append(rec)
            known.add(k)
    return sorted(out)


def frames(spark, history, batches):
    return spark.createDataFrame([(k,) for k in history], "key bigint"), spark.createDataFrame(batches, "rec_id bigint, batch_no int, key bigint")


@pytest.mark.parametrize("flush", [1, 3])
def test_seen_keys_against_brute_force(spark, flush):
    coin = random.Random(flush)
    history = [coin.randrange(200) for _ in range(150)] + [None, -(1 << 63), (1 << 63) - 1]
    batches = [(1000 + i, i // 40, coin.choice([None, 7, coin.randrange(400), -(1 << 63)])) for i in range(400)]
    seen = seen_keys.find_seen(*frames(spark, history, batches), flush_batches=flush)
    assert sorted(r.rec_id for r in seen.hits.collect()) == seen_by_hand(history, batches)
    rates = seen_keys.wrong_rates(seen).first()
    assert rates.wrong_rate == 0 and rates.probed == rates.unseen + (rates.hash_hits - rates.refuted)


def test_seen_keys_hot_key_extra_columns_and_empty(spark):
    batches = [(i, 0, 5 if i % 3 else i + 10_000) for i in range(1, 600)]
    h, b = frames(spark, [], batches)
    clash = b.withColumns({"h": F.lit(1), "n": F.lit(2), "first": F.lit(3), "hit": F.lit(True)})
    got = sorted(r.rec_id for r in seen_keys.find_seen(h.withColumn("b", F.lit(0)), clash).hits.collect())
    assert got == seen_by_hand([], batches)
    h, b = frames(spark, [1, 2], [])
    empty = seen_keys.find_seen(h, b)
    assert empty.hits.count() == 0 and seen_keys.wrong_rates(empty).first().hash_wrong_rate == 0


def test_hash_collisions_are_refuted(spark, monkeypatch):
    monkeypatch.setattr(runs, "hash32", lambda key: F.pmod(key, F.lit(4)).cast("int"))
    seen = seen_keys.find_seen(*frames(spark, [0, 1, 2], [(10, 0, 4), (11, 0, 1), (12, 0, 3)]))
    assert [r.rec_id for r in seen.hits.collect()] == [11]
    rates = seen_keys.wrong_rates(seen).first()
    assert rates.refuted == 1 and rates.hash_wrong_rate == 0.5


def test_store_levels_compact_and_reopen(spark):
    path = session.new_path(spark, "store")
    store = runs.RunStore.open(spark, path, payload="v bigint", fan_out=2, block_bytes=1024, rows_per_file=60)
    for part in range(5):
        store.flush(spark.range(part * 100, part * 100 + 100).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v")))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    again = runs.RunStore.open(spark, path)
    assert again.runs == store.runs and again.scan().count() == 500
    probe = spark.createDataFrame([(5, "a"), (5, "b"), (499, "c"), (777, "d")], "key bigint, name string")
    got = {r.name: (r.found, r.old_v) for r in again.probe(probe).collect()}
    assert got == {"a": (True, 10), "b": (True, 10), "c": (True, 998), "d": (False, None)}


def test_a_store_that_begins_empty_grows(spark):
    """Each run has the files its own size asks for, whatever the store began with; every key is found again."""
    store = runs.RunStore.open(spark, session.new_path(spark, "store"), rows_per_file=100_000)
    assert store.flush(spark.range(0).select(F.col("id").alias("key"))) is None
    store.flush(spark.range(10).select(F.col("id").alias("key")))
    store.flush(spark.range(100, 1_000_100, numPartitions=4).select(F.col("id").alias("key")))
    assert [run.files for run in store.runs] == [1, 10] and store.probe(spark.range(3).select(F.col("id").alias("key"))).rdd.getNumPartitions() == 10
    asked = store.probe(spark.range(0, 2_000_000, 7, numPartitions=4).select(F.col("id").alias("key")))
    got = {r.found: (r.n, r.least, r.most) for r in asked.groupBy("found").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()}
    known = [k for k in range(0, 2_000_000, 7) if k < 10 or 100 <= k < 1_000_100]
    assert got[True] == (len(known), 0, known[-1]) and got[False][0] == len(range(0, 2_000_000, 7)) - len(known)


def test_twins_are_all_pairs_of_a_run_with_one_key(spark):
    store = runs.RunStore.open(spark, session.new_path(spark, "store"), payload="v bigint", block_bytes=512, rows_per_file=400)
    rows = [(k % 40 if k < 900 else 10_000 + k, k) for k in range(1000)]
    run = store.flush(spark.createDataFrame(rows, "key bigint, v bigint"))
    assert run.files == 3
    got = sorted(tuple(sorted((r.v, r.old_v))) for r in store.twins(run).collect())
    assert got == sorted((a, b) for b in range(900) for a in range(b) if a % 40 == b % 40)


def test_a_broken_commit_leaves_the_state_before(spark):
    path = session.new_path(spark, "store")
    store = runs.RunStore.open(spark, path, fan_out=2)
    for k in range(3):
        store.flush(spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("key")))
    newest, name = session._versions(spark, f"{path}/manifest.json")[0]
    broken = session._hadoop(spark, f"{path}/manifest.json.v{newest + 1:08d}")
    out = broken[1].create(broken[0], False)
    out.write(bytearray(b'{"levels": [], "made"'))  # the writer died in mid-file
    out.close()
    assert runs.RunStore.open(spark, path).scan().count() == 30
    again = runs.RunStore.open(spark, path, fan_out=2)
    again._write(spark.range(5).select(F.col("id").alias("key")), 5)  # a run that was written but never committed
    again = runs.RunStore.open(spark, path, fan_out=2)
    again.flush(spark.range(30, 40).select(F.col("id").alias("key")))
    assert sorted(r.key for r in runs.RunStore.open(spark, path).scan().collect()) == list(range(40))


def test_seen_keys_go_on_with_a_store(spark):
    path = session.new_path(spark, "store")
    h, b = frames(spark, [1, 2], [(10, 0, 3), (11, 0, 1)])
    assert [r.rec_id for r in seen_keys.find_seen(h, b, path=path).hits.collect()] == [11]
    _, later = frames(spark, [], [(20, 1, 3), (21, 1, 9), (22, 1, 2)])
    assert sorted(r.rec_id for r in seen_keys.find_seen(None, later, path=path).hits.collect()) == [20, 22]


# Splits -----------------------------------------------------------------------------------------------------------


def components_by_hand(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("edges_of_a_task", [500_000, 8])
@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind, edges_of_a_task, monkeypatch):
    monkeypatch.setattr(union_find, "FOREST_EDGES", edges_of_a_task)  # few: the levels of a forest that no task holds
    coin = random.Random(5)
    if kind == "random":
        edges = [(f"n{coin.randrange(300):03d}", f"n{coin.randrange(300):03d}") for _ in range(200)]
    elif kind == "chain":
        order = coin.sample(range(400), 400)
        edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in zip(order, order[1:])]
    else:
        edges = [("n900", f"n{i:03d}") for i in range(500)]
    edges += [(None, "n001"), ("n002", None), ("n003", "n003"), edges[0]]
    df = spark.createDataFrame(edges, "a string, b string").repartition(7)
    got = union_find.components(df).collect()
    assert {r.node: r.root for r in got} == components_by_hand(edges) and len(got) == len({r.node for r in got})


def test_components_of_nothing(spark):
    assert union_find.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups_and_contradictions(spark):
    links = spark.createDataFrame([("b", "c"), ("c", "d"), ("x", "missing"), ("y", "missing"), (None, "b"), ("e", "e")], "id string, other string")
    ids = spark.createDataFrame([(i,) for i in ["b", "c", "d", "x", "y", "e", "solo", "solo", None]], "id string")
    groups = splits.groups_of(links, ids)
    assert {r.id: r.group_id for r in groups.collect()} == {"b": "b", "c": "b", "d": "b", "x": "x", "y": "x", "missing": "x", "e": "e", "solo": "solo"}
    log = [(1, "b", "train"), (1, "d", "test"), (2, "b", "train"), (2, "c", "train"), (1, "solo", "val"), (1, "solo", "val"), (1, "solo", None), (1, None, "test"),
           (1, "nowhere", "test"), (1, "nowhere", "val"), (None, "e", "val"), (3, "x", "val"), (3, "y", "train")]
    df = spark.createDataFrame(log, "seed bigint, id string, split string").withColumns({"group_id": F.lit("zz"), "low": F.lit(1)})
    assert sorted(tuple(r) for r in splits.contradictions(df, groups).collect()) == [(1, "b"), (3, "x")]
    assert splits.contradictions(df.limit(0), groups).count() == 0


def greedy(sizes, shares):
    gap = [sum(sizes) * s for s in shares]
    for s in sorted(sizes, reverse=True):
        gap[max(range(len(gap)), key=lambda k: (gap[k], -k))] -= s
    return gap


def test_quotas_are_the_greedy_assignment():
    coin = random.Random(2)
    for _ in range(60):
        sizes = [coin.choice([1, 1, 1, 1, 2, 3, 10, 50]) for _ in range(coin.randrange(1, 400))]
        shares = coin.choice([[0.9, 0.05, 0.05], [0.8, 0.1, 0.1], [0.4, 0.3, 0.3]])
        counted = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
        given = splits.quotas(counted, shares)
        assert all(sum(g) == n for (_, n), (_, g) in zip(counted, given))
        gap = [sum(sizes) * share - sum(size * g[k] for size, g in given) for k, share in enumerate(shares)]
        assert max(map(abs, gap)) <= max(map(abs, greedy(sizes, shares))) + 1.5


def test_split_records(spark):
    rows = [(i, f"g{i % 40:02d}" if i % 5 else None) for i in range(2000)] + [(i, "hot") for i in range(2000, 3000)]
    links = spark.createDataFrame([(f"g{i:02d}", f"g{i + 1:02d}") for i in range(0, 40, 2)], "id string, other string")
    ids = spark.createDataFrame([(f"g{i:02d}",) for i in range(40)], "id string")
    groups = splits.groups_of(links, ids)
    configs = [{"seed": 1, "train": 0.6, "val": 0.2, "test": 0.2}, {"seed": 2, "train": 0.4, "val": 0.3, "test": 0.3}]
    got = splits.split_records(spark.createDataFrame(rows, "rec_id bigint, id string"), groups, configs)
    assert got.count() == 6000 and got.select("seed", "rec_id").distinct().count() == 6000
    assert got.groupBy("seed", "group_id").agg(F.count_distinct("split").alias("k")).filter("k > 1").count() == 0
    share = {(r.seed, r.split): r.share for r in splits.shares(got).collect()}
    assert abs(share[1, "train"] - 0.6) < 0.01 and abs(share[2, "val"] - 0.3) < 0.01
    empty = splits.split_records(spark.createDataFrame([], "rec_id bigint, id string"), groups, configs)
    assert empty.count() == 0


# Proportions ------------------------------------------------------------------------------------------------------


def test_repair_meets_floors_and_targets():
    coin = np.random.default_rng(3)
    for _ in range(50):
        k = int(coin.integers(1, 8))
        have = coin.integers(0, 500, k)
        share = coin.dirichlet(np.ones(k))
        floor = coin.integers(0, 60, k)
        size = int(coin.integers(1, 600))
        x = proportions.repair(have, share, floor, size, coin)
        size = min(size, have.sum())
        assert x.sum() == size and (x <= have).all() and (x >= 0).all()
        low = np.minimum(floor, have)
        if low.sum() <= size:
            assert (x >= low).all()
            want = share * size
            over = np.where(x > low, x - want, -np.inf).max()
            under = np.where(x < have, want - x, -np.inf).max()
            assert over + under <= 1 or k == 1


def test_sample_matches_plan(spark):
    rows = [(i, "d", "Blitz" if i % 3 else "Rapid", bool(i % 2)) for i in range(3000)] + [(9000 + i, "d", None, True) for i in range(5)] + [(9100, None, "Blitz", None)]
    pool = spark.createDataFrame(rows, "rec_id bigint, src_dump string, time_control string, turn_white boolean").withColumn("take", F.lit(1))
    plans = [(1, 1, "d", "Blitz", True, 0.5, 0, 400), (2, 1, "d", "Rapid", True, 0.2, 300, 400), (3, 1, "d", "Rapid", False, 0.3, None, 400), (4, 2, "d", "Bullet", True, 1.0, 5, 50),
             (5, 3, "none", "Blitz", True, None, None, 10), (6, 4, "d", "Rapid", True, 0.5, 600, 900)]
    strata = spark.createDataFrame(plans, "stratum_id bigint, plan_id bigint, src_dump string, time_control string, turn_white boolean, target_share double, min_rows bigint, sample_rows bigint")
    got = {r.stratum_id: r for r in proportions.report(pool, strata.withColumn("available", F.lit(7))).collect()}
    assert {k: r.available for k, r in got.items()} == {1: 1000, 2: 500, 3: 500, 4: 0, 5: 0, 6: 500}
    assert {k for k, r in got.items() if r.short} == {4, 6}
    assert got[2].take == 300 and got[2].floor_met and got[1].take + got[3].take == 100 and not got[4].floor_met
    drawn = proportions.draw(pool, proportions.report(pool, strata)).collect()
    count = {k: sum(r.stratum_id == k for r in drawn) for k in got}
    assert count == {k: r.take for k, r in got.items()} and len({(r.stratum_id, r.rec_id) for r in drawn}) == len(drawn)
    assert proportions.report(pool.limit(0), strata).filter("take > 0").count() == 0
    assert proportions.report(pool, strata.limit(0)).count() == 0


# Percentiles ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["uniform", "heavy", "ties", "sorted"])
def test_sketch_bounds_hold_and_merge(shape):
    coin = np.random.default_rng(8)
    n = 60_000
    values = {"uniform": coin.uniform(0, 1, n), "heavy": coin.pareto(1.0, n), "ties": coin.integers(0, 20, n).astype(float), "sorted": np.arange(n, dtype=float)}[shape]
    exact = np.sort(values)
    for high in (False, True):
        whole = quantiles.Sketch(high)
        for part in np.array_split(values, 13):
            sketch = quantiles.Sketch(high, seed=len(part) + whole.n)
            for chunk in np.array_split(part, 5):
                sketch.update(chunk)
            whole.merge(quantiles.Sketch.from_bytes(sketch.to_bytes()))
        assert whole.n == n and sum(len(lv[0]) << i for i, lv in enumerate(whole.levels)) == n
        assert sum(len(lv[0]) for lv in whole.levels) < 12_000
        for pct in (0.1, 1, 10, 50) if not high else (50, 90, 99, 99.9):
            value, low, up = whole.quantile(pct)
            true = exact[math.ceil(pct * n / 100) - 1]
            assert low <= true <= up and low <= value <= up
            # relative error in rank, from the protected end
            rank = np.searchsorted(exact, value, "left"), np.searchsorted(exact, value, "right")
            want = math.ceil(pct * n / 100)
            off = max(0, rank[0] + 1 - want, want - rank[1])
            assert off <= 0.02 * (n - want + 1 if high else want) + 1


def test_percentiles_and_bands(spark):
    coin = random.Random(1)
    rows = [("a", "Blitz", coin.choice([None, coin.randrange(-100, 100)]), coin.randrange(0, 60)) for _ in range(4000)] + [("b", "Rapid", 1, None)] * 130 + [("c", "Rapid", 500, 1)] * 119
    df = spark.createDataFrame(rows, "src_dump string, time_control string, cp_white int, ply int").withColumns({"n": F.lit(1), "low": F.lit(2), "pct": F.lit(3)})
    values = sorted(r[2] for r in rows if r[0] == "a" and r[2] is not None)
    at = values[math.ceil(0.1 * len(values)) - 1]
    bands = [("Blitz", "cp_white", 10, at, at), ("Blitz", "cp_white", 50, at + 1000, at + 2000), ("Blitz", "ply", 90, 0, 1), ("Rapid", "cp_white", 50, 2, 3), ("Rapid", "ply", 50, 5, 6), ("Bullet", "ply", 50, 5, 6)]
    spec = spark.createDataFrame(bands, "time_control string, field string, pct int, low int, high int")
    got = sorted(tuple(r) for r in quantiles.outside_bands(df, spec, 120).collect())
    assert got == [("a", "Blitz", "cp_white", 50), ("a", "Blitz", "ply", 90), ("b", "Rapid", "cp_white", 50)]
    assert quantiles.outside_bands(df.limit(0), spec, 120).count() == 0
    assert quantiles.outside_bands(df, spec.limit(0), 120).count() == 0


# Linkage ----------------------------------------------------------------------------------------------------------

BASE = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
SAME = "rnbqkbnr/pppppppp/11111111/8/8/8/PPPPPPPP/RNBQKBNR W qkQK - 5 9"
OTHER = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR b KQkq - 0 1"


def recs(spark, rows):
    df = spark.createDataFrame(rows, "rec_id bigint, batch_no int, fen string, pos_key bigint").withColumns({"ident": F.lit(1), "first": F.lit(2)})
    return linkage.records(df, F.col("pos_key"), F.col("batch_no"))


def key_of(fen):
    return keys.digest64(" ".join(fen.split(" ")[:4]))


def test_linkage(spark):
    history = recs(spark, [(1, None, BASE, key_of(BASE)), (2, None, None, 12345), (3, None, BASE, None), (4, None, None, None)])
    batches = recs(spark, [
        (100, 1, SAME, 999), (101, 1, OTHER, key_of(OTHER)), (102, 1, None, key_of(BASE)), (103, 1, None, 12345), (104, 1, None, None), (105, 2, OTHER.replace(" b ", " B "), None),
        (106, 2, "no position", None), (107, 2, "no position", 3), (108, 2, "", None), (109, 3, None, key_of(OTHER)), (110, 3, "x" * 50_000, None), (111, 3, "x" * 50_000, None),
    ])
    out = linkage.link(history, batches, flush_batches=1)
    want = [(1, 100), (1, 102), (2, 103), (101, 105), (101, 109), (106, 107), (110, 111)]
    assert sorted(tuple(r) for r in out.found.collect()) == sorted(want)
    assert out.clusters.count() == out.clusters.select("ident").distinct().count()
    assert linkage.link(history, batches.limit(0)).found.count() == 0
    assert sorted(tuple(r) for r in linkage.link(history.limit(0), batches).found.collect()) == sorted([(100, 102), *want[3:]])


def test_linkage_of_a_hot_position(spark):
    history = recs(spark, [(1, None, BASE, None)])
    batches = recs(spark, [(100 + i, i // 100, BASE if i % 3 == 0 else None, None if i % 3 == 0 else i) for i in range(600)])
    found = linkage.link(history, batches).found
    assert found.count() == 200 and found.filter("first_rec_id != 1").count() == 0


def test_weights_tell_agreement_from_chance():
    """Pairs of which half agree in everything shown and half by chance; origins as repeats have them."""
    import itertools

    coin = random.Random(3)
    counted = {}
    for k in range(4000):
        match = k % 2 == 0
        flags = tuple(coin.random() < (0.95 if match else 0.3) for _ in linkage.SHOWN) + (coin.random() < (0.7 if match else 0.05), None, None)
        counted[flags] = counted.get(flags, 0) + 1
    w = linkage.learn_weights(sorted(counted.items(), key=str), [0.3] * 4 + [0.05, 0.1, 0.2], [(700, 1000), (0, 0), (90, 100)])
    assert all(m > 0.85 for m in w.m[:4]) and abs(w.m[4] - 0.7) < 0.02 and w.m[5] == 0.5 and 0.35 < w.prior < 0.65
    scores = [w.odds(dict(zip(linkage.FIELDS, f))) for f in itertools.product([False, True], repeat=7)]
    assert max(scores) == w.odds(dict.fromkeys(linkage.FIELDS, True)) and w.limit(0.9) <= w.odds(dict.fromkeys(linkage.SHOWN, True))



# Mixing -----------------------------------------------------------------------------------------------------------


def test_mix(spark):
    coin = random.Random(4)
    docs = [(i, "d", "forum", coin.randrange(1, 50)) for i in range(2000)] + [(5000 + i, "d", "manual", 10) for i in range(10)] + [(6000, "d", "forum", 0), (6001, None, "forum", 9), (6002, "d", None, 9)]
    targets = [(1, 1, "d", "forum", 3.0, 1, 10_000), (2, 1, "d", "manual", 1.0, 4, 10_000), (3, 2, "d", "forum", 1.0, 6, 200_000), (4, 3, "d", "none", 1.0, 2, 100), (5, 4, "d", "forum", 0.0, 2, 100), (6, 5, "d", "forum", None, None, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, src_dump string, source string, tokens bigint").withColumn("place", F.lit(1))
    t = spark.createDataFrame(targets, "target_id bigint, mix_id bigint, src_dump string, source string, target_weight double, max_uses int, budget_tokens bigint").withColumn("available", F.lit(0))
    plan = mixing.plan(d, t)
    drawn = mixing.draw(d, plan)
    got = {r.target_id: r for r in mixing.report(plan, drawn).collect()}
    assert {k for k, r in got.items() if r.short} == {2, 4}
    assert abs(got[1].used - 7500) < 250 and got[1].most_uses == 1
    assert got[2].used == 4 * 100 and got[2].most_uses == 4
    total = sum(x[3] for x in docs if x[1] == "d" and x[2] == "forum")
    assert abs(got[3].used - 200_000) < 1500 and got[3].most_uses == math.ceil(200_000 / total)
    assert got[5].used == 0 and got[6].used == 0 and got[4].used == 0
    rows = mixing.emitted(drawn)
    assert rows.filter("target_id = 2").count() == 40 and rows.count() == rows.distinct().count()
    assert mixing.report(mixing.plan(d.limit(0), t), mixing.draw(d.limit(0), mixing.plan(d.limit(0), t))).filter("used > 0").count() == 0
