"""Splits that keep related records together.

Entities (games) tied by links (copies) form groups (``union_find``); all records of a group get one split. Groups are
assigned largest first, each to the split furthest below its target. The assignment is computed on sizes: all groups
of one size are interchangeable, so only how many of them go to which split is computed on the driver (n records have at
most sqrt(2 n) different sizes), and which ones is drawn by a seeded hash. No group, link or record is collected.

Nulls: a record that names no entity is a group by itself. Configurations with a null share count it as zero; shares
are scaled to sum to one. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge import session
from plyforge.llm.union_find import components
from plyforge.operators.skew import HOT_SHARE, bucket_count, hot_join, numbered

SPLITS = ("train", "val", "test")
#: Largest plan (a row for each seed, size and split) that is broadcast; above it the join is an ordinary one.
PLAN_ROWS = 100_000


def groups_of(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, group_id) of every entity and of every other id that a link ties to one.

    ``links`` has columns id, other; ``entities`` has id. ``group_id`` is the group's smallest id among ``entities``.
    """
    tied = components(links.select("id", "other"))
    whole = session.cut(tied.select(F.col("node").alias("id"), "root").unionByName(tied.select(F.col("root").alias("id"), "root")).distinct(), "groups")
    known = entities.select("id").filter("id is not null").distinct()
    named = whole.join(known, "id").groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("size"))
    load = whole.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    inside = hot_join(whole, named.join(load, "root").select("root", "group_id", "n"), "root", "n", whole.count()).select("id", "group_id")
    single = known.join(whole, "id", "left_anti").select("id", F.col("id").alias("group_id"))
    return inside.unionByName(single)


def contradictions(log: DataFrame, groups: DataFrame) -> DataFrame:
    """(seed, group_id) of groups whose rows in ``log`` (seed, id, split) lie in more than one split.

    Rows with a null seed, id or split say nothing. The log is reduced to its distinct statements before any join.
    """
    said = log.filter("seed is not null and id is not null and split is not null")
    said = said.groupBy("seed", "id").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    both = said.join(groups, "id").groupBy("seed", "group_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return both.filter("low != high").select("seed", "group_id")


def quotas(sizes: list[tuple[int, int]], shares: list[float]) -> list[tuple[int, list[int]]]:
    """For (size, how many groups) in descending order of size: (size, groups for each split).

    The same as giving the groups one by one to the split furthest below its target (ties to the first): for many
    groups of one size, the gaps are first levelled in one step and the last few groups given singly.
    """
    total = sum(size * n for size, n in sizes)
    scale = sum(shares) or 1.0
    gap = [total * s / scale for s in shares]
    out = []
    for size, n in sizes:
        given = [0] * len(shares)
        left = n
        if left > 4 * len(shares):
            order = sorted(range(len(gap)), key=lambda k: -gap[k])
            used = len(order)
            # the level to which the `used` largest gaps sink; a gap already below it takes no part
            while used > 1 and gap[order[used - 1]] <= (sum(gap[k] for k in order[:used]) - size * left) / used:
                used -= 1
            level = (sum(gap[k] for k in order[:used]) - size * left) / used
            for k in order[:used]:
                take = min(left, max(0, int((gap[k] - level) // size) - 1))
                given[k] += take
                gap[k] -= take * size
                left -= take
        for _ in range(left):
            k = max(range(len(gap)), key=lambda i: (gap[i], -i))
            given[k] += 1
            gap[k] -= size
        out.append((size, given))
    return out


def assign(group_sizes: DataFrame, configs: list[dict]) -> DataFrame:
    """(seed, group_id, n, split) for each configuration (seed, train, val, test) and group (group_id, n)."""
    spark = group_sizes.sparkSession
    sized = session.cut(group_sizes.select("group_id", "n"), "group-sizes")
    histogram = sorted(((r.n, r.c) for r in sized.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    rows = []
    alike = dict(histogram)
    for config in configs:
        start = {size: 0 for size, _ in histogram}
        for size, given in quotas(histogram, [float(config[s] or 0.0) for s in SPLITS]):
            for split, count in zip(SPLITS, given):
                if count:
                    rows.append((config["seed"], size, start[size], start[size] + count, split, alike[size]))
                    start[size] += count
    plan = spark.createDataFrame(rows, "seed bigint, n bigint, low bigint, high bigint, split string, alike bigint")
    seeds = F.array(*[F.lit(c["seed"]).cast("bigint") for c in configs])
    drawn = sized.withColumn("seed", F.explode(seeds)).withColumn("salt", F.xxhash64("seed", "group_id"))
    buckets = bucket_count(sum(c for _, c in histogram))
    ranked = numbered(drawn, ["seed", "n"], [F.col("salt"), F.col("group_id")], buckets, F.col("salt"))
    inside = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    out = ["seed", "group_id", "n", "split"]
    if len(rows) <= PLAN_ROWS:
        return ranked.join(F.broadcast(plan), ["seed", "n"]).filter(inside).select(out)
    # of a larger plan only the sizes that many groups have are broadcast (fewer than HOT_SHARE for a seed), so none is a hot key
    many = F.col("alike") > max(1, sum(alike.values()) // HOT_SHARE)
    hot = plan.filter(many)
    near = ranked.join(F.broadcast(hot), ["seed", "n"]).filter(inside).select(out)
    rest = ranked.join(F.broadcast(hot.select("seed", "n").distinct()), ["seed", "n"], "left_anti")
    return near.unionByName(rest.join(plan.filter(~many), ["seed", "n"]).filter(inside).select(out))


def split_records(records: DataFrame, groups: DataFrame, configs: list[dict]) -> DataFrame:
    """(seed, rec_id, group_id, split) for every record (rec_id, id): one split per group and configuration.

    A record whose id is null is a group of its own, named ``#rec_id``.
    """
    counted = records.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    mapped = session.cut(counted.join(groups, "id", "left").select("id", "n", F.coalesce("group_id", "id").alias("group_id")), "record-ids")
    lone = records.filter("id is null").select(F.concat(F.lit("#"), F.col("rec_id")).alias("group_id"), F.lit(1).cast("bigint").alias("n"))
    sizes = mapped.groupBy("group_id").agg(F.sum("n").alias("n")).unionByName(lone)
    given = session.cut(assign(sizes, configs), "group-splits")
    total = records.count()
    # a group with a third of all ids, or an id with a third of all records, is joined where its rows lie
    listed = given.groupBy("group_id").agg(F.collect_list(F.struct("seed", "split")).alias("given"))
    load = mapped.groupBy("group_id").agg(F.count(F.lit(1)).alias("ids"))
    per_id = hot_join(mapped, listed.join(load, "group_id"), "group_id", "ids", mapped.count()).select("id", "n", "group_id", "given")
    named = hot_join(records.filter("id is not null").select("rec_id", "id"), per_id, "id", "n", total)
    alone = records.filter("id is null").select("rec_id", F.concat(F.lit("#"), F.col("rec_id")).alias("group_id"))
    both = named.select("rec_id", "group_id", "given").unionByName(alone.join(listed, "group_id").select("rec_id", "group_id", "given"))
    return both.select(F.explode("given").alias("g"), "rec_id", "group_id").select("g.seed", "rec_id", "group_id", "g.split")


def shares(assigned: DataFrame) -> DataFrame:
    """(seed, split, records, share): what each split actually got."""
    n = assigned.groupBy("seed", "split").agg(F.count(F.lit(1)).alias("records"))
    return n.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy("seed")))
