"""The queries of this package over the project's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge import session
from plyforge.catalog import SQL_BLANKS, sql_category, sql_ref
from plyforge.functions import keys, refs
from plyforge.operators import ranks
from plyforge.llm import bpe, language, linkage, mixing, proportions, quantiles, seen_keys, splits, tables


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_keys.find_seen(tables.accepted_keys(spark, sf_dir), tables.arriving_keys(spark, sf_dir)).hits


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_keys.wrong_rates(seen_keys.find_seen(tables.accepted_keys(spark, sf_dir), tables.arriving_keys(spark, sf_dir)))


def p1_written_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals whose written key was seen among written keys (no digests, which SQL has not), and for each the verdict's kind."""
    history = tables.read(spark, sf_dir, "openings").select(F.col("pos_key").alias("key")).unionByName(tables.read(spark, sf_dir, "positions").select(F.col("pos_key").alias("key")))
    arrivals = tables.read(spark, sf_dir, "arrivals").select("rec_id", "batch_no", keys.parse_key(F.col("pos_key")).alias("key"))
    return seen_keys.find_seen(history, arrivals).hits


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.groups_of(tables.game_links(spark, sf_dir), tables.game_ids(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.contradictions(tables.split_log(spark, sf_dir), _groups(spark, sf_dir))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = [r.asDict() for r in tables.read(spark, sf_dir, "split_configs").collect()]
    records = tables.read(spark, sf_dir, "positions").select("rec_id", refs.game_ref(F.col("game_id")).alias("id"))
    return splits.split_records(records, _groups(spark, sf_dir), configs)


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each split got under each seed, and whether it missed its share by no more than the largest group."""
    configs = [r.asDict() for r in tables.read(spark, sf_dir, "split_configs").collect()]
    assigned = session.cut(p2_splits(spark, sf_dir), "assigned")
    wanted = spark.createDataFrame([(c["seed"], s, float(c[s] or 0.0) / sum(float(c[x] or 0.0) for x in splits.SPLITS)) for c in configs for s in splits.SPLITS], "seed bigint, split string, target double")
    largest = assigned.groupBy("seed", "group_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    got = wanted.join(splits.shares(assigned), ["seed", "split"], "left").crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(assigned.filter("seed is not null").groupBy("seed").count().agg(F.max("count").alias("total"))))
    return got.select("seed", "split", (F.abs(F.coalesce("records", F.lit(0)) - F.col("target") * F.col("total")) <= F.col("largest")).alias("met"))


def p2_whole_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each seed the records that got a split, and the groups that lie in more than one."""
    assigned = session.cut(p2_splits(spark, sf_dir), "assigned")
    torn = assigned.groupBy("seed", "group_id").agg((F.min("split") != F.max("split")).alias("torn"), F.count(F.lit(1)).alias("n"))
    return torn.groupBy("seed").agg(F.sum("n").alias("records"), F.count_if("torn").alias("torn_groups"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions.report(tables.sampling_pool(spark, sf_dir), tables.read(spark, sf_dir, "sample_plans"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_report(spark, sf_dir).filter("short").select("stratum_id")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = tables.sampling_pool(spark, sf_dir)
    strata = session.cut(proportions.report(pool, tables.read(spark, sf_dir, "sample_plans")), "strata")
    return proportions.draw(pool, strata)


def p3_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each plan the rows drawn, those drawn twice, and the strata that did not get what the report says or less than their floor."""
    pool = tables.sampling_pool(spark, sf_dir)
    strata = session.cut(proportions.report(pool, tables.read(spark, sf_dir, "sample_plans")), "strata")
    drawn = proportions.draw(pool, strata).groupBy("plan_id", "stratum_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rec_id").alias("d"))
    both = strata.join(drawn, ["plan_id", "stratum_id"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "d": F.coalesce("d", F.lit(0))})
    # floors hold where the pool and the sample can give them
    room = F.least("min_rows", "available")
    wrong = (F.col("n") != F.col("take")) | ((F.col("floors") <= F.col("sample_rows")) & (F.col("n") < room))
    floors = strata.groupBy("plan_id").agg(F.sum(F.least("min_rows", "available")).alias("floors"))
    return both.join(floors, "plan_id").groupBy("plan_id").agg(F.sum("n").alias("drawn"), F.sum(F.col("n") - F.col("d")).alias("twice"), F.count_if(wrong).alias("wrong"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.outside_bands(tables.measured(spark, sf_dir), tables.read(spark, sf_dir, "percentile_bands"), min_rows=120)


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["src_dump", "time_control"]
    return quantiles.percentiles(quantiles.sketch(tables.measured(spark, sf_dir), keys, ["cp_white", "ply"]), keys, [10, 50, 90])


def p4_all_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches of the dumps, combined."""
    by_dump = quantiles.sketch(tables.measured(spark, sf_dir), ["src_dump", "time_control"], ["cp_white", "ply"])
    numbered = by_dump.withColumn("part", F.pmod(F.hash("src_dump"), F.lit(1 << 20)))
    return quantiles.percentiles(quantiles.merged(numbered, ["time_control"]), ["time_control"], [10, 50, 90])


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each percentile from the sketches, and whether the exact nearest-rank one lies within the bounds given for it."""
    keys_, pcts = ["src_dump", "time_control"], [10, 50, 90]
    told = p4_percentiles(spark, sf_dir)
    rows = tables.measured(spark, sf_dir)
    n = ranks.running_counts(rows, ["cp_white", "ply"], keys_).withColumnRenamed("_col", "field")
    both = told.join(ranks.renamed(n, [*keys_, "field"]), ranks.matching([*keys_, "field"]))
    at = F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("n") / 100))
    exact = both.groupBy(*keys_, "field", "pct", "lower", "upper").agg(F.min(F.when(F.col("_upto") >= at, F.col("_v"))).alias("exact"))
    return exact.select(*keys_, "field", "pct", F.col("exact").between(F.col("lower"), F.col("upper")).alias("inside"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals linked to an earlier record of their cluster that shows exactly the same: all blocking keys, scores, union-find."""
    return linkage.link(tables.accepted_records(spark, sf_dir), tables.arriving_records(spark, sf_dir)).found


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every record of openings, positions and arrivals: (rec_id, rep)."""
    return linkage.link(tables.accepted_records(spark, sf_dir), tables.arriving_records(spark, sf_dir)).members


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(tables.read(spark, sf_dir, "documents"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.sized_documents(spark, sf_dir)
    planned = session.cut(mixing.plan(docs, tables.mix_targets(spark, sf_dir)), "mix-plan")
    return mixing.report(planned, mixing.draw(docs, planned))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose documents, all drawn as often as they may be, give less than wanted."""
    return p7_report(spark, sf_dir).filter("exhausted").select("target_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tokens of the emitted rows meet each target, or its cap, up to one document."""
    return p7_report(spark, sf_dir).select("target_id", "met", (F.col("most_uses") <= F.coalesce("max_uses", F.lit(1))).alias("capped"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.sized_documents(spark, sf_dir)
    planned = session.cut(mixing.plan(docs, tables.mix_targets(spark, sf_dir)), "mix-plan")
    return mixing.emitted(mixing.draw(docs, planned))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.unnamed(docs, language.label_documents(docs))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.label_documents(docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_rates, p1_written_keys, p2_found, p2_splits, p2_shares, p2_whole_groups, p3_found, p3_report, p3_sample, p3_drawn,
        p4_found, p4_percentiles, p4_all_dumps, p4_bounds, p5_found, p5_clusters, p6_ids, p7_found, p7_report, p7_mix, p7_shares,
        p8_found, p8_segments,
    )
}

_WORD = f"trim(pos_key, {SQL_BLANKS})"
#: the signed 64 bits of a key in any notation
_WRITTEN = f"""CASE WHEN regexp_full_match({_WORD}, '[+-]?[0-9]+') THEN CASE WHEN try_cast({_WORD} AS HUGEINT) BETWEEN -9223372036854775808 AND 18446744073709551615
    THEN (try_cast({_WORD} AS HUGEINT) - CASE WHEN try_cast({_WORD} AS HUGEINT) > 9223372036854775807 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT END
    WHEN regexp_full_match(lower({_WORD}), '(0x)?0*[0-9a-f]{{1,16}}') THEN (('0x' || regexp_extract(lower({_WORD}), '^(0x)?0*([0-9a-f]{{1,16}})$', 2))::UBIGINT::HUGEINT
        - CASE WHEN ('0x' || regexp_extract(lower({_WORD}), '^(0x)?0*([0-9a-f]{{1,16}})$', 2))::UBIGINT > 9223372036854775807 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT END"""

_SIDE = "lower(regexp_extract(fen, '^[\\s_]*[^\\s_]+[\\s_]+([^\\s_]+)', 1))"

SQL: dict[str, str] = {
    "p1_written_keys": f"""
        WITH old AS (SELECT DISTINCT pos_key AS key FROM openings WHERE pos_key IS NOT NULL UNION SELECT pos_key FROM positions WHERE pos_key IS NOT NULL),
        new AS (SELECT rec_id, {_WRITTEN} AS key FROM arrivals), ranked AS (SELECT rec_id, key, min(rec_id) OVER (PARTITION BY key) AS first FROM new WHERE key IS NOT NULL)
        SELECT rec_id FROM ranked WHERE rec_id > first OR key IN (SELECT key FROM old)""",
    "p2_shares": "SELECT seed, unnest(['train', 'val', 'test']) AS split, true AS met FROM split_configs",
    "p2_whole_groups": "SELECT seed, (SELECT count(*) FROM positions) AS records, 0::BIGINT AS torn_groups FROM split_configs",
    "p3_drawn": f"""
        WITH pool AS (
            SELECT src_dump, {sql_category("time_control")} AS time_control,
                coalesce(turn_white, CASE lower(regexp_extract(fen, '^[\\s_]*[^\\s_]+[\\s_]+([^\\s_]+)', 1)) WHEN 'w' THEN true WHEN 'b' THEN false END) AS turn_white FROM positions
        ), n AS (SELECT src_dump, time_control, turn_white, count(*) AS c FROM pool WHERE turn_white IS NOT NULL GROUP BY ALL)
        SELECT plan_id, least(max(sample_rows), sum(coalesce(c, 0)))::BIGINT AS drawn, 0::BIGINT AS twice, 0::BIGINT AS wrong FROM sample_plans
        LEFT JOIN n USING (src_dump, time_control, turn_white) GROUP BY 1""",
    "p4_bounds": f"""
        WITH v AS (
            SELECT src_dump, {sql_category("time_control")} AS time_control, unnest(['cp_white', 'ply']) AS field,
                unnest([CASE WHEN cp_white BETWEEN -2000 AND 2000 THEN cp_white END, CASE WHEN ply >= 0 THEN ply END]) AS x FROM positions
        ), g AS (SELECT DISTINCT src_dump, time_control, field FROM v WHERE x IS NOT NULL)
        SELECT src_dump, time_control, field, unnest([10, 50, 90]) AS pct, true AS inside FROM g""",
    "p7_shares": "SELECT target_id, true AS met, true AS capped FROM mix_targets",
    "p2_found": f"""
        WITH RECURSIVE edge AS (
            SELECT {sql_ref("site")} AS a, {sql_ref("copy_of")} AS b FROM games
        ), tie AS (
            SELECT DISTINCT * FROM (SELECT a, b FROM edge WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b
                UNION ALL SELECT b, a FROM edge WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)
        ), reach(a, b) AS (
            SELECT a, a FROM tie UNION SELECT r.a, t.b FROM reach r JOIN tie t ON r.b = t.a
        ), known AS (SELECT DISTINCT a AS id FROM edge WHERE a IS NOT NULL
        ), grp AS (
            SELECT r.a AS id, min(r.b) AS group_id FROM reach r JOIN known k ON r.b = k.id GROUP BY 1
            UNION ALL SELECT id, id FROM known WHERE id NOT IN (SELECT a FROM tie)
        ), said AS (
            SELECT seed, {sql_ref("game_id")} AS id, lower(trim(split, {SQL_BLANKS})) AS w FROM split_log
        ), named AS (
            SELECT seed, id, CASE WHEN w IN ('train', 'training', 'tr') THEN 'train' WHEN w IN ('val', 'valid', 'validation', 'dev')
                THEN 'val' WHEN w IN ('test', 'testing', 'tst') THEN 'test' END AS split FROM said
        )
        SELECT seed, group_id FROM named JOIN grp USING (id) WHERE split IS NOT NULL AND seed IS NOT NULL
        GROUP BY seed, group_id HAVING count(DISTINCT split) > 1""",
    "p3_found": f"""
        WITH pool AS (
            SELECT src_dump, {sql_category("time_control")} AS time_control,
                coalesce(turn_white, CASE {_SIDE} WHEN 'w' THEN true WHEN 'b' THEN false END) AS turn_white FROM positions
        ), n AS (SELECT src_dump, time_control, turn_white, count(*) AS c FROM pool WHERE turn_white IS NOT NULL GROUP BY ALL)
        SELECT stratum_id FROM sample_plans LEFT JOIN n USING (src_dump, time_control, turn_white)
        WHERE greatest(coalesce(min_rows, 0), coalesce(target_share, 0) * sample_rows) > coalesce(c, 0)""",
    "p4_found": f"""
        WITH v AS (
            SELECT src_dump, {sql_category("time_control")} AS time_control, 'cp_white' AS field, cp_white::INT AS x FROM positions
            WHERE cp_white BETWEEN -2000 AND 2000
            UNION ALL SELECT src_dump, {sql_category("time_control")}, 'ply', ply::INT FROM positions WHERE ply >= 0
        ), r AS (
            SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY src_dump, time_control, field) AS n FROM v
            WINDOW w AS (PARTITION BY src_dump, time_control, field ORDER BY x)
        )
        SELECT r.src_dump, r.time_control, r.field, b.pct::INT AS pct FROM r JOIN percentile_bands b USING (time_control, field)
        WHERE n >= 120 AND k = greatest(1, -((-b.pct * n) // 100)) AND (x < b.low OR x > b.high)""",
}
