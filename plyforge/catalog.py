"""The queries over the project's tables that exercise the core's operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge import session
from plyforge.config import SplitConfig
from plyforge.functions import board, keys, refs, scoring
from plyforge.operators import encode, ingest, match, metrics, profile, search, split, validate
from plyforge.operators.skew import sequenced
from plyforge.sources.shards import SCHEMA

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "positions").select(*SCHEMA.names)


SQL_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def sql_ref(col: str) -> str:
    pattern = r"^(?:(?:[A-Za-z]+://)?[^/\s]+/)?([A-Za-z0-9]{8})(?:/(?:white|black)?)?(?:[?#]\S*)?$"
    return f"nullif(regexp_extract(trim({col}, {SQL_BLANKS}), '{pattern}', 1), '')"


def sql_clock(col: str) -> str:
    part = [f"try_cast(nullif(regexp_extract(trim({col}, {SQL_BLANKS}), '^([0-9]{{1,9}})[+]([0-9]{{1,9}})$', {k}), '') AS BIGINT)" for k in (1, 2)]
    seconds = f"({part[0]} + 40 * {part[1]})"
    bounds = "".join(f" WHEN {seconds} <= {b} THEN '{c}'" for b, c in refs.CLOCK_BOUNDS)
    return f"CASE WHEN trim({col}, {SQL_BLANKS}) = '-' THEN 'Correspondence'{bounds} WHEN {seconds} IS NOT NULL THEN 'Classical' END"


def sql_elo(col: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({col}, {SQL_BLANKS}), '[+-]?[0-9]{{1,9}}') THEN try_cast(trim({col}, {SQL_BLANKS}) AS INT) END"


def sql_category(col: str) -> str:
    names = "".join(f" WHEN contains(lower({col}), '{c.lower()}') THEN '{c}'" for c in refs.CATEGORIES)
    return f"coalesce(CASE{names} END, {sql_clock(col)}, 'Unknown')"


def sql_header_category() -> str:
    names = "".join(f" WHEN contains(coalesce(event_text, ''), '{c}') THEN '{c}'" for c in refs.CATEGORIES)
    return f"coalesce(CASE{names} END, {sql_clock('time_control')})"


_ACCEPTS = f"""coalesce({sql_header_category()} IN ('Blitz', 'Rapid', 'Classical')
    AND {sql_elo("white_elo")} >= 2200 AND {sql_elo("black_elo")} >= 2200
    AND coalesce(termination, '') NOT IN ('Abandoned', 'Rules infraction', 'Unterminated')
    AND starts_with(coalesce(event_text, ''), 'Rated'), false)"""


# Ingest -----------------------------------------------------------------------------------------------------------


@query(f"SELECT src_dump, count(*) AS games_seen, count(*) FILTER (WHERE {_ACCEPTS}) AS games_accepted, count(*) FILTER (WHERE {_ACCEPTS}) / count(*)::DOUBLE AS acceptance_rate FROM games GROUP BY 1")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.scan_stats(_t(spark, sf_dir, "games"), by=("src_dump",))


@query(f"SELECT game_seq, {sql_ref('site')} AS game_id, {sql_header_category()} AS category FROM games WHERE {_ACCEPTS}")
def accepted_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _t(spark, sf_dir, "games").filter(ingest.accepts())
    return g.select("game_seq", refs.game_ref(F.col("site")).alias("game_id"), refs.header_category(F.coalesce("event_text", F.lit("")), F.col("time_control")).alias("category"))


@query(f"""SELECT count(*) AS games_seen, count(*) FILTER (WHERE {_ACCEPTS}) AS games_accepted, count(*) FILTER (WHERE {_ACCEPTS}) / count(*)::DOUBLE AS acceptance_rate,
    count(*) FILTER (WHERE {_ACCEPTS}) / count(*)::DOUBLE * 90e6 * 4 AS positions_per_month,
    ceil(2.5e6 / nullif(count(*) FILTER (WHERE {_ACCEPTS}) / count(*)::DOUBLE * 90e6 * 4, 0))::BIGINT AS months_needed FROM games""")
def yield_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.yield_projection(ingest.scan_stats(_t(spark, sf_dir, "games")), 90e6, 4, 2.5e6)


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY game_seq) AS k FROM games WHERE {_ACCEPTS})
    SELECT ((k - 1) // 500)::INT AS shard, count(*) AS n_positions, count(DISTINCT k) AS n_games, count(*) / 2000.0 AS share_of_ceiling FROM a
    GROUP BY 1""")
def shard_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _t(spark, sf_dir, "games").filter(ingest.accepts()).select("game_seq")
    return profile.shard_yield(sequenced(g, "game_seq").select(F.col("rank").alias("game_seq")), 500)


@query("""SELECT pos_key, rec_id FROM (SELECT pos_key, rec_id, row_number() OVER (PARTITION BY pos_key ORDER BY rec_id) AS k FROM positions WHERE pos_key IS NOT NULL)
    WHERE k = 1""")
def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "positions").select("pos_key", "rec_id").filter("pos_key is not null")
    return ingest.first_of_key(p, "pos_key", ["rec_id"])


@query("SELECT rec_id, pos_key FROM positions p WHERE pos_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM openings o WHERE o.pos_key = p.pos_key)")
def unseen_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "positions").select("rec_id", "pos_key").filter("pos_key is not null")
    return ingest.unseen(p, _t(spark, sf_dir, "openings"), "pos_key")


@query("SELECT count(pos_key) AS n, count(DISTINCT pos_key) AS n_distinct, 1.0 - count(DISTINCT pos_key) / count(pos_key)::DOUBLE AS rate FROM positions")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rate(_t(spark, sf_dir, "positions"), "pos_key")


@query()
def position_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys computed anew, and how many agree with those delivered (blake2b has no SQL)."""
    p = _t(spark, sf_dir, "positions").select("pos_key", keys.digest(keys.first_four_as_written(F.col("fen"))).alias("k"))
    return p.agg(F.count("k").alias("keyed"), F.count_if(F.col("k") == F.col("pos_key")).alias("agree"))


@query()
def early_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings to play from: distinct early positions with either colour."""
    p = _t(spark, sf_dir, "openings").select(F.col("rec_id").alias("opening_id"), "ply", "fen")
    return match.pairings(ingest.openings(p, 40))


# Checks -----------------------------------------------------------------------------------------------------------

_NULLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in SCHEMA.names)
_RANGE = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND {c} BETWEEN -1 AND 1" for c in ("value_white", "value_stm"))


@query(f"""WITH a AS (SELECT count(*) AS n, count(*) - count(DISTINCT pos_key) AS dup,
        greatest(count(*) FILTER (WHERE turn_white), count(*) - count(*) FILTER (WHERE turn_white)) AS larger,
        count(*) FILTER (WHERE NOT ({_RANGE})) AS rng, {_NULLS} AS nulls,
        count(*) FILTER (WHERE white_elo < 2200 OR black_elo < 2200) AS elo, least(count(white_elo), count(black_elo)) AS elos,
        count(*) FILTER (WHERE NOT coalesce(turn_white IS NOT NULL AND cp_white = CASE WHEN turn_white THEN cp_stm ELSE -cp_stm END
            AND abs(value_white - CASE WHEN turn_white THEN value_stm ELSE -value_stm END) < 1e-6, false)) AS sgn,
        count(*) FILTER (WHERE NOT coalesce(is_mate = (mate_in <> 0), false) OR coalesce(is_mate AND abs(cp_white) <> 2000, false)) AS mate
        FROM positions)
    SELECT unnest(['no_duplicate_positions', 'colour_balance', 'label_range', 'no_nulls', 'elo_threshold', 'sign_invariant', 'mate_flags']) AS name,
        unnest([dup = 0, n > 0 AND larger <= 0.55 * n, n > 0 AND rng = 0, nulls = 0, elos > 0 AND elo = 0, sgn = 0, mate = 0]) AS passed,
        unnest([dup, greatest(0, ceil(larger - 0.55 * n)::BIGINT), rng, nulls, elo, sgn, mate])::BIGINT AS violations FROM a""")
def validate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_rows(_dataset(spark, sf_dir))


@query()
def fen_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position read by the rules (no SQL for them)."""
    return validate.legality(_dataset(spark, sf_dir))


@query("""SELECT count(*) AS n_positions, count(DISTINCT game_id) AS n_games, count(*) FILTER (WHERE turn_white) / count(*)::DOUBLE AS white_to_move_share,
    count(*) FILTER (WHERE is_mate) / count(*)::DOUBLE AS mate_share, round(avg(value_white::DOUBLE), 9) AS value_mean, round(stddev_pop(value_white::DOUBLE), 9) AS value_std,
    min(value_white) AS value_min, max(value_white) AS value_max, round(avg(white_elo), 6) AS mean_white_elo, round(avg(black_elo), 6) AS mean_black_elo,
    round(avg(ply), 6) AS mean_ply FROM positions""")
def describe_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {"value_mean": 9, "value_std": 9, "mean_white_elo": 6, "mean_black_elo": 6, "mean_ply": 6}
    d = validate.describe(_dataset(spark, sf_dir).withColumn("value_white", F.col("value_white")))
    return d.withColumns({c: F.round(c, n) for c, n in places.items()})


# Profiles ---------------------------------------------------------------------------------------------------------


@query(f"SELECT {sql_category('time_control')} AS category, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM positions GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "positions").select(refs.label_category(F.col("time_control")).alias("category"))
    return profile.value_counts(p, "category")


@query("""SELECT is_mate, least(floor((value_white::DOUBLE + 1) / (2 / 61.0::DOUBLE)), 60)::INT AS bin, count(*) AS n FROM positions
    WHERE value_white BETWEEN -1 AND 1 GROUP BY 1, 2""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(_t(spark, sf_dir, "positions"), "value_white", -1.0, 1.0, 61, "is_mate")


@query("SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS pct, unnest(quantile_cont(cp_white, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS value FROM positions")
def cp_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.percentiles(_t(spark, sf_dir, "positions"), "cp_white")


@query("""SELECT turn_white, count(value_white) AS n, round(avg(value_white::DOUBLE), 9) AS mean, round(stddev_pop(value_white::DOUBLE), 9) AS std,
    round(quantile_cont(value_white::DOUBLE, 0.5), 9) AS median, round(avg(abs(value_white::DOUBLE)), 9) AS mean_abs FROM positions GROUP BY 1""")
def turn_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.by_turn(_t(spark, sf_dir, "positions"), "value_white")
    return d.withColumns({c: F.round(c, 9) for c in ("mean", "std", "median", "mean_abs")})


@query("""SELECT floor(ply / 10)::INT AS bucket, count(*) AS n, round(avg(abs(value_white::DOUBLE)), 9) AS mean_abs FROM positions WHERE ply IS NOT NULL
    GROUP BY 1 HAVING count(*) >= 30""")
def ply_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.by_ply(_t(spark, sf_dir, "positions"), "value_white").withColumn("mean_abs", F.round("mean_abs", 9))


@query("""SELECT ply, count(*) AS n, sum(count(*)) OVER (ORDER BY ply DESC) / sum(count(*)) OVER ()::DOUBLE AS from_top FROM positions
    WHERE ply IS NOT NULL GROUP BY 1""")
def ply_from_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.cumulative_share(_t(spark, sf_dir, "positions"), "ply")


@query("""SELECT t.threshold, count(*) FILTER (WHERE ply >= t.threshold) AS kept, count(*) AS n, count(*) FILTER (WHERE ply >= t.threshold) / count(*)::DOUBLE AS share
    FROM positions, (SELECT unnest([0, 12, 16, 20, 25, 30]) AS threshold) t GROUP BY 1""")
def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.survival(_t(spark, sf_dir, "positions"), "ply")


@query("""SELECT turn_white, is_mate, count(*) AS n, grouping(turn_white)::INT AS all_a, grouping(is_mate)::INT AS all_b FROM positions
    GROUP BY CUBE (turn_white, is_mate)""")
def turn_by_mate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.contingency(_t(spark, sf_dir, "positions"), "turn_white", "is_mate")


_COUNT = "length(split_part(fen, ' ', 1)) - length(replace(split_part(fen, ' ', 1), '{0}', ''))"
_BALANCE = " + ".join(f"{w} * (({_COUNT.format(p)}) - ({_COUNT.format(p.lower())}))" for p, w in (("P", 1), ("N", 3), ("B", 3), ("R", 5), ("Q", 9)))


#: positions with every text, its fields apart by single blanks and its side in lower case
_EVERY = r"""(SELECT * REPLACE (regexp_replace(x, '^[^ ]+ [^ ]+', split_part(x, ' ', 1) || ' ' || lower(split_part(x, ' ', 2))) AS fen) FROM
    (SELECT *, trim(regexp_replace(fen, '[\s\x0B_\x{00A0}]+', ' ', 'g'), ' ') AS x FROM positions WHERE fen IS NOT NULL))"""


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with a text, however written, with White's material balance."""
    p = _t(spark, sf_dir, "positions").filter("fen is not null")
    return p.withColumn("_pieces", board.placement(F.col("fen"))).withColumn("balance", board.material_balance(F.col("_pieces"))).drop("_pieces")


@query(f"""WITH p AS (SELECT *, {_BALANCE} AS balance FROM {_EVERY})
    SELECT turn_white, count(*) FILTER (WHERE abs(balance) >= 3) AS n_clear,
        round(avg(CASE WHEN abs(balance) >= 3 THEN (sign(balance) = sign(value_white))::INT END), 9) AS agreement,
        round(corr(balance::DOUBLE, value_white::DOUBLE), 8) AS correlation FROM p GROUP BY 1""")
def label_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.label_convention(_balanced(spark, sf_dir), "balance", "value_white")
    return d.withColumns({"agreement": F.round("agreement", 9), "correlation": F.round("correlation", 8)})


@query("SELECT DISTINCT sf_depth, sf_version, src_dump FROM positions")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "positions").select("sf_depth", "sf_version", "src_dump").distinct()


@query("SELECT time_control FROM (SELECT DISTINCT time_control FROM positions EXCEPT SELECT unnest(['UltraBullet', 'Bullet', 'Blitz', 'Rapid', 'Classical', 'Correspondence', 'Unknown']))")
def unexpected_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(c,) for c in (*refs.CATEGORIES, "Unknown")], "time_control string")
    return _t(spark, sf_dir, "positions").select("time_control").subtract(known)


# Labels -----------------------------------------------------------------------------------------------------------


@query("""SELECT rec_id, greatest(-2000, least(2000, cp_white))::INT AS clipped, round(tanh(greatest(-2000, least(2000, cp_white)) / 400.0::DOUBLE), 12) AS value,
    round(400 * atanh(greatest(-tanh(5.0::DOUBLE), least(tanh(5.0::DOUBLE), value_white::DOUBLE))), 6) AS cp_back FROM positions
    WHERE cp_white IS NOT NULL AND value_white IS NOT NULL AND NOT isnan(value_white)""")
def values_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "positions").filter("cp_white is not null and value_white is not null and not isnan(value_white)")
    return p.select(
        "rec_id",
        scoring.clip_cp(F.col("cp_white")).alias("clipped"),
        F.round(scoring.cp_to_value(F.col("cp_white")), 12).alias("value"),
        F.round(scoring.value_to_cp(F.col("value_white")), 6).alias("cp_back"),
    )


@query("""WITH e AS (SELECT abs(cp_white - 400 * atanh(greatest(-tanh(5.0::DOUBLE), least(tanh(5.0::DOUBLE), value_white::DOUBLE)))) AS err FROM positions
    WHERE cp_white IS NOT NULL AND value_white IS NOT NULL AND NOT isnan(value_white)) SELECT round(max(err), 5) AS max_error, round(avg(err), 5) AS mean_error FROM e""")
def reconstruction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "positions").filter("cp_white is not null and value_white is not null and not isnan(value_white)")
    return metrics.reconstruction(p, "cp_white", "value_white").select(F.round("max_error", 5).alias("max_error"), F.round("mean_error", 5).alias("mean_error"))


# Splits -----------------------------------------------------------------------------------------------------------

_PLACE = "('0x' || substr(sha256('20260911:' || {0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_SPLIT = "CASE WHEN {0} IS NULL THEN NULL WHEN " + _PLACE + " < 0.9 THEN 'train' WHEN " + _PLACE + " < 0.9500000000000001 THEN 'val' ELSE 'test' END"


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "positions").select("rec_id", refs.game_ref(F.col("game_id")).alias("game_id"))


@query(f"WITH g AS (SELECT rec_id, {sql_ref('game_id')} AS game_id FROM positions) SELECT rec_id, {_SPLIT.format('game_id')} AS split FROM g")
def hashed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _games(spark, sf_dir).select("rec_id", split.hashed_split(F.col("game_id")).alias("split"))


@query(f"""WITH g AS (SELECT rec_id, {sql_ref('game_id')} AS game_id FROM positions), s AS (SELECT *, {_SPLIT.format('game_id')} AS split FROM g)
    SELECT split, count(*) AS n, count(DISTINCT game_id) AS n_games, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM s GROUP BY 1""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.describe_split(_games(spark, sf_dir).withColumn("split", split.hashed_split(F.col("game_id"))))


@query()
def keyed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blake2b split (no SQL for it)."""
    return split.describe_split(_games(spark, sf_dir).withColumn("split", split.keyed_split(F.col("game_id"), SplitConfig())))


@query(f"""WITH s AS (SELECT seed, {sql_ref('game_id')} AS game_id, lower(trim(split, {SQL_BLANKS})) AS w FROM split_log),
    n AS (SELECT seed, game_id, CASE WHEN w IN ('train', 'training', 'tr') THEN 'train' WHEN w IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN w IN ('test', 'testing', 'tst') THEN 'test' END AS split FROM s)
    SELECT seed, game_id FROM n WHERE split IS NOT NULL AND game_id IS NOT NULL AND seed IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def leaked_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks under every seed of the log."""
    t = _t(spark, sf_dir, "split_log").filter("seed is not null")
    t = t.select("seed", refs.game_ref(F.col("game_id")).alias("game_id"), refs.split_name(F.col("split")).alias("split")).filter("game_id is not null")
    return split.leaked_games(t, game=["seed", "game_id"])


@query("SELECT CASE (rec_id // 1000) % 20 WHEN 1 THEN 'test' WHEN 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM positions GROUP BY 1")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "positions").groupBy(split.block_split(F.col("rec_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query()
def nested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 500, 1000 and 3000 rows, the smaller within the larger (the order is by xxhash64)."""
    p = _t(spark, sf_dir, "positions").select("rec_id")
    return split.nested_samples(p, "rec_id", [500, 1000, 3000], 7)


# Metrics and baselines --------------------------------------------------------------------------------------------

_PRED = f"WITH p AS (SELECT {sql_category('time_control')} AS category, tanh(({_BALANCE}) / 4.0::DOUBLE) AS p, value_white::DOUBLE AS a FROM {_EVERY} WHERE value_white IS NOT NULL)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _balanced(spark, sf_dir)
    return b.select("rec_id", refs.label_category(F.col("time_control")).alias("category"), F.tanh(F.col("balance") / 4.0).alias("p"), F.col("value_white").cast("double").alias("a"))


@query(f"""{_PRED}, r AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY p) + (count(*) OVER (PARTITION BY category, p) - 1) / 2.0 AS rp,
        rank() OVER (PARTITION BY category ORDER BY a) + (count(*) OVER (PARTITION BY category, a) - 1) / 2.0 AS ra,
        400 * atanh(greatest(-tanh(5.0::DOUBLE), least(tanh(5.0::DOUBLE), p))) AS cp, 400 * atanh(greatest(-tanh(5.0::DOUBLE), least(tanh(5.0::DOUBLE), a))) AS ca FROM p)
    SELECT category, count(*) AS n, round(sqrt(avg((p - a) * (p - a))), 9) AS rmse, round(avg(abs(p - a)), 9) AS mae, round(avg(abs(cp - ca)), 5) AS mae_cp,
        round(avg(CASE WHEN abs(a) > 0.05 THEN (sign(p) = sign(a))::INT END), 9) AS sign_agreement,
        round(CASE WHEN stddev_pop(rp) > 0 AND stddev_pop(ra) > 0 THEN corr(rp, ra) END, 8) AS spearman FROM r GROUP BY 1""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {"rmse": 9, "mae": 9, "mae_cp": 5, "sign_agreement": 9, "spearman": 8}
    got = metrics.evaluate(_predicted(spark, sf_dir), "p", "a", by=["category"])
    return got.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(f"""{_PRED} SELECT CASE WHEN abs(a) < 0.05 THEN 0 WHEN abs(a) < 0.2 THEN 1 WHEN abs(a) < 0.5 THEN 2 WHEN abs(a) < 1.01 THEN 3 END AS band, count(*) AS n,
    round(avg(CASE WHEN abs(a) > 0 THEN (sign(p) = sign(a))::INT END), 9) AS sign_agreement, round(sqrt(avg((p - a) * (p - a))), 9) AS rmse FROM p GROUP BY 1""")
def evaluation_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _predicted(spark, sf_dir).filter("a is not null")
    p, a = F.col("p"), F.col("a")
    return d.groupBy(profile.band(a).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(metrics.sign_agreement(p, a, 0.0), 9).alias("sign_agreement"), F.round(metrics.rmse(p, a), 9).alias("rmse")
    )


@query(f"""{_PRED} SELECT round(avg(CASE WHEN abs(p - a) <= 0.1 THEN 0.5 * (p - a) * (p - a) ELSE 0.1 * (abs(p - a) - 0.05) END), 9) AS huber,
    round(avg((abs(a) >= 0.99)::INT), 9) AS saturated FROM p""")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _predicted(spark, sf_dir).filter("a is not null")
    return d.agg(F.round(metrics.huber(F.col("p"), F.col("a")), 9).alias("huber"), F.round(metrics.saturated_share(F.col("a")), 9).alias("saturated"))


@query(f"""WITH g AS (SELECT {sql_ref('game_id')} AS game_id, value_white::DOUBLE AS a FROM positions), s AS (SELECT a, {_SPLIT.format('game_id')} AS split FROM g),
    m AS (SELECT avg(a) AS m FROM s WHERE split = 'train')
    SELECT round(sqrt(avg((m - a) * (m - a))), 9) AS rmse, round(avg(abs(m - a)), 9) AS mae FROM s, m WHERE split = 'test'""")
def mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "positions").select("value_white", split.hashed_split(refs.game_ref(F.col("game_id"))).alias("split"))
    got = metrics.mean_baseline(p.filter("split = 'train'"), p.filter("split = 'test'"), "value_white")
    return got.select(F.round("rmse", 9).alias("rmse"), F.round("mae", 9).alias("mae"))


@query()
def material_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on material (an estimator; no SQL)."""
    p = _t(spark, sf_dir, "positions").select("fen", F.col("value_stm").cast("double").alias("value_stm"), split.hashed_split(refs.game_ref(F.col("game_id"))).alias("split"))
    f = encode.material_features(p)
    names = [f"d_{x}" for x in encode.PIECES]
    return metrics.material_baseline(f.filter("split = 'train'"), f.filter("split = 'test'"), names, "value_stm")[0]


_OWN = "CASE split_part(fen, ' ', 2) WHEN 'w' THEN 1 WHEN 'b' THEN -1 END"


@query("SELECT rec_id, " + ", ".join(f"({_OWN}) * (({_COUNT.format(c)}) - ({_COUNT.format(c.lower())})) AS d_{n}" for n, c in zip(encode.PIECES, "PNBRQK")) + f" FROM {_EVERY}")
def material_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "positions").filter("fen is not null").select("rec_id", "fen")
    return encode.material_features(p).drop("fen")


@query()
def encoded_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions as planes, checked (the en passant plane needs the rules)."""
    p = session.spread(_t(spark, sf_dir, "positions").select("fen"))
    return encode.encoding_sanity(encode.with_planes(p))


# Matches ----------------------------------------------------------------------------------------------------------

_GAMES = f"""WITH g AS (SELECT {sql_elo("white_elo")} AS w, {sql_elo("black_elo")} AS b, plies, termination,
    CASE trim(result, {SQL_BLANKS}) WHEN '1-0' THEN 1.0::DOUBLE WHEN '0-1' THEN 0.0 WHEN '1/2-1/2' THEN 0.5 END AS score FROM games),
    m AS (SELECT (b // 100 * 100)::INT AS opponent_elo, score, plies, termination FROM g WHERE w BETWEEN 2000 AND 3200 AND b BETWEEN 2000 AND 3200 AND score IS NOT NULL)"""


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = refs.stripped(F.col("result"))
    g = _t(spark, sf_dir, "games").select(
        ingest.elo(F.col("white_elo")).alias("w"), ingest.elo(F.col("black_elo")).alias("b"), "plies", "termination",
        F.when(result == "1-0", 1.0).when(result == "0-1", 0.0).when(result == "1/2-1/2", 0.5).alias("score"),
    )
    g = g.filter(F.col("w").between(2000, 3200) & F.col("b").between(2000, 3200) & F.col("score").isNotNull())
    return g.select((F.floor(F.col("b") / 100) * 100).cast("int").alias("opponent_elo"), "score", "plies", "termination")


@query(f"""{_GAMES} SELECT opponent_elo, count(*) AS n, count(*) FILTER (WHERE score = 1) AS won, count(*) FILTER (WHERE score = 0.5) AS drawn,
    count(*) FILTER (WHERE score = 0) AS lost, count(*) FILTER (WHERE termination IN ('max_plies', 'interrupted')) AS unfinished, round(avg(score), 9) AS score_rate,
    round(stddev_samp(score) / sqrt(count(*)), 9) AS margin, round(avg(plies), 6) AS mean_plies,
    round(CASE WHEN avg(score) >= 1 THEN 'inf'::DOUBLE WHEN avg(score) <= 0 THEN '-inf'::DOUBLE ELSE 400 * log10(avg(score) / (1 - avg(score))) END, 6) AS elo_difference FROM m GROUP BY 1""")
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {"score_rate": 9, "margin": 9, "mean_plies": 6, "elo_difference": 6}
    return match.match_stats(_match(spark, sf_dir), ["opponent_elo"]).withColumns({c: F.round(c, n) for c, n in places.items()})


@query(f"{_GAMES} SELECT termination, count(*) AS n FROM m WHERE score = 0.5 GROUP BY 1")
def draws_by_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.draws_by_termination(_match(spark, sf_dir))


@query(f"""{_GAMES}, r AS (SELECT opponent_elo, count(*) AS n, avg(score) AS s FROM m GROUP BY 1),
    lim AS (SELECT min(opponent_elo) AS lo, max(opponent_elo) AS hi, sum(n) AS games FROM r),
    grid AS (SELECT lo - 2000 + unnest(generate_series(0, (hi - lo + 4000)::BIGINT)) AS rating FROM lim),
    ll AS (SELECT rating, sum(n * (s * ln(greatest(1e-12, least(1 - 1e-12, 1 / (1 + pow(10.0, (opponent_elo - rating) / 400.0::DOUBLE)))))
        + (1 - s) * ln(1 - greatest(1e-12, least(1 - 1e-12, 1 / (1 + pow(10.0, (opponent_elo - rating) / 400.0::DOUBLE))))))) AS l FROM grid, r GROUP BY 1)
    SELECT any_value(lim.games)::BIGINT AS games, arg_max(rating, l)::DOUBLE AS rating,
        (max(rating) FILTER (WHERE l >= (SELECT max(l) FROM ll) - 0.5) - min(rating) FILTER (WHERE l >= (SELECT max(l) FROM ll) - 0.5)) / 2.0::DOUBLE AS sigma FROM ll, lim""")
def pooled_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _match(spark, sf_dir).groupBy("opponent_elo").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score_rate"))
    return match.pooled_elo(r)


# Search -----------------------------------------------------------------------------------------------------------


@query()
def best_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best move of every opening position by material after the reply (the rules have no SQL)."""
    roots = _t(spark, sf_dir, "openings").select(F.col("rec_id").alias("root"), "fen").repartition(8)
    return search.best_moves(roots, search.material_scorer, depth=2)
