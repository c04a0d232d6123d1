"""More queries with their SQL: dumps, extracts and shards written and read again, evaluation records, labels, training
histories, move quality and timings, on data derived from the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge import session
from plyforge.catalog import _ACCEPTS, _BALANCE, _EVERY, _balanced, _dataset, _GAMES, _match, _SPLIT, _t, query, sql_category, sql_ref
from plyforge.config import DatasetConfig, FilterConfig
from plyforge.functions import refs, scoring
from plyforge.operators import ingest, learn, match, metrics, profile, search, split
from plyforge.plans import build
from plyforge.sources import evals, pgn, shards

HEADERS = {"Event": "event_text", "Site": "site", "Result": "result", "WhiteElo": "white_elo", "BlackElo": "black_elo", "TimeControl": "time_control", "Termination": "termination"}

# Dumps ------------------------------------------------------------------------------------------------------------


def _dump(spark: SparkSession, sf_dir: str) -> str:
    """The games as PGN text in a folder of their own, a header for each value there is, with a stub of movetext."""
    g = _t(spark, sf_dir, "games")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in HEADERS.items()]), lambda e: e["value"].isNotNull())
    # every game has a header line, as in a dump; this one is not among those kept
    headers = F.map_from_entries(F.concat(F.array(F.struct(F.lit("Round").alias("key"), F.lit("-").alias("value"))), pairs))
    path = session.new_path(spark, "pgn")
    pgn.write_text(g.select(headers.alias("headers"), F.lit("1. e4 e5 2. Nf3 *").alias("movetext")), path)
    return path


@query("SELECT " + ", ".join(f"regexp_replace({c}, '[\\r\\n]+', ' ', 'g') AS {c}" for c in HEADERS.values()) + " FROM games")
def pgn_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every header of every game, written as a dump (where a value is one line) and read again."""
    return pgn.flat(pgn.read(spark, *pgn.files(spark, _dump(spark, sf_dir)))).select(*HEADERS.values())


@query(f"""SELECT count(*) AS games_seen, count(*) FILTER (WHERE {_ACCEPTS}) AS games_accepted, count(*) FILTER (WHERE {_ACCEPTS}) / count(*)::DOUBLE AS acceptance_rate,
    count(*) FILTER (WHERE {_ACCEPTS}) AS movetexts_read FROM games""")
def dump_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey of a dump; the reader keeps the movetext of accepted games only."""
    g = pgn.flat(pgn.read(spark, *pgn.files(spark, _dump(spark, sf_dir)), accept=FilterConfig()))
    kept = g.agg(F.count("movetext").alias("movetexts_read"))
    return ingest.scan_stats(g).crossJoin(F.broadcast(kept))


@query(f"SELECT count(*) AS games_seen, count(*) FILTER (WHERE {_ACCEPTS}) AS games_accepted, count(*) FILTER (WHERE {_ACCEPTS}) AS games_written FROM games")
def dump_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump's accepted games written in one pass, and how many there are."""
    place = session.new_path(spark, "extract")
    seen, accepted = build.extract_once(spark, ",".join(pgn.files(spark, _dump(spark, sf_dir))), place, DatasetConfig())
    written = spark.read.parquet(place).agg(F.count(F.lit(1)).alias("games_written"))
    return written.select(F.lit(seen).cast("bigint").alias("games_seen"), F.lit(accepted).cast("bigint").alias("games_accepted"), "games_written")


@query(f"SELECT src_dump, format('{{:d}} of {{:d}} games accepted ({{:.2f}} %)', count(*) FILTER (WHERE {_ACCEPTS}), count(*), 100 * count(*) FILTER (WHERE {_ACCEPTS}) / count(*)::DOUBLE) AS summary FROM games GROUP BY 1")
def survey_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.survey_text(ingest.scan_stats(_t(spark, sf_dir, "games"), by=("src_dump",)), by=("src_dump",))


# Shards -----------------------------------------------------------------------------------------------------------


@query("""SELECT src_dump, (rec_id // 2000)::INT AS shard, count(*) AS n, count(DISTINCT pos_key) AS n_keys, count(fen) AS n_texts, sum(cp_white)::BIGINT AS sum_cp FROM positions
    GROUP BY 1, 2""")
def shards_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset written as shards, one of them twice, and read again."""
    rows = _t(spark, sf_dir, "positions").withColumn("shard", F.floor(F.col("rec_id") / 2000).cast("int")).select(*shards.SCHEMA.names, "shard")
    path = session.new_path(spark, "dataset")
    shards.write(rows, path)
    shards.write(rows.filter(F.col("shard") == 1), path)
    return shards.read(spark, path).groupBy("src_dump", "shard").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pos_key").alias("n_keys"), F.count("fen").alias("n_texts"), F.sum("cp_white").alias("sum_cp")
    )


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT pos_key FROM arrivals WHERE pos_key IS NOT NULL)""")
def arriving_key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "arrivals").filter("pos_key is not null").select("pos_key").distinct().agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT rec_id, pos_key, (rec_id // 2000)::INT AS shard, row_number() OVER (PARTITION BY pos_key ORDER BY rec_id) AS k FROM positions)
    SELECT shard, count(*) AS drawn, count(*) FILTER (WHERE pos_key IS NOT NULL AND k > 1) AS duplicates FROM r GROUP BY 1""")
def duplicates_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build leaves out of each shard because an earlier row had the key."""
    p = _t(spark, sf_dir, "positions").select("rec_id", "pos_key").withColumn("shard", F.floor(F.col("rec_id") / 2000).cast("int"))
    fresh = ingest.first_of_key(p, "pos_key", ["rec_id"]).groupBy("shard").agg(F.count(F.lit(1)).alias("fresh"))
    drawn = p.groupBy("shard").agg(F.count(F.lit(1)).alias("drawn"))
    return drawn.join(fresh, "shard", "left").select("shard", "drawn", (F.col("drawn") - F.coalesce("fresh", F.lit(0))).alias("duplicates"))


# Evaluation records -----------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested evaluation records of the positions, as JSON lines, read again: a shallower evaluation, the labelled one and an equally deep one."""
    p = _t(spark, sf_dir, "positions").filter("fen is not null")
    line = lambda cp, mate: F.struct(cp.cast("int").alias("cp"), mate.cast("int").alias("mate"))
    one = lambda depth, cp, mate: F.struct(depth.cast("int").alias("depth"), F.array(line(cp, mate)).alias("pvs"))
    mate = F.when(F.col("is_mate"), F.col("mate_in"))
    three = F.array(one(F.col("sf_depth") - 3, F.lit(7), F.lit(None)), one(F.col("sf_depth"), F.when(mate.isNull(), F.col("cp_white")), mate), one(F.col("sf_depth"), F.lit(9), F.lit(None)))
    text = F.to_json(F.struct("fen", three.alias("evals")))
    path = session.new_path(spark, "evals")
    p.select(text.alias("value")).unionByName(p.filter("is_mate").select(F.lit("{not json").alias("value"))).write.text(path)
    return evals.read(spark, path)


_RECORDS = """WITH p AS (SELECT fen, coalesce(sf_depth, 0)::INT AS depth, CASE WHEN is_mate THEN mate_in END AS m, cp_white, sf_depth FROM positions WHERE fen IS NOT NULL),
    b AS (SELECT fen, depth, CASE WHEN sf_depth IS NULL THEN 7 WHEN m IS NULL THEN cp_white END AS cp, CASE WHEN sf_depth IS NOT NULL THEN m END AS mate FROM p)"""


@query(f"{_RECORDS} SELECT fen, cp, mate::TINYINT AS mate, depth FROM b WHERE depth >= 12 AND (cp IS NOT NULL OR mate IS NOT NULL)")
def evaluation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest evaluation of each record of depth 12 or more; the first of equally deep ones."""
    return evals.flat(_records(spark, sf_dir), 12)


@query("""SELECT 'depth' AS what, sf_depth::INT AS value, count(*) AS n FROM positions WHERE fen IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'evals', 3, count(*) FROM positions WHERE fen IS NOT NULL HAVING count(*) > 0
    UNION ALL SELECT 'lines', 1, count(*) FROM positions WHERE fen IS NOT NULL HAVING count(*) > 0
    UNION ALL SELECT 'fields', len(string_split(fen, ' '))::INT, count(*) FROM positions WHERE fen IS NOT NULL GROUP BY 2""")
def evaluation_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.frequencies(_records(spark, sf_dir))


# Labels -----------------------------------------------------------------------------------------------------------

_CP = "CASE WHEN is_mate AND mate_in IS NOT NULL THEN CASE WHEN mate_in > 0 THEN 2000 ELSE -2000 END WHEN cp_white IS NOT NULL THEN greatest(-2000, least(2000, cp_white)) END"


@query(f"""WITH c AS (SELECT rec_id, {_CP} AS w, turn_white, is_mate AND mate_in IS NOT NULL AS mated, mate_in FROM positions WHERE turn_white IS NOT NULL AND is_mate IS NOT NULL)
    SELECT rec_id, w::INT AS cp_white, (CASE WHEN turn_white THEN w ELSE -w END)::INT AS cp_stm, round(tanh(w / 400.0::DOUBLE)::FLOAT::DOUBLE, 6) AS value_white,
        round(tanh(CASE WHEN turn_white THEN w ELSE -w END / 400.0::DOUBLE)::FLOAT::DOUBLE, 6) AS value_stm, mated AS is_mate, (CASE WHEN mated THEN mate_in ELSE 0 END)::SMALLINT AS mate_in FROM c""")
def labels_made_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of both points of view from White's score, mates counting as the clip."""
    p = _t(spark, sf_dir, "positions").filter("turn_white is not null and is_mate is not null")
    made = scoring.label(F.col("cp_white"), F.when(F.col("is_mate"), F.col("mate_in").cast("int")), F.col("turn_white"))
    return p.select("rec_id", made.alias("l")).select(
        "rec_id", "l.cp_white", "l.cp_stm", F.round(F.col("l.value_white").cast("double"), 6).alias("value_white"), F.round(F.col("l.value_stm").cast("double"), 6).alias("value_stm"), "l.is_mate", "l.mate_in"
    )


@query("""SELECT rec_id, CASE WHEN turn_white THEN value_stm ELSE -value_stm END AS white, CASE WHEN abs(value_stm - value_white) < 0.10::FLOAT THEN 'close'
    WHEN abs(value_stm - value_white) < 0.30::FLOAT THEN 'apart' WHEN value_stm - value_white IS NOT NULL THEN 'far apart' END AS verdict FROM positions WHERE turn_white IS NOT NULL AND NOT coalesce(isnan(value_stm), false)""")
def views_and_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White's view of the mover's value, and how far the two stored values lie apart, in words."""
    p = _t(spark, sf_dir, "positions").filter("turn_white is not null and not isnan(value_stm)")
    return p.select("rec_id", scoring.white_view(F.col("value_stm"), F.col("turn_white")).alias("white"), search.verdict(F.col("value_stm") - F.col("value_white")).alias("verdict"))


@query("""WITH v AS (SELECT rec_id, CASE WHEN is_mate THEN (CASE WHEN mate_in > 0 THEN 1 ELSE -1 END) * (2.0::DOUBLE - abs(mate_in) * 0.01::DOUBLE) ELSE value_white::DOUBLE END AS v FROM positions)
    SELECT rec_id, CASE WHEN abs(v) >= 2.0::DOUBLE - 64 * 0.01::DOUBLE THEN (CASE WHEN v > 0 THEN 1 ELSE -1 END * greatest(1, (round((2.0 - abs(v)) / 0.01)::INT + 1) // 2))::INT END AS moves
    FROM v WHERE v IS NOT NULL""")
def mate_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves to mate that search values stand for; values of no mate stand for none."""
    mate = F.when(F.col("mate_in") > 0, 1).otherwise(-1) * (F.lit(scoring.MATE) - F.abs("mate_in") * F.lit(scoring.MATE_STEP))
    v = _t(spark, sf_dir, "positions").select("rec_id", F.when(F.col("is_mate"), mate).otherwise(F.col("value_white").cast("double")).alias("v")).filter("v is not null")
    return v.select("rec_id", scoring.mate_in(F.col("v")).alias("moves"))


# Splits, samples, batches -----------------------------------------------------------------------------------------


@query(f"""WITH g AS (SELECT {sql_ref('game_id')} AS game_id FROM positions), s AS (SELECT {_SPLIT.format('game_id')} AS split FROM g)
    SELECT count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE split IS NULL) AS none FROM s""")
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "positions").select(split.split_masks(split.hashed_split(refs.game_ref(F.col("game_id")))))
    of = {s: F.count_if(f"masks.in_{s}") for s in ("train", "val", "test")}
    return p.agg(*[c.alias(s) for s, c in of.items()], (F.count(F.lit(1)) - sum(of.values(), F.lit(0))).alias("none"))


@query("""WITH n AS (SELECT count(*) AS n FROM positions) SELECT k AS batch, least(1024, n - k * 1024)::BIGINT AS rows, true AS in_order FROM n, (SELECT unnest(generate_series(0, (SELECT (n - 1) // 1024 FROM n))) AS k)""")
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of an epoch: their sizes, and whether rows are placed in the order of their numbers."""
    b = ingest.numbered_batches(_t(spark, sf_dir, "positions").select("rec_id"), 7, 3, "rec_id", 1024)
    ranked = b.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_list(F.struct("place", "rec_id"))).alias("r"))
    return ranked.select("batch", "rows", (F.transform("r", lambda x: x["rec_id"]) == F.array_sort(F.transform("r", lambda x: x["rec_id"]))).alias("in_order"))


@query("SELECT rec_id FROM positions WHERE rec_id % 50 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth row: the sampling operator itself."""
    return ingest.every_kth(_t(spark, sf_dir, "positions").select("rec_id"), "rec_id", 50)


@query("SELECT count(*) AS n, count(DISTINCT rec_id) AS n_distinct FROM (SELECT rec_id FROM positions LIMIT 400)")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 rows without replacement (a sampling operator)."""
    s = ingest.random_rows(_t(spark, sf_dir, "positions").select("rec_id"), "rec_id", 400, 5)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rec_id").alias("n_distinct"))


@query("SELECT least(500, count(*)) AS v500, least(1000, count(*)) AS v1000, least(3000, count(*)) AS v3000 FROM positions")
def nested_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each nested sample has, the smaller counted within the larger."""
    n = split.nested_samples(_t(spark, sf_dir, "positions").select("rec_id"), "rec_id", [500, 1000, 3000], 7)
    return n.agg(*[F.count_if(F.col("volume") <= v).alias(f"v{v}") for v in (500, 1000, 3000)])


@query("SELECT count(*) AS pairs, count(*) // 2 AS openings, true AS early FROM (SELECT rec_id, unnest([true, false]) AS w FROM (SELECT rec_id FROM openings WHERE ply BETWEEN 0 AND 16 LIMIT 40))")
def opening_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early positions drawn for a match, each with either colour."""
    p = match.pairings(ingest.openings(_t(spark, sf_dir, "openings").select("rec_id", "ply", "fen"), 40))
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("rec_id").alias("openings"), (F.max("ply") <= 16).alias("early"))


# Metrics, histories, timings --------------------------------------------------------------------------------------

_SHOWN = f"SELECT *, {_BALANCE} AS balance FROM {_EVERY}"


@query(f"""WITH p AS ({_SHOWN}), b AS (SELECT src_dump, CASE WHEN abs(balance) < 1 THEN 0 WHEN abs(balance) < 3 THEN 1 WHEN abs(balance) < 5 THEN 2 WHEN abs(balance) < 9 THEN 3
        WHEN balance IS NOT NULL THEN 4 END AS band, balance, value_white FROM p)
    SELECT src_dump, band, count(*) FILTER (WHERE abs(balance) >= 1) AS n_clear, round(avg(CASE WHEN abs(balance) >= 1 THEN (sign(balance) = sign(value_white))::INT END), 9) AS agreement FROM b GROUP BY 1, 2""")
def agreement_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of values with the material balance, by dump and by how clear the balance is."""
    b = _balanced(spark, sf_dir).withColumn("band", profile.material_band(F.col("balance")))
    got = profile.label_convention(b, "balance", "value_white", least=1, by=("src_dump", "band"))
    return got.select("src_dump", "band", "n_clear", F.round("agreement", 9).alias("agreement"))


@query(f"""WITH p AS ({_SHOWN}) SELECT count(*) FILTER (WHERE abs(cp_white) >= 100) AS n_clear, count(*) FILTER (WHERE abs(cp_white) >= 100 AND sign(100 * balance) = sign(cp_white)) AS right_sign,
    count(*) FILTER (WHERE abs(cp_white) < 100) AS n_even, count(*) FILTER (WHERE abs(cp_white) < 100 AND abs(100 * balance) < 100) AS seen_even FROM p""")
def material_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a count of material sees decided and even positions as such."""
    return match.coherence(_balanced(spark, sf_dir).withColumn("guess", 100 * F.col("balance")), "guess", "cp_white")


@query(f"""WITH p AS ({_SHOWN}), v AS (SELECT {sql_category('time_control')} AS category, tanh(balance / 4.0::DOUBLE) AS p, value_white::DOUBLE AS a FROM p WHERE value_white IS NOT NULL),
    f AS (SELECT category, sqrt(avg((p - a) * (p - a))) AS rmse, stddev_pop(a) AS floor FROM v GROUP BY 1)
    SELECT category, round(1 - pow(rmse / nullif(floor, 0), 2), 8) AS r2 FROM f""")
def r_squared_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R squared of the material guess against the mean of each category."""
    d = _balanced(spark, sf_dir).select(refs.label_category(F.col("time_control")).alias("category"), F.tanh(F.col("balance") / 4.0).alias("p"), F.col("value_white").cast("double").alias("a")).filter("a is not null")
    f = d.groupBy("category").agg(metrics.rmse(F.col("p"), F.col("a")).alias("rmse"), F.nullif(F.stddev_pop("a"), F.lit(0.0)).alias("floor"))
    return f.select("category", F.round(metrics.r_squared(F.col("rmse"), F.col("floor")), 8).alias("r2"))


@query(f"WITH p AS ({_SHOWN}) SELECT round(avg((abs(balance / 10.0) <= 1)::INT), 9) AS within, round(min(balance / 10.0::DOUBLE), 9) AS least, round(max(balance / 10.0::DOUBLE), 9) AS largest FROM p")
def output_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an unbounded guess lies within the range of values."""
    got = metrics.coverage(_balanced(spark, sf_dir).withColumn("guess", F.col("balance") / F.lit(10.0)), "guess")
    return got.select(*[F.round(c, 9).alias(c) for c in ("within", "least", "largest")])


@query(f"""WITH p AS ({_SHOWN}), m AS (SELECT src_dump, sqrt(avg(pow(tanh(balance / 4.0::DOUBLE) - value_white::DOUBLE, 2))) AS e, avg(white_elo) AS s FROM p WHERE value_white IS NOT NULL GROUP BY 1),
    r AS (SELECT rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS re, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs FROM m WHERE e IS NOT NULL AND s IS NOT NULL),
    c AS (SELECT count(*) AS models, CASE WHEN stddev_pop(re) > 0 AND stddev_pop(rs) > 0 THEN corr(re, rs) END AS rho FROM r)
    SELECT models, round(rho, 8) AS rho, CASE WHEN rho <= -0.8 THEN 'follows' WHEN rho <= -0.3 THEN 'partly' WHEN rho IS NOT NULL THEN 'does not' END AS verdict FROM c""")
def error_against_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the error on a dump falls with the strength of its players, by rank correlation."""
    b = _balanced(spark, sf_dir).filter("value_white is not null")
    m = b.groupBy("src_dump").agg(metrics.rmse(F.tanh(F.col("balance") / 4.0), F.col("value_white").cast("double")).alias("e"), F.avg("white_elo").alias("s"))
    return metrics.rank_agreement(m, "e", "s").withColumn("rho", F.round("rho", 8))


_EPOCHS = """WITH e AS (SELECT coalesce(src_dump, 'none') AS run_name, (ply // 20)::INT AS epoch, avg(abs(value_stm::DOUBLE)) AS train_loss, round(sqrt(avg(pow(value_white::DOUBLE, 2))), 3) AS val_rmse
    FROM positions WHERE ply >= 0 AND NOT coalesce(isnan(value_stm), false) AND NOT coalesce(isnan(value_white), false) GROUP BY 1, 2)"""


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the shape of training histories, written as JSON files of runs and read again."""
    p = _t(spark, sf_dir, "positions").filter("ply >= 0 and not isnan(value_stm) and not isnan(value_white)")
    e = p.groupBy(F.coalesce("src_dump", F.lit("none")).alias("run_name"), F.floor(F.col("ply") / 20).cast("int").alias("epoch")).agg(
        F.avg(F.abs(F.col("value_stm").cast("double"))).alias("train_loss"), F.round(F.sqrt(F.avg(F.pow(F.col("value_white").cast("double"), F.lit(2.0)))), 3).alias("val_rmse")
    )
    runs = e.groupBy("run_name").agg(F.array_sort(F.collect_list(F.struct("epoch", "train_loss", "val_rmse"))).alias("epochs"))
    path = session.new_path(spark, "histories")
    runs.select(F.to_json(F.struct("run_name", "epochs")).alias("value"), "run_name").repartition("run_name").write.partitionBy("run_name").text(path)
    return learn.histories(spark, f"{path}/*")


@query(f"{_EPOCHS} SELECT run_name, arg_min(epoch, val_rmse * 1e6 + epoch) AS epoch, min(val_rmse) AS val_rmse FROM e GROUP BY 1")
def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's epoch of least validation error, the first of equals."""
    return learn.best_epochs(_epochs(spark, sf_dir))


@query(f"""{_EPOCHS}, l AS (SELECT run_name, arg_max(epoch, epoch) AS epoch, arg_max(train_loss, epoch) AS train_loss, arg_max(val_rmse, epoch) AS val_rmse FROM e GROUP BY 1),
    r AS (SELECT *, pow(val_rmse, 2) / nullif(train_loss, 0) AS ratio FROM l)
    SELECT run_name, epoch, round(ratio, 8) AS ratio, CASE WHEN ratio < 1.4 THEN 'fits' WHEN ratio < 2.5 THEN 'overfits somewhat' WHEN ratio IS NOT NULL THEN 'overfits' END AS verdict FROM r""")
def run_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.diagnosis(_epochs(spark, sf_dir)).select("run_name", "epoch", F.round("ratio", 8).alias("ratio"), "verdict")


@query(f"{_EPOCHS} SELECT run_name, epoch, round(pow(val_rmse, 2) / nullif(train_loss, 0), 8) AS ratio FROM e")
def overfit_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared validation error over training loss at every epoch."""
    return learn.overfit_ratios(_epochs(spark, sf_dir)).select("run_name", "epoch", F.round("ratio", 8).alias("ratio"))


@query("""WITH v AS (SELECT k AS volume, round(sqrt(avg(pow(value_white::DOUBLE, 2))), 9) AS rmse FROM positions, (SELECT unnest([12, 24, 48, 96]) AS k) WHERE ply < k AND NOT coalesce(isnan(value_white), false) GROUP BY 1)
    SELECT volume, rmse, round(rmse / lag(rmse) OVER (ORDER BY volume) - 1, 7) AS improvement FROM v""")
def scaling_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of an error from one volume to the next."""
    p = _t(spark, sf_dir, "positions").filter("not isnan(value_white)").withColumn("volume", F.explode(F.array(*[F.lit(k) for k in (12, 24, 48, 96)]))).filter("ply < volume")
    v = p.groupBy("volume").agg(F.round(F.sqrt(F.avg(F.pow(F.col("value_white").cast("double"), F.lit(2.0)))), 9).alias("rmse"))
    return learn.scaling(v).withColumn("improvement", F.round("improvement", 7))


_MOVES = "WITH m AS (SELECT turn_white, abs(cp_white - cp_stm)::DOUBLE AS loss_cp, cp_white = cp_stm AS agrees FROM positions WHERE cp_white IS NOT NULL AND cp_stm IS NOT NULL)"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "positions").filter("cp_white is not null and cp_stm is not null")
    return p.select("turn_white", F.abs(F.col("cp_white") - F.col("cp_stm")).cast("double").alias("loss_cp"), (F.col("cp_white") == F.col("cp_stm")).alias("agrees"))


@query(f"""{_MOVES} SELECT turn_white, count(*) AS n, round(avg(loss_cp), 6) AS acpl, round(stddev_samp(loss_cp) / sqrt(count(*)), 6) AS acpl_se, round(avg(agrees::INT), 9) AS agreement,
    round(avg((loss_cp > 300)::INT), 9) AS blunder_rate, quantile_cont(loss_cp, 0.5) AS median_loss FROM m GROUP BY 1""")
def move_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median loss, agreement and blunders, by side to move (a null side is a group)."""
    got = match.move_quality(_moves(spark, sf_dir), ["turn_white"])
    return got.withColumns({"acpl": F.round("acpl", 6), "acpl_se": F.round("acpl_se", 6), "agreement": F.round("agreement", 9), "blunder_rate": F.round("blunder_rate", 9)})


@query("""SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, max(value) AS longest, 5000 / quantile_cont(value, 0.99) AS headroom FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 99th percentile and longest of measured values, by kind."""
    return match.latency(_t(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms")), ["event_type"])


@query("""WITH t AS (SELECT event_type AS model, (user_id % 3 + 1) * 512 AS batch, value AS seconds FROM events WHERE value > 0),
    s AS (SELECT model, batch, sum(batch) / sum(seconds) AS r FROM t GROUP BY 1, 2)
    SELECT model, batch, round(r, 6) AS positions_per_second, r = max(r) OVER (PARTITION BY model) AS best FROM s""")
def batch_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions a second of each model and batch size, and which batch size is best."""
    t = _t(spark, sf_dir, "events").select(F.col("event_type").alias("model"), ((F.pmod("user_id", F.lit(3)) + 1) * 512).alias("batch"), F.col("value").alias("seconds"))
    return metrics.throughput(t).withColumn("positions_per_second", F.round("positions_per_second", 6))


# Reports as text --------------------------------------------------------------------------------------------------


@query(f"""{_GAMES}, s AS (SELECT opponent_elo, count(*) AS n, count(*) FILTER (WHERE score = 1) AS w, count(*) FILTER (WHERE score = 0.5) AS d, count(*) FILTER (WHERE score = 0) AS l, avg(score) AS r,
        stddev_samp(score) / sqrt(count(*)) AS e, count(*) FILTER (WHERE termination IN ('max_plies', 'interrupted')) AS u FROM m GROUP BY 1)
    SELECT opponent_elo, printf('%d games: +%d =%d -%d (%.1f %% / %.1f %% / %.1f %%), rate %.3f', n, w, d, l, 100 * w / n::DOUBLE, 100 * d / n::DOUBLE, 100 * l / n::DOUBLE, r) || coalesce(printf(' +- %.3f', e), '')
        || ', Elo ' || CASE WHEN r >= 1 THEN '+inf' WHEN r <= 0 THEN '-inf' ELSE printf('%+.0f', 400 * log10(r / (1 - r))) END || CASE WHEN u > 0 THEN printf(', %d unfinished', u) ELSE '' END AS summary FROM s""")
def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_text(match.match_stats(_match(spark, sf_dir), ["opponent_elo"]), ["opponent_elo"])


@query(f"""{_MOVES}, q AS (SELECT turn_white, count(*) AS n, avg(loss_cp) AS a, coalesce(stddev_samp(loss_cp) / sqrt(count(*)), 0) AS e, quantile_cont(loss_cp, 0.5) AS h, avg(agrees::INT) AS g, avg((loss_cp > 300)::INT) AS b FROM m GROUP BY 1)
    SELECT turn_white, printf('ACPL %.1f +- %.1f (median %.1f), agreement %.1f %%, blunders %.1f %%, n %d', a, e, h, 100 * g, 100 * b, n) AS summary FROM q""")
def quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.quality_text(match.move_quality(_moves(spark, sf_dir), ["turn_white"]), ["turn_white"])


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE fen IS NOT NULL) AS texts, count(DISTINCT src_dump) AS dumps FROM positions""")
def dataset_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count("fen").alias("texts"), F.count_distinct("src_dump").alias("dumps"))
