"""The project's tables as the operators of this package take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge import session
from plyforge.functions import board, keys, refs
from plyforge.llm import bpe, linkage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_digest(df: DataFrame, key: str = "key", text: str = "_text") -> DataFrame:
    """Fill null ``key`` by the digest of ``text``; only rows that need it leave the JVM. ``text`` is dropped."""
    have = df.filter(F.col(key).isNotNull() | F.col(text).isNull()).drop(text)
    lack = df.filter(F.col(key).isNull() & F.col(text).isNotNull())
    return have.unionByName(lack.withColumn(key, keys.digest(text)).drop(text))


def accepted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, key of openings and positions."""
    rows = None
    for name in ("openings", "positions"):
        t = read(spark, sf_dir, name).select("rec_id", F.col("pos_key").alias("key"), keys.first_four_as_written(F.col("fen")).alias("_text"))
        rows = t if rows is None else rows.unionByName(t)
    return with_digest(rows)


def arriving_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, batch_no, key of arrivals."""
    t = read(spark, sf_dir, "arrivals")
    return with_digest(
        t.select("rec_id", "batch_no", keys.parse_key(F.col("pos_key")).alias("key"), keys.first_four_as_written(F.col("fen")).alias("_text"))
    )


def game_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, other): the games whose header says they are copies."""
    g = read(spark, sf_dir, "games").select(refs.game_ref(F.col("site")).alias("id"), refs.game_ref(F.col("copy_of")).alias("other"))
    return g.filter("id is not null and other is not null")


def game_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "games").select(refs.game_ref(F.col("site")).alias("id"))


def split_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "split_log")
    return t.select("seed", refs.game_ref(F.col("game_id")).alias("id"), refs.split_name(F.col("split")).alias("split"))


def accepted_records(spark: SparkSession, sf_dir: str, near: bool = True) -> DataFrame:
    """openings and positions as ``linkage.RECORD``."""
    book = read(spark, sf_dir, "openings").select("rec_id", "fen", "pos_key", F.lit(None).cast("string").alias("game_id"), "ply", F.lit(None).cast("string").alias("src_dump"))
    both = book.unionByName(read(spark, sf_dir, "positions").select("rec_id", "fen", "pos_key", "game_id", "ply", "src_dump"))
    return linkage.records(both, F.col("pos_key"), F.lit(None), *_origin(), near=near)


def arriving_records(spark: SparkSession, sf_dir: str, near: bool = True) -> DataFrame:
    t = read(spark, sf_dir, "arrivals").select("rec_id", "batch_no", "fen", "pos_key", "game_id", "ply", "src_dump")
    return linkage.records(t, keys.parse_key(F.col("pos_key")), F.col("batch_no"), *_origin(), near=near)


def _origin() -> tuple:
    """Game, ply and dump as ``linkage.records`` takes them."""
    return refs.game_ref(F.col("game_id")), F.col("ply"), refs.dump_name(F.col("src_dump"))


def sampling_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id and signature of positions; the side to move is read from the position where the column is null."""
    t = read(spark, sf_dir, "positions")
    turn = F.coalesce("turn_white", F.when(F.col("turn_white").isNull(), board.side_to_move(F.col("fen"))))
    return t.select("rec_id", "src_dump", refs.label_category(F.col("time_control")).alias("time_control"), turn.alias("turn_white"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_dump, time_control, cp_white, ply of positions, null where the value does not count."""
    t = read(spark, sf_dir, "positions")
    return t.select(
        "src_dump",
        refs.label_category(F.col("time_control")).alias("time_control"),
        F.when(F.col("cp_white").between(-2000, 2000), F.col("cp_white")).alias("cp_white"),
        F.when(F.col("ply") >= 0, F.col("ply")).alias("ply"),
    )


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, src_dump, source, tokens of documents, cut so that the texts are encoded once."""
    t = read(spark, sf_dir, "documents").withColumn("source", refs.source_name(F.col("source")))
    return session.cut(bpe.count_tokens(t, ["doc_id", "src_dump", "source"]), "sized")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "mix_targets")
    return t.select("target_id", "mix_id", "src_dump", refs.source_name(F.col("source_name")).alias("source"), "target_weight", "max_uses", "budget_tokens")
