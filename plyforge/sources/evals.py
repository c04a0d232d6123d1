"""Nested evaluation records (one JSON object a line) as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.scoring import bounded

RECORD = "struct<fen:string,evals:array<struct<depth:int,pvs:array<struct<cp:int,mate:int>>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(value, record): ``record`` is null where a line is not readable."""
    return parse(spark.read.text(path))


def parse(lines: DataFrame) -> DataFrame:
    """(value, record) from a column ``value`` of JSON text; lines of another shape have no record."""
    record = F.from_json("value", RECORD)
    return lines.select("value", F.when(record["fen"].isNotNull() & record["evals"].isNotNull(), record).alias("record"))


def deepest(evals: Column) -> Column:
    """The evaluation of the greatest depth, the first of equals; a missing depth counts as 0."""
    none = F.lit(None).cast("struct<depth:int,pvs:array<struct<cp:int,mate:int>>>")
    depth = lambda e: F.coalesce(e["depth"], F.lit(0))
    return F.aggregate(evals, none, lambda best, e: F.when(best.isNull() | (depth(e) > depth(best)), e).otherwise(best))


def flat(records: DataFrame, least_depth: int = 12) -> DataFrame:
    """(fen, cp, mate, depth) of each record's deepest evaluation of at least ``least_depth`` that has a score."""
    best = records.filter("record is not null").select("record.fen", deepest(F.col("record.evals")).alias("best"))
    line = F.get("best.pvs", F.lit(0))
    out = best.select("fen", line["cp"].alias("cp"), line["mate"].cast("tinyint").alias("mate"), F.coalesce("best.depth", F.lit(0)).alias("depth"))
    return out.filter((F.col("depth") >= least_depth) & (F.col("cp").isNotNull() | F.col("mate").isNotNull()))


def quality(records: DataFrame) -> DataFrame:
    """One row: lines, unreadable ones, and bytes."""
    return records.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("record").isNull()).alias("unreadable"), F.sum(F.octet_length("value")).alias("bytes"))


def target(cp: Column, mate: Column, turn_white: Column, clip: int = 2000, scale: float = 400.0) -> Column:
    """Side to move's bounded value of a White-view score."""
    white = F.when(mate.isNotNull(), F.signum(mate.cast("double")) * clip).otherwise(bounded(cp, clip))
    return F.tanh(F.when(turn_white, white).otherwise(-white) / F.lit(scale))


def frequencies(records: DataFrame) -> DataFrame:
    """(what, value, n): how often each depth, number of evaluations, number of lines and number of fields occurs, in one pass."""
    best = deepest(F.col("record.evals"))
    parts = {
        "depth": best["depth"], "evals": F.size("record.evals"), "lines": F.size(best["pvs"]), "fields": F.size(F.split("record.fen", " ")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in parts.items()])
    return records.filter("record is not null").select(F.inline(rows)).groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


def looks_like_evals(spark: SparkSession, line: str) -> bool:
    """Whether a line of JSON has the shape of an evaluation record."""
    return parse(spark.createDataFrame([(line,)], "value string")).filter("record is not null").count() == 1


def write(flat_rows: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    flat_rows.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def projection(quality_row: DataFrame, accepted: DataFrame, targets: list[int]) -> DataFrame:
    """(target, lines, bytes): what must be read for each target number of rows, at the yield of what was read."""
    yields = quality_row.withColumn("accepted", F.lit(accepted.count()).cast("double"))
    per = F.explode(F.array(*[F.lit(t).cast("bigint") for t in targets])).alias("target")
    t = yields.select(per, "lines", "bytes", "accepted")
    need = F.try_divide(F.col("target"), F.col("accepted"))
    return t.select("target", F.ceil(need * F.col("lines")).alias("lines"), F.ceil(need * F.col("bytes")).alias("bytes"))
