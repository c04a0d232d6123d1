"""The labelled dataset: its schema, writing and reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("game_id", T.StringType()),
        T.StructField("ply", T.ShortType()),
        T.StructField("fen", T.StringType()),
        T.StructField("pos_key", T.LongType()),
        T.StructField("turn_white", T.BooleanType()),
        T.StructField("cp_white", T.IntegerType()),
        T.StructField("cp_stm", T.IntegerType()),
        T.StructField("value_white", T.FloatType()),
        T.StructField("value_stm", T.FloatType()),
        T.StructField("is_mate", T.BooleanType()),
        T.StructField("mate_in", T.ShortType()),
        T.StructField("white_elo", T.ShortType()),
        T.StructField("black_elo", T.ShortType()),
        T.StructField("result", T.StringType()),
        T.StructField("time_control", T.StringType()),
        T.StructField("sf_depth", T.ShortType()),
        T.StructField("sf_version", T.StringType()),
        T.StructField("src_dump", T.StringType()),
    ]
)


class SchemaMismatchError(ValueError):
    """Rows do not have exactly the dataset's columns."""


def conform(df: DataFrame) -> DataFrame:
    """``df`` in the dataset's column order and types; raises where columns are missing or left over."""
    missing, extra = sorted(set(SCHEMA.names) - set(df.columns)), sorted(set(df.columns) - set(SCHEMA.names))
    if missing or extra:
        raise SchemaMismatchError(f"missing columns {missing}, unexpected columns {extra}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields])


def write(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Append rows (the dataset's columns and ``shard``) under src_dump=/shard=, replacing shards written before.

    Only the shards in ``df`` are replaced, so writing one again after a failure leaves no rows twice.
    """
    out = conform(df.drop(shard)).withColumn(shard, F.lit(None).cast("int")) if shard not in df.columns else df.select(*SCHEMA.names, shard)
    conform(out.drop(shard))
    writer = out.repartition("src_dump", shard).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd").partitionBy("src_dump", shard).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The dataset with ``shard``; an empty table of the right columns where nothing was written yet."""
    from plyforge import session

    schema = T.StructType([*SCHEMA.fields, T.StructField("shard", T.IntegerType())])
    if not session.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*schema.names)


def seen_keys(spark: SparkSession, path: str) -> DataFrame:
    """The keys already published: only this column is read."""
    return read(spark, path).select("pos_key")
