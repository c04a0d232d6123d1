"""The build as a stream: new extracts of games become new shards, each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plyforge.config import DatasetConfig
from plyforge.operators import label
from plyforge.plans.build import Labeler, pending
from plyforge.sources import shards


def stream_build(spark: SparkSession, cfg: DatasetConfig, schema, dump: str, labeler: Labeler, version: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Process the extract files that no batch has seen and stop; the checkpoint remembers which.

    A batch writes the partition shard = batch id and overwrites it if it runs again, so a failure between writing and
    committing leaves no rows twice. New keys are looked up among the shards of other batches, not kept as state.
    """

    def take(games: DataFrame, batch: int) -> None:
        out = cfg.output.local_dir
        seen = shards.read(games.sparkSession, out).filter(F.col("shard") != batch).select("pos_key")
        rows = pending(games, cfg, seen)
        full = label.attach(rows, labeler(rows.select("fen")), cfg.normalization).withColumns(
            {"sf_depth": F.lit(cfg.labeling.depth).cast("smallint"), "sf_version": F.lit(version), "src_dump": F.lit(dump), "shard": F.lit(batch).cast("int")}
        )
        shards.write(full, out)

    extracts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(cfg.output.extract_dir)
    return extracts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_positions(stream: DataFrame, key: str = "pos_key") -> DataFrame:
    """A stream without repeated keys. The state grows with the number of keys; for bounded state use the batch join."""
    return stream.dropDuplicates([key])
