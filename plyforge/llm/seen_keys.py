"""Has this key been seen before?

Keys go into a log-structured store of sorted runs (``runs``): hashes in levelled immutable files with block fences,
probed by merge join, compacted periodically; every hit is verified by the full key. So a hit is never wrong by a
hash; the rate at which hashes alone would have been wrong is measured on the way.

Nulls: a null key is never seen and never stored. Empty inputs give empty results. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge import session
from plyforge.llm.runs import Rounds, RunStore, rounds
from plyforge.operators.skew import hot_join

PROBED = "key bigint, first bigint, n bigint, hit boolean, found boolean"


@dataclass
class Seen:
    hits: DataFrame  # rec_id
    probed: DataFrame  # key, first, n, hit, found: each round's distinct keys


def find_seen(history: DataFrame | None, batches: DataFrame, flush_batches: int = 4, rows_per_file: int = 2_000_000, path: str | None = None) -> Seen:
    """Which rows of ``batches`` (rec_id, batch_no, key) have a key of ``history`` (key) or of a row of smaller rec_id.

    ``flush_batches`` batches are gathered before their new keys are flushed as a run (equal keys among them are
    told apart by rec_id). ``path`` names a store to go on with; its keys count as history, and ``history`` (which may
    be None then) is added to them.
    """
    spark = batches.sparkSession
    batches = session.cut(batches.select("rec_id", "batch_no", "key").filter("key is not null"), "seen-batches")
    store = RunStore.open(spark, path or session.new_path(spark, "seen-store"), rows_per_file=rows_per_file)
    if history is not None:
        old = session.cut(history.select("key").filter("key is not null").distinct(), "seen-history")
        store.flush(old, level=1)
        session.release(old)
    results = Rounds(spark, session.new_path(spark, "seen-rounds"), PROBED)
    for low, high in rounds(batches, flush_batches):
        distinct = batches.filter(F.col("rec_id").between(low, high)).groupBy("key").agg(F.min("rec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        result = results.add(store.probe(distinct))
        store.flush(result.filter("not found").select("key"))
    probed = results.read()
    # the round of a key's first row tells whether history has it; later rounds find it in the store anyhow
    known = probed.groupBy("key").agg(F.min("first").alias("first"), F.min_by("found", "first").alias("before"), F.sum("n").alias("n"))
    known = known.filter("before or n > 1")
    hits = hot_join(batches.select("rec_id", "key"), known, "key", "n", batches.count()).filter("before or rec_id > first").select("rec_id")
    return Seen(hits, probed)


def wrong_rates(seen: Seen) -> DataFrame:
    """One row: distinct keys probed, hash hits, hits the full key refuted, and the rates of wrong answers.

    ``hash_wrong_rate`` is the measured share of unseen keys that a hash alone would have called seen;
    ``wrong_rate`` that of the answers given, zero since every hit was verified and every miss is certain.
    """
    agg = seen.probed.agg(
        F.count(F.lit(1)).alias("probed"),
        F.count_if("hit").alias("hash_hits"),
        F.count_if(F.col("hit") & ~F.col("found")).alias("refuted"),
        F.count_if(~F.col("found")).alias("unseen"),
    )
    rate = F.coalesce(F.try_divide(F.col("refuted").cast("double"), F.col("unseen")), F.lit(0.0))
    return agg.withColumn("hash_wrong_rate", rate).withColumn("wrong_rate", F.lit(0.0))
