"""Mixing sources to target weights by systematic sampling.

For each source of a mix, every document is expected the same number of times r: what the source's share of the budget
needs over the tokens its documents have, at most the cap. Documents stand in the order of their tokens, those of one
size in a random order; the expected copies are summed along it from a random offset, and a document is emitted once for
each whole number its sum crosses. So it is used floor(r) or ceil(r) times, never more than the cap. The sizes being in
order, what a crossing takes too much the next takes too little: a source's tokens miss r times its tokens by less than
its largest document, whatever the sizes and the offset.

The order is a distributed numbering (``placed_by_value``): no source and no size is gathered in one task, however large.

Nulls: a null or empty text has no tokens and is never used; a null source or pool matches no target; a null weight or
budget is zero, a null cap one. Repeated documents are documents of their own, each with its own cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.operators.skew import placed_by_value

POOL = ["src_dump", "source"]
#: Largest table of targets that is broadcast to the documents.
TARGET_ROWS = 100_000


def plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with wanted (tokens), available (tokens of its documents), largest (of one), rate (copies of each) and short.

    ``docs`` has doc_id, src_dump, source, tokens; ``targets`` has target_id, mix_id, src_dump, source, target_weight,
    max_uses, budget_tokens. ``short`` says that wanted exceeds the cap times available.
    """
    have = docs.groupBy(*POOL).agg(F.sum("tokens").alias("available"), F.max("tokens").alias("largest"))
    names = ["target_id", "mix_id", *POOL, "target_weight", "max_uses", "budget_tokens"]
    t = targets.select(names).join(have, POOL, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("available", "largest")})
    weight = F.coalesce("target_weight", F.lit(0.0))
    whole = F.sum(weight).over(Window.partitionBy("mix_id"))
    wanted = F.coalesce(F.try_divide(weight, whole) * F.coalesce("budget_tokens", F.lit(0)), F.lit(0.0))
    cap = F.coalesce("max_uses", F.lit(1))
    return (
        t.withColumn("wanted", wanted)
        .withColumn("short", F.col("wanted") > cap * F.col("available"))
        .withColumn("rate", F.least(cap.cast("double"), F.coalesce(F.try_divide(F.col("wanted"), F.col("available")), F.lit(0.0))))
    )


def draw(docs: DataFrame, planned: DataFrame, seed: int = 20260911) -> DataFrame:
    """(mix_id, target_id, doc_id, tokens, copies): how often each document is used in each mix, where it is."""
    used = docs.select("doc_id", *POOL, "tokens").filter("tokens > 0 and src_dump is not null and source is not null")
    salted = used.withColumn("_salt", F.xxhash64(F.lit(seed), "doc_id"))
    placed = placed_by_value(salted, POOL, "tokens", F.col("_salt"), [F.col("doc_id")]).drop("_salt")
    quota = planned.filter("rate > 0").select("mix_id", "target_id", *POOL, "rate")
    offset = F.pmod(F.xxhash64(F.lit(seed), "target_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    quota = quota.withColumn("_offset", offset)
    few = quota.limit(TARGET_ROWS + 1).count() <= TARGET_ROWS
    rows = placed.join(F.broadcast(quota) if few else quota, POOL)
    upto = F.floor(F.col("_offset") + (F.col("place") + 1) * F.col("rate"))
    copies = upto - F.floor(F.col("_offset") + F.col("place") * F.col("rate"))
    return rows.select("mix_id", "target_id", "doc_id", "tokens", copies.alias("copies")).filter("copies > 0")


def emitted(drawn: DataFrame) -> DataFrame:
    """One row (mix_id, target_id, doc_id, copy) for each use of a document."""
    return drawn.select("mix_id", "target_id", "doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))


def report(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """The plan with used (tokens drawn), actual_share and target_share of each source in its mix.

    ``exhausted`` says that all documents were used as often as they may be and yet gave less than wanted; ``met`` that
    the tokens drawn miss what was wanted, or what the cap leaves of it, by less than the largest document.
    """
    used = drawn.groupBy("target_id").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_uses"))
    mix, cap = Window.partitionBy("mix_id"), F.coalesce("max_uses", F.lit(1))
    return (
        planned.join(used, "target_id", "left")
        .withColumn("used", F.coalesce("used", F.lit(0)))
        .withColumn("most_uses", F.coalesce("most_uses", F.lit(0)))
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("used").cast("double"), F.sum("used").over(mix)), F.lit(0.0)))
        .withColumn("target_share", F.coalesce(F.try_divide(F.col("wanted"), F.sum("wanted").over(mix)), F.lit(0.0)))
        .withColumn("exhausted", (F.col("used") >= cap * F.col("available")) & (F.col("used") < F.col("wanted")))
        .withColumn("met", F.abs(F.col("used") - F.least(F.col("wanted"), cap * F.col("available"))) <= F.col("largest"))
    )
