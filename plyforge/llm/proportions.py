"""Sample matching target category proportions, by swap repair on signature counts.

Rows of a pool are grouped by category signature; only counts leave the rows. For each plan: start from a random
sample that satisfies the floors (above them counts are drawn in proportion to what is left), exchange counts between signatures
while that lowers the deviation from the targets, then materialise by taking that many rows of each signature at
random (smallest seeded hashes). Strata that cannot reach their target or floor are reported.

Nulls: a row with a null category, or null pool, is counted in no stratum; a null floor or share is zero; a stratum
without a matching pool row has none available. If a plan's floors exceed its sample they are cut in proportion, and
that is reported too. Ties are broken by the hash and then by the row's id, so rows that occur twice both count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.operators.skew import bucket_count

SIGNATURE = ["src_dump", "time_control", "turn_white"]
#: Largest plan table that is broadcast to the rows; above it the join is an ordinary one.
PLAN_ROWS = 100_000


def repair(available: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Counts to draw of each signature: random start above the floors, then exchanges until none improves."""
    size = int(min(size, available.sum()))
    floor = np.minimum(floor, available).astype(np.int64)
    if floor.sum() > size:
        exact = floor * (size / floor.sum())
        cut = np.floor(exact).astype(np.int64)
        for k in np.argsort(-(exact - cut), kind="stable")[: size - cut.sum()]:
            cut[k] += 1
        floor = cut
    x = floor.copy()
    while (left := size - x.sum()) > 0:  # what a signature cannot give is drawn again from the others
        room = available - x
        x += np.minimum(rng.multinomial(left, room / room.sum()), room)
    total = share.sum()
    want = share * (size / total) if total > 0 else x.astype(float)
    while True:
        over = np.where(x > floor, x - want, -np.inf)
        under = np.where(x < available, want - x, -np.inf)
        i, j = int(np.argmax(over)), int(np.argmax(under))
        # moving k from i to j changes the squared deviation by 2k(k - (over_i + under_j)): best near half the sum
        gain = over[i] + under[j]
        if i == j or not np.isfinite(gain) or gain <= 1:
            return x
        k = int(min(max(1, gain // 2), x[i] - floor[i], available[j] - x[j]))
        x[i] -= k
        x[j] += k


def _repair_plan(strata: pd.DataFrame) -> pd.DataFrame:
    strata = strata.sort_values("stratum_id", kind="stable").reset_index(drop=True)
    size = int(strata["sample_rows"].fillna(0).max())
    rng = np.random.default_rng([abs(int(strata["plan_id"].iloc[0])), size])
    available = strata["available"].fillna(0).to_numpy(np.int64)
    strata["take"] = repair(available, strata["target_share"].fillna(0.0).to_numpy(float), strata["min_rows"].fillna(0).to_numpy(np.int64), size, rng)
    return strata[["stratum_id", "take"]]


def report(pool: DataFrame, plans: DataFrame) -> DataFrame:
    """Every stratum of ``plans`` with available, take (rows to draw), actual_share, wanted, and whether it is met.

    ``pool`` has the signature columns and rec_id. ``wanted`` is the greater of floor and share x sample; ``short``
    says that the pool cannot give it, ``floor_met`` and ``deviation`` what the sample does.
    """
    counts = pool.dropna(subset=SIGNATURE).groupBy(*SIGNATURE).agg(F.count(F.lit(1)).alias("available"))
    strata = plans.select("stratum_id", "plan_id", *SIGNATURE, "target_share", "min_rows", "sample_rows").join(counts, SIGNATURE, "left")
    strata = strata.withColumn("available", F.coalesce("available", F.lit(0)))
    taken = strata.groupBy("plan_id").applyInPandas(_repair_plan, "stratum_id bigint, take bigint")
    wanted = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("double"), F.coalesce("target_share", F.lit(0.0)) * F.col("sample_rows"))
    size = F.greatest(F.sum("take").over(Window.partitionBy("plan_id")), F.lit(1))
    return (
        strata.join(taken, "stratum_id")
        .withColumn("wanted", wanted)
        .withColumn("short", F.col("wanted") > F.col("available"))
        .withColumn("actual_share", F.col("take") / size)
        .withColumn("deviation", F.col("take") / size - F.coalesce("target_share", F.lit(0.0)))
        .withColumn("floor_met", F.col("take") >= F.coalesce("min_rows", F.lit(0)))
    )


def draw(pool: DataFrame, strata: DataFrame, seed: int = 20260911) -> DataFrame:
    """(plan_id, stratum_id, rec_id): ``take`` random rows of each stratum of ``report``.

    A row's hash puts it into one of the slots of its stratum (about 100,000 rows at most in each); slots are taken whole up to the one in which the
    quota ends, and only that one is ranked, so no task sees more than a slot of a stratum.
    """
    quota = strata.filter("take > 0").select("plan_id", "stratum_id", *SIGNATURE, "take")
    fine = bucket_count(strata.agg(F.coalesce(F.max("available"), F.lit(0))).first()[0], least=1024)
    few = quota.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS
    rows = pool.select("rec_id", *SIGNATURE).dropna(subset=SIGNATURE).join(F.broadcast(quota) if few else quota, SIGNATURE)
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "stratum_id", "rec_id")).withColumn("_slot", F.pmod("_h", F.lit(fine)))
    slots = rows.groupBy("stratum_id", "take", "_slot").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("stratum_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("_left", F.col("take") - F.coalesce(before, F.lit(0))).filter("_left > 0")
    kept = rows.join(slots.select("stratum_id", "_slot", "_size", "_left"), ["stratum_id", "_slot"])
    whole = kept.filter("_size <= _left").select("plan_id", "stratum_id", "rec_id")
    rank = F.row_number().over(Window.partitionBy("stratum_id").orderBy("_h", "rec_id"))
    part = kept.filter("_size > _left").withColumn("_rank", rank).filter("_rank <= _left").select("plan_id", "stratum_id", "rec_id")
    return whole.unionByName(part)
