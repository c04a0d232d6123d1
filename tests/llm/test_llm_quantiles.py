import random

import pytest

from plyforge.llm import quantiles


@pytest.mark.parametrize("rows", [200, 40_000])
def test_rows_without_a_dump_are_judged_whatever_their_number(spark, rows):
    """At the larger size the bounds straddle the band, so the exact count decides."""
    coin = random.Random(rows)
    values = [coin.randrange(1_000_000) for _ in range(rows)]
    at = sorted(values)[rows // 2 - 1]
    df = spark.createDataFrame([(None, "Blitz", v) for v in values], "src_dump string, time_control string, ply int")
    bands = spark.createDataFrame([("Blitz", "ply", 50, at + 1, at + 2), ("Blitz", "ply", 90, 0, 1_000_000)], "time_control string, field string, pct int, low int, high int")
    assert [tuple(r) for r in quantiles.outside_bands(df, bands, 120).collect()] == [(None, "Blitz", "ply", 50)]
