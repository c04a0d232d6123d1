"""What a linkage does not do twice or in vain, and that its shorter ways give what the longer ones gave."""

import glob
import random

import pyarrow.parquet as pq
from compare import DATA, needs_data
from pyspark.sql import functions as F

from plyforge import session
from plyforge.functions import keys, position
from plyforge.functions.position import usual_text
from plyforge.llm import linkage, tables

FENS = ["r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1", "r3k2r/8/8/8/8/8/8/R3K2R_b_HAha_e3", "4k3/8/8/8/8/8/8/11111R1K w - -", "4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 1"]


def test_squares_and_rights_are_those_of_the_long_way():
    dots = str.maketrans({str(n): "." * n for n in range(1, 9)})
    coin = random.Random(3)
    texts = ["".join(coin.choices("pnbrqkPNBRQK0123456789/.x٣", k=coin.randrange(80))) for _ in range(2000)]
    assert all(position.squares(t) == t.translate(dots) for t in texts)
    assert [usual_text(t) for t in FENS] == [
        "r3k2r/8/8/8/8/8/8/R3K2R w KQkq -", "r3k2r/8/8/8/8/8/8/R3K2R b KQkq -", "4k3/8/8/8/8/8/8/5R1K w - -", "4k3/8/8/3pP3/8/8/8/4K3 w - d6",
    ]
    # the same rights with other squares at home, after they were kept once
    assert usual_text("r3k3/8/8/8/8/8/8/R3K2R w KQkq -") == "r3k3/8/8/8/8/8/8/R3K2R w KQq -"
    for text in FENS:
        placement, grid, state = position.usual_parts(text)
        assert f"{placement} {state}" == usual_text(text) and grid == placement.translate(dots)


def test_what_records_show(spark):
    """With and without squares, for positions, damaged boards, other texts and none."""
    damaged = "4k3/8/8/8/8/8/8/4K2x W KQ e3 0 1"
    rows = spark.createDataFrame([(0, FENS[1]), (1, damaged), (2, "no position"), (3, None)], "rec_id bigint, fen string")
    grid = "r...k..r/" + "......../" * 6 + "R...K..R"
    for near in (True, False):
        got = linkage.records(rows, F.lit(7).cast("bigint"), F.lit(1), near=near).orderBy("rec_id")
        assert got.schema.simpleString() == spark.createDataFrame([], linkage.RECORD).schema.simpleString()
        place = keys.digest64(usual_text(FENS[1]).split(" ")[0])
        none = (None, None, None)
        assert [tuple(r) for r in got.collect()] == [
            (0, 1, keys.digest64(usual_text(FENS[1])), place, grid if near else None, "b KQkq -", *none),
            (1, 1, keys.digest64("4k3/8/8/8/8/8/8/4K2x W KQ e3"), None, *(("....k.../" + "......../" * 6 + "....K..x", "w KQ e3") if near else (None, None)), *none),
            (2, 1, keys.digest64("no position"), None, None, None, *none),
            (3, 1, 7, None, None, None, *none),
        ]


@needs_data
def test_references_are_read_once_a_row(spark):
    """The pattern that finds a game in a reference stands in the plan for its test and its value only, once for each table."""
    plan = tables.accepted_records(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract(game_id") <= 2
    assert 0 < plan.count("regexp_extract(src_dump") <= 2


def test_no_dictionaries_of_keys(spark):
    """Runs try dictionaries only for what has few values; a record's other columns would fill one for each block in vain."""
    path = session.new_path(spark, "linker")
    rows = spark.createDataFrame([(i, None if i < 3 else 1, t) for i, t in enumerate(FENS)], "rec_id bigint, batch_no int, fen string")
    rec = linkage.records(rows, F.lit(None).cast("bigint"), F.col("batch_no"))
    linkage.link(rec.filter("batch_no is null"), rec.filter("batch_no is not null"), path=path).found.collect()
    seen = set()
    for name in ("ident", "place", "near", "reps"):
        for file in glob.glob(f"{path.removeprefix('file:')}/{name}/run-*/part-*.parquet"):
            meta = pq.read_metadata(file)
            for k in range(meta.num_columns):
                column = meta.row_group(0).column(k)
                seen.add(column.path_in_schema)
                assert column.path_in_schema in ("state", "ply", "dump") or not any("DICTIONARY" in e for e in column.encodings), (name, column.path_in_schema)
                assert column.path_in_schema != "h" or column.statistics.has_min_max
    assert {"h", "key", "ident", "board", "state"} <= seen
