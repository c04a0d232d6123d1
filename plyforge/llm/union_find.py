"""Connected components by distributed union-find.

Every partition first builds a forest of its own edges, so that what is shuffled is at most one edge per node and
partition. The forests are then merged level by level: a node that has several roots ties them together (hooking) and
every node takes its root's root (pointer jumping), again with a local forest in each partition. Each level is written
to the shared folder. A root with a third of all nodes below it is joined where its nodes lie (``hot_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge import session
from plyforge.operators.skew import hot_join

#: Edges a task holds in its forest before it hands the forest on and begins another: bounds its memory.
FOREST_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}
    kind = None

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def emit() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kind), pa.array([r for _, r in pairs], kind)], names=["node", "root"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if x is None or y is None or x == y:
                continue
            a, b = find(x), find(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(x, min(a, b))
        if len(parent) > FOREST_EDGES:
            yield emit()
    if parent:
        yield emit()


def local_forests(edges: DataFrame) -> DataFrame:
    """(node, root) with root < node: each partition's edges (its first two columns) as a forest of stars."""
    kind = edges.schema.fields[0].dataType.simpleString()
    return edges.mapInArrow(_forest, f"node {kind}, root {kind}")


def components(edges: DataFrame, max_levels: int = 60) -> DataFrame:
    """(node, root) for every node of an edge but the roots; root is the component's smallest node.

    ``edges`` has two columns of one type. Nulls, loops and repeated edges tie nothing. Strings compare by code point.
    """
    forest = session.cut(local_forests(edges).distinct(), "forest")
    if forest.count() <= FOREST_EDGES // 2:  # no more nodes than a task holds: the last level is one forest
        return session.cut(local_forests(forest.coalesce(1)), "forest", replaces=forest)
    for _ in range(max_levels):
        best = session.cut(forest.groupBy("node").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("n")), "forest-best")
        size = best.count()
        load = best.groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("below"))
        ups = best.select("node", F.col("root").alias("up")).join(load, "node")  # roots that have a root themselves
        many = best.filter("n > 1").select("node", F.col("root").alias("least"))
        moved = ups.limit(1).count() + many.limit(1).count()
        if not moved:
            return best.select("node", "root")
        hooks = local_forests(forest.join(many, "node").filter("root != least").select("root", "least"))
        below = best.select(F.col("node").alias("child"), F.col("root").alias("node"))
        jumped = hot_join(below, ups, "node", "below", size).select(F.col("child").alias("node"), F.col("up").alias("root"))
        still = below.join(ups.select("node"), "node", "left_anti").select(F.col("child").alias("node"), F.col("node").alias("root"))
        forest = session.cut(jumped.unionByName(still).unionByName(hooks).distinct(), "forest")
    raise RuntimeError(f"components not found in {max_levels} levels")
