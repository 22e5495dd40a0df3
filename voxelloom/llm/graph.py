"""Connected components of a distributed edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import common

#: Nodes that one task's forest holds before it is handed on.
HELD_NODES = 1 << 19
#: Edges (two ids of 16 bytes, so 4 MB) that one task may finish alone.
ONE_TASK_EDGES = 1 << 17


class Forest:
    """Union-find over ids; the root of a tree is its smallest id."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(above, above)
        return x

    def join(self, a, b) -> bool:
        """Whether ``a`` and ``b`` were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _stars(batches, kind: pa.DataType, held: int | None, roots: bool):
    """Edges (a, b) as stars around their smallest id."""
    forest = Forest()

    def out():
        rows = [(x, forest.root(x)) for x in list(forest.up)]
        rows = [r for r in rows if roots or r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if held is not None and len(forest.up) > held:
            yield out()
            forest.up.clear()
    yield out()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b: binary); label: smallest node.

    Every task first replaces its edges by stars, which keeps what is
    connected.  At most ``one_task`` edges are finished by one task.  Beyond
    that, large-star and small-star steps alternate, each a grouped minimum and
    a join, until nothing changes; neighbours are never gathered in one place.
    Each round is written out, so a lost executor never replays earlier ones.
    """
    schema, kind = "a binary, b binary", pa.binary()
    stars = edges.where("a <> b").select("a", "b").mapInArrow(lambda rows: _stars(rows, kind, HELD_NODES, False), schema)
    current = common.durable(stars, "edges")
    if current.count() <= one_task:
        done = current.repartition(1).mapInArrow(lambda rows: _stars(rows, kind, None, True), schema)
        return done.select(F.col("a").alias("node"), F.col("b").alias("label"))
    before = None
    while (now := _mark(current)) != before:
        before = now
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        paired = large.join(low, "a")
        small = paired.select("a", F.col("m").alias("b")).unionByName(
            paired.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        )
        current = common.durable(small.distinct(), "edges")
    labels = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return labels.unionByName(roots.join(labels, "node", "left_anti"))
