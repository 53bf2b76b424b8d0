"""Connected components by randomised contraction (Bögeholz, Brand, Todor: in-database connected components).

Each round renames all nodes by a bijection that differs from round to round, merges every node into the
smallest of itself and its neighbours, and carries the edges over to the merged nodes; edges inside a
merged node vanish.  A round keeps a constant share of the nodes at most (in expectation), a star of any
size is done in one or two, and the smallest neighbour is an aggregate with map-side combining and a hub's new name is sent to its edges, so a node
with a third of all edges costs no task more than its share.  Nothing is gathered on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import join_facts, materialize

MAX_ROUNDS = 60
#: A node with more edges than this, and than its share of all, is joined without gathering them.
HOT_EDGES = 50_000


def _renamed(x: Column, k: int) -> Column:
    """A bijection of longs: xor-shifts, whose distances vary with the round (no overflow under ANSI rules)."""
    # fixed values: shift triples of full period
    a, b, c = ((13, 7, 17), (23, 17, 26), (21, 35, 4), (17, 31, 8), (5, 47, 23))[k % 5]
    x = x.bitwiseXOR(F.lit(0x5851F42D4C957F2D >> (k % 7)))
    for left, n in ((True, a), (False, b), (True, c), (True, a), (False, b), (True, c)):
        x = x.bitwiseXOR(F.shiftleft(x, n) if left else F.shiftrightunsigned(x, n))
    return x


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges are pairs of longs; nulls, loops, repeated and reversed pairs are harmless.  No edge, no row.
    """
    plain = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialize(plain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    steps: list[DataFrame] = []
    while total := now.count():
        k = len(steps)
        if k >= MAX_ROUNDS:
            raise RuntimeError("components did not settle")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = materialize(
            both.groupBy("a").agg(F.min(_renamed(F.col("b"), k)).alias("low"))
            .select(F.col("a").alias("node"), F.least(_renamed(F.col("a"), k), "low").alias("into")), "cc-step")
        steps.append(best)
        one = join_facts(now, best.select(F.col("node").alias("a"), F.col("into").alias("x")), "a", hot_rows=HOT_EDGES, total=total)
        two = join_facts(one, best.select(F.col("node").alias("b"), F.col("into").alias("y")), "b", hot_rows=HOT_EDGES, counted=now, total=total)
        now = materialize(
            two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    if not steps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    first = steps[0].withColumnRenamed("into", "label")

    def carried(labels: DataFrame, step: tuple[int, DataFrame]) -> DataFrame:
        k, best = step
        return labels.join(best.select(F.col("node").alias("label"), "into"), "label", "left").select(
            "node", F.coalesce("into", _renamed(F.col("label"), k)).alias("label"))

    labels = materialize(reduce(carried, enumerate(steps[1:], 1), first), "cc-labels")
    names = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(names, "label").select("node", "component")
